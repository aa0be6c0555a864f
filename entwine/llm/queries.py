"""Registered queries: each applies one operator, with its production parameters, to its
whole table."""

from __future__ import annotations

from . import (chat_rotation, decontaminate, kn_quality, language_id, license_scan, line_dedup, mixing, quality_rules, secret_scan, simhash_dedup, spelling,
               substring_dedup, vector_codes)
from .common import table

QUERIES = {
    "op1_license_scan": lambda spark, sf_dir: license_scan.digest(table(spark, sf_dir, "documents")),
    "op2_quality_rules": lambda spark, sf_dir: quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_source_mixing": lambda spark, sf_dir: mixing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_substring_dedup": lambda spark, sf_dir: substring_dedup.digest(table(spark, sf_dir, "documents")),
    "op5_simhash_dedup": lambda spark, sf_dir: simhash_dedup.digest(table(spark, sf_dir, "documents")),
    "op6_kn_quality": lambda spark, sf_dir: kn_quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_chat_rotation": lambda spark, sf_dir: chat_rotation.rotate(table(spark, sf_dir, "conversations")),
    "op8_secret_scan": lambda spark, sf_dir: secret_scan.digest(table(spark, sf_dir, "documents")),
    "op9_line_dedup": lambda spark, sf_dir: line_dedup.digest(table(spark, sf_dir, "documents")),
    "op10_decontaminate": lambda spark, sf_dir: decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op11_language_id": lambda spark, sf_dir: language_id.identify(table(spark, sf_dir, "documents")),
    "op12_spelling_variants": lambda spark, sf_dir: spelling.digest(table(spark, sf_dir, "documents")),
    "op13_vector_codes": lambda spark, sf_dir: vector_codes.digest(table(spark, sf_dir, "embeddings")),
}

ORACLE = {
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op7_chat_rotation": chat_rotation.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
