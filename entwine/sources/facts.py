"""A user's own fact table: a CSV, JSON or Parquet folder whose columns are mapped by name onto the
columns that the operators read.

Text is cast to the column's type; a row whose text does not fit, or that has too many fields for its
header, is rejected whole and kept as it came with the reasons, so every row read is in one of the two results.
Nothing is inferred from the data, so all files of a folder are read alike and none is scanned twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import GraphSpec, HEALTHCARE
from .io import CSV

CORRUPT = "_corrupt_record"


def fact_types(spec: GraphSpec = HEALTHCARE) -> dict[str, str]:
    """Column → type of the fact table that ``spec`` asks for. The stay is derived, not read."""
    types = {"name": "string", "date_of_admission": "timestamp", "discharge_date": "timestamp"}
    types.update({a.column: "string" for a in spec.attributes})
    types.update({c: "double" for m, c in spec.metric_columns.items() if m != "stay"})
    return types


def _load(spark: SparkSession, path: str, fmt: str, options: Mapping[str, str]) -> DataFrame:
    if fmt != "csv":
        return spark.read.format(fmt).options(**options).load(path)
    options = {**CSV, "emptyValue": "", **options}
    header = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    return spark.read.schema(schema).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False).csv(path)


def _typed(raw: DataFrame, source: str, kind: str) -> tuple[Column, Column]:
    """(value, whether it does not fit). Text of white space alone is a missing number or date."""
    c = F.col(f"`{source}`")
    if kind == "string" or not isinstance(raw.schema[source].dataType, T.StringType):
        return c.cast(kind), F.lit(False)
    text = F.nullif(F.trim(c), F.lit(""))
    value = F.try_to_timestamp(text) if kind == "timestamp" else text.try_cast(kind)
    return value, text.isNotNull() & value.isNull()


def read_facts(spark: SparkSession, path: str, columns: Mapping[str, str], fmt: str = "csv",
               options: Mapping[str, str] | None = None, spec: GraphSpec = HEALTHCARE) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected) of the table at ``path``.

    ``columns`` maps each fact column to the name it has there; a fact column that is not mapped is
    null everywhere, which the operators leave out of every count and average of it. ``facts`` holds the fact columns only, so other
    columns of the table may have any name. ``rejected`` holds the rows as read with ``reasons``, the fact columns
    that did not fit (``_corrupt_record`` for a row that is not one of the table). A name that the
    table lacks, or a fact column that does not exist, raises ``ValueError``."""
    types = fact_types(spec)
    raw = _load(spark, path, fmt, options or {})
    wrong = sorted(set(columns) - set(types)) + sorted(set(columns.values()) - set(raw.columns))
    if wrong:
        raise ValueError(f"unknown columns: {', '.join(wrong)}")
    typed = {c: _typed(raw, columns[c], kind) if c in columns else (F.lit(None).cast(kind), F.lit(False)) for c, kind in types.items()}
    checks = [F.when(bad, F.lit(c)) for c, (_, bad) in typed.items()]
    if CORRUPT in raw.columns:
        checks.append(F.when(F.col(CORRUPT).isNotNull(), F.lit(CORRUPT)))
    reasons = F.array_compact(F.array(*checks))
    return (raw.where(F.size(reasons) == 0).select(*[v.alias(c) for c, (v, _) in typed.items()]),
            raw.withColumn("reasons", reasons).where(F.size("reasons") > 0))
