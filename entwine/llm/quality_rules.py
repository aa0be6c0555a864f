"""Quality rules: text measures, and a log-likelihood ratio of hashed n-grams.

Method: unigrams and bigrams of tokens (runs of word characters, runs of symbols) are
hashed into 65,536 buckets. Bucket counts over trusted documents and over the whole
corpus are two multinomials (add-one smoothed); a document's score is the mean of its
n-grams' log ratios, in millionths and summed as whole numbers, so it is the same in any order. Every
document with a score of ``threshold`` or more passes; no sampling takes part.

Counting: each task adds up its documents in two arrays of 65,536 numbers and sends them
once; so the tables that are joined, collected and sent out have at most that many rows.

Defined results: words are runs of anything but ASCII white space. A null or blank text
has no words, fails the base rules and has a null score. Rows that repeat a ``doc_id``
are each judged and counted. A document with label rows is trusted if all of them say
quality 1 and not toxic. Without trusted documents all scores are 0 and the base decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark_trusted, pieces, split_words

BUCKETS = 1 << 16
#: Mean log ratio, in millionths, below which a document is rejected.
THRESHOLD = -400_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TOKEN = re.compile(r"\w+|[^\w\s]+")


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every unigram and bigram."""
    lists = [TOKEN.findall(t) if t else [] for t in texts.to_pylist()]
    n = np.array([len(x) for x in lists], np.int64)
    coded = pa.array([t for x in lists for t in x], pa.large_string()).dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[np.asarray(coded.indices)] if n.sum() else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(row[1:] == row[:-1])
    two = (h[pair] * np.uint64(0x9E3779B97F4A7C15) ^ h[pair + 1]) * np.uint64(0xBF58476D1CE4E5B9)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([row, row[pair]]), (np.concatenate([h, two]) >> shift).astype(np.int64)


def bucket_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, target, raw): n-grams of trusted and of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for part in pieces(batches):
            row, bucket = buckets_of(part.column(0))
            good = np.asarray(part.column(1).cast(pa.uint8())).astype(bool)
            sums[1] += np.bincount(bucket, minlength=BUCKETS)
            sums[0] += np.bincount(bucket[good[row]], minlength=BUCKETS)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "target", "raw"])

    return (mark_trusted(docs.select("doc_id", "text"), labels).select("text", "trusted")
            .mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The log ratio of each bucket in millionths; ``counts`` has at most ``BUCKETS`` rows."""
    got = np.array([(r.bucket, r.target, r.raw) for r in counts.collect()], np.int64).reshape(-1, 3)
    both = np.ones((2, BUCKETS))
    both[:, got[:, 0]] += got[:, 1:].T
    if not got[:, 1].sum():
        return np.zeros(BUCKETS, np.int64)
    logs = np.log(both / both.sum(axis=1, keepdims=True))
    return np.rint((logs[0] - logs[1]) * 1e6).astype(np.int64)


def repeated_words(row: np.ndarray, ids: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text, its words inside 3-word windows that it holds twice or more.
    ``ids`` are exact word numbers, made into exact numbers of pairs and triples."""
    out = np.zeros(n_texts, np.int64)
    if len(ids) < 3:
        return out
    pair = np.unique(ids[:-1].astype(np.int64) * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    triple = np.unique(pair[:-1].astype(np.int64) * (ids.max() + 1) + ids[2:], return_inverse=True)[1]
    at = np.flatnonzero(row[2:] == row[:-2])
    key, n = np.unique(triple[at].astype(np.int64) * n_texts + row[at], return_inverse=True, return_counts=True)[1:]
    twice = at[n[key] > 1]
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[twice + k] = True
    return np.bincount(row[inside], minlength=n_texts)


def repeated_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, ratios: np.ndarray, threshold: int = THRESHOLD) -> DataFrame:
    """The measures, score and verdict of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            texts = part.column(1)
            flat, n = split_words(texts)
            row = np.repeat(np.arange(len(n)), n)
            chars = np.bincount(row, np.asarray(pc.utf8_length(flat)), len(n)).astype(np.int64)
            whole = pc.fill_null(texts, "")
            symbols = np.asarray(pc.count_substring_regex(whole, "[#*$%&|<>]")).astype(np.int64)
            again = repeated_words(row, np.asarray(flat.dictionary_encode().indices), len(n))
            failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
            of, bucket = buckets_of(texts)
            size = np.bincount(of, minlength=len(n))
            total = np.bincount(of, sent.value[bucket], len(n)).astype(np.int64)  # whole numbers far below 2**53
            score = total // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(chars), pa.array(symbols), pa.array([repeated_lines(t.as_py()) for t in texts], pa.int64()),
                 pa.array(again.astype(np.int64)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score, mask=size == 0)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio long")


def quality(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return judge(docs, log_ratios(bucket_counts(docs, labels)), threshold)
