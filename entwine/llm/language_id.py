"""Language identification by nearest centroids.

Method: a text's vector holds its 1 to 3 letter n-grams (lower-cased, every run of other
characters one space) hashed into ``BUCKETS`` places, weighted (1 + ln count) * idf and
normalised. Document frequencies come from all learning documents. The vectors of a
sample of at most ``SAMPLE`` learning documents a language (those of smallest hash, the model's
documented bound) are clustered by spherical k-means into at most ``CENTROIDS`` clusters;
clusters of under ``MIN_SHARE`` of the sample go. A document gets the language of the centroid of greatest
cosine. It is ``rejected`` if its distance is over that centroid's limit, which is the
distance that ``INSIDE`` of the centroid's own documents keep, and a margin.

Weights and centroids are whole numbers, so a score is the same in any order and batch.

The model is languages x ``CENTROIDS`` x ``BUCKETS`` numbers; ``SHARD`` languages at a time are collected,
sent out and compared (a pass each, results written between), so a broadcast has a fixed bound.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; it is not learned
from, nor are documents with a null language or id. A null id is not held out. Rows that repeat an
id each count. Equal scores go to the language first in code-point order. Where nothing can be learned
all texts are ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, small, written

ORDERS, BUCKETS = (1, 2, 3), 1 << 14
SAMPLE, CENTROIDS, STEPS, MIN_SHARE = 400, 4, 12, 0.05
INSIDE, MARGIN = 0.99, 0.05
SPARE = 4
SHARD = 128
#: Texts turned into dense rows at once, and letters read at once from a long text.
TEXTS, LETTERS = 64, 1 << 20
#: Whole-number scales of weights and centroids: sums stay below 2**53.
WEIGHT, CENTROID = 256, 1 << 20
FOLDS, HELD_OUT = 4, 2


@cache
def letter_table() -> np.ndarray:
    """For every code point 0 (no letter), 1 (a mark, part of a word) or 2 (a letter)."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kinds[i] = {"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0)
    return kinds


def has_letter(text: str | None) -> bool:
    kinds = letter_table()
    return any((kinds[np.frombuffer(text[at:at + LETTERS].encode("utf-32-le", "surrogatepass"), np.uint32)] == 2).any()
               for at in range(0, len(text or ""), LETTERS))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, a block of letters at a time."""
    kinds = letter_table()
    tail = np.array([32], np.uint64)  # words begin and end at a space
    for at in range(0, len(text), LETTERS):
        piece = text[at:at + LETTERS].lower() + ("" if at + LETTERS < len(text) else " ")
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.concatenate([tail, np.where(kinds[code] > 0, code, 32).astype(np.uint64)])
        new = np.arange(len(code)) >= len(tail)
        new[1:] &= (code[1:] != 32) | (code[:-1] != 32)
        new[:len(tail)] = True
        code, seen = code[new], len(tail)
        key, found = code, []
        for order in ORDERS:  # three code points of 21 bits make an exact key
            if order > 1:
                key = key[1:] | (code[:1 - order] << np.uint64(21 * (order - 1)))
            last = key[max(seen - order + 1, 0):]
            found.append(last[last != 32] if order == 1 else last)
        yield (np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        tail = code[1 - max(ORDERS):]


def counts(texts: list[str | None]) -> np.ndarray:
    """Counts of n-grams by bucket, a row a text; a text without a letter has none."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    for i, text in enumerate(texts):
        for found in grams(text) if has_letter(text) else ():
            out[i] += np.bincount(found, minlength=BUCKETS)
    return out


def weights(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Whole-number weights of counts, as floats."""
    out = np.zeros(n.shape)
    row, at = np.nonzero(n)
    out[row, at] = np.rint((1 + np.log(n[row, at])) * idf[at] * WEIGHT)
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        for at in range(0, part.num_rows, TEXTS):
            yield part.slice(at, TEXTS)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learning(docs: DataFrame) -> DataFrame:
    """(lang, text, h) of the documents to learn from."""
    return (docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
            .select("lang", "text", F.xxhash64("doc_id", "text").alias("h")))


def inverse_frequencies(learn: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the bucket)) + 1 over all of ``learn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for part in blocks(batches):
            total[:BUCKETS] += (counts(part.column(0).to_pylist()) > 0).sum(axis=0)
            total[BUCKETS] += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = learn.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    total = np.zeros(BUCKETS + 1)
    total[[r.at for r in got]] = [r.n for r in got]
    return np.log((1 + total[BUCKETS]) / (1 + total[:BUCKETS])) + 1


def clustered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the rows of ``x`` (of unit length) and the limit of each centroid's distance."""
    def unit(c: np.ndarray) -> np.ndarray:
        return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    k = min(CENTROIDS, len(x))
    by_mean = np.argsort(x @ x.sum(axis=0), kind="stable")
    centre = x[by_mean[(2 * np.arange(k) + 1) * len(x) // (2 * k)]]
    for _ in range(STEPS):
        to = np.argmax(x @ centre.T, axis=1)
        sums = np.stack([x[to == j].sum(axis=0) for j in range(k)])
        centre = np.where(np.bincount(to, minlength=k)[:, None] > 0, unit(sums), centre)
    size = np.bincount(np.argmax(x @ centre.T, axis=1), minlength=k)
    centre = centre[(size >= MIN_SHARE * len(x)) | (size == size.max())]
    near = x @ centre.T
    to, far = np.argmax(near, axis=1), 1 - near.max(axis=1)
    limit = np.array([np.quantile(far[to == j], INSIDE) if (to == j).any() else 0.0 for j in range(len(centre))])
    return np.rint(centre * CENTROID).astype(np.int64), limit + MARGIN


def smallest(learn: DataFrame, sample: int) -> DataFrame:
    """(_lang, _h): the ``sample`` smallest hashes of each language. Hashes are uniform, so those below
    a share that leaves some ``SPARE`` times the sample are ranked, not those of all documents."""
    keys = written(learn.select("lang", "h").distinct(), "language-hashes")
    each = small(keys.groupBy(F.col("lang").alias("_lang")).agg((sample * SPARE / F.count("*")).alias("share")))
    low = keys.join(each, F.col("lang") == F.col("_lang")).where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return low.select(F.col("lang").alias("_lang"), F.col("h").alias("_h"), rank.alias("k")).where(F.col("k") <= sample).drop("k")


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """The centroids (lang, k, centre, within), written, and the inverse document frequencies."""
    learn = learning(docs)
    idf = inverse_frequencies(learn)
    keys = small(written(smallest(learn, sample), "language-sample"))
    rows = learn.join(keys, (F.col("h") == F.col("_h")) & (F.col("lang") == F.col("_lang"))).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            w = weights(counts(part.column(2).to_pylist()), sent.value)
            at = [np.flatnonzero(r) for r in w]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([r[i].astype(np.int64) for r, i in zip(w, at)], pa.list_(pa.int64()))],
                                             ["lang", "h", "at", "w"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:  # at most ``sample`` rows
        group = group.sort_values("h")
        x = np.zeros((len(group), BUCKETS))
        for i, (at, w) in enumerate(zip(group["at"], group["w"])):
            x[i, at] = w
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "k": [], "centre": [], "within": []})
        centre, limit = clustered(x / np.linalg.norm(x, axis=1, keepdims=True))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": np.arange(len(limit)), "centre": list(centre), "within": limit})

    model = (rows.mapInArrow(sparse, "lang string, h long, at array<int>, w array<long>").groupBy("lang")
             .applyInPandas(cluster, "lang string, k int, centre array<long>, within double"))
    return written(model, "language-centroids"), idf


def compared(rows: DataFrame, model: list, idf: np.ndarray, last: bool) -> DataFrame:
    """``rows`` (doc_id, held_out, lang_pred, score, rejected, text) with the result so far and that of ``model``."""
    centre = np.array([r.centre for r in model], float).reshape(-1, BUCKETS)
    sent = rows.sparkSession.sparkContext.broadcast((centre.T, np.linalg.norm(centre, axis=1), np.array([r.lang for r in model], object), np.array([r.within for r in model]), idf))
    names = rows.columns[:-1] if last else rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, length, langs, within, idf = sent.value
        for part in blocks(batches):
            w = weights(counts(part.column(5).to_pylist()), idf)
            size = np.sqrt((w * w).sum(axis=1))
            pred, score, out = (np.array(part.column(i).to_pylist(), object) for i in (2, 3, 4))
            if len(langs):
                near = np.clip(w @ centre / np.maximum(size[:, None] * length, 1e-12), 0, 1)
                to = np.argmax(near, axis=1)
                near = np.round(near[np.arange(len(to)), to], 6)
                take = (size > 0) & ((pred == "und") | (near > score.astype(float)))
                pred[take], score[take], out[take] = langs[to[take]], near[take], (1 - near > within[to])[take]
            done = [part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_()), part.column(5)]
            yield pa.RecordBatch.from_arrays(done[:len(names)], names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:len(names)]))


def predict(docs: DataFrame, model: DataFrame, idf: np.ndarray, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"),
                       F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), "text")
    langs = sorted(r.lang for r in model.select("lang").distinct().collect())
    for at in range(0, max(len(langs), 1), shard):
        part = model.where(F.col("lang").isin(langs[at:at + shard])).orderBy("lang", "k").collect()  # at most shard x CENTROIDS rows
        last = at + shard >= len(langs)
        rows = compared(rows, part, idf, last)
        rows = rows if last else written(rows, "language-scores")
    return rows


def identify(docs: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    return predict(docs, *train(docs, sample), shard=shard)
