"""Exact nearest neighbours over dense vectors.

One side is sent to every task, the other is read where it lies, and only the best k of a query leave
a task: no pair of vectors is ever a row. The corpus is sent if its vectors take at most
``SENT_BYTES``: each query is then finished in its own task. Otherwise the queries are sent, in as
many blocks as that bound asks for, each task keeps the best k of the rows it reads, and
k rows a query and task are merged.

Distances come from three numbers of a pair, dot, |q|² and |d|²; with whole-number components they are
exact in any order. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENT_BYTES = 32 << 20
#: Distances held at once inside a task.
CELLS = 1 << 22


def squared_l2(dot: np.ndarray, qq: np.ndarray, dd: np.ndarray) -> np.ndarray:
    return qq + dd - 2.0 * dot


def normalised_l2(dot: np.ndarray, qq: np.ndarray, dd: np.ndarray) -> np.ndarray:
    """Squared distance of the vectors at unit length; a zero vector stays zero."""
    both = np.sqrt(qq * dd)
    out = np.where(both > 0, 2.0 - 2.0 * dot / np.where(both > 0, both, 1.0), 1.0)
    return np.where((qq == 0) & (dd == 0), 0.0, out)


def matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    flat = np.asarray(column.flatten()).astype(float)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def smallest(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` least of each row, ties to the lower column, in order."""
    n = distance.shape[1]
    if k < n:
        edge = np.partition(distance, k - 1, axis=1)[:, k - 1:k]
        row, col = np.nonzero(distance <= edge)
    else:
        row, col = np.nonzero(np.ones_like(distance, bool))
    order = np.lexsort((col, distance[row, col], row))
    row, col = row[order], col[order]
    at = np.arange(len(row)) - np.searchsorted(row, row)
    return row[at < k], col[at < k]


def vector_bytes(df: DataFrame, key: str, vec: str) -> int:
    got = df.agg(F.sum(F.size(vec).cast("long") * 8), F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 64)).first()
    return (got[0] or 0) + (got[1] or 0)


def topk(queries: DataFrame, q_key: str, corpus: DataFrame, d_key: str, k: int | str = 4, vec: str = "vec",
         metric: Callable = squared_l2, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(q_key, rank, d_key, distance) of the ``k`` nearest rows of ``corpus`` for each row of ``queries``.

    ``k`` is a number or a column of ``queries``. Vectors are arrays of one length; rows without a key or
    vector, or with a k below 1, are left out; keys of queries are told apart, so they must not repeat."""
    ks = F.col(k) if isinstance(k, str) else F.lit(k)
    qs = queries.select(F.col(q_key).alias("_q"), F.col(vec).alias("_v"), ks.cast("int").alias("_k")).where("_q is not null and _v is not null and _k > 0")
    ds = corpus.select(F.col(d_key).alias("_d"), F.col(vec).alias("_v")).where("_d is not null and _v is not null")
    kinds = ", ".join(f"{n} {t}" for n, t in (("_q", qs.schema["_q"].dataType.simpleString()), ("_d", ds.schema["_d"].dataType.simpleString()), ("distance", "double")))
    if vector_bytes(ds, "_d", "_v") <= sent_bytes:
        found = _to_corpus(qs, ds, kinds, metric)
    else:
        found = by_queries(qs, ds, kinds, metric, sent_bytes).join(qs.select("_q", "_k"), "_q")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_d"))
    ranked = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= F.col("_k") if "_k" in found.columns else F.lit(True))
    return ranked.select(F.col("_q").alias(q_key), "rank", F.col("_d").alias(d_key), "distance")


def by_queries(qs: DataFrame, ds: DataFrame, kinds: str, metric: Callable, sent_bytes: int = SENT_BYTES, read: Callable = matrix) -> DataFrame:
    """(_q, _d, distance): the best ``_k`` of each task's rows of ``ds`` for every query, which are sent out
    in blocks of at most ``sent_bytes``; ``read`` gives the vectors of a column of ``ds``."""
    blocks = max(1, -(-vector_bytes(qs, "_q", "_v") // sent_bytes))
    found = None
    for b in range(blocks):
        part = _to_queries(qs.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b) if blocks > 1 else qs, ds, kinds, metric, read)
        found = part if found is None else found.unionByName(part)
    return found


def _sent(df: DataFrame) -> pa.Table:
    return df.toArrow().combine_chunks()


def _rows(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _to_corpus(qs: DataFrame, ds: DataFrame, kinds: str, metric: Callable) -> DataFrame:
    """(_q, _d, distance): every query against the whole corpus, sent out (at most SENT_BYTES)."""
    table = _sent(ds)
    if not table.num_rows:
        return qs.sparkSession.createDataFrame([], kinds)
    table = table.take(pa.array(np.argsort(np.array(_rows(table, "_d").to_pylist(), object), kind="stable")))
    sent = qs.sparkSession.sparkContext.broadcast((_rows(table, "_d"), matrix(_rows(table, "_v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, d = sent.value
        dd, step = (d * d).sum(axis=1), max(1, CELLS // len(d))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                q, k = matrix(part.column(1)), np.asarray(part.column(2))
                far = metric(q @ d.T, (q * q).sum(axis=1)[:, None], dd)
                row, col = smallest(far, int(min(k.max(), len(d))))
                fits = np.arange(len(row)) - np.searchsorted(row, row) < k[row]
                row, col = row[fits], col[fits]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), ids.take(pa.array(col)), pa.array(far[row, col])], ["_q", "_d", "distance"])

    return qs.mapInArrow(run, kinds)


def _to_queries(qs: DataFrame, ds: DataFrame, kinds: str, metric: Callable, read: Callable = matrix) -> DataFrame:
    """(_q, _d, distance): the best of each task's corpus rows for a block of queries, sent out."""
    table = _sent(qs)
    if not table.num_rows:
        return qs.sparkSession.createDataFrame([], kinds)
    sent = qs.sparkSession.sparkContext.broadcast((_rows(table, "_q"), matrix(_rows(table, "_v")), np.asarray(_rows(table, "_k"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, k = sent.value
        qq, step, most = (q * q).sum(axis=1)[:, None], max(1, CELLS // len(q)), int(k.max())
        held_row, held_far, held_id, kind = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = np.array(part.column(0).to_pylist(), object)
                order = np.argsort(ids, kind="stable")
                ids, d = ids[order], read(part.column(1))[order]
                far = metric(q @ d.T, qq, (d * d).sum(axis=1))
                row, col = smallest(far, min(most, len(d)))
                rows, fars, found = np.concatenate([held_row, row]), np.concatenate([held_far, far[row, col]]), np.concatenate([held_id, ids[col]])
                order = np.lexsort((found, fars, rows))
                rows = rows[order]
                fits = np.arange(len(rows)) - np.searchsorted(rows, rows) < k[rows]
                held_row, held_far, held_id = rows[fits], fars[order][fits], found[order][fits]
        if len(held_row):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(held_row)), pa.array(held_id.tolist(), kind), pa.array(held_far)], ["_q", "_d", "distance"])

    return ds.mapInArrow(run, kinds)
