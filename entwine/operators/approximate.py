"""Approximate nearest neighbours: a scan of small codes, then exact distances of a few candidates.

The index holds every vector as four bits a component: sixteen equal steps about the component's mean, as
wide as its spread asks for, so an eighth of the bytes of floats is read. A search sends the queries to the tasks
in blocks of proven size; each task scores its codes and keeps a query's ``k * WIDEN`` best, these are
merged, and only the ``k * WIDEN`` best of all meet the stored vectors for their exact distances. So every query
gets ``k`` rows wherever the table has as many, and no pair besides the candidates is ever a row.
Recall against ``nearest.topk`` is measured by ``recall``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import broadcast_if_bytes
from . import nearest as N

#: Candidates of a query for each row asked for.
WIDEN = 5
LEVELS = 16
#: Step of sixteen equal levels, in standard deviations, that distorts a normal component least.
STEP = 0.335


def usable(vec: str | Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    whole = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    return F.coalesce(F.forall(vec, whole), F.lit(False))


def scale(vectors: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(mean, step) of each component over all vectors: a row a component comes to the driver."""
    parts = vectors.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = sorted(parts.collect())
    nine = lambda xs: np.array([float(f"{x:.9g}") for x in xs])  # noqa: E731  # sums in any order give one scale
    step = nine(r.s * STEP for r in rows)
    return nine(r.m for r in rows), np.where(step > 0, step, 1.0)


def pack(x: np.ndarray, mean: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Two components a byte; an odd last one has a byte of its own."""
    code = np.clip(np.floor((x - mean) / step) + LEVELS // 2, 0, LEVELS - 1).astype(np.uint8)
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return code[:, ::2] << 4 | code[:, 1::2]


def unpack(code: np.ndarray, mean: np.ndarray, step: np.ndarray) -> np.ndarray:
    both = np.stack([code >> 4, code & 15], axis=2).reshape(len(code), -1)[:, :len(mean)]
    return mean + (both - (LEVELS - 1) / 2) * step


def build(vectors: DataFrame, key: str, vec: str = "vec") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The index of ``vectors``: (``key``, code) of every usable row, written once, and its scale."""
    rows = vectors.select(F.col(key).alias("_d"), F.col(vec).alias("_v")).where(F.col("_d").isNotNull() & usable("_v"))
    mean, step = scale(rows, "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = pack(N.matrix(batch.column(1)), mean, step)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["_d", "code"])

    codes = rows.mapInArrow(run, f"_d {rows.schema['_d'].dataType.simpleString()}, code binary")
    return cut_lineage(codes.withColumnRenamed("_d", key)), mean, step


def topk(queries: DataFrame, q_key: str, corpus: DataFrame, d_key: str, k: int = 10, vec: str = "vec",
         index: tuple[DataFrame, np.ndarray, np.ndarray] | None = None, widen: int = WIDEN, sent_bytes: int = N.SENT_BYTES) -> DataFrame:
    """(q_key, rank, d_key, distance): ``k`` near rows of ``corpus`` for each row of ``queries``, with their
    exact squared distances; ties go to the smaller id. ``index`` is what ``build`` made of ``corpus``.

    Vectors have one length. Rows without a key or with a null or non-finite component are left
    out. Keys must not repeat."""
    codes, mean, step = index or build(corpus, d_key, vec)
    qs = queries.select(F.col(q_key).alias("_q"), F.col(vec).alias("_v"), F.lit(k * widen).alias("_k")).where(F.col("_q").isNotNull() & usable("_v"))
    ds = codes.select(F.col(d_key).alias("_d"), F.col("code").alias("_v"))
    kinds = ", ".join(f"{n} {t}" for n, t in (("_q", qs.schema["_q"].dataType.simpleString()), ("_d", ds.schema["_d"].dataType.simpleString()), ("distance", "double")))

    def read(column: pa.Array) -> np.ndarray:
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
        return unpack(flat.reshape(len(column), -1), mean, step)

    near = N.by_queries(qs, ds, kinds, N.squared_l2, sent_bytes, read)
    best = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_d"))
    near = cut_lineage(near.withColumn("_r", best).where(F.col("_r") <= k * widen).select("_q", "_d"))
    full = corpus.select(F.col(d_key).alias("_d"), F.col(vec).alias("_x")).join(broadcast_if_bytes(near), "_d").join(broadcast_if_bytes(qs.select("_q", "_v")), "_q")
    gaps = F.zip_with("_v", "_x", lambda a, b: a.cast("double") - b.cast("double"))
    exact = full.select("_q", "_d", F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g).alias("distance"))
    return (exact.withColumn("rank", best.cast("long")).where(F.col("rank") <= k)
            .select(F.col("_q").alias(q_key), "rank", F.col("_d").alias(d_key), "distance"))


def recall(found: DataFrame, exact: DataFrame, q_key: str, d_key: str) -> DataFrame:
    """One row (n_exact, n_found, recall): the share of the exact neighbours that were found."""
    hit = found.select(q_key, d_key).distinct().withColumn("_hit", F.lit(1))
    both = exact.select(q_key, d_key).join(hit, [q_key, d_key], "left")
    return both.agg(F.count("*").alias("n_exact"), F.count("_hit").alias("n_found")).withColumn(
        "recall", F.when(F.col("n_exact") > 0, F.col("n_found") / F.col("n_exact")))
