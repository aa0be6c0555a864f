"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
#: Text handled at once inside a task, in bytes; a single longer document is one piece.
PIECE_BYTES = 2 << 20
#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, read from
    there by every later step, and still there when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted up to the
    bound and no further), else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Column ``doc_id`` of the documents labelled as good: all their label rows have
    quality 1 and none is toxic (a null label counts as neither)."""
    return (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
            .where("q = 1 and t = 0").select("doc_id"))


def mark_trusted(docs: DataFrame, labels: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the boolean column ``trusted``."""
    side = small(trusted_ids(labels).withColumnRenamed("doc_id", "_id"), rows)
    return (docs.join(side, F.col("doc_id") == F.col("_id"), "left")
            .withColumn("trusted", F.col("_id").isNotNull()).drop("_id"))


def text_hash() -> F.Column:
    """What tells rows that repeat a ``doc_id`` apart."""
    return F.xxhash64("text")


def words(text) -> F.Column:
    """Array of the words of a text column; null and blank give none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each, at least a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        group = (np.cumsum(n) - n) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, lens = lists.flatten(), np.diff(np.asarray(lists.offsets))
    full = np.asarray(pc.not_equal(flat, "").cast(pa.uint8())).astype(bool)
    row = np.repeat(np.arange(len(texts)), lens)
    return flat.filter(pa.array(full)), np.bincount(row[full], minlength=len(texts)).astype(np.int64)
