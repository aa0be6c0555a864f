"""Positions in a total order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with the position (from 1) of every row in ``order``, which should be total.

    The rows are range-partitioned and sorted inside each partition; a row's position is its
    place there plus the number of rows in the partitions before, of which one count
    each is collected. The sorted rows are checkpointed, so that partitions stay as counted."""
    laid = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = laid.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["_part"], before))
        before += r["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))  # a row a partition
    # the id holds the partition above bit 33 and the place in it below
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(starts, "_part").select(*df.columns, at.alias(name))


def both_ends(df: DataFrame, order: list[Column], reverse: list[Column], k: int, name: str = "pos") -> DataFrame:
    """The first and the last ``k`` rows of ``df`` with their positions and ``grp`` (top or
    bottom); a row is in both if there are fewer than 2k. Two bounded sorts, no window."""
    def ends(by: list[Column], pos) -> DataFrame:
        rows = F.collect_list(F.struct(*df.columns))  # k rows, in order: they come from one sorted partition
        return df.orderBy(*by).limit(k).agg(rows.alias("rows")).select(F.posexplode("rows").alias("_i", "_row")).select("_row.*", pos(F.col("_i")).cast("long").alias(name))

    total = df.agg(F.count(F.lit(1))).scalar()
    top = ends(order, lambda i: i + 1).withColumn("grp", F.lit("top"))
    return top.unionByName(ends(reverse, lambda i: total - i).withColumn("grp", F.lit("bottom")))
