"""Readers for the given parquet tables and the ``visits`` fact view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import VISIT_COLUMNS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LINEITEM_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                    "l_shipdate")

# Row bound checked before a dimension table is broadcast; above it the join
# shuffles on its key (and AQE may still pick a broadcast from runtime sizes).
DIMENSION_BOUND = 500_000
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def broadcast_if_bounded(df: DataFrame, max_rows: int = DIMENSION_BOUND) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (a limit, not a full count), so it
    stays cheap even when the table turns out to be large; beyond the bound the
    plain frame is returned and the planner (with AQE) picks a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def broadcast_if_bytes(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its values take at most ``max_bytes``: the text of its string
    columns, ``ROW_BYTES`` a row and column for the rest. Beyond that the join shuffles."""
    texts = [F.coalesce(F.sum(F.octet_length(f.name).cast("long")), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    nested = [F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(f.name))).cast("long")), F.lit(0)) for f in df.schema
              if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    size = df.agg(sum(texts + nested, F.count(F.lit(1)) * ROW_BYTES * len(df.columns))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


def raw_visits(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """The raw fact table: one row per line item, with the order, customer, region
    and part it belongs to, and the fact columns under their domain names; with
    ``since`` only those of orders from that time on.

    The customer dimension (customer ⋈ nation ⋈ region), part and orders are broadcast only
    after a bounded row-count check, else shuffle-joined. Customers are joined to the orders, of
    which there are fewer than line items. Line items whose orders are broadcast stay where they lie;
    else they get their part first, while they are narrow. So they are shuffled twice at most: by part,
    unless that is broadcast, and by order. Only the columns a query uses survive column
    pruning, so the scans read a handful of columns.
    """
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders")
    cu = read_table(spark, sf_dir, "customer")
    na = broadcast_if_bounded(read_table(spark, sf_dir, "nation"))
    rg = broadcast_if_bounded(read_table(spark, sf_dir, "region"))
    pt = read_table(spark, sf_dir, "part")
    cust = broadcast_if_bounded(
        cu.join(na, cu.c_nationkey == na.n_nationkey)
          .join(rg, F.col("n_regionkey") == rg.r_regionkey)
          .select("c_custkey", "c_name", "c_mktsegment", "r_name"))
    part = broadcast_if_bounded(pt.select("p_partkey", "p_name", "p_brand", "p_type"))
    of_customer, of_order, of_part = F.col("o_custkey") == F.col("c_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey") == F.col("p_partkey")
    if since is not None:
        od = od.where(F.col("o_orderdate") >= since)
    if od.limit(DIMENSION_BOUND + 1).count() <= DIMENSION_BOUND:
        v = li.join(broadcast_if_bounded(od.join(cust, of_customer)), of_order).join(part, of_part)
    else:
        v = li.join(part, of_part).join(od.join(cust, of_customer), of_order)
    mapped = [F.col(src).alias(dst) for dst, src in VISIT_COLUMNS.items()]
    return v.select(*mapped, *LINEITEM_COLUMNS)
