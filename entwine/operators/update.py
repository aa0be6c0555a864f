"""Incremental graph maintenance: take the newest records as a batch and upsert
their counts into a saved graph (create-or-update for nodes and edges).

Every step is a join or an aggregate; the batch is bounded by its size parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import edge_tooltip, node_tooltip
from ..spec import GraphSpec, HEALTHCARE

# Order that makes "the N most recent records" repeatable: the date, then every
# lineitem column (whole lineitem rows are unique; (orderkey, linenumber) is not).
TIE_BREAK = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def cutoff_day(df: DataFrame, n: int, date: str = "date_of_admission") -> DataFrame:
    """One row: the latest day with ``n`` rows on it or after it; null if fewer rows have a date.
    Rows are counted per day (map-side partial sums, a row for each day)."""
    timed = isinstance(df.schema[date].dataType, (T.TimestampType, T.TimestampNTZType))
    per_day = df.groupBy((F.date_trunc("day", date) if timed else F.col(date)).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    upto = per_day.withColumn("_upto", F.sum("_n").over(Window.orderBy(F.desc_nulls_last("_day"))))
    return upto.where(F.col("_upto") >= n).agg(F.max_by("_day", -F.col("_upto")).alias("_cutoff"))


def recent_batch(clean: DataFrame, n: int, date: str = "date_of_admission", tie_break: tuple[str, ...] | None = TIE_BREAK,
                 cutoff: DataFrame | None = None) -> DataFrame:
    """The ``n`` most recent records by ``date``, then ``tie_break`` (both descending; None: all other
    columns, so that only equal records are interchangeable).

    ``cutoff_day`` (or ``cutoff``, where the caller has it) is a scalar that Catalyst pushes to the scans. Only
    the records from that day on, ``n`` and the rest of one day, are sorted. Records without a
    date come last."""
    cutoff = (cutoff_day(clean, n, date) if cutoff is None else cutoff).scalar()
    if tie_break is None:
        tie_break = tuple(c for c in clean.columns if c != date)
    late = clean.where(cutoff.isNull() | (F.col(date) >= cutoff))
    return late.orderBy(F.desc_nulls_last(date), *(F.desc_nulls_last(c) for c in tie_break)).limit(n)


def upsert_nodes(base: DataFrame, batch_counts: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """base: nodes(id, label, node_type, color, count, title); batch_counts: (id, label,
    node_type, n). Existing nodes add n and get a new tooltip; others are inserted.
    Adds ``status`` ∈ {new, updated, unchanged}."""
    labels = F.create_map(*[x for a in spec.node_attrs for x in (F.lit(a.node_type), F.lit(a.type_label))])
    colors = F.create_map(*[x for k, v in spec.colors.items() for x in (F.lit(k), F.lit(v))])
    b = batch_counts.select("id", F.col("label").alias("b_label"), F.col("node_type").alias("b_type"), "n")
    j = base.withColumn("_saved", F.lit(True)).join(b, "id", "full_outer")
    count = F.coalesce(F.col("count"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0))
    node_type = F.coalesce(F.col("node_type"), F.col("b_type"))
    label = F.coalesce(F.col("label"), F.col("b_label"))
    status = (F.when(F.col("_saved").isNull(), "new")
               .when(F.col("n").isNotNull(), "updated").otherwise("unchanged"))
    return j.select(
        "id", label.alias("label"), node_type.alias("node_type"),
        F.coalesce(F.col("color"), colors[node_type], F.lit(spec.default_color)).alias("color"),
        count.cast("long").alias("count"),
        F.when(F.col("n").isNull(), F.col("title"))
         .otherwise(node_tooltip(label, labels[node_type], count)).alias("title"),
        status.alias("status"))


def upsert_edges(base: DataFrame, batch_edges: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """base: edges(src, dst, relationship, weight, title); batch_edges: (src, dst,
    relationship, n). Weights add up; a saved relationship is kept; the tooltip unit
    follows the relation."""
    units = F.create_map(*[x for r in spec.relations for x in (F.lit(r.name), F.lit(r.unit))])
    b = batch_edges.select("src", "dst", F.col("relationship").alias("b_rel"), "n")
    j = base.withColumn("_saved", F.lit(True)).join(b, ["src", "dst"], "full_outer")
    weight = F.coalesce(F.col("weight"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0))
    rel = F.coalesce(F.col("relationship"), F.col("b_rel"))
    status = (F.when(F.col("_saved").isNull(), "new")
               .when(F.col("n").isNotNull(), "updated").otherwise("unchanged"))
    return j.select(
        "src", "dst", rel.alias("relationship"), weight.cast("long").alias("weight"),
        F.when(F.col("n").isNull(), F.col("title"))
         .otherwise(edge_tooltip(rel, weight, F.coalesce(units[rel], F.lit("patients")))).alias("title"),
        status.alias("status"))


def update_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n_new, n_updated, n_total for nodes and edges."""
    def rep(df, kind):
        return df.agg(F.lit(kind).alias("kind"),
                      F.count_if(F.col("status") == "new").alias("n_new"),
                      F.count_if(F.col("status") == "updated").alias("n_updated"),
                      F.count(F.lit(1)).alias("n_total"))
    return rep(nodes, "nodes").unionByName(rep(edges, "edges"))
