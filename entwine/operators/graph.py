"""Co-occurrence graph as two tables, plus degree, centrality and display payload.

nodes(id, label, node_type, color, count, title)  id = "<node_type>:<label>"
edges(src, dst, relationship, weight, title)     one row per unordered pair, hub first

Nodes come from the entity profile and edges from the shared pair counts, so the
graph costs no extra scan of the fact table. Whole-graph numbers (node count,
largest weight) enter row expressions as scalar subqueries, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded_ratio
from ..functions.text import edge_tooltip, node_tooltip, tooltip_plain
from ..spec import GraphSpec, HEALTHCARE


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def node_id(node_type: Column | str, label: Column | str) -> Column:
    t = F.col(node_type) if isinstance(node_type, str) else node_type
    lab = F.col(label) if isinstance(label, str) else label
    return F.concat(t, F.lit(":"), lab)


def color_of(node_type: Column, spec: GraphSpec = HEALTHCARE) -> Column:
    return F.coalesce(_map(spec.colors)[node_type], F.lit(spec.default_color))


def type_label_of(node_type: Column, spec: GraphSpec = HEALTHCARE) -> Column:
    return _map({a.node_type: a.type_label for a in spec.node_attrs})[node_type]


def nodes_from_counts(counts: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """counts(entity_type, entity, patient_count) → nodes."""
    t = F.col("entity_type")
    return counts.select(node_id("entity_type", "entity").alias("id"),
                         F.col("entity").alias("label"),
                         t.alias("node_type"),
                         color_of(t, spec).alias("color"),
                         F.col("patient_count").alias("count"),
                         node_tooltip("entity", type_label_of(t, spec), "patient_count").alias("title"))


def relation_edges(pairs: DataFrame, spec: GraphSpec = HEALTHCARE, only: str | None = None) -> DataFrame:
    """pairs(pair, a, b, n) → edges for every hub relation (or just ``only``), in one
    pass: a literal map routes each hub pair row to its relation. A relation with
    ``top_k`` keeps the k heaviest targets per hub (ties by label); that window
    runs on aggregated counts and plans as a WindowGroupLimit."""
    order = [a.key for a in spec.attributes]
    hub = spec.attr(spec.hub)
    routes = {}
    for r in spec.relations:
        if only and r.name != only:
            continue
        tgt = spec.attr(r.target)
        x, y = sorted((hub.key, tgt.key), key=order.index)
        routes[f"{x}|{y}"] = (r, tgt, x != hub.key)
    info = F.create_map(*[x for k, (r, tgt, flip) in routes.items() for x in (
        F.lit(k), F.struct(F.lit(r.name).alias("rel"), F.lit(r.unit).alias("unit"),
                           F.lit(tgt.node_type).alias("ttype"), F.lit(flip).alias("flip"),
                           F.lit(r.top_k or 0).alias("top_k")))])
    e = (pairs.where(F.col("pair").isin(list(routes)))
              .select(info[F.col("pair")].alias("r"), "a", "b", "n")
              .select("r", F.when(F.col("r.flip"), F.col("b")).otherwise(F.col("a")).alias("h"),
                      F.when(F.col("r.flip"), F.col("a")).otherwise(F.col("b")).alias("t"), "n"))
    w = Window.partitionBy("r.rel", "h").orderBy(F.desc("n"), F.asc("t"))
    e = (e.withColumn("_k", F.when(F.col("r.top_k") > 0, F.row_number().over(w)).otherwise(F.lit(0)))
          .where((F.col("r.top_k") == 0) | (F.col("_k") <= F.col("r.top_k"))))
    out = e.select(node_id(F.lit(hub.node_type), F.col("h")).alias("src"),
                   node_id(F.col("r.ttype"), F.col("t")).alias("dst"),
                   F.col("r.rel").alias("relationship"),
                   F.col("n").alias("weight"),
                   edge_tooltip(F.col("r.rel"), F.col("n"), F.col("r.unit")).alias("title"))
    return out.where(F.col("src") != F.col("dst"))   # no self-loops


def both_directions(edges: DataFrame) -> DataFrame:
    """edges ∪ reversed: (id, other, relationship, weight) for adjacency lookups."""
    fwd = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relationship", "weight")
    rev = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relationship", "weight")
    return fwd.unionByName(rev)


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    deg = both_directions(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return (nodes.join(deg, "id", "left")
                 .withColumn("degree", F.coalesce(F.col("degree"), F.lit(0)).cast("long")))


def with_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds degree, centrality = degree / (n-1) at 4 decimals (1 when n ≤ 1) and
    radius = 18 + 44·centrality at 1 decimal (from the unrounded centrality)."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    d = node_degree(nodes, edges)
    den = n - 1
    cen = F.when(n <= 1, F.lit(1.0)).otherwise(rounded_ratio(F.col("degree"), den, 4))
    rad = F.when(n <= 1, F.lit(62.0)).otherwise(
        rounded_ratio(F.lit(18) * den + F.lit(44) * F.col("degree"), den, 1))
    return d.withColumn("centrality", cen).withColumn("radius", rad)


def max_edge_weight(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.max("weight"), F.lit(1)).cast("long").alias("max_weight"))


def with_width(edges: DataFrame) -> DataFrame:
    """width = 0.8 + 5·weight/max_weight at 2 decimals."""
    mx = max_edge_weight(edges).scalar()
    w = F.coalesce(F.col("weight"), F.lit(1))
    return edges.withColumn("width", rounded_ratio(F.lit(80) * mx + F.lit(500) * w, mx * 100, 2))


def graph_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = with_centrality(nodes, edges)
    return c.select("id", F.col("label").alias("node"),
                    F.coalesce(F.col("node_type"), F.lit("unknown")).alias("node_type"),
                    "degree", "centrality",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("patient_count"))


def payload_nodes(nodes: DataFrame, edges: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    c = with_centrality(nodes, edges)
    return c.select("id", "label",
                    F.coalesce(F.col("color"), F.lit(spec.default_color)).alias("color"),
                    "radius",
                    F.coalesce(F.col("node_type"), F.lit(spec.default_node_type)).alias("node_type"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    tooltip_plain(F.coalesce(F.col("title"), F.col("label"))).alias("tooltip"))


def payload_links(edges: DataFrame) -> DataFrame:
    w = with_width(edges)
    return w.select(F.col("src").alias("source"), F.col("dst").alias("target"),
                    F.coalesce(F.col("weight"), F.lit(1)).cast("long").alias("weight"), "width",
                    F.coalesce(F.col("relationship"), F.lit("")).alias("relationship"),
                    tooltip_plain(F.coalesce(F.col("title"), F.lit(""))).alias("tooltip"))


def ego_network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's ego network: the node itself and its 1-hop neighbours with the
    connecting edge (the display's hover highlight, as a query)."""
    nb = both_directions(edges).select(F.col("id").alias("center"), F.col("other").alias("member"),
                                       "relationship", "weight", F.lit(False).alias("is_center"))
    me = nodes.select(F.col("id").alias("center"), F.col("id").alias("member"),
                      F.lit(None).cast("string").alias("relationship"),
                      F.lit(None).cast("long").alias("weight"), F.lit(True).alias("is_center"))
    return me.unionByName(nb)
