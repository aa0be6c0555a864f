"""Graph-enriched retrieval: resolve entity names to graph nodes, list their 1-hop
neighbours by relation, and attach that context to vector-search hits — for every
question of a table at once.

All joins are against the node/edge tables, whose size is bounded by the entity
count of the spec (checked before broadcast); the per-group lists (neighbours of a
node, hits of a question) are bounded by node degree and by k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fmt_int
from ..sources.tables import broadcast_if_bounded
from ..spec import GraphSpec, HEALTHCARE
from .graph import both_directions
from .linking import resolve

# The context texts' wording must equal the reference's.
NEIGHBOURS_HEADING = "Graph neighbours of '{}':"
NOT_FOUND = "Entity '{}' not found in graph."
NO_GRAPH = "Knowledge graph not available."
SECTION_DIVIDER = "\n\n---\n\n"
UNKNOWN_ENTITY = "unknown"
UNKNOWN_TOOL = "Unknown tool: "
NODE_BOUND = 1_000_000


def neighbors(nodes: DataFrame, edges: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """id, neighbour_id, neighbour (label), relationship, weight for every node."""
    lab = nodes.select(F.col("id").alias("other"), F.col("label").alias("neighbour"))
    b = both_directions(edges)
    return (b.join(broadcast_if_bounded(lab, NODE_BOUND), "other", "left")
             .select("id", F.col("other").alias("neighbour_id"),
                     F.coalesce(F.col("neighbour"), F.col("other")).alias("neighbour"),
                     F.coalesce(F.col("relationship"), F.lit(spec.default_relationship)).alias("relationship"),
                     F.coalesce(F.col("weight"), F.lit(0)).cast("long").alias("weight")))


def by_relation(nb: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """id, relationship, rel_order, line ``  REL: a (1,234 patients), …`` with
    neighbours by weight desc, then label."""
    order = F.create_map(*[x for i, r in enumerate(spec.relations) for x in (F.lit(r.name), F.lit(i))])
    item = F.struct(-F.col("weight"), F.col("neighbour"),
                    F.concat(F.col("neighbour"), F.lit(" ("), fmt_int("weight"), F.lit(" patients)")).alias("t"))
    g = nb.groupBy("id", "relationship").agg(F.array_sort(F.collect_list(item)).alias("xs"),
                                            F.count(F.lit(1)).alias("n_neighbours"))
    return g.select("id", "relationship", "n_neighbours",
                    F.coalesce(order[F.col("relationship")], F.lit(len(spec.relations))).alias("rel_order"),
                    F.concat(F.lit("  "), F.col("relationship"), F.lit(": "),
                             F.array_join(F.transform("xs", lambda x: x["t"]), ", ")).alias("line"))


def node_contexts(nodes: DataFrame, edges: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """id, context: heading plus one line per relation (relation order of the spec)."""
    lines = by_relation(neighbors(nodes, edges, spec), spec)
    agg = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rel_order", "relationship", "line")))
                                  .alias("ls"))
    j = nodes.select("id", "label").join(agg, "id", "left")
    head = F.concat(F.lit("Graph neighbours of '"), F.col("label"), F.lit("':"))
    body = F.array_join(F.transform(F.coalesce(F.col("ls"), F.array()), lambda x: x["line"]), "\n")
    return j.select("id", F.when(F.size(F.coalesce(F.col("ls"), F.array())) > 0,
                                 F.concat(head, F.lit("\n"), body)).otherwise(head).alias("context"))


def graph_context(names: DataFrame, name: str, nodes: DataFrame, edges: DataFrame,
                  spec: GraphSpec = HEALTHCARE, graph_available: bool = True) -> DataFrame:
    """names + resolved_id + context text (or the not-found / no-graph text)."""
    if not graph_available:
        return names.withColumn("resolved_id", F.lit(None).cast("string")).withColumn("context", F.lit(NO_GRAPH))
    r = resolve(names, name, nodes, spec)
    ctx = node_contexts(nodes, edges, spec).withColumnRenamed("id", "resolved_id")
    j = r.join(broadcast_if_bounded(ctx, NODE_BOUND), "resolved_id", "left")
    nf = F.concat(F.lit("Entity '"), F.col(name), F.lit("' not found in graph."))
    return j.select(*names.columns, "resolved_id",
                    F.when(F.col("resolved_id").isNull(), nf).otherwise(F.col("context")).alias("context"))


def sections(hits: DataFrame, q_key: str, docs: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """hits(q_key, rank, doc_id) → q_key, rank, doc_id, entity, text, section.
    ``contexts`` (entity_name, context) enriches a hit; None means plain retrieval."""
    d = docs.select(F.col("id").alias("doc_id"), "text", "entity_name")
    h = hits.join(d, "doc_id", "left").withColumn("entity", F.coalesce(F.col("entity_name"), F.lit(UNKNOWN_ENTITY)))
    if contexts is None:
        return h.select(q_key, "rank", "doc_id", "entity", "text", F.col("text").alias("section"))
    c = contexts.select(F.col("entity_name").alias("entity"), F.col("context").alias("_ctx"))
    h = h.join(c, "entity", "left")
    ctx = F.when(F.col("entity") == UNKNOWN_ENTITY, F.lit("")).otherwise(F.coalesce(F.col("_ctx"), F.lit("")))
    sec = F.concat(F.lit("["), F.col("entity"), F.lit("]\n"), F.coalesce(F.col("text"), F.lit("")),
                   F.when(ctx != "", F.concat(F.lit("\n\n"), ctx)).otherwise(F.lit("")))
    return h.select(q_key, "rank", "doc_id", "entity", "text", sec.alias("section"))


def join_sections(secs: DataFrame, q_key: str, out: str = "context") -> DataFrame:
    """q_key, context: sections in rank order joined by the divider (≤ k per group)."""
    xs = F.array_sort(F.collect_list(F.struct("rank", "section")))
    return secs.groupBy(q_key).agg(F.array_join(F.transform(xs, lambda x: x["section"]), SECTION_DIVIDER)
                                   .alias(out), F.count(F.lit(1)).alias("n_hits"))


def plain_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)
