"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key of the
operator inventory. Each reads the given tables (or frames Spark derives from them)
in full; outputs are flat scalar columns so that results compare across engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.numeric import exact_column, rounded_ratio, rounded_units, whole_units
from ..operators import clean as C
from ..operators import profile as P
from ..operators.ranking import row_numbers
from ..session import cut_lineage, scratch_path
from ..sources.facts import read_facts
from .context import Ctx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reg(key: str):
    def deco(fn: Callable[[Ctx], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir, _fn=fn: _fn(Ctx(spark, sf_dir))
        return fn
    return deco


DISPLAY_COLUMNS = ("name", "age", "medical_condition", "medication", "insurance_provider",
                   "admission_type", "test_results", "blood_type")
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


# ---------------------------------------------------------------- 2.1 sources
@reg("scan_visits")
def scan_visits(c: Ctx) -> DataFrame:
    return c.raw


@reg("scan_sample")
def scan_sample(c: Ctx) -> DataFrame:
    cols = [x for x in DISPLAY_COLUMNS if x in c.raw.columns]
    return c.raw.orderBy(*LINE_KEY).select(*cols).limit(6)


#: Headers of a table that is not ours, as a user's file may have them.
FOREIGN = {"name": "Name", "age": "Age", "gender": "Sex", "blood_type": "Blood Type", "medical_condition": "Medical Condition",
           "medication": "Medication", "insurance_provider": "Insurance Provider", "admission_type": "Admission Type",
           "test_results": "Test Results", "date_of_admission": "Date of Admission", "discharge_date": "Discharge Date",
           "billing_amount": "Billing Amount"}


def _foreign(c: Ctx) -> tuple[DataFrame, DataFrame]:
    """The fact table written as CSV under other headers, dates of 1995 admissions as text that is no
    date and a column besides that has the name of a derived one, then read by the mapping."""
    bad = F.year("date_of_admission") == 1995
    columns = [F.when(bad, F.lit("in 1995")).otherwise(F.col(k).cast("string")).alias(v) if k == "date_of_admission"
               else F.col(k).alias(v) for k, v in FOREIGN.items()]
    path = scratch_path(c.spark, "foreign")
    c.raw.select(F.col("l_orderkey").alias("length_of_stay"), *columns).write.options(**IO.CSV_OUT).csv(path)
    return read_facts(c.spark, path, FOREIGN)


@reg("scan_mapped")
def scan_mapped(c: Ctx) -> DataFrame:
    """Rows of a table with other headers, typed."""
    return _foreign(c)[0]


@reg("scan_mapped_rejects")
def scan_mapped_rejects(c: Ctx) -> DataFrame:
    """Its rejected rows, as they came."""
    return _foreign(c)[1].select("length_of_stay", "Name", F.col("Billing Amount").cast("double").alias("Billing Amount"), "Date of Admission", F.array_join("reasons", ",").alias("reasons"))


@reg("update_mapped")
def update_mapped(c: Ctx) -> DataFrame:
    """Edges of the graph of a table with other headers, updated with its most recent records."""
    facts = cut_lineage(_foreign(c)[0])
    return _updated(Ctx(c.spark, facts=facts, spec=c.spec))[1]


# ---------------------------------------------------------------- 2.2 cleaning
@reg("clean_title_case")
def clean_title_case(c: Ctx) -> DataFrame:
    return c.raw.select(*LINE_KEY[:4], "name", TX.title_case("name").alias("name_title"),
                        TX.title_case("doctor").alias("doctor_title"))


@reg("clean_dates")
def clean_dates(c: Ctx) -> DataFrame:
    d = C.clean_dates(c.raw)
    return d.select(*LINE_KEY, "date_of_admission", "discharge_date")


@reg("clean_dates_audit")
def clean_dates_audit(c: Ctx) -> DataFrame:
    """Dates as text, as a CSV file has them: how many parse, are null or are rejected."""
    return C.date_audit(c.raw.select(*[F.col(x).cast("string").alias(x) for x in C.DATE_COLUMNS]))


@reg("clean_length_of_stay")
def clean_length_of_stay(c: Ctx) -> DataFrame:
    return c.clean.select(*LINE_KEY, "length_of_stay")


@reg("clean_strip")
def clean_strip(c: Ctx) -> DataFrame:
    cats = [a.column for a in c.spec.attributes]
    return c.raw.select(*LINE_KEY, *[TX.strip_ws(x).alias(x) for x in cats])


@reg("clean_visits")
def clean_visits(c: Ctx) -> DataFrame:
    return c.clean


@reg("clean_quality_log")
def clean_quality_log(c: Ctx) -> DataFrame:
    q = C.clean_quality_log(c.clean)
    return q.select("n_records", rounded_ratio(F.col("total_stay_days"), F.col("n_records"), 1)
                    .alias("avg_stay"))


@reg("slug_id")
def slug_id(c: Ctx) -> DataFrame:
    return c.profile.select("entity_type", "entity", TX.slug_id("entity_type", "entity").alias("id"))


@reg("pct_of_total")
def pct_of_total(c: Ctx) -> DataFrame:
    total = c.total.scalar()
    return c.profile.select("entity_type", "entity", "patient_count",
                            rounded_ratio(F.col("patient_count") * 100, total, 1).alias("pct"))


@reg("number_format")
def number_format(c: Ctx) -> DataFrame:
    total = c.total.scalar()
    pct = rounded_ratio(F.col("patient_count") * 100, total, 1)
    return c.profile.select(
        "entity_type", "entity",
        TX.fmt_int("patient_count").alias("count_text"),
        F.coalesce(TX.fmt_money("avg_billing"), F.lit("")).alias("billing_text"),
        F.concat(TX.fmt_fixed(pct, 1, commas=False), F.lit("%")).alias("pct_text"),
        F.coalesce(TX.fmt_money(whole_units("avg_billing", 2), 0), F.lit("")).alias("billing_whole_text"))


@reg("stats_display")
def stats_display(c: Ctx) -> DataFrame:
    s = P.entity_stats(c.profile, c.spec)
    dash = F.lit("—")
    return s.select("entity_name", "entity_type",
                    TX.fmt_int("patient_count").alias("patient_count"),
                    F.coalesce(TX.fmt_money("avg_billing"), dash).alias("avg_billing"),
                    F.coalesce(TX.fmt_fixed("avg_age", 1, commas=False), dash).alias("avg_age"),
                    F.coalesce(TX.fmt_fixed("avg_stay", 1, commas=False), dash).alias("avg_stay"))


# ---------------------------------------------------------------- 2.3 filters
@reg("filter_entity_equality")
def filter_entity_equality(c: Ctx) -> DataFrame:
    """Rows of the fact table for each hub entity: the reference's per-entity mask
    loop as one grouped pass (row count and billing in cents per entity)."""
    hub = c.spec.attr(c.spec.hub).column
    return (c.clean.where(F.col(hub).isNotNull())
             .groupBy(F.col(hub).alias("entity"))
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  rounded_units(F.sum(exact_column(c.clean, "billing_amount")), 2).alias("billing_cents")))


@reg("filter_stats_by_type")
def filter_stats_by_type(c: Ctx) -> DataFrame:
    """The stats table under every selector value: "All" keeps all rows, a type
    keeps its own rows. The selector set is the distinct types plus "All"."""
    s = P.entity_stats(c.profile, c.spec)
    cols = ("entity_name", "entity_type", "patient_count")
    own = s.where(F.col("entity_type").isNotNull()).select(F.col("entity_type").alias("selected"), *cols)
    return own.unionByName(s.select(F.lit("All").alias("selected"), *cols))


# ---------------------------------------------------------------- 2.4 aggregations
@reg("total_records")
def total_records(c: Ctx) -> DataFrame:
    return c.clean.agg(F.count(F.lit(1)).alias("total_records"))


@reg("distinct_entities")
def distinct_entities(c: Ctx) -> DataFrame:
    entries = [F.struct(F.lit(a.node_type).alias("entity_type"), F.col(a.column).alias("entity"))
               for a in c.spec.node_attrs]
    return (c.clean.select(F.inline(F.array(*entries)))
             .where(F.col("entity").isNotNull()).distinct())


@reg("distinct_types_sorted")
def distinct_types_sorted(c: Ctx) -> DataFrame:
    s = P.entity_stats(c.profile, c.spec).where(F.col("entity_type").isNotNull())
    types = s.select("entity_type").distinct()
    ranked = row_numbers(types, ["entity_type"])
    return c.spark.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit("All").alias("entity_type")) \
        .unionByName(ranked)


def _summary(node_type: str):
    def fn(c: Ctx) -> DataFrame:
        return P.summary_for(c.profile, c.texts, node_type, c.spec)
    return fn


for _k, _t in [("summary_conditions", "condition"), ("summary_medications", "medication"),
               ("summary_insurers", "insurer"), ("summary_blood_types", "blood_type"),
               ("summary_admission_types", "admission_type"), ("summary_test_results", "test_result")]:
    reg(_k)(_summary(_t))


@reg("entity_profile")
def entity_profile(c: Ctx) -> DataFrame:
    return c.profile


@reg("value_distribution")
def value_distribution(c: Ctx) -> DataFrame:
    return c.dist


@reg("distribution_map")
def distribution_map(c: Ctx) -> DataFrame:
    return c.texts.select("entity_type", "entity", "dist_column", "dist")


@reg("summary_counts")
def summary_counts(c: Ctx) -> DataFrame:
    return c.profile.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_entities"))


@reg("emergency_rate")
def emergency_rate(c: Ctx) -> DataFrame:
    return P.emergency_rate(c.clean, c.spec)


# ---------------------------------------------------------------- 2.5 sort / top-k
@reg("stats_sorted")
def stats_sorted(c: Ctx) -> DataFrame:
    return row_numbers(P.entity_stats(c.profile, c.spec), [F.desc("patient_count"), F.asc("entity_type"), F.asc("entity_name")])


@reg("recent_batch")
def recent_batch(c: Ctx) -> DataFrame:
    from ..operators.update import recent_batch as rb
    return rb(c.clean, c.spec.update_batch_size).select(*LINE_KEY, "date_of_admission")


@reg("topk_blood_types")
def topk_blood_types(c: Ctx) -> DataFrame:
    d = c.dist.where((F.col("entity_type") == "condition") & (F.col("dist_column") == "blood_type")
                     & (F.col("rank") <= 4))
    return d.select(F.col("entity").alias("condition"), F.col("value").alias("blood_type"), "n", "rank")


@reg("topk_distribution")
def topk_distribution(c: Ctx) -> DataFrame:
    return c.dist.where(F.col("rank") <= 3)


def _cond_profile(c: Ctx) -> DataFrame:
    return c.profile.where(F.col("entity_type") == c.spec.attr(c.spec.hub).node_type)


@reg("rank_cost")
def rank_cost(c: Ctx) -> DataFrame:
    return P.rank_both_ways(_cond_profile(c).select("entity", "avg_billing"), "avg_billing")


@reg("rank_stay")
def rank_stay(c: Ctx) -> DataFrame:
    return P.rank_both_ways(_cond_profile(c).select("entity", "avg_stay"), "avg_stay")


@reg("rank_emergency")
def rank_emergency(c: Ctx) -> DataFrame:
    e = P.emergency_from_dist(c.profile, c.dist, c.spec)
    e = e.withColumn("exact_rate", F.col("emergency_count") / F.col("patient_count"))
    return P.rank_both_ways(e.select("entity", "emergency_rate", "exact_rate"), "exact_rate") \
        .drop("exact_rate")


# ---------------------------------------------------------------- 2.6 flatten
@reg("entity_stats")
def entity_stats(c: Ctx) -> DataFrame:
    return P.entity_stats(c.profile, c.spec)


# ---------------------------------------------------------------- 2.2 graph text / lookups
from ..operators import graph as G  # noqa: E402


@reg("node_tooltip")
def node_tooltip(c: Ctx) -> DataFrame:
    return c.nodes.select("id", "title")


@reg("edge_tooltip")
def edge_tooltip(c: Ctx) -> DataFrame:
    return c.edges.select("src", "dst", "title")


@reg("tooltip_plain")
def tooltip_plain(c: Ctx) -> DataFrame:
    n = c.nodes.select("id", TX.tooltip_plain("title").alias("tooltip"))
    e = c.edges.select(F.concat("src", F.lit("->"), "dst").alias("id"), TX.tooltip_plain("title").alias("tooltip"))
    return n.unionByName(e)


@reg("attr_defaults")
def attr_defaults(c: Ctx) -> DataFrame:
    """Every node id the graph mentions (nodes and edge endpoints, the event types that no
    node table holds among them) with its display attributes, falling back to the defaults where a node carries none."""
    ends = c.edges.select(F.col("src").alias("id")).unionByName(c.edges.select(F.col("dst").alias("id")))
    events = c.table("events").where("event_type is not null").select(F.concat(F.lit("event_type:"), "event_type").alias("id")).distinct()
    ids = c.nodes.select("id").unionByName(ends).unionByName(events).distinct()
    j = ids.join(c.nodes, "id", "left")
    return j.select("id",
                    F.coalesce("color", F.lit(c.spec.default_color)).alias("color"),
                    F.coalesce("node_type", F.lit(c.spec.default_node_type)).alias("node_type"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"))


@reg("color_lookup")
def color_lookup(c: Ctx) -> DataFrame:
    return c.nodes.select("id", "node_type", G.color_of(F.col("node_type"), c.spec).alias("color"))


@reg("graph_size")
def graph_size(c: Ctx) -> DataFrame:
    n = c.nodes.agg(F.count(F.lit(1))).scalar()
    m = c.edges.agg(F.count(F.lit(1))).scalar()
    return c.spark.range(1).select(n.alias("n_nodes"), m.alias("n_edges"))


@reg("max_edge_weight")
def max_edge_weight(c: Ctx) -> DataFrame:
    return G.max_edge_weight(c.edges)


# ---------------------------------------------------------------- 2.7 graph construction
@reg("graph_nodes")
def graph_nodes(c: Ctx) -> DataFrame:
    return c.nodes


def _rel(name: str):
    def fn(c: Ctx) -> DataFrame:
        return G.relation_edges(c.pairs, c.spec, only=name)
    return fn


for _k, _r in [("edges_treated_with", "TREATED_WITH"), ("edges_covered_by", "COVERED_BY"),
               ("edges_admitted_as", "ADMITTED_AS"), ("edges_shows_result", "SHOWS_RESULT"),
               ("edges_associated_with", "ASSOCIATED_WITH")]:
    reg(_k)(_rel(_r))


@reg("graph_edges")
def graph_edges(c: Ctx) -> DataFrame:
    return c.edges


# ---------------------------------------------------------------- 2.9 analytics / export
@reg("node_degree")
def node_degree(c: Ctx) -> DataFrame:
    return G.node_degree(c.nodes, c.edges).select("id", "degree")


@reg("degree_centrality")
def degree_centrality(c: Ctx) -> DataFrame:
    return G.with_centrality(c.nodes, c.edges).select("id", "degree", "centrality")


@reg("node_radius")
def node_radius(c: Ctx) -> DataFrame:
    return G.with_centrality(c.nodes, c.edges).select("id", "radius")


@reg("edge_width")
def edge_width(c: Ctx) -> DataFrame:
    return G.with_width(c.edges).select(F.col("src").alias("source"), F.col("dst").alias("target"), "width")


@reg("graph_metadata")
def graph_metadata(c: Ctx) -> DataFrame:
    return G.graph_metadata(c.nodes, c.edges)


@reg("graph_payload")
def graph_payload(c: Ctx) -> DataFrame:
    return G.payload_nodes(c.nodes, c.edges, c.spec)


@reg("graph_payload_links")
def graph_payload_links(c: Ctx) -> DataFrame:
    return G.payload_links(c.edges)


@reg("ego_network")
def ego_network(c: Ctx) -> DataFrame:
    return G.ego_network(c.nodes, c.edges)


# ---------------------------------------------------------------- 2.8 incremental update
from ..operators import update as U  # noqa: E402


def _batch(c: Ctx) -> DataFrame:
    return c.batch


def _batch_nodes(c: Ctx) -> DataFrame:
    b = P.profile_from_facts(c.batch_facts, c.spec)
    return b.select(G.node_id("entity_type", "entity").alias("id"), F.col("entity").alias("label"),
                    F.col("entity_type").alias("node_type"), F.col("patient_count").alias("n"))


def _batch_edges(c: Ctx, topk: bool | None) -> DataFrame:
    pairs = c.batch_facts.where(~F.col("pair").isin(P.NODE, P.ALL)).select("pair", "a", "b", "n")
    e = G.relation_edges(pairs, c.spec)
    tk = [r.name for r in c.spec.relations if r.top_k]
    if topk is True:
        e = e.where(F.col("relationship").isin(tk))
    elif topk is False:
        e = e.where(~F.col("relationship").isin(tk))
    return e.select("src", "dst", "relationship", F.col("weight").alias("n"))


@reg("update_batch_nodes")
def update_batch_nodes(c: Ctx) -> DataFrame:
    return P.profile_from_facts(c.batch_facts, c.spec).select("entity_type", "entity", "patient_count")


@reg("update_upsert_nodes")
def update_upsert_nodes(c: Ctx) -> DataFrame:
    return U.upsert_nodes(c.nodes, _batch_nodes(c), c.spec)


@reg("update_upsert_edges")
def update_upsert_edges(c: Ctx) -> DataFrame:
    return U.upsert_edges(c.edges, _batch_edges(c, topk=False), c.spec)


@reg("update_upsert_topk")
def update_upsert_topk(c: Ctx) -> DataFrame:
    tk = [r.name for r in c.spec.relations if r.top_k]
    base = c.edges.where(F.col("relationship").isin(tk))
    return U.upsert_edges(base, _batch_edges(c, topk=True), c.spec)


def _updated(c: Ctx) -> tuple[DataFrame, DataFrame]:
    nodes = U.upsert_nodes(c.nodes, _batch_nodes(c), c.spec)
    edges = U.upsert_edges(c.edges, _batch_edges(c, topk=None), c.spec)
    return nodes, edges


@reg("update_report")
def update_report(c: Ctx) -> DataFrame:
    return U.update_report(*_updated(c))


@reg("graph_update")
def graph_update(c: Ctx) -> DataFrame:
    nodes, edges = _updated(c)
    return G.graph_metadata(nodes.drop("status"), edges.drop("status"))


@reg("stream_graph_update")
def stream_graph_update(c: Ctx) -> DataFrame:
    from ..streaming.graph_stream import current_graph, run_event_stream
    return current_graph(c.spark, run_event_stream(c.spark, c.sf_dir))


@reg("stream_graph_nodes")
def stream_graph_nodes(c: Ctx) -> DataFrame:
    from ..streaming.graph_stream import current_nodes, run_event_stream
    return current_nodes(c.spark, run_event_stream(c.spark, c.sf_dir))


# ---------------------------------------------------------------- 2.10 documents
from ..operators import documents as D  # noqa: E402


def _doc(node_type: str):
    def fn(c: Ctx) -> DataFrame:
        return D.entity_documents(c.profile, c.texts, c.total.scalar(), node_type, c.spec)
    return fn


for _k, _t in [("doc_conditions", "condition"), ("doc_medications", "medication"), ("doc_insurers", "insurer")]:
    reg(_k)(_doc(_t))


@reg("doc_insight_cost")
def doc_insight_cost(c: Ctx) -> DataFrame:
    return D.cost_insight(c.profile, c.spec)


@reg("doc_insight_emergency")
def doc_insight_emergency(c: Ctx) -> DataFrame:
    return D.emergency_insight(c.profile, c.dist, c.spec)


@reg("rag_documents")
def rag_documents(c: Ctx) -> DataFrame:
    return c.documents


@reg("documents_union")
def documents_union(c: Ctx) -> DataFrame:
    return c.documents.select("id", "entity_type", "entity_name",
                              F.length("text").cast("long").alias("n_chars"))


# ---------------------------------------------------------------- 2.11 embedding and vector search
from ..operators import approximate as AP  # noqa: E402
from ..operators import nearest as N  # noqa: E402
from ..operators import requests as RQ  # noqa: E402
from ..operators import retrieve as RT  # noqa: E402
from ..operators import vectors as V  # noqa: E402


@reg("embed_documents")
def embed_documents(c: Ctx) -> DataFrame:
    """The vector of every text of the ``documents`` table (whole texts), as text: components in
    units of 2**-20."""
    d = V.unit_vectors(c.table("documents").where("doc_id is not null"), ["doc_id"], "text")
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * (1 << 20)).cast("long").cast("string"))
    return d.select("doc_id", F.array_join(whole, ",").alias("embedding"))


@reg("embed_postings")
def embed_postings(c: Ctx) -> DataFrame:
    """Hashed term counts of the same texts, a row for each bucket that a text uses."""
    return V.postings(c.table("documents"), ["doc_id"], "text")


@reg("embed_collection")
def embed_collection(c: Ctx) -> DataFrame:
    d = V.dense(c.documents, ["id"], c.d_post)
    return c.documents.join(d, "id").select(
        "id", "entity_type", "entity_name", F.size("embedding").cast("long").alias("dim"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"))


@reg("embed_dimension_check")
def embed_dimension_check(c: Ctx) -> DataFrame:
    docs = c.table("documents")
    d = V.dense(docs, ["doc_id"], V.postings(docs, ["doc_id"], "text"))
    return d.agg(F.count(F.lit(1)).alias("n_vectors"),
                 F.min(F.size("embedding")).cast("long").alias("min_dim"),
                 F.max(F.size("embedding")).cast("long").alias("max_dim"))


@reg("embed_query")
def embed_query(c: Ctx) -> DataFrame:
    return c.q_post


@reg("vector_topk")
def vector_topk(c: Ctx) -> DataFrame:
    return c.hits


#: Components of stored vectors are searched in units of 1 / UNIT, so that distances are exact.
UNIT = 1 << 20


def _stored(c: Ctx) -> DataFrame:
    return c.table("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * UNIT).cast("long")).alias("vec"))


def _search_stored(c: Ctx, topk: Callable) -> DataFrame:
    """Every row whose id 50 divides against all rows: its ten nearest."""
    e = _stored(c)
    hits = topk(e.where(F.col("vec_id") % 50 == 0), "vec_id", e.withColumnRenamed("vec_id", "neighbour_id"), "neighbour_id", 10)
    return hits.withColumn("distance", F.col("distance") / F.lit(float(UNIT) ** 2))


@reg("vector_topk_embeddings")
def vector_topk_embeddings(c: Ctx) -> DataFrame:
    """The stored vectors searched exactly, by squared distance of components rounded to 2**-20."""
    return _search_stored(c, N.topk)


@reg("vector_topk_ann")
def vector_topk_ann(c: Ctx) -> DataFrame:
    """The same search by four-bit codes, exact distances of the candidates."""
    return _search_stored(c, AP.topk)


@reg("vector_ann_recall")
def vector_ann_recall(c: Ctx) -> DataFrame:
    """Recall of that search against the exact one, and whether it reaches 0.9."""
    r = AP.recall(_search_stored(c, AP.topk), _search_stored(c, N.topk), "vec_id", "neighbour_id")
    return r.select("n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


@reg("vector_lookup_metadata")
def vector_lookup_metadata(c: Ctx) -> DataFrame:
    d = c.documents.select(F.col("id").alias("doc_id"), "entity_name", "text")
    return (c.hits.join(d, "doc_id", "left")
                  .select("qid", "rank", "doc_id",
                          F.coalesce(F.col("entity_name"), F.lit(RT.UNKNOWN_ENTITY)).alias("entity"),
                          F.length("text").cast("long").alias("n_chars")))


# ---------------------------------------------------------------- 2.12 graph-enriched retrieval
@reg("neighbors_1hop")
def neighbors_1hop(c: Ctx) -> DataFrame:
    return RT.neighbors(c.nodes, c.edges, c.spec)


@reg("neighbors_by_relation")
def neighbors_by_relation(c: Ctx) -> DataFrame:
    return RT.by_relation(RT.neighbors(c.nodes, c.edges, c.spec), c.spec).drop("rel_order")


def _parsed(c: Ctx) -> DataFrame:
    return cut_lineage(RQ.parse_requests(RQ.tool_requests(c.table("conversations"), c.nodes, c.spec)))


@reg("entity_resolve")
def entity_resolve(c: Ctx) -> DataFrame:
    names = _parsed(c).where(F.col("fn") == RQ.CONTEXT_TOOL).select("question_id", "pos", "call", "entity_name")
    return RT.resolve(names, "entity_name", c.nodes, c.spec)


@reg("graph_context")
def graph_context(c: Ctx) -> DataFrame:
    return c.contexts


@reg("ops_join_summary_graph")
def ops_join_summary_graph(c: Ctx) -> DataFrame:
    """Document hit → node → incident edges: each document's entity joined to its
    node and the edges at that node."""
    d = c.documents.select(F.col("id").alias("doc_id"), "entity_name")
    r = RT.resolve(d, "entity_name", c.nodes, c.spec)
    nb = RT.neighbors(c.nodes, c.edges, c.spec).withColumnRenamed("id", "resolved_id")
    return r.join(nb, "resolved_id", "left").select("doc_id", "entity_name", "resolved_id", "neighbour_id",
                                                    "relationship", "weight")


def _sections(c: Ctx) -> DataFrame:
    return RT.sections(c.hits, "qid", c.documents, c.contexts.select("entity_name", "context"))


@reg("search_section")
def search_section(c: Ctx) -> DataFrame:
    return _sections(c).select("qid", "rank", "doc_id", "entity", "section")


@reg("graph_search")
def graph_search(c: Ctx) -> DataFrame:
    return RT.join_sections(_sections(c), "qid")


@reg("plain_search")
def plain_search(c: Ctx) -> DataFrame:
    p = RT.join_sections(RT.sections(c.hits, "qid", c.documents, None), "qid")
    return (p.join(c.questions.select("qid", "question"), "qid")
             .select("qid", "context", RT.plain_prompt(F.col("context"), F.col("question")).alias("prompt")))


@reg("search_compare")
def search_compare(c: Ctx) -> DataFrame:
    g = RT.join_sections(_sections(c), "qid", "graph_context")
    p = RT.join_sections(RT.sections(c.hits, "qid", c.documents, None), "qid", "plain_context").drop("n_hits")
    return (g.join(p, "qid")
             .select("qid", "n_hits", F.length("plain_context").cast("long").alias("plain_chars"),
                     F.length("graph_context").cast("long").alias("graph_chars"),
                     (F.length("graph_context") - F.length("plain_context")).cast("long").alias("added_chars")))


# ---------------------------------------------------------------- 2.13 prompts, tool requests, report
@reg("prompt_messages")
def prompt_messages(c: Ctx) -> DataFrame:
    return RQ.prompt_messages(c.questions, RQ.load_template())


@reg("tool_call_parse")
def tool_call_parse(c: Ctx) -> DataFrame:
    return _parsed(c).drop("args")


CALL = ("question_id", "pos", "call", "fn", "args")


def _routed(c: Ctx) -> DataFrame:
    req = _parsed(c)
    search = req.where(F.col("fn") == RQ.SEARCH_TOOL).withColumn("rid", RQ.question_key("question_id", "pos"))
    asked = V.count_vectors(search, ["rid", "n_results"], "query")
    h = N.topk(asked, "rid", c.d_vec, "id", "n_results", metric=N.normalised_l2).withColumnRenamed("id", "doc_id")
    res_search = RT.join_sections(RT.sections(h, "rid", c.documents, c.contexts.select("entity_name", "context")),
                                  "rid", "result")
    s = search.join(res_search, "rid", "left").select(*CALL, F.coalesce("result", F.lit("")).alias("result"))
    ctx_req = req.where(F.col("fn") == RQ.CONTEXT_TOOL).select(*CALL, "entity_name")
    g = RT.graph_context(ctx_req, "entity_name", c.nodes, c.edges, c.spec).select(*CALL, F.col("context").alias("result"))
    other = req.where(~F.col("fn").isin(RQ.SEARCH_TOOL, RQ.CONTEXT_TOOL)).select(*CALL, RQ.unknown_tool().alias("result"))
    return s.unionByName(g).unionByName(other)


@reg("tool_call_route")
def tool_call_route(c: Ctx) -> DataFrame:
    return _routed(c).drop("args")


@reg("tool_call_log")
def tool_call_log(c: Ctx) -> DataFrame:
    """Every call with its tool, arguments and result, numbered within its conversation."""
    return _log(c)


def _log(c: Ctx) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("question_id").orderBy("pos", "call", "result"))
    return _routed(c).select("question_id", seq.cast("long").alias("seq"), "pos", F.col("fn").alias("tool"), "args", "result")


@reg("retrieval_report")
def retrieval_report(c: Ctx) -> DataFrame:
    """Per question: the tool calls made for it (its own turn's and those of the turns up
    to the next question) and the retrieved context size; ``answer`` is left null (no
    model call in this library)."""
    calls = (_routed(c).join(RQ.question_turns(c.table("conversations")), ["question_id", "pos"])
             .groupBy("question_id", "turn")
             .agg(F.count(F.lit(1)).alias("n_tool_calls"), F.sum(F.length("result")).cast("long").alias("context_chars")))
    asked = c.questions.select(F.col("conv_id").alias("question_id"), "turn", "question")
    n_answered = asked.agg(F.count(F.lit(1))).scalar()
    return (asked.join(calls, ["question_id", "turn"], "left")
                   .select("question_id", "turn", "question",
                           F.coalesce("n_tool_calls", F.lit(0)).cast("long").alias("n_tool_calls"),
                           F.coalesce("context_chars", F.lit(0)).cast("long").alias("context_chars"),
                           F.lit(None).cast("string").alias("answer"),
                           F.lit(V.EMBEDDER_NAME).alias("embedding_model"),
                           n_answered.alias("questions_answered")))


# ---------------------------------------------------------------- 2.1 sinks and round trips
from ..sources import io as IO  # noqa: E402


@reg("csv_roundtrip_clean")
def csv_roundtrip_clean(c: Ctx) -> DataFrame:
    return IO.csv_roundtrip(c.clean)


@reg("summaries_roundtrip")
def summaries_roundtrip(c: Ctx) -> DataFrame:
    """Nested summaries (one map<string,bigint> per distribution) to Parquet and
    back, exploded to long form."""
    nested = (c.dist.groupBy("entity_type", "entity", "dist_column")
                    .agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("dist")))
    back = IO.parquet_roundtrip(nested)
    return back.select("entity_type", "entity", "dist_column", F.explode("dist").alias("value", "n"))


@reg("graph_json_export")
def graph_json_export(c: Ctx) -> DataFrame:
    """The graph as one node-link document, read again: its nodes."""
    path = IO.write_node_link(c.nodes, c.edges, scratch_path(c.spark, "node-link"))
    return IO.read_node_link(c.spark, path)[0]


@reg("graph_json_import")
def graph_json_import(c: Ctx) -> DataFrame:
    path = IO.write_node_link(c.nodes, c.edges, scratch_path(c.spark, "node-link"))
    return IO.read_node_link(c.spark, path)[1]


@reg("graph_json_lines")
def graph_json_lines(c: Ctx) -> DataFrame:
    """The same as JSON lines, written in parallel, for graphs of any size."""
    path = IO.export_graph_json(c.nodes, c.edges, scratch_path(c.spark, "graph-json"))
    return IO.import_graph_json(c.spark, path)[1]


@reg("graph_metadata_csv")
def graph_metadata_csv(c: Ctx) -> DataFrame:
    return IO.csv_roundtrip(G.graph_metadata(c.nodes, c.edges))


@reg("documents_store")
def documents_store(c: Ctx) -> DataFrame:
    docs = c.documents.select("id", "text", F.struct("entity_type", "entity_name").alias("metadata"))
    back = IO.parquet_roundtrip(docs)
    return back.select("id", "text", F.col("metadata.entity_type").alias("entity_type"),
                       F.col("metadata.entity_name").alias("entity_name"))


@reg("vector_store")
def vector_store(c: Ctx) -> DataFrame:
    """Vectors stored partitioned by entity type; one type is then re-embedded and
    rewritten alone (dynamic partition overwrite) and the store is reopened."""
    path = scratch_path(c.spark, "vectors")
    vec = c.documents.join(V.dense(c.documents, ["id"], c.d_post), "id")
    vec.write.mode("overwrite").partitionBy("entity_type").parquet(path)
    (vec.where(F.col("entity_type") == "insight").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("entity_type").parquet(path))
    back = c.spark.read.parquet(path)
    return back.select("id", "entity_type", "entity_name", F.size("embedding").cast("long").alias("dim"),
                       F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"))


@reg("stats_table_replace")
def stats_table_replace(c: Ctx) -> DataFrame:
    s = P.entity_stats(c.profile, c.spec)
    name = f"entity_statistics_{uuid.uuid4().hex}"  # a name of its own: no table of the caller's is replaced
    IO.replace_table(s, name)
    return IO.replace_table(s, name).orderBy(F.desc("patient_count"))


@reg("report_json")
def report_json(c: Ctx) -> DataFrame:
    """The report as nested JSON, a question a line with its calls (tool, arguments, result) in
    order, read back and given a row a call (one with a null call for a question without)."""
    turns = RQ.question_turns(c.table("conversations"))
    calls = (_log(c).join(turns, ["question_id", "pos"]).groupBy("question_id", "turn")
             .agg(F.array_sort(F.collect_list(F.struct("seq", "tool", "args", "result"))).alias("calls")))
    asked = c.questions.select(F.col("conv_id").alias("question_id"), "turn", "question")
    report = asked.join(calls, ["question_id", "turn"], "left").withColumns(
        {"answer": F.lit(None).cast("string"), "embedding_model": F.lit(V.EMBEDDER_NAME)})
    path = scratch_path(c.spark, "report")
    report.write.mode("overwrite").json(path)
    back = c.spark.read.schema(report.schema).json(path)
    return back.select("question_id", "turn", "question", "answer", "embedding_model", F.inline_outer("calls"))


@reg("graph_replace_in_place")
def graph_replace_in_place(c: Ctx) -> DataFrame:
    """Save the graph, read it back, upsert the recent batch, save the successor in a fresh folder and
    read that: its edges. A failed save leaves the old folder as it was."""
    saved = IO.export_graph_json(c.nodes, c.edges, scratch_path(c.spark, "graph-saved"))
    nodes0, edges0 = IO.import_graph_json(c.spark, saved)
    nodes = U.upsert_nodes(nodes0, _batch_nodes(c), c.spec).drop("status")
    edges = U.upsert_edges(edges0, _batch_edges(c, topk=None), c.spec).drop("status")
    return IO.import_graph_json(c.spark, IO.export_graph_json(nodes, edges, scratch_path(c.spark, "graph-saved")))[1]
