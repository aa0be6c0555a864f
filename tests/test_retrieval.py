"""Resolution, context text, exact top-k against brute force, requests."""
import math

from pyspark.sql import functions as F

from entwine.operators import nearest as N
from entwine.operators import requests as RQ
from entwine.operators import retrieve as RT
from entwine.operators import vectors as V
from entwine.spec import HEALTHCARE


def _graph(spark):
    nodes = spark.createDataFrame(
        [("condition:Diabetes", "Diabetes", "condition"), ("medication:Insulin", "Insulin", "medication"),
         ("insurer:Aetna", "Aetna", "insurer")], "id string, label string, node_type string")
    edges = spark.createDataFrame(
        [("condition:Diabetes", "medication:Insulin", "TREATED_WITH", 1200),
         ("condition:Diabetes", "insurer:Aetna", "COVERED_BY", 7)],
        "src string, dst string, relationship string, weight long")
    return nodes, edges


def test_resolve_exact_substring_missing_empty(spark):
    nodes, _ = _graph(spark)
    names = spark.createDataFrame([("Diabetes",), ("dia",), ("zzz",), ("",)], "name string")
    got = {r.name: r.resolved_label for r in RT.resolve(names, "name", nodes, HEALTHCARE).collect()}
    assert got == {"Diabetes": "Diabetes", "dia": "Diabetes", "zzz": None, "": None}


def test_context_text(spark):
    nodes, edges = _graph(spark)
    names = spark.createDataFrame([("Diabetes",), ("zzz",)], "name string")
    got = {r.name: r.context for r in RT.graph_context(names, "name", nodes, edges, HEALTHCARE).collect()}
    assert got["Diabetes"] == ("Graph neighbours of 'Diabetes':\n  TREATED_WITH: Insulin (1,200 patients)\n"
                               "  COVERED_BY: Aetna (7 patients)")
    assert got["zzz"] == "Entity 'zzz' not found in graph."


def _brute(qs, ds, k):
    import hashlib
    import unicodedata

    def words(t):  # runs of letters, marks and digits
        return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in t.lower()).split()

    def vec(t):
        v = [0] * V.DIM
        for tok in words(t):
            v[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % V.DIM] += 1
        return v
    out = {}
    for qid, qt in qs:
        q = vec(qt)
        qq = sum(x * x for x in q)
        scored = []
        for did, dt in ds:
            d = vec(dt)
            dd = sum(x * x for x in d)
            dot = sum(a * b for a, b in zip(q, d))
            dist = 0.0 if qq == 0 and dd == 0 else 1.0 if qq == 0 or dd == 0 else 2.0 - 2.0 * dot / math.sqrt(qq * dd)
            scored.append((dist, did))
        out[qid] = [did for _, did in sorted(scored)[:k]]
    return out


def test_exact_topk_matches_brute_force_with_ties(spark):
    docs = [("d1", "alpha beta"), ("d0", "alpha beta"), ("d2", "gamma"), ("d3", ""), ("d4", "delta epsilon zeta"),
            ("d5", "beta beta beta")]
    qs = [(1, "alpha"), (2, "omega"), (3, ""), (4, "beta gamma")]
    dq = spark.createDataFrame(qs, "qid long, q string")
    dd = spark.createDataFrame(docs, "id string, text string")
    qv, dv = V.count_vectors(dq, ["qid"], "q"), V.count_vectors(dd, ["id"], "text")
    hits = N.topk(qv, "qid", dv, "id", 3, metric=N.normalised_l2).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append(r.id)
    assert got == _brute(qs, docs, 3)
    assert got[1][:2] == ["d0", "d1"]           # equal distance → lower id first
    # a corpus above the bound, which is read where it lies, gives the same result
    read = N.topk(qv, "qid", dv, "id", 3, metric=N.normalised_l2, sent_bytes=1000).collect()
    assert sorted((r.qid, r.rank, r.id) for r in read) == sorted((r.qid, r.rank, r.id) for r in hits)


def test_requests_parse_defaults_and_unknown_tool(spark):
    req = spark.createDataFrame([(1, 0, "search_knowledge_base", '{"query": "q"}'),
                                 (1, 1, "search_knowledge_base", '{"query": "q", "n_results": 2}'),
                                 (1, 2, "zz", "{}")], "question_id long, pos long, fn string, args string")
    p = {r.pos: r for r in RQ.parse_requests(req).collect()}
    assert p[0].n_results == 4 and p[1].n_results == 2
    txt = RQ.parse_requests(req).where(F.col("fn") == "zz").select(RQ.unknown_tool()).first()[0]
    assert txt == "Unknown tool: zz"


def test_prompt_template_roles(spark):
    qs = spark.createDataFrame([(1, 1, 0, "Why?")], "qid long, conv_id long, turn long, question string")
    msgs = RQ.prompt_messages(qs, RQ.load_template()).orderBy("pos").collect()
    assert [m.role for m in msgs] == ["system", "user"] and msgs[1].content == "Why?"
    t = RQ.read_template(spark).collect()
    assert [r.role for r in t] == ["system", "human"]


def test_pluggable_embedder_runs_batched(spark):
    def length_model():          # defined here so workers receive it by value
        def embed(texts):
            return [[float(len(t)), 1.0] for t in texts]
        return embed

    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, None)], "id long, text string")
    got = {r.id: list(r.embedding) for r in V.embed_with(df, "text", length_model, 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0]}


def test_question_turns(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "tool"), (1, 4, "user"), (1, 5, "assistant"),
            (2, 0, "assistant"), (3, 0, "user"), (3, 1, "user")]
    conv = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string")
    got = {(r.question_id, r.pos): r.turn for r in RQ.question_turns(conv).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (1, 5): 4, (2, 0): None, (3, 0): 0, (3, 1): 1}


def test_report_counts_every_call_of_a_question(spark):
    import __spark_entry__ as E
    q, sf = E.queries(), "/root/testdata/sf0.001"
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    asked = conv.where("role = 'user'").select("conv_id").distinct()
    calls = q["tool_call_route"](spark, sf).join(asked, F.col("question_id") == F.col("conv_id"))
    want = calls.agg(F.count("*").alias("n"), F.sum(F.length("result")).alias("c")).first()
    got = q["retrieval_report"](spark, sf).agg(F.sum("n_tool_calls").alias("n"), F.sum("context_chars").alias("c")).first()
    assert (got.n, got.c) == (want.n, want.c) and want.n > conv.where("role = 'user'").count()
