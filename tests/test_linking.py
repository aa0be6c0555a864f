"""Entity linking and name resolution against brute force."""
import random
import re

import pytest
from pyspark.sql import functions as F

from entwine.operators import linking as L
from entwine.operators import requests as RQ
from entwine.operators import retrieve as RT
from entwine.spec import HEALTHCARE

TYPES = [a.node_type for a in HEALTHCARE.node_attrs]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("condition", "Diabetes"), ("condition", "Diabetes Type 2"), ("medication", "Insulin"), ("insurer", "Blue Cross"), ("insurer", "Cross Health Plan"),
            ("admission_type", "1-URGENT"), ("blood_type", "Brand#13"), ("test_result", "A"), ("odd", "A"), ("condition", "Ärzte é"), ("odd", "--")]
    return spark.createDataFrame([(f"{t}:{x}", x, t) for t, x in rows], "id string, label string, node_type string").checkpoint()


def words(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower())]


def test_whole_texts_are_linked(spark, nodes):
    texts = {1: "x " * 40 + "his diabetes, type-2, was found", 2: "Blue Cross Health Plan and blue cross", 3: "brand 13; 1 urgent INSULIN", 4: None, 5: "",
             6: "nothing here", 7: "a ÄRZTE É a"}
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    got = sorted((r.k, r.start, r.words, r.label) for r in L.mentions(df, ["k"], "text", nodes).collect())
    assert got == [(1, 41, 3, "Diabetes Type 2"), (2, 0, 2, "Blue Cross"), (2, 5, 2, "Blue Cross"), (3, 0, 2, "Brand#13"), (3, 2, 2, "1-URGENT"),
                   (3, 4, 1, "Insulin"), (7, 0, 1, "A"), (7, 1, 2, "Ärzte é"), (7, 3, 1, "A")]
    assert {r.id for r in L.mentions(df.where("k = 7"), ["k"], "text", nodes).collect()} == {"test_result:A", "condition:Ärzte é"}


def test_mentions_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = "abcde"
    labels = sorted({" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(25)})
    nodes = spark.createDataFrame([(f"condition:{x}", x, "condition") for x in labels], "id string, label string, node_type string")
    texts = [(i, " ".join(rng.choices(vocabulary + "xyz", k=rng.randint(0, 60)))) for i in range(60)]
    want = []
    for i, text in texts:
        w, at = words(text), 0
        while at < len(w):
            n = max((n for n in range(1, 5) if at + n <= len(w) and " ".join(w[at:at + n]) in labels), default=0)
            if n:
                want.append((i, at, n, " ".join(w[at:at + n])))
            at += n or 1
    got = L.mentions(spark.createDataFrame(texts, "k long, text string"), ["k"], "text", nodes)
    assert sorted((r.k, r.start, r.words, r.label) for r in got.collect()) == sorted(want) and len(want) > 500


def test_a_long_repetitive_text(spark, nodes):
    df = spark.createDataFrame([(1, "a " * 20_000 + "diabetes")], "k long, text string")
    got = L.mentions(df, ["k"], "text", nodes).groupBy("label").agg(F.count("*").alias("n"), F.max("start").alias("last")).collect()
    assert {(r.label, r.n, r["last"]) for r in got} == {("A", 20_000, 19_999), ("Diabetes", 1, 20_000)}


def brute_resolve(name, rows):
    rank = {t: i for i, t in enumerate(TYPES)}
    order = sorted(rows, key=lambda r: (rank.get(r[2], len(rank)), r[1], r[0]))
    if not name:
        return None
    return next((r[0] for r in order if r[1] == name), next((r[0] for r in order if name.lower() in r[1].lower()), None))


def test_resolve_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"n{i}", "".join(rng.choices("abAB é", k=rng.randint(0, 9))), rng.choice([*TYPES, "odd"])) for i in range(150)]
    names = ["".join(rng.choices("abABé q", k=rng.randint(0, 6))) for _ in range(300)] + [rows[5][1], None, "", "a", "é"]
    nodes = spark.createDataFrame(rows, "id string, label string, node_type string")
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(0, names[0])], "k long, name string")
    got = sorted(((r.k, r.resolved_id) for r in L.resolve(df, "name", nodes).collect()), key=str)
    assert got == sorted([(i, brute_resolve(n, rows)) for i, n in enumerate(names)] + [(0, brute_resolve(names[0], rows))], key=str)
    assert sum(x[1] is not None for x in got) > 50


def test_no_join_without_a_key(spark, nodes):
    df = spark.createDataFrame([(1, "diab")], "k long, name string")
    for frame in (L.resolve(df, "name", nodes), L.mentions(df, ["k"], "name", nodes), RT.graph_context(df, "name", nodes, spark.createDataFrame(
            [("condition:Diabetes", "medication:Insulin", "TREATED_WITH", 3)], "src string, dst string, relationship string, weight long"))):
        plan = frame._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_requests_name_every_entity(spark, nodes):
    conv = spark.createDataFrame([
        (1, 0, "user", "q?"), (1, 1, "assistant", "first word, then insulin for diabetes and insulin"), (1, 2, "assistant", "Nobody known"), (1, 3, "tool", "x"),
        (1, 1, "assistant", "diabetes again"), (1, 1, "assistant", "diabetes again"), (2, 0, "assistant", None), (None, None, "assistant", "Insulin"), (3, 0, None, "x")],
        "conv_id long, turn long, role string, text string")
    got = sorted(((r.question_id, r.pos, r.call, r.fn, r.entity_name) for r in RQ.parse_requests(RQ.tool_requests(conv, nodes)).collect()), key=str)
    c = RQ.CONTEXT_TOOL
    assert got == sorted([(1, 0, 0, RQ.SEARCH_TOOL, None), (1, 1, 0, c, "Insulin"), (1, 1, 1, c, "Diabetes"), (1, 2, 0, c, "Nobody"), (1, 3, 0, "summarize_tool", None),
                          (1, 1, 0, c, "Diabetes"), (1, 1, 0, c, "Diabetes"), (2, 0, 0, c, None), (None, None, 0, c, "Insulin"), (3, 0, 0, None, None)], key=str)


def test_answers_come_in_batches(spark):
    def model():
        return lambda questions, contexts: [None if c is None else f"{q} <- {c}" for q, c in zip(questions, contexts)]

    df = spark.createDataFrame([(1, "q1", "c1"), (2, "q2", None)], "k long, question string, context string")
    assert {r.k: r.answer for r in RQ.answer_with(df, "question", "context", model).collect()} == {1: "q1 <- c1", 2: None}
