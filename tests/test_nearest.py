"""Exact dense search and row numbers against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from entwine.operators import nearest as N
from entwine.operators.profile import rank_both_ways
from entwine.operators.ranking import row_numbers

METRICS = {"l2": N.squared_l2, "normalised": N.normalised_l2}


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(2)
    d = [(f"d{i:03}", [int(x) for x in rng.integers(-2, 3, 6)]) for i in range(300)] + [("zero", [0] * 6), ("none", None), (None, [1] * 6)]
    q = [(i, [int(x) for x in rng.integers(-2, 3, 6)], int(rng.integers(0, 7))) for i in range(40)] + [(90, [0] * 6, 4), (91, [0] * 6, 400), (92, None, 3), (93, [1] * 6, None)]
    return (spark.createDataFrame(q, "q long, vec array<int>, k int").repartition(3).checkpoint(),
            spark.createDataFrame(d, "id string, vec array<int>").repartition(5).checkpoint(), q, [x for x in d if x[0] and x[1]])


def brute(q, d, metric, k=None):
    out = {}
    for i, v, own in q:
        n = own if k is None else k
        if v is None or not n:
            continue
        a = np.array(v, float)
        far = sorted((float(metric(np.array([[a @ np.array(x, float)]]), np.array([[a @ a]]), np.array([np.array(x, float) @ np.array(x, float)]))[0, 0]), j) for j, x in d)
        out.update({(i, r + 1): (j, f) for r, (f, j) in enumerate(far[:n])})
    return out


@pytest.mark.parametrize("sent", [1 << 25, 4000, 500], ids=["corpus sent", "queries sent", "queries in blocks"])
@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("k", [3, "k"])
def test_topk(sides, sent, metric, k):
    qs, ds, q, d = sides
    got = {(r.q, r["rank"]): (r.id, r.distance) for r in N.topk(qs, "q", ds, "id", k, metric=METRICS[metric], sent_bytes=sent).collect()}
    assert got == brute(q, d, METRICS[metric], None if k == "k" else k)


def test_routes_are_those_named(sides):
    qs, ds, _, _ = sides
    assert 4000 < N.vector_bytes(ds, "id", "vec") < 1 << 25 and 500 < N.vector_bytes(qs, "q", "vec") <= 8000


def test_topk_of_nothing(spark, sides):
    qs, ds, _, _ = sides
    for sent in (1 << 25, 0):
        assert N.topk(qs.limit(0), "q", ds, "id", 3, sent_bytes=max(sent, 1)).collect() == []
        assert N.topk(qs, "q", ds.limit(0), "id", 3, sent_bytes=max(sent, 1)).collect() == []


def test_no_pair_is_a_row(sides):
    qs, ds, _, _ = sides
    for sent in (1 << 25, 4000):
        plan = N.topk(qs, "q", ds, "id", 3, sent_bytes=sent)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_embedding_search_finds_itself(spark):
    import __spark_entry__ as E
    rows = E.queries()["vector_topk_embeddings"](spark, "/root/testdata/sf0.001").collect()
    first = {r.vec_id: (r.neighbour_id, r.distance) for r in rows if r["rank"] == 1}
    assert first and all(k == v for k, (v, far) in first.items()) and all(far == 0 for _, far in first.values())


def test_row_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(v)) for i, v in enumerate(rng.integers(0, 50, 3000))] + [(5000, None)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    got = row_numbers(df, [F.desc("v"), F.asc("i")])
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert [r.i for r in sorted(got.collect(), key=lambda r: r.pos)] == want
    assert sorted(r.pos for r in got.collect()) == list(range(1, 3002))
    assert "Window" not in got._jdf.queryExecution().toString() and row_numbers(df.limit(0), ["v"]).collect() == []


def test_rank_both_ways(spark):
    for n in (0, 1, 4, 50):
        rows = [(f"e{i:02}", float(i * 7 % 10)) for i in range(n)]
        got = rank_both_ways(spark.createDataFrame(rows, "entity string, v double").repartition(4), "v")
        order = sorted(rows, key=lambda r: (-r[1], r[0]))
        every = [(*r, i + 1) for i, r in enumerate(order)]
        assert sorted(map(tuple, got.collect())) == sorted([(*r, "top") for r in every[:3]] + [(*r, "bottom") for r in every[-3:] if n])
        assert "Window" not in got._jdf.queryExecution().toString()
