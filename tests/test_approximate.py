"""Approximate search: codes, whole answers, recall against brute force, odd rows."""
import numpy as np
import pytest

from entwine.operators import approximate as AP
from entwine.operators import nearest as N

DIM, K = 24, 10


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, DIM))
    x = np.round(centres[rng.integers(0, 5, 2000)] + rng.normal(size=(2000, DIM)), 3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, [None] * DIM), (5002, [float("nan")] * DIM), (5003, [float("inf")] * DIM), (None, [0.0] * DIM)]
    return spark.createDataFrame(rows + odd, "id long, vec array<double>").repartition(6).checkpoint(), x


def test_codes_are_within_a_step():
    rng = np.random.default_rng(1)
    for dim in (1, 7, 8):
        x = rng.normal(size=(50, dim)) * 3 + 1
        mean, step = x.mean(0), x.std(0) * AP.STEP
        back = AP.unpack(AP.pack(x, mean, step), mean, step)
        inside = np.abs(x - mean) < step * AP.LEVELS / 2
        assert back.shape == x.shape and (np.abs(back - x)[inside] <= (step / 2 + 1e-12)[None].repeat(50, 0)[inside]).all()


@pytest.mark.parametrize("sent", [N.SENT_BYTES, 3000], ids=["one block", "blocks"])
def test_recall_and_exact_distances(vectors, sent):
    df, x = vectors
    queries = df.where("id % 50 = 0")
    hits = AP.topk(queries, "id", df.withColumnRenamed("id", "other"), "other", K, sent_bytes=sent)
    got = {}
    for r in hits.collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.other, r.distance)
    assert set(got) == set(range(0, 2000, 50)) and all(set(v) == set(range(1, K + 1)) for v in got.values())
    found = 0
    for q, ranks in got.items():
        far = ((x - x[q]) ** 2).sum(axis=1)
        assert all(abs(far[d] - f) < 1e-9 for d, f in ranks.values())
        assert [f for _, f in (ranks[i] for i in range(1, K + 1))] == sorted(f for _, f in ranks.values())
        found += len({d for d, _ in ranks.values()} & set(np.argsort(far, kind="stable")[:K].tolist()))
    assert found >= 0.95 * K * len(got)
    assert AP.WIDEN * K <= 0.1 * len(x)


def test_recall_counts(vectors):
    df, _ = vectors
    exact = df.where("id < 4").selectExpr("id", "id + 1 as other")
    assert AP.recall(exact.where("id < 3"), exact, "id", "other").first().asDict() == {"n_exact": 4, "n_found": 3, "recall": 0.75}


def test_small_empty_and_constant_tables(spark, vectors):
    df, _ = vectors
    few = df.where("id < 3").withColumnRenamed("id", "other")
    assert AP.topk(df.where("id = 1"), "id", few, "other", K).count() == 3  # all there are
    assert AP.topk(df.where("id < 0"), "id", few, "other", K).count() == 0
    assert AP.topk(df.where("id = 1"), "id", few.where("other < 0"), "other", K).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(30)], "other long, vec array<double>")
    got = AP.topk(same.where("other = 4").withColumnRenamed("other", "id"), "id", same, "other", 3)
    assert sorted((r["rank"], r.distance) for r in got.collect()) == [(1, 0.0), (2, 0.0), (3, 0.0)]
