"""Every registered query against its DuckDB oracle on the smallest data set,
plus invariants of the stand-in graph."""
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from entwine.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


ORACLE_KEYS = sorted(E.oracle_sql())


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _digest(df.columns, srows) == _digest(dcols, res.fetchall())


def test_entry_runs(spark):
    assert E.entry(spark).count() == 49


def test_graph_sizes_and_invariants(spark):
    q = E.queries()
    assert q["graph_nodes"](spark, SF).count() == 49
    edges = q["graph_edges"](spark, SF)
    assert edges.count() == 132
    per_hub = edges.where("relationship = 'ASSOCIATED_WITH'").groupBy("src").count().collect()
    assert max(r["count"] for r in per_hub) <= 4
    docs = q["rag_documents"](spark, SF)
    assert docs.count() == 18 and docs.select("id").distinct().count() == 18


def test_json_export_import_identity(spark):
    from entwine.plans.context import Ctx
    from entwine.session import scratch_path
    from entwine.sources import io as IO
    c = Ctx(spark, SF)
    path = IO.export_graph_json(c.nodes, c.edges, scratch_path(spark, "t-json"))
    nodes, edges = IO.import_graph_json(spark, path)
    assert nodes.exceptAll(c.nodes).count() == 0 and c.nodes.exceptAll(nodes).count() == 0
    assert edges.exceptAll(c.edges).count() == 0 and c.edges.exceptAll(edges).count() == 0


def test_ann_recall_against_exact(spark):
    q = E.queries()
    exact = {(r.vec_id, r.neighbour_id) for r in q["vector_topk_embeddings"](spark, SF).collect()}
    ann = {(r.vec_id, r.neighbour_id) for r in q["vector_topk_ann"](spark, SF).collect()}
    assert len(ann) == len(exact) and len(ann & exact) >= 0.9 * len(exact)
