"""Profile, graph, update and stream semantics on hand-made fixtures."""
from pyspark.sql import functions as F

from entwine.operators import graph as G
from entwine.operators import profile as P
from entwine.operators import update as U
from entwine.spec import HEALTHCARE

BASE = [
    ("Diabetes", "Insulin", "Aetna", "Emergency", "Normal", "A+", "M", 40, 100.00, 2),
    ("Diabetes", "Insulin", "Aetna", "Urgent", "Abnormal", "B+", "F", 50, 200.00, 4),
    ("Diabetes", "Metformin", "Cigna", "Emergency", "Normal", "A+", "F", 60, 300.00, 6),
    ("Cancer", "Chemo", "Cigna", "Elective", "Normal", "O-", "M", 70, 1000.50, 10),
    ("Cancer", None, "Aetna", "Elective", "Inconclusive", "O-", "F", 30, 500.25, 3),
]


def collect_map(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_profile_counts_and_null_label(make_clean):
    clean = make_clean(BASE)
    prof = P.entity_profile(clean, HEALTHCARE)
    rows = {(r.entity_type, r.entity): r for r in prof.collect()}
    assert ("medication", None) not in rows                 # null label is not an entity
    assert rows[("condition", "Diabetes")].patient_count == 3
    assert rows[("condition", "Diabetes")].avg_billing == 200.0
    assert rows[("condition", "Cancer")].avg_billing == 750.38  # 750.375 half up
    assert rows[("condition", "Diabetes")].avg_stay == 4.0
    assert rows[("medication", "Insulin")].avg_age is None      # not a medication metric
    # invariant: Σ count per node type = rows (minus nulls)
    per_type = prof.groupBy("entity_type").agg(F.sum("patient_count").alias("s"))
    sums = collect_map(per_type, "entity_type", "s")
    assert sums["condition"] == 5 and sums["medication"] == 4


def test_edges_topk_ties_and_weights(make_clean):
    rows = [("X", "m", "i", "a", "r", bt, "g", 1, 1.0, 1) for bt in ("E", "D", "C", "B", "A")]
    clean = make_clean(rows)
    edges = G.relation_edges(P.pair_counts(clean, HEALTHCARE), HEALTHCARE)
    assoc = sorted(r.dst for r in edges.where(F.col("relationship") == "ASSOCIATED_WITH").collect())
    assert assoc == ["blood_type:A", "blood_type:B", "blood_type:C", "blood_type:D"]   # ties by label
    treated = edges.where(F.col("relationship") == "TREATED_WITH").agg(F.sum("weight")).first()[0]
    assert treated == 5                                      # Σ weight of a full relation = rows


def test_degree_invariants_and_isolated_and_single(spark, make_clean):
    clean = make_clean(BASE)
    nodes = G.nodes_from_counts(P.entity_profile(clean, HEALTHCARE), HEALTHCARE)
    edges = G.relation_edges(P.pair_counts(clean, HEALTHCARE), HEALTHCARE)
    iso = spark.createDataFrame([("condition:Lonely", "Lonely", "condition", "#D9506A", 1, "t")], nodes.schema)
    c = G.with_centrality(nodes.unionByName(iso), edges)
    deg = collect_map(c, "id", "degree")
    assert deg["condition:Lonely"] == 0
    assert sum(deg.values()) == 2 * edges.count()
    assert collect_map(c, "id", "centrality")["condition:Lonely"] == 0.0
    one = G.with_centrality(iso, edges.limit(0)).first()
    assert one.centrality == 1.0 and one.radius == 62.0
    assert G.max_edge_weight(edges.limit(0)).first()[0] == 1


def test_label_clash_gives_two_nodes(make_clean):
    clean = make_clean([("Other", "Other", "i", "a", "r", "b", "g", 1, 1.0, 1)])
    nodes = G.nodes_from_counts(P.entity_profile(clean, HEALTHCARE), HEALTHCARE)
    ids = sorted(r.id for r in nodes.where(F.col("label") == "Other").collect())
    assert ids == ["condition:Other", "medication:Other"]


def test_upsert_new_updated_untouched(spark):
    edges = spark.createDataFrame([("c:A", "m:X", "TREATED_WITH", 3, "t1"), ("c:A", "m:Y", "TREATED_WITH", 7, "t2")],
                                  "src string, dst string, relationship string, weight long, title string")
    batch = spark.createDataFrame([("c:A", "m:X", "TREATED_WITH", 2), ("c:B", "m:X", "TREATED_WITH", 1)],
                                  "src string, dst string, relationship string, n long")
    out = {(r.src, r.dst): r for r in U.upsert_edges(edges, batch, HEALTHCARE).collect()}
    assert out[("c:A", "m:X")].weight == 5 and out[("c:A", "m:X")].status == "updated"
    assert out[("c:A", "m:X")].title == "TREATED_WITH<br>5 patients"
    assert out[("c:B", "m:X")].weight == 1 and out[("c:B", "m:X")].status == "new"
    assert out[("c:A", "m:Y")].weight == 7 and out[("c:A", "m:Y")].title == "t2"
    empty = U.upsert_edges(edges, batch.limit(0), HEALTHCARE)
    assert sorted((r.src, r.dst, r.weight) for r in empty.collect()) == [("c:A", "m:X", 3), ("c:A", "m:Y", 7)]


def test_rank_overlap_with_few_hubs(spark):
    df = spark.createDataFrame([(f"h{i}", float(i)) for i in range(4)], "entity string, v double")
    r = P.rank_both_ways(df, "v").collect()
    top = [x.entity for x in sorted(r, key=lambda x: x.pos) if x.grp == "top"]
    bottom = [x.entity for x in sorted(r, key=lambda x: x.pos) if x.grp == "bottom"]
    assert top == ["h3", "h2", "h1"] and bottom == ["h2", "h1", "h0"]


def test_stream_batch_redo_is_idempotent(spark, tmp_path):
    from entwine.streaming.graph_stream import current_graph, delta_writer, edge_deltas
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "u long, t string")
    to_d = lambda b: edge_deltas(b, F.col("u").cast("string"), F.col("t"), "R")
    w = delta_writer(str(tmp_path / "d"), to_d)
    w(batch, 0)
    w(batch, 0)            # replay of batch 0
    w(batch.limit(1), 1)
    g = {(r.src, r.dst): r.weight for r in current_graph(spark, str(tmp_path / "d")).collect()}
    assert g == {("1", "a"): 3, ("2", "b"): 1}


def test_event_stream_reads_a_folder_of_files(spark, tmp_path):
    from entwine.streaming.graph_stream import current_graph, run_event_stream
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) == 5
    got = current_graph(spark, run_event_stream(spark, str(tmp_path)))
    assert got.agg(F.sum("weight")).first()[0] == events.where("user_id is not null and event_type is not null").count()


def test_compacted_graph_counts_every_batch_once(spark, tmp_path):
    from entwine.streaming.graph_stream import GraphStore, current_graph, current_nodes, delta_writer, graph_deltas
    path, rows = str(tmp_path / "g"), [("u1", "a"), ("u1", "a"), ("u2", None), (None, "b")]
    batch = spark.createDataFrame(rows, "u string, t string")
    w = delta_writer(path, lambda b: graph_deltas(b, F.col("u"), "user", F.col("t"), "type", "R"), compact_every=3)
    GraphStore(spark, path).create()
    assert current_graph(spark, path).collect() == [] and current_nodes(spark, path).collect() == []
    for i in range(8):
        w(batch, i)
        if i in (2, 5, 6):
            w(batch, i)        # replayed: 2 and 5 after their compaction
        assert {(r.src, r.dst): r.weight for r in current_graph(spark, path).collect()} == {("u1", "a"): 2 * (i + 1)}
        assert {(r.id, r.node_type): r["count"] for r in current_nodes(spark, path).collect()} == {
            ("u1", "user"): 2 * (i + 1), ("u2", "user"): i + 1, ("a", "type"): 2 * (i + 1), ("b", "type"): i + 1}
    assert sorted(r.upto for r in spark.read.parquet(f"{path}/states").select("upto").distinct().collect()) == [2, 5]
    read = [p for p in current_graph(spark, path).inputFiles() if "/deltas/" in p]
    plan = current_graph(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "batch_id" in plan and "> 5" in plan and read


def test_an_empty_event_table_is_an_empty_graph(spark, tmp_path):
    from entwine.streaming.graph_stream import current_graph, current_nodes, run_event_stream
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    path = run_event_stream(spark, str(tmp_path))
    assert current_graph(spark, path).collect() == [] and current_nodes(spark, path).collect() == []


def test_upsert_marks_saved_rows_without_title_as_updated(spark):
    from entwine.operators.update import upsert_edges
    base = spark.createDataFrame([("a", "b", "R", 3, None)], "src string, dst string, relationship string, weight long, title string")
    batch = spark.createDataFrame([("a", "b", "R", 2)], "src string, dst string, relationship string, n long")
    assert [(r.weight, r.status) for r in upsert_edges(base, batch).collect()] == [(5, "updated")]


def test_tokens_keep_letters_of_all_languages(spark):
    from entwine.operators.vectors import tokens
    df = spark.createDataFrame([("Élève naïve, 東京 42",)], "t string")
    assert df.select(tokens(F.col("t")).alias("x")).first().x == ["élève", "naïve", "東京", "42"]


def test_question_keys_do_not_clash(spark):
    from entwine.operators.requests import questions
    c = spark.createDataFrame([(1, 1000, "user", "a"), (2, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert questions(c).select("qid").distinct().count() == 2


def test_recent_batch_takes_the_latest_with_ties_and_nulls(spark):
    from entwine.operators.update import recent_batch
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, None)], "k int, date_of_admission int")
    for n, want in ((1, [3]), (2, [3, 2]), (3, [3, 2, 1]), (4, [3, 2, 1, 4]), (9, [3, 2, 1, 4])):
        assert [r.k for r in recent_batch(df, n, tie_break=("k",)).collect()] == want


def test_recent_batch_cuts_off_by_day(spark):
    import datetime as dt
    from entwine.operators.update import recent_batch
    rows = [(i, dt.datetime(2024, 1, 1 + i // 24, i % 24, i % 60)) for i in range(24 * 5)]
    df = spark.createDataFrame(rows, "k int, date_of_admission timestamp_ntz").repartition(4)
    assert [r.k for r in recent_batch(df, 30, tie_break=("k",)).collect()] == list(range(119, 89, -1))


def test_csv_keeps_every_text(spark):
    from entwine.sources.io import csv_roundtrip
    rows = [(1, "a\nb"), (2, " lead and trail "), (3, ""), (4, None), (5, 'say "hi", \\ and \\"'), (6, "x,y"), (7, "\t")]
    assert sorted(map(tuple, csv_roundtrip(spark.createDataFrame(rows, "k int, t string")).collect())) == rows


def test_node_link_documents(spark, tmp_path):
    import json

    import pytest
    from entwine.sources.io import read_node_link, write_node_link
    doc = {"directed": False, "multigraph": False, "graph": {}, "nodes": [
        {"node_type": "condition", "color": "#D9506A", "count": 3, "title": "t", "id": "Flu"}, {"id": "Aspirin", "label": "Asp"}]}
    link = {"weight": 2, "relationship": "TREATED_WITH", "title": "x", "source": "Flu", "target": "Aspirin"}
    for name in ("links", "edges"):
        (tmp_path / f"{name}.json").write_text(json.dumps({**doc, name: [link]}, indent=1))
        nodes, edges = read_node_link(spark, str(tmp_path / f"{name}.json"))
        assert sorted((r.id, r.label, r["count"]) for r in nodes.collect()) == [("Aspirin", "Asp", None), ("Flu", "Flu", 3)]
        assert [tuple(r) for r in edges.collect()] == [("Flu", "Aspirin", "TREATED_WITH", 2, "x")]
    path = write_node_link(nodes, edges, str(tmp_path / "out"))
    [file] = (tmp_path / "out").glob("part-*")
    back = json.loads(file.read_text())
    assert back["links"] == [link] and {x["id"] for x in back["nodes"]} == {"Flu", "Aspirin"} and back["multigraph"] is False
    assert read_node_link(spark, path)[1].collect() == edges.collect()
    with pytest.raises(ValueError):
        write_node_link(nodes, edges, str(tmp_path / "big"), max_bytes=10)
