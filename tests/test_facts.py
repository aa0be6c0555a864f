"""A user's own table: mapping by name, types, rejected rows, the update path without given columns."""
import datetime as dt

import pytest

from entwine.plans import registry as R
from entwine.plans.context import Ctx
from entwine.sources.facts import read_facts

HEADER = "Name,Cond,When,Out,Years,Bill,extra"
MAPPING = {"name": "Name", "medical_condition": "Cond", "date_of_admission": "When", "discharge_date": "Out", "age": "Years", "billing_amount": "Bill"}
ROWS = ['"smith, ""jo""\nann",Flu,2024-01-02,2024-01-05,31,10.5,x',
        "bo lee, Flu ,2024-01-03,2024-01-04,,7.25,",
        "cy day,Cold,2024-02-30,2024-03-01,40,1,x",
        "di fox,Cold,2024-03-01,2024-03-02,many,1,x",
        "ed gun,Cold,2024-03-01,2024-03-02,50,NaN,x",
        "fi hall,Cold,2024-03-01,2024-03-02,60,2,x,one,too,many",
        "gi ivy,Cold"]


@pytest.fixture
def table(tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *ROWS[:3]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([HEADER, *ROWS[3:]]) + "\n")
    return str(tmp_path)


def test_rows_are_read_or_rejected(spark, table):
    facts, rejected = read_facts(spark, table, MAPPING)
    rows = {r.name: r for r in facts.collect()}
    assert set(rows) == {'smith, "jo"\nann', "bo lee", "ed gun"}
    assert rows["bo lee"].age is None and rows["bo lee"].billing_amount == 7.25 and rows["bo lee"].medical_condition == " Flu "
    assert rows["bo lee"].date_of_admission == dt.datetime(2024, 1, 3) and rows["bo lee"].gender is None
    assert {r.Name: r.reasons for r in rejected.collect()} == {
        "cy day": ["date_of_admission"], "di fox": ["age"], "fi hall": ["_corrupt_record"], "gi ivy": ["_corrupt_record"]}
    assert facts.count() == 3 and rejected.count() == 4  # whatever columns are read


def test_graph_profile_and_update_of_a_table_without_the_given_columns(spark, table):
    c = Ctx(spark, facts=read_facts(spark, table, MAPPING)[0])
    profile = {(r.entity_type, r.entity): r for r in c.profile.collect()}
    assert set(profile) == {("condition", "Flu"), ("condition", "Cold")}
    flu, cold = profile["condition", "Flu"], profile["condition", "Cold"]
    assert (flu.patient_count, flu.avg_age, flu.avg_billing, flu.avg_stay) == (2, 31.0, 8.88, 2.0)
    assert (cold.patient_count, cold.avg_age, cold.avg_billing) == (1, 50.0, None)
    nodes, _ = R._updated(c)
    assert {r.label: (r["count"], r.status) for r in nodes.collect()} == {"Flu": (4, "updated"), "Cold": (2, "updated")}


def test_typed_tables_and_wrong_names(spark, table, tmp_path):
    path = str(tmp_path / "typed")
    spark.createDataFrame([("Ann", 3, dt.datetime(2024, 1, 1))], "n string, a int, d timestamp").write.parquet(path)
    facts, rejected = read_facts(spark, path, {"name": "n", "age": "a", "date_of_admission": "d"}, fmt="parquet")
    assert [(r.name, r.age, r.date_of_admission) for r in facts.collect()] == [("Ann", 3.0, dt.datetime(2024, 1, 1))]
    assert rejected.count() == 0
    for columns in ({"name": "Nobody"}, {"length_of_stay": "Name"}):
        with pytest.raises(ValueError, match="unknown columns"):
            read_facts(spark, table, columns)


def test_documents_of_a_table_without_some_figures(spark, table):
    from entwine.operators.documents import rag_documents

    mapping = {k: v for k, v in MAPPING.items() if k != "age"}
    c = Ctx(spark, facts=read_facts(spark, table, mapping)[0])
    texts = {r.id: r.text for r in rag_documents(c.profile, c.texts, c.dist, None, c.spec).collect()}
    assert all(texts.values()) and "n/a" in texts["condition_flu"]
    assert "0.0%" in texts["condition_flu"]  # 3 records of the default total
    assert "50.0%" in c.documents.where("id = 'condition_flu'").first().text  # of its own, the rejected age row included


def test_vectors_have_unit_length(spark):
    import numpy as np

    from entwine.operators.vectors import unit_vectors

    rows = spark.createDataFrame([(1, "a b b c"), (2, ""), (3, None), (4, "Ünï b")], "k long, t string")
    got = {r.k: np.array(r.embedding) for r in unit_vectors(rows, ["k"], "t").collect()}
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys([1, 2, 3, 4], 64)
    assert [round(float(np.linalg.norm(got[k])), 5) for k in (1, 2, 3, 4)] == [1, 0, 0, 1]
