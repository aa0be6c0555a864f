"""The fact view and what reads it: how often line items are shuffled, and the batch of latest records."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from entwine.operators.update import recent_batch
from entwine.plans.context import Ctx
from entwine.sources import io, tables
from entwine.sources.tables import raw_visits

DAY = dt.datetime(2020, 1, 1)


@pytest.fixture
def star(spark, tmp_path):
    """A folder with the six tables; the orders of the last 40 days have no line item but for one record,
    some orders have no date, some keys come twice and some are null or unknown."""
    r = random.Random(5)

    def save(name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("region", "r_regionkey int, r_name string", [(0, "EAST"), (1, "WEST")])
    save("nation", "n_nationkey int, n_name string, n_regionkey int", [(i, f"n{i}", i % 2) for i in range(4)])
    save("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
         [(i % 18, f"Customer#{i}", i % 5, 1.0, "AB"[i % 2]) for i in range(20)])
    save("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
         [(i % 28, f"part {i}", f"Brand#{i % 3}", ("SMALL", "LARGE")[i % 2], 1, 1.0) for i in range(30)])
    days = [DAY + dt.timedelta(days=i // 4) for i in range(400)]
    save("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
         [(i if i % 50 else 7, r.randrange(20) if i % 9 else None, "O", 1.0, None if i % 31 == 0 else days[i], "1-URGENT") for i in range(400)])
    lines = [(r.randrange(240), r.randrange(32), 1, j % 7, float(j % 9), float(j), 0.0, 0.0, "AN"[j % 2], "FO"[j % 2], DAY) for j in range(900)]
    lines.append((397, 3, 1, 1, 1.0, 1.0, 0.0, 0.0, "A", "F", DAY))
    save("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp", lines)
    return str(tmp_path)


def plain(df):
    return sorted(map(str, df.collect()))


def joined_plainly(spark, folder):
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region", "part")}
    v = (t["lineitem"].join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(t["customer"], F.expr("o_custkey = c_custkey"))
         .join(t["nation"], F.expr("c_nationkey = n_nationkey")).join(t["region"], F.expr("n_regionkey = r_regionkey")).join(t["part"], F.expr("l_partkey = p_partkey")))
    return v.select(*[F.col(src).alias(dst) for dst, src in tables.VISIT_COLUMNS.items()], *tables.LINEITEM_COLUMNS)


def test_line_items_of_large_tables_are_shuffled_twice_at_most(spark, star, monkeypatch, capsys):
    monkeypatch.setattr(tables, "DIMENSION_BOUND", 0)
    monkeypatch.setattr(tables, "broadcast_if_bounded", lambda df: df)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        visits = raw_visits(spark, star)
        capsys.readouterr()
        visits.explain()
        lines = capsys.readouterr().out.splitlines()
        assert plain(visits) == plain(joined_plainly(spark, star))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    depth = [next((i for i, x in enumerate(line) if x.isalnum()), 0) for line in lines]
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "l_orderkey" in line)
    above, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if 0 < depth[i] < level:
            above.append(lines[i])
            level = depth[i]
    assert sum("Exchange" in line for line in above) == 2


def test_broadcast_orders_give_the_same_visits(spark, star):
    assert plain(raw_visits(spark, star)) == plain(joined_plainly(spark, star))


@pytest.mark.parametrize("n", [1, 20, 300, 5000])
def test_batch_joins_late_orders_only(spark, star, n):
    c = Ctx(spark, star)
    late, cutoff = c._late(n)
    assert plain(recent_batch(late, n, cutoff=cutoff)) == plain(recent_batch(c.clean, n))
    assert n > 20 or 0 < late.count() < c.clean.count() / 2


def test_csv_is_compressed_and_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", 1.5), (2, None, None), (3, ' "q" ', 0.1), (4, "", 2.0)], "k int, t string, x double")
    path = str(tmp_path / "out")
    assert plain(io.csv_roundtrip(df, path)) == plain(df)
    assert glob.glob(f"{path}/*.csv.gz") and not glob.glob(f"{path}/*.csv")
