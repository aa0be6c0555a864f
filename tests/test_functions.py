"""Scalar functions: title case, strip, stay, dates, number text (FIXTURES §4)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from entwine.functions import text as TX
from entwine.functions.numeric import rounded_ratio
from entwine.operators.clean import parse_date, stay_days


def test_title_case(spark):
    rows = [("bOBBY jAcksOn",), ("o'neil mary-ann 3rd x_y",), ("étion éaL",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(TX.title_case("s")).collect()]
    assert got == ["Bobby Jackson", "O'Neil Mary-Ann 3Rd X_Y", "Étion Éal", ""]
    assert got == [r[0].title() for r in rows]


def test_strip_all_whitespace(spark):
    got = spark.createDataFrame([("\t \n a b \r\n",)], "s string").select(TX.strip_ws("s")).first()[0]
    assert got == "a b"


def test_length_of_stay_counts_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 3, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(stay_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_bad_date_raises_and_quarantine_gives_null(spark):
    df = spark.createDataFrame([("xx",)], "date_of_admission string")
    with pytest.raises(Exception):
        df.select(parse_date(df, "date_of_admission")).collect()
    assert df.select(parse_date(df, "date_of_admission", quarantine=True)).first()[0] is None


def test_number_text(spark):
    df = spark.createDataFrame([(1234567, 25539.31, 1665, 10000)], "n long, b double, num long, den long")
    r = df.select(TX.fmt_int("n"), TX.fmt_money("b"),
                  F.concat(TX.fmt_fixed(rounded_ratio(F.col("num"), F.col("den"), 1, 0) * 100 / 100 * 1, 1,
                                        commas=False), F.lit("%"))).first()
    assert r[0] == "1,234,567" and r[1] == "$25,539.31"
    pct = df.select(rounded_ratio(F.col("num") * 100, F.col("den"), 1)).first()[0]
    assert pct == 16.7          # 16.65 rounds half up


def test_rounded_ratio_half_up_and_zero_den(spark):
    df = spark.createDataFrame([(2345, 1000), (-2345, 1000), (125, 1000), (1, 0)], "a long, b long")
    got = [r[0] for r in df.select(rounded_ratio(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [2.35, -2.35, 0.13, None]


def test_tooltips(spark):
    df = spark.createDataFrame([("Diabetes", "Medical Condition", 1234)], "l string, t string, c long")
    title = df.select(TX.node_tooltip("l", "t", "c")).first()[0]
    assert title == "<b>Diabetes</b><br>Type: Medical Condition<br>Patients: 1,234"
    plain = df.select(TX.tooltip_plain(F.lit(title))).first()[0]
    assert plain == "Diabetes\nType: Medical Condition\nPatients: 1,234"


def test_strip_unicode_whitespace(spark):
    rows = [("\u00a0\u2003x y\u3000\x1c\x85",), ("\u200bkept\u200b",), (" \u2028",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(TX.strip_ws("s")).collect()]
    assert got == [r[0].strip() for r in rows] == ["x y", "\u200bkept\u200b", ""]


def test_rejected_dates_are_returned(spark):
    from entwine.operators.clean import clean_dates, date_audit, split_dates
    rows = [(1, "2024-01-31", "2024-02-01 10:00:00"), (2, "31.01.2024", "2024-02-01"), (3, None, "x"), (4, "y", "z"), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, date_of_admission string, discharge_date string")
    good, bad = split_dates(df)
    assert sorted(r.k for r in good.collect()) == [1, 5] and good.schema["date_of_admission"].dataType.typeName() == "timestamp"
    assert sorted((r.k, r.date_of_admission, r.bad_dates) for r in bad.where("k <> 3").collect()) == [
        (2, "31.01.2024", ["date_of_admission"]), (4, "y", ["date_of_admission", "discharge_date"])]
    assert bad.where("k = 3").first().bad_dates == ["discharge_date"] and bad.count() == 3
    assert sorted(map(tuple, date_audit(df).collect())) == [("date_of_admission", 1, 2, 2), ("discharge_date", 2, 1, 2)]
    typed = clean_dates(good)
    assert split_dates(typed)[1].count() == 0 and date_audit(typed.limit(0)).collect() == []


def test_metrics_are_rounded_once_and_missing_values_are_left_out(spark):
    """Averages of raw values: 0.004 a row would vanish if rows were rounded to cents first."""
    from decimal import Decimal, ROUND_HALF_UP

    from entwine.functions.numeric import exact_column, rounded_mean, rounded_units

    values = [0.004, 0.004, 0.007, None, float("nan"), 1234567.125, -3.3333333]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    x = exact_column(df, "v")
    got = df.agg(*[rounded_mean(F.sum(x), F.count(x), d).alias(f"d{d}") for d in (0, 1, 2)],
                 rounded_units(F.sum(x), 2).alias("cents")).first()
    kept = [Decimal(repr(v)) for v in values if v is not None and v == v]
    for d in (0, 1, 2):
        want = (sum(kept) / len(kept)).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP)
        assert got[f"d{d}"] == float(want)
    assert got["cents"] == int((sum(kept) * 100).quantize(Decimal(1), ROUND_HALF_UP))
    ties = spark.createDataFrame([(0.01,), (0.02,), (-0.01,), (-0.02,)], "v double").withColumn("g", F.col("v") > 0)
    t = exact_column(ties, "v")
    assert {r.g: r.m for r in ties.groupBy("g").agg(rounded_mean(F.sum(t), F.count(t), 2).alias("m")).collect()} == {True: 0.02, False: -0.02}
    assert df.where("v > 1e9").agg(rounded_mean(F.sum(x), F.count(x), 2)).first()[0] is None
