"""Cleaning: title-cased names, parsed dates, length of stay, stripped categoricals.
One projection; fully pipelined, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws, title_case
from ..spec import GraphSpec, HEALTHCARE

DATE_COLUMNS = ("date_of_admission", "discharge_date")


def parse_date(df: DataFrame, name: str, quarantine: bool = False) -> Column:
    """Text dates are parsed (an unparsable value raises under ANSI, or becomes null
    with ``quarantine``); timestamp columns pass through as they are."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(c) if quarantine else F.to_timestamp(c)
    return c


def stay_days(admit: Column, discharge: Column) -> Column:
    """Whole days between two timestamps, floored (times of day count)."""
    secs = F.unix_timestamp(discharge) - F.unix_timestamp(admit)
    return F.floor(secs / F.lit(86400)).cast("long")


def clean_dates(df: DataFrame, quarantine: bool = False) -> DataFrame:
    return df.withColumns({c: parse_date(df, c, quarantine) for c in DATE_COLUMNS})


def bad_dates(df: DataFrame) -> Column:
    """Names of the date columns whose text is not a date (a null is none); typed columns have none."""
    texts = [c for c in DATE_COLUMNS if isinstance(df.schema[c].dataType, T.StringType)]
    wrong = [F.when(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull(), F.lit(c)) for c in texts]
    return F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")


def split_dates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with parsed dates, rejected rows as they came with ``bad_dates``): no row is in both, none is lost."""
    marked = df.withColumn("bad_dates", bad_dates(df))
    good = marked.where(F.size("bad_dates") == 0).drop("bad_dates")
    return clean_dates(good, quarantine=True), marked.where(F.size("bad_dates") > 0)


def date_audit(df: DataFrame) -> DataFrame:
    """(column, n_dates, n_null, n_rejected) in one pass over the rows."""
    bad = bad_dates(df)
    rows = [F.struct(F.lit(c).alias("column"), F.array_contains("bad", c).alias("wrong"), F.col(c).isNull().alias("none")) for c in DATE_COLUMNS]
    return (df.select(*DATE_COLUMNS, bad.alias("bad")).select(F.inline(F.array(*rows))).groupBy("column")
            .agg(F.count_if(~F.col("wrong") & ~F.col("none")).alias("n_dates"), F.count_if("none").alias("n_null"), F.count_if("wrong").alias("n_rejected")))


def clean_visits(raw: DataFrame, spec: GraphSpec = HEALTHCARE, quarantine: bool = False) -> DataFrame:
    """The four cleaning steps in one ``withColumns``; all other columns are kept."""
    df = clean_dates(raw, quarantine)
    cats = [a.column for a in spec.attributes]
    updates = {"name": title_case("name")}
    updates.update({c: strip_ws(c) for c in cats})
    updates["length_of_stay"] = stay_days(F.col("date_of_admission"), F.col("discharge_date"))
    return df.withColumns(updates)


def clean_quality_log(clean: DataFrame) -> DataFrame:
    """Row count and mean stay (the cleaning log line) as a one-row aggregate."""
    return clean.agg(F.count(F.lit(1)).alias("n_records"),
                     F.sum("length_of_stay").alias("total_stay_days"))
