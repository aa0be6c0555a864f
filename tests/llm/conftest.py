import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents of the smallest data set with odd rows added: nulls, blanks, a very long
    text, an exact repeat of a row and columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long_text = " ".join(f"wort{i % 7919}" for i in range(60_000)) + "\nline of some length"
    odd = spark.createDataFrame([
        (900001, None, "en", "x", None), (900002, "", None, None, 0), (900003, " \t\n\x0b ", "en", None, 5), (900004, "one", None, "x", 3),
        (900005, long_text, "en", "x", None), (900006, "a b c d e f g h i j", "xx", "x", 1), (900006, "a b c d e f g h i j", "xx", "x", 1),
        (None, "row without an id\nline of some length", "en", "x", 2), (900007, "LINE of some length \nkeep me", "en", "x", 2)], SCHEMA)
    df = base.unionByName(odd)
    for name in ("k", "fp", "h", "a", "c", "_id", "trusted", "bucket", "rate", "copies", "component_id", "start", "sh", "words", "domain", "pos"):
        df = df.withColumn(name, F.lit("clash"))
    return df.checkpoint()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").unionByName(
        spark.createDataFrame([(None, 1, 0), (0, None, None), (900006, 1, 0), (900006, 1, 0)], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0).checkpoint()
