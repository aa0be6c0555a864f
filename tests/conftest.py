import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from entwine.session import build_session
    ckpt = tempfile.mkdtemp(prefix="entwine-test-ckpt-")
    s = build_session(master="local[*]", shuffle_partitions=8, app="entwine-tests",
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"


def visit_rows(rows):
    """Cleaned-visit fixture rows from compact tuples:
    (condition, medication, insurer, admission, result, blood_type, gender, age, billing, stay)."""
    import datetime as dt
    out = []
    for i, r in enumerate(rows):
        cond, med, ins, adm, res, bt, gen, age, bill, stay = r
        d0 = dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
        out.append(dict(name=f"p{i}", medical_condition=cond, medication=med, insurance_provider=ins,
                        admission_type=adm, test_results=res, blood_type=bt, gender=gen, age=float(age),
                        billing_amount=float(bill), date_of_admission=d0,
                        discharge_date=d0 + dt.timedelta(days=stay), length_of_stay=stay,
                        l_orderkey=i, l_partkey=i, l_suppkey=i, l_linenumber=1, l_quantity=float(age),
                        l_extendedprice=float(bill), l_discount=0.0, l_tax=0.0, l_returnflag=res,
                        l_linestatus=gen, l_shipdate=d0))
    return out


@pytest.fixture
def make_clean(spark):
    from pyspark.sql import types as T
    schema = T.StructType([
        T.StructField("name", T.StringType()), T.StructField("medical_condition", T.StringType()),
        T.StructField("medication", T.StringType()), T.StructField("insurance_provider", T.StringType()),
        T.StructField("admission_type", T.StringType()), T.StructField("test_results", T.StringType()),
        T.StructField("blood_type", T.StringType()), T.StructField("gender", T.StringType()),
        T.StructField("age", T.DoubleType()), T.StructField("billing_amount", T.DoubleType()),
        T.StructField("date_of_admission", T.TimestampNTZType()), T.StructField("discharge_date", T.TimestampNTZType()),
        T.StructField("length_of_stay", T.LongType()),
        T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType())])

    def make(rows):
        return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in visit_rows(rows)], schema)
    return make
