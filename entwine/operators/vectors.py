"""Embedding and nearest-neighbour search.

Embedder: the default is a network-free feature-hashing embedder written as native
SQL (tokens are runs of letters, marks and digits of the lower-cased text, bucket = first 8 hex digits of
md5(token) mod ``dim``, counts, L2-normalised), so it runs inside whole-stage
codegen on executors. Vectors are made sparse, as ``(id, bucket, n)`` postings, or as
arrays of whole-number counts, whose distances are exact. A user-given model can
be plugged in through ``embed_with`` (an iterator ``pandas_udf``: the model is
loaded once per Python worker and fed Arrow batches).

The exact search over such vectors, or any others, is in ``nearest``, the approximate one in ``approximate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+"
EMBEDDER_NAME = "hashing-md5-64"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def bucket_of(token: Column, dim: int = DIM) -> Column:
    h = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(dim))


def postings(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """Sparse hashed term counts: keys…, bucket, n. One row per (text, bucket);
    the map-side partial aggregate collapses a long text to ≤ dim rows per task
    before the shuffle."""
    t = df.select(*keys, F.explode(tokens(F.col(text))).alias("tok"))
    return (t.select(*keys, bucket_of(F.col("tok"), dim).alias("bucket"))
             .groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")))


def count_vectors(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """keys…, vec array<bigint>: the counts of all ``dim`` buckets, zeros for a text without
    tokens. One shuffle, behind a partial sum that leaves a row a text and task."""
    t = df.select(*keys, F.explode_outer(tokens(F.col(text))).alias("tok")).select(*keys, bucket_of(F.col("tok"), dim).alias("_b"))
    return t.groupBy(*keys).agg(F.array(*[F.count_if(F.col("_b") == b) for b in range(dim)]).alias("vec"))


def unit_vectors(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """keys…, embedding array<float>: ``count_vectors`` at unit length, zeros for a text without tokens."""
    v = count_vectors(df, keys, text, dim)
    norm = F.sqrt(F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x).cast("double"))
    unit = F.transform("vec", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))
    return v.select(*keys, unit.alias("embedding"))


def dense(df: DataFrame, keys: list[str], post: DataFrame, dim: int = DIM) -> DataFrame:
    """keys…, embedding array<float> of length dim, L2-normalised (zero vector for a
    text without tokens). The per-row map holds at most ``dim`` entries."""
    m = post.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"),
                                F.sum(F.col("n") * F.col("n")).alias("nn"))
    j = df.select(*keys).join(m, keys, "left")
    norm = F.sqrt(F.coalesce(F.col("nn"), F.lit(0)).cast("double"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda b: F.when(norm > 0, F.coalesce(F.col("m")[b], F.lit(0)) / norm)
                                 .otherwise(F.lit(0.0)).cast("float"))
    return j.select(*keys, vec.alias("embedding"))


def embed_with(df: DataFrame, text: str, model_factory, dim: int, out: str = "embedding") -> DataFrame:
    """Plug-in embedder: ``model_factory()`` returns a callable list[str] → 2-D array
    of shape (n, dim). Runs as an iterator pandas UDF: one model per Python worker,
    Arrow batches in and out."""
    from pyspark.sql.types import ArrayType, FloatType

    @F.pandas_udf(ArrayType(FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for s in batches:
            vecs = model(s.fillna("").tolist())
            yield pd.Series([list(map(float, v)) for v in vecs])

    return df.withColumn(out, _embed(F.col(text)))

