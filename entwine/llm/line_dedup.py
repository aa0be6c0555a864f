"""Line dedup across documents: every repeated line stays in one document only.

Method: line hashes are range-partitioned together with a salt taken from the
document and sorted by hash, document and position inside each partition; the first
document of each (hash, salt) group is streamed off that order. Rows of a later
document in the group go at once; the rest (one document for each hash and salt at
most) meet once more by hash alone. So a line that a third of all documents hold is
spread over all salts, and no group holds more documents than there are salts in the
second step. Text never takes part: the result is a bitmap for each document.

Native DataFrame code throughout.

Defined results: a null or empty text is one empty line. Lines whose key (ASCII white
space stripped at both ends, A-Z lower-cased) has fewer than ``min_chars`` code
points stay. Rows that repeat a ``doc_id`` are told apart by a hash of their text: each
gets its own bitmap, and equal rows the same one. Rows without ``doc_id`` stay whole and count for
nothing. Other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_hash

MIN_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line) -> F.Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (doc_id, t, n_dropped, bitmap) for each document that loses lines; ``t`` is a hash
    of its text, taken below the generator, so once a text.

    ``bitmap`` is an array of 64-bit words, bit ``i % 64`` of word ``i div 64`` set if
    line ``i`` goes; words after the last one with a bit are left out, and so are
    documents that lose nothing.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 8))).cast("int")
    keys = (docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", text_hash().alias("t"))
            .select("doc_id", "t", F.posexplode_outer(lines_of(F.col("text"))).alias("pos", "line"))
            .select("doc_id", "t", "pos", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= min_chars)
            .select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), salt.alias("salt")))
    by_salt = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    streamed = keys.repartitionByRange(n, "h1", "h2", "salt").withColumn("first", F.first("doc_id").over(by_salt))
    # one row for each (hash, salt) and document: its positions, for the second step
    late = streamed.where(F.col("doc_id") > F.col("first")).select("doc_id", "t", "pos")
    heads = streamed.where(F.col("doc_id") == F.col("first")).select("h1", "h2", "doc_id", "t", "pos")
    both = Window.partitionBy("h1", "h2")
    late_heads = heads.withColumn("first", F.min("doc_id").over(both)).where(F.col("doc_id") > F.col("first")).select("doc_id", "t", "pos")
    bits = (late.unionByName(late_heads).select("doc_id", "t", F.expr("cast(pos div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("b"))
            .groupBy("doc_id", "t", "w").agg(F.bit_or("b").alias("b")))
    return (bits.groupBy("doc_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"), F.max("w").alias("last"),
                                       F.sum(F.bit_count("b")).cast("long").alias("n_dropped"))
            .select("doc_id", "t", "n_dropped",
                    F.expr("transform(sequence(0, last), i -> coalesce(m[i], 0L))").alias("bitmap")))


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``__dropped`` (long) and ``__bitmap`` (null where all lines stay)."""
    found = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("n_dropped").alias("__n"), F.col("bitmap").alias("__bitmap"))
    return (docs.join(found, (F.col("doc_id") == F.col("__id")) & (text_hash() == F.col("__t")), "left")
            .withColumn("__dropped", F.coalesce("__n", F.lit(0).cast("long"))).drop("__id", "__t", "__n"))


def kept_text() -> F.Column:
    """The kept lines of ``text`` under ``__bitmap``, joined by line feeds."""
    return F.when(F.col("__bitmap").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.expr(
        "array_join(filter(split(coalesce(text, ''), '\n', -1), (l, i) -> "
        "coalesce(shiftright(get(__bitmap, cast(i div 64 as int)), i % 64) & 1L, 0L) = 0L), '\n')"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``; rows and columns stay."""
    names = docs.columns
    return with_bitmaps(docs, min_chars).withColumn("text", F.when(F.col("__dropped") > 0, kept_text()).otherwise(F.col("text"))).select(*names)


def digest(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return with_bitmaps(docs.select("doc_id", "text"), min_chars).select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.col("__dropped").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as line
  from documents),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key)
select k.doc_id, count(*) as n_lines, count(*) filter (where k.doc_id > f.first) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.first is null or k.doc_id <= f.first), '')) as kept_sha256
from k left join f on k.key = f.key and length(k.key) >= 10 group by k.doc_id
"""
