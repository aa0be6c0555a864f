"""Benchmark decontamination by SimHash over item-sized windows.

Method: a window of a document has as many words as an item. Where shingle ``p`` of the
document (a run of five words) equals shingle ``q`` of the item, ``p - q`` is an aligned
start. All starts between an item's least and largest aligned one are taken (moved inside
the document's ends) whose window holds as many of the item's shingles as the similarity
needs, and of windows with the same shingles the first; a best window is among them, since one left of all its aligned starts can move right
without loss, and likewise to the left. Windows and items get a 64-bit SimHash of their
shingles, repeats included. Thirty-two blocks of two bits index them: fingerprints at most 31 bits
apart agree in a block, so the join on (item, block, bits) finds all pairs within the
radius; the first agreeing block alone reports a pair. Candidates are then verified by the
weighted Jaccard similarity of their shingles (least counts over largest counts).

Native DataFrame code throughout. Items are the small side: they are broadcast if a
count shows that they have at most ``BROADCAST_ROWS`` shingles, else joins shuffle.

Defined results: words are runs of anything but ASCII white space, in lower case. Items
of fewer than five words, null and blank ones have no shingle and match nothing; a
document of fewer than five words matches nothing. A document shorter than the item
is compared as a whole. Repeated rows of either table give the pair once. Rows without
``doc_id`` or ``item_id`` take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, small, words, written

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 31, 32


def with_shingles(df: DataFrame, name: str, size: int = SHINGLE) -> DataFrame:
    """``df`` with ``name`` in place of ``text``: the hashes of the text's shingles in
    order; none below ``size`` words. In two steps, so that words are hashed once; explode
    it with the outer forms, since a filter that Spark infers would join the steps."""
    rest = [c for c in df.columns if c != "text"]
    hashed = df.select(*rest, F.transform(words(F.lower("text")), lambda w: F.xxhash64(w)).alias("_w"))
    return hashed.select(*rest, F.when(F.size("_w") >= size, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0))),
        lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>")).alias(name))


def simhash(hashes: Column) -> Column:
    """Bit ``b`` is 1 if it is set in over half of the hashes."""
    one = F.lit(1).cast("long")
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(
        2 * F.aggregate(hashes, F.lit(0).cast("int"), lambda n, h: n + F.getbit(h, b).cast("int")) > F.size(hashes),
        F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def blocks(fp: Column) -> Column:
    width = 64 // BLOCKS
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
                       lambda b: F.call_function("shiftright", fp, b * width).bitwiseAND(F.lit((1 << width) - 1)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as bags."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.when((F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b)),
                    F.size(F.array_intersect(a, b))).otherwise(
        F.aggregate(F.array_intersect(a, b), F.lit(0).cast("int"), lambda n, x: n + F.least(count(a, x), count(b, x))))
    return common / (F.size(a) + F.size(b) - common)


def items_of(benchmark: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, ish, ik, ifp): the items with their shingles' hashes, a hash of these and fingerprint."""
    items = with_shingles(benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text"), "ish", size)
    return checkpointed(checkpointed(items.where(F.size("ish") > 0).distinct()).withColumn("ik", F.xxhash64("ish")).withColumn("ifp", simhash(F.col("ish"))))


def starts(least: float) -> Column:
    """The starts of an item's windows that can reach the similarity ``least``. A window of ``n`` shingles
    needs ``need`` that the item has, so some ``need`` consecutive marks lie inside it; of the
    starts, those between the least and the largest aligned one are enough."""
    n, last = F.col("n"), F.greatest(F.lit(0), F.col("len") - F.col("n"))
    inside = lambda x: F.greatest(F.lit(0), F.least(x, last))
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * (n + F.least(n, F.col("len"))) / F.lit(1 + least) - F.lit(1e-9)).cast("int"))
    before = lambda i: F.when(i > 0, F.least(inside(F.col("hi")), F.get("ps", i - 1)) + 1)  # noqa: E731  # behind the last span, so that none is twice
    spans = F.transform("ps", lambda p, i: F.struct(
        F.greatest(inside(F.col("lo")), F.get("ps", i + need - 1) - n + 1, before(i)).alias("a"), F.least(inside(F.col("hi")), p).alias("b"),
        F.get("ps", i + need - 1).isNotNull().alias("full")))
    return F.flatten(F.transform(F.filter(spans, lambda s: s["full"] & (s["a"] <= s["b"])), lambda s: F.sequence(s["a"], s["b"])))


def first_starts(hit: DataFrame) -> DataFrame:
    """(doc_id, k, item_id, ik, n, start) of ``hit`` (doc_id, k, sh, spans): of an item's windows of a text
    that hold the same shingles, the first. Windows are told apart by the differences of two running
    sums of 31-bit hashes, on narrow rows, so that a text that repeats itself is not cut at every start."""
    part = lambda seed: F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 31))
    upto = Window.partitionBy("doc_id", "k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sums = (hit.select("doc_id", "k", F.posexplode("sh").alias("p", "h"))
            .select("doc_id", "k", (F.col("p") + 1).alias("p"), F.sum(part(1)).over(upto).alias("s1"), F.sum(part(2)).over(upto).alias("s2")))
    at = hit.select("doc_id", "k", F.size("sh").alias("len"), F.inline("spans")).select("doc_id", "k", "len", "item_id", "ik", "n", F.explode("starts").alias("start"))
    zero = F.lit(0).cast("long")
    ends = (at.withColumn("p", F.least(F.col("start") + F.col("n"), F.col("len"))).join(sums, ["doc_id", "k", "p"]).drop("p")
            .withColumnsRenamed({"s1": "e1", "s2": "e2"}).withColumn("p", F.col("start")).join(sums, ["doc_id", "k", "p"], "left"))
    held = [(F.col("e1") - F.coalesce("s1", zero)).alias("b1"), (F.col("e2") - F.coalesce("s2", zero)).alias("b2")]
    return ends.groupBy("doc_id", "k", "item_id", "ik", "n", *held).agg(F.min("start").alias("start")).drop("b1", "b2")


def windows_of(docs: DataFrame, items: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, k, item_id, ik, start, n, wsh): an item's windows of ``n`` shingles, each once; ``k`` and
    ``ik`` are hashes of the text and of the item's shingles; of windows with the same shingles the first. Shared shingles are found on
    narrow rows; only documents that have enough are read again."""
    own = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("k"), "text")
    marks = (items.select("item_id", "ik", F.size("ish").alias("n"), F.posexplode("ish").alias("q", "h"))
             .groupBy("item_id", "ik", "n", "h").agg(F.min("q").alias("q0"), F.max("q").alias("q1")))
    spots = with_shingles(own, "sh", size).select("doc_id", "k", F.size("sh").alias("len"), F.posexplode_outer("sh").alias("p", "h"))
    at = (spots.join(small(marks, rows), "h").groupBy("doc_id", "k", "len", "item_id", "ik", "n")
          .agg(F.array_sort(F.collect_set("p")).alias("ps"), F.min(F.col("p") - F.col("q1")).alias("lo"), F.max(F.col("p") - F.col("q0")).alias("hi"))
          .select("doc_id", "k", "item_id", "ik", "n", starts(least).alias("starts")).where(F.size("starts") > 0))
    lists = written(at.groupBy("doc_id", "k").agg(F.collect_list(F.struct("item_id", "ik", "n", "starts")).alias("spans")), "decontaminate-spans")
    hit = written(with_shingles(own.join(small(lists, rows), ["doc_id", "k"]).dropDuplicates(["doc_id", "k"])
                                .select("doc_id", "k", "text", "spans"), "sh", size), "decontaminate-texts")
    kept = first_starts(hit).groupBy("doc_id", "k").agg(F.collect_list(F.struct("item_id", "ik", "start", "n")).alias("kept"))
    # a window is cut behind the explode, so that no row holds all windows of a text
    return (hit.select("doc_id", "k", "sh").join(kept, ["doc_id", "k"]).select("doc_id", "k", "sh", F.inline("kept"))
            .select("doc_id", "k", "item_id", "ik", "start", "n", F.slice("sh", F.col("start") + 1, F.col("n")).alias("wsh")))



def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, least: float = SIMILARITY,
                 radius: int = RADIUS, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, start, bits, similarity): each document and item that match, with
    the best window (most similar, then first)."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find all pairs up to {BLOCKS - 1} bits apart")
    items = items_of(benchmark, size)
    # each step that computes on arrays is written, so that no later step repeats it
    found = written(windows_of(docs, items, size, least, rows), "decontaminate-windows")
    found = written(found.withColumn("wfp", simhash(F.col("wsh"))), "decontaminate-prints")
    wide = items.select("item_id", "ik", "ifp", F.posexplode(blocks(F.col("ifp"))).alias("block", "bits"))
    agree = F.array_position(blocks(F.col("wfp").bitwiseXOR(F.col("ifp"))), F.lit(0).cast("long"))
    window = ["doc_id", "k", "item_id", "ik", "start"]
    near = (found.select(*window, "wfp", F.posexplode(blocks(F.col("wfp"))).alias("block", "bits"))
            .join(small(wide, rows), ["item_id", "ik", "block", "bits"])
            .where((F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= radius) & (agree == F.col("block") + 1))
            .select(*window, F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))).alias("x")))
    pairs = written(near.join(found, window).join(small(items.select("item_id", "ik", "ish"), rows), ["item_id", "ik"])
                    .withColumn("similarity", similarity(F.col("wsh"), F.col("ish"))), "decontaminate-pairs").where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"), (-F.col("x")).alias("near")))
    return (pairs.groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", (-F.col("b.at")).alias("start"), (-F.col("b.near")).alias("bits"), "b.similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that match an item."""
    gone = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
