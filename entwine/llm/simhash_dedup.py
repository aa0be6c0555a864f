"""SimHash near-dedup by anchor-point covering.

Method: two fingerprints at most 3 bits apart are at most 1 bit apart in one of their
halves of 32 bits. The anchors of a half are the words of the perfect Hamming code of
length 31, each with either value of the last bit: every half has one anchor at
distance 1 or less (covering radius 1), its home, so the homes of halves within 1 bit
of ``y`` are all among the anchors within radius plus threshold, 2 bits, of ``y``. Each distinct
fingerprint is put at its two homes and copied to all those anchors, and compared per
anchor. An anchor's rows are cut into blocks (home block x copy block), so no group
grows beyond two blocks; each pair of blocks returns a spanning forest of its links, not
all pairs. Links are checked by their whole bit distance. Components come from
min-label propagation with pointer jumping.

Equal texts share a fingerprint and are one node; their rows join in only at the end.

Defined results: a null or blank text has fingerprint zero, linked like any other.
A document's component is the smallest ``doc_id`` reachable; rows that repeat a
``doc_id`` are each returned. Rows without ``doc_id`` name no component: theirs is that
of their fingerprint's other rows, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions, pieces, text_hash, written

SHINGLE, MAX_BITS = 3, 3
#: Rows of a block; two blocks meet in a task at a time.
BLOCK = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) <= size:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    a = np.concatenate(([0], ends[:-1] + 1))[: len(found) - size + 1].tolist()
    b = ends[size - 1:].tolist()
    del found
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(a), CHUNK):
        h = np.array([digest(joined[x:y], 42) for x, y in zip(a[i:i + CHUNK], b[i:i + CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(a)).tolist()))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, t, fp) with ``fp`` as a signed long, for every row; ``t`` is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            fps = np.array([fingerprint(t.as_py(), size) for t in part.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["doc_id", "t", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), "text").mapInArrow(run, "doc_id long, t long, fp long")


# ---------------------------------------------------------------- anchors of a 32-bit half
def parity(x: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of the low 31 bits: bit ``j - 1`` of a half stands for ``j``."""
    out = np.zeros(len(x), np.int64)
    for j in range(1, 32):
        out ^= np.where((x >> (j - 1)) & 1, j, 0)
    return out


def home(x: np.ndarray) -> np.ndarray:
    """The nearest anchor of each half (int64 below 2**32)."""
    s = parity(x)
    return np.where(s > 0, x ^ (np.int64(1) << np.maximum(s - 1, 0)), x)


def near_anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all homes of halves within one bit of each ``x``."""
    found = np.stack([home(x), *(home(x ^ np.int64(1 << b)) for b in range(32))], axis=1)
    found.sort(axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def place(fps: DataFrame, copies: bool) -> DataFrame:
    """(anchor, fp): the two homes of each fingerprint, or its copies at all anchors near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for half in (0, 1):
                x = (fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                row, at = near_anchors(x) if copies else (np.arange(len(x)), home(x))
                yield pa.RecordBatch.from_arrays([pa.array(at * 2 + half), pa.array(fp[row])], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def forest(homes: np.ndarray, copies: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between home and copy fingerprints."""
    sides, left, links = (homes, copies), [np.ones(len(homes), bool), np.ones(len(copies), bool)], []
    for i in range(len(homes)):
        if not left[0][i]:
            continue
        left[0][i], queue = False, [(homes[i], 0)]
        while queue:
            x, side = queue.pop()
            there = sides[1 - side]
            new = np.flatnonzero(left[1 - side] & (np.bitwise_count((there ^ x).view(np.uint64)) <= max_bits))
            left[1 - side][new] = False
            links += [(int(x), int(y)) for y in there[new] if x != y]
            queue += [(y, 1 - side) for y in there[new]]
    return links


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v): links that join all distinct fingerprints ``fps.fp`` that ``max_bits`` join."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with threshold 1 cover up to 3 differing bits")
    n = partitions(fps.sparkSession)
    homes, copies = place(fps, False), place(fps, True)
    met = homes.select("anchor", F.col("fp").alias("home"))
    copies = copies.join(met, (copies.anchor == met.anchor) & (F.col("fp") != F.col("home")), "left_semi")
    copies = written(copies, "simhash-copies")  # few: most anchors near a fingerprint are nobody's home
    homes = homes.join(copies.select("anchor").distinct(), "anchor", "left_semi")
    rows = homes.select("anchor", "fp", F.lit(True).alias("is_home")).unionByName(copies.select("anchor", "fp", F.lit(False).alias("is_home")))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    size = (rows.groupBy("anchor").agg(F.count_if("is_home").alias("nh"), F.count_if(~F.col("is_home")).alias("nc"))
            .where((F.col("nh") > block) | (F.col("nc") > block)).select("anchor", blocks("nh").alias("h"), blocks("nc").alias("c")))
    own = lambda c: F.pmod(F.xxhash64("fp"), F.coalesce(c, F.lit(1))).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)
    dealt = (rows.join(size, "anchor", "left")
             .select("anchor", "fp", "is_home", F.when(F.col("is_home"), F.array(own("h"))).otherwise(every("h")).alias("i"),
                     F.when(F.col("is_home"), every("c")).otherwise(F.array(own("c"))).alias("j"))
             .withColumn("i", F.explode("i")).withColumn("j", F.explode("j")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(key_rows: list[np.ndarray]) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            all_rows = np.concatenate(key_rows, axis=1)
            cuts = np.flatnonzero(np.any(all_rows[:3, 1:] != all_rows[:3, :-1], axis=0)) + 1
            for g in np.split(all_rows[3:], cuts, axis=1):
                found += forest(g[0][g[1] == 1], g[0][g[1] == 0], max_bits)
            uv = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())], ["u", "v"])

        for batch in batches:  # sorted by (anchor, i, j): the last group of a batch may go on
            part = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1, 2, 3)] + [np.asarray(batch.column(4).cast(pa.int8())).astype(np.int64)])
            same = np.all(part[:3] == part[:3, -1:], axis=0)
            if not (held and np.all(held[-1][:3, -1] == part[:3, 0]) and same.all()):
                cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
                if held or cut:
                    joins = bool(held) and np.all(held[-1][:3, -1] == part[:3, 0])
                    if joins or cut:
                        yield out([*held, part[:, :cut]])
                    else:
                        yield out(held)
                    held = []
                part = part[:, cut:]
            held.append(part)
        if held:
            yield out(held)

    return (dealt.select("anchor", "i", "j", "fp", "is_home").repartition(n, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
            .mapInArrow(run, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (u, v), in a few rounds that shrink
    the graph: every node joins the neighbour (or itself) of the least hash, hashes
    change from round to round, and links within a merged node go."""
    edges = checkpointed(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels, k = None, 0
    while not edges.isEmpty():
        k += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: E731,B023
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = checkpointed(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select(F.col("u").alias("node"), F.least("m", rank("u")).getField("n").alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = checkpointed(labels)
        for end in ("u", "v"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("to").alias(f"{end}2")), end)
        edges = checkpointed(edges.where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct())
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels


def classes(rows: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fp, first, c): each fingerprint of ``rows``, its smallest ``doc_id`` and its component."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = components(written(links(nodes, max_bits, block), "simhash-links"))
    return checkpointed(nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = written(fingerprints(docs, size), "simhash-fp")
    where = classes(rows, max_bits, block)
    least = where.groupBy("c").agg(F.min("first").alias("component_id"))
    return rows.join(where.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: of the smallest ``doc_id``, then the smallest
    hash of the text; of equal rows one stays. Rows without ``doc_id`` all stay."""
    rows = written(fingerprints(docs, size), "simhash-fp").where("doc_id is not null")
    best = (rows.groupBy("fp").agg(F.min(F.struct("doc_id", "t")).alias("best")).join(classes(rows, max_bits).select("fp", "c"), "fp")
            .groupBy("c").agg(F.min("best").alias("best")).select("best.doc_id", "best.t"))
    each = rows.groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    gone = each.join(best, ["doc_id", "t"], "left_anti").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    same = (F.col("doc_id") == F.col("__id")) & (text_hash() == F.col("__t"))
    stay = docs.join(gone, same, "left_anti")
    again = checkpointed(each.where("n > 1").join(best, ["doc_id", "t"], "left_semi").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")))
    if again.isEmpty():
        return stay.select(*docs.columns)
    return (stay.join(again, same, "left_anti").select(*docs.columns)
            .unionByName(stay.join(again, same, "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])))


def digest(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    return near_duplicates(docs, size, max_bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
