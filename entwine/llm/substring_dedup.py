"""Removal of long passages repeated across documents, by De Bruijn compaction.

Method: the graph's edges are token k-mers, but only those that some window of 50 words
selects (the k-mer of least hash in the window), so equal windows always select equal
edges and a document of n words has about 2 n / 42 of them. The run of consecutive
windows that select one k-mer is its path: the words those windows span. A k-mer that
occurs in one document only is dropped. Where all occurrences of a k-mer have the same
path, the path does not branch: it is compacted to one row with its least document, and
no window of it is looked at. Where paths differ the graph branches: each distinct path
(not each occurrence) reads its windows back by the coordinates of its first source and
Spark joins find the least document of each window. Joining the verdicts of paths to
their occurrences gives the start of every removed window.

K-mers, paths and windows are told apart by 64-bit hashes, always within one
64-bit k-mer, so by 128 bits together.

Defined results: a word is a run of anything but ASCII white space, unchanged; a null or
blank text has none. A window goes if its words also start in a document of smaller
``doc_id``; repeats inside one document stay. Rows that repeat a ``doc_id`` are told apart by a
hash of their text: each loses its own windows, and equal rows are treated alike. Rows
without ``doc_id`` stay whole and count for nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, split_words, text_hash, written

WINDOW, KMER = 50, 10
#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stream:
    """The words of some texts in a row, with hashes of any run of them."""

    def __init__(self, texts: pa.Array):
        flat, self.n_words = split_words(texts)
        coded = flat.dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        h = hashes[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.uint64)
        n = len(h)
        self.ends = np.cumsum(self.n_words)
        self.begins = self.ends - self.n_words
        up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * np.multiply.accumulate(up)[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the runs of ``length`` words at ``start``; equal runs of words of one
        length have equal hashes wherever they stand."""
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(np.uint64))


def paths(stream: Stream, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """(text, first window's start in it, windows, k-mer hash, path hash) of each run of
    consecutive windows that select the same k-mer."""
    has = np.flatnonzero(stream.n_words >= window)
    if not len(has):
        return (np.zeros(0, np.int64),) * 5
    hashes = stream.runs(np.arange(stream.ends[-1] - kmer + 1), kmer)
    wide = window - kmer + 1
    n_win = stream.n_words[has] - window + 1
    text = np.repeat(has, n_win)
    start = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win) + stream.begins[text]
    view = np.lib.stride_tricks.sliding_window_view(hashes, wide)
    at = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 16):
        part = slice(i, i + (1 << 16))
        at[part] = view[start[part]].argmin(axis=1)
    at += start
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    m = np.diff(np.append(first, len(start)))
    s = start[first]
    return text[first], s - stream.begins[text[first]], m, hashes[at[first]], stream.runs(s, m + window - 1)


def occurrences(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, t, start, m, a, c): every path of every document, with its k-mer ``a``; ``t`` is
    a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            text, start, m, a, c = paths(Stream(part.column(2)), window, kmer)
            ids, t = np.asarray(part.column(0)), np.asarray(part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(t[text]), pa.array(start.astype(np.int32)), pa.array(m.astype(np.int32)),
                                              pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["doc_id", "t", "start", "m", "a", "c"])

    return (docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_hash().alias("t"), "text")
            .mapInArrow(run, "doc_id long, t long, start int, m int, a long, c long"))


def branch_windows(docs: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """(a, c, off, w, first): the windows of the paths in ``sources`` (a, c, doc_id, t,
    start, m), read from their first source."""
    wanted = sources.groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_list(F.struct("start", "m", "a", "c")).alias("paths"))
    found = (docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), "text").join(wanted, (F.col("doc_id") == F.col("__id")) & (F.col("t") == F.col("__t")))
             .select("doc_id", "text", "paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            stream = Stream(part.column(1))
            lists = part.column(2)
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            start, m, a, c = (np.asarray(x) for x in lists.flatten().flatten())
            at = np.repeat(np.arange(len(row)), m)
            off = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            w = stream.runs(stream.begins[row[at]] + start[at] + off, window)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(c[at]), pa.array(off.astype(np.int32)), pa.array(w.view(np.int64)),
                                              pa.array(np.asarray(part.column(0))[row[at]])], ["a", "c", "off", "w", "first"])

    return found.mapInArrow(run, "a long, c long, off int, w long, first long")


def removed_windows(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, t, starts): for each document that loses words, the starts of the removed
    windows (an array that its length bounds)."""
    if not 1 <= kmer <= window:
        raise ValueError("a window holds at least one k-mer")
    occ = written(occurrences(docs, window, kmer), "repeat-occurrences")
    # tables, so that Spark can split a k-mer that many documents hold when it joins
    shared = written(occ.groupBy("a").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("c").alias("c0"), F.max("c").alias("c1"))
                     .where("first < last").select("a", "first", (F.col("c0") != F.col("c1")).alias("branches")), "repeat-kmers")
    occ = written(occ.join(shared, "a"), "repeat-shared")
    sources = (occ.where("branches").groupBy("a", "c").agg(F.min(F.struct("doc_id", "t", "start", "m")).alias("s"))
               .select("a", "c", "s.doc_id", "s.t", "s.start", "s.m"))
    windows = written(branch_windows(docs, sources, window), "repeat-windows")
    least = written(windows.groupBy("a", "w").agg(F.min("first").alias("least")), "repeat-least")
    verdict = written(windows.join(least, ["a", "w"]).groupBy("a", "c")
               .agg(F.collect_set(F.struct("off", "least")).alias("offs")), "repeat-verdicts")  # as many as the path has windows
    plain = occ.where(~F.col("branches") & (F.col("doc_id") > F.col("first"))).select(
        "doc_id", "t", F.sequence(F.col("start"), F.col("start") + F.col("m") - 1).alias("starts"))
    branched = (occ.where("branches").join(verdict, ["a", "c"])
                .select("doc_id", "t", F.expr("transform(filter(offs, o -> o.least < doc_id), o -> start + o.off)").alias("starts"))
                .where(F.size("starts") > 0))
    return plain.unionByName(branched).groupBy("doc_id", "t").agg(F.flatten(F.collect_set("starts")).alias("starts"))


def _cut(docs: DataFrame, window: int, kmer: int) -> DataFrame:
    gone = removed_windows(docs, window, kmer).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("starts").alias("__starts"))
    return docs.join(gone, (F.col("doc_id") == F.col("__id")) & (text_hash() == F.col("__t")), "left").drop("__id", "__t")


def _masks(part: pa.RecordBatch, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words, words of each text, and which words go."""
    flat, n = split_words(part.column("text"))
    lists = part.column("__starts")
    lens = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    row = np.repeat(np.arange(len(n)), lens)
    steps = np.zeros(len(flat) + 1, np.int64)
    if len(row):
        at = (np.cumsum(n) - n)[row] + np.asarray(lists.flatten())
        at = np.unique(at)
        steps += np.bincount(at, minlength=len(steps))
        steps -= np.bincount(at + window, minlength=len(steps))
    return flat, n, np.cumsum(steps)[:-1] > 0


def _kept(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, removed words and the kept words of each text, joined by spaces."""
    flat, n, gone = _masks(part, window)
    row = np.repeat(np.arange(len(n)), n)
    n_gone = np.bincount(row[gone], minlength=len(n)).astype(np.int64)
    kept, ends = flat.filter(pa.array(~gone)).to_pylist(), np.cumsum(n - n_gone).tolist()
    return n, n_gone, [" ".join(kept[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def drop_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``docs`` with the removed words gone from ``text``; a text that loses words comes
    back with single spaces between those left, other texts unchanged."""
    names = docs.columns
    cut = _cut(docs, window, kmer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            texts = pa.array(_kept(part, window)[2], pa.string())
            k = part.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([texts if i == k else part.column(i) for i in range(len(names))], names)

    whole, parts = cut.where(F.col("__starts").isNull()), cut.where(F.col("__starts").isNotNull())
    return whole.select(*names).unionByName(parts.select(*names, "__starts").mapInArrow(run, docs.schema))


def digest(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            n, n_gone, texts = _kept(part, window)
            shas = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n_gone), pa.array(shas)],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return (_cut(docs.select(F.col("doc_id").cast("long"), "text"), window, kmer).select("doc_id", "text", "__starts")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


ORACLE = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
v as (
  select doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) as h
  from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as s from d where len(ws) >= 50)),
f as (select h, min(doc_id) as first from v group by h),
g as (select distinct doc_id, unnest(range(s, s + 50)) as pos from v join f using (h) where doc_id > first),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from d),
k as (
  select w.doc_id, count(g.pos) as n, string_agg(word, ' ' order by w.pos) filter (where g.pos is null) as t
  from w left join g on w.doc_id = g.doc_id and w.pos = g.pos group by w.doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
