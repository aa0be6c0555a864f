"""Spelling variant grouping by a bit-sliced position index.

Method: a block of the vocabulary gets a bitset for every (position, letter): bit w is set if
word w has the letter there. A query goes through its letters; ``zero`` holds the words that
agree so far, and three one-error sets those with one letter replaced, one letter of the query
missing (read from the bitsets one position back) or one letter more (one position on). All
bits of a word are handled at once, and all queries of a block together. Length masks pick
the words that end there.

Sharding: two near words, the shorter of length c, differ in one place of a zone of c, so they
agree before the zone's middle or from there on. Every word goes to both halves of the
classes c = its length and its length - 1, under what lies outside the zone; only words
under one key can be near, and only their letters inside the zone are compared. Keys of
more than ``BLOCK`` words are halved again, down to zones of one letter, which the alphabet
bounds; so no block holds more and nothing is left out. A pair that agrees on both sides of a
middle is found in the right half alone, so it counts once. A block returns a row per
word (its number of near words and the best of them), never its pairs.

Forms are followed by doubling: a form is at least twice as frequent, so chains are no longer
than the logarithm of the largest count.

Defined results: a null text has no words; a null id is written as nothing before the colon.
Repeated rows count each. Words of any length take part. Empty input gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, written

RUN = "[a-zÀ-ÿ]+"
SLIP, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Words under one key, and words (and letters) of a block of several keys.
BLOCK, LETTERS = 2048, 1 << 20
NEAR = "word string, n_near long, form_n long, form string"


def corpus_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the texts; a run whose hash ``SLIP`` divides has lost a letter."""
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with what lies outside the zone as ``key`` and inside as ``inner``."""
    after = F.col("c") - F.col("hi")
    size = F.length("word")
    return rows.withColumn("key", F.concat_ws(" ", F.col("c"), F.col("lo"), F.col("hi"), F.substring(F.col("word"), F.lit(1), F.col("lo")),
                                              F.substring(F.col("word"), size - after + 1, after))).withColumn(
        "inner", F.substring(F.col("word"), F.col("lo") + 1, size - after - F.col("lo")))


def halved(rows: DataFrame) -> DataFrame:
    """Both halves of the zone [lo, hi) of every row."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi"))))
    return keyed(rows.select("word", "n", "c", halves.alias("zone")).select("word", "n", "c", "zone.lo", "zone.hi"))


def sharded(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, c, lo, hi, key, inner) with at most ``block`` words under a key, unless its
    zone is one letter."""
    size = F.length("word")
    shortest = words.agg(F.min(size)).first()[0] or 0
    rows = halved(words.select("word", "n", F.explode(F.array(size, size - 1)).alias("c"), F.lit(0).alias("lo")).where(F.col("c") >= shortest)
                  .withColumn("hi", F.col("c")))
    done = None
    while True:
        hot = checkpointed(rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > block).select("key"))
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        side = small(hot)
        rest = rows.join(side, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = halved(rows.join(side, "key", "left_semi"))


def search(group: np.ndarray, inner: list[str], zone: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its number of near words of its own group and the first of these (-1 if none).

    ``inner`` are the letters inside the zone, of ``zone`` letters or one more; ``left`` marks zones
    with letters to compare behind them."""
    size = np.array([len(t) for t in inner], np.int64)
    order = np.argsort(-size, kind="stable")  # queries, the longest first, so that those still running are the first rows
    n, length = len(inner), int(size.max())
    letters = np.full((n, length + 2), -1, np.int32)
    letters[np.arange(length + 2) < size[:, None]] = np.frombuffer("".join(inner).encode("utf-32-le"), np.uint32)
    known = np.unique(letters[letters >= 0])
    letters = np.where(letters >= 0, np.searchsorted(known, letters), len(known)).astype(np.int32)
    lanes = -(-n // 64) * 64

    def bits(flags: np.ndarray) -> np.ndarray:
        wide = np.zeros((*flags.shape[:-1], lanes), bool)
        wide[..., :n] = flags
        return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)

    def position(p: int) -> np.ndarray:
        return bits(letters[:, p] == np.arange(len(known))[:, None])

    short = bits(size == zone)
    ids = np.unique(group, return_inverse=True)[1]
    zero = bits(ids == np.arange(ids.max() + 1)[:, None])[ids[order]]
    changed, fewer, more, before = (np.zeros_like(zero) for _ in range(4))
    back, here, on = None, position(0), position(1)
    for i in range(length):
        r = int((size > i).sum())
        letter = letters[order[:r], i]
        same, was = here[letter], zero[:r].copy()
        before[:r] = was
        changed[:r] = (changed[:r] & same) | (was & ~same)
        fewer[:r] = was if back is None else (fewer[:r] & back[letter]) | was
        more[:r] = (more[:r] | was) & on[letter]
        zero[:r] = was & same
        if i + 1 < length:
            back, here, on = here, on, position(i + 2)
    whole = (size == zone)[order, None]
    near = np.where(whole, (changed & short) | ((more | zero) & ~short), fewer & short)
    near &= ~np.where(left[order, None], np.where(whole, zero, before), np.uint64(0))
    count, first = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    row, lane = np.nonzero(near)
    hit = near[row, lane]
    np.add.at(count, order[row], np.bitwise_count(hit).astype(np.int64))
    row, at = np.unique(row, return_index=True)
    low = hit[at] & (~hit[at] + np.uint64(1))
    first[order[row]] = lane[at] * 64 + np.bitwise_count(low - np.uint64(1)).astype(np.int64)
    return count, first


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys, from batches sorted by key."""
    held = None
    for batch in batches:
        held = pa.concat_tables([x for x in (held, pa.Table.from_batches([batch])) if x is not None]).combine_chunks()
        while True:
            cost = np.asarray(pc.utf8_length(held["inner"])).astype(np.int64)
            full = (np.arange(1, held.num_rows + 1) > BLOCK) | (np.cumsum(cost) > LETTERS)
            ends = 1 + np.flatnonzero(np.asarray(pc.not_equal(held["key"].slice(1), held["key"].slice(0, held.num_rows - 1)).cast(pa.uint8())))
            if not full.any() or not len(ends):
                break
            over = int(np.argmax(full))  # cut at the last key end before it, else at the first one
            cut = int(ends[max(np.searchsorted(ends, over, "right") - 1, 0)])
            yield held.slice(0, cut)
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in blocks(batches):
        keys = table["key"].combine_chunks().dictionary_encode()
        keys = np.asarray((keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).indices)
        table = table.filter(pa.array(np.bincount(keys)[keys] > 1))
        if not table.num_rows:
            continue
        # The most frequent word first, ties by code point: the first near word is the best.
        table = table.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
        keys = np.unique(np.asarray(table["key"]), return_inverse=True)[1]
        c, lo, hi = (np.asarray(table[x]).astype(np.int64) for x in ("c", "lo", "hi"))
        count, first = search(keys, table["inner"].to_pylist(), hi - lo, hi < c)
        found = pa.array(np.flatnonzero(count))
        best = pa.array(first[count > 0])
        yield pa.RecordBatch.from_arrays([pc.take(table["word"], found).combine_chunks(), pa.array(count[count > 0]),
                                          pc.take(table["n"], best).combine_chunks(), pc.take(table["word"], best).combine_chunks()],
                                         ["word", "n_near", "form_n", "form"])


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``links`` (word, root) end."""
    links = checkpointed(links)
    while True:
        on = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = checkpointed(links.join(on, F.col("root") == F.col("_w"), "left"))
        links = step.select("word", F.coalesce("_r", "root").alias("root"))
        if step.where("_w is not null").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n)."""
    words = written(words.select("word", "n"), "vocabulary")
    rows = sharded(words, block).select("key", "word", "n", "c", "lo", "hi", "inner")
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(near_words, NEAR)
    none = F.lit(None)
    both = (words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("struct<k:bigint,form:string>").alias("best"))
            .unionByName(found.select("word", none.cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("k"), "form").alias("best"))))
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.k") >= ratio * F.col("n")
    judged = written(best.select("word", "n", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.k")).alias("form_n")), "forms")
    ends = roots(judged.where("form is not null").select("word", F.col("form").alias("root"))).withColumnRenamed("word", "_word")
    return (judged.join(ends, F.col("word") == F.col("_word"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def digest(docs: DataFrame) -> DataFrame:
    return variants(corpus_words(docs))


#: Chains have fewer than 2**6 links, as counts at least double: six times the root of the root.
ROOTS = ", ".join(["r0 AS MATERIALIZED (SELECT word, coalesce(form, word) AS root FROM form)"] + [
    f"r{k + 1} AS MATERIALIZED (SELECT a.word, b.root FROM r{k} a JOIN r{k} b ON a.root = b.word)" for k in range(6)])
#: crc32 by its table of 256; near words by all strings that a deletion gives.
ORACLE = f"""
WITH RECURSIVE bit(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{RUN}')) AS run FROM documents),
once AS (SELECT run, named, count(*) AS times FROM (SELECT id || ':' || run AS named, run FROM runs WHERE length(run) >= {MIN_LENGTH}) GROUP BY ALL),
hashed AS (SELECT run, times, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(named)) + 1),
  lambda i: ('0x' || substr(hex(encode(named)), 2 * i - 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM once, crc),
slipped AS (SELECT times, CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
gone AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN w b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM gone a JOIN w b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'k': -m, 'form': other}}) AS best FROM near GROUP BY word),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= {RATIO} * n THEN best.form END AS form, CASE WHEN -best.k >= {RATIO} * n THEN -best.k END AS form_n
  FROM w LEFT JOIN best USING (word)),
{ROOTS}
SELECT form.word, form.form, r6.root, form.n, form.n_near, form.form_n FROM form JOIN r6 USING (word)"""
