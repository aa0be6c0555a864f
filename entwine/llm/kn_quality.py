"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

Method: an order-5 n-gram model over the symbols (code points) of words, each closed by
an end mark and preceded by four start marks, one model for each language, trained on
the trusted documents. Tasks count the 5-grams of their distinct words and Spark adds the
counts up; continuation counts of the lower orders, modified discounts (from the counts
of counts of each order and language), context weights and interpolated probabilities
are DataFrame aggregates and equi-joins on (language, gram).

Scoring: the model's rows are dealt to shards of at most about ``SHARD_ROWS`` rows by the two
symbols before the predicted one, which every look-up of a position shares, so a
position is scored in one shard whole. Each shard in turn is joined to the documents as a
broadcast table, and a document's perplexity adds up its positions over all shards. A model
of one shard needs one pass; memory is bounded at any size.

A document is rejected if its log perplexity (in thousandths) is more than ``MARGIN``
above the ``QUANTILE`` of trusted documents of its language; the quantile comes from
exact counts by thousandth.

Defined results: words are runs of anything but ASCII white space. A null or blank text
has no perplexity and is rejected. A null ``lang`` is a language of its own. A language
without trusted text has no model and no threshold: its documents stay, with null
perplexity. Rows that repeat a ``doc_id`` with the same text are one; with another text
each is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mark_trusted, pieces, split_words, written

ORDER, START, END = 5, "\x02", "\x03"
SHARD_ROWS = 2_000_000
QUANTILE, MARGIN = 0.995, 150
#: Distinct 5-grams that a task holds before it sends them on.
HELD = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words with their marks, position of each predicted symbol)."""
    text = "".join(START * (ORDER - 1) + w + END for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.array([len(w) + 1 for w in words], np.int64)
    return cp, np.arange(lens.sum()) + np.repeat((np.arange(len(words)) + 1) * (ORDER - 1), lens)


def keys(cp: np.ndarray, last: np.ndarray, n: int, context: bool, lang: str) -> np.ndarray:
    """A 64-bit key of the ``n`` symbols that end at each ``last``."""
    key = np.full(len(last), xxhash.xxh64_intdigest(lang), np.uint64)
    for k in range(n):
        key = (key + cp[last - (n - 1 - k)] + np.uint64(1)) * _P
        key ^= key >> np.uint64(29)
    return (key ^ np.uint64(2 * n + context)) * np.uint64(0xBF58476D1CE4E5B9)


def by_language(part: pa.RecordBatch, text: int, lang: int) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    names = part.column(lang).fill_null("").to_pylist()
    for name in sorted(set(names)):
        at = np.array([i for i, x in enumerate(names) if x == name])
        yield name, at, part.column(text).take(pa.array(at))


# ---------------------------------------------------------------- training
def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, g, n): counts of the 5-grams of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            _, n, grams = held.pop(lang)
            text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([text[i:i + ORDER] for i in range(0, len(text), ORDER)]), pa.array(n)], ["lang", "g", "n"])

        for part in pieces(batches):
            for lang, _, texts in by_language(part, 0, 1):
                coded = split_words(texts)[0].dictionary_encode()
                if not len(coded):
                    continue
                words, times = coded.dictionary.to_pylist(), np.bincount(np.asarray(coded.indices))
                cp, at = symbols(words)
                n = np.repeat(times, [len(w) + 1 for w in words]).astype(np.int64)
                key = keys(cp, at, ORDER, False, lang)
                grams = cp[at[:, None] - np.arange(ORDER - 1, -1, -1)].astype(np.uint32)
                if lang in held:
                    key, n, grams = (np.concatenate(x) for x in zip(held[lang], (key, n, grams)))
                key, first, where = np.unique(key, return_index=True, return_inverse=True)
                held[lang] = [key, np.bincount(where, n, len(key)).astype(np.int64), grams[first]]
            while sum(len(x[1]) for x in held.values()) > HELD:
                yield out(max(held, key=lambda x: len(held[x][1])))
        for lang in list(held):
            yield out(lang)

    return docs.select("text", "lang").mapInArrow(run, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """(lang, g, context, value): log probabilities of grams of 1 to 5 symbols (and of any
    symbol at all, for the empty gram), and log weights of contexts of 0 to 4."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
        levels[k] = written(levels[k + 1].groupBy("lang", F.expr(f"substring(g, 2, {k})").alias("g")).agg(F.count("*").alias("n")), f"kn-{k}")
    lower = checkpointed(levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p"))).withColumn("g", F.lit(""))
    rows = lower.select("lang", "g", F.lit(False).alias("context"), F.log("p").alias("value"))
    for k in range(1, ORDER + 1):
        own = levels[k].withColumn("h", F.expr(f"substring(g, 1, {k - 1})"))
        c = own.groupBy("lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)))
        y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
        full = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0)
        cut = lambda i: F.when(full, F.greatest(F.lit(0.05), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"c{i + 1}") / F.col(f"c{i}")))).otherwise(0.5 * i).alias(f"d{i}")  # noqa: E731,B023
        discounts = checkpointed(c.select("lang", cut(1), cut(2), cut(3)))  # a row for each language
        kind = lambda n: F.least(n, F.lit(3))
        ctx = (own.groupBy("lang", "h").agg(F.sum("n").alias("total"), *(F.count_if(kind(F.col("n")) == i).alias(f"k{i}") for i in (1, 2, 3)))
               .join(F.broadcast(discounts), "lang")
               .withColumn("gamma", F.expr("(d1 * k1 + d2 * k2 + d3 * k3) / total")))
        ctx = written(ctx.select("lang", "h", "total", "gamma", "d1", "d2", "d3"), f"kn-context-{k}")
        p = own.join(ctx, ["lang", "h"]).withColumn("s", F.expr("substring(g, 2)")).join(
            lower.select("lang", F.col("g").alias("s"), F.col("p").alias("q")), ["lang", "s"])
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        lower = written(p.select("lang", "g", (F.greatest(F.col("n") - taken, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), f"kn-p-{k}")
        rows = (rows.unionByName(lower.select("lang", "g", F.lit(False).alias("context"), F.log("p").alias("value")))
                .unionByName(ctx.select("lang", F.col("h").alias("g"), F.lit(True).alias("context"), F.log("gamma").alias("value"))))
    return written(rows, "kn-model")


def shards(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shard, shards, sorted keys, values): the model's rows, a shard at a time."""
    count = max(1, -(-rows.count() // shard_rows))
    last = F.length("g") - F.when(F.col("context"), F.lit(0)).otherwise(F.lit(1))  # symbols of history in the gram
    shard = F.when(last < 2, F.lit(-1)).otherwise((F.expr("ascii(substring(g, length(g) - if(context, 1, 2), 1))") * 8191
                                                  + F.expr("ascii(substring(g, length(g) - if(context, 0, 1), 1))")) % count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kinds = np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            sizes = np.array([len(g) for g in grams])
            out = np.zeros(len(grams), np.uint64)
            for group in sorted(set(zip(langs, sizes.tolist(), kinds.tolist()))):
                at = np.flatnonzero((np.array(langs) == group[0]) & (sizes == group[1]) & (kinds == group[2]))
                cp = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                out[at] = keys(cp, (np.arange(len(at)) + 1) * group[1] - 1, group[1], group[2], group[0])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column(3)], ["key", "value"])

    for s in range(count):
        got = rows.where(shard.isin(-1, s)).select("lang", "g", "context", "value").mapInArrow(run, "key long, value double").toArrow()
        key, value = np.asarray(got["key"]).view(np.uint64), np.asarray(got["value"])
        order = np.argsort(key)
        yield s, count, key[order], value[order].astype(np.float32)


# ---------------------------------------------------------------- scoring
class Scorer:
    def __init__(self, shard: int, count: int, key: np.ndarray, value: np.ndarray):
        self.shard, self.count, self.key, self.value = shard, count, key, value

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        found = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        return found, self.value[at].astype(np.float64) if len(self.key) else np.zeros(len(key))

    def words(self, words: list[str], lang: str) -> tuple[np.ndarray, np.ndarray]:
        """Log probability and symbols of each word, as far as this shard goes."""
        cp, last = symbols(words)
        of = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        if self.count > 1:
            mine = (cp[last - 2] * np.uint64(8191) + cp[last - 1]) % np.uint64(self.count) == self.shard
            last, of = last[mine], of[mine]
        n, logp, left = np.bincount(of, minlength=len(words)), np.zeros(len(last)), np.arange(len(last))
        for k in range(ORDER, -1, -1):
            key = keys(cp, last[left], k, False, lang)
            order = np.argsort(key)  # look-ups in order stay in the cache
            found, value = np.empty(len(key), bool), np.empty(len(key))
            found[order], value[order] = self.look(key[order])
            logp[left[found]] += value[found]
            left = left[~found]
            if not len(left) or not k:
                break
            found, value = self.look(keys(cp, last[left] - 1, k - 1, True, lang))
            logp[left[found]] += value[found]
        return np.bincount(of, logp, len(words)), n


def partial_scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # at most about SHARD_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            total, n = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
            for lang, at, texts in by_language(part, 1, 2):
                flat, size = split_words(texts)
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                logp, symbol = sent.value.words(coded.dictionary.to_pylist(), lang)
                code, row = np.asarray(coded.indices), np.repeat(np.arange(len(size)), size)
                total[at] = np.bincount(row, logp[code], len(size))
                n[at] = np.bincount(row, symbol[code], len(size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(total), pa.array(n)],
                                             ["doc_id", "lang", "trusted", "k", "logp", "n_symbols"])

    return docs.mapInArrow(run, "doc_id long, lang string, trusted boolean, k long, logp double, n_symbols long")


def perplexities(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, k, trusted, n_symbols, mils): log perplexity in thousandths, null
    without a model or words; ``k`` is a hash of the text."""
    marked = mark_trusted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), labels)
    rows = model(written(gram_counts(marked.where("trusted")), "kn-counts"))
    known = rows.select(F.col("lang").alias("known")).distinct()
    wide = marked.select("doc_id", "text", "lang", "trusted", F.xxhash64("text").alias("k"))
    parts = None
    for shard in shards(rows, shard_rows):
        part = written(partial_scores(wide, Scorer(*shard)), "kn-scores")
        parts = part if parts is None else parts.unionByName(part)
    total = parts.groupBy("doc_id", "lang", "k", "trusted").agg(F.sum("logp").alias("logp"), F.sum("n_symbols").alias("n_symbols"))
    mils = F.when(F.col("known").isNotNull() & (F.col("n_symbols") > 0), F.floor(-F.col("logp") / F.col("n_symbols") * 1000))
    return (total.join(F.broadcast(known), F.coalesce("lang", F.lit("")) == F.col("known"), "left")  # a row for each language
            .select("doc_id", "lang", "k", "trusted", "n_symbols", mils.alias("mils")))


def thresholds(scores: DataFrame, quantile: float = QUANTILE, margin: int = MARGIN) -> DataFrame:
    """(l, threshold): a row for each language."""
    bins = scores.where(F.col("trusted") & F.col("mils").isNotNull()).groupBy(F.coalesce("lang", F.lit("")).alias("l"), "mils").agg(F.count("*").alias("n"))
    by = Window.partitionBy("l")
    return (bins.withColumn("upto", F.sum("n").over(by.orderBy("mils"))).withColumn("all", F.sum("n").over(by))
            .where(F.col("upto") >= F.lit(quantile) * F.col("all")).groupBy("l").agg((F.min("mils") + margin).alias("threshold")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: int = MARGIN, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, k, n_symbols, log_perplexity, threshold, kept), the logarithms in thousandths."""
    scores = written(perplexities(docs, labels, shard_rows), "kn-perplexities")
    limit = F.broadcast(checkpointed(thresholds(scores, quantile, margin)))
    kept = (F.col("n_symbols") > 0) & (F.col("mils").isNull() | F.col("threshold").isNull() | (F.col("mils") <= F.col("threshold")))
    return (scores.join(limit, F.coalesce("lang", F.lit("")) == F.col("l"), "left")
            .select("doc_id", "lang", "k", "n_symbols", F.col("mils").alias("log_perplexity"), "threshold", kept.alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents."""
    gone = classify(docs, labels).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("k").alias("__k")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k")), "left_anti").select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).drop("k")
