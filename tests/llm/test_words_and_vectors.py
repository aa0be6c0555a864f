"""Language identification, spelling variants and vector codes against brute force."""
import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from entwine.llm import language_id, queries, spelling, vector_codes

SMALL = "/root/testdata/sf0.001"


# --- op11 -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model(corpus):
    return language_id.train(corpus)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in held) < 0.1 * len(held)


def brute_counts(text):
    out = Counter()
    if text and any(unicodedata.category(c)[0] == "L" for c in text):
        s = " " + re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()) + " ").lstrip(" ")
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                if n > 1 or s[i] != " ":
                    key = 0
                    for c in s[i:i + n]:
                        key = key << 21 | ord(c)
                    out[key * 0x9E3779B97F4A7C15 % 2**64 >> 64 - 14] += 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_language_counts(monkeypatch, rows, block):
    monkeypatch.setattr(language_id, "LETTERS", block)
    texts = [t for _, t in rows if t is None or len(t) < 400][:60] + ["Ünï  ćode\n\n 12 ab", "́", "12 !", "a", " a ", "日本語 text"]
    got = language_id.counts(texts)
    for text, row in zip(texts, got):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == brute_counts(text)


def test_language_prediction_against_brute_force(corpus, rows, model):
    centres, idf = model
    centres = sorted(centres.collect(), key=lambda r: (r.lang, r.k))
    assert all(r.lang is not None for r in centres) and max(r.k for r in centres) < language_id.CENTROIDS
    want = Counter()
    for i, text in rows:
        n = brute_counts(text)
        w = {b: round((1 + math.log(k)) * idf[b] * language_id.WEIGHT) for b, k in n.items()}
        if not w:
            want[i, "und", 0.0, True] += 1
            continue
        size = math.sqrt(sum(v * v for v in w.values()))
        near = [sum(v * r.centre[b] for b, v in w.items()) / (size * math.sqrt(sum(c * c for c in r.centre))) for r in centres]
        best = max(range(len(near)), key=lambda j: near[j])
        want[i, centres[best].lang, round(near[best], 4), 1 - round(near[best], 6) > centres[best].within] += 1
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4), r.rejected) for r in language_id.predict(corpus, *model).collect())
    assert sum((got - want).values()) <= 2  # a score that rounds another way


def test_language_shards_agree(corpus, model):
    one = language_id.predict(corpus, *model, shard=1)
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, language_id.predict(corpus, *model).collect()))


def test_language_sample_is_bounded(corpus):
    centres, _ = language_id.train(corpus, sample=3)
    assert 0 < max(r["count"] for r in centres.groupBy("lang").count().collect()) <= 3


def test_language_never_learns_from_held_out(spark):
    ids = list(range(60))
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2}
    df = spark.createDataFrame([(i, "zzz qqq", "bad") if i in held else (i, "the word and", "en") for i in ids], "doc_id long, text string, lang string")
    got = language_id.identify(df).collect()
    assert held and {r.lang_pred for r in got} == {"en"} and {r.doc_id for r in got if r.held_out} == held
    assert all(r.rejected for r in got if r.held_out) and not any(r.rejected for r in got if not r.held_out)


def test_language_of_odd_tables(spark, empty):
    assert language_id.identify(empty).collect() == []
    df = spark.createDataFrame([(1, "no label here", None), (None, None, "en"), (2, "12", "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in language_id.identify(df).collect()} == {(1, "und", 0.0, True), (None, "und", 0.0, True), (2, "und", 0.0, True)}


# --- op12 -------------------------------------------------------------------------------

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if abs(len(o) - len(w)) < 2 and o != w and near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[w] = [w, form, w, n, len(others), counts[form] if form else None]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return Counter(map(tuple, out.values()))


@pytest.mark.parametrize("block", [2048, 2])
def test_variants_of_dense_words(spark, block):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 8))): int(rng.integers(1, 40)) for _ in range(700)}
    words.update({"x" * 300: 4, "x" * 301: 9, "x" * 150 + "y" + "x" * 149: 20, "é" * 5: 2, "aaaa": 7})
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), block=block)
    assert Counter(map(tuple, got.collect())) == brute_variants(words)


def test_variants_hot_key_is_split(spark):
    """A third of all words under one key: no key keeps more than the block."""
    words = [("anfang" + a + b + c, 3) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"] + [(f"{x}wort{y}", 3) for x in "abcdefghij" for y in "klmnop"]
    df = spark.createDataFrame(words, "word string, n long")
    rows = spelling.sharded(df, 64)
    assert max(r["count"] for r in rows.where("hi - lo > 1").groupBy("key").count().collect()) <= 64
    assert Counter(map(tuple, spelling.variants(df, block=64).collect())) == brute_variants(dict(words))


def test_words_and_variants_of_corpus(corpus, rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert dict(map(tuple, spelling.corpus_words(corpus).collect())) == counts
    assert Counter(map(tuple, spelling.digest(corpus).collect())) == brute_variants(counts)


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, root string")
    assert {r.root for r in spelling.roots(links).collect()} == {"w40"}


def test_variants_of_nothing(spark, empty):
    assert spelling.digest(empty).collect() == []
    assert spelling.digest(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect() == []


# --- op13 -------------------------------------------------------------------------------

def brute_codes(rows, entries, rounds, parts=4):
    """rows of (id, label, whole numbers) of one length; a full search."""
    length = len(rows[0][2]) // parts
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[2]))
    cut = [[tuple(x[p * length:(p + 1) * length]) for p in range(parts)] for _, _, x in rows]
    books = [[c[p] for c, r in zip(cut, rows) if r[0] is not None][:entries] for p in range(parts)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for c in cut]

    for _ in range(rounds):
        for p in range(parts):
            to = assign(p)
            for j in range(len(books[p])):
                mine = [c[p] for c, t in zip(cut, to) if t[1] == j]
                if mine:
                    books[p][j] = tuple(sum(v) // len(mine) for v in zip(*mine))
    found = [assign(p) for p in range(parts)]
    text = ",".join(str(v) for b in books for e in b for v in e)
    out = [(r[0], r[1], "".join(f"{f[k][1]:02x}" for f in found), sum(f[k][0] for f in found)) for k, r in enumerate(rows)]
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in np.float32(rng.normal(0, 0.01, 8))], i % 3 or None) for i in range(60)]
    rows += [(7, rows[7][1], 1), (7, [0.5] * 8, 1), (100, None, 1), (101, [0.1] * 7 + [None], 1), (102, [nan] + [0.1] * 7, 2), (103, [0.1] * 7 + [inf], 2),
             (None, [0.01] * 8, 2), (104, [], 1), (105, [1.0] * 12, 2), (106, [1e30] * 4 + [-1e30] * 4, 5), (107, rows[3][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("x", "code", "error", "_label", "at", "label_error"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(7).checkpoint()


@pytest.mark.parametrize("entries,rounds", [(16, 4), (256, 2), (1, 1)])
def test_codes_against_full_search(vectors, entries, rounds):
    kept, other = [], []
    for r in vectors.collect():
        if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding):
            x = [math.floor(1024 * max(min(v, 16384.0), -16384.0)) for v in r.embedding]
            (kept if len(x) == 8 else other).append((r.vec_id, r.label, x))
    coded, checksum = brute_codes(kept, entries, rounds)
    sums = Counter()
    for _, label, _, error in coded:
        sums[label] += error
    want = Counter((i, c, e, sums[label], checksum) for i, label, c, e in coded)
    want.update((i, None, None, sums[label], checksum) for i, label, _ in other)
    assert Counter(map(tuple, vector_codes.digest(vectors, entries=entries, rounds=rounds).collect())) == want and len(other) == 2


def test_search_equals_full_search():
    rng = np.random.default_rng(9)
    for span in (2, 40, 1 << 24):
        x, book = rng.integers(-span, span, (500, 16)), rng.integers(-span, span, (64, 16))
        book[10], book[40], book[41] = book[3], book[3], 0
        far = ((x[:, None] - book) ** 2).sum(axis=2)
        index, best = vector_codes.nearest(x, book)
        assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()


def test_codes_stand_for_their_entries(spark):
    df = vector_codes.whole_numbers(spark.read.parquet(f"{SMALL}/embeddings.parquet")).checkpoint()
    books = vector_codes.train(df, entries=32)
    coded = vector_codes.decode(vector_codes.encode(df, books), books)
    for r in coded.join(df.select("vec_id", "x"), "vec_id").collect():
        assert sum((round(a * 1024) - b) ** 2 for a, b in zip(r.approx, r.x)) == r.error


def test_codes_of_odd_tables(spark, vectors):
    assert vector_codes.digest(vectors.limit(0)).collect() == []
    got = vector_codes.digest(vectors.where("vec_id is null")).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(None, None, None, None)]


# --- SQL --------------------------------------------------------------------------------

@pytest.mark.parametrize("key,table", [("op12_spelling_variants", "documents"), ("op13_vector_codes", "embeddings")])
def test_sql(spark, key, table):
    got = queries.QUERIES[key](spark, SMALL)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert Counter(c.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[key]})").fetchall()) == Counter(map(tuple, got.collect()))
