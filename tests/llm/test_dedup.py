"""Line, substring and SimHash dedup and decontamination against brute force."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from entwine.llm import decontaminate, line_dedup, simhash_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_lines(corpus, rows):
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if i is not None and len(key) >= 10:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or first.get(lower(x.strip(SPACE)), i) >= i]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert Counter(map(tuple, line_dedup.digest(corpus).collect())) == Counter(want)
    texts = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(corpus).collect()}
    assert texts[900007] == "keep me" and texts[900001] is None
    assert line_dedup.drop_repeated_lines(corpus).columns == corpus.columns


def test_long_bitmap(spark):
    lines = [f"some line number {i}" for i in range(200)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["mine alone, really", *lines[60:140]]))], "doc_id long, text string")
    got = line_dedup.keep_bitmaps(df).collect()
    assert [(r.doc_id, r.n_dropped) for r in got] == [(2, 80)] and len(got[0].bitmap) == 2
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}[2] == "mine alone, really"


@pytest.mark.parametrize("window,kmer", [(50, 10), (6, 3)])
def test_substrings(corpus, rows, window, kmer):
    first, want = {}, []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(text or "")
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s:s + window]), i)
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s:s + window])] < i:
                gone[s:s + window] = [True] * window
        want.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    assert Counter(map(tuple, substring_dedup.digest(corpus, window, kmer).collect())) == Counter(want)
    assert any(x[2] for x in want)


def test_substring_texts(corpus):
    out = substring_dedup.drop_repeats(corpus)
    assert out.columns == corpus.columns and out.count() == corpus.count()


def fingerprint(text):
    w = [lower(x) for x in WORD.findall(text or "")]
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash(spark, rows, corpus, block):
    keep = [(i, t) for i, t in rows if t is None or len(t) < 5000]
    df = corpus.where("text is null or length(text) < 5000")
    fps = [fingerprint(t) for _, t in keep]
    arr, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(keep):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(keep))
    got = simhash_dedup.near_duplicates(df, block=block)
    assert Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()) == want


def test_links_cover_three_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(6):  # chains of three flips
            x ^= sum(1 << int(k) for k in rng.choice(62, 3, replace=False))
            fps.add(x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = {r.node: r.component for r in simhash_dedup.components(simhash_dedup.links(df, block=3)).collect()}
    assert len(comp) == len(fps) and len(set(comp.values())) == 40


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in simhash_dedup.components(edges).collect()}
    assert len(set(got[i] for i in range(301))) == 1 and got[1000] == got[1001] != got[0]


def test_decontaminate(spark, rows, corpus):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").unionByName(spark.createDataFrame(
        [(5001, None), (5002, ""), (5003, "a b c"), (5004, "A b c d e f g h i j"), (None, "a b c d e f"), (5005, "x y x y x y x y x y x y")], "item_id long, text string"))
    bench = bench.union(bench.limit(2))
    sh = lambda t: [tuple(w[i:i + 5]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 4)]
    items = {r.item_id: sh(r.text) for r in bench.collect() if r.item_id is not None and sh(r.text)}
    want = {}
    for d, t in rows:
        s = sh(t)
        for i, x in items.items():
            if d is None or not set(x) & set(s):
                continue
            best = 0
            for st in range(max(1, len(s) - len(x) + 1)):
                w = Counter(s[st:st + len(x)])
                both = sum((w & Counter(x)).values())
                best = max(best, both / (sum(w.values()) + len(x) - both))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    for bound in (1_000_000, 0):
        got = decontaminate.contaminated(corpus, bench, rows=bound).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want and len(got) == len(want)
    assert (900006, 5004) in want


@pytest.mark.parametrize("run", [line_dedup.digest, substring_dedup.digest, simhash_dedup.digest, line_dedup.drop_repeated_lines, simhash_dedup.one_of_each])
def test_empty(empty, run):
    assert run(empty).count() == 0


def test_decontaminate_between_aligned_starts(spark):
    item = [f"w{i}" for i in range(104)]
    doc = ["x0", "x1", "x2", *item[3:52], *(f"y{i}" for i in range(6)), *item[52:101], "z0", "z1", "z2"]
    around = [f"a{i}" for i in range(20)]
    two = [(1, " ".join(around + doc + around)), (2, "b c d e f g h i j"), (2, " ".join(item)), (3, " ".join(item[52:] + item[:52])), (3, "b c d e f g h i j")]
    docs = spark.createDataFrame(two, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for bound in (1_000_000, 0):
        got = {r.doc_id: (r.start, round(r.similarity, 3)) for r in decontaminate.contaminated(docs, bench, rows=bound).collect()}
        assert got == {1: (23, 0.818), 2: (0, 1.0), 3: (0, 0.923)}


def test_decontaminate_radius():
    """Random bags of weighted Jaccard similarity 0.8 or little more stay within the radius."""
    rng = np.random.default_rng(3)
    lost = pairs = 0
    for n in (9, 18, 45, 90):
        bits = rng.integers(0, 2, (3000, n + n // 9, 64), dtype=np.int8)
        a, b = (2 * bits[:, x:x + n].sum(1, dtype=np.int16) > n for x in (0, n // 9))  # n * 8 / 9 in common
        lost, pairs = lost + int(((a != b).sum(1) > decontaminate.RADIUS).sum()), pairs + 3000
    assert lost == 0 and pairs == 12000


def test_empty_benchmark(spark, corpus, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(corpus, none).count() == 0
    assert decontaminate.contaminated(empty, none).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_that_repeat_an_id_with_other_texts(spark, parts):
    """No row is judged by the positions of another row of its id."""
    shared, other = " ".join(f"s{i}" for i in range(60)), " ".join(f"o{i}" for i in range(120))
    df = spark.createDataFrame([(1, shared), (2, shared), (2, "short"), (3, other), (2, "short")], "doc_id long, text string").repartition(parts)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digest(df).collect())
    assert got == Counter({(1, 60, 0): 1, (2, 60, 60): 1, (2, 1, 0): 2, (3, 120, 0): 1})
    assert Counter(r.text for r in substring_dedup.drop_repeats(df).collect()) == Counter([shared, "", "short", "short", other])
    df = spark.createDataFrame([(1, "a line that many share\nmine"), (2, "a line that many share\nb"), (2, "unique first line!\nc"), (2, None)],
                               "doc_id long, text string").repartition(parts)
    assert Counter((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(df).collect()) == Counter(
        [(1, "a line that many share\nmine"), (2, "b"), (2, "unique first line!\nc"), (2, None)])
    words = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, words, "x"), (1, words, "x"), (2, words, "y"), (2, "entirely other words are in this row", "z"), (None, words, "n"),
                                (None, words, "n")], "doc_id long, text string, t string").repartition(parts)
    assert Counter(map(tuple, simhash_dedup.one_of_each(df).collect())) == Counter(
        [(1, words, "x"), (2, "entirely other words are in this row", "z"), (None, words, "n"), (None, words, "n")])


def test_decontaminate_long_repetitive_text(spark):
    """200,000 words of period two and three: every start is a window of one of a few kinds."""
    item = " ".join(["x y"] * 50)
    docs = spark.createDataFrame([(1, " ".join(["x y"] * 100_000)), (2, " ".join(["x y z"] * 60_000)), (3, "x y " * 20), (4, "p q " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([("b", item)], "item_id string, text string")
    windows = decontaminate.windows_of(docs, decontaminate.items_of(bench))
    assert windows.groupBy("doc_id").count().where("doc_id = 1").first()["count"] <= 2
    got = {r.doc_id: (r.start, r.similarity) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: (0, 1.0), 4: (2, 1.0)}
