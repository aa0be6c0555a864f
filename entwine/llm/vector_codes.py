"""Vector code compression: product codebooks searched by equal averages.

Method: components become whole numbers, floor(1024 * x); vectors are cut into ``PARTS``
equal parts, and each part has a codebook of ``ENTRIES`` entries, at first those of the
smallest ids. ``ROUNDS`` times every part goes to its nearest entry and every entry becomes
the floor of its parts' mean; then the parts are assigned for good. Equal-average search:
the entries are sorted by the sum of their components, and the search goes outward from a
part's own sum, a step to each side, until the squared gap of sums over the dimension is
strictly more than the best distance, which bounds the distance of all entries beyond. So it
finds the same entry as a full search, ties to the lower index included.

Each round is one pass over the written whole numbers; a task sends sums of its own parts per
entry, so what is shuffled and collected has the size of the codebooks.

Defined results: rows whose vector is null, or holds a null or non-finite component, go. Components
beyond +-2**24 after scaling count as that bound, so that an error is a long. The length of all
vectors is that of the smallest id with a positive multiple of ``PARTS``; a vector of another
length keeps its row with a null code and error. Rows without an id are coded but found no
codebook. Rows that repeat an id each count, in order of their components. With fewer rows
than entries the codebooks are that short. A label's error is null if it is beyond a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE, BOUND = 1024, 1 << 24
#: Vectors searched at once inside a task.
ROWS = 8192
#: Bytes of label text that may be broadcast.
LABEL_BYTES = 64 << 20


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, x): the kept rows, x being whole numbers."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    edge = float(BOUND) / SCALE
    return (vectors.where(F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
            .select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                    F.transform(x, lambda v: F.floor(F.least(F.greatest(v, F.lit(-edge)), F.lit(edge)) * SCALE).cast("int")).alias("x")))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest entry of ``book`` and the squared distance."""
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, entries, mine = sums[order], book[order], x.sum(axis=1)
    best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book))
    above = np.searchsorted(sums, mine)
    sides = [(np.arange(len(x)), above - 1, -1), (np.arange(len(x)), above, 1)]
    while sides:
        left = []
        for row, at, step in sides:
            inside = (at >= 0) & (at < len(sums))
            row, at = row[inside], at[inside]
            gap = (mine[row] - sums[at]).astype(float)
            # In floats, with room for their error: an entry more may be looked at, never one less.
            near = gap * gap <= best[row].astype(float) * (x.shape[1] * (1 + 1e-9))
            row, at = row[near], at[near]
            if len(row):
                apart = x[row] - entries[at]
                far = np.einsum("ij,ij->i", apart, apart)
                better = (far < best[row]) | ((far == best[row]) & (order[at] < index[row]))
                best[row[better]], index[row[better]] = far[better], order[at[better]]
                left.append((row, at + step, step))
        sides = left
    return index, best


def matrices(batches: Iterator[pa.RecordBatch], column: int, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, which of their rows have vectors of ``length``, and these as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column(column)
            fits = np.asarray(x.value_lengths()) == length
            yield part, fits, np.asarray(x.filter(pa.array(fits)).flatten()).astype(np.int64).reshape(-1, max(length, 1))


def seeds(numbers: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The first codebooks, as an array by part, entry and place; at most ``entries`` rows are collected."""
    fit = numbers.where((F.size("x") > 0) & (F.size("x") % parts == 0) & F.col("vec_id").isNotNull()).select("vec_id", "x").orderBy("vec_id", "x")
    first = fit.limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    length = len(first[0].x)
    rows = fit.where(F.size("x") == length).limit(entries).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), parts, length // parts).transpose(1, 0, 2)


def improved(numbers: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    parts, entries, width = books.shape
    sent = numbers.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, _, x in matrices(batches, 0, parts * width):
            for p in range(parts):
                mine = x[:, p * width:(p + 1) * width]
                to = nearest(mine, books[p])[0]
                for j in range(width):
                    total[p, :, j] += np.bincount(to, mine[:, j], entries).astype(np.int64)  # whole numbers below 2**53
                total[p, :, width] += np.bincount(to, minlength=entries)
        at = np.flatnonzero(total[:, :, width].repeat(width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["at", "total"])

    got = numbers.select("x").mapInArrow(run, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[[r.at for r in got]] = [r.total for r in got]
    total = total.reshape(parts, entries, width + 1)
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)


def train(numbers: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = seeds(numbers, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = improved(numbers, books)
    return books


def encode(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row of ``numbers``."""
    parts, entries, width = books.shape
    sent = numbers.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        names = np.array([f"{i:0{digits}x}" for i in range(entries)], object)
        for part, fits, x in matrices(batches, 2, parts * width if entries else -1):
            found = [nearest(x[:, p * width:(p + 1) * width], books[p]) for p in range(parts)] if len(x) else []
            codes, errors = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            if found:
                codes[fits] = sum((names[to] for to, _ in found[1:]), names[found[0][0]])
                errors[fits] = sum(far for _, far in found)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=~fits)],
                                             ["vec_id", "label", "code", "error"])

    kind = numbers.schema["label"].dataType.simpleString()
    return numbers.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with the column ``approx``: the vector that its code stands for."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    entry = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in book]) for book in books])
    pick = [F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int") for p in range(parts)]
    return coded.withColumn("approx", F.transform(F.flatten(F.array(*[F.get(F.get(entry, F.lit(p)), at) for p, at in enumerate(pick)])), lambda v: v / F.lit(float(SCALE))))


def checksum(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def digest(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    numbers = written(whole_numbers(vectors), "whole-numbers")
    books = train(numbers, parts, entries, rounds)
    coded = written(encode(numbers, books), "vector-codes")
    sums = written(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    held = sums.agg(F.sum(F.octet_length(F.col("_label").cast("string")))).first()[0] or 0
    sums = small(sums) if held <= LABEL_BYTES else sums
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(checksum(books)).alias("codebooks_sha256")))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: every part against every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT v.vec_id, v.label, v.part, v.x, min({{'far': list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x), 'entry': b.entry}}) AS hit
  FROM cut v JOIN b{r} b ON v.part = b.part GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT part, entry, list(m ORDER BY place) AS x FROM (SELECT part, hit.entry AS entry, place, floor(sum(v) / count(*)) AS m
  FROM (SELECT part, hit, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS (SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{r} u ON b.part = u.part AND b.entry = u.entry)""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
cut AS (SELECT vec_id, label, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x FROM kept, range({parts}) t(part)),
b0 AS (SELECT c.part, e.entry, c.x FROM cut c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) e ON c.vec_id = e.vec_id),
{", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', hit.entry), '' ORDER BY part) AS code, sum(hit.far)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda v: v::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM coded"""


ORACLE = oracle()
