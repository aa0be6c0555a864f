"""Licence scan: a trained paragraph classifier whose finds a template must confirm.

Method: a softmax regression over sparse word unigrams and bigrams tells licence families
and ``unknown`` apart. It is trained on the driver on a bounded set: noisy copies of the templates
below for the families; for ``unknown`` near misses (other licences, other versions, denials such
as "not licensed under ..."), template words in no order, and at most ``BACKGROUND`` paragraphs of
the corpus (those of the documents whose ids have the least hashes). Its vocabulary is the grams of
templates and near misses and the ``FREQUENT`` commonest grams of the corpus paragraphs. A temperature
fitted on held-out examples calibrates the probabilities.

The classifier looks first: it scores windows of ``SCALES`` words all over a paragraph, and a paragraph
whose windows are all unknown (or under ``MIN_PROBABILITY``) is done. Templates then confirm the
families found: a run of words as long as a template must hold ``MIN_SHARE`` of its bigrams and, within
``SLACK`` words, all its telling words (names and version numbers). Last, the classifier judges the run
with the words around it; its likeliest class, ``unknown`` among them, must be a family that was
confirmed there. Every paragraph of every document is looked through; one without any key word of a
template can't hold that share, so it needs no score.

Defined results: words are runs of letters and digits, in lower case. A paragraph is
consecutive lines with a word beside signs of comments, so notices may be wrapped; a
notice's span is that of the lines it covers. ``n_paragraphs`` counts lines with a word.
A null or blank text has none. Every row is scanned by itself, so repeated rows
repeat their result. Spans are code points, end exclusive. Without background
paragraphs (empty table) the model is trained on made-up ones of template words.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# The wording of common licence notices, a sentence each.
TEMPLATES = {
    "MIT": ["MIT License", "Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at",
                   "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
                "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
                "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.",
             "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
             "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
             "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD": ["Released under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.",
            "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.",
                    "No part of this publication may be reproduced or distributed without the prior written permission of the publisher."],
}
# Notices of licences that are none of these families, and what denies a notice.
NEAR_MISSES = [
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "This work is licensed under the GNU General Public License, version 1.",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or any later version",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Licensed under the Eclipse Public License.", "SPDX-License-Identifier: EPL-2.0",
    "This work is licensed under the European Union Public License, version 1.2.",
    "Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License.",
    "Released under the Zlib License.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: ISC", "Released under the ISC License.",
    "Licensed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
    "Licensed under the Educational Community License, Version 2.0.", "Licensed under the Academic Free License, version 3.0.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "SPDX-License-Identifier: MPL-1.1",
    "Licensed under CC BY 3.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "not all rights reserved",
]
DENIALS_BEFORE = ["not", "no longer", "never", "neither"]
DENIALS_AFTER = ["does not apply", "no longer applies"]
# The words that name a licence; its version numbers tell it apart as well.
NAMES = frozenset("apache attribution bsd cc cc0 commons creative general gnu gpl lesser lgpl mit mozilla mpl nc noncommercial public "
                  "reserved sa sharealike unencumbered".split())
FAMILIES = ["unknown", *TEMPLATES]
COMMON = frozenset("a an and any are as at be by for from in is it may no not of on or out part that the this to under use with work you".split())

#: Bounds of the training set: corpus paragraphs, and made copies of each template.
BACKGROUND, COPIES, NEAR_COPIES, FREQUENT = 4000, 60, 30, 400
MIN_PROBABILITY, MIN_SHARE = 0.5, 0.6
#: Window lengths that the classifier scores, words around a run where telling words may lie,
#: and words before and behind a run that it judges with the run.
SCALES, SLACK, BEFORE, BEHIND = (4, 8, 16, 32), 4, 3, 3
WORD = re.compile(r"[^\W_]+")
#: What opens a line of a comment.
PREFIX = re.compile(r"\s*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|(?:rem|dnl)\b)\s*", re.I)


def words(line: str) -> list[str]:
    return WORD.findall(line.lower())


def ngrams(ws: list[str]) -> list[str]:
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def telling(ws: list[str]) -> frozenset[str]:
    """The words that name a licence or its version."""
    return frozenset(w for w in ws if w in NAMES or w.isdigit())


BIGRAMS = {f: [frozenset(zip(w, w[1:])) for w in map(words, ts)] for f, ts in TEMPLATES.items()}
#: (family, bigrams, words, telling words) of each template, and the templates that hold a bigram.
FORMS = [(f, frozenset(zip(w, w[1:])), len(w), telling(w)) for f, ts in TEMPLATES.items() for w in map(words, ts)]
TEMPLATES_OF = {g: [t for t, form in enumerate(FORMS) if g in form[1]] for g in {g for form in FORMS for g in form[1]}}
KEYS = frozenset(w for ts in TEMPLATES.values() for t in ts for w in words(t)) - COMMON


def share(ws: list[str], family: str) -> float:
    """The largest share of a template's bigrams that the words hold."""
    own = set(zip(ws, ws[1:]))
    return max(len(own & t) / len(t) for t in BIGRAMS[family])


class Model:
    """Vocabulary, weights (grams x families), bias and temperature."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.vocabulary, self.weights, self.bias, self.temperature = vocabulary, weights, bias, temperature

    def logits(self, ws: list[str]) -> np.ndarray:
        at = [i for g in ngrams(ws) if (i := self.vocabulary.get(g)) is not None]
        return self.bias + (self.weights[at].sum(0) / np.sqrt(len(at)) if at else 0)

    def predict(self, ws: list[str]) -> tuple[str, float]:
        """The likeliest class, ``unknown`` among them, and its probability."""
        z = self.logits(ws) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return FAMILIES[k], float(p[k] / p.sum())

    def families(self, ws: list[str]) -> frozenset[str]:
        """Families that are the likeliest class of some window of ``SCALES`` words (the whole, if
        shorter), by sums over the words' weights up to each place."""
        n, v = len(ws), self.vocabulary
        ones = [v.get(w, -1) for w in ws]
        twos = [v.get(f"{a} {b}", -1) if x >= 0 and y >= 0 else -1 for a, b, x, y in zip(ws, ws[1:], ones, ones[1:])]
        one, two = (np.array(x, dtype=np.int64) for x in (ones, twos))
        sums = [np.concatenate([np.zeros((1, len(FAMILIES))), np.cumsum(np.where((x >= 0)[:, None], self.weights[x], 0.0), 0)]) for x in (one, two)]
        known = [np.concatenate([[0], np.cumsum(x >= 0)]) for x in (one, two)]
        found: set[int] = set()
        for scale in SCALES:
            a = np.arange(0, max(n - scale, 0) + max(scale // 2, 1), max(scale // 2, 1))
            a = np.unique(np.minimum(a, max(n - scale, 0)))
            b = np.minimum(a + scale, n)
            m = known[0][b] - known[0][a] + known[1][b - 1] - known[1][a]
            z = (self.bias + (sums[0][b] - sums[0][a] + sums[1][b - 1] - sums[1][a]) / np.sqrt(np.maximum(m, 1))[:, None]) / self.temperature
            best = z.argmax(1)
            top = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
            found |= set(best[(best > 0) & (top >= MIN_PROBABILITY)].tolist())
            if scale >= n:
                break
        return frozenset(FAMILIES[k] for k in found)


def background(docs: DataFrame, most: int = BACKGROUND) -> list[list[str]]:
    """At most ``most`` paragraphs of the corpus that no template claims. A bound on the hash
    lets about four times the documents wanted pass, so that tasks send few texts on."""
    n, rows, h = max(most // 8, 1), max(docs.count(), 1), F.xxhash64("doc_id")
    bound = min(-(1 << 63) + (1 << 64) * 4 * n // rows, (1 << 63) - 1)
    lines = (docs.where(F.col("text").isNotNull() & (h <= F.lit(bound))).orderBy(h, "doc_id", "text").limit(n)
             .select(F.explode_outer(F.split("text", "\n")).alias("line")).where(F.length(F.btrim("line")) > 0).limit(most).collect())
    found = [words(r.line) for r in lines]
    return [w for w in found if w and max(share(w, f) for f in TEMPLATES) < MIN_SHARE / 2]


def train(paragraphs: list[list[str]], copies: int = COPIES, rounds: int = 600, seed: int = 7) -> Model:
    rng, examples = random.Random(seed), []
    texts = paragraphs or [sorted(KEYS | COMMON)]
    common = sorted(COMMON - {w for d in (*DENIALS_BEFORE, *DENIALS_AFTER) for w in words(d)} - NAMES)

    def copy(ws: list[str], number: int, k: int) -> None:
        """Copies of the words without some of those that tell nothing, among other words."""
        named = telling(ws)
        for i in range(number):
            part = [w for w in ws if i == 0 or w in named or rng.random() > 0.1]
            if i % 3 == 0 and i:  # between the end of a paragraph and the start of another
                before, after = rng.choice(texts)[-rng.randrange(1, 9):], rng.choice(texts)[:rng.randrange(0, 5)]
            else:  # among common words, or one word again and again
                around = rng.choices(common if i % 3 == 1 else [rng.choice(common)], k=rng.randrange(0, 12)) if i else []
                cut = rng.randrange(len(around) + 1)
                before, after = around[:cut], around[cut:]
            examples.append((before + part + after, k))

    misses = [words(t) for t in NEAR_MISSES]
    for k, family in enumerate(FAMILIES[1:], 1):
        for ws in map(words, TEMPLATES[family]):
            copy(ws, copies, k)
            misses += [[*words(rng.choice(DENIALS_BEFORE)), *ws], [*ws, *words(rng.choice(DENIALS_AFTER))]]
            misses += [[v if w.isdigit() and w != "0" else w for w in ws] for v in ("5", "7") if any(w.isdigit() and w != "0" for w in ws)]
    misses += [[*d, *words(t)] for d in map(words, DENIALS_BEFORE) for ts in TEMPLATES.values() for t in ts if t.startswith(("Licensed", "Released"))]
    own = {g for ts in TEMPLATES.values() for t in ts for g in ngrams(words(t))} | {g for ws in misses for g in ngrams(ws)}
    for ws in misses:
        copy(ws, max(copies * NEAR_COPIES // COPIES, 1), 0)
    frequent = sorted(Counter(g for p in paragraphs for g in ngrams(p)).items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
    vocabulary = {g: i for i, g in enumerate(sorted(own | {x for g, _ in frequent for x in (g, *g.split())}))}
    scattered = [rng.sample(sorted(KEYS | COMMON), 12) for _ in range(len(examples) // 4)]  # template words in no order
    examples += [(p, 0) for p in [*paragraphs, *scattered]]
    rng.shuffle(examples)
    x, y = np.zeros((len(examples), len(vocabulary)), np.float32), np.array([k for _, k in examples])
    for i, (ws, _) in enumerate(examples):
        at = [vocabulary[g] for g in ngrams(ws) if g in vocabulary]
        np.add.at(x[i], at, 1 / np.sqrt(max(len(at), 1)))
    held = np.arange(len(y)) % 4 == 0
    a, b = x[~held], np.eye(len(FAMILIES), dtype=np.float32)[y[~held]]
    w, c = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    vw, vc = np.zeros_like(w), np.zeros_like(c)
    for _ in range(rounds):  # gradient descent with momentum
        z = a @ w + c
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - b) / len(b)
        vw, vc = 0.9 * vw - 4.0 * (a.T @ g + 1e-5 * w), 0.9 * vc - 4.0 * g.sum(0)
        w, c = w + vw, c + vc
    z, t = x[held] @ w + c, y[held]

    def loss(temperature: float) -> float:
        s = z / temperature
        m = s.max(1)
        return float((m + np.log(np.exp(s - m[:, None]).sum(1)) - s[np.arange(len(t)), t]).mean())

    return Model(vocabulary, w.astype(float), c.astype(float), min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss))


def windows(ws: list[str], wanted: frozenset[str] = frozenset(TEMPLATES)) -> list[tuple[int, int, frozenset[str]]]:
    """(first word, end, families) of the runs of words that templates of the wanted families claim:
    windows as long as a template that hold ``MIN_SHARE`` of its bigrams and, with ``SLACK`` words around,
    its telling words, the best of those that overlap; windows of several templates that overlap are one run."""
    hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for i, g in enumerate(zip(ws, ws[1:])):
        for t in TEMPLATES_OF.get(g, ()):
            if FORMS[t][0] in wanted:
                hits.setdefault(t, []).append((i, g))
    runs = []
    for t, at in hits.items():
        family, grams, length, named = FORMS[t]
        if len(at) < MIN_SHARE * len(grams):
            continue
        counts: Counter = Counter()
        j, fits = 0, []
        for i, g in at:
            while j < len(at) and at[j][0] <= i + length - 2:
                counts[at[j][1]] += 1
                j += 1
            end = at[j - 1][0] + 2
            if len(counts) >= MIN_SHARE * len(grams) and named.issubset(ws[max(i - SLACK, 0):end + SLACK]):
                fits.append((-len(counts), i, end))
            counts[g] -= 1
            if not counts[g]:
                del counts[g]
        taken: list[tuple[int, int]] = []
        for _, x, y in sorted(fits):
            k = bisect_left(taken, (x, y))
            if (not k or taken[k - 1][1] <= x) and (k == len(taken) or y <= taken[k][0]):
                taken.insert(k, (x, y))
        runs += [(x, y, family) for x, y in taken]
    out: list[tuple[int, int, frozenset[str]]] = []
    for x, y, family in sorted(runs):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y), out[-1][2] | {family})
        else:
            out.append((x, y, frozenset([family])))
    return out


def claims(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, str, float]]]:
    """Number of lines with a word, and (start, end, family, probability) of the notices: the
    lines that a notice covers."""
    if not text:
        return 0, []
    lines = text.split("\n")
    if KEYS.isdisjoint(WORD.findall(text.lower())):
        return sum(WORD.search(x) is not None for x in lines), []
    n, at, found = 0, 0, []
    ws: list[str] = []  # words of the paragraph so far
    parts: list[tuple[int, int, int]] = []  # first word, start and end of each of its lines

    def close() -> None:
        if ws and not KEYS.isdisjoint(ws):
            first = [x for x, _, _ in parts]
            wanted = model.families(ws)
            runs = windows(ws, wanted) if wanted else []
            for k, (x, y, families) in enumerate(runs):
                a = max(x - BEFORE, runs[k - 1][1] if k else 0)
                b = min(y + BEHIND, runs[k + 1][0] if k + 1 < len(runs) else len(ws))
                family, p = model.predict(ws[a:b])
                if p >= MIN_PROBABILITY and family in families:
                    found.append((parts[bisect_right(first, x) - 1][1], parts[bisect_right(first, y - 1) - 1][2], family, p))
        ws.clear()
        parts.clear()

    for line in lines:
        own = words(PREFIX.sub("", line, count=1))
        if own:
            parts.append((len(ws), at, at + len(line)))
            ws += own
        else:
            close()
        n += WORD.search(line) is not None
        at += len(line) + 1
    close()
    return n, found


def find_licenses(docs: DataFrame, most: int = BACKGROUND, copies: int = COPIES) -> DataFrame:
    """(doc_id, n_paragraphs, licenses) for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(background(docs.select("doc_id", "text"), most), copies))  # bounded by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))
        for part in pieces(batches):
            got = [claims(t.as_py(), model.value) for t in part.column(1)]
            found = [[{"start": a, "end": b, "family": f, "probability": round(p, 3)} for a, b, f, p in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(found, kind)], ["doc_id", "n_paragraphs", "licenses"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_paragraphs long, licenses array<struct<start: int, end: int, family: string, probability: double>>")


def digest(docs: DataFrame) -> DataFrame:
    found = find_licenses(docs)
    return found.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licensed"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",").alias("families"),
                        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))
