"""Secret scan by assignment-aware lexing.

Method: a text is lexed into names, strings (with prefixes, escapes, three quotes,
backticks), signs, brackets and newlines, and name-literal pairs are read from the tokens:
``name = "literal"``, ``name: literal``, ``"name": "literal"``, ``name := ...``,
``export NAME=...``, ``obj.name = ...``, ``name => ...``, ``name: type = ...``,
``obj["name"] = ...``, ``name = ("one" "two")`` and ``<name>literal</name>``. Adjacent strings
are one literal. Signs that the tokens leave out, as those inside strings or beside a stray
quote, are read by a plain pattern. A pair whose right side is a name is a reference;
constants are propagated along references to a fixed point, in any order of the lines, so a
literal is scored by every name that it reaches. A literal's score is the weight of the most sensitive word
among its names' parts plus marks for length, mixed character kinds and entropy;
placeholders score nothing. Literals at ``THRESHOLD`` or more are spans of kind
``literal``. Plain patterns give the base spans, which always stay: ``assign``,
``access`` and ``hex``.

Defined results: spans are code points of the text, end exclusive, in order of start, then
kind (assign, access, hex, literal). A null or empty text has none. Every row is scanned
by itself, so repeated rows repeat their result. A literal whose span a base match covers is
not reported again.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 and more, as [0-9a-f]+ finds them
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Strings of any length, names, signs, other marks and newlines; a quote after a letter, digit or backslash opens nothing.
TOKEN = re.compile(r"""(?P<string>(?<![\w\\])(?:[rbfu]|rb|br|fr|rf)?(?:\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"(?:[^"\\\n]++|\\(?s:.))*+"|'(?:[^'\\\n]++|\\(?s:.))*+'|`(?:[^`\\]++|\\(?s:.))*+`))"""
                   r"""|(?P<name>[A-Z_$][\w$]*+(?:[.-][\w$]++)*+)|(?P<run>\w++)|(?P<sign>:=|=>|(?<![=!<>])=(?!=)|(?<!:):(?![:/]))|(?P<mark>[\[\](){},;|<>?*&+\\])|(?P<line>\n)""", re.A | re.I)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
ELEMENT = re.compile(r"<([A-Za-z_][\w:.-]*+)(?:[ \t][^<>]*+)?>[ \t\n]*+([^<>]*+)</", re.A)
#: Marks of a type between a name's colon and its ``=``, and tokens such a type may have.
TYPE, TYPE_TOKENS = frozenset("[]|<>?*&,"), 24

#: What the tokens leave out: a name, an assignment sign, and a quoted literal, a bare value or another name, of any
#: length; possessive, so that a long run is read once.
PAIR = re.compile(r"""(?<![\w.-])["']?(?P<name>[A-Za-z_][\w.-]*+)["']?[ \t]*(?P<sign>:=|=>|=(?!=)|:(?![:/]))[ \t]*"""
                  r"""(?:"(?P<dq>[^"\n]*+)"|'(?P<sq>[^'\n]*+)'|(?P<bare>[^\s"'`,;(){}\[\]<>]++))""", re.A)
NAME = re.compile(r"[A-Za-z_$][\w.]*\Z", re.A)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Weights of sensitive parts of names.
WEIGHTS = {"password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "secret": 4, "token": 3, "apikey": 4, "credential": 3,
           "credentials": 3, "private": 2, "key": 2, "auth": 2, "bearer": 3, "access": 1, "signature": 2, "salt": 2, "dsn": 2, "pin": 1}
PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|change.?me|example|sample|dummy|your[\w-]*|none|null|true|false|test|todo|<.*>|\$\{.*\}|%\(.*\)s)\Z", re.I | re.A)
THRESHOLD, MIN_LITERAL = 6, 8


def sensitivity(name: str) -> int:
    """The weight of the most sensitive parts of a name, from its words in any case."""
    return min(sum(sorted((WEIGHTS.get(p.lower(), 0) for p in PART.findall(name)), reverse=True)[:2]), 5)


def strength(literal: str) -> int:
    """0 to 5: how much a literal looks like a key rather than a word."""
    if len(literal) < MIN_LITERAL or PLACEHOLDER.match(literal) or " " in literal:
        return 0
    counts, n = Counter(literal).values(), len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    kinds = sum(bool(re.search(k, literal)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (n >= 12) + (n >= 20) + (kinds >= 2) + (kinds >= 3) + (entropy >= 3)


def body(text: str, start: int, end: int) -> tuple[int, int]:
    """The span inside a string token's prefix and quotes."""
    while text[start] not in "\"'`":
        start += 1
    n = 3 if end - start >= 6 and text[start] != "`" and text[start:start + 3] == text[start] * 3 else 1
    return start + n, end - n


def pairs(text: str) -> Iterator[tuple[str, tuple[int, int], str, bool]]:
    """(name, span, literal, whether it may be a reference)."""
    tokens = [(m.lastgroup, *m.span()) for m in TOKEN.finditer(text)]
    read = lambda k: text[tokens[k][1]:tokens[k][2]]

    def target(k: int) -> str | None:
        """The name that ends at token ``k``."""
        if k >= 0 and read(k) == "?":
            k -= 1
        if k >= 2 and read(k) == "]" and read(k - 2) == "[" and tokens[k - 1][0] in ("string", "name"):
            k -= 1
        if k < 0 or tokens[k][0] not in ("string", "name"):
            return None
        return read(k) if tokens[k][0] == "name" else text[slice(*body(text, *tokens[k][1:]))]

    def typed(k: int) -> int | None:
        """The colon whose type ends at token ``k``."""
        for j in range(k, max(k - TYPE_TOKENS, -1), -1):
            if tokens[j][0] == "sign":
                return j if read(j) == ":" and j < k else None
            if tokens[j][0] != "name" and read(j) not in TYPE:
                return None
        return None

    signs = [i for i, t in enumerate(tokens) if t[0] == "sign"]
    colons = {i: c for i in signs if read(i) == "=" and (c := typed(i - 1)) is not None and target(c - 1) is not None}
    seen, taken, done = {tokens[c][1] for c in colons.values()}, [], 0
    for i in signs:
        if tokens[i][1] < done:  # inside a bare value
            seen.add(tokens[i][1])
            continue
        if tokens[i][1] in seen or (name := target(colons.get(i, i) - 1)) is None:
            continue
        j, deep = i + 1, False
        while j < len(tokens) and (read(j) == "(" or tokens[j][0] == "line"):
            deep |= read(j) == "("
            j += 1
        after = j < len(tokens) and j > i + 1 and not deep  # on a later line
        if j < len(tokens) and tokens[j][0] == "string" and not text[tokens[j - 1][2]:tokens[j][1]].strip():
            if after and j + 1 < len(tokens) and tokens[j + 1][0] == "sign":
                continue  # the next key
            spans, k = [body(text, *tokens[j][1:])], j + 1
            while True:
                while k < len(tokens) and (read(k) in ("+", "\\") or tokens[k][0] == "line" and (deep or read(k - 1) in ("+", "\\"))):
                    k += 1
                if k == len(tokens) or tokens[k][0] != "string" or text[tokens[k - 1][2]:tokens[k][1]].strip() or k + 1 < len(tokens) and tokens[k + 1][0] == "sign":
                    break
                spans.append(body(text, *tokens[k][1:]))
                k += 1
            span, literal, plain = (spans[0][0], spans[-1][1]), "".join(text[a:b] for a, b in spans), False
        elif j == i + 1 or deep:
            at = tokens[j - 1][2]
            while at < len(text) and text[at] in " \t":
                at += 1
            if not (m := BARE.match(text, at)):
                continue
            literal, plain = m[0].rstrip("."), True
            span, done = (at, at + len(literal)), m.end()
        else:
            continue
        seen.add(tokens[i][1])
        taken.append(span)
        yield name, span, literal, plain
        if colons.get(i) == i - 2 and (inner := target(i - 1)):  # "here: name = ...", no type
            yield inner, span, literal, plain
    for m in ELEMENT.finditer(text):
        literal = m[2].rstrip()
        taken.append((m.start(2), m.start(2) + len(literal)))
        yield m[1], taken[-1], literal, False
    taken.sort()
    reach = list(accumulate((b for _, b in taken), max))
    for m in PAIR.finditer(text):
        group = m.lastgroup
        literal = m[group].rstrip(".") if group == "bare" else m[group]
        span = (m.start(group), m.start(group) + len(literal))
        i = bisect_left(taken, (span[1],))
        if m.start("sign") not in seen and (not i or reach[i - 1] <= span[0]):
            yield m["name"], span, literal, group == "bare"


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that score enough under the names they reach."""
    found = list(pairs(text))
    known = {n for name, *_ in found for n in (name, name.rpartition(".")[2])}
    holders: dict[str, set[str]] = {}  # name -> the names whose values it takes
    held: dict[tuple[int, int], tuple[str, set[str]]] = {}
    weight: dict[str, int] = {}
    for name, span, literal, plain in found:
        own = {name, name.rpartition(".")[2]}
        for n in own:
            weight[n] = max(weight.get(n, 0), sensitivity(name))
        if plain and NAME.match(literal) and literal in known and literal not in own:
            for n in own:
                holders.setdefault(n, set()).add(literal)
        else:
            held.setdefault(span, (literal, set()))[1].update(own)
    best: dict[str, int] = {}
    for name in sorted(weight, key=weight.get, reverse=True):  # the most sensitive first, so each name is settled once
        todo = [name]
        while todo:
            n = todo.pop()
            if n not in best:
                best[n] = weight[name]
                todo += holders.get(n, ())
    return [span for span, (literal, names) in held.items()
            if (w := max(best[n] for n in names)) and (good := strength(literal)) and w + good >= THRESHOLD]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text, in order."""
    if not text:
        return []
    low, found = text.lower(), []
    if any(w in low for w in NAMED):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if ("=" in text or ":" in text or "</" in text) and any(w in low for w in WEIGHTS):
        base = sorted(found)
        starts, reach = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max))
        for a, b in literals(text):
            i = bisect_right(starts, a)
            if not i or reach[i - 1] < b:
                found.append((a, b, "literal"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))



def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: spans are structs of start, end and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for part in pieces(batches):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t.as_py())] for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<start: int, end: int, kind: string>>")


def digest(docs: DataFrame) -> DataFrame:
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return find_secrets(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"),
                                     text(F.col("spans")).alias("spans"), count("literal"))
