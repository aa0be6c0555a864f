"""Scalar text functions, all as native Spark column expressions (codegen'd, no
Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title_case(x: Column | str) -> Column:
    """Title case where every non-letter starts a new word (``o'neil`` → ``O'Neil``,
    ``3rd`` → ``3Rd``). ``initcap`` only splits on spaces, so split the lower-cased
    text into alternating letter / non-letter runs and upper-case each run's head."""
    runs = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        "")


# All characters that count as white space, Unicode ones included.
WHITESPACE = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())


def strip_ws(x: Column | str) -> Column:
    """Strip all leading/trailing whitespace (``trim`` removes spaces only). A
    character-set trim, not a regex: no per-row pattern matching."""
    return F.btrim(_c(x), F.lit(WHITESPACE))


def fmt_int(x: Column | str) -> Column:
    """``1234567`` → ``1,234,567``."""
    return F.format_number(_c(x).cast("long"), 0)


def fmt_fixed(x: Column | str, decimals: int, commas: bool = True) -> Column:
    """A value already rounded to ``decimals`` places as text (``12,345.60``)."""
    d = _c(x).cast(f"decimal(38,{decimals})")
    return F.format_number(d, decimals) if commas else d.cast("string")


def fmt_money(x: Column | str, decimals: int = 2) -> Column:
    return F.concat(F.lit("$"), fmt_fixed(x, decimals))


def fmt_plain(x: Column | str) -> Column:
    """A double as its shortest text (``25.0``, ``25.3``)."""
    return _c(x).cast("string")


def slug_id(entity_type: Column | str, name: Column | str) -> Column:
    """``condition`` + ``Heart Disease`` → ``condition_heart_disease``."""
    return F.concat(_c(entity_type), F.lit("_"), F.replace(F.lower(_c(name)), F.lit(" "), F.lit("_")))


def node_tooltip(label: Column | str, type_label: Column | str, count: Column | str) -> Column:
    return F.concat(F.lit("<b>"), _c(label), F.lit("</b><br>Type: "), _c(type_label),
                    F.lit("<br>Patients: "), fmt_int(count))


def edge_tooltip(relationship: Column | str, weight: Column | str, unit: Column | str) -> Column:
    return F.concat(_c(relationship), F.lit("<br>"), fmt_int(weight), F.lit(" "), _c(unit))


def tooltip_plain(x: Column | str) -> Column:
    """Markup → text: ``<br>`` becomes a newline, bold tags are dropped."""
    t = F.replace(_c(x), F.lit("<br>"), F.lit("\n"))
    return F.replace(F.replace(t, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit(""))
