"""Reusable DuckDB SQL fragments for the oracle queries (the independent check of
each Spark job). Kept apart from the Spark code on purpose: the two sides must be
written independently to mean anything."""

from __future__ import annotations

from ..spec import HEALTHCARE, VISIT_COLUMNS

SPEC = HEALTHCARE


def rr(num: str, den: str, dec: int, num_dec: int = 0) -> str:
    """num/den rounded half away from zero at ``dec`` places, as DOUBLE; null if den=0."""
    shift = dec - num_dec
    n = f"(({num})::HUGEINT * {10 ** shift})"
    d = f"(({den})::HUGEINT)"
    return (f"(CASE WHEN {d} > 0 THEN (sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})))::DOUBLE"
            f" / {float(10 ** dec)}::DOUBLE END)")


def units(x: str, dec: int) -> str:
    return f"round(({x}) * {10 ** dec})::HUGEINT"


def exact(x: str) -> str:
    """A number by its shortest decimal text, in units of 1e-12; NaN counts as missing."""
    return f"(CASE WHEN NOT isnan(({x})::DOUBLE) THEN (({x})::VARCHAR::DECIMAL(28,12) * 1000000000000::HUGEINT)::HUGEINT END)"


def fmt_int(x: str) -> str:
    return f"format('{{:,}}', ({x})::BIGINT)"


def fmt_fixed(x: str, dec: int) -> str:
    return f"format('{{:,.{dec}f}}', ({x})::DECIMAL(38,{dec}))"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|\\P{{L}}+)', 1),"
            f" lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')")


def strip(x: str) -> str:
    space = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+"
    return f"regexp_replace({x}, '^{space}|{space}$', '', 'g')"


_mapped = ", ".join(f"{src} AS {dst}" for dst, src in VISIT_COLUMNS.items())
_cats = [a.column for a in SPEC.attributes]

VISITS = f"""visits AS (
  SELECT {_mapped}, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

_replace = ", ".join([f"{title('name')} AS name"] + [f"{strip(c)} AS {c}" for c in _cats])
CLEAN = f"""clean AS (
  SELECT * REPLACE ({_replace}),
         floor(date_diff('second', date_of_admission, discharge_date) / 86400)::BIGINT AS length_of_stay
  FROM visits)"""

BASE = f"WITH {VISITS},\n{CLEAN}"

METRIC_COL = SPEC.metric_columns


def node_entries(src: str = "clean") -> str:
    """UNION ALL of (entity_type, entity, metric units) per node attribute."""
    parts = []
    for a in SPEC.node_attrs:
        mcols = ", ".join(f"{exact(METRIC_COL[m])} AS u_{m}" for m in ("age", "billing", "stay"))
        parts.append(f"SELECT '{a.node_type}' AS entity_type, {a.column} AS entity, {mcols} FROM {src} "
                     f"WHERE {a.column} IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


def profile_cte(src: str = "clean", name: str = "profile") -> str:
    avgs = []
    for m in ("age", "billing", "stay"):
        types = ", ".join(f"'{a.node_type}'" for a in SPEC.node_attrs if m in a.metrics)
        avgs.append(f"CASE WHEN entity_type IN ({types}) THEN "
                    f"{rr(f'sum(u_{m}) * {10 ** SPEC.metric_scale[m]}', f'(count(u_{m})::HUGEINT * 1000000000000)', 0)} / {float(10 ** SPEC.metric_scale[m])} END AS avg_{m}")
    return (f"{name} AS (SELECT entity_type, entity, count(*) AS patient_count, {', '.join(avgs)}\n"
            f"FROM ({node_entries(src)}) GROUP BY entity_type, entity)")


def pairs_cte(src: str = "clean", name: str = "pairs") -> str:
    parts = []
    for x, y in SPEC.pairs():
        cx, cy = SPEC.attr(x).column, SPEC.attr(y).column
        parts.append(f"SELECT '{x}|{y}' AS pair, {cx} AS a, {cy} AS b, count(*) AS n FROM {src} "
                     f"WHERE {cx} IS NOT NULL AND {cy} IS NOT NULL GROUP BY ALL")
    return f"{name} AS (" + "\nUNION ALL\n".join(parts) + ")"


def dist_cte() -> str:
    order = [a.key for a in SPEC.attributes]
    parts = []
    for t in SPEC.node_attrs:
        for d in t.dists:
            x, y = sorted((t.key, d), key=order.index)
            ent, val = ("a", "b") if x == t.key else ("b", "a")
            parts.append(f"SELECT '{t.node_type}' AS entity_type, {ent} AS entity, '{d}' AS dist_column, "
                         f"{val} AS value, n FROM pairs WHERE pair = '{x}|{y}'")
    return ("dist AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity, dist_column "
            "ORDER BY n DESC, value) AS rank FROM (" + "\nUNION ALL\n".join(parts) + "))")


def texts_cte() -> str:
    return f"""texts AS (
  SELECT entity_type, entity, dist_column,
    string_agg(value || ':' || n::VARCHAR, ',' ORDER BY rank) AS dist,
    string_agg(CASE WHEN rank <= 3 THEN value || ' (' || {fmt_int('n')} || ' patients)' END, ', ' ORDER BY rank) AS top3_patients,
    string_agg(CASE WHEN rank <= 3 THEN value || ' (' || {fmt_int('n')} || ')' END, ', ' ORDER BY rank) AS top3,
    string_agg(value || ': ' || {fmt_int('n')}, ', ' ORDER BY rank) AS breakdown
  FROM dist GROUP BY ALL)"""


def ctes(*names: str) -> str:
    """WITH visits, clean and the named derived CTEs (in dependency order)."""
    table = {"profile": profile_cte, "pairs": pairs_cte, "dist": dist_cte, "texts": texts_cte}
    need = []
    deps = {"dist": ["pairs"], "texts": ["pairs", "dist"]}
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in need:
                need.append(d)
    body = ",\n".join([VISITS, CLEAN] + [table[n]() for n in need])
    return "WITH " + body


def _case(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {default} END)"


TYPE_LABEL = {a.node_type: a.type_label for a in SPEC.node_attrs}


def nodes_cte(src: str = "profile", name: str = "nodes") -> str:
    color = _case("entity_type", SPEC.colors, f"'{SPEC.default_color}'")
    tl = _case("entity_type", TYPE_LABEL)
    return (f"{name} AS (SELECT entity_type || ':' || entity AS id, entity AS label, entity_type AS node_type, "
            f"{color} AS color, patient_count AS count, "
            f"'<b>' || entity || '</b><br>Type: ' || {tl} || '<br>Patients: ' || {fmt_int('patient_count')} AS title "
            f"FROM {src})")


def relation_select(rel, src: str = "pairs") -> str:
    order = [a.key for a in SPEC.attributes]
    hub = SPEC.attr(SPEC.hub)
    tgt = SPEC.attr(rel.target)
    x, y = sorted((hub.key, tgt.key), key=order.index)
    h, t = ("a", "b") if x == hub.key else ("b", "a")
    q = (f"SELECT '{hub.node_type}:' || {h} AS src, '{tgt.node_type}:' || {t} AS dst, '{rel.name}' AS relationship, "
         f"n AS weight, '{rel.name}<br>' || {fmt_int('n')} || ' {rel.unit}' AS title FROM {src} "
         f"WHERE pair = '{x}|{y}'")
    if rel.top_k:
        q += f" QUALIFY row_number() OVER (PARTITION BY {h} ORDER BY n DESC, {t}) <= {rel.top_k}"
    return q


def edges_cte(src: str = "pairs", name: str = "edges") -> str:
    return f"{name} AS (" + "\nUNION ALL\n".join(f"({relation_select(r, src)})" for r in SPEC.relations) + ")"


def degree_ctes() -> str:
    return """deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
nn AS (SELECT count(*) AS n FROM nodes),
nd AS (SELECT nodes.*, coalesce(deg.degree, 0)::BIGINT AS degree FROM nodes LEFT JOIN deg USING (id)),
cen AS (SELECT nd.*,
  CASE WHEN (SELECT n FROM nn) <= 1 THEN 1.0::DOUBLE ELSE """ + rr("degree", "(SELECT n FROM nn) - 1", 4) + """ END AS centrality,
  CASE WHEN (SELECT n FROM nn) <= 1 THEN 62.0::DOUBLE ELSE """ + rr("18 * ((SELECT n FROM nn) - 1) + 44 * degree", "(SELECT n FROM nn) - 1", 1) + """ END AS radius
  FROM nd),
mw AS (SELECT coalesce(max(weight), 1)::BIGINT AS max_weight FROM edges),
wid AS (SELECT edges.*, """ + rr("80 * (SELECT max_weight FROM mw) + 500 * coalesce(weight, 1)", "(SELECT max_weight FROM mw) * 100", 2) + """ AS width FROM edges)"""


def graph_ctes(*extra: str) -> str:
    """WITH … profile, pairs, nodes, edges (+ degree family when asked)."""
    base = ctes("profile", "pairs", *extra)
    out = base + ",\n" + nodes_cte() + ",\n" + edges_cte()
    return out


def plain(x: str) -> str:
    return f"replace(replace(replace({x}, '<br>', chr(10)), '<b>', ''), '</b>', '')"


def sql_render(template: str, parts: dict[str, str]) -> str:
    """A fixed template as a DuckDB ``||`` chain."""
    import string

    out = []
    for lit, field, _, _ in string.Formatter().parse(template):
        if lit:
            out.append("'" + lit.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        if field is not None:
            out.append(f"({parts[field]})")
    return " || ".join(out)
