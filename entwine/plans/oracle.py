"""DuckDB oracle SQL, one statement per registered key, over the pre-registered
views of the given tables. Written independently of the Spark code."""

from __future__ import annotations

from .sqlparts import (CLEAN, SPEC, VISITS, ctes, exact, fmt_fixed, fmt_int, rr, strip, title, units)

ORACLE: dict[str, str] = {}

LINE_KEY = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
            "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
LINE_KEY_DESC = ", ".join(f"{c.strip()} DESC" for c in LINE_KEY.split(","))
W = f"WITH {VISITS}"
WC = f"WITH {VISITS},\n{CLEAN}"
HUB = SPEC.attr(SPEC.hub).column
CATS = [a.column for a in SPEC.attributes]


def hu(num: str, den: str) -> str:
    return f"(sign(({num})::HUGEINT) * ((2 * abs(({num})::HUGEINT) + ({den})) // (2 * ({den}))))"


# ---------------------------------------------------------------- 2.1 sources
ORACLE["scan_visits"] = f"{W} SELECT * FROM visits"
ORACLE["scan_sample"] = (f"{W} SELECT name, age, medical_condition, medication, insurance_provider, "
                         f"admission_type, test_results, blood_type FROM visits ORDER BY {LINE_KEY} LIMIT 6")

# ---------------------------------------------------------------- 2.2 cleaning
ORACLE["clean_title_case"] = (f"{W} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, name, "
                              f"{title('name')} AS name_title, {title('doctor')} AS doctor_title FROM visits")
ORACLE["clean_dates"] = f"{W} SELECT {LINE_KEY}, date_of_admission, discharge_date FROM visits"
ORACLE["clean_dates_audit"] = f"{W} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(TRY_CAST({c}::VARCHAR AS TIMESTAMP)) AS n_dates, count(*) FILTER ({c} IS NULL) AS n_null, "
    f"count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c}::VARCHAR AS TIMESTAMP) IS NULL) AS n_rejected FROM visits"
    for c in ("date_of_admission", "discharge_date"))
ORACLE["clean_length_of_stay"] = f"{WC} SELECT {LINE_KEY}, length_of_stay FROM clean"
ORACLE["clean_strip"] = f"{W} SELECT {LINE_KEY}, " + ", ".join(f"{strip(c)} AS {c}" for c in CATS) + " FROM visits"
ORACLE["clean_visits"] = f"{WC} SELECT * FROM clean"
ORACLE["clean_quality_log"] = (f"{WC} SELECT count(*) AS n_records, "
                               f"{rr('sum(length_of_stay)', 'count(*)', 1)} AS avg_stay FROM clean")
ORACLE["slug_id"] = (f"{ctes('profile')} SELECT entity_type, entity, "
                     f"entity_type || '_' || replace(lower(entity), ' ', '_') AS id FROM profile")
_PCT = rr("patient_count * 100", "(SELECT count(*) FROM clean)", 1)
ORACLE["pct_of_total"] = f"{ctes('profile')} SELECT entity_type, entity, patient_count, {_PCT} AS pct FROM profile"
ORACLE["number_format"] = f"""{ctes('profile')}
SELECT entity_type, entity, {fmt_int('patient_count')} AS count_text,
  coalesce('$' || {fmt_fixed('avg_billing', 2)}, '') AS billing_text,
  ({_PCT})::DECIMAL(38,1)::VARCHAR || '%' AS pct_text,
  coalesce('$' || {fmt_fixed(hu(units('avg_billing', 2), '100') + '::DOUBLE', 0)}, '') AS billing_whole_text
FROM profile"""
ORACLE["stats_display"] = f"""{ctes('profile')}
SELECT entity AS entity_name, entity_type, {fmt_int('patient_count')} AS patient_count,
  coalesce('$' || {fmt_fixed('avg_billing', 2)}, '—') AS avg_billing,
  coalesce(avg_age::DECIMAL(38,1)::VARCHAR, '—') AS avg_age,
  coalesce(avg_stay::DECIMAL(38,1)::VARCHAR, '—') AS avg_stay
FROM profile"""

# ---------------------------------------------------------------- 2.3 filters
ORACLE["filter_entity_equality"] = (f"{WC} SELECT {HUB} AS entity, count(*) AS n_rows, "
                                    f"{hu('sum(' + exact('billing_amount') + ')', '10000000000')}::BIGINT AS billing_cents "
                                    f"FROM clean WHERE {HUB} IS NOT NULL GROUP BY 1")
ORACLE["filter_stats_by_type"] = f"""{ctes('profile')},
sel AS (SELECT DISTINCT entity_type AS selected FROM profile UNION ALL SELECT 'All')
SELECT selected, entity AS entity_name, entity_type, patient_count
FROM profile JOIN sel ON selected = 'All' OR selected = entity_type"""

# ---------------------------------------------------------------- 2.4 aggregations
ORACLE["total_records"] = f"{WC} SELECT count(*) AS total_records FROM clean"
ORACLE["distinct_entities"] = f"{WC} " + " UNION ".join(
    f"SELECT '{a.node_type}' AS entity_type, {a.column} AS entity FROM clean WHERE {a.column} IS NOT NULL"
    for a in SPEC.node_attrs)
ORACLE["distinct_types_sorted"] = f"""{ctes('profile')}
SELECT 0::BIGINT AS pos, 'All' AS entity_type
UNION ALL
SELECT row_number() OVER (ORDER BY entity_type) AS pos, entity_type
FROM (SELECT DISTINCT entity_type FROM profile WHERE entity_type IS NOT NULL)"""


def _summary_sql(node_type: str) -> str:
    a = [x for x in SPEC.node_attrs if x.node_type == node_type][0]
    cols = ["p.entity", "p.patient_count"] + [f"p.avg_{m}" for m in a.metrics]
    cols += [f"coalesce(max(CASE WHEN t.dist_column = '{d}' THEN t.dist END), '') AS {d}_dist" for d in a.dists]
    return (f"{ctes('profile', 'texts')} SELECT {', '.join(cols)} FROM profile p "
            f"LEFT JOIN texts t ON t.entity_type = p.entity_type AND t.entity = p.entity "
            f"WHERE p.entity_type = '{node_type}' GROUP BY ALL")


for _k, _t in [("summary_conditions", "condition"), ("summary_medications", "medication"),
               ("summary_insurers", "insurer"), ("summary_blood_types", "blood_type"),
               ("summary_admission_types", "admission_type"), ("summary_test_results", "test_result")]:
    ORACLE[_k] = _summary_sql(_t)

ORACLE["entity_profile"] = f"{ctes('profile')} SELECT * FROM profile"
ORACLE["value_distribution"] = f"{ctes('dist')} SELECT * FROM dist"
ORACLE["distribution_map"] = f"{ctes('texts')} SELECT entity_type, entity, dist_column, dist FROM texts"
ORACLE["summary_counts"] = f"{ctes('profile')} SELECT entity_type, count(*) AS n_entities FROM profile GROUP BY 1"
_ADM = [a for a in SPEC.attributes if a.node_type == "admission_type"][0].column
ORACLE["emergency_rate"] = f"""{WC}
SELECT entity, patient_count, emergency_count, {rr('emergency_count * 100', 'patient_count', 1)} AS emergency_rate
FROM (SELECT {HUB} AS entity, count(*) AS patient_count,
             count(*) FILTER (WHERE {_ADM} = '{SPEC.emergency_value}') AS emergency_count
      FROM clean WHERE {HUB} IS NOT NULL GROUP BY 1)"""

# ---------------------------------------------------------------- 2.5 sort / top-k
ORACLE["stats_sorted"] = f"""{ctes('profile')}
SELECT entity AS entity_name, entity_type, patient_count, avg_billing, avg_age, avg_stay,
  row_number() OVER (ORDER BY patient_count DESC, entity_type, entity) AS pos FROM profile"""
ORACLE["recent_batch"] = (f"{WC} SELECT {LINE_KEY}, date_of_admission FROM clean "
                          f"ORDER BY date_of_admission DESC, {LINE_KEY_DESC} LIMIT {SPEC.update_batch_size}")
ORACLE["topk_blood_types"] = (f"{ctes('dist')} SELECT entity AS condition, value AS blood_type, n, rank FROM dist "
                              f"WHERE entity_type = 'condition' AND dist_column = 'blood_type' AND rank <= 4")
ORACLE["topk_distribution"] = f"{ctes('dist')} SELECT * FROM dist WHERE rank <= 3"


def _rank_sql(base: str, cols: str, order: str) -> str:
    return f"""{base},
r AS (SELECT {cols}, row_number() OVER (ORDER BY {order}) AS pos FROM src)
SELECT *, 'top' AS grp FROM r WHERE pos <= 3
UNION ALL
SELECT *, 'bottom' AS grp FROM r WHERE pos > (SELECT count(*) FROM r) - 3"""


_COND = "src AS (SELECT * FROM profile WHERE entity_type = 'condition')"
ORACLE["rank_cost"] = _rank_sql(f"{ctes('profile')}, {_COND}", "entity, avg_billing", "avg_billing DESC, entity")
ORACLE["rank_stay"] = _rank_sql(f"{ctes('profile')}, {_COND}", "entity, avg_stay", "avg_stay DESC, entity")
_EMG = f"""src AS (SELECT p.entity, p.patient_count, coalesce(d.n, 0) AS emergency_count
  FROM profile p LEFT JOIN dist d ON d.entity_type = 'condition' AND d.entity = p.entity
   AND d.dist_column = 'admission' AND d.value = '{SPEC.emergency_value}'
  WHERE p.entity_type = 'condition')"""
ORACLE["rank_emergency"] = _rank_sql(
    f"{ctes('profile', 'dist')}, {_EMG}",
    f"entity, {rr('emergency_count * 100', 'patient_count', 1)} AS emergency_rate",
    "emergency_count / patient_count DESC, entity")

# ---------------------------------------------------------------- 2.6 flatten
ORACLE["entity_stats"] = (f"{ctes('profile')} SELECT entity AS entity_name, entity_type, patient_count, "
                          f"avg_billing, avg_age, avg_stay FROM profile")


# ---------------------------------------------------------------- graph
from .sqlparts import degree_ctes, graph_ctes, plain  # noqa: E402

GR = graph_ctes()
GRD = GR + ",\n" + degree_ctes()
ORACLE["node_tooltip"] = f"{GR} SELECT id, title FROM nodes"
ORACLE["edge_tooltip"] = f"{GR} SELECT src, dst, title FROM edges"
ORACLE["tooltip_plain"] = (f"{GR} SELECT id, {plain('title')} AS tooltip FROM nodes UNION ALL "
                           f"SELECT src || '->' || dst, {plain('title')} FROM edges")
ORACLE["attr_defaults"] = f"""{GR},
ids AS (SELECT id FROM nodes UNION SELECT src FROM edges UNION SELECT dst FROM edges
  UNION SELECT 'event_type:' || event_type FROM events WHERE event_type IS NOT NULL)
SELECT ids.id, coalesce(color, '{SPEC.default_color}') AS color, coalesce(node_type, '{SPEC.default_node_type}') AS node_type,
  coalesce(count, 0)::BIGINT AS count FROM ids LEFT JOIN nodes USING (id)"""
ORACLE["color_lookup"] = f"{GR} SELECT id, node_type, color FROM nodes"
ORACLE["graph_size"] = f"{GR} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges"
ORACLE["max_edge_weight"] = f"{GR} SELECT coalesce(max(weight), 1)::BIGINT AS max_weight FROM edges"
ORACLE["graph_nodes"] = f"{GR} SELECT * FROM nodes"
for _k, _r in [("edges_treated_with", "TREATED_WITH"), ("edges_covered_by", "COVERED_BY"),
               ("edges_admitted_as", "ADMITTED_AS"), ("edges_shows_result", "SHOWS_RESULT"),
               ("edges_associated_with", "ASSOCIATED_WITH")]:
    ORACLE[_k] = f"{GR} SELECT * FROM edges WHERE relationship = '{_r}'"
ORACLE["graph_edges"] = f"{GR} SELECT * FROM edges"
ORACLE["node_degree"] = f"{GRD} SELECT id, degree FROM nd"
ORACLE["degree_centrality"] = f"{GRD} SELECT id, degree, centrality FROM cen"
ORACLE["node_radius"] = f"{GRD} SELECT id, radius FROM cen"
ORACLE["edge_width"] = f"{GRD} SELECT src AS source, dst AS target, width FROM wid"
ORACLE["graph_metadata"] = (f"{GRD} SELECT id, label AS node, coalesce(node_type, 'unknown') AS node_type, degree, "
                            f"centrality, coalesce(count, 0)::BIGINT AS patient_count FROM cen")
ORACLE["graph_payload"] = (f"{GRD} SELECT id, label, coalesce(color, '{SPEC.default_color}') AS color, radius, "
                           f"coalesce(node_type, '{SPEC.default_node_type}') AS node_type, coalesce(count, 0)::BIGINT AS count, "
                           f"{plain('coalesce(title, label)')} AS tooltip FROM cen")
_T = "coalesce(title, '')"
ORACLE["graph_payload_links"] = (f"{GRD} SELECT src AS source, dst AS target, coalesce(weight, 1)::BIGINT AS weight, width, "
                                 f"coalesce(relationship, '') AS relationship, {plain(_T)} AS tooltip FROM wid")
ORACLE["ego_network"] = f"""{GR}
SELECT id AS center, id AS member, NULL::VARCHAR AS relationship, NULL::BIGINT AS weight, true AS is_center FROM nodes
UNION ALL SELECT src, dst, relationship, weight, false FROM edges
UNION ALL SELECT dst, src, relationship, weight, false FROM edges"""


# ---------------------------------------------------------------- 2.8 incremental update
from .sqlparts import TYPE_LABEL, _case, edges_cte, nodes_cte, pairs_cte, profile_cte  # noqa: E402

_UNITS = {r.name: r.unit for r in SPEC.relations}
_TOPK = [r.name for r in SPEC.relations if r.top_k]
_TOPK_IN = ", ".join(f"'{x}'" for x in _TOPK)
BATCH = (f"batch AS (SELECT * FROM clean ORDER BY date_of_admission DESC, {LINE_KEY_DESC} "
         f"LIMIT {SPEC.update_batch_size})")
UPD = ",\n".join([ctes("profile", "pairs"), nodes_cte("profile", "nodes0"), edges_cte("pairs", "edges0"), BATCH,
                  profile_cte("batch", "profile_b"), pairs_cte("batch", "pairs_b"),
                  nodes_cte("profile_b", "nodes_b"), edges_cte("pairs_b", "edges_b")])


def _up_nodes(base: str, batch: str) -> str:
    color = _case("coalesce(b.node_type, x.node_type)", SPEC.colors)
    tl = _case("coalesce(b.node_type, x.node_type)", TYPE_LABEL)
    cnt = "(coalesce(b.count, 0) + coalesce(x.count, 0))"
    return f"""SELECT coalesce(b.id, x.id) AS id, coalesce(b.label, x.label) AS label,
  coalesce(b.node_type, x.node_type) AS node_type, coalesce(b.color, {color}, '{SPEC.default_color}') AS color,
  {cnt}::BIGINT AS count,
  CASE WHEN x.id IS NULL THEN b.title ELSE '<b>' || coalesce(b.label, x.label) || '</b><br>Type: ' || {tl}
       || '<br>Patients: ' || {fmt_int(cnt)} END AS title,
  CASE WHEN b.id IS NULL THEN 'new' WHEN x.id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS status
FROM {base} b FULL OUTER JOIN {batch} x ON b.id = x.id"""


def _up_edges(base: str, batch: str) -> str:
    rel = "coalesce(b.relationship, x.relationship)"
    w = "(coalesce(b.weight, 0) + coalesce(x.weight, 0))"
    unit = _case(rel, _UNITS, "'patients'")
    return f"""SELECT coalesce(b.src, x.src) AS src, coalesce(b.dst, x.dst) AS dst, {rel} AS relationship,
  {w}::BIGINT AS weight,
  CASE WHEN x.src IS NULL THEN b.title ELSE {rel} || '<br>' || {fmt_int(w)} || ' ' || {unit} END AS title,
  CASE WHEN b.src IS NULL THEN 'new' WHEN x.src IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS status
FROM {base} b FULL OUTER JOIN {batch} x ON b.src = x.src AND b.dst = x.dst"""


ORACLE["update_batch_nodes"] = f"{UPD} SELECT entity_type, entity, patient_count FROM profile_b"
ORACLE["update_upsert_nodes"] = f"{UPD} {_up_nodes('nodes0', 'nodes_b')}"
ORACLE["update_upsert_edges"] = (f"{UPD}, eb AS (SELECT * FROM edges_b WHERE relationship NOT IN ({_TOPK_IN})) "
                                 f"{_up_edges('edges0', 'eb')}")
ORACLE["update_upsert_topk"] = (f"{UPD}, e0 AS (SELECT * FROM edges0 WHERE relationship IN ({_TOPK_IN})), "
                                f"eb AS (SELECT * FROM edges_b WHERE relationship IN ({_TOPK_IN})) "
                                f"{_up_edges('e0', 'eb')}")
UPD2 = f"{UPD},\nnodes AS ({_up_nodes('nodes0', 'nodes_b')}),\nedges AS ({_up_edges('edges0', 'edges_b')})"
ORACLE["update_report"] = f"""{UPD2}
SELECT 'nodes' AS kind, count(*) FILTER (WHERE status = 'new') AS n_new,
  count(*) FILTER (WHERE status = 'updated') AS n_updated, count(*) AS n_total FROM nodes
UNION ALL
SELECT 'edges', count(*) FILTER (WHERE status = 'new'), count(*) FILTER (WHERE status = 'updated'), count(*) FROM edges"""
_ORDER = ["date_of_admission", "name", "discharge_date", *CATS, "age", "billing_amount", "length_of_stay"]
_FACTS = ", ".join(["name", "date_of_admission", "discharge_date", *CATS, "age", "billing_amount"])
ORACLE["scan_mapped"] = f"{W} SELECT {_FACTS} FROM visits WHERE year(date_of_admission) <> 1995"
ORACLE["scan_mapped_rejects"] = f"""{W} SELECT l_orderkey::VARCHAR AS length_of_stay, name AS "Name",
  billing_amount AS "Billing Amount", 'in 1995' AS "Date of Admission", 'date_of_admission' AS reasons
FROM visits WHERE year(date_of_admission) = 1995"""
_LATER = UPD.replace("  FROM visits)", "  FROM visits WHERE year(date_of_admission) <> 1995)").replace(
    BATCH, f"batch AS (SELECT * FROM clean ORDER BY {', '.join(f'{x} DESC' for x in _ORDER)} LIMIT {SPEC.update_batch_size})")
ORACLE["update_mapped"] = f"{_LATER} {_up_edges('edges0', 'edges_b')}"
ORACLE["graph_update"] = (f"{UPD2},\n{degree_ctes()} SELECT id, label AS node, coalesce(node_type, 'unknown') AS node_type, "
                          f"degree, centrality, coalesce(count, 0)::BIGINT AS patient_count FROM cen")
ORACLE["stream_graph_update"] = ("SELECT 'user:' || user_id::VARCHAR AS src, 'event_type:' || event_type AS dst, "
                                 "'PERFORMED' AS relationship, count(*) AS weight FROM events "
                                 "WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
ORACLE["stream_graph_nodes"] = ("SELECT 'user:' || user_id::VARCHAR AS id, 'user' AS node_type, count(*) AS count FROM events WHERE user_id IS NOT NULL GROUP BY ALL "
                                "UNION ALL SELECT 'event_type:' || event_type, 'event_type', count(*) FROM events WHERE event_type IS NOT NULL GROUP BY ALL")


# ---------------------------------------------------------------- 2.10 documents
from ..operators.documents import (COST_ID, COST_NAME, COST_TEMPLATE, CONDITION_TEMPLATE,  # noqa: E402
                                   EMERGENCY_ID, EMERGENCY_NAME, EMERGENCY_TEMPLATE, INSURER_TEMPLATE,
                                   MEDICATION_TEMPLATE)
from .sqlparts import sql_render  # noqa: E402

_DM = ("dm AS (SELECT entity_type, entity, " + ", ".join(
    f"max(CASE WHEN dist_column = '{a.key}' THEN {f} END) AS {p}_{a.key}"
    for a in SPEC.attributes for f, p in (("top3_patients", "top"), ("top3", "top3"), ("breakdown", "all")))
    + " FROM texts GROUP BY ALL)")
_DOC_PARTS = {"name": "p.entity", "count": fmt_int("p.patient_count"),
              "pct": f"({rr('p.patient_count * 100', '(SELECT count(*) FROM clean)', 1)})::DECIMAL(38,1)::VARCHAR",
              "avg_age": "p.avg_age::VARCHAR", "avg_stay": "p.avg_stay::VARCHAR",
              "billing": "'$' || " + fmt_fixed("p.avg_billing", 2)}
for _a in SPEC.attributes:
    for _p in ("top", "top3", "all"):
        _DOC_PARTS[f"{_p}_{_a.key}"] = f"coalesce(dm.{_p}_{_a.key}, '')"


def _doc_sql(node_type: str, template: str) -> str:
    return (f"SELECT '{node_type}_' || replace(lower(p.entity), ' ', '_') AS id, "
            f"{sql_render(template, _DOC_PARTS)} AS text, '{node_type}' AS entity_type, p.entity AS entity_name "
            f"FROM profile p LEFT JOIN dm ON dm.entity_type = p.entity_type AND dm.entity = p.entity "
            f"WHERE p.entity_type = '{node_type}'")


DOCS = ctes("profile", "texts") + ",\n" + _DM
_COND_DOCS = _doc_sql("condition", CONDITION_TEMPLATE)
_MED_DOCS = _doc_sql("medication", MEDICATION_TEMPLATE)
_INS_DOCS = _doc_sql("insurer", INSURER_TEMPLATE)
_RANKS = f"""rb AS (SELECT entity, avg_billing, row_number() OVER (ORDER BY avg_billing DESC, entity) AS pos,
   count(*) OVER () AS cnt FROM profile WHERE entity_type = 'condition'),
rs AS (SELECT entity, avg_stay, row_number() OVER (ORDER BY avg_stay DESC, entity) AS pos,
   count(*) OVER () AS cnt FROM profile WHERE entity_type = 'condition'),
re AS (SELECT p.entity, {rr('coalesce(d.n, 0) * 100', 'p.patient_count', 1)} AS rate,
   row_number() OVER (ORDER BY coalesce(d.n, 0) / p.patient_count DESC, p.entity) AS pos, count(*) OVER () AS cnt
   FROM profile p LEFT JOIN dist d ON d.entity_type = 'condition' AND d.entity = p.entity
    AND d.dist_column = 'admission' AND d.value = '{SPEC.emergency_value}'
   WHERE p.entity_type = 'condition')"""


def _agg(src: str, item: str, which: str) -> str:
    cond = "pos <= 3" if which == "top" else "pos > cnt - 3"
    return f"(SELECT string_agg({item}, ', ' ORDER BY pos) FROM {src} WHERE {cond})"


_BILL_ITEM = "entity || ' ($' || " + fmt_fixed(hu(units("avg_billing", 2), "100") + "::DOUBLE", 0) + " || ')'"
_STAY_ITEM = "entity || ' (' || avg_stay::VARCHAR || ' days)'"
_RATE_ITEM = "entity || ' (' || rate::DECIMAL(38,1)::VARCHAR || '%)'"
_COST_DOC = (f"SELECT '{COST_ID}' AS id, " + sql_render(COST_TEMPLATE, {
    "top_billing": _agg("rb", _BILL_ITEM, "top"), "bottom_billing": _agg("rb", _BILL_ITEM, "bottom"),
    "top_stay": _agg("rs", _STAY_ITEM, "top"), "bottom_stay": _agg("rs", _STAY_ITEM, "bottom")})
    + f" AS text, 'insight' AS entity_type, '{COST_NAME}' AS entity_name")
_EMG_DOC = (f"SELECT '{EMERGENCY_ID}' AS id, " + sql_render(EMERGENCY_TEMPLATE, {
    "top_rate": _agg("re", _RATE_ITEM, "top"), "bottom_rate": _agg("re", _RATE_ITEM, "bottom")})
    + f" AS text, 'insight' AS entity_type, '{EMERGENCY_NAME}' AS entity_name")
DOCS_ALL = ctes("profile", "texts") + ",\n" + _DM + ",\n" + _RANKS + ",\nrag AS (" + " UNION ALL ".join(
    f"({q})" for q in (_COND_DOCS, _MED_DOCS, _INS_DOCS, _COST_DOC, _EMG_DOC)) + ")"

ORACLE["doc_conditions"] = f"{DOCS} {_COND_DOCS}"
ORACLE["doc_medications"] = f"{DOCS} {_MED_DOCS}"
ORACLE["doc_insurers"] = f"{DOCS} {_INS_DOCS}"
ORACLE["doc_insight_cost"] = f"{DOCS_ALL} {_COST_DOC}"
ORACLE["doc_insight_emergency"] = f"{DOCS_ALL} {_EMG_DOC}"
ORACLE["rag_documents"] = f"{DOCS_ALL} SELECT * FROM rag"
ORACLE["documents_union"] = f"{DOCS_ALL} SELECT id, entity_type, entity_name, length(text)::BIGINT AS n_chars FROM rag"


# ---------------------------------------------------------------- 2.11 embedding and vector search
from ..operators.requests import CONTEXT_TOOL, DEFAULT_N_RESULTS, SEARCH_TOOL, load_template  # noqa: E402
from ..operators.retrieve import SECTION_DIVIDER, UNKNOWN_ENTITY, UNKNOWN_TOOL  # noqa: E402
from ..operators.vectors import DIM, EMBEDDER_NAME  # noqa: E402


def _post(src: str, key: str, text: str) -> str:
    return (f"SELECT {key}, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIM}) AS bucket, count(*) AS n "
            f"FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS tok FROM {src}) "
            f"GROUP BY ALL")


_QS = "qs AS (SELECT conv_id || ':' || turn AS qid, conv_id, turn, text AS question FROM conversations WHERE role = 'user')"
_DIST = ("CASE WHEN qq = 0 AND dd = 0 THEN 0.0::DOUBLE WHEN qq = 0 OR dd = 0 THEN 1.0::DOUBLE "
         "ELSE 2.0::DOUBLE - 2.0::DOUBLE * dot / sqrt((qq * dd)::DOUBLE) END")


def _topk_ctes(q_src: str, q_key: str, q_text: str, k: str) -> str:
    return f"""qpost AS ({_post(q_src, q_key, q_text)}),
dpost AS ({_post('rag', 'id', 'text')}),
qn AS (SELECT s.{q_key} AS qk, coalesce(sum(p.n * p.n), 0)::BIGINT AS qq FROM {q_src} s LEFT JOIN qpost p USING ({q_key}) GROUP BY ALL),
dn AS (SELECT r.id, coalesce(sum(p.n * p.n), 0)::BIGINT AS dd FROM rag r LEFT JOIN dpost p USING (id) GROUP BY ALL),
dots AS (SELECT q.{q_key} AS qk, d.id, sum(q.n * d.n) AS dot FROM qpost q JOIN dpost d USING (bucket) GROUP BY ALL),
scored AS (SELECT qn.qk, dn.id, coalesce(dots.dot, 0) AS dot, qq, dd FROM qn CROSS JOIN dn
           LEFT JOIN dots ON dots.qk = qn.qk AND dots.id = dn.id),
hits AS (SELECT qk AS {q_key}, row_number() OVER (PARTITION BY qk ORDER BY {_DIST}, id) AS rank, id AS doc_id,
         {_DIST} AS distance FROM scored QUALIFY rank <= {k})"""


RET = DOCS_ALL + ",\n" + _QS + ",\n" + _topk_ctes("qs", "qid", "question", "4")
ORACLE["embed_postings"] = f"{_post('documents', 'doc_id', 'text')}"
ORACLE["embed_documents"] = f"""WITH p AS ({_post('documents', 'doc_id', 'text')}), norms AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM p GROUP BY doc_id),
cells AS (SELECT i.doc_id, b.bucket, coalesce(round((p.n / norm)::FLOAT::DOUBLE * 1048576)::BIGINT, 0) AS x
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) AS i CROSS JOIN range({DIM}) AS b(bucket)
  LEFT JOIN p ON p.doc_id = i.doc_id AND p.bucket = b.bucket LEFT JOIN norms ON norms.doc_id = i.doc_id)
SELECT doc_id, string_agg(x::VARCHAR, ',' ORDER BY bucket) AS embedding FROM cells GROUP BY doc_id"""
ORACLE["documents_store"] = f"{DOCS_ALL} SELECT id, text, entity_type, entity_name FROM rag"
ORACLE["embed_collection"] = (f"{DOCS_ALL}, p AS ({_post('rag', 'id', 'text')}) SELECT id, entity_type, entity_name, {DIM}::BIGINT AS dim, "
                              f"(SELECT count(*) FROM p WHERE p.id = rag.id) AS nonzero FROM rag")
ORACLE["vector_store"] = ORACLE["embed_collection"]
ORACLE["embed_query"] = f"WITH {_QS} {_post('qs', 'qid', 'question')}"
ORACLE["embed_dimension_check"] = f"SELECT count(*) AS n_vectors, {DIM}::BIGINT AS min_dim, {DIM}::BIGINT AS max_dim FROM documents"
ORACLE["vector_topk"] = f"{RET} SELECT * FROM hits"
ORACLE["vector_topk_embeddings"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1048576)) AS v FROM embeddings),
d AS (SELECT q.vec_id, e.vec_id AS neighbour_id, list_inner_product(q.v, q.v) + list_inner_product(e.v, e.v) - 2 * list_inner_product(q.v, e.v) AS far
  FROM e AS q, e WHERE q.vec_id % 50 = 0)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY far, neighbour_id) AS rank, neighbour_id, far / 1048576.0::DOUBLE / 1048576.0::DOUBLE AS distance
FROM d QUALIFY rank <= 10"""
ORACLE["vector_lookup_metadata"] = (f"{RET} SELECT qid, rank, doc_id, coalesce(entity_name, '{UNKNOWN_ENTITY}') AS entity, "
                                    f"length(text)::BIGINT AS n_chars FROM hits LEFT JOIN rag ON rag.id = hits.doc_id")

# ---------------------------------------------------------------- 2.12 graph-enriched retrieval


def _num_case(col: str, mapping: dict, default: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {default} END)"


_TYPE_RANK = _num_case("node_type", {a.node_type: i for i, a in enumerate(SPEC.node_attrs)}, len(SPEC.node_attrs))
_REL_ORDER = _num_case("relationship", {r.name: i for i, r in enumerate(SPEC.relations)}, len(SPEC.relations))
GRAPH_RET = f"""nodes_r AS (SELECT id, label, {_TYPE_RANK}::INT AS type_rank FROM nodes),
nb AS (SELECT src AS id, dst AS other, relationship, weight FROM edges UNION ALL SELECT dst, src, relationship, weight FROM edges),
nbl AS (SELECT nb.id, nb.other AS neighbour_id, coalesce(n.label, nb.other) AS neighbour,
        coalesce(relationship, '{SPEC.default_relationship}') AS relationship, coalesce(weight, 0)::BIGINT AS weight
        FROM nb LEFT JOIN nodes n ON n.id = nb.other),
lines AS (SELECT id, relationship, count(*) AS n_neighbours, {_REL_ORDER}::INT AS rel_order,
          '  ' || relationship || ': ' || string_agg(neighbour || ' (' || {fmt_int('weight')} || ' patients)', ', '
          ORDER BY weight DESC, neighbour) AS line FROM nbl GROUP BY id, relationship),
ctx AS (SELECT n.id, CASE WHEN count(l.line) > 0
          THEN 'Graph neighbours of ''' || n.label || ''':' || chr(10) || string_agg(l.line, chr(10) ORDER BY l.rel_order, l.relationship, l.line)
          ELSE 'Graph neighbours of ''' || n.label || ''':' END AS context
        FROM nodes n LEFT JOIN lines l USING (id) GROUP BY n.id, n.label)"""


def _resolve(names: str, name: str, keys: str) -> str:
    return (f"SELECT {keys}, n.id AS resolved_id, n.label AS resolved_label FROM {names} s LEFT JOIN nodes_r n "
            f"ON n.label = s.{name} OR (length(s.{name}) > 0 AND contains(lower(n.label), lower(s.{name}))) "
            f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN n.label = s.{name} THEN 0 ELSE 1 END, "
            f"n.type_rank, n.label) = 1")


def _context(names: str, name: str, keys: str) -> str:
    return (f"SELECT r.*, CASE WHEN r.resolved_id IS NULL THEN 'Entity ''' || r.{name} || ''' not found in graph.' "
            f"ELSE ctx.context END AS context FROM ({_resolve(names, name, keys)}) r LEFT JOIN ctx ON ctx.id = r.resolved_id")


GRET = (RET + ",\n" + nodes_cte("profile") + ",\n" + edges_cte("pairs") + ",\n" + GRAPH_RET + ",\n"
        + "dnames AS (SELECT DISTINCT entity_name FROM rag WHERE entity_name IS NOT NULL),\n"
        + f"ctxs AS ({_context('dnames', 'entity_name', 's.entity_name')})")
# the ctes() helper already defines profile/texts; pairs/dist are needed for edges
GRET = GRET.replace(ctes("profile", "texts"), ctes("profile", "texts"), 1)
_SECTION = ("'[' || coalesce(rag.entity_name, 'unknown') || ']' || chr(10) || coalesce(rag.text, '') || "
            "CASE WHEN coalesce(rag.entity_name, 'unknown') <> 'unknown' AND coalesce(ctxs.context, '') <> '' "
            "THEN chr(10) || chr(10) || ctxs.context ELSE '' END")
SECS = (f"secs AS (SELECT hits.qid, hits.rank, hits.doc_id, coalesce(rag.entity_name, '{UNKNOWN_ENTITY}') AS entity, "
        f"rag.text, {_SECTION} AS section FROM hits LEFT JOIN rag ON rag.id = hits.doc_id "
        f"LEFT JOIN ctxs ON ctxs.entity_name = rag.entity_name)")
_DIV = "'" + SECTION_DIVIDER.replace("\n", "' || chr(10) || '") + "'"

ORACLE["neighbors_1hop"] = f"{GRET} SELECT id, neighbour_id, neighbour, relationship, weight FROM nbl"
ORACLE["neighbors_by_relation"] = f"{GRET} SELECT id, relationship, n_neighbours, line FROM lines"
ORACLE["graph_context"] = f"{GRET} SELECT entity_name, resolved_id, context FROM ctxs"
ORACLE["ops_join_summary_graph"] = (f"{GRET}, dr AS ({_resolve('(SELECT id AS doc_id, entity_name FROM rag)', 'entity_name', 's.doc_id, s.entity_name')}) "
                                    f"SELECT dr.doc_id, dr.entity_name, dr.resolved_id, nbl.neighbour_id, nbl.relationship, nbl.weight "
                                    f"FROM dr LEFT JOIN nbl ON nbl.id = dr.resolved_id")
ORACLE["search_section"] = f"{GRET}, {SECS} SELECT qid, rank, doc_id, entity, section FROM secs"
ORACLE["graph_search"] = (f"{GRET}, {SECS} SELECT qid, string_agg(section, {_DIV} ORDER BY rank) AS context, "
                          f"count(*) AS n_hits FROM secs GROUP BY qid")
ORACLE["plain_search"] = (f"{GRET}, {SECS} SELECT secs.qid, string_agg(text, {_DIV} ORDER BY rank) AS context, "
                          f"'Context:' || chr(10) || string_agg(text, {_DIV} ORDER BY rank) || chr(10) || chr(10) || "
                          f"'Question: ' || any_value(qs.question) AS prompt FROM secs JOIN qs USING (qid) GROUP BY secs.qid")
ORACLE["search_compare"] = (f"{GRET}, {SECS}, agg AS (SELECT qid, count(*) AS n_hits, "
                            f"length(string_agg(text, {_DIV} ORDER BY rank))::BIGINT AS plain_chars, "
                            f"length(string_agg(section, {_DIV} ORDER BY rank))::BIGINT AS graph_chars FROM secs GROUP BY qid) "
                            f"SELECT qid, n_hits, plain_chars, graph_chars, graph_chars - plain_chars AS added_chars FROM agg")

# ---------------------------------------------------------------- 2.13 prompts, tool requests, report
_msgs = []
for _i, _m in enumerate(load_template()):
    _role = "user" if _m["role"] == "human" else _m["role"]
    _content = "'" + _m["content"].replace("'", "''") + "'"
    _msgs.append(f"SELECT qid, conv_id, turn, {_i}::BIGINT AS pos, '{_role}' AS role, "
                 f"replace({_content}, '{{question}}', question) AS content FROM qs")
ORACLE["prompt_messages"] = f"WITH {_QS} " + " UNION ALL ".join(_msgs)

#: Requests: the leftmost longest label runs of an assistant's text, or its first word.
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
REQ = f"""lab AS (SELECT array_to_string(w, ' ') AS run, len(w) AS words, min({{'r': type_rank, 'l': label, 'i': id}}) AS b
   FROM (SELECT *, {_WORDS.format('label')} AS w FROM nodes_r) WHERE len(w) > 0 GROUP BY ALL),
said AS (SELECT conv_id, turn, {_WORDS.format('text')} AS w FROM conversations WHERE role = 'assistant'),
match AS (SELECT conv_id, turn, i AS start, lab.words, lab.b.l AS label
   FROM (SELECT conv_id, turn, words, w, unnest(range(len(w) - words + 1)) AS i FROM said, (SELECT DISTINCT words FROM lab)) s
   JOIN lab ON lab.words = s.words AND lab.run = array_to_string(w[i + 1:i + s.words], ' ')),
folded AS (SELECT conv_id, turn, list_reduce(list([{{'start': start, 'stop': start + words, 'label': label}}] ORDER BY start, words DESC),
   lambda kept, m: CASE WHEN m[1].start >= kept[len(kept)].stop THEN list_concat(kept, m) ELSE kept END) AS kept FROM match GROUP BY conv_id, turn),
walk AS (SELECT conv_id, turn, k.start, k.label FROM (SELECT conv_id, turn, unnest(kept) AS k FROM folded)),
named AS (SELECT conv_id, turn, label, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(start)) - 1 AS call FROM walk GROUP BY conv_id, turn, label),
preq AS (SELECT c.conv_id AS question_id, c.turn AS pos, coalesce(n.call, 0)::BIGINT AS call,
   CASE WHEN role = 'user' THEN '{SEARCH_TOOL}' WHEN role = 'assistant' THEN '{CONTEXT_TOOL}' ELSE 'summarize_' || role END AS fn,
   CASE WHEN role = 'user' THEN text END AS query, {DEFAULT_N_RESULTS}::BIGINT AS n_results,
   CASE WHEN role = 'assistant' THEN coalesce(n.label, regexp_extract(text, '\\p{{L}}+', 0)) END AS entity_name,
   CASE WHEN role = 'user' THEN to_json({{'query': text}})::VARCHAR
        WHEN role = 'assistant' THEN to_json({{'entity_name': coalesce(n.label, regexp_extract(text, '\\p{{L}}+', 0))}})::VARCHAR ELSE '{{}}' END AS args
 FROM conversations c LEFT JOIN named n ON role = 'assistant' AND n.conv_id = c.conv_id AND n.turn = c.turn)"""
GREQ = f"{GRET}, {REQ}"
ORACLE["tool_call_parse"] = f"{GREQ} SELECT question_id, pos, call, fn, query, n_results, entity_name FROM preq"
ORACLE["entity_resolve"] = (f"{GREQ} SELECT * FROM ({_resolve('(SELECT * FROM preq WHERE fn = ' + repr(CONTEXT_TOOL) + ')', 'entity_name', 's.question_id, s.pos, s.call, s.entity_name')})")
_ROUTE = f"""sreq AS (SELECT question_id || ':' || pos AS rid, * FROM preq WHERE fn = '{SEARCH_TOOL}'),
rqpost AS ({_post('sreq', 'rid', 'query')}),
rqn AS (SELECT s.rid AS qk, coalesce(sum(p.n * p.n), 0)::BIGINT AS qq FROM sreq s LEFT JOIN rqpost p USING (rid) GROUP BY ALL),
rdots AS (SELECT q.rid AS qk, d.id, sum(q.n * d.n) AS dot FROM rqpost q JOIN dpost d USING (bucket) GROUP BY ALL),
rscored AS (SELECT rqn.qk, dn.id, coalesce(rdots.dot, 0) AS dot, qq, dd FROM rqn CROSS JOIN dn
            LEFT JOIN rdots ON rdots.qk = rqn.qk AND rdots.id = dn.id),
rhits AS (SELECT qk AS rid, row_number() OVER (PARTITION BY qk ORDER BY {_DIST}, id) AS rank, id AS doc_id FROM rscored),
rsecs AS (SELECT rhits.rid, rhits.rank, {_SECTION} AS section FROM rhits JOIN sreq USING (rid)
          LEFT JOIN rag ON rag.id = rhits.doc_id LEFT JOIN ctxs ON ctxs.entity_name = rag.entity_name
          WHERE rhits.rank <= sreq.n_results),
routed AS (
  SELECT sreq.question_id, sreq.pos, sreq.call, sreq.fn, sreq.args, coalesce(string_agg(section, {_DIV} ORDER BY rank), '') AS result
    FROM sreq LEFT JOIN rsecs USING (rid) GROUP BY ALL
  UNION ALL
  SELECT question_id, pos, call, fn, args, context FROM ({_context("(SELECT * FROM preq WHERE fn = '" + CONTEXT_TOOL + "')", 'entity_name', 's.question_id, s.pos, s.call, s.fn, s.args, s.entity_name')})
  UNION ALL
  SELECT question_id, pos, call, fn, args, '{UNKNOWN_TOOL}' || fn FROM preq WHERE fn NOT IN ('{SEARCH_TOOL}', '{CONTEXT_TOOL}'))"""
ROUTED = f"{GREQ}, {_ROUTE}"
ORACLE["tool_call_route"] = f"{ROUTED} SELECT question_id, pos, call, fn, result FROM routed"
LOG = (f"{ROUTED}, log AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY pos, call, result) AS seq, "
       f"pos, fn AS tool, args, result FROM routed)")
ORACLE["tool_call_log"] = f"{LOG} SELECT * FROM log"
#: A call belongs to the latest question at or before it, one before all questions to the first.
_OWN = """, own AS (SELECT l.question_id, l.seq, l.tool, l.args, l.result, coalesce(max(q.turn) FILTER (WHERE q.turn <= l.pos), min(q.turn)) AS turn
  FROM log l JOIN qs q ON q.conv_id = l.question_id GROUP BY ALL)"""
ORACLE["retrieval_report"] = f"""{LOG}{_OWN}
SELECT qs.conv_id AS question_id, qs.turn, qs.question, count(own.seq) AS n_tool_calls, coalesce(sum(length(own.result)), 0)::BIGINT AS context_chars,
  NULL::VARCHAR AS answer, '{EMBEDDER_NAME}' AS embedding_model, (SELECT count(*) FROM qs) AS questions_answered
FROM qs LEFT JOIN own ON own.question_id = qs.conv_id AND own.turn = qs.turn GROUP BY qs.conv_id, qs.turn, qs.question"""
ORACLE["report_json"] = f"""{LOG}{_OWN}
SELECT qs.conv_id AS question_id, qs.turn, qs.question, NULL::VARCHAR AS answer, '{EMBEDDER_NAME}' AS embedding_model, own.seq, own.tool, own.args, own.result
FROM qs LEFT JOIN own ON own.question_id = qs.conv_id AND own.turn = qs.turn"""


# ---------------------------------------------------------------- 2.1 sinks and round trips
ORACLE["csv_roundtrip_clean"] = ORACLE["clean_visits"]
ORACLE["summaries_roundtrip"] = f"{ctes('dist')} SELECT entity_type, entity, dist_column, value, n FROM dist"
ORACLE["graph_json_export"] = f"{GR} SELECT * FROM nodes"
ORACLE["graph_json_import"] = f"{GR} SELECT * FROM edges"
ORACLE["graph_json_lines"] = ORACLE["graph_json_import"]
ORACLE["graph_metadata_csv"] = ORACLE["graph_metadata"]
ORACLE["stats_table_replace"] = ORACLE["entity_stats"]
ORACLE["graph_replace_in_place"] = f"{UPD2} SELECT src, dst, relationship, weight, title FROM edges"
ORACLE["vector_ann_recall"] = """SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) * least(10, (SELECT count(*) FROM embeddings WHERE vec_id IS NOT NULL)) AS n_exact,
  true AS recall_reached"""
