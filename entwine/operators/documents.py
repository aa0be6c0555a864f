"""Text documents rendered from the entity profile and its distributions: one per
hub / medication / insurer entity, plus two corpus-wide insight texts.

Rendering is a column expression over a join of two aggregated tables, so it runs
on executors for any number of entities; the only global step (the insight texts)
folds the ranked hub rows, whose count is bounded by the number of hub entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded_ratio, whole_units
from ..functions.text import fmt_fixed, fmt_int, fmt_money, fmt_plain, slug_id
from ..spec import GraphSpec, HEALTHCARE
from .profile import emergency_from_dist, rank_both_ways

# The document templates' wording must equal the reference's.
CONDITION_TEMPLATE = ("Medical Condition: {name}\n\n"
                      "Affects {count} patients ({pct}% of all patients). "
                      "Average patient age: {avg_age} years. Average billing: {billing}. "
                      "Average hospital stay: {avg_stay} days.\n\n"
                      "Top medications: {top_medication}.\n"
                      "Insurance coverage: {top_insurer}.\n"
                      "Admission breakdown: {all_admission}.\n"
                      "Test results: {all_result}.\n"
                      "Gender split: {all_gender}.")
MEDICATION_TEMPLATE = ("Medication: {name}\n\n"
                       "Prescribed to {count} patients ({pct}% of all patients). "
                       "Average billing for {name} patients: {billing}.\n"
                       "Primary conditions treated: {top3_condition}.\n"
                       "Insurance breakdown: {all_insurer}.\n"
                       "Admission types: {all_admission}.\n"
                       "Test results: {all_result}.")
INSURER_TEMPLATE = ("Insurance Provider: {name}\n\n"
                    "Covers {count} patients ({pct}% of the insured population). "
                    "Average covered patient age: {avg_age} years. Average billing: {billing}.\n"
                    "Most covered conditions: {top3_condition}.\n"
                    "Most covered medications: {top3_medication}.\n"
                    "Admission types: {all_admission}.")
COST_TEMPLATE = ("Healthcare Cost Analysis by Medical Condition\n\n"
                 "Highest average billing: {top_billing}.\n"
                 "Lowest average billing: {bottom_billing}.\n"
                 "Longest average stay: {top_stay}.\n"
                 "Shortest average stay: {bottom_stay}.")
EMERGENCY_TEMPLATE = ("Emergency Admission Rates by Condition\n\n"
                      "Highest emergency rates: {top_rate}.\n"
                      "Lowest emergency rates: {bottom_rate}.")
COST_ID, COST_NAME = "insight_cost_analysis", "cost_analysis"
EMERGENCY_ID, EMERGENCY_NAME = "insight_emergency_rates", "emergency_rates"


def render(template: str, parts: dict[str, Column]) -> Column:
    """Fill ``{field}`` slots of a fixed template with column expressions."""
    import string

    out = []
    for lit, field, _, _ in string.Formatter().parse(template):
        if lit:
            out.append(F.lit(lit))
        if field is not None:
            out.append(F.coalesce(parts[field], F.lit(MISSING)))
    return F.concat(*out)


#: Written in place of a figure that is null.
MISSING = "n/a"


def total_or_default(total: Column | None, spec: GraphSpec = HEALTHCARE) -> Column:
    default = F.lit(spec.total_default).cast("long")
    return default if total is None else F.coalesce(total, default)


def _dist_map(texts: DataFrame) -> DataFrame:
    """(entity_type, entity) → map dist_column → struct(top3_patients, top3, breakdown)."""
    return (texts.groupBy("entity_type", "entity")
                 .agg(F.map_from_entries(F.collect_list(F.struct(
                     "dist_column", F.struct("top3_patients", "top3", "breakdown")))).alias("dm")))


def entity_documents(profile: DataFrame, texts: DataFrame, total: Column | None, node_type: str,
                     spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """A document for each entity of a type. Without a ``total`` (or with a null one) shares are of
    the spec's default total; a figure that no record has is written as MISSING."""
    template = {"condition": CONDITION_TEMPLATE, "medication": MEDICATION_TEMPLATE,
                "insurer": INSURER_TEMPLATE}[node_type]
    p = profile.where(F.col("entity_type") == node_type)
    d = _dist_map(texts.where(F.col("entity_type") == node_type))
    j = p.join(d, ["entity_type", "entity"], "left")

    def dist(key: str, field: str) -> Column:
        return F.coalesce(F.col("dm")[key][field], F.lit(""))

    pct = rounded_ratio(F.col("patient_count") * 100, total_or_default(total, spec), 1)
    parts = {
        "name": F.col("entity"),
        "count": fmt_int("patient_count"),
        "pct": fmt_fixed(pct, 1, commas=False),
        "avg_age": fmt_plain("avg_age"),
        "avg_stay": fmt_plain("avg_stay"),
        "billing": fmt_money("avg_billing"),
    }
    for a in spec.attributes:
        parts[f"top_{a.key}"] = dist(a.key, "top3_patients")
        parts[f"top3_{a.key}"] = dist(a.key, "top3")
        parts[f"all_{a.key}"] = dist(a.key, "breakdown")
    return j.select(slug_id(F.lit(node_type), F.col("entity")).alias("id"),
                    render(template, parts).alias("text"),
                    F.lit(node_type).alias("entity_type"),
                    F.col("entity").alias("entity_name"))


def _fold(u: DataFrame, lists: dict[str, tuple[str, str]]) -> DataFrame:
    """One-row aggregate of ranked rows (m, grp, pos, t): each output list joins the
    ``t`` of one (metric, group) in rank order with ``, ``."""
    xs = F.array_sort(F.collect_list(F.struct("m", "grp", "pos", "t")))

    def picks(m: str, g: str):
        return lambda x: (x["m"] == m) & (x["grp"] == g)

    return u.agg(*[F.array_join(F.transform(F.filter(xs, picks(m, g)), lambda x: x["t"]), ", ").alias(name)
                   for name, (m, g) in lists.items()])


def cost_insight(profile: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    hub = profile.where(F.col("entity_type") == spec.attr(spec.hub).node_type)
    whole = whole_units("avg_billing", 2)
    rb = rank_both_ways(hub.select("entity", "avg_billing"), "avg_billing").select(
        "pos", "grp", F.lit("billing").alias("m"),
        F.concat(F.col("entity"), F.lit(" ("), fmt_money(whole, 0), F.lit(")")).alias("t"))
    rs = rank_both_ways(hub.select("entity", "avg_stay"), "avg_stay").select(
        "pos", "grp", F.lit("stay").alias("m"),
        F.concat(F.col("entity"), F.lit(" ("), fmt_plain("avg_stay"), F.lit(" days)")).alias("t"))
    a = _fold(rb.unionByName(rs), {"top_billing": ("billing", "top"), "bottom_billing": ("billing", "bottom"),
                                   "top_stay": ("stay", "top"), "bottom_stay": ("stay", "bottom")})
    parts = {k: F.col(k) for k in ("top_billing", "bottom_billing", "top_stay", "bottom_stay")}
    return a.select(F.lit(COST_ID).alias("id"), render(COST_TEMPLATE, parts).alias("text"),
                    F.lit("insight").alias("entity_type"), F.lit(COST_NAME).alias("entity_name"))


def emergency_insight(profile: DataFrame, dist: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    e = emergency_from_dist(profile, dist, spec)
    e = e.withColumn("exact_rate", F.col("emergency_count") / F.col("patient_count"))
    r = rank_both_ways(e.select("entity", "emergency_rate", "exact_rate"), "exact_rate")
    r = r.select("pos", "grp", F.lit("rate").alias("m"),
                 F.concat(F.col("entity"), F.lit(" ("), fmt_fixed("emergency_rate", 1, commas=False),
                          F.lit("%)")).alias("t"))
    a = _fold(r, {"top_rate": ("rate", "top"), "bottom_rate": ("rate", "bottom")})
    return a.select(F.lit(EMERGENCY_ID).alias("id"),
                    render(EMERGENCY_TEMPLATE, {"top_rate": F.col("top_rate"),
                                                "bottom_rate": F.col("bottom_rate")}).alias("text"),
                    F.lit("insight").alias("entity_type"), F.lit(EMERGENCY_NAME).alias("entity_name"))


def rag_documents(profile: DataFrame, texts: DataFrame, dist: DataFrame, total: Column | None,
                  spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """All documents: id, text, entity_type, entity_name."""
    parts = [entity_documents(profile, texts, total, t, spec) for t in ("condition", "medication", "insurer")]
    parts += [cost_insight(profile, spec), emergency_insight(profile, dist, spec)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
