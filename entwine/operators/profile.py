"""Entity profiling: counts, exact averages and value distributions for every entity
of every type, in one scan and one hash aggregation.

The reference filters the whole table once per entity and rescans it per
distribution (O(entities × rows)). Here each fact row is unpivoted into one row per
entity (and one per attribute pair), then a single ``groupBy`` with map-side partial
aggregation produces everything. A hot entity holding a third of all rows is
collapsed by the partial aggregate before the shuffle, so skew never reaches a
reducer as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact_column, rounded_mean, rounded_ratio
from ..spec import GraphSpec, HEALTHCARE
from .ranking import both_ends

METRICS = ("age", "billing", "stay")
NODE = "node"   # marker in the ``pair`` column for single-entity rows
ALL = "*"       # marker for the single whole-table row (n = record count)


def entity_facts(clean: DataFrame, spec: GraphSpec = HEALTHCARE,
                 nodes: bool = True, pairs: bool = True, total: bool = False) -> DataFrame:
    """One aggregate holding entity rows, attribute-pair rows and the record count.

    Schema: ``pair`` (``node``, ``*`` or ``"<a>|<b>"``), ``entity_type`` (node type
    or the pair name), ``a``, ``b`` (null unless a pair row), ``n`` and, for nodes,
    exact metric sums ``s_age``, ``s_billing``, ``s_stay`` (decimals, no value rounded)
    with the number of values summed, ``k_age`` and so on (a null or NaN is none).

    Two steps, both hash aggregates with map-side partial aggregation:
    1. group the fact rows by the full combination of categorical attributes,
       counting rows and summing metrics — its size is bounded by the product
       of the attribute cardinalities, not by the row count, so a hot value (a third
       of all rows) collapses to a handful of rows inside each map task;
    2. unpivot each combination into one row per entity and per attribute pair and
       sum again. Null labels never become entities.
    """
    values = {m: exact_column(clean, spec.metric_columns[m]) for m in METRICS}
    cats = [a.column for a in spec.attributes]
    combos = (clean.groupBy(*cats)
                   .agg(F.count(F.lit(1)).alias("c"),
                        *[F.sum(values[m]).alias(f"c_{m}") for m in METRICS],
                        *[F.count(values[m]).alias(f"d_{m}") for m in METRICS]))
    sums = [F.col(f"c_{m}").alias(f"u_{m}") for m in METRICS] + [F.col(f"d_{m}").alias(f"v_{m}") for m in METRICS]
    none = ([F.lit(None).cast(combos.schema[f"c_{m}"].dataType).alias(f"u_{m}") for m in METRICS]
            + [F.lit(None).cast("long").alias(f"v_{m}") for m in METRICS])
    entries = []
    if nodes:
        for a in spec.node_attrs:
            entries.append(F.struct(F.lit(NODE).alias("pair"), F.lit(a.node_type).alias("entity_type"),
                                    F.col(a.column).alias("a"), F.lit(None).cast("string").alias("b"),
                                    *sums))
    if pairs:
        for x, y in spec.pairs():
            ax, ay = spec.attr(x), spec.attr(y)
            entries.append(F.struct(F.lit(f"{x}|{y}").alias("pair"), F.lit(f"{x}|{y}").alias("entity_type"),
                                    F.col(ax.column).alias("a"), F.col(ay.column).alias("b"),
                                    *none))
    if total:
        entries.append(F.struct(F.lit(ALL).alias("pair"), F.lit(ALL).alias("entity_type"),
                                F.lit(ALL).alias("a"), F.lit(None).cast("string").alias("b"),
                                *none))
    e = (combos.select("c", F.inline(F.array(*entries)))
               .where(F.col("a").isNotNull() & (F.col("pair").isin(NODE, ALL) | F.col("b").isNotNull())))
    return (e.groupBy("pair", "entity_type", "a", "b")
             .agg(F.sum("c").alias("n"), *[F.sum(f"u_{m}").alias(f"s_{m}") for m in METRICS],
                  *[F.sum(f"v_{m}").alias(f"k_{m}") for m in METRICS]))


def _avg(m: str, spec: GraphSpec) -> Column:
    return rounded_mean(F.col(f"s_{m}"), F.col(f"k_{m}"), spec.metric_scale[m])


def profile_from_facts(facts: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """entity_type, entity, patient_count, avg_age, avg_billing, avg_stay; a metric
    the entity type does not report is null."""
    nodes = facts.where(F.col("pair") == NODE)
    out = [F.col("entity_type"), F.col("a").alias("entity"), F.col("n").alias("patient_count")]
    for m in METRICS:
        types = [a.node_type for a in spec.node_attrs if m in a.metrics]
        out.append(F.when(F.col("entity_type").isin(types), _avg(m, spec)).alias(f"avg_{m}"))
    return nodes.select(*out)


def entity_profile(clean: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    return profile_from_facts(entity_facts(clean, spec, nodes=True, pairs=False), spec)


def pair_counts(clean: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """pair, a, b, n for every attribute pair any distribution or edge needs."""
    f = entity_facts(clean, spec, nodes=False, pairs=True)
    return f.select("pair", "a", "b", "n")


def _dist_routes(spec: GraphSpec) -> Column:
    """Literal map: pair name → array of (entity_type, dist_column, flip) telling in
    which direction(s) a pair row serves a distribution."""
    order = [a.key for a in spec.attributes]
    routes: dict[str, list] = {}
    for t in spec.node_attrs:
        for d in t.dists:
            x, y = sorted((t.key, d), key=order.index)
            routes.setdefault(f"{x}|{y}", []).append((t.node_type, d, x != t.key))
    return F.create_map(*[x for k, v in routes.items() for x in (
        F.lit(k), F.array(*[F.struct(F.lit(et).alias("entity_type"), F.lit(dc).alias("dist_column"),
                                     F.lit(fl).alias("flip")) for et, dc, fl in v]))])


def entity_dist(pairs: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """Long-form distributions: entity_type, entity, dist_column, value, n, rank
    (rank 1 = most frequent; ties by value). One pass over ``pair_counts``: each
    pair row is routed to the distribution(s) it serves, in either direction."""
    r = pairs.select("a", "b", "n", F.explode(_dist_routes(spec)[F.col("pair")]).alias("r"))
    u = r.select(F.col("r.entity_type").alias("entity_type"),
                 F.when(F.col("r.flip"), F.col("b")).otherwise(F.col("a")).alias("entity"),
                 F.col("r.dist_column").alias("dist_column"),
                 F.when(F.col("r.flip"), F.col("a")).otherwise(F.col("b")).alias("value"), "n")
    w = Window.partitionBy("entity_type", "entity", "dist_column").orderBy(F.desc("n"), "value")
    return u.withColumn("rank", F.row_number().over(w).cast("long"))


def dist_texts(dist: DataFrame) -> DataFrame:
    """Per (entity_type, entity, dist_column) the ordered distribution as text in the
    three renderings the documents use, plus a compact ``v:n`` form.

    The list per group is bounded by the distinct values of one categorical column."""
    from ..functions.text import fmt_int

    item = F.struct(F.col("rank"), F.col("value"), F.col("n"))
    g = dist.groupBy("entity_type", "entity", "dist_column").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def render(xs, f, top=None):
        xs = F.slice(xs, 1, top) if top else xs
        return F.array_join(F.transform(xs, f), ", ")

    return g.select(
        "entity_type", "entity", "dist_column",
        F.array_join(F.transform("xs", lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",")
         .alias("dist"),
        render(F.col("xs"), lambda x: F.concat(x["value"], F.lit(" ("), fmt_int(x["n"]), F.lit(" patients)")), 3)
         .alias("top3_patients"),
        render(F.col("xs"), lambda x: F.concat(x["value"], F.lit(" ("), fmt_int(x["n"]), F.lit(")")), 3)
         .alias("top3"),
        render(F.col("xs"), lambda x: F.concat(x["value"], F.lit(": "), fmt_int(x["n"]))).alias("breakdown"),
    )


def entity_stats(profile: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """The flat relational table: entity_name, entity_type, patient_count, averages.
    The type falls back to the summary category when absent."""
    cat = F.create_map(*[x for a in spec.node_attrs for x in (F.lit(a.node_type), F.lit(a.category))])
    return profile.select(F.col("entity").alias("entity_name"),
                          F.coalesce(F.col("entity_type"), cat[F.col("entity_type")]).alias("entity_type"),
                          "patient_count", "avg_billing", "avg_age", "avg_stay")


def summary_for(profile: DataFrame, texts: DataFrame, node_type: str,
                spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """One category's nested summary, flattened: entity, count, its metrics and one
    ``<dist>_dist`` text column per distribution it keeps."""
    a = [x for x in spec.node_attrs if x.node_type == node_type][0]
    p = profile.where(F.col("entity_type") == node_type)
    t = (texts.where(F.col("entity_type") == node_type)
              .groupBy("entity")
              .agg(F.map_from_entries(F.collect_list(F.struct("dist_column", "dist"))).alias("m")))
    out = p.join(t, "entity", "left")
    cols = [F.col("entity"), F.col("patient_count")] + [F.col(f"avg_{m}") for m in a.metrics]
    cols += [F.coalesce(F.col("m")[d], F.lit("")).alias(f"{d}_dist") for d in a.dists]
    return out.select(*cols)


def emergency_rate(clean: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """Share (%) of each hub entity's records with the emergency admission value."""
    hub = spec.attr(spec.hub).column
    adm = [a for a in spec.attributes if a.node_type == "admission_type"][0].column
    g = (clean.where(F.col(hub).isNotNull())
              .groupBy(F.col(hub).alias("entity"))
              .agg(F.count(F.lit(1)).alias("patient_count"),
                   F.count_if(F.col(adm) == spec.emergency_value).alias("emergency_count")))
    return g.withColumn("emergency_rate", rounded_ratio(F.col("emergency_count") * 100,
                                                        F.col("patient_count"), 1))


def emergency_from_dist(profile: DataFrame, dist: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """The same rate read from the already aggregated distributions (no rescan)."""
    hub_type = spec.attr(spec.hub).node_type
    e = (dist.where((F.col("entity_type") == hub_type) & (F.col("dist_column") == "admission")
                    & (F.col("value") == spec.emergency_value))
             .select("entity", F.col("n").alias("emergency_count")))
    p = profile.where(F.col("entity_type") == hub_type).select("entity", "patient_count")
    r = p.join(e, "entity", "left").fillna(0, ["emergency_count"])
    return r.withColumn("emergency_rate", rounded_ratio(F.col("emergency_count") * 100,
                                                        F.col("patient_count"), 1))


def rank_both_ways(df: DataFrame, value: str, k: int = 3, key: str = "entity") -> DataFrame:
    """Top-k and bottom-k rows by ``value`` (bottom kept in descending order, like a
    tail of the descending sort); a row may be in both groups when there are < 2k."""
    return both_ends(df, [F.desc(value), F.asc(key)], [F.asc(value), F.desc(key)], k)
