"""Entity linking: which nodes of the graph a whole text names, and which node a name means.

``mentions`` looks at every run of words of a text, of each length that a label has. Words are
runs of letters, marks and digits, lower-cased, in texts and labels alike, so ``Brand#13`` is found
in ``a brand 13 box``. Runs travel as two hashes and are joined with those of the
labels; where matches overlap the leftmost counts, and of those the longest.

``resolve`` finds the node that a name stands for through an index of the labels' parts of up to
``GRAM`` letters: a label that contains a name holds all its parts, so a name is joined
on its rarest part alone and the few labels found are compared. Both are equi-joins, for
any number of names and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import broadcast_if_bytes
from ..spec import GraphSpec, HEALTHCARE
from .vectors import tokens

GRAM = 3


def ranked_nodes(nodes: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """(id, label, type_rank): types in the spec's order, others last."""
    ranks = F.create_map(*[x for i, a in enumerate(spec.node_attrs) for x in (F.lit(a.node_type), F.lit(i))])
    return nodes.select("id", "label", F.coalesce(ranks[F.col("node_type")], F.lit(len(spec.node_attrs))).alias("type_rank"))


def _best() -> Column:
    """The first node by type, label and id, to be aggregated."""
    return F.min(F.struct("type_rank", "label", "id"))


# ---------------------------------------------------------------- names → nodes
def runs(text: Column, n: Column | int) -> Column:
    """All runs of ``n`` letters, none if the text is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.filter(every, lambda r: F.length(r) == n)


def parts(text: Column) -> Column:
    """Distinct parts of a text: all runs of 1 to ``GRAM`` letters."""
    return F.array_distinct(F.concat(*[runs(text, n) for n in range(1, GRAM + 1)]))


def longest_parts(text: Column) -> Column:
    """Distinct parts of the largest length that the text has."""
    return F.array_distinct(runs(text, F.least(F.length(text), F.lit(GRAM))))


def resolve(names: DataFrame, name: str, nodes: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """``names`` with resolved_id and resolved_label, null where nothing matches.

    A label equal to the name wins; otherwise the first node (type order, label, id) whose label
    contains the name, letter case aside. An empty or null name matches nothing. Each
    distinct name is looked up once; rows that repeat a name all stay."""
    labels = ranked_nodes(nodes, spec)
    asked = names.select(F.col(name).alias("_name")).where(F.length(F.col(name)) > 0).distinct()
    exact = asked.join(broadcast_if_bytes(labels), F.col("_name") == F.col("label")).groupBy("_name").agg(_best().alias("exact"))
    index = labels.select("*", F.explode(parts(F.lower("label"))).alias("part"))
    sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    wanted = asked.select("_name", F.explode(longest_parts(F.lower("_name"))).alias("part"))
    # a part that no label holds has no size and is the rarest of all: its name is found nowhere
    rarest = (wanted.join(broadcast_if_bytes(sizes), "part", "left").groupBy("_name")
              .agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "part")).alias("r")).where("r.size > 0").select("_name", F.col("r.part").alias("part")))
    within = (rarest.join(broadcast_if_bytes(index), "part").where(F.contains(F.lower("label"), F.lower("_name")))
              .groupBy("_name").agg(_best().alias("within")))
    found = (exact.join(within, "_name", "full_outer")
             .select(F.col("_name").alias("_found"), F.coalesce("exact", "within").alias("_node")))
    return (names.join(broadcast_if_bytes(found), F.col(name) == F.col("_found"), "left")
            .select(*names.columns, F.col("_node.id").alias("resolved_id"), F.col("_node.label").alias("resolved_label")))


# ---------------------------------------------------------------- texts → nodes
def _hashes(run: Column) -> tuple[Column, Column]:
    return F.xxhash64(run).alias("h1"), F.xxhash64(run, F.lit(1)).alias("h2")


def label_keys(nodes: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """(h1, h2, words, id, label): the labels by the hashes of their words; of labels with the same
    words the first node."""
    found = ranked_nodes(nodes, spec).withColumn("_w", tokens(F.col("label"))).where(F.size("_w") > 0)
    best = found.groupBy(F.array_join("_w", " ").alias("run"), F.size("_w").alias("words")).agg(_best().alias("b"))
    return best.select(*_hashes(F.col("run")), "words", "b.id", "b.label")


def mentions(texts: DataFrame, keys: list[str], text: str, nodes: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """(keys…, start, words, id, label): the nodes named in each text, by the position of their
    first word (from 0). Rows with equal keys and text count once; null texts name nothing."""
    labels = label_keys(nodes, spec)
    lengths = labels.agg(F.collect_set("words")).scalar()  # as many as labels have different lengths
    t = (texts.select(*keys, F.xxhash64(text).alias("_t"), tokens(F.col(text)).alias("_w"))
         .select("*", F.explode(lengths).alias("_n")).where(F.col("_n") <= F.size("_w")))
    run = lambda i: F.array_join(F.slice(F.col("_w"), i + 1, F.col("_n")), " ")
    every = t.select(*keys, "_t", F.inline(F.transform(F.sequence(F.lit(0), F.size("_w") - F.col("_n")), lambda i: F.struct(i.alias("start"), *_hashes(run(i))))))
    side = broadcast_if_bytes(labels)
    hits = every.join(side, ["h1", "h2"]).select(*keys, "_t", "start", "words", "id", "label").distinct()
    # Only matches that overlap need an order: they are folded together, chain by chain.
    by = Window.partitionBy(*keys, "_t").orderBy("start", F.desc("words"))
    stop = F.max(F.col("start") + F.col("words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    chained = hits.withColumn("_new", F.when(F.col("start") < stop, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    xs = F.array_sort(F.collect_list(F.struct("start", (-F.col("words")).alias("less"), "id", "label")))
    none = F.filter("xs", lambda x: F.lit(False))
    kept = F.aggregate("xs", F.struct(F.lit(0).alias("stop"), none.alias("kept")), lambda a, x: F.when(
        x["start"] >= a["stop"], F.struct((x["start"] - x["less"]).alias("stop"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))
    return (chained.groupBy(*keys, "_t", "_chain").agg(xs.alias("xs"))
            .select(*keys, F.inline(kept["kept"])).select(*keys, "start", (-F.col("less")).alias("words"), "id", "label"))
