"""Mixing sources to target weights by soft domain membership.

Method: the label table names a domain for each labelled document: ``toxic``, ``clean``
(quality 1) or ``junk`` (quality 0). A multinomial classifier over hashed tokens, trained
on all labelled documents, gives every document a posterior for each domain; log
likelihoods count as ``TEMPER`` tokens at most, so membership stays soft. Then nonnegative
rates r of the documents are fitted by least squares, so that the expected domain token
totals, sum of r * tokens * posterior, match the targets: projected gradient steps from
r = 1, each one scan that adds up a few numbers, with the errors weighted by the domains' shares.

A document's rate says how often it should be seen; ``copies`` rounds it up or down by a hash of
the document, so that the mean is the rate. The targets' total is ``GROWTH`` times what
makes the clean domain's rate 1, so clean documents are repeated rather than dropped.

Native DataFrame code throughout. Broadcast: a weight row for each of ``BUCKETS`` buckets,
and labels if a count shows that they are few.

Defined results: tokens are runs of letters and digits or of symbols, lower case. A null or
blank text has no tokens and the prior as posterior. Rows that repeat a ``doc_id`` with the same text
are one; with another text each has a rate. A domain without labelled tokens takes no
part; without any, posteriors are null and rates 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, written

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
BUCKETS, TEMPER = 8192, 50.0
TARGETS = {"clean": 0.90, "junk": 0.05, "toxic": 0.05}
GROWTH = 1.2
STEPS, TOLERANCE, WRITE_EVERY = 60, 1e-4, 8


def domains(labels: DataFrame) -> DataFrame:
    """(id, domain) of the labelled documents, one row each."""
    return (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .select("id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "clean").when(F.col("q") == 0, "junk").alias("domain"))
            .where(F.col("domain").isNotNull()))


def token_rows(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, k, pos, bucket, *more): a row for each token, one with null ``pos`` for a
    document without any; ``k`` is a hash of the text, taken below the generator: beside
    it, Spark would hash the whole text again for each token."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0))
    return (docs.select("doc_id", "text", F.xxhash64("text").alias("k"), *more)
            .select("doc_id", "k", *more, F.posexplode_outer(found).alias("pos", "w"))
            .select("doc_id", "k", *more, "pos", F.when(F.col("w").isNotNull(), F.pmod(F.xxhash64("w"), F.lit(BUCKETS))).alias("bucket")))


def weights(docs: DataFrame, labels: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[list[str], dict[str, float], DataFrame | None]:
    """The domains, their log priors, and a row of log likelihoods for each bucket."""
    side = small(domains(labels), rows)
    counts = written(token_rows(docs.join(side, F.col("doc_id") == F.col("id")), "domain").where(F.col("bucket").isNotNull())
                     .groupBy("bucket", "domain").agg(F.count("*").alias("n")), "mixing-counts")
    total = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}  # a row for each domain
    names = sorted(total)
    if not names:
        return [], {}, None
    prior = {d: math.log(total[d] / sum(total.values())) for d in names}
    by_bucket = counts.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(d) for d in names))
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(by_bucket, "bucket", "left")
    return names, prior, every.select("bucket", *(F.log((F.coalesce(d, F.lit(0)) + 1) / F.lit(float(total[d] + BUCKETS))).alias(d) for d in names))


def posteriors(docs: DataFrame, labels: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[list[str], DataFrame]:
    """The domains and (doc_id, k, n_tokens, p_<domain>...), one row for each document."""
    docs = docs.select("doc_id", "text")
    names, prior, table = weights(docs, labels, rows)
    tokens = token_rows(docs)
    if table is not None:
        tokens = tokens.join(F.broadcast(table), "bucket", "left")  # BUCKETS rows
    sums = tokens.groupBy("doc_id", "k").agg(F.count("bucket").alias("n"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"),
                                             *(F.sum(d).alias(d) for d in names))
    logit = lambda d: F.lit(prior[d]) + F.coalesce(F.col(d) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)) * F.least(F.lit(TEMPER), F.col("n") / F.col("rows"))
    z = sums.select("doc_id", "k", (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"), *(logit(d).alias(d) for d in names))
    if names:
        top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        z = z.select("doc_id", "k", "n_tokens", *(F.exp(F.col(d) - top).alias(d) for d in names))
    whole = sum((F.col(d) for d in names), F.lit(0.0))
    return names, z.select("doc_id", "k", "n_tokens", *((F.col(d) / whole).alias(f"p_{d}") for d in names))


def fit(found: DataFrame, names: list[str], targets: dict[str, float] = TARGETS, growth: float = GROWTH,
        steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``found`` with ``rate``."""
    one = found.withColumn("rate", F.lit(1.0))
    wanted = [d for d in names if targets.get(d, 0) > 0]
    if not wanted:
        return one
    total = lambda df, r: df.agg(*(F.coalesce(F.sum(r * F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in names)).first()
    now = total(one, F.lit(1.0))
    all_tokens = sum(now)
    lead = "clean" if "clean" in wanted else wanted[0]
    share = sum(targets[d] for d in wanted)
    budget = growth * now[lead] / (targets[lead] / share)
    goal = {d: budget * targets.get(d, 0) / share for d in names}
    if not all_tokens:
        return one
    first = {d: max(now[d], 1.0) for d in names}  # the weights of the errors
    for k in range(1, steps + 1):
        if max(abs(now[d] - goal[d]) for d in names) <= tolerance * all_tokens:
            break
        step: Column = sum((F.col(f"p_{d}") * ((now[d] - goal[d]) / first[d]) for d in names), F.lit(0.0))
        one = one.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - step))
        if k % WRITE_EVERY == 0:
            one = written(one, "mixing-rates")
        now = total(one, F.col("rate"))
    return one


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, growth: float = GROWTH) -> DataFrame:
    """(doc_id, k, n_tokens, p_<domain>..., rate, copies) for every document."""
    names, found = posteriors(docs, labels)
    fitted = fit(written(found, "mixing-posteriors"), names, targets, growth)
    luck = F.pmod(F.xxhash64("doc_id", "k"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return written(fitted.withColumn("copies", F.floor(F.col("rate") + luck)), "mixing-result")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, growth: float = GROWTH) -> DataFrame:
    """``docs`` with ``rate`` and ``copies`` (in place of columns of those names), without
    the documents of no copies."""
    found = rates(docs, labels, targets, growth).select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), F.col("rate").alias("__rate"), F.col("copies").alias("__copies"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k"))).where("__copies > 0")
    return joined.select(*(c for c in docs.columns if c not in ("rate", "copies")), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``rates``, the posteriors and rates to six places."""
    found = rates(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in found.columns if c.startswith("p_")), F.round("rate", 6).alias("rate"), "copies")
