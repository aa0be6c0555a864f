"""Chat formatting with multi-party perspective rotation.

Method: for every participant of a dialogue, the dialogue is rendered with that speaker
as the assistant and the others as named users; system turns stay system turns. The mask
tells what is trained on: the assistant's own texts. The result has one row for each turn
and perspective, with its place in the rendered dialogue, so no dialogue, however long,
is gathered in one row or task: places come from sums over blocks of ``BLOCK`` turns and
sums of the turns before inside the block.

Native DataFrame code throughout.

Defined results: turns are ordered by ``turn`` (null last), then role and text, so the
order of ties is fixed; repeated rows are repeated turns. A null or blank role is a user
named ``unknown`` and, like ``system``, no perspective of its own. A null text is empty.
The marker ``<|`` inside a text or role is written ``< |``, so no text can open or close a
turn. A dialogue without participants gives no row. Rows without ``conv_id`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"


def as_seen(rows: DataFrame) -> DataFrame:
    """``rows`` (speaker, perspective) with the role, name and header that the perspective gives the speaker."""
    role = F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    return (rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
            .withColumn("header", F.concat(F.lit(OPEN), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))))


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, turn, role, name, header, text, mask_start, mask_end, start, end, trained):
    one row for each perspective and turn. ``start`` and ``end`` are the code points that the turn
    takes in the rendered dialogue, ``mask_start`` and ``mask_end`` those of its text."""
    clean = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    last = F.lit(1 << 62)  # the block of turns without a number, after all others
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce(F.expr(f"turn div {block}"), last).alias("block"),
        F.coalesce(F.nullif(F.btrim(clean("role")), F.lit("")), F.lit(UNKNOWN)).alias("speaker"), clean("text").alias("text"))

    # narrow: where each block starts, from sizes by speaker; perspectives differ in headers only
    sums = turns.groupBy("conv_id", "block", "speaker").agg(F.sum(F.length("text") + len(CLOSE)).alias("chars"), F.count("*").alias("n"))
    who = sums.where(~F.col("speaker").isin(SYSTEM, UNKNOWN)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    by_block = (as_seen(sums.join(who, "conv_id")).groupBy("conv_id", "perspective", "block")
                .agg(F.sum(F.col("chars") + F.col("n") * F.length("header")).alias("size")))
    order = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = by_block.select("conv_id", "block", "perspective", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")).alias("before"))

    # texts are shuffled once, by (conv_id, block), before they multiply: the window keeps that partitioning
    rendered = as_seen(turns.join(before.hint("merge"), ["conv_id", "block"])).withColumn("size", (F.length("header") + F.length("text") + len(CLOSE)).cast("long"))
    inside = (Window.partitionBy("conv_id", "block", "perspective").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))
    return (rendered.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
            .withColumn("mask_start", F.col("start") + F.length("header")).withColumn("mask_end", F.col("mask_start") + F.length("text"))
            .select("conv_id", "perspective", "turn", "role", "name", "header", "text", "start", "end", "mask_start", "mask_end", (F.col("role") == "assistant").alias("trained")))


def dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, rendered, masks): whole dialogues from ``rotate``'s rows, for
    training sets whose dialogues fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct("start", F.concat("header", "text", F.lit(CLOSE)).alias("s"), "trained", "mask_start", "mask_end")))
    return (rotated.groupBy("conv_id", "perspective").agg(parts.alias("t"))
            .select("conv_id", "perspective", F.array_join(F.transform("t", lambda t: t["s"]), "").alias("rendered"),
                    F.transform(F.filter("t", lambda t: t["trained"]), lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end"))).alias("masks")))


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(nullif(trim(replace(coalesce(role, ''), '<|', '< |')), ''), 'unknown') as speaker,
    replace(coalesce(text, ''), '<|', '< |') as text
  from conversations where conv_id is not null),
w as (select distinct conv_id, speaker as perspective from t where speaker not in ('system', 'unknown')),
r as (
  select t.conv_id, perspective, turn, speaker, text,
    case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as role
  from t join w on t.conv_id = w.conv_id),
h as (
  select *, case when role = 'user' then speaker end as name,
    '<|im_start|>' || role || case when role = 'user' then ' name=' || speaker else '' end || chr(10) as header from r),
p as (
  select *, cast(sum(length(header) + length(text) + 11) over (partition by conv_id, perspective order by turn nulls last, speaker, text
    rows between unbounded preceding and current row) as bigint) as "end" from h)
select conv_id, perspective, turn, role, name, header, text, "end" - length(header) - length(text) - 11 as start, "end",
  "end" - length(text) - 11 as mask_start, "end" - 11 as mask_end, role = 'assistant' as trained
from p
"""
