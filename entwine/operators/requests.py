"""Question, prompt and tool-request jobs.

The reference answers questions one at a time in a chat loop. Here the data work of
that loop runs as batch jobs over a question table: fill the chat template for every
question, parse a table of tool requests, route each request to the search or the
graph-context job, log the calls per question in order, and build the report. The
model call itself is not part of this library: ``answer`` stays null unless a batch
function is supplied through ``answer_with``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import GraphSpec, HEALTHCARE
from .linking import mentions
from .retrieve import UNKNOWN_TOOL

PROMPT_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "agent_prompt.json")
SEARCH_TOOL, CONTEXT_TOOL = "search_knowledge_base", "get_graph_context"
DEFAULT_N_RESULTS = 4
ARGS_SCHEMA = "query string, n_results int, entity_name string"


def question_key(conv: str, turn: str):
    """One key for a question: its conversation and turn, ``<conv_id>:<turn>``."""
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def questions(conversations: DataFrame) -> DataFrame:
    """Every user turn is a question: qid, conv_id, turn, question."""
    u = conversations.where(F.col("role") == "user")
    return u.select(question_key("conv_id", "turn").alias("qid"), "conv_id", "turn",
                    F.col("text").alias("question"))


def question_turns(conversations: DataFrame) -> DataFrame:
    """question_id, pos, turn: the question that each position of a conversation serves, the
    latest user turn at or before it. What precedes the first question counts to that one;
    a conversation without user turns has no question, and null turns."""
    asked = F.when(F.col("role") == "user", F.col("turn"))
    by = Window.partitionBy("conv_id")
    turn = F.coalesce(F.max(asked).over(by.orderBy("turn")), F.min(asked).over(by))
    return conversations.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("pos"),
                                turn.alias("turn")).distinct()


def load_template(path: str = PROMPT_PATH) -> list[dict]:
    """The chat template (a small config file, read once on the driver)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["messages"]


def read_template(spark, path: str = PROMPT_PATH) -> DataFrame:
    """The template as a table: pos, role, content (multi-line JSON reader)."""
    t = spark.read.option("multiLine", True).json(path)
    return t.select(F.posexplode("messages").alias("pos", "m")).select(
        F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def prompt_messages(qs: DataFrame, template: list[dict]) -> DataFrame:
    """One row per (question, message): the ``{question}`` slot filled, role
    ``human`` renamed ``user``. The template is a literal, so no join."""
    msgs = []
    for i, m in enumerate(template):
        role = "user" if m["role"] == "human" else m["role"]
        content = F.replace(F.lit(m["content"]), F.lit("{question}"), F.col("question"))
        msgs.append(F.struct(F.lit(i).cast("long").alias("pos"), F.lit(role).alias("role"), content.alias("content")))
    return qs.select("qid", "conv_id", "turn", F.inline(F.array(*msgs)))


def tool_requests(conversations: DataFrame, nodes: DataFrame, spec: GraphSpec = HEALTHCARE) -> DataFrame:
    """question_id, pos, call, fn, args: a request table derived from the conversation log.

    User turns ask the search tool with their text; assistant turns ask the graph-context tool for
    every node that their whole text names, in order of first mention (``call`` counts
    from 0), or for their first word if it names none; other turns name a tool that does not
    exist. Rows that repeat a turn each make their requests."""
    asked = conversations.where(F.col("role") == "assistant").withColumn("_h", F.xxhash64("text"))
    keys = ["conv_id", "turn", "_h"]
    first = mentions(asked, keys, "text", nodes, spec).groupBy(*keys, "id", "label").agg(F.min("start").alias("start"))
    lists = first.groupBy(*[F.col(k).alias(f"{k}2") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("start", "id", "label"))).alias("xs"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in keys]
    named = asked.join(lists, same[0] & same[1] & same[2], "left")
    first_word = F.regexp_extract(F.col("text"), r"\p{L}+", 0)
    names = F.coalesce(F.transform("xs", lambda x: x["label"]), F.array(first_word))
    context = (named.select("conv_id", "turn", F.posexplode(names).alias("call", "name"))
               .select("conv_id", "turn", "call", F.lit(CONTEXT_TOOL).alias("fn"), F.to_json(F.struct(F.col("name").alias("entity_name"))).alias("args")))
    search = F.col("role") == "user"
    rest = conversations.where(~F.col("role").eqNullSafe("assistant")).select(
        "conv_id", "turn", F.lit(0).alias("call"), F.when(search, F.lit(SEARCH_TOOL)).otherwise(F.concat(F.lit("summarize_"), F.col("role"))).alias("fn"),
        F.when(search, F.to_json(F.struct(F.col("text").alias("query")))).otherwise(F.lit("{}")).alias("args"))
    return context.unionByName(rest).select(F.col("conv_id").alias("question_id"), F.col("turn").alias("pos"), F.col("call").cast("long").alias("call"), "fn", "args")


def parse_requests(req: DataFrame) -> DataFrame:
    """``req`` without args, with query, n_results (default 4) and entity_name, and ``args`` last."""
    a = F.from_json(F.col("args"), ARGS_SCHEMA)
    return req.select(*[c for c in req.columns if c != "args"], a["query"].alias("query"),
                      F.coalesce(a["n_results"], F.lit(DEFAULT_N_RESULTS)).cast("long").alias("n_results"),
                      a["entity_name"].alias("entity_name"), "args")


def answer_with(df: DataFrame, question: str, context: str, model_factory, out: str = "answer") -> DataFrame:
    """Plug-in answers: ``model_factory()`` returns a callable (questions, contexts) → list of str. Runs as
    an iterator pandas UDF: one model per Python worker, Arrow batches in and out."""
    @F.pandas_udf("string")
    def _answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = model_factory()
        for q, c in batches:
            yield pd.Series(list(model(q.tolist(), c.tolist())), dtype=object)

    return df.withColumn(out, _answer(F.col(question), F.col(context)))


def unknown_tool(fn_col: str = "fn"):
    return F.concat(F.lit(UNKNOWN_TOOL), F.col(fn_col))
