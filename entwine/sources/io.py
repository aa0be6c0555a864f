"""Sinks and round trips: CSV, Parquet, JSON lines, node-link documents, managed
tables. Every path lives under the shared checkpoint folder (or a caller
given location); nothing is written through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

NODE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("node_type", T.StringType()), T.StructField("color", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("title", T.StringType())])
LINK_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("relationship", T.StringType()), T.StructField("weight", T.LongType()),
    T.StructField("title", T.StringType())])


#: CSV that keeps line feeds, quotes and outer white space, and tells null from empty text.
CSV = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
       "nullValue": "\u2400"}
#: The same for writers. The files are compressed (quickly): multi-line CSV is read a whole file a task in any case.
CSV_OUT = {**CSV, "emptyValue": '""', "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def csv_roundtrip(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write with a header, read back with the original schema (types intact)."""
    path = path or scratch_path(df.sparkSession, "csv")
    df.write.mode("overwrite").options(**CSV_OUT).csv(path)
    return df.sparkSession.read.schema(df.schema).options(**CSV, emptyValue="").csv(path)


def parquet_roundtrip(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    path = path or scratch_path(df.sparkSession, "parquet")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def export_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Node-link JSON, split into ``nodes/`` and ``links/`` JSON-lines folders so a
    graph of any size is written in parallel (one object per line)."""
    nodes.select(*[f.name for f in NODE_SCHEMA]).write.mode("overwrite").json(f"{path}/nodes")
    (edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship", "weight", "title")
          .write.mode("overwrite").json(f"{path}/links"))
    return path


def import_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.schema(NODE_SCHEMA).json(f"{path}/nodes")
    links = spark.read.schema(LINK_SCHEMA).json(f"{path}/links")
    edges = links.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relationship", "weight", "title")
    return nodes, edges


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a catalog table (external, stored under the shared folder) and read
    it back ordered by patient count, largest first."""
    path = path or scratch_path(df.sparkSession, f"table-{name}")
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


# ---------------------------------------------------------------- one node-link document
#: Bytes of a graph that may be put together into one document, which one task writes.
DOCUMENT_BYTES = 256 << 20
DOCUMENT = "nodes array<struct<{0}>>, links array<struct<{1}>>, edges array<struct<{1}>>".format(
    *(", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema) for schema in (NODE_SCHEMA, LINK_SCHEMA)))


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, max_bytes: int = DOCUMENT_BYTES) -> str:
    """The graph as one undirected node-link object with ``nodes`` and ``links``, a text file below ``path``.
    Graphs of more than ``max_bytes`` are refused: ``export_graph_json`` writes those in parallel."""
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *[f.name for f in LINK_SCHEMA][2:])
    sides = [nodes.select(F.struct(*[f.name for f in NODE_SCHEMA]).alias("x")), links.select(F.struct(*links.columns).alias("x"))]
    size = sum(side.agg(F.coalesce(F.sum(F.octet_length(F.to_json("x")).cast("long")), F.lit(0))).first()[0] for side in sides)
    if size > max_bytes:
        raise ValueError(f"a graph of {size} bytes is too large for one document; write it with export_graph_json")
    lists = [side.agg(F.to_json(F.array_sort(F.collect_list("x")))).scalar() for side in sides]
    doc = F.concat(F.lit('{"directed": false, "multigraph": false, "graph": {}, "nodes": '), lists[0], F.lit(', "links": '), lists[1], F.lit("}"))
    nodes.sparkSession.range(0, 1, 1, 1).select(doc.alias("value")).write.mode("overwrite").text(path)
    return path


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link documents (a file, or a folder of files, each one object whose
    links are under ``links`` or ``edges``). A node without a label has its id as label."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", DOCUMENT).alias("d"))
    nodes = doc.select(F.inline("d.nodes")).withColumn("label", F.coalesce("label", "id"))
    links = doc.select(F.inline(F.coalesce("d.links", "d.edges")))
    return nodes, links.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relationship", "weight", "title")
