"""Streaming graph maintenance.

New records arrive as a stream; each micro-batch is reduced to deltas of nodes and edges (one
hash aggregate, on executors) and written to partition ``batch_id`` of a delta table. A
replayed batch overwrites only its own partition, so every batch counts once.

Every ``COMPACT_EVERY`` batches the deltas up to that batch are folded into a partition
``upto`` of a state table, which holds the whole graph as of that batch. The current graph is the
last state and the deltas after it; partition pruning leaves everything older unread.
A batch that is replayed after its compaction changes a delta that is no longer read, and a
compaction that is repeated overwrites its own partition with the same sums. Sums are
order-free, so no watermark or late-data rule is needed. All state lies in files under the
shared checkpoint folder, never on one machine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

NODE, EDGE = "node", "edge"
#: ``relationship`` is an edge's relation or a node's type; nodes have no ``dst``.
ROW = "kind string, src string, dst string, relationship string, delta long"
KEY = ("kind", "src", "dst", "relationship")
COMPACT_EVERY = 16


def _row(kind: str, src: Column, dst: Column, name: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(name).alias("relationship"))


def _counted(batch: DataFrame, rows: list[Column]) -> DataFrame:
    return (batch.select(F.inline(F.array(*rows))).where(F.col("src").isNotNull() & ((F.col("kind") == NODE) | F.col("dst").isNotNull()))
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("delta")))


def edge_deltas(batch: DataFrame, src: Column, dst: Column, relationship: str) -> DataFrame:
    """One micro-batch → how often each pair of nodes occurs; a record without one end has no edge."""
    return _counted(batch, [_row(EDGE, src, dst, relationship)])


def graph_deltas(batch: DataFrame, src: Column, src_type: str, dst: Column, dst_type: str, relationship: str) -> DataFrame:
    """One micro-batch → how often each node and each pair of nodes occurs. A record without one
    end counts for the node at the other end alone."""
    none = F.lit(None).cast("string")
    return _counted(batch, [_row(NODE, src, none, src_type), _row(NODE, dst, none, dst_type), _row(EDGE, src, dst, relationship)])


class GraphStore:
    """The delta and state tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.every = spark, compact_every
        self.deltas, self.states = f"{root}/deltas", f"{root}/states"

    def create(self) -> None:
        """Both tables, empty if new: an empty stream is an empty graph."""
        for path, part in ((self.deltas, "batch_id"), (self.states, "upto")):  # an append of no rows makes the folder
            self.spark.createDataFrame([], f"{ROW}, {part} long").write.mode("append").partitionBy(part).parquet(path)

    def _replace(self, rows: DataFrame, path: str, part: str, number: int) -> None:
        (rows.withColumn(part, F.lit(number).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))

    def _read(self, path: str, part: str) -> DataFrame:
        return self.spark.read.schema(f"{ROW}, {part} long").parquet(path)

    def _sum(self, below: int | None = None) -> DataFrame:
        """The last state (of those before batch ``below``) and the deltas after it, up to ``below``."""
        states, deltas = self._read(self.states, "upto"), self._read(self.deltas, "batch_id")
        if below is not None:
            states, deltas = states.where(F.col("upto") < below), deltas.where(F.col("batch_id") <= below)
        last = states.agg(F.max("upto")).first()[0]  # one number, from the partitions' names
        if last is not None:
            deltas = deltas.where(F.col("batch_id") > last)
        rows = states.where(F.col("upto") == F.lit(last).cast("long")).drop("upto").unionByName(deltas.drop("batch_id"))
        return rows.groupBy(*KEY).agg(F.sum("delta").cast("long").alias("delta"))

    def compact(self, upto: int) -> None:
        """State ``upto``: the graph as of that batch."""
        self._replace(self._sum(upto), self.states, "upto", upto)

    def add(self, deltas: DataFrame, batch_id: int) -> None:
        """The deltas of one batch, in place of those it may have had."""
        self._replace(deltas, self.deltas, "batch_id", batch_id)
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def edges(self) -> DataFrame:
        """(src, dst, relationship, weight)."""
        return self._sum().where(F.col("kind") == EDGE).select("src", "dst", "relationship", F.col("delta").alias("weight"))

    def nodes(self) -> DataFrame:
        """(id, node_type, count)."""
        return self._sum().where(F.col("kind") == NODE).select(F.col("src").alias("id"), F.col("relationship").alias("node_type"), F.col("delta").alias("count"))


def delta_writer(path: str, to_deltas: Callable[[DataFrame], DataFrame], compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink into the graph below ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store = GraphStore(batch.sparkSession, path, compact_every)
        store.create()
        store.add(to_deltas(batch), batch_id)
    return write


def current_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, relationship, weight) of all edges below ``path``."""
    return GraphStore(spark, path).edges()


def current_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, node_type, count) of all nodes below ``path``."""
    return GraphStore(spark, path).nodes()


def run_event_stream(spark: SparkSession, sf_dir: str, compact_every: int = COMPACT_EVERY) -> str:
    """Stream the ``events`` table, one file or a folder of them, into a graph of users and event types
    (``availableNow``: all files present now, a file a micro-batch, then stop), however
    long that takes. Returns the graph's path."""
    table = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(table).schema
    table = f"{table[:-1]}[t]"  # a pattern: the stream source takes a plain path for a folder
    base = scratch_path(spark, "event-graph")
    GraphStore(spark, f"{base}/graph").create()  # a stream without batches is an empty graph
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    event = F.concat(F.lit("event_type:"), F.col("event_type"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(table)
    to_deltas = lambda b: graph_deltas(b, user, "user", event, "event_type", "PERFORMED")
    q = (stream.writeStream.foreachBatch(delta_writer(f"{base}/graph", to_deltas, compact_every))
               .option("checkpointLocation", f"{base}/checkpoint")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/graph"
