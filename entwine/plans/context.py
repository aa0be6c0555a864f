"""Lazily built, shared intermediate frames for one (session, data folder).

Each registered query asks the context for what it needs; nothing is computed until
an action runs, and Catalyst prunes every frame down to the columns used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean as C
from ..operators import profile as P
from ..operators.update import TIE_BREAK, cutoff_day, recent_batch
from ..sources.tables import raw_visits, read_table
from ..session import cut_lineage
from ..spec import GraphSpec, HEALTHCARE


class Ctx:
    """The given tables below ``sf_dir``, or with ``facts`` a user's own fact table (see
    ``sources.facts``), whose records ``tie_break`` orders among equal dates."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, spec: GraphSpec = HEALTHCARE,
                 facts: DataFrame | None = None, tie_break: tuple[str, ...] | None = None):
        self.spark, self.sf_dir, self.spec = spark, sf_dir, spec
        self._facts, self._tie_break = facts, TIE_BREAK if facts is None else tie_break

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return raw_visits(self.spark, self.sf_dir) if self._facts is None else self._facts

    @cached_property
    def clean(self) -> DataFrame:
        return C.clean_visits(self.raw, self.spec)

    @cached_property
    def facts(self) -> DataFrame:
        """Entity rows, pair rows and the record count from ONE scan of the fact
        table and one hash aggregate. The result is bounded by the number of
        entities and value pairs (not by rows), so it is persisted and every
        downstream frame of this context reads it instead of rescanning; a lost
        block is recomputed from lineage."""
        return cut_lineage(P.entity_facts(self.clean, self.spec, nodes=True, pairs=True, total=True))

    @cached_property
    def profile(self) -> DataFrame:
        return P.profile_from_facts(self.facts, self.spec)

    @cached_property
    def pairs(self) -> DataFrame:
        from pyspark.sql import functions as F
        return self.facts.where(~F.col("pair").isin(P.NODE, P.ALL)).select("pair", "a", "b", "n")

    @cached_property
    def dist(self) -> DataFrame:
        """Long-form distributions (bounded by entity × value pairs), materialised
        once: documents, summaries and ranks all read it."""
        return cut_lineage(P.entity_dist(self.pairs, self.spec))

    @cached_property
    def texts(self) -> DataFrame:
        return cut_lineage(P.dist_texts(self.dist))

    @cached_property
    def total(self) -> DataFrame:
        """One-row frame with the record count."""
        from pyspark.sql import functions as F
        return self.facts.where(F.col("pair") == P.ALL).select(F.col("n").alias("total"))

    @cached_property
    def nodes(self) -> DataFrame:
        from ..operators.graph import nodes_from_counts
        return nodes_from_counts(self.profile, self.spec)

    @cached_property
    def edges(self) -> DataFrame:
        from ..operators.graph import relation_edges
        return relation_edges(self.pairs, self.spec)

    @cached_property
    def documents(self) -> DataFrame:
        from ..operators.documents import rag_documents
        # One document per entity of three types plus two insights: bounded by the
        # entity count, reused by every retrieval step, so persisted.
        return cut_lineage(rag_documents(self.profile, self.texts, self.dist, self.total.scalar(), self.spec))

    # ------------------------------------------------------------ retrieval inputs
    @cached_property
    def questions(self) -> DataFrame:
        from ..operators.requests import questions
        return questions(self.table("conversations"))

    @cached_property
    def q_post(self) -> DataFrame:
        from ..operators.vectors import postings
        return postings(self.questions, ["qid"], "question")

    @cached_property
    def d_post(self) -> DataFrame:
        from ..operators.vectors import postings
        return cut_lineage(postings(self.documents, ["id"], "text"))

    @cached_property
    def d_vec(self) -> DataFrame:
        """id, vec of every document; written once, since searches first measure it."""
        from ..operators.vectors import count_vectors
        return cut_lineage(count_vectors(self.documents, ["id"], "text"))

    @cached_property
    def hits(self) -> DataFrame:
        from ..operators.nearest import normalised_l2, topk
        from ..operators.vectors import count_vectors
        qs = count_vectors(self.questions, ["qid"], "question")
        return topk(qs, "qid", self.d_vec, "id", 4, metric=normalised_l2).withColumnRenamed("id", "doc_id")

    @cached_property
    def contexts(self) -> DataFrame:
        """entity_name, resolved_id, context for every entity a document names."""
        from pyspark.sql import functions as F
        from ..operators.retrieve import graph_context
        names = self.documents.select("entity_name").where(F.col("entity_name").isNotNull()).distinct()
        return cut_lineage(graph_context(names, "entity_name", self.nodes, self.edges, self.spec))

    # ------------------------------------------------------------ incremental update inputs
    @cached_property
    def batch(self) -> DataFrame:
        """The N most recent records (N = spec.update_batch_size), materialised once:
        bounded by the parameter, read by both batch aggregates."""
        n = self.spec.update_batch_size
        if self._facts is not None:
            return cut_lineage(recent_batch(self.clean, n, tie_break=self._tie_break))
        late, cutoff = self._late(n)
        return cut_lineage(recent_batch(late, n, tie_break=self._tie_break, cutoff=cutoff))

    def _late(self, n: int) -> tuple[DataFrame, DataFrame | None]:
        """Clean records that hold the ``n`` most recent ones, and the day to cut them at. Orders are counted per
        day, and only the latest ``n`` of them and the rest of one day are joined with the other tables. If
        they have fewer than ``n`` records, eight times as many orders are taken, in the end all."""
        orders, wanted = self.table("orders").select("o_orderdate"), n
        while True:
            since = cut_lineage(cutoff_day(orders, wanted, "o_orderdate"))  # a single row
            if since.first()[0] is None:
                return self.clean, None
            late = C.clean_visits(raw_visits(self.spark, self.sf_dir, since.scalar()), self.spec)
            cutoff = cut_lineage(cutoff_day(late, n))
            if cutoff.first()[0] is not None:
                return late, cutoff
            wanted *= 8

    @cached_property
    def batch_facts(self) -> DataFrame:
        return P.entity_facts(self.batch, self.spec, nodes=True, pairs=True)
