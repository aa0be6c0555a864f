"""Spark session helpers.

Library code never creates its own session: every function takes the caller's
``SparkSession``. These helpers are for tests, the bench and the entry point.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness (UTC, ANSI) and for scale (AQE, skew joins,
# partition coalescing). Shuffle partitions default to the core count locally; on a
# cluster the caller sizes them (≈ input bytes / 128 MB), AQE coalesces the rest.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Let per-group top-n filters (row_number() <= n) apply a partial limit before
    # the shuffle for n up to the update batch size.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "entwine", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is only read. Where it is
    unset (tests, local runs) a fresh scratch folder is created and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="entwine-ckpt-", dir=os.environ.get("ENTWINE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise a small, reused intermediate in the shared checkpoint folder and
    return a frame whose plan is a plain scan of it. Later plans stay small (fast
    to analyse) and a lost executor re-reads the files instead of recomputing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
