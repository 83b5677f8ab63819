"""Spark session and shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loanweave", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``. A local session may go
    without, and then gets a fresh folder that is kept for its lifetime.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None:
        known = context.getCheckpointDir()
        if known is not None:
            return known
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="loanweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as column files in the shared scratch folder, so a lost executor never replays earlier rounds.

    A checkpoint would run what leads to the rows twice and write them whole and unpacked.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the plans rely on for speed (not for results).

    The JVM does not compile methods above 8000 bytes. Generated stages that
    exceed it would run interpreted; below the limit Spark falls back to one
    small method per group of expressions, which is compiled.

    Loans bucketed by their block are joined on the block and more columns,
    which they may be without moving if part of the join key suffices.

    What is broadcast passes through the driver, which builds a hash table many
    times the size of the rows for each, and a contest has up to four at once. So
    the threshold is low, for the size of files and for what is measured alike.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1MB")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1MB")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
SMALL_METHOD = "2000"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Runs what a round evaluates for each pair as many small methods.

    A join with all tests of a round is one method of some thousand bytes, which the JVM
    accepts but compiles poorly. Results do not depend on it.
    """
    before = spark.conf.get(METHOD_LIMIT, None)
    spark.conf.set(METHOD_LIMIT, SMALL_METHOD)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(METHOD_LIMIT)
        else:
            spark.conf.set(METHOD_LIMIT, before)
