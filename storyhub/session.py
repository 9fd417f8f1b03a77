"""Session defaults. Every setting gives way to what the cluster has set."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Sessions of a key are merged before the shuffle, so a hot key sends few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Call sites of Column operations cost a driver round trip each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "storyhub") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("STORYHUB_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the queries rely on; safe to call on any running session."""
    for key in ("spark.sql.session.timeZone", "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"):
        spark.conf.set(key, DEFAULTS[key])
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Reliable checkpoints go to the folder the cluster names in
    `spark.checkpoint.dir`. Only a local-mode session without one gets a
    temporary folder; a cluster session without one is an error at first use."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-checkpoint-"))


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they end; else these stay on disk
    until the driver happens to collect garbage. For writes only: a frame that is run
    again would look for the files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_bounded(spark: SparkSession) -> Iterator[None]:
    """Writes inside hand Python at most about 4 MB at a time, unless the session has a
    limit; else 10,000 texts are one batch, held by the JVM and by the worker."""
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(4 << 20))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def materialize(df):
    """Write a frame to a table in the checkpoint folder and read it back.

    Cuts lineage and survives lost executors like a checkpoint; being Parquet,
    later reads take only the columns they need and Spark knows its size.
    """
    path = scratch_path(df.sparkSession, "table")
    with shuffles_freed(df.sparkSession), batches_bounded(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_run_folders: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Collects all intermediate tables made inside in one folder below the
    checkpoint folder and deletes it at the end. Results that read those tables
    must be written or counted before the block ends."""
    folder = scratch_path(spark, "run")
    _run_folders.append(folder)
    try:
        yield folder
    finally:
        _run_folders.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for stream state and output."""
    if _run_folders:
        return f"{_run_folders[-1]}/{name}-{uuid.uuid4().hex}"
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root.isDefined():
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.get()}/{name}-{uuid.uuid4().hex}"
