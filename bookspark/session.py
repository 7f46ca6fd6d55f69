"""Session construction and the shared folder for lineage cuts.

On a cluster the session comes from the platform and already names
``spark.checkpoint.dir``; we only read it.  Tests and local runs get a
fresh scratch folder under ``/tmp`` when the setting is unset; a cluster
without the setting is an error, because a local folder is not shared.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Broadcast a side only when its row count is bounded by construction (per-file
# decisions, 1-row totals, constant tables) and below this many rows.
BROADCAST_MAX_ROWS = 200_000

# Spark's setting that removes an execution's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "bookspark") -> SparkSession:
    """Local session for tests, benches and the CLI; a no-op wrapper around an
    already running session on a cluster (the builder returns it)."""
    master = master or os.environ.get("BOOKSPARK_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("BOOKSPARK_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BOOKSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .config("spark.sql.files.openCostInBytes", str(512 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="bookspark-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared checkpoint dir for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def write_and_reload(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared folder and reading it
    back.  Survives executor loss (unlike cached blocks) and lets later jobs
    prune columns and push filters into the scan."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """The shuffle files of each write in the block go when it ends; else they stay on
    disk until the driver happens to collect its garbage."""
    return setting(spark, SHUFFLE_CLEANUP, "true")


def write_and_free(df: DataFrame, name: str) -> DataFrame:
    """``write_and_reload``, and the shuffle files of the write go when it ends."""
    with freed_shuffles(df.sparkSession):
        return write_and_reload(df, name)


@contextmanager
def passing_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``write_and_free`` for a table that only writes inside the block read: it goes with the block."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        with freed_shuffles(spark):
            df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize_small(df: DataFrame, bound_rows: int | None, name: str = "small") -> DataFrame:
    """Freeze a small metadata table (mapping, per-file decisions) so later plans
    do not recompute it.  With a proven row bound it becomes a local relation
    (collected once; size known); otherwise it is written to the shared folder."""
    if bound_rows is not None and bound_rows <= BROADCAST_MAX_ROWS:
        return local_df(df.sparkSession, df.collect(), df.schema)
    return write_and_reload(df, name)


def ensure_parallel(df: DataFrame) -> DataFrame:
    """Spread a DataFrame over the cores when its scan yields fewer partitions
    than the cluster's parallelism (a single-row-group file, a few small
    files).  Large inputs already have many splits, so this is then a no-op
    and adds no shuffle."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def local_df(spark: SparkSession, rows, schema) -> DataFrame:
    """A small table built in the driver (metadata, constants) through Arrow,
    so no Python worker is started to serve it."""
    import pandas as pd
    from pyspark.sql.types import StructType
    st = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    # as objects: pandas would turn whole numbers beside a null into floats
    pdf = pd.DataFrame([tuple(r) for r in rows], columns=st.fieldNames(), dtype=object)
    if pdf.empty:
        return spark.createDataFrame([], st)
    return spark.createDataFrame(pdf, schema=st)
