"""Incremental ingest of a landing folder with Structured Streaming.

New export files are discovered by the file stream source (its log in the
checkpoint makes discovery exactly-once); each micro-batch runs the batch
load (profile -> read -> map -> clean -> index) over just its new files and
writes to a folder keyed by the batch id, so a retried batch overwrites its
own output instead of duplicating it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bookspark.plans.load import load_files
from bookspark.session import scratch_path


def _run_batch(out_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the batch's new file paths: bounded by maxFilesPerTrigger (metadata)
        paths = [r["path"] for r in batch.select("path").collect()]
        if not paths:
            return
        done = load_files(spark, paths, out_dir=f"{out_dir}/load/batch={batch_id}")
        done.outcomes.write.mode("overwrite").parquet(f"{out_dir}/outcomes/batch={batch_id}")
    return run


def ingest_stream(spark: SparkSession, landing: str, out_dir: str, checkpoint: str | None = None,
                  max_files_per_batch: int = 1000, glob: str = "*/*.csv",
                  available_now: bool = True) -> StreamingQuery:
    """Start the ingest; with ``available_now`` it processes what is there and stops."""
    checkpoint = checkpoint or scratch_path(spark, "ingest-checkpoint")
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = (spark.readStream.format("binaryFile").schema(schema)
                   .option("maxFilesPerTrigger", max_files_per_batch)
                   .load(f"{landing.rstrip('/')}/{glob}")
                   .select("path", "length"))
    writer = stream.writeStream.foreachBatch(_run_batch(out_dir)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
