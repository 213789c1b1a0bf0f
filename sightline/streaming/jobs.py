"""Streaming jobs: monitor of job logs, resumable ingest, replay-safe rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline.sources.scans import parse_job_log
from sightline.streaming.batches import append_batch, cover, current_folders, folders, newest, read_folders


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Text lines with their log file; new files are picked up as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.col("_metadata.file_name").alias("file"))


def monitor_jobs(events: DataFrame, job: str = "file", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Current state per job: events, last status, last metric value, error count.

    A job is a log file: metric, progress and error lines name no subject.  Works on a batch and on
    a stream (update mode).  State is one row per job.
    """
    at = F.struct(*order)
    is_status, is_number = F.col("status").isNotNull(), F.col("number").isNotNull()
    return events.groupBy(job).agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by(F.when(is_status, F.col("status")), F.when(is_status, at)).alias("last_status"),
        F.max_by(F.when(is_number, F.col("number")), F.when(is_number, at)).alias("last_value"),
        F.count_if((F.col("kind") == "error") | F.coalesce(F.col("status") == "error", F.lit(False))).alias("errors"),
    )


def start_monitor(
    lines: DataFrame, history_path: str, snapshot_path: str, checkpoint: str, job: str = "file", order: Sequence[str] = ("ts",), value: str = "value"
) -> StreamingQuery:
    """Append the job rows that each batch updated to the history, and add them to the snapshot after it.

    The snapshot is a table of :mod:`~sightline.streaming.batches`: a batch writes the rows of the jobs that it
    updated, not those of all jobs.  Each batch writes folders of its own, so a replayed batch replaces its rows.
    """
    state = monitor_jobs(parse_job_log(lines, value), job, order)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
        rows = batch.sparkSession.read.parquet(f"{history_path}/batch={batch_id}")
        append_batch(rows, snapshot_path, batch_id, lambda parts: newest(parts, [job], "batch_id"))

    writer = state.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_snapshot(spark: SparkSession, snapshot_path: str, job: str = "file") -> DataFrame:
    """State of every job after the last batch; ``batch_id`` is the batch that changed it last.

    ``batches.drop_superseded`` frees what merged folders replace.
    """
    return newest(read_folders(spark, snapshot_path, current_folders(folders(spark, snapshot_path))), [job], "batch_id")


def ingest_samples(
    source: DataFrame, done_path: str, failed_path: str, checkpoint: str, keys: Sequence[str], valid: str, ledger_path: str | None = None
) -> StreamingQuery:
    """Write each new sample once; samples that fail ``valid`` are set aside for :func:`run_retries`.

    Which keys have been written, a row per key and outcome, is a ledger on disk (``ledger_path``, beside
    ``done_path`` by default; a table of :mod:`~sightline.streaming.batches`), so the stream holds no state that grows
    and a key is known however old it is.  The ledger is cut down to the keys of the batch before it meets the batch,
    so with a batch of broadcast size it is scanned, not shuffled.  Null keys are equal.  A replayed batch
    overwrites its own folders and looks only at the batches before it.
    """
    marked = source.withColumn("_ok", F.coalesce(F.expr(valid), F.lit(False)))
    ledger, known = ledger_path or f"{done_path.rstrip('/')}-ledger", [*keys, "_ok"]

    def same(left: DataFrame, right: DataFrame) -> Column:
        return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in known])

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(known)
        if batch_id > 0:
            asked = batch.select(*known).distinct()
            seen = read_folders(spark, ledger, cover(batch_id))
            seen = seen.join(asked, same(seen, asked), "left_semi")
            new = new.join(seen, same(new, seen), "left_anti")
        new = new.persist()
        for ok, path in ((F.col("_ok"), done_path), (~F.col("_ok"), failed_path)):
            new.filter(ok).drop("_ok").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        new.unpersist()
        written = [spark.read.parquet(f"{path}/batch={batch_id}").select(*keys, F.lit(ok).alias("_ok")) for path, ok in ((done_path, True), (failed_path, False))]
        append_batch(written[0].union(written[1]), ledger, batch_id, lambda parts: parts.hint("rebalance"))

    return marked.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_retries(
    spark: SparkSession, done_path: str, failed_path: str, keys: Sequence[str], valid: str, repair: Callable[[DataFrame], DataFrame], attempt: int = 1
) -> None:
    """After the queue: try the failed samples that are not done once more, and add those that pass as batch ``-attempt``."""
    failed, done = spark.read.parquet(failed_path), spark.read.parquet(done_path)
    again = repair(retry_failed(failed.drop("batch"), done.filter(F.col("batch") != -attempt), keys))
    again.filter(F.coalesce(F.expr(valid), F.lit(False))).write.mode("overwrite").parquet(f"{done_path}/batch={-attempt}")


def retry_failed(failed: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failed samples that no later batch completed."""
    return failed.dropDuplicates(list(keys)).join(done.select(*keys), list(keys), "left_anti")


def stream_dedup(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Drop replayed rows: one row per key while copies arrive within ``delay`` of each other.

    State is bounded by the watermark.  ``delay`` is a promise about how late copies can come.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
