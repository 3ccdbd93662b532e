"""The queue operators over a replayable log of task changes.

A change is (task_id, context_id, from_status, status, generation, ts): ``from_status`` is NULL when the
task is new, ``generation`` counts the retries of the context. Each function takes a streaming frame and
returns one, or takes a batch for ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.operators.lifecycle import latest_outcomes, record_outcomes
from pageloom.session import stage

# Fixed value: how often counters are exported.
EXPORT_INTERVAL = "15 seconds"


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append", path: str | None = None, each=None) -> None:
    """Work off what is there and stop: into Parquet at ``path``, or through ``each(batch, batch_id)``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)
    writer.start().awaitTermination()


def stream_progress(changes: DataFrame) -> DataFrame:
    """Running total, done and failed per context (update mode).

    Every change adds one to the status entered and takes one from the status left, so the counts are
    plain sums: a busy context is summed on the map side before the shuffle. A status that a task has
    already entered in this generation is a repeat, however late it comes, and counts nothing.
    """
    once = changes.dropDuplicates(["task_id", "generation", "status"])

    def net(status):
        entered = (F.col("status") == status).cast("long")
        left = F.coalesce((F.col("from_status") == status).cast("long"), F.lit(0))
        return F.sum(entered - left)

    return once.groupBy("context_id").agg(
        F.count_if(F.col("from_status").isNull()).alias("total"), net("done").alias("done"), net("failed").alias("failed")
    )


def keep_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Store each batch in a folder of its own; a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_rows(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """What a sequence of update batches says last about each key."""
    rows = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_age", F.row_number().over(newest)).filter("_age = 1").drop("_age", "batch")


def stream_dedup(outcomes: DataFrame, delay: str) -> DataFrame:
    """Outcomes (…, finished_at) with repeats of the same (task_id, attempt) within ``delay`` left out."""
    return outcomes.withWatermark("finished_at", delay).dropDuplicatesWithinWatermark(["task_id", "attempt"])


def stream_metrics(changes: DataFrame, delay: str, width: str = EXPORT_INTERVAL) -> DataFrame:
    """Changes per export interval and status (append mode: a window comes out when it can no longer change)."""
    return (
        changes.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "status")
        .agg(F.count("*").alias("changes"))
        .select(F.col("w.start").alias("window_start"), "status", "changes")
    )


def append_outcomes(path: str, run: str = "0") -> Callable[[DataFrame, int], None]:
    """Per batch, store one outcome per task in the batch's folder of the outcome log.

    Batches are numbered from 0 in every checkpoint: a stream with a new one needs a ``run`` of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_outcomes(batch).write.mode("overwrite").parquet(f"{path}/batch={run}-{batch_id}")

    return write


def current_tasks(snapshot: DataFrame, outcome_log: DataFrame) -> DataFrame:
    """The snapshot with the logged outcomes of its running tasks applied on reading.

    A batch writes only its own outcomes; the table itself is rewritten now and then, by storing what
    this returns as the next snapshot and starting a new log. Store a snapshot that was changed on top of an
    earlier reading of the log: Spark takes two readings of one folder in one plan for the same.
    """
    return record_outcomes(snapshot, outcome_log, current_only=True)


def ingest_batch(submit: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Per batch of archives, run ``submit`` (archives -> pending tasks) and store the tasks of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # the archives are read by several steps of the submission; the stream must read them once
        submit(stage(batch, "archives")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
