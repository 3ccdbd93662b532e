"""State changes of the task table, each as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.results import context_progress, finished_contexts
from pageloom.schemas import TRANSITIONS


def _changed(tasks: DataFrame, columns: list[str], changes: dict[str, Column]) -> DataFrame:
    """The columns of the task table with some replaced, in the table's order."""
    return tasks.select(*(changes.get(name, F.col(name)).alias(name) for name in columns))


def stale_tasks(tasks: DataFrame, now: Column, minutes: int = 5, limit: int | None = None) -> DataFrame:
    """Running tasks started more than ``minutes`` ago; with ``limit`` the oldest ones, in order."""
    overdue = tasks.filter((F.col("status") == "running") & (F.col("started_at") < _before(now, minutes)))
    return overdue if limit is None else overdue.orderBy("started_at", "id").limit(limit)


def _before(now: Column, minutes: int) -> Column:
    return now - F.make_dt_interval(mins=F.lit(minutes))


def reclaim_stale(tasks: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Start stale tasks anew. One pass over the table, nothing is shuffled."""
    stale = (F.col("status") == "running") & (F.col("started_at") < _before(now, minutes))
    return _changed(tasks, tasks.columns, {"started_at": F.when(stale, now).otherwise(F.col("started_at"))})


def apply_claim(tasks: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """Mark the claimed ids as running. Whether the claim is small enough to be broadcast is left to its measured size."""
    marked = claimed.select("id", F.lit(True).alias("_claimed"))
    joined = tasks.join(marked, "id", "left").select(*tasks.columns, "_claimed")
    hit = F.col("_claimed").isNotNull()
    return _changed(
        joined,
        tasks.columns,
        {
            "status": F.when(hit, "running").otherwise(F.col("status")),
            "started_at": F.when(hit, now).otherwise(F.col("started_at")),
        },
    )


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome per task, the last to finish; a task reported twice counts once."""
    fields = [name for name in outcomes.columns if name not in ("task_id", "finished_at", "attempt")]
    newest = F.max(F.struct("finished_at", "attempt", *fields)).alias("_last")
    return outcomes.groupBy("task_id").agg(newest).select("task_id", "_last.*")


def record_outcomes(tasks: DataFrame, outcomes: DataFrame, current_only: bool = False) -> DataFrame:
    """Set status, failure_reason ('' when done) and finished_at of the tasks that have an outcome.

    With ``current_only`` an outcome counts for a running task alone, and only if it finished after the
    task's present start: what is left of a run before a retry or a reclaim changes nothing.
    """
    last = latest_outcomes(outcomes).select(
        F.col("task_id").alias("id"),
        F.col("status").alias("_status"),
        F.coalesce("failure_reason", F.lit("")).alias("_reason"),
        F.col("finished_at").alias("_finished"),
    )
    joined = tasks.join(last, "id", "left").select(*tasks.columns, "_status", "_reason", "_finished")
    hit = F.col("_status").isNotNull()
    if current_only:
        hit &= F.coalesce((F.col("status") == "running") & (F.col("_finished") >= F.col("started_at")), F.lit(False))
    return _changed(
        joined,
        tasks.columns,
        {
            "status": F.when(hit, F.col("_status")).otherwise(F.col("status")),
            "failure_reason": F.when(hit, F.col("_reason")).otherwise(F.col("failure_reason")),
            "finished_at": F.when(hit, F.col("_finished")).otherwise(F.col("finished_at")),
        },
    )


def retriable_contexts(tasks: DataFrame) -> DataFrame:
    """Contexts with nothing left to do and at least one failed task."""
    return finished_contexts(context_progress(tasks)).filter("failed > 0").select("context_id")


def retry_failed(tasks: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Put the failed tasks of retriable contexts back to pending.

    ``requested`` (context_id) limits it to the contexts asked for; see ``retry_verdicts`` for the others.
    """
    chosen = retriable_contexts(tasks)
    if requested is not None:
        chosen = chosen.join(requested.select("context_id").distinct(), "context_id", "left_semi")
    joined = tasks.join(chosen.withColumn("_retry", F.lit(True)), "context_id", "left")
    hit = F.col("_retry").isNotNull() & (F.col("status") == "failed")
    return _changed(
        joined,
        tasks.columns,
        {
            "status": F.when(hit, "pending").otherwise(F.col("status")),
            "failure_reason": F.when(hit, "").otherwise(F.col("failure_reason")),
            "started_at": F.when(~hit, F.col("started_at")),
            "finished_at": F.when(~hit, F.col("finished_at")),
        },
    )


def retry_verdicts(tasks: DataFrame) -> DataFrame:
    """Per context whether a retry would be accepted: code NULL, else TS-05."""
    can = (F.col("done") + F.col("failed") == F.col("total")) & (F.col("failed") > 0)
    return context_progress(tasks).withColumn("code", F.when(~can, "TS-05"))


def fail_contexts(tasks: DataFrame, failures: DataFrame) -> DataFrame:
    """Fail every task of the contexts whose completion failed (context_id, reason); finish times stay."""
    reasons = failures.groupBy("context_id").agg(F.max("reason").alias("_reason"))
    joined = tasks.join(reasons, "context_id", "left").select(*tasks.columns, "_reason")
    hit = F.col("_reason").isNotNull()
    return _changed(
        joined,
        tasks.columns,
        {
            "status": F.when(hit, "failed").otherwise(F.col("status")),
            "failure_reason": F.coalesce("_reason", "failure_reason"),
        },
    )


def invalid_transitions(task_events: DataFrame) -> DataFrame:
    """Status changes that the state machine does not allow, with the status before. A task has a few events."""
    # events of one instant are taken in the order a task goes through
    stage_no = F.array_position(F.array(*map(F.lit, ("pending", "running", "done", "failed"))), F.col("status"))
    before_it = F.lag("status").over(Window.partitionBy("task_id").orderBy("ts", stage_no))
    log = task_events.withColumn("from_status", before_it)
    allowed = F.lit(False)
    for before, after in TRANSITIONS:
        allowed = allowed | (F.col("from_status").eqNullSafe(F.lit(before)) & (F.col("status") == after))
    return log.filter(~allowed)
