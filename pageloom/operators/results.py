"""What a user is shown: owners, progress, failure reasons, results, downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.ordered import position

# default number of failure reasons per result row, as many as an accepted archive has pages
REASONS_PER_PAGE = 100


def tasks_by_status(tasks: DataFrame, *statuses: str) -> DataFrame:
    """Tasks in the given states; prunes folders of a snapshot partitioned by status."""
    return tasks.filter(F.col("status").isin(*statuses))


def context_progress(tasks: DataFrame) -> DataFrame:
    """Per context: total, done, failed."""
    return tasks.groupBy("context_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def finished_contexts(progress: DataFrame) -> DataFrame:
    return progress.filter("done + failed = total")


def context_idle(tasks: DataFrame, now: Column) -> DataFrame:
    """When each context was last worked on, and for how many seconds it has been idle; NULL if never."""
    return (
        tasks.groupBy("context_id")
        .agg(F.max("started_at").alias("last_started"))
        .withColumn("idle_s", F.timestamp_diff("SECOND", F.col("last_started"), now))
    )


def context_owner(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("context_id").agg(F.min("created_by").alias("owner"))


def owned_contexts(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests (user_id, context_id) with code NULL, or TS-07 where the user is not the context's owner."""
    mine = F.col("owner").eqNullSafe(F.col("user_id"))
    return requests.join(context_owner(tasks), "context_id", "left").withColumn(
        "code", F.when(~mine | F.col("owner").isNull(), "TS-07")
    )


def downloadable(requests: DataFrame, tasks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Owner check, then TS-08 where there is no transcript. Carries the generation of the one served.

    ``transcripts`` is (context_id, generation), a row per stored transcript.
    """
    latest = transcripts.groupBy("context_id").agg(F.max("generation").alias("generation"))
    checked = owned_contexts(requests, tasks).join(latest, "context_id", "left")
    code = F.coalesce("code", F.when(F.col("generation").isNull(), "TS-08"))
    return checked.withColumn("code", code).withColumn("generation", F.when(code.isNull(), F.col("generation")))


def failure_reasons(tasks: DataFrame, slices: int | None = None) -> DataFrame:
    """Failed tasks with their reason, numbered per context from the latest finished; no finish time comes first."""
    failed = tasks_by_status(tasks, "failed").select("context_id", "id", "failure_reason", "finished_at")
    latest_first = [F.col("finished_at").desc_nulls_first(), F.col("id").asc()]
    return position(failed, ["context_id"], latest_first, "reason_no", slices)


def derive_result(
    tasks: DataFrame, base_url: str, slices: int | None = None, reasons_per_page: int = REASONS_PER_PAGE
) -> DataFrame:
    """Per context: derived status, counts, reasons and download link.

    Reasons are listed in order, ``reasons_per_page`` to a row; a context with more of them has
    further rows (reasons_page 1, 2, ...) that repeat its counts, so none is cut and no row grows without
    bound. The rows of reasons_page 0 are the contexts, each once; ``failure_reasons`` has a reason per row.
    """
    page = F.floor((F.col("reason_no") - 1) / reasons_per_page).alias("reasons_page")
    entry = F.struct("reason_no", F.struct("id", "failure_reason").alias("reason"))
    pages = (
        failure_reasons(tasks, slices)
        .groupBy("context_id", page)
        .agg(F.array_sort(F.collect_list(entry))["reason"].alias("failure_reasons"))
    )
    progress = context_progress(tasks)
    # an inner join can be split on either side, so a context with most of the reasons is no single task
    listed = progress.filter("failed > 0").join(pages, "context_id")
    none = F.array().cast("array<struct<id:string,failure_reason:string>>")
    others = progress.filter("failed = 0 OR context_id IS NULL").withColumns(
        {"reasons_page": F.lit(0).cast("long"), "failure_reasons": none}
    )
    finished = F.col("done") + F.col("failed") == F.col("total")
    started = F.col("done") + F.col("failed") > 0
    link = F.concat(F.lit(f"{base_url}/"), "context_id", F.lit("/download"))
    return listed.unionByName(others).select(
        "context_id",
        F.when(finished, "done").when(started, "running").otherwise("pending").alias("status"),
        "total",
        "done",
        "failed",
        "reasons_page",
        "failure_reasons",
        F.when(finished, link).otherwise("").alias("download_link"),
    )
