"""Operational metrics: counters, histograms, gauges, throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.codes import code_of, error_dimension
from pageloom.functions.ordered import running_sum
from pageloom.schemas import GPU_FIELDS

# Default histogram bounds of the metrics SDK.
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
MIB = 1048576


def task_counters(tasks: DataFrame, table: str) -> DataFrame:
    """Finished tasks by table and status."""
    return (
        tasks.filter(F.col("status").isin("done", "failed"))
        .groupBy(F.lit(table).alias("table"), "status")
        .agg(F.count("*").alias("tasks"))
    )


def histogram(df: DataFrame, keys: Sequence[str], value: Column, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Cumulative counts (keys, le, count) with the total under ``+Inf`` and the sum of values beside it.

    One aggregate holds a counter per bound; no window and no second shuffle.
    """
    label = {bound: f"{bound:g}" for bound in bounds}
    counters = [F.count_if(F.col("_value") <= bound).alias(f"_{i}") for i, bound in enumerate(bounds)]
    totals = (
        df.filter(value.isNotNull())
        .withColumn("_value", value)
        .groupBy(*keys)
        .agg(*counters, F.count("_value").alias("_all"), F.sum("_value").alias("total"))
    )
    points = [
        F.struct(F.lit(label[bound]).alias("le"), F.col(f"_{i}").alias("count")) for i, bound in enumerate(bounds)
    ]
    points.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("count")))
    return totals.select(*keys, "total", F.inline(F.array(*points)))


def seconds_between(start: str, end: str) -> Column:
    """Seconds with microsecond digits."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(1e6)


def task_duration_hist(tasks: DataFrame, table: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Wall time of finished tasks."""
    timed = tasks.filter("finished_at IS NOT NULL").withColumn("table", F.lit(table))
    return histogram(timed, ["table"], seconds_between("started_at", "finished_at"), bounds)


def model_duration_hist(calls: DataFrame, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Wall time of model requests, per model."""
    return histogram(calls, ["model"], F.col("duration_s"), bounds)


def tokens_by_model(calls: DataFrame) -> DataFrame:
    """Tokens by model and direction; a call that reports none counts 0."""
    sums = calls.groupBy("model").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output"),
    )
    return sums.unpivot("model", ["input", "output"], "direction", "tokens")


def gpu_samples(lines: DataFrame) -> DataFrame:
    """(ts, line) of six comma-separated numbers to (ts, gauge, value); memory given in MiB becomes bytes."""
    layout = ", ".join(f"{name} DOUBLE" for name in GPU_FIELDS)
    spaces = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    sample = F.from_csv("line", layout, spaces)
    wide = lines.select("ts", sample.alias("s")).select("ts", "s.*")
    for name in ("memory_used", "memory_total"):
        wide = wide.withColumn(name, F.col(name) * MIB)
    return wide.unpivot("ts", list(GPU_FIELDS), "gauge", "value").filter("value IS NOT NULL")


def gpu_gauges(lines: DataFrame) -> DataFrame:
    """Latest value of each gauge."""
    return (
        gpu_samples(lines).groupBy("gauge").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    )


def gpu_windows(lines: DataFrame, width: str = "1 hour") -> DataFrame:
    """Mean, maximum and latest value of each gauge per window."""
    return (
        gpu_samples(lines)
        .groupBy("gauge", F.window("ts", width).alias("w"))
        .agg(
            F.count("*").alias("samples"),
            F.avg("value").alias("mean"),
            F.max("value").alias("peak"),
            F.max_by("value", "ts").alias("last"),
        )
        .select("gauge", F.col("w.start").alias("window_start"), "samples", "mean", "peak", "last")
    )


def throughput(tasks: DataFrame, width: str = "1 minute") -> DataFrame:
    """Pages finished per window, overall and per context (context_id NULL is the overall row).

    Contexts are counted first; the overall rows are sums of those, so the table is read once.
    """
    per_context = (
        tasks.filter("status = 'done'")
        .groupBy(F.window("finished_at", width).alias("w"), "context_id")
        .agg(F.count("*").alias("pages"))
    )
    both = F.explode(F.array(F.col("context_id"), F.lit(None).cast("string")))
    return (
        per_context.select(F.col("w.start").alias("window_start"), both.alias("context_id"), "pages")
        .groupBy("window_start", "context_id")
        .agg(F.sum("pages").alias("pages"))
    )


def context_batches(tasks: DataFrame) -> DataFrame:
    """Per context: pages done, seconds from first start to last finish, pages per minute."""
    spans = (
        tasks.filter("finished_at IS NOT NULL")
        .groupBy("context_id")
        .agg(
            F.count_if(F.col("status") == "done").alias("pages"),
            F.min("started_at").alias("first_start"),
            F.max("finished_at").alias("last_finish"),
        )
        .withColumn("span_s", seconds_between("first_start", "last_finish"))
    )
    return spans.select("context_id", "pages", "span_s", F.try_divide(F.col("pages") * 60, "span_s").alias("per_min"))


def errors_by_code(tasks: DataFrame) -> DataFrame:
    """Failed tasks by the code in their reason, with the HTTP class. Reasons without a code count under NULL."""
    counts = (
        tasks.filter("status = 'failed'")
        .groupBy(code_of(F.col("failure_reason")).alias("code"))
        .agg(F.count("*").alias("tasks"))
    )
    return counts.join(F.broadcast(error_dimension(tasks.sparkSession)), "code", "left").select(
        "code", "http_status", "message", "tasks"
    )


def code_usage(tasks: DataFrame) -> DataFrame:
    """Every known code with the number of failed tasks that name it, 0 included."""
    counts = errors_by_code(tasks).select("code", "tasks")
    return error_dimension(tasks.sparkSession).join(counts, "code", "left").select(
        "code", "http_status", "message", F.coalesce("tasks", F.lit(0)).alias("tasks")
    )


def tasks_inflight(tasks: DataFrame, table: str, slices: int | None = None) -> DataFrame:
    """Tasks being handled after each start or end, over time.

    Steps of one instant are summed first; the running sum is spread over slices of time.
    """
    steps = F.inline(
        F.array(
            F.struct(F.col("started_at").alias("ts"), F.lit(1).alias("step")),
            F.struct(F.col("finished_at").alias("ts"), F.lit(-1).alias("step")),
        )
    )
    changes = (
        tasks.filter("started_at IS NOT NULL")
        .select(F.lit(table).alias("table"), steps)
        .filter("ts IS NOT NULL")
        .groupBy("table", "ts")
        .agg(F.sum("step").alias("step"))
    )
    return running_sum(changes, ["table"], [F.col("ts")], F.col("step"), "inflight", slices).select(
        "table", "ts", "inflight"
    )
