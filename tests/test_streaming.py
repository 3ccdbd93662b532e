"""Streams against their batch forms, over several batches, with repeats and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pageloom.operators import lifecycle, results
from pageloom.schemas import OUTCOMES, TASKS
from pageloom.streaming import queue

T = dt.datetime(2024, 1, 1)
CHANGES = "task_id STRING, context_id STRING, from_status STRING, status STRING, generation BIGINT, ts TIMESTAMP"


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def walk(task, context, start, end, status="done", generation=0, first=True):
    rows = [(task, context, None if first else "failed", "pending", generation, at(start)),
            (task, context, "pending", "running", generation, at(start + 1))]
    if end is not None:
        rows.append((task, context, "running", status, generation, at(end)))
    return rows


class Log:
    """A folder that grows by one file per call."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "log"), CHANGES)


def test_progress_with_retry(spark, tmp_path, log):
    log.add(walk("1", "a", 0, 5, "failed") + walk("2", "a", 0, 6))
    log.add(walk("1", "a", 10, 12, "done", 1, first=False) + walk("3", "b", 11, None))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        queue.run_available(queue.stream_progress(log.stream()), str(tmp_path / "cp"), "update", each=queue.keep_batch(out))
    got = queue.latest_rows(spark, out, "context_id STRING, total BIGINT, done BIGINT, failed BIGINT", ["context_id"])
    assert sorted(map(tuple, got.collect())) == [("a", 2, 2, 0), ("b", 1, 0, 0)]


def test_repeats_hours_apart_count_once(spark, tmp_path, log):
    """A task that is reclaimed ends twice: it is not two tasks done."""
    log.add(walk("a", "c", 0, 1) + walk("b", "c", 0, None))
    log.add([("z", "other", "running", "done", 0, at(500))])
    log.add([("a", "c", "running", "done", 0, at(600))])
    counts = str(tmp_path / "counts")
    queue.run_available(queue.stream_progress(log.stream()), str(tmp_path / "cp2"), "update", each=queue.keep_batch(counts))
    got = queue.latest_rows(spark, counts, "context_id STRING, total BIGINT, done BIGINT, failed BIGINT", ["context_id"])
    assert ("c", 2, 1, 0) in set(map(tuple, got.collect()))


def test_logged_outcome_does_not_undo_a_retry(spark, tmp_path):
    kept = str(tmp_path / "kept")
    queue.append_outcomes(kept)(spark.createDataFrame([("1", "failed", "E('x')", at(5), 1)], OUTCOMES), 0)
    tasks = spark.createDataFrame([("1", "c", "running", "u", "{}", None, T, T, None, "standard")], TASKS)
    read = lambda: spark.read.schema(OUTCOMES).parquet(kept).drop("batch")
    failed = queue.current_tasks(tasks, read())
    assert failed.first()["status"] == "failed"
    stored = lambda frame: spark.createDataFrame(frame.collect(), TASKS)
    retried = stored(lifecycle.retry_failed(failed))
    assert queue.current_tasks(retried, read()).first()["status"] == "pending"
    again = stored(lifecycle.apply_claim(retried, retried.select("id"), F.lit(at(10))))
    assert queue.current_tasks(again, read()).first()["status"] == "running"
    # a stream with a new checkpoint numbers its batches from 0 as well
    queue.append_outcomes(kept, "1")(spark.createDataFrame([("1", "done", "", at(12), 2)], OUTCOMES), 0)
    assert read().count() == 2 and queue.current_tasks(again, read()).first()["status"] == "done"


def test_metrics_windows(spark, tmp_path, log):
    log.add(walk("1", "a", 0, 1) + walk("2", "a", 0, 90))
    log.add(walk("3", "a", 200, 201))
    out = str(tmp_path / "out")
    queue.run_available(queue.stream_metrics(log.stream(), "10 minutes"), str(tmp_path / "cp"), path=out)
    got = spark.read.schema("window_start TIMESTAMP, status STRING, changes BIGINT").parquet(out)
    assert sorted(map(tuple, got.collect())) == [
        (at(0), "pending", 2), (at(1), "done", 1), (at(1), "running", 2), (at(90), "done", 1)]


def test_outcomes_stream(spark, tmp_path):
    log = Log(spark, str(tmp_path / "outcomes"), OUTCOMES)
    log.add([("1", "failed", "E('x')", at(5), 1), ("1", "failed", "E('x')", at(5), 1), ("2", "done", "", at(6), 1)])
    log.add([("1", "done", "", at(9), 2), ("2", "done", "", at(6), 1)])
    out = str(tmp_path / "dedup")
    queue.run_available(queue.stream_dedup(log.stream(), "1 hour"), str(tmp_path / "cp1"), path=out)
    got = spark.read.schema(OUTCOMES).parquet(out)
    assert sorted((r["task_id"], r["attempt"]) for r in got.collect()) == [("1", 1), ("1", 2), ("2", 1)]

    kept = str(tmp_path / "kept")
    queue.run_available(log.stream(), str(tmp_path / "cp2"), each=queue.append_outcomes(kept))
    tasks = spark.createDataFrame([(i, "c", "running", "u", "{}", None, T, T, None, "standard") for i in "123"], TASKS)
    outcome_log = spark.read.schema(OUTCOMES).parquet(kept).drop("batch")
    streamed = queue.current_tasks(tasks, outcome_log)
    batch = lifecycle.record_outcomes(tasks, spark.read.schema(OUTCOMES).parquet(log.path))
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert results.context_progress(streamed).first()["done"] == 2
    queue.append_outcomes(kept)(spark.read.schema(OUTCOMES).parquet(log.path).filter("attempt = 2"), 1)  # replay
    assert sorted(queue.current_tasks(tasks, spark.read.schema(OUTCOMES).parquet(kept).drop("batch")).collect()) == sorted(batch.collect())


def test_shared_dir(spark, monkeypatch):
    from pageloom import session

    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
    assert session.stage(spark.range(5).withColumn("r", F.rand()), "x").count() == 5
