"""Edge rules of results and state changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pageloom.functions.codes import CODES, code_of
from pageloom.operators import lifecycle, merge, opmetrics, results
from pageloom.schemas import TASKS, TRANSITIONS
from pageloom.sources import tasks as task_table

T = dt.datetime(2024, 1, 1, 12)


def at(minutes):
    return None if minutes is None else T + dt.timedelta(minutes=minutes)


def table(spark, *rows):
    """rows: (id, context, status, reason, started, finished)"""
    return spark.createDataFrame(
        [(i, c, s, f"owner-{c}", "{}", r, T, at(a), at(z), "standard") for i, c, s, r, a, z in rows], TASKS
    )


@pytest.fixture(scope="module")
def tasks(spark):
    return table(
        spark,
        ("1", "all-failed", "failed", "AppError('TS-03: cut')", 1, 5),
        ("2", "all-failed", "failed", "ValueError('x')", 2, 9),
        ("3", "all-failed", "failed", "OSError('y')", None, None),
        ("4", "busy", "running", None, 3, None),
        ("5", "busy", "pending", None, None, None),
        ("6", "started", "done", "", 1, 2),
        ("7", "started", "pending", None, None, None),
        ("8", "done", "done", "", 1, 2),
        ("9", "fresh", "pending", None, None, None),
    )


def by(frame, key, *values):
    return {row[key]: tuple(row[v] for v in values) if len(values) > 1 else row[values[0]] for row in frame.collect()}


def test_derived_status(tasks):
    got = results.derive_result(tasks, "http://x")
    assert by(got, "context_id", "status") == {
        "all-failed": "done", "busy": "pending", "started": "running", "done": "done", "fresh": "pending"}
    links = by(got, "context_id", "download_link")
    assert links["all-failed"] == "http://x/all-failed/download" and links["busy"] == ""
    reasons = by(got, "context_id", "failure_reasons")
    # no finish time first, then the latest
    assert [r["id"] for r in reasons["all-failed"]] == ["3", "2", "1"] and reasons["done"] == []


def test_many_reasons_go_on_in_further_rows(spark):
    many = table(spark, *((f"{k:03d}", "hot", "failed", "e", 1, k) for k in range(250)), ("x", "cool", "failed", "e", 1, 1))
    got = results.derive_result(many, "", slices=7).filter("context_id = 'hot'").orderBy("reasons_page").collect()
    assert [len(row["failure_reasons"]) for row in got] == [100, 100, 50]
    assert [r["id"] for row in got for r in row["failure_reasons"]] == [f"{k:03d}" for k in reversed(range(250))]
    assert {row["total"] for row in got} == {250}


def test_ownership(spark, tasks):
    asked = spark.createDataFrame(
        [(1, "owner-done", "done"), (2, "owner-done", "busy"), (3, "owner-x", "unknown"), (4, None, "done")],
        "request_id INT, user_id STRING, context_id STRING",
    )
    assert by(results.owned_contexts(asked, tasks), "request_id", "code") == {1: None, 2: "TS-07", 3: "TS-07", 4: "TS-07"}
    stored = spark.createDataFrame([("done", 0), ("done", 1)], "context_id STRING, generation BIGINT")
    got = results.downloadable(asked.unionByName(asked.limit(0)), tasks, stored)
    assert by(got, "request_id", "code", "generation")[1] == (None, 1)  # the newest transcript
    none = results.downloadable(asked, tasks, stored.filter("generation > 5"))
    assert by(none, "request_id", "code")[1] == "TS-08"


def test_retry(tasks):
    assert by(lifecycle.retry_verdicts(tasks), "context_id", "code") == {
        "all-failed": None, "busy": "TS-05", "started": "TS-05", "done": "TS-05", "fresh": "TS-05"}
    got = by(lifecycle.retry_failed(tasks), "id", "status", "failure_reason", "started_at", "finished_at")
    assert got["1"] == got["3"] == ("pending", "", None, None)
    assert got["8"] == ("done", "", at(1), at(2))


def test_completion_failure_then_retry_redoes_all(spark, tasks):
    failures = spark.createDataFrame([("done", "OSError('merge')")], "context_id STRING, reason STRING")
    failed = lifecycle.fail_contexts(tasks, failures)
    assert by(failed, "id", "status", "failure_reason", "finished_at")["8"] == ("failed", "OSError('merge')", at(2))
    assert by(lifecycle.retry_failed(failed), "id", "status")["8"] == "pending"


def test_outcomes_last_one_wins(spark, tasks):
    outcomes = spark.createDataFrame(
        [("4", "failed", "E('1')", at(5), 1), ("4", "done", None, at(6), 2), ("4", "done", None, at(6), 2), ("zz", "done", "", at(1), 1)],
        "task_id STRING, status STRING, failure_reason STRING, finished_at TIMESTAMP, attempt INT",
    )
    got = lifecycle.record_outcomes(tasks, outcomes)
    assert got.count() == tasks.count() and got.columns == tasks.columns
    assert by(got, "id", "status", "failure_reason", "finished_at")["4"] == ("done", "", at(6))


def test_stale_is_strict(spark):
    rows = table(spark, ("a", "c", "running", None, 0, None), ("b", "c", "running", None, 1, None), ("d", "c", "done", "", -9, 0))
    now = F.lit(at(5))
    assert [r["id"] for r in lifecycle.stale_tasks(rows, now, 5).collect()] == []
    assert [r["id"] for r in lifecycle.stale_tasks(rows, F.lit(at(6)), 5).collect()] == ["a"]
    assert [r["id"] for r in lifecycle.stale_tasks(rows, F.lit(at(60)), 5, limit=1).collect()] == ["a"]
    assert by(lifecycle.reclaim_stale(rows, F.lit(at(6)), 5), "id", "started_at") == {"a": at(6), "b": at(1), "d": at(-9)}


def test_transitions(spark):
    log = [(f"{a}>{b}", s, at(k)) for a in (None, "pending", "running", "done", "failed")
           for b in ("pending", "running", "done", "failed") for k, s in enumerate((a, b)) if s]
    frame = spark.createDataFrame(log, "task_id STRING, status STRING, ts TIMESTAMP").withColumn("context_id", F.lit("c"))
    bad = {(row["from_status"], row["status"]) for row in lifecycle.invalid_transitions(frame).collect()}
    pairs = {(a, b) for a in ("pending", "running", "done", "failed") for b in ("pending", "running", "done", "failed")}
    starts = {(None, s) for s in ("running", "done", "failed")}
    assert bad == (pairs | starts) - set(TRANSITIONS)


def test_quarantine(spark, tasks):
    bad = tasks.withColumn("status", F.when(F.col("id") == "1", "lost").when(F.col("id") != "2", F.col("status")))
    good, aside = task_table.quarantine(bad)
    assert {row["id"] for row in aside.collect()} == {"1", "2"} and good.count() == 7


def test_codes(spark):
    frame = spark.createDataFrame([("AppError('TS-03: x')",), ("boom",), (None,), ("BadRequestError('ZIP-01: y')",)], "r STRING")
    assert [row[0] for row in frame.select(code_of(F.col("r"))).collect()] == ["TS-03", None, None, "ZIP-01"]
    assert len({code for code, _, _ in CODES}) == len(CODES) == 25


def test_errors_without_code_are_counted(tasks):
    assert by(opmetrics.errors_by_code(tasks), "code", "tasks", "http_status") == {"TS-03": (1, 500), None: (2, None)}


def test_parts(spark):
    pages = [("hot", f"{k:04d}_p.jpg", f"<{k}>") for k in range(230)] + [("small", "0001_b.jpg", "B"), ("small", "0000_c.jpg", "C"),
                                                                        ("small", "0002_x.jpg", None)]
    got = merge.merge_transcripts(spark.createDataFrame(pages, "context_id STRING, object_name STRING, text STRING"))
    rows = sorted(got.collect())
    assert [(r["context_id"], r["part"], r["pages"]) for r in rows] == [("hot", 0, 100), ("hot", 1, 100), ("hot", 2, 30), ("small", 0, 2)]
    bare = spark.createDataFrame([("c", f"p{k:04d}", "x") for k in range(25)], "context_id STRING, object_name STRING, text STRING")
    assert sorted(r["pages"] for r in merge.merge_transcripts(bare, 10).collect()) == [5, 10, 10]
    assert "".join(r["text"] for r in rows[:3]) == "".join(f"<{k}>" for k in range(230)) and rows[3]["text"] == "CB"


def test_completion_once_per_generation(spark, tasks):
    pages = spark.createDataFrame([("done", "0000_a", "A")], "context_id STRING, object_name STRING, text STRING")
    none = spark.createDataFrame([], "context_id STRING, generation BIGINT")
    got = by(merge.complete_contexts(tasks, pages, none), "context_id", "text", "pages")
    assert got == {"done": ("A", 1), "all-failed": ("", 0)}  # nothing readable: an empty transcript
    before = spark.createDataFrame([("done", 0), ("all-failed", 0)], "context_id STRING, generation BIGINT")
    assert merge.complete_contexts(tasks, pages, before).count() == 0
    retried = spark.createDataFrame([("done", 1)], "context_id STRING, generation BIGINT")
    assert by(merge.complete_contexts(tasks, pages, before, retried), "context_id", "generation") == {"done": 1}
