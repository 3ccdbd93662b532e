"""Completions and alerts over several batches: repeats, retries, reclaims, early ends, and state that ends."""

import pytest
from test_streaming import Log, at, log, walk  # noqa: F401

from pageloom.streaming import processors


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """A state store per task and batch is slow to open."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def run(stream, folder, name, progress=None):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True)
    query = writer.format("parquet").option("path", f"{folder}/{name}").start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress


def rows(spark, folder, name, schema):
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{folder}/{name}").collect()))


def test_completion_counts_its_own_totals(spark, tmp_path, log):  # noqa: F811
    def done():
        run(processors.stream_completion(log.stream(), "1 day", buckets=2), tmp_path, "out")
        return rows(spark, tmp_path, "out", processors.COMPLETIONS)

    log.add(walk("1", "a", 0, 5, "failed") + walk("1", "a", 0, 5, "failed") + walk("2", "a", 0, None) + walk("3", "b", 0, 4) + walk("4", "b", 0, None))
    assert done() == []  # a task reported twice is not two tasks
    log.add([("2", "a", "running", "done", 0, at(6))])
    assert done() == [("a", 0, 2, 1, 1)]
    log.add([("2", "a", "running", "done", 0, at(6)), ("1", "a", "running", "failed", 0, at(700))])
    log.add(walk("1", "a", 10, 12, "done", 1, first=False))
    log.add(walk("2", "a", 0, None))
    assert done() == [("a", 0, 2, 1, 1), ("a", 1, 1, 1, 0)]
    log.add([("5", "c", "running", "done", 0, at(3))])
    assert len(done()) == 2  # an end whose opening is still to come
    log.add(walk("5", "c", 0, None) + [("4", "b", "running", "failed", 0, at(900))])
    assert done() == [("a", 0, 2, 1, 1), ("a", 1, 1, 1, 0), ("b", 0, 2, 1, 1), ("c", 0, 1, 1, 0)]


def test_completion_state_ends(spark, tmp_path, log):  # noqa: F811
    told = []
    log.add(walk("1", "a", 0, 5) + walk("2", "b", 0, None) + walk("3", "a", 0, 8, "failed"))
    log.add(walk("4", "z", 6000, 6001))
    run(processors.stream_completion(log.stream(), "1 hour", buckets=2), tmp_path, "out", told)
    assert rows(spark, tmp_path, "out", processors.COMPLETIONS) == [("a", 0, 2, 1, 1), ("z", 0, 1, 1, 0)]
    assert [s["numRowsTotal"] for s in told[-1]["stateOperators"]] == [2, 2]  # "b" is open, "z" young; "a" is gone
    log.add([("3", "a", "running", "failed", 0, at(8)), ("2", "b", "running", "done", 0, at(6200))])
    log.add(walk("5", "y", 99000, 99001))
    run(processors.stream_completion(log.stream(), "1 hour", buckets=2), tmp_path, "out", told)
    assert rows(spark, tmp_path, "out", processors.COMPLETIONS)[1:] == [("b", 0, 1, 1, 0), ("y", 0, 1, 1, 0), ("z", 0, 1, 1, 0)]


def test_alerts_on_timers(spark, tmp_path, log):  # noqa: F811
    told = []
    log.add(walk("quick", "a", 0, 3) + walk("slow", "a", 0, 30) + walk("lost", "b", 1, None) + walk("now", "b", 170, None))
    log.add([("again", "c", "pending", "running", 0, at(20)), ("again", "c", "running", "running", 0, at(24))])
    log.add([("again", "c", "running", "done", 0, at(28)), ("quick", "a", "running", "done", 0, at(3)), ("reclaimed", "c", "pending", "running", 0, at(60))])
    log.add([("reclaimed", "c", "running", "running", 0, at(70)), ("reclaimed", "c", "running", "done", 0, at(72))])
    log.add(walk("late", "d", 180, 181) + walk("later", "d", 300, 301))
    run(processors.stream_stale(log.stream(), 5, "30 minutes", buckets=2), tmp_path, "out", told)
    got = rows(spark, tmp_path, "out", processors.ALERTS)
    assert got == [("lost", "b", at(2)), ("now", "b", at(171)), ("reclaimed", "c", at(60)), ("slow", "a", at(1))]
    log.add(walk("end", "e", 900, 901))
    log.add([("end", "e", "running", "running", 0, at(2000)), ("x", "e", "running", "done", 0, at(2001))])
    log.add([("y", "e", "running", "done", 0, at(2300)), ("y", "e", "pending", "running", 0, at(2299))])
    run(processors.stream_stale(log.stream(), 5, "30 minutes", buckets=2), tmp_path, "out", told)
    assert len(rows(spark, tmp_path, "out", processors.ALERTS)) == 5  # the restart of "end" that nothing answered
    assert told[-1]["stateOperators"][0]["numRowsTotal"] <= 2  # only the last starts still wait


def test_many_contexts_share_a_slot(spark, tmp_path, log):  # noqa: F811
    """A slot's timers are few however many contexts it holds, and each context keeps its own count and end."""
    told = []
    rows_of = [walk(f"{n}-{t}", f"c{n}", n % 7, n % 7 + 1 + t) for n in range(40) for t in range(2)]
    log.add([x for own in rows_of for x in own] + walk("open", "c3", 2, None) + [("null", None, None, "pending", 0, at(1)), ("null", None, "running", "done", 0, at(2))])
    run(processors.stream_completion(log.stream(), "1 day", buckets=2, slots=2), tmp_path, "out", told)
    done = lambda: set(map(tuple, spark.read.schema(processors.COMPLETIONS).parquet(f"{tmp_path}/out").collect()))
    assert done() == {(f"c{n}", 0, 2, 2, 0) for n in range(40) if n != 3} | {(None, 0, 1, 1, 0)}
    timers = [int(s["customMetrics"]["numRegisteredTimers"]) for p in told[:1] for s in p["stateOperators"]]
    assert all(0 < n <= 4 for n in timers)
    log.add([("open", "c3", "running", "done", 0, at(9))])
    log.add(walk("later", "z", 6000, 6001))
    run(processors.stream_completion(log.stream(), "1 day", buckets=2, slots=2), tmp_path, "out", told)
    assert ("c3", 0, 3, 3, 0) in done()
    assert [s["numRowsTotal"] for s in told[-1]["stateOperators"]] == [1, 1]  # only "z" is young
