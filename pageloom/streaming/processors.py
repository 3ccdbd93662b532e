"""Keyed state with an end: completions that count their own totals, and alerts on event-time timers.

State is one value per key and read and written once per batch. A hot context is spread over ``buckets`` keys by task; what the
buckets say is added up per context from at most one row a bucket and batch. Completions keep the values of many keys in one of
``slots`` maps, as calling the processor costs more than a key's own work: a slot is called once per batch and reads and writes the values of that batch's keys alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDED = ("done", "failed")
BUCKETS = 8
SLOTS = 1024
SWEEPS = 4  # timers per slot and delay

# inside the processors a generation is a string: pandas has no null in a column of numbers
_DELTAS = "context_id STRING, generation STRING, opened BIGINT, done BIGINT, failed BIGINT, ts TIMESTAMP"
_TOLD = "context_id STRING, generation STRING, total BIGINT, done BIGINT, failed BIGINT"
COMPLETIONS = "context_id STRING, generation BIGINT, total BIGINT, done BIGINT, failed BIGINT"
ALERTS = "task_id STRING, context_id STRING, started_at TIMESTAMP"


class _Ending(StatefulProcessor):
    """Values by (context, generation), each due at its latest row: when no row of its time can come any more, ``over`` drops the value.

    A slot has a timer at every multiple of ``grain`` milliseconds that follows a due time, so a value goes at most that much later.
    """

    layout = ""
    empty: tuple = ()
    says: tuple = ()

    def __init__(self, grain: int):
        self.grain = grain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "context_id STRING, generation STRING", f"{self.layout}, due BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[tuple, list[tuple]] = {}
        for frame in rows:
            of, told = frame.columns[1:3], frame.columns[3:]  # after the slot
            keys = zip(*(frame[x].tolist() for x in of), strict=True)
            for one, row in zip(keys, zip(*(frame[x].tolist() for x in told), strict=True), strict=True):
                arrived.setdefault(one, []).append(row)
        timers, found = set(), []
        for of, own in arrived.items():
            *value, due = self.values.getValue(of) or (*self.empty, 0)
            own.sort(key=itemgetter(-1))
            value, told = self.add(value, own)
            due = max(own[-1][-1] // 1000 + 1, due)
            self.values.updateValue(of, (*value, due))
            timers.add(-(-due // self.grain) * self.grain)
            if told:
                found.append((*of, *told))
        for timer in timers.difference(self.handle.listTimers()):
            self.handle.registerTimer(timer)
        if found:
            yield pd.DataFrame(found, columns=self.says)

    def add(self, value: list, rows: list[tuple]) -> tuple[tuple, tuple | None]:
        """The value with a key's rows, which end in their time and its microseconds and are in its order, and what is to be said of them."""
        raise NotImplementedError

    def over(self, value: list) -> bool:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for of in [of for of, (*value, due) in self.values.iterator() if due <= now and self.over(value)]:
            self.values.removeKey(of)
        yield from ()

    def close(self) -> None:
        pass


class _Tally(_Ending):
    """Per (context, generation, bucket): tasks newly opened and newly ended, each once however often it is reported."""

    layout = "opened ARRAY<STRING>, done ARRAY<STRING>, failed ARRAY<STRING>"
    empty = ((), (), ())
    says = ("context_id", "generation", "opened", "done", "failed", "ts")

    def add(self, value: list, rows: list[tuple]) -> tuple[tuple, tuple | None]:
        sets = [set(x) for x in value]
        before = [len(x) for x in sets]
        for task, status, *_ in rows:
            if status == "pending":
                sets[0].add(task)
            elif task not in sets[1] and task not in sets[2]:
                sets[ENDED.index(status) + 1].add(task)
        new = [len(x) - n for x, n in zip(sets, before, strict=True)]
        return tuple(sorted(x) for x in sets), (*new, rows[-1][-2]) if any(new) else None

    def over(self, value: list) -> bool:
        return not set(value[0]) - set(value[1]) - set(value[2])


class _Complete(_Ending):
    """Per (context, generation): one row when as many tasks have ended as were opened."""

    layout = "total BIGINT, done BIGINT, failed BIGINT, told BOOLEAN"
    empty = (0, 0, 0, False)
    says = ("context_id", "generation", "total", "done", "failed")

    def add(self, value: list, rows: list[tuple]) -> tuple[tuple, tuple | None]:
        total, done, failed, told = value
        for opened, new, lost, *_ in rows:
            total, done, failed = total + opened, done + new, failed + lost
        due = not told and total > 0 and done + failed == total
        return (total, done, failed, told or due), (total, done, failed) if due else None

    def over(self, value: list) -> bool:
        return value[3] or not value[0]


def stream_completion(changes: DataFrame, delay: str, buckets: int = BUCKETS, slots: int = SLOTS) -> DataFrame:
    """Contexts whose last open task has ended: (context_id, generation, total, done, failed), each (context, generation) once (append mode).

    A generation's total is the number of tasks that became pending in it, as the stream itself says: new ones in generation 0, retried ones in
    later ones. The tasks of a submission must not be split over batches by tasks that end in between. Ends may come before their task's opening;
    repeats count nothing. ``delay`` says how late a change may come; state of what is complete goes when it has passed, at most a quarter of
    it later, so only open tasks are remembered for longer. A checkpoint keeps to the ``buckets`` and ``slots`` it began with.
    """
    told = changes.filter(F.col("status").isin("pending", *ENDED)).withWatermark("ts", delay)
    millis = changes.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {delay})").head()[0]
    grain = max(millis // SWEEPS, 1)
    slot = lambda *of: F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int").alias("slot")
    at = F.unix_micros("ts").alias("at")
    generation = F.col("generation").cast("string").alias("generation")
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets))
    keyed = told.select(slot("context_id", "generation", bucket), "context_id", generation, "task_id", "status", "ts", at)
    tallied = keyed.groupBy("slot").transformWithStateInPandas(_Tally(grain), _DELTAS, "Append", "EventTime", eventTimeColumnName="ts")
    summed = tallied.select(slot("context_id", "generation"), *tallied.columns, at)
    found = summed.groupBy("slot").transformWithStateInPandas(_Complete(grain), _TOLD, "Append", "EventTime")
    return found.withColumn("generation", F.col("generation").cast("long"))


class _Overdue(StatefulProcessor):
    """Per (context, bucket): the starts that wait for an end, and a timer for the earliest."""

    def __init__(self, limit: int):
        self.limit = limit  # all times in microseconds, but for timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "tasks ARRAY<STRING>, starts ARRAY<BIGINT>, answers ARRAY<BIGINT>, timer BIGINT")

    def _read(self) -> tuple[list[tuple[str, int, int | None]], int | None]:
        known = self.open.get()
        if known is None:
            return [], None
        return [(t, s, a) for t, s, a in zip(known[0], known[1], known[2], strict=True)], known[3]

    def _write(self, runs: list[tuple[str, int, int | None]], timer: int | None) -> None:
        due = min((start for _, start, _ in runs), default=None)
        due = None if due is None else (due + self.limit) // 1000 + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if runs:
            self.open.update(([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], due))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        runs, timer = self._read()
        by_task: dict[str, list[list]] = {}
        for task, start, answer in runs:
            by_task.setdefault(task, []).append([start, answer])
        arrived = sorted((row.at, row.status != "running", row.task_id) for row in rows)
        for at, _, task in (x for x in arrived if not x[1]):
            if all(start != at for start, _ in by_task.setdefault(task, [])):
                by_task[task].append([at, None])
        # a run is answered by the task's first later start or end; answers without a start are of runs long decided
        for at, ended, task in arrived:
            for run in by_task.get(task, ()):
                if (at >= run[0] if ended else at > run[0]) and (run[1] is None or at < run[1]):
                    run[1] = at
        self._write([(task, *run) for task, own in by_task.items() for run in own], timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        runs, timer = self._read()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = [r for r in runs if r[1] + self.limit < passed]
        # a timer that has fired is gone; the next one is for the earliest start that is left
        self._write([r for r in runs if r[1] + self.limit >= passed], None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        for task, start, answer in due:
            if answer is None or answer > start + self.limit:
                yield Row(task_id=task, context_id=key[0], at=start)

    def close(self) -> None:
        pass


def stream_stale(changes: DataFrame, minutes: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Starts that neither an end nor a new start follows within ``minutes``: (task_id, context_id, started_at), append mode.

    A timer per key fires when the watermark, the slower of those of starts and ends, has passed the earliest start's limit; the start's state
    goes with it.
    """
    parts = []
    for kind in (F.col("status") == "running", F.col("status").isin(*ENDED)):
        part = changes.filter(kind).withWatermark("ts", delay)
        parts.append(part.select("task_id", "context_id", "status", "ts", F.unix_micros("ts").alias("at")))
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = parts[0].unionByName(parts[1]).withColumn("bucket", bucket)
    found = keyed.groupBy("context_id", "bucket").transformWithState(
        _Overdue(minutes * 60_000_000), "task_id STRING, context_id STRING, at BIGINT", "Append", "EventTime"
    )
    return found.select("task_id", "context_id", F.timestamp_micros("at").alias("started_at"))
