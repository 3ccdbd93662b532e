"""Batch claims against a queue that claims one task at a time."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import claims
from pageloom.schemas import TASKS

T0 = dt.datetime(2024, 1, 1)


def make(spark, seed, tasks=60, contexts=7):
    chance = random.Random(seed)
    rows = []
    for n in range(tasks):
        context = "c0" if chance.random() < 0.4 else f"c{chance.randrange(contexts)}"
        status = chance.choice(["pending", "pending", "running", "done", "failed"])
        created = T0 + dt.timedelta(minutes=chance.randrange(20))  # many ties
        started = None if status == "pending" else T0 + dt.timedelta(hours=1, seconds=chance.randrange(10**6))
        payload = json.dumps({"object_name": f"{chance.randrange(100):04d}_p.jpg"})
        rows.append((f"t{n}", context, status, "u", payload, None, created, started, None, chance.choice(claims.TIERS)))
    return rows, spark.createDataFrame(rows, TASKS)


def age(row):
    return row[6], json.loads(row[4])["object_name"], row[0]


def one_at_a_time(rows, picks):
    """picks: a list of 'licq', 'fifo' or 'tiers'; each claim starts its context anew."""
    last = {}
    for row in rows:
        if row[7] is not None:
            last[row[1]] = max(last.get(row[1], row[7]), row[7])
    waiting = [row for row in rows if row[2] == "pending"]
    clock, taken = dt.datetime(2030, 1, 1), []
    for kind in picks:
        if not waiting:
            break
        tier = {name: place for place, name in enumerate(claims.TIERS)}
        idle = lambda row: (row[1] in last, last.get(row[1], T0))
        key = {
            "fifo": age,
            "licq": lambda row: (idle(row), age(row)),
            "tiers": lambda row: (tier[row[9]], idle(row), age(row)),
        }[kind]
        row = min(waiting, key=key)
        waiting.remove(row)
        clock += dt.timedelta(seconds=1)
        last[row[1]] = clock
        taken.append(row[0])
    return taken


def ids(frame):
    return [row["id"] for row in frame.orderBy("claim_no").collect()]


@pytest.mark.parametrize("seed", range(6))
def test_licq(spark, seed):
    rows, tasks = make(spark, seed)
    n = (3, 10, 100)[seed % 3]
    assert ids(claims.claim_licq(tasks.repartition(5), n)) == one_at_a_time(rows, ["licq"] * n)


@pytest.mark.parametrize("seed", range(6))
def test_licq_by_tier(spark, seed):
    rows, tasks = make(spark, 100 + seed)
    assert ids(claims.claim_licq(tasks, 100, claims.TIERS)) == one_at_a_time(rows, ["tiers"] * 100)


@pytest.mark.parametrize("seed", range(4))
def test_fifo_then_licq(spark, seed):
    rows, tasks = make(spark, 200 + seed)
    got = claims.claim_mixed(tasks, 5, 12).collect()
    order = [row["id"] for row in sorted(got, key=lambda row: (row["kind"], row["claim_no"]))]
    assert order == one_at_a_time(rows, ["fifo"] * 5 + ["licq"] * 12)


def test_custom_order_and_unknown_tier(spark):
    rows, tasks = make(spark, 300)
    got = ids(claims.claim_custom(tasks, 5, [F.col("created_by"), F.col("id").desc()]))
    assert got == sorted((row[0] for row in rows if row[2] == "pending"), reverse=True)[:5]
    odd = tasks.withColumn("priority", F.when(F.col("id") == got[0], "trial").otherwise(F.col("priority")))
    assert ids(claims.claim_fifo(odd, 1000, claims.TIERS))[-1] == got[0]


def test_positions_follow_fifo(spark):
    rows, tasks = make(spark, 301)
    ahead = {row["id"]: row["ahead"] for row in claims.queue_position(tasks, slices=5).collect()}
    assert sorted(ahead, key=ahead.get) == one_at_a_time(rows, ["fifo"] * 100)
