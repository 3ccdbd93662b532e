"""Which pending tasks to work on next, n at a time.

A queue that claims one task at a time and looks again after each claim is expressed as one ordering:
pending tasks are numbered inside their context (the round), contexts get rank keys from when they were
last worked on, and a claim of n is the first n rows by (round, rank keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.ordered import position

# Priority tiers, the one that is served first leading.
TIERS = ("enterprise", "premium", "standard")
# Ways a context's rows are split before its first n are taken; a context that holds a third of the
# queue is then cut down by this many tasks in place of one.
SALTS = 32


def page_order() -> list[Column]:
    """Queue order. Tasks of one upload share created_at, so the object name decides inside it."""
    return [F.col("created_at"), F.get_json_object("payload", "$.object_name"), F.col("id")]


def _pending(tasks: DataFrame) -> DataFrame:
    created, name, task_id = page_order()
    return tasks.filter("status = 'pending'").select(
        "context_id", "priority", created.alias("created_at"), name.alias("object_name"), task_id.alias("id")
    )


def _age() -> list[Column]:
    return [F.col("created_at"), F.col("object_name"), F.col("id")]


def _take(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows, numbered. The window without keys sees these n rows only."""
    first = rows.orderBy(*order).limit(n)
    return first.withColumn("claim_no", F.row_number().over(Window.orderBy(*order)).cast("long"))


def tier_of(priority: Column, tiers: Sequence[str] = TIERS) -> Column:
    """0 for the tier served first; unknown tiers come last."""
    place = F.array_position(F.array(*map(F.lit, tiers)), priority).cast("int")
    return F.when(place > 0, place - 1).otherwise(len(tiers))


def claim_custom(tasks: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First n pending tasks by the caller's sort keys, queue order deciding ties."""
    pending = tasks.filter("status = 'pending'")
    claimed = _take(pending, [*order, *page_order()], n)
    return claimed.select("claim_no", "id", "context_id")


def claim_fifo(tasks: DataFrame, n: int, tiers: Sequence[str] | None = None) -> DataFrame:
    """Oldest pending tasks; with ``tiers`` the tier decides before age."""
    lead = [tier_of(F.col("priority"), tiers)] if tiers else []
    return _take(_pending(tasks), [*lead, *_age()], n).select("claim_no", "id", "context_id")


def _first_per_context(pending: DataFrame, n: int) -> DataFrame:
    """Pending rows with their round in (tier, context), as far as a claim of n can need them."""
    salted = pending.withColumn("_salt", F.spark_partition_id() % SALTS)
    place = F.row_number().over(Window.partitionBy("tier", "context_id", "_salt").orderBy(*_age()))
    cut = salted.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place", "_salt")
    rounds = F.row_number().over(Window.partitionBy("tier", "context_id").orderBy(*_age()))
    return cut.withColumn("round", rounds).filter(F.col("round") <= n)


def claim_licq(
    tasks: DataFrame, n: int, tiers: Sequence[str] | None = None, after: DataFrame | None = None
) -> DataFrame:
    """Next n tasks by longest-idle context.

    The context whose latest start is oldest, or that never started, goes first; each claim makes its
    context the most recent one. ``tiers`` are served one after the other, and a context served in an
    earlier tier counts as just worked on in the next. ``after`` (claim_no, context_id) are claims made
    just before on the same snapshot.
    """
    names = list(tiers or ())
    tier = tier_of(F.col("priority"), names) if names else F.lit(0)
    pending = _pending(tasks).withColumn("tier", tier)
    is_pending = F.col("status") == "pending"
    waiting = [
        F.count_if(is_pending & (tier == place)).alias(f"waiting_{place}") for place in range(len(names))
    ]
    # numbers and times only, so the whole table goes through a hash aggregate
    contexts = tasks.groupBy("context_id").agg(F.max("started_at").alias("last_started"), *waiting)
    if after is not None:
        served = after.groupBy("context_id").agg(F.max("claim_no").alias("served"))
        # as many rows as the earlier claim asked for
        contexts = contexts.join(F.broadcast(served), "context_id", "left")
    else:
        contexts = contexts.withColumn("served", F.lit(None).cast("long"))

    # contexts served in an earlier tier follow the others, in the order of their last turn there
    turns = [
        F.when(F.col("tier") > place, F.col(f"waiting_{place}")).otherwise(0) for place in reversed(range(len(names)))
    ]
    order = [
        F.col("tier"),
        F.col("round"),
        *turns,
        F.col("served").asc_nulls_first(),
        F.col("last_started").asc_nulls_first(),
        F.col("oldest"),
    ]
    in_context = Window.partitionBy("context_id").orderBy("tier", *_age())
    oldest = F.first(F.struct("tier", *_age())).over(in_context)
    rows = _first_per_context(pending, n).withColumn("oldest", oldest).join(contexts, "context_id")
    return _take(rows, order, n).select("claim_no", "id", "context_id")


def claim_mixed(tasks: DataFrame, n_fifo: int, n_licq: int) -> DataFrame:
    """A FIFO claim and then a longest-idle claim on what is left, as two kinds of worker share a queue."""
    fifo = claim_fifo(tasks, n_fifo)
    rest = tasks.join(F.broadcast(fifo.select("id")), "id", "left_anti")  # n_fifo rows
    licq = claim_licq(rest, n_licq, after=fifo)
    return fifo.withColumn("kind", F.lit("fifo")).unionByName(licq.withColumn("kind", F.lit("licq")))


def queue_position(tasks: DataFrame, slices: int | None = None) -> DataFrame:
    """How many pending tasks precede each, first in first out."""
    placed = position(_pending(tasks), [], _age(), "_place", slices)
    return placed.select("id", "context_id", (F.col("_place") - 1).alias("ahead"))
