"""Positions, running sums and previous values over one long order, without a one-task window.

``Window.partitionBy(key)`` puts a whole key in one task, and ``Window.orderBy`` the whole table. Here
the rows are range-partitioned on (keys, order) into slices of like size, so a key that holds a third
of all rows spans many slices. Work inside a slice is an ordinary window; what a slice has to know of
the slices before it is at most two rows per slice, which is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import stage

_SLICE, _ROW = "_slice", "_row"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _slices(df: DataFrame, order: Sequence, slices: int | None) -> DataFrame:
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id())
    # range bounds come from a sample, so slice numbers are written down before two branches use them
    return stage(numbered, "ordered").select(
        "*",
        F.shiftright("_slot", _ROW_BITS).alias(_SLICE),
        F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(_ROW),
    ).drop("_slot")


def _edges(rows: DataFrame, keys: Sequence[str], carried: Column) -> DataFrame:
    """Per slice only its first and its last key: the ones that can go on in a neighbour."""
    groups = rows.groupBy(_SLICE, *keys).agg(F.min(_ROW).alias("_head"), F.max(_ROW).alias("_tail"), carried)
    ends = rows.groupBy(_SLICE).agg(F.max(_ROW).alias("_end"))
    on_edge = (F.col("_head") == 0) | (F.col("_tail") == F.col("_end"))
    return groups.join(F.broadcast(ends), _SLICE).filter(on_edge)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, slices: int | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same keys up to and with this one.

    ``keys`` and ``order`` together must identify a row.
    """
    keys = list(keys)
    rows = _slices(df.withColumn("_value", value), [*map(F.col, keys), *order], slices)
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        _edges(rows, keys, F.sum("_value").alias("_total"))
        .select(_SLICE, *keys, F.sum("_total").over(earlier).alias("_carry"))
        .filter("_carry IS NOT NULL")
    )
    inside = Window.partitionBy(_SLICE, *keys).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_sum", F.sum("_value").over(inside))
        .join(F.broadcast(carry), [_SLICE, *keys], "left")
        .withColumn(name, F.col("_sum") + F.coalesce("_carry", F.lit(0)))
        .drop(_SLICE, _ROW, "_value", "_sum", "_carry")
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, slices: int | None = None
) -> DataFrame:
    """Add ``name``: the place of the row among the rows of the same keys, from 1."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, slices)


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, slices: int | None = None
) -> DataFrame:
    """Add ``name``: ``value`` of the row before this one among the rows of the same keys, else NULL."""
    keys = list(keys)
    rows = _slices(df, [*map(F.col, keys), *order], slices)
    carry = (
        _edges(rows, keys, F.max_by(value, _ROW).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(_SLICE)))
        .filter("_carry IS NOT NULL")
        .select(_SLICE, *keys, F.col("_head").alias(_ROW), "_carry")
    )
    inside = Window.partitionBy(_SLICE, *keys).orderBy(_ROW)
    return (
        rows.withColumn(name, F.lag(value).over(inside))
        .join(F.broadcast(carry), [_SLICE, *keys, _ROW], "left")
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop(_SLICE, _ROW, "_carry")
    )
