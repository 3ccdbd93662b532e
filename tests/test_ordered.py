"""Positions, running sums and previous values across slices, with a key that holds a third of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions.ordered import position, previous, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    chance = random.Random(7)
    data = [("hot" if n % 3 == 0 else f"k{chance.randrange(12)}", chance.randrange(50), n, chance.randrange(-5, 6))
            for n in range(900)]
    return spark.createDataFrame(data, "k STRING, at INT, n INT, v INT")


ORDER = [F.col, "at", "n"]


def _order():
    return [F.col("at").desc(), F.col("n").asc()]


@pytest.mark.parametrize("slices", [None, 1, 7, 16])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_sums_and_positions(rows, keys, slices):
    window = Window.partitionBy(*keys).orderBy(*_order())
    expected = rows.withColumn("s", F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "p", F.row_number().over(window)
    )
    got = running_sum(rows, keys, _order(), F.col("v"), "s", slices)
    assert sorted(got.collect()) == sorted(expected.drop("p").collect())
    got = position(rows, keys, _order(), "p", slices)
    assert sorted(got.collect()) == sorted(expected.drop("s").collect())


@pytest.mark.parametrize("slices", [None, 7, 16])
def test_previous(rows, slices):
    expected = rows.withColumn("b", F.lag("v").over(Window.partitionBy("k").orderBy(*_order())))
    got = previous(rows, ["k"], _order(), "v", "b", slices)
    key = lambda row: row["n"]
    assert sorted(got.collect(), key=key) == sorted(expected.collect(), key=key)


def test_hot_key_is_spread(spark, rows):
    from pageloom.functions.ordered import _SLICE, _slices

    hot = _slices(rows, [F.col("k"), *_order()], 9).filter("k = 'hot'").groupBy(_SLICE).count().collect()
    assert len(hot) >= 3
    assert max(row["count"] for row in hot) <= 200
