"""Exact top-k against all products, with ties, lengths of all sizes and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import topk
from pageloom.llm.tables import opened
from pageloom.llm.topk import Best, top_inner_products


def brute(rows, k):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(kept):
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for place, (c, b) in enumerate(kept) if place != at)  # noqa: B905
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, k):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, v string")
    return sorted(tuple(r) for r in top_inner_products(frame, F.col("vec_id") % 20 == 0, k).collect())


def test_against_all_products(spark):
    opened(spark)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2 * (1 + i % 3)) * s for s in (3, 1, 0.5, 0.2, 0.1)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_odd_rows(spark):
    opened(spark)
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (40, []), (-20, [-0.01, 0.0]), (60, [1.0, None]), (61, [float("nan")]), (62, [float("inf")]),
        (63, None), (None, [1.0]), (1, [1e6, -1e6]), (2, [3.0, 4.0, 5.0]), (80, [2.0, 1.0]), (80, [-2.0, 1.0]),
    ]
    assert found(spark, rows, 4) == brute(rows, 4)
    repeated = [(i % 50, [float(i % 7), 1.0]) for i in range(400)]
    assert found(spark, repeated, 12) == brute(repeated, 12)
    assert found(spark, [], 4) == [] and found(spark, [(20, [1.0])], 4) == [] and found(spark, [(1, [1.0])], 4) == []


def test_short_candidates_are_not_moved(spark, monkeypatch):
    opened(spark)
    moved = []
    search = topk._search
    monkeypatch.setattr(topk, "_search", lambda runs, *rest: (moved.append(runs.filter("bars IS NULL").count()), search(runs, *rest))[1])
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 30 / (1 + i) for _ in range(4)]) for i in range(9000)]
    out = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3000 == 20, 5)
    near = sorted((-sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(rows[20][1], v, strict=True)), i) for i, v in rows if i != 20)[:5]
    assert [(r.vec_id, -r.score) for r in out.filter("query_id = 20").orderBy("rank").collect()] == [(i, s) for s, i in near]
    assert 0 < moved[0] < 9


@pytest.mark.parametrize("scale", [1, 1 << 24])
def test_bounds_lose_nothing(scale):
    draws = np.random.default_rng(1)
    numbers = (draws.normal(0, 9, (4000, 16)) * np.linspace(3, 0.1, 16)).astype(np.int64) * scale
    numbers = numbers[np.argsort(-np.linalg.norm(numbers.astype(float), axis=1))]
    axes = np.linalg.svd(numbers.astype(float), full_matrices=False)[2].T
    best = Best(np.arange(50), numbers[:50], axes, 10)
    for low in range(0, 4000, 500):
        best.meet(np.arange(low, low + 500), numbers[low : low + 500])
    q, c, s = best.found
    plain = numbers[:50].astype(object) @ numbers.T.astype(object)
    for i in range(50):
        order = sorted((-plain[i][j], j) for j in range(4000) if j != i)[:10]
        assert list(zip((-s[q == i]).tolist(), c[q == i].tolist(), strict=True)) == order
