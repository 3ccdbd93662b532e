"""Held-out accuracy, the quantile cut, and odd rows."""

import numpy as np
import pyarrow as pa

from pageloom.llm.quality import CUT, FEATURES, features, fit_pairs, fit_quality, score_quality
from pageloom.llm.queries import QUERIES
from pageloom.llm.tables import opened, table


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op4_quality_classifier"](spark, folder).join(table(spark, folder, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    right = np.mean([r.predicted == r.quality for r in held])
    assert len(held) > 30 and right > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= CUT) for r in rows)


def test_order_of_two_worths_and_the_cut():
    draws = np.random.default_rng(3)
    good, bad = draws.normal(0.3, 1, (900, FEATURES)), draws.normal(-0.3, 1, (300, FEATURES))
    model = fit_pairs(good, bad, 0.25)
    scores = np.concatenate([model.score(good), model.score(bad)])
    assert abs((scores < CUT).mean() - 0.25) < 0.02 and model.score(good).mean() > model.score(bad).mean() + 0.5
    assert np.allclose(fit_pairs(good[:0], bad, 1.0).score(good), 0.5)


def test_features_of_odd_texts():
    rows = features(pa.array([None, "", " \n", "a", "A!" * 500_000, "é" * 10]))
    assert np.isfinite(rows).all() and not rows[:2].any() and rows[4].any()


def test_odd_tables(spark):
    opened(spark)
    docs = spark.createDataFrame(
        [(1, "good words here", "x"), (1, "good words here", "x"), (2, None, "y"), (None, "", "y"), (3, "BAD!! BAD!!", "z")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    out = score_quality(docs, model)
    scores = {r.doc_id: r.score for r in out.collect()}
    assert out.columns == ["doc_id", "text", "score"] and len(out.collect()) == 5 and scores[1] > scores[3]
    assert score_quality(docs.limit(0), model).collect() == []
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}


def test_all_labels_are_learned_from(spark):
    """Groups of labelled documents give the model of all of them, of a rare kind too; no label is left out."""
    opened(spark)
    draws = np.random.default_rng(4)
    texts = [("word " if i % 9 else "!! ") * int(draws.integers(1, 30)) + "x" * int(draws.integers(0, 9)) for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 > 0 if i % 50 else i % 9 == 0)) for i in range(900)], "doc_id long, quality int")
    whole, parted = fit_quality(docs, labels), fit_quality(docs, labels, most=100)
    rows = features(pa.array(texts))
    assert np.corrcoef(whole.score(rows), parted.score(rows))[0, 1] > 0.99
    bad = labels.filter("quality = 0").count() / 900
    assert abs((parted.score(rows) < CUT).mean() - bad) < 0.02
    # labels beyond the first 100 by hash change the model
    turned = labels.selectExpr("doc_id", "IF(doc_id >= 600, 1 - quality, quality) AS quality")
    assert abs(fit_quality(docs, turned, most=100).weights - parted.weights).max() > 0.1
    one = labels.selectExpr("doc_id", "int(doc_id > 0) AS quality")
    assert np.isfinite(fit_quality(docs, one, most=100).weights).all() and fit_quality(docs, one, most=100).weights.any()
