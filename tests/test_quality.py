"""Scores of short texts, counted by hand."""

import json

import pytest
from pyspark.sql import functions as F

from pageloom.functions.text import normalise_text
from pageloom.operators import quality
from pageloom.plans.evaluate import evaluate
from pageloom.sources import evaljson


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a \n\n b\t\r\n", "a\n b"),
        ("x  y\u0085z \x0b w", "x  y\nz\n w"),
        ("one\x1ctwo \x1d\x1ethree\x1f", "one\ntwo\nthree"),
        ("", ""),
        (" \n\t", ""),
        ("café \u3000\nend", "café\nend"),
        ("\r\r\na", "a"),
    ],
)
def test_normalise(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "text STRING")
    assert frame.select(normalise_text(F.col("text"))).first()[0] == expected


GOLD = {
    "same": "A page, as it is.",
    "marks": "One, two — three's company; four.",
    "case": "The Sea\n\nThe sky, the Land",
    "none": "no marks here",
    "empty": "",
    "unread": "never transcribed.",
}
OUTPUT = {
    "same": "A page, as it is.",
    "marks": "One,, two - threes company; four.",
    "case": "the Sea\nThe sky , the Land\n\n",
    "none": "no marks her",
    "empty": "?",
    "extra": "x",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "key STRING, text STRING")


def test_scores(spark):
    got = {row["key"]: row for row in evaluate(frame(spark, GOLD), frame(spark, OUTPUT)).collect()}
    assert set(got) == set(GOLD) & set(OUTPUT)
    assert got["same"]["distance"] == 0 and got["same"]["passed"]
    # a comma more, the dash replaced, the apostrophe gone
    marks = got["marks"]
    assert (marks["distance"], marks["kept"], marks["missing"], marks["added"]) == (3, 3, 2, 2)
    assert marks["recall"] == pytest.approx(60) and marks["precision"] == pytest.approx(60) and not marks["passed"]
    case = got["case"]
    assert case["gold_chars"] == len("The Sea\nThe sky, the Land") and case["distance"] == 2
    assert (case["kept"], case["missing"], case["added"]) == (1, 0, 0)
    assert got["none"]["recall"] is None and got["none"]["precision"] is None
    assert got["none"]["cer"] == pytest.approx(1 / 13)
    assert got["empty"]["cer"] is None and got["empty"]["distance"] == 1


def test_pairing(spark):
    got = quality.pair_eval(frame(spark, GOLD), frame(spark, OUTPUT)).collect()
    assert {row["key"]: row["pairing"] for row in got if row["pairing"] != "paired"} == {
        "unread": "gold only", "extra": "output only"}


def test_eval_json_files(spark, tmp_path):
    records = spark.createDataFrame(
        [("a/1", "p.jpg", 'two\nlines "q" é'), ("b", None, "x")], "key STRING, image STRING, text STRING"
    )
    assert evaljson.eval_json(records, 0).count() == 1
    assert {len(row["shard"]) for row in evaljson.eval_json(records).collect()} == {evaljson.SHARD_DIGITS}
    for digits in (0, 1, 4):
        path = str(tmp_path / f"s{digits}")
        evaljson.write_eval_json(records, path, digits)
        assert sorted(evaljson.read_eval_json(spark, path).collect()) == sorted(records.collect())
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty" / "gold.json").write_text('{\n  "k": {\n    "image": "i.jpg",\n    "text": "t"\n  }\n}')
    assert evaljson.read_eval_json(spark, str(tmp_path / "pretty"), whole_file=True).collect() == [("k", "i.jpg", "t")]


def test_eval_json_objects_are_bounded(spark, tmp_path):
    records = spark.createDataFrame([(f"k{i:03}", None, str(i)) for i in range(250)], "key STRING, image STRING, text STRING")
    objects = [json.loads(row["json"]) for row in evaljson.eval_json(records, 0, 100).collect()]
    assert sorted(len(x) for x in objects) == [50, 100, 100]
    assert sorted(key for x in objects for key in x) == [f"k{i:03}" for i in range(250)]
    evaljson.write_eval_json(records, str(tmp_path / "bounded"), 0, 100)
    assert sorted(evaljson.read_eval_json(spark, str(tmp_path / "bounded")).collect()) == sorted(records.collect())
