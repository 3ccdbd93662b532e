"""Retrieval against plain BM25 of every passage, whole results against word overlap, and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa

from pageloom.llm import decontaminate as d
from pageloom.llm import hashing
from pageloom.llm.queries import QUERIES
from pageloom.llm.tables import opened, table


def test_retrieval_loses_nothing():
    rng = random.Random(2)
    word = lambda: rng.choice("the of and to in".split()) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.4)) % 400}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(rng.randrange(1, 130)) for _ in range(70)]
    docs = [text(rng.randrange(0, 400)) for _ in range(60)]
    docs += [f"{text(rng.randrange(90))} {items[i][: rng.randrange(20, 400)]} {text(rng.randrange(90))}" for i in range(60)]
    index = d.build_index(list(range(len(items))), items, [None] * len(items))
    words, begins = hashing.words(pa.array(docs))
    found = {(r, i): s for r, i, s in d.retrieve(index, words, begins)}
    plain = {}
    for r in range(len(docs)):
        own = words[begins[r] : begins[r + 1]]
        for at in range(0, max(1, len(own)), d.STRIDE):
            terms = np.searchsorted(index.vocabulary, np.intersect1d(own[at : at + d.WINDOW], index.vocabulary))
            for s, item in enumerate(index.segment_item):
                a, b = index.segment_begins[s : s + 2]
                score = index.segment_weights[a:b][np.isin(index.segment_terms[a:b], terms)].sum()
                if score >= d.THRESHOLD:
                    plain[r, item] = max(score, plain.get((r, item), 0))
    assert found.keys() == plain.keys() and all(abs(found[k] - plain[k]) < 1e-9 for k in plain)
    assert len(found) > 60


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_query_finds_all_contained_items(spark):
    folder = "/root/testdata/sf0.01"
    items = {r.item_id: shingles(r.text) for r in table(spark, folder, "benchmark").collect()}
    expected = set()
    for r in table(spark, folder, "documents").collect():
        own = shingles(r.text)
        expected |= {(r.doc_id, i) for i, s in items.items() if len(s & own) >= 0.8 * len(s)}
    out = QUERIES["op9_decontamination"](spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in out} == expected and len(out) == len(expected) > 0


def test_edits_ends_and_odd_rows(spark):
    opened(spark)
    question = " ".join(f"q{i}" for i in range(60))
    items = [(1, question, "the answer is forty two"), (1, question, "the answer is forty two"), (2, "short one", None), (3, None, None), (4, "", ""), (None, "x1 x2 x3 x4 x5 x6", "y")]
    edited = question.replace("q30", "other")
    docs = [
        (1, f"Before {question.upper()} the answer is forty two after."), (2, edited + " The Answer is forty two"), (3, question), (4, None), (5, ""),
        (6, "short one"), (6, "short one"), (None, "a b x1 x2 x3 x4 x5 x6 y c"), (7, "w " * 300_000 + question + " the answer is forty two"),
    ]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double")
    items = spark.createDataFrame(items, "item_id long, question string, answer string")
    out = d.contaminated(docs, items)
    assert out.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    found = sorted((str(r.doc_id), str(r.item_id)) for r in out.collect())
    assert found == sorted([(str(i), "1") for i in (1, 2, 3, 7) for _ in range(2)] + [("6", "2")] * 2 + [("None", "None")])
    assert sorted((str(r.doc_id), str(r.item_id)) for r in d.contaminated(docs, items, most=2).collect()) == found
    assert d.contaminated(docs.limit(0), items).collect() == [] and d.contaminated(docs, items.limit(0)).collect() == []


def test_question_and_answer(spark):
    texts = spark.createDataFrame([("One. Two? Three!",), ("Only one.",), (None,), ("",)], "text string")
    out = [(r.question, r.answer) for r in d.question_and_answer(texts).collect()]
    assert out == [("One. Two?", "Three!"), ("Only one.", None), (None, None), ("", None)]


def test_a_slice_costs_its_own_bytes_alone():
    """The runs of one row of a batch, which are asked for of every row found, look at no other row's text."""
    texts = pa.array(["one Two three four five six", None, "", "x" * 300 + " seven\teight", "nine"] * 400)
    words, begins = hashing.words(texts)
    for row in (0, 1, 2, 3, 4, 1003, 1999):
        one = texts.slice(row, 1)
        data, bounds = hashing.bytes_of(one)
        assert data.tobytes().decode() == (one[0].as_py() or "") and bounds.tolist() == [0, len(data)]
        own, ends = hashing.words(one)
        assert own.tolist() == words[begins[row] : begins[row + 1]].tolist() and ends.tolist() == [0, len(own)]
    data, bounds = hashing.bytes_of(texts.slice(2000))
    assert len(data) == 0 and bounds.tolist() == [0]
