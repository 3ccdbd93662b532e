"""Counts after edits against encoding the whole edited text, how little is encoded again, and odd rows."""

import random

import numpy as np

import pytest

from pageloom.llm.edit_counts import _counts, apply_edits, build_trees, edited_counts, leaves, tree_of
from pageloom.llm.queries import PERSONAL, QUERIES, tokenizer_path
from pageloom.llm.tables import opened, table
from pageloom.llm.tokens import Encoder


@pytest.fixture(scope="module")
def made():
    return Encoder(tokenizer_path())


def test_random_edits(made):
    rng = random.Random(8)
    bits = [" ", "  ", "\n", " a", "word", "'", "s", "'ll", "1", "23", "!", ", ", ".", "é", "\t", " The", "漢"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(n))
    for _ in range(400):
        before = text(rng.randrange(0, 200))
        begins = np.array(leaves(before, 8), dtype=np.int32)
        parts = [before[a:b] for a, b in zip(begins, [*begins[1:], len(before)])]  # noqa: B905
        tree = tree_of(_counts(made, parts))
        assert tree[1] == len(made.whole(before))
        marks = sorted(rng.sample(range(len(before) + 1), min(len(before) + 1, 2 * rng.randrange(1, 5)) // 2 * 2))
        edits = [(a, b, text(rng.randrange(4))) for a, b in zip(marks[::2], marks[1::2], strict=True)]
        after, at = "", 0
        for a, b, by in edits:
            after, at = after + before[at:a] + by, b
        after += before[at:]
        out, _ = apply_edits(before, begins, tree, edits, lambda x: _counts(made, x))
        assert out == after and tree[1] == len(made.whole(after)), (before, edits)
        assert (tree[1 : len(tree) // 2] == tree[2 : 2 * (len(tree) // 2)].reshape(-1, 2).sum(axis=1)).all()


def test_only_touched_regions_are_encoded(made):
    text = " ".join(f"word{i}" for i in range(20_000))
    begins = np.array(leaves(text), dtype=np.int32)
    tree = tree_of(_counts(made, [text[a:b] for a, b in zip(begins, [*begins[1:], len(text)])]))  # noqa: B905
    _, again = apply_edits(text, begins, tree, [(90_000, 90_003, "x")], lambda x: _counts(made, x))
    assert 0 < again < 800


def test_odd_rows(spark, made):
    opened(spark)
    rows = [
        (1, "a b c", [(2, 3, "x y")]), (1, "a b c", [(2, 3, "x y")]), (None, "a b", None), (2, None, [(0, 0, "new text")]), (3, "", []),
        (4, "abc def", [(-5, 2, None), (1, 4, "lost"), None, (5, 99, "!")]), (5, "w " * 300_000 + "end", [(7, 8, "\n")]), (6, "abc", [(9, 9, "z")]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>")
    trees = build_trees(docs, tokenizer_path())
    out = {r.doc_id: r for r in edited_counts(trees, tokenizer_path()).collect()}
    texts = {1: "a x y c", None: "a b", 2: "new text", 3: "", 4: "c d!", 5: "w w w w\nw " + "w " * 299_995 + "end", 6: "abc"}
    texts[5] = ("w " * 300_000 + "end")[:7] + "\n" + ("w " * 300_000 + "end")[8:]
    assert {k: r.text for k, r in out.items()} == texts
    assert all(r.tokens_after == len(made.whole(r.text)) for r in out.values()) and out[4].edits_applied == 2
    assert edited_counts(trees, tokenizer_path()).count() == 8
    assert edited_counts(build_trees(docs.limit(0), tokenizer_path()), tokenizer_path()).collect() == []


def test_query_against_whole_encoding(spark, made):
    import re

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    out = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, folder).collect()}
    assert out.keys() == texts.keys() and any(r.edits_applied for r in out.values())
    for name, text in texts.items():
        assert out[name].tokens_before == len(made.whole(text))
        spans = sorted((m.start(), m.end(), by) for p, by in PERSONAL for m in re.finditer(p, text))
        if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):  # noqa: B905
            for a, b, by in reversed(spans):
                text = text[:a] + by + text[b:]
            assert out[name].tokens_after == len(made.whole(text))
