"""Fingerprints: equality by roots, likeness by runs, places of edits, neighbours across ranges, odd rows."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import fingerprints as fp
from pageloom.llm.queries import QUERIES
from pageloom.llm.tables import opened, table


def told(*texts):
    return fp.fingerprints(pa.array(texts, pa.large_string()))


def prose(seed, count=900):
    rng = random.Random(seed)
    marks = [" "] * 12 + ["\n", "\n\n"]
    return "".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) + rng.choice(marks) for _ in range(count))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\tÉ", max_size=40), min_size=2, max_size=6))
def test_equal_texts_alone_have_equal_fingerprints(texts):
    found = told(*texts)
    for a, x in zip(texts, found, strict=True):
        for b, y in zip(texts, found, strict=True):
            near = fp.likeness(x, y)
            assert (x == y) == (a == b) == (near == 1.0) and 0 <= near <= 1 and near == fp.likeness(y, x)
    assert found == [told(x)[0] for x in texts]  # whatever stands in the same batch


def test_likeness_follows_what_is_shared():
    whole, other = prose(1), prose(2)
    half = whole[: len(whole) // 2]
    near = [fp.likeness(*told(whole, x)) for x in (whole + " end", whole[:-400] + other[:400], half, half + other[: len(half)], other)]
    assert near == sorted(near, reverse=True) and near[0] > 0.9 and 0.35 < near[3] < 0.65 and near[4] < 0.05


def test_levels_of_unlike_sizes_compare():
    whole = prose(3, 12000)
    small = whole[:2500]
    levels = [x[64] for x in told(whole, small)]
    assert levels[0] > levels[1] and 0 < fp.likeness(*told(whole, small)) < 0.3


def test_one_word_over_and_over():
    a, b = told("so " * 30000, "so " * 15000 + "no " * 15000)
    assert len(a) < 1000 and 0.2 < fp.likeness(a, b) < 0.9


def test_edits_are_located():
    lines = [f"line {i} of the text" for i in range(400)]
    after = [*lines[:50], "new", *lines[50:200], *lines[203:390], "changed", *lines[391:]]
    before, then = "\n".join(lines), "\n".join(after)
    assert fp.edited_paragraphs(before, before) == []
    assert [(lines[a:b], after[c:d]) for a, b, c, d in fp.edited_paragraphs(before, then)] == [
        ([], ["new"]), (lines[200:203], []), ([lines[390]], ["changed"])
    ]


@settings(max_examples=60, deadline=None)
@given(st.text("ab\n", max_size=60), st.text("ab\n", max_size=60))
def test_outside_the_edits_paragraphs_agree(before, after):
    one, other = before.split("\n"), after.split("\n")
    left = right = 0
    for a, b, c, d in fp.edited_paragraphs(before, after):
        assert one[left:a] == other[right:c]
        left, right = b, d
    assert one[left:] == other[right:]


def brute(rows):
    """Of (id, text) rows whose order is total."""
    out = []
    for i, (key, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        edited = text[: len(text) - len(text) // 2] + follow[: len(text) // 2]
        a, b, c = told(text, edited, follow)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_on_a_whole_table(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in table(spark, folder, "documents").collect())
    assert sorted(map(tuple, QUERIES["op12_fingerprints"](spark, folder).collect())) == brute(docs)


@pytest.mark.parametrize("rows", [[], [(1, "alone it is")], [(None, "x y"), (2, None), (3, ""), (4, "É é " * 9), (9, "w " * 300000)]])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_odd_rows(spark, rows, partitions):
    opened(spark)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame([(*r, "p", True) for r in rows], "doc_id long, text string, part string, head boolean")
        got = sorted((tuple(r) for r in fp.compare_with_edits(docs).collect()), key=lambda r: (r[0] is not None, r[0]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == brute(rows)


def test_repeated_rows_and_hot_ids(spark):
    opened(spark)
    rows = [(7, f"text {i % 3}") for i in range(600)] + [(8, "other")] * 5
    out = fp.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 605 and sum(r.near_next == 1.0 for r in out) >= 600 - 3
