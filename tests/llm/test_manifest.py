"""Merkle trees against plain recursion, for sizes around the runs and blocks, with tampering and odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pageloom.llm.manifest import leaf_hash, lower_letters, manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path int, at string, key string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes, fanout=16):
    """The levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout=16):
    path = []
    for level in levels[:-1]:
        low = at // fanout * fanout
        path.append(("".join(level[low:at]), "".join(level[at + 1 : low + fanout])))
        at //= fanout
    return path


def brute(rows, tampered):
    groups = {}
    for row in rows:
        groups.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    trees = {}
    for key, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[key] = own, climb([leaf(r) for r in own])
    order = sorted(trees)
    top = climb([trees[k][1][-1][0] for k in order])
    out = []
    for place, key in enumerate(order):
        own, levels = trees[key]
        for at, row in enumerate(own):
            path = siblings(levels, at) + siblings(top, place)
            node = leaf([*row[:4], row[4].translate(UPPER)]) if tampered(row) and row[4] is not None else leaf(row)
            for left, right in path:
                node = h(left + node + right)
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], h("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def built(spark, rows, tampered="false", **kw):
    docs = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA)
    fake = leaf_hash(*(lower_letters(F.col(x)) if x == "text" else F.col(x) for x in FIELDS))
    return sorted((tuple(r) for r in manifest(docs, FIELDS, "source", "doc_id", F.when(F.expr(tampered), fake), **kw).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17], [256], [257, 1], [15, 700, 33]])
def test_against_recursion(spark, sizes):
    rows = [(100 * g + 7 * i, f"s{g}", "en", i, f"Text {i} É") for g, size in enumerate(sizes) for i in range(size)]
    assert built(spark, rows, "doc_id % 5 = 0") == brute(rows, lambda r: r[0] % 5 == 0)


def test_several_rounds_and_many_groups(spark):
    rows = [(i, "hot" if i % 3 else f"g{i}", None, None, f"T{i}") for i in range(900)]
    kept = brute(rows, lambda r: r[0] % 2 == 0)
    assert built(spark, rows, "doc_id % 2 = 0") == kept
    assert built(spark, rows, "doc_id % 2 = 0", levels=1) == kept


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (3, None, "de", 4, "Ä" * 70000), (1, "é", "en", 2, None), (1, "z", "en", 2, "A")]
    rows += [(5, "z", "en", 2, "B")] * 40 + [(2, None, "x:", -4, "1:a")] * 3
    assert built(spark, rows, "doc_id IS NOT NULL") == brute(rows, lambda r: r[0] is not None)
    assert built(spark, []) == []


def test_what_is_tampered_is_told(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "Ab" if i % 2 else "ab") for i in range(60)]
    out = {r[0]: r[-1] for r in built(spark, rows, "doc_id % 5 = 0")}
    assert {i for i, fine in out.items() if not fine} == {i for i in range(60) if i % 5 == 0 and i % 2}
