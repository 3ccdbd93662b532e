"""The grouped prefix join against all pairs, and its defined results on odd rows."""

import random
import re

from pageloom.llm.components import components
from pageloom.llm.ngram_join import _possible, frequent_shingles, ngram_join
from pageloom.llm.tables import opened


def brute(rows, size=5, percent=80):
    """(id, text) → sorted (id, n, component) by comparing every pair."""
    sets = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[find(i)] = min(key, names.get(find(i), key))
    return sorted(
        (str(key), len(sets[i]), str(names.get(find(i)) if sets[i] else key)) for i, (key, _) in enumerate(rows)
    )


def joined(spark, rows, schema="doc_id long, text string"):
    frame = ngram_join(spark.createDataFrame(rows, schema))
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in frame.collect())


def family(rng, base, copies, edits):
    for _ in range(copies):
        words = base.split()
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def test_families_against_all_pairs(spark):
    opened(spark)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("the of and a in to".split()) if rng.random() < 0.5 else f"x{rng.randrange(500)}" for _ in range(n))
    passage = text(50)
    texts = []
    for _ in range(8):
        texts += family(rng, text(rng.randrange(20, 200)), 12, 8)
    texts += [text(rng.randrange(1, 40)) + " " + passage for _ in range(60)]
    texts += [texts[0]] * 40 + [text(30) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    opened(spark)
    rows = [
        (7, None), (8, ""), (9, " \t\n "), (3, "one two"), (4, "ONE\x0btwo"), (5, "One two"), (None, "one two"),
        (6, "one"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "É a b c d e"), (None, "É a b c d e"), (None, None),
        (11, "x " * 300_000 + "y"), (12, "X " * 300_000 + "y"), (13, "z" * 3_000_000),
    ]
    assert joined(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    opened(spark)
    assert joined(spark, []) == []
    frame = spark.createDataFrame([(1, "a b c d e f", 5, 6)], "doc_id long, text string, n_shingles int, component_id int")
    assert [tuple(r) for r in ngram_join(frame).select("doc_id", "n_shingles", "component_id").collect()] == [(1, 2, 1)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1300), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_the_list_of_frequent_shingles_holds_what_repeats(spark):
    """All that 65,536 places leave out would stand in prefixes and be joined; a shorter list takes the most frequent first."""
    opened(spark)
    words = " ".join(f"w{i}" for i in range(70_004))
    often = "some words that very often come again"
    rows = [(f"{words} {i}",) for i in range(3)] + [(f"{often} {i}",) for i in range(7)]
    texts = spark.createDataFrame(rows, "text string").coalesce(1)
    every = frequent_shingles(texts).tolist()
    assert len(every) == len(set(every)) == 70_003
    short = frequent_shingles(texts, most=1_000).tolist()
    assert short[-3:] == every[-3:] and 900 < len(short) <= 1_000 and set(short) <= set(every)
    assert len(frequent_shingles(texts.limit(0))) == 0


def test_pairs_are_not_written_out_by_class(spark):
    """A class of a large group is in very many pairs; their prefixes are looked up once a class."""
    pairs = spark.createDataFrame([(a, b) for b in range(9) for a in range(b)], "a long, b long")
    for common, kept in (([1, 2], 36), ([1], 0)):
        rows = spark.createDataFrame([(i, 5, [*common, i + 10]) for i in range(9)], "cls long, n long, prefix array<long>")
        found = _possible(rows, pairs, 80)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == kept
