"""Mined phrases against counting everything, border failures, runs with overlap, odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

from pageloom.llm import phrases
from pageloom.llm.phrases import collocations, frequent_phrases
from pageloom.llm.tables import opened

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(rows, longest=3):
    found = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                found.update((lang or "und", size, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return found


def brute(rows, least=10, inside=50, top=2000, longest=3):
    f = counted(rows, longest)
    candidates = {k: n for k, n in f.items() if k[1] > 1 and n >= least}
    scored = {}
    for (lang, size, words), a in candidates.items():
        longer = [n for (g, m, w), n in candidates.items() if g == lang and m > size and any(w[i : i + size] == words for i in range(m - size + 1))]
        if any(100 * n >= inside * a for n in longer):
            continue
        cuts = [(f[lang, k, words[:k]], f[lang, size - k, words[k:]]) for k in range(1, size)]
        score, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        scored.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in scored.items():
        n = sum(c for (g, m, _), c in f.items() if g == lang and m == 1)
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, size int")


def mined(spark, rows, **kw):
    return sorted(tuple(r) for r in collocations(frame(spark, rows), **kw).collect())


def prose(seed, texts, vocabulary=60):
    rng = np.random.default_rng(seed)
    names = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(texts):
        picked = rng.zipf(1.3, 80) % vocabulary
        marks = rng.choice([" ", "  ", "\t", ", ", ".\n", "\r", "; x y z "], 80, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append((["en", "de", None, "und"][i % 4], "".join(names[w] + m for w, m in zip(picked, marks, strict=True))))
    return rows


def test_against_counting_everything(spark):
    opened(spark)
    rows = prose(5, 300)
    rows += [rows[0]] * 200
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, top=3) == brute(rows, top=3)


def test_longer_phrases(spark):
    opened(spark)
    rows = prose(8, 60, 12)
    assert mined(spark, rows, max_words=5) == brute(rows, longest=5)


@pytest.mark.parametrize("rate", [0.0, 0.01, 1.0])
def test_a_poor_sample_only_costs_passes(spark, rate, monkeypatch):
    opened(spark)
    rows = prose(6, 200)
    passes = []
    count = phrases.count_phrases
    monkeypatch.setattr(phrases, "count_phrases", lambda *a: passes.append(1) or count(*a))
    found = frequent_phrases(frame(spark, rows).fillna("und", ["lang"]), rate=rate)
    wanted = {(lang, size, " ".join(w)): n for (lang, size, w), n in counted(rows).items() if n >= 10}
    assert {(r.lang, r["size"], r.phrase): r.f for r in found.filter("size > 0").collect()} == wanted
    assert len(passes) == (2 if rate == 1 else 4 if rate == 0 else len(passes))  # the sample, and passes until closed


def test_a_full_bit_map_changes_nothing(spark):
    opened(spark)
    rows = prose(7, 150)
    assert mined(spark, rows, filter_bytes=8) == brute(rows)


def _counts(rows, now, before):
    import pyarrow as pa

    langs, texts = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.large_string())
    total = Counter()
    for data, run in phrases._runs(texts, phrases._seeds(langs), 2):
        for batch in phrases._counted(data, run, langs, 3, now, before, False):
            total.update(dict(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
    return total


def test_a_chance_hit_of_the_map_before_loses_nothing():
    """Phrases of a new word whose pairs the map before knew by chance alone are counted by the pass that allows them."""
    import pyarrow as pa

    def hashes(*words):
        run = next(phrases._runs(pa.array([" ".join(words)], pa.large_string()), phrases._seeds(pa.array(["en"])), 2))[1].hashes
        pairs = phrases.mix(run[:-1] * phrases._CHAIN + run[1:])
        return list(run), list(pairs)

    def mapped(found):
        bits = np.zeros(1 << 12, np.uint64)
        for place in phrases._probes(np.array(found, np.uint64), len(bits) * 64):
            np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(int), np.uint64(1) << (place & np.uint64(63)))
        return bits

    words, pairs = hashes("a", "b", "c")
    before, now = mapped([words[0], words[2], *pairs]), mapped([*words, *pairs])  # before: "b" is not known, its pairs are by chance
    rows = [("en", "a b c")] * 10
    assert _counts(rows, before, None) == {}
    assert _counts(rows, now, before) == {"a b\ten": 10, "b c\ten": 10, "a b c\ten": 10}


def test_the_border_is_counted_by_hash_and_what_is_suspect_as_text():
    import pyarrow as pa

    rows = [("en", "a b c")] * 12 + [("en", "b a")] * 2
    langs, texts = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.large_string())
    data, run = next(phrases._runs(texts, phrases._seeds(langs), 2))

    def mapped(found):
        bits = np.zeros(1 << 12, np.uint64)
        for place in phrases._probes(np.array(found, np.uint64), len(bits) * 64):
            np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(int), np.uint64(1) << (place & np.uint64(63)))
        return bits

    def counts(now, before, words_too, by_hash, resolve):
        texts, hashes = Counter(), Counter()
        for mark, _, batch in phrases._told(data, run, langs, 3, now, before, words_too, by_hash, resolve):
            (hashes if mark is None else texts).update(dict(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        return texts, {np.int64(h).view(np.uint64): n for h, n in hashes.items()}

    words, (ab, bc) = list(run.hashes[:3]), phrases.mix(run.hashes[:2] * phrases._CHAIN + run.hashes[1:3])
    ba = phrases.mix(run.hashes[1:2] * phrases._CHAIN + run.hashes[:1])[0]
    assert counts(None, None, True, True, False)[0] == {}  # the sample
    now = mapped([*words, ab])
    texts, hashes = counts(now, None, True, True, False)
    assert texts == {"a\ten": 14, "b\ten": 14, "c\ten": 12, "\ten": 40, "a b\ten": 12} and hashes == {bc: 12, ba: 2}
    texts, hashes = counts(now | mapped([bc]), now, False, False, True)
    assert texts == {"b c\ten": 12, "a b c\ten": 12} and hashes == {}


@pytest.mark.parametrize("rows", [1, 5, 1000])
def test_what_occurs_again_is_added_up_in_a_task(rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "MERGE_ROWS", rows)
    batch = pa.record_batch([pa.array([f"{n}\ten" for n in range(7)]), pa.array(range(1, 8), pa.int64())], schema=phrases._ARROW)
    hashed = pa.record_batch([pa.array([5, -6]), pa.array([1, 2])], schema=phrases._HASHED)
    total, emitted = Counter(), 0
    told = [(phrases.KNOWN, True, batch), (None, False, hashed), (phrases.NEW, False, batch.slice(2, 1)), (phrases.NEW, False, batch.slice(0, 0))]
    for out in phrases._merged(iter(told * 4)):
        emitted += out.num_rows
        for key, mark, f in zip(*(c.to_pylist() for c in out.columns), strict=True):
            total[key, mark] += f
    assert total == {**{(f"{n}\ten", phrases.KNOWN): 4 * n + 4 for n in range(7)}, (None, 5): 4, (None, -6): 8, ("2\ten", phrases.NEW): 12}
    assert rows < 1000 or emitted == 7 + 3 * 4


def test_rows_are_added_up_behind_the_shuffle_alone(spark):
    """Tasks have added up their runs: a second sum before the shuffle took most of the time."""
    opened(spark)
    docs = frame(spark, [("en", "a b c")] * 3).select("lang", "text")
    plan = phrases.count_phrases(docs, 3, None, None, True, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") and "HashAggregate" not in plan[plan.index("Exchange") :]


def test_regular_long_words_are_told_apart(spark):
    opened(spark)
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [("en", f"{word} q, {other} q, {other} Q")] * 12
    assert mined(spark, rows) == brute(rows)


def test_runs_and_steps_overlap(spark, monkeypatch):
    """A long text is counted in runs, cut anywhere, each beginning with the last words of the one before."""
    import pyarrow as pa

    monkeypatch.setattr("pageloom.llm.hashing._STEP", 64)
    rows = [("en", " ".join(t for _, t in prose(9, 30))), ("en", ""), ("en", "a b c d"), ("de", "a b c d"), ("de", "x" * 500)]
    langs, texts = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.large_string())
    total = Counter()
    for data, run in phrases._runs(texts, phrases._seeds(langs), 2, run_words=50):
        for batch in phrases._counted(data, run, langs, 3, None, None, True):
            for key, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                phrase, lang = key.split("\t", 1)
                if phrase:
                    total[lang, phrase.count(" ") + 1, tuple(phrase.split(" "))] += f
    assert total == counted(rows)


def test_odd_tables(spark):
    opened(spark)
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("en", ""), ("en", " \t. ,\n")]) == []
    many = [(None, "a b")] * 10 + [("und", "A  b")] * 5
    assert mined(spark, many) == [("und", 1, "a b", 15, 15, 15, 30, 1000000)]
    ties = [("en", "b c. a b. b a")] * 12
    assert mined(spark, ties) == brute(ties)
    one = [("en", "the the " * 5000)]
    assert mined(spark, one) == brute(one)


def test_products_beyond_64_bits(spark):
    counts = "lang string, size int, phrase string, f long"
    big = 3_000_000_000_000
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 3), ("en", 2, "a b", big - 11)]
    found = phrases.frequent_phrases
    try:
        phrases.frequent_phrases = lambda *a, **k: spark.createDataFrame(rows, counts)
        out = collocations(frame(spark, []))
    finally:
        phrases.frequent_phrases = found
    assert [r.score for r in out.collect()] == [1000000 * (big - 11) ** 2 // ((big + 7) * (big + 3))]
