"""The pipeline's stages against plain Python on a whole small table, and on odd rows."""

import itertools
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from test_decontaminate import shingles
from test_ngram_join import brute

from pageloom.llm import quality
from pageloom.llm.queries import tokenizer_path
from pageloom.llm.tables import table
from pageloom.llm.tokens import Encoder
from pageloom.session import stage

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\r"


def plain_lines(rows):
    """rows of dicts → the same with boilerplate lines out"""
    sites = defaultdict(set)
    for r in rows:
        for line in {x.strip(SPACE) for x in (r["text"] or "").split("\n")}:
            if len(line) >= 20 and r["source"] is not None:
                sites[line].add(r["source"])
    bad = {line for line, s in sites.items() if len(s) >= 5}
    by_text = defaultdict(list)
    for r in rows:
        by_text[r["text"] or ""].append(r["source"])
    shared = {t: [x.strip(SPACE) for x in t.split("\n") if x.strip(SPACE) in bad] for t in by_text}
    shared = {t: x for t, x in shared.items() if x}
    mostly = {t for t in shared if sum(len(x) for x in t.split("\n") if x.strip(SPACE) in bad) * 100 > len(t.replace("\n", "")) * 50}
    free = defaultdict(set)
    for t in shared.keys() - mostly:
        for line in shared[t]:
            free[line] |= set(by_text[t]) - {None}
    free = {line for line, s in free.items() if len(s) >= 5}
    pairs = {t: set(itertools.pairwise([x for x in shared[t] if x not in free])) for t in mostly}
    seen = Counter(p for found in pairs.values() for p in found)
    copies = {t for t in mostly if len(by_text[t]) > 1 or any(seen[p] > 1 for p in pairs[t])}
    out = []
    for r in rows:
        t = r["text"] or ""
        gone = set(shared.get(t, ())) & (free if t in copies else bad)
        if gone:
            text = "\n".join(x for x in t.split("\n") if x.strip(SPACE) not in gone)
            r = {**r, "text": text, "n_chars": len(text)}
        out.append(r)
    return out


def test_whole_pipeline(spark):
    docs = [r.asDict() for r in table(spark, FOLDER, "documents").collect()]
    model = quality.fit_quality(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    scores = model.score(quality.features(pa.array([d["text"] for d in docs])))
    kept = [d for d, s in zip(docs, scores, strict=True) if s >= 0.3]
    assert 0 < len(kept) < len(docs)
    kept = plain_lines(kept)
    named = {int(i): c for i, _, c in brute([(d["doc_id"], d["text"]) for d in kept])}
    kept = [d for d in kept if named[d["doc_id"]] == str(d["doc_id"])]
    items = [shingles(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    kept = [d for d in kept if not any(len(s & shingles(d["text"])) >= 0.8 * len(s) for s in items)]

    frame = table(spark, FOLDER, "documents")
    for _, function in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(function(spark, frame, FOLDER), "test")
        assert frame.dtypes == before.dtypes
    key = lambda d: d["doc_id"]
    assert sorted((r.asDict() for r in frame.collect()), key=key) == sorted(kept, key=key)

    made, pieces = Encoder(tokenizer_path()), defaultdict(list)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        pieces[r.doc_id].append((r.start, r.ids))
    assert pieces.keys() == {d["doc_id"] for d in kept}
    for d in kept:
        ids = np.concatenate([x for _, x in sorted(pieces[d["doc_id"]])])
        assert np.array_equal(ids, np.append(made.whole(d["text"]), 0))


def test_line_stage_against_plain_python(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    key = lambda d: d["doc_id"]
    out = sorted((r.asDict() for r in corpus_pipeline.drop_shared_lines(spark, frame, FOLDER).collect()), key=key)
    assert out == sorted(plain_lines([r.asDict() for r in frame.collect()]), key=key)


def test_line_stage_keeps_a_column_with_the_name_of_its_count(spark):
    note = "All rights reserved by the publisher."
    frame = spark.createDataFrame([(i, f"Own words of page {i}.\n{note}", f"s{i}", "mine") for i in range(6)], "doc_id long, text string, source string, removed_lines string")
    out = corpus_pipeline.drop_shared_lines(spark, frame, FOLDER).collect()
    assert {(r.text, r.removed_lines) for r in out} == {(f"Own words of page {i}.", "mine") for i in range(6)}


def test_odd_rows_in_every_stage(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "a b c d e f g", "en", "s", 13, "x"), (1, "a b c d e f g", None, None, None, "y")]
    rows += [(None, "a b c d e f g", "en", "s", 13, None), (2, "w " * 200_000 + "end", "en", "s", 400_003, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    for part in (rows, []):
        frame = stage(spark.createDataFrame(part, schema), "test")
        for name, function in corpus_pipeline.STAGES:
            out = stage(function(spark, frame, FOLDER), "test")
            if name == "n-gram Jaccard join":
                texts = sorted(re.sub(" .*", "", r.text or "") for r in out.collect())
                assert texts == (["", "", "a", "w"] if part else [])
            elif name != "packing" and name != "quality classifier":
                assert out.count() == len(part)
        assert out.columns[0] == "doc_id" and (out.count() > 0) == bool(part)


def test_the_last_stages_take_small_batches(spark):
    """They run where the earlier ones have filled the executors; the next run's first stage has large ones again."""
    frame = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    size = lambda: int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    corpus_pipeline.drop_shared_lines(spark, frame.selectExpr("*", "'s' AS source"), FOLDER)
    assert size() == 16 << 20
    for last in (corpus_pipeline.drop_benchmarks, corpus_pipeline.pack):
        last(spark, frame, FOLDER)
        assert size() == 4 << 20
