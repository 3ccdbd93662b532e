"""A round of work from claim to transcript, and the sinks."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from pageloom.operators import inference, lifecycle
from pageloom.operators.merge import merge_transcripts
from pageloom.plans.process import advance, process_round
from pageloom.schemas import TASKS
from pageloom.sources import evaljson, objects
from pageloom.sources.versions import Conflict, VersionedTable

T = dt.datetime(2024, 1, 1)


def test_two_rounds(spark, tmp_path):
    def open_model(settings):
        def read(image):
            text = bytes(image).decode()
            if text == "boom":
                raise RuntimeError("model down")
            return {"text": text, "finish_reason": "length" if text == "long" else "stop", "input_tokens": 7, "output_tokens": len(text)}

        return read

    pages = {"a": ["one", "boom", "three"], "b": ["x"], "c": ["long"]}
    rows, images = [], []
    for context, texts in pages.items():
        for k, text in enumerate(texts):
            name = f"{k:04d}_p{k}.jpg"
            payload = {"object_name": name, "file_path": f"{context}/{name}", "original_file_name": f"p{k}.jpg"}
            rows.append((f"{context}{k}", context, "pending", "u", json.dumps(payload), None, T, None, None, "standard"))
            images.append((payload["file_path"], text.encode()))
    tasks = spark.createDataFrame(rows, TASKS)
    images = spark.createDataFrame(images, "file_path STRING, image BINARY")
    store = str(tmp_path / "pages")
    now = F.lit(T + dt.timedelta(hours=1))
    first = process_round(tasks, images, open_model, store, 0, now, n_licq=3)
    got = {row["id"]: (row["status"], row["failure_reason"]) for row in first.tasks.collect()}
    # one task of each context goes first
    assert got["a0"] == got["b0"] == ("done", "")
    assert got["c0"] == ("failed", "AppError('TS-03: Transcription truncated (finish_reason=length, output=4)')")
    assert got["a1"] == got["a2"] == ("pending", None)
    texts = {row["context_id"]: row["text"] for row in first.transcripts.collect()}
    assert texts == {"b": "=== p0.jpg ===\nx\n\n", "c": ""}

    completed = first.transcripts.select("context_id", "generation").distinct()
    second = process_round(first.tasks, images, open_model, store, 1, now, n_licq=1, n_fifo=1, completed=completed)
    got = {row["id"]: (row["status"], row["failure_reason"]) for row in second.tasks.collect()}
    assert got["a1"] == ("failed", "RuntimeError('model down')") and got["a2"] == ("done", "")
    texts = {row["context_id"]: row["text"] for row in second.transcripts.collect()}
    assert texts == {"a": "=== p0.jpg ===\none\n\n=== p2.jpg ===\nthree\n\n"}
    assert {r["context_id"] for r in lifecycle.retriable_contexts(second.tasks).collect()} == {"a", "c"}


def test_task_without_image_fails(spark, tmp_path):
    rows, images = [], [("c/0000_a.jpg", b"text"), ("c/0002_c.jpg", None)]
    for k, name in enumerate(("0000_a.jpg", "0001_b.jpg", "0002_c.jpg")):
        payload = {"object_name": name, "file_path": f"c/{name}", "original_file_name": name[5:]}
        rows.append((str(k), "c", "pending", "u", json.dumps(payload), None, T, None, None, "standard"))

    def open_model(settings):
        return lambda image: {"text": bytes(image).decode(), "finish_reason": "stop", "input_tokens": 1, "output_tokens": 1}

    done = process_round(
        spark.createDataFrame(rows, TASKS), spark.createDataFrame(images, "file_path STRING, image BINARY"), open_model,
        str(tmp_path / "pages"), 0, F.lit(T + dt.timedelta(hours=1)), n_licq=3)
    got = {row["id"]: (row["status"], row["failure_reason"]) for row in done.tasks.collect()}
    assert got == {"0": ("done", ""), "1": ("failed", inference.NO_IMAGE), "2": ("failed", inference.NO_IMAGE)}
    assert [r["text"] for r in done.transcripts.collect()] == ["=== a.jpg ===\ntext\n\n"]


def test_handler_opens_once_per_task_and_spreads(spark):
    def open_handler():
        opened = []

        def handle(row):
            opened.append(row["id"])
            return {"seen": len(opened)}

        return handle

    rows = spark.range(40).select(F.col("id").cast("string").alias("id"))
    got = inference.run_handler(rows, "id", open_handler, "seen LONG", concurrency=4).collect()
    assert len(got) == 40 and max(row["seen"] for row in got) <= 12


def test_resize(spark):
    sizes = [(3000, 2000, 1), (2000, 3000, 6), (1536, 1536, 1), (100, 90, 8), (4000, 1, 1), (1, 9000, 3), (5000, 1537, 1)]
    frame = spark.createDataFrame([(k, "c", *size) for k, size in enumerate(sizes)], "id INT, context_id STRING, width INT, height INT, orientation INT")
    got = [(r["out_width"], r["out_height"]) for r in inference.resize_plan(frame).orderBy("id").collect()]
    assert got == [(1536, 1024), (1536, 1024), (1536, 1536), (90, 100), (1536, 1), (1, 1536), (1536, 472)]


def test_stores(spark, tmp_path):
    pages = spark.createDataFrame([("c1", "0000_a", "A"), ("c1", "0001_b", "B"), ("c2", "0000_a", "é\nx")],
                                  "context_id STRING, object_name STRING, text STRING")
    store = str(tmp_path / "store")
    objects.write_page_text(pages, store, 0)
    objects.write_page_text(pages.filter("object_name = '0001_b'").withColumn("text", F.lit("B2")), store, 1)
    objects.write_page_text(pages.filter("object_name = '0001_b'").withColumn("text", F.lit("B2")), store, 1)  # replayed
    latest = objects.read_page_text(spark, store)
    assert {(r["key"], r["text"]) for r in latest.collect()} == {
        ("c1/outputs/0000_a.txt", "A"), ("c1/outputs/0001_b.txt", "B2"), ("c2/outputs/0000_a.txt", "é\nx")}

    merged = merge_transcripts(latest)
    out = str(tmp_path / "export")
    objects.export_transcripts(merged, out)
    read = {folder.name: "".join(p.read_text() for p in sorted(folder.glob("part-*"))) for folder in (tmp_path / "export").glob("context_id=*")}
    assert read == {"context_id=c1": "AB2\n", "context_id=c2": "é\nx\n"}
    listed = objects.object_inventory(spark, out, "context_id=c1/").collect()
    assert len(listed) == 1 and listed[0]["length"] == 4
    deep = tmp_path / "data" / "x" / "data"
    (deep / "ctx1").mkdir(parents=True)
    (deep / "ctx1" / "a[1].txt").write_text("abc")
    (deep / "ctx2").mkdir()
    (deep / "ctx2" / "b.txt").write_text("b")
    keys = lambda prefix: sorted(r["key"] for r in objects.object_inventory(spark, str(deep), prefix).collect())
    assert keys("") == ["ctx1/a[1].txt", "ctx2/b.txt"] and keys("ctx1") == keys("ctx1/a[1]") == ["ctx1/a[1].txt"] and keys("no") == []
    objects.write_transcripts(merged, str(tmp_path / "transcripts"))
    one = objects.read_transcripts(spark, str(tmp_path / "transcripts")).filter("context_id = 'c1'").collect()
    assert [(r["part"], r["text"]) for r in one] == [(0, "AB2")]


def test_limits(spark):
    """What hangs fails in time, one dropped request costs one more attempt, a coded answer is not asked for again."""

    def open_handler():
        asked = {}

        def handle(row):
            asked[row["id"]] = asked.get(row["id"], 0) + 1
            if row["id"] == "hangs":
                time.sleep(30)
            if row["id"] == "drops" and asked["drops"] == 1:
                raise ConnectionError("dropped")
            if row["id"] == "coded":
                raise inference.AppError("TS-02", "no")
            if row["id"] == "broken":
                raise ValueError("always")
            return {"asked": asked[row["id"]]}

        return handle

    rows = spark.createDataFrame([(x,) for x in ("hangs", "drops", "coded", "broken", "fine")], "id STRING").coalesce(1)
    begun = time.monotonic()
    limits = inference.Limits(window=5, timeout_s=0.4, retries=2, backoff_s=0.1)
    got = {r["id"]: r for r in inference.run_handler(rows, "id", open_handler, "asked LONG", limits=limits, cost=True).collect()}
    assert time.monotonic() - begun < 20
    assert {k: (r["status"], r["failure_reason"], r["asked"], r["attempts"]) for k, r in got.items()} == {
        "hangs": ("failed", "TimeoutError('no answer within 0.4 s')", None, 3),
        "drops": ("done", "", 2, 2),
        "coded": ("failed", "AppError('TS-02: no')", None, 1),
        "broken": ("failed", "ValueError('always')", None, 3),
        "fine": ("done", "", 1, 1),
    }
    assert got["hangs"]["duration_s"] >= 1.4 and got["broken"]["duration_s"] >= 0.3 > got["fine"]["duration_s"]


def test_images_by_path_and_media_type(spark):
    """Tasks are spread by path and fetch the bytes themselves; no image is part of a shuffle."""
    kept = {"a": b"\x89PNG\r\n\x1a\nA", "b": b"GIF89a", "c": None, "d": b"\xff\xd8\xffB", "e": b"text"}

    def open_model(settings):
        return lambda image, kind: {"text": kind, "finish_reason": "stop", "input_tokens": 1, "output_tokens": 1}

    rows = spark.createDataFrame([(k, k) for k in kept], "id STRING, file_path STRING")
    done = inference.transcribe(rows, open_model, concurrency=3, window=2, media_types=True, open_fetch=lambda: kept.get)
    refused = "AppError('TS-02: Failed image media_type parse for llm')"
    assert sorted((r["id"], r["text"], r["failure_reason"]) for r in done.collect()) == [
        ("a", "image/png", ""), ("b", None, refused), ("c", None, inference.NO_IMAGE), ("d", "image/jpeg", ""), ("e", None, refused)]


def test_rounds_on_a_versioned_table(spark, tmp_path):
    def open_model(settings):
        return lambda image: {"text": bytes(image).decode(), "finish_reason": "stop", "input_tokens": 1, "output_tokens": 1}

    rows = []
    for k in range(6):
        name = f"{k:04d}_p.jpg"
        payload = {"object_name": name, "file_path": f"c/{name}", "original_file_name": "p.jpg"}
        rows.append((str(k), "c", "pending", "u", json.dumps(payload), None, T, None, None, "standard"))
    table = VersionedTable(spark, str(tmp_path / "tasks"), TASKS)
    table.create(spark.createDataFrame(rows, TASKS))
    images = spark.createDataFrame([(f"c/{k:04d}_p.jpg", b"t") for k in range(6)], "file_path STRING, image BINARY")
    now, store = F.lit(T + dt.timedelta(hours=1)), str(tmp_path / "pages")
    first, done = advance(table, images, open_model, store, 0, now, n_licq=4)
    assert table.changes(first).count() == 4 and done.transcripts.count() == 0
    ends = table.changes(first).select("started_at", "finished_at").collect()
    assert all(r["finished_at"] >= r["started_at"] for r in ends) and len({r["finished_at"] for r in ends}) > 1
    assert advance(table, images, open_model, store, 0, now, n_licq=4) == (first, None)
    with pytest.raises(Conflict):
        table.commit(done.changes, table.version(0))
    second, done = advance(table, images, open_model, store, 1, now, n_licq=4)
    assert table.changes(second).count() == 2 and done.transcripts.count() == 1
    assert {r["status"] for r in table.read().collect()} == {"done"} and second.number == 2


def test_transcripts_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "transcripts")
    merged = spark.createDataFrame([(f"c{k}", 0, f"text {k}") for k in range(40)], "context_id STRING, part BIGINT, text STRING")
    for rows in (merged, merged.filter("context_id <> 'c7'")):
        objects.write_transcripts(rows, path)
    assert {r["context_id"] for r in objects.read_transcripts(spark, path).collect()} == {f"c{k}" for k in range(40)} - {"c7"}


def test_broken_evaluation_objects_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": {"image": "i", "text": "t"}}\n{"cut": {"image": "i", "te\n\n{}\n')
    read = evaljson.read_eval_json(spark, str(tmp_path), with_code=True)
    assert sorted(map(tuple, read.collect()), key=str) == [("k", "i", "t", None), (None, None, None, "EVAL-01")]
    assert [tuple(r) for r in evaljson.read_eval_json(spark, str(tmp_path)).collect()] == [("k", "i", "t")]
