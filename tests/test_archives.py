"""Real zip files through the whole submission."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from pageloom.plans.submit import submit
from pageloom.sources import archives

JPEG, PNG, GIF = b"\xff\xd8\xff\xe0rest", b"\x89PNG\r\n\x1a\nrest", b"GIF89arest"


def pack(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for name, content in entries:
            out.writestr(name, content)
    return held.getvalue()


def images(n, content=JPEG):
    return [(f"f/{k}.jpg", content) for k in range(n)]


FILES = {
    "good.zip": pack([("a/", b""), ("a/x.jpg", JPEG), ("__MACOSX/a/._x.jpg", b"?"), ("b/.DS_Store", b""), ("b/x.jpg", PNG),
                      ("b/._y.jpg", b"")]),
    "broken.zip": b"not a zip at all",
    "half.zip": pack(images(3))[:60],
    "nothing.zip": pack([("a/", b""), ("__MACOSX/x.jpg", JPEG)]),
    "empty.zip": pack([]),
    "hundred.zip": pack(images(100) + [("._z.jpg", b"")]),
    "toomany.zip": pack(images(101, b"no image")),
    "fake.zip": pack([("1.jpg", JPEG), ("2.jpg", b"text"), ("3.gif", GIF)]),
    "gif.zip": pack([("1.jpg", JPEG), ("3.gif", GIF), ("2.jpg", b"text")]),
    "large.zip": pack([("1.jpg", JPEG + b"0" * 93), ("2.jpg", b"text")]),
    "equal.zip": pack([("1.jpg", JPEG + b"0" * 92)]),
}
CODES = {
    "good.zip": None, "broken.zip": "ZIP-01", "half.zip": "ZIP-01", "nothing.zip": "ZIP-02", "empty.zip": "ZIP-02",
    "hundred.zip": None, "toomany.zip": "ZIP-03", "fake.zip": "ZIP-05", "gif.zip": "ZIP-06", "large.zip": "ZIP-04",
    "equal.zip": None,
}


def test_submission(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    landed = archives.read_archives(spark, str(tmp_path))
    uploads = landed.select("archive", F.concat(F.lit("ctx-"), "archive").alias("context_id"), F.lit("u1").alias("created_by"))
    now = F.to_timestamp(F.lit("2024-02-01 10:00:00"))
    tasks, verdicts = submit(landed, uploads, now, max_bytes=100)
    assert {row["archive"]: row["code"] for row in verdicts.collect()} == CODES
    rows = tasks.orderBy("context_id", "payload").collect()
    good = [json.loads(row["payload"]) for row in rows if row["context_id"] == "ctx-good.zip"]
    # equal base names of two folders stay apart by their index, which counts kept entries only
    assert [payload["object_name"] for payload in good] == ["0000_x.jpg", "0001_x.jpg"]
    assert good[1] == {"object_name": "0001_x.jpg", "file_path": "ctx-good.zip/0001_x.jpg", "original_file_name": "x.jpg"}
    assert len(rows) == 2 + 100 + 1
    assert {row["status"] for row in rows} == {"pending"} and rows[0]["failure_reason"] is None
    assert rows == submit(landed, uploads, now, max_bytes=100)[0].orderBy("context_id", "payload").collect()


def test_signatures(spark):
    heads = [("image/jpeg", JPEG), ("image/png", PNG), ("image/gif", GIF), ("image/bmp", b"BM12"), ("image/tiff", b"II*\0"),
             ("image/tiff", b"MM\0*"), ("image/webp", b"RIFF1234WEBPVP8"), (None, b"RIFF1234WAVE"), (None, b""), (None, None)]
    frame = spark.createDataFrame([(k, kind, head) for k, (kind, head) in enumerate(heads)], "k INT, kind STRING, head_bytes BINARY")
    for row in archives.sniff_media_type(frame).collect():
        assert row["media_type"] == row["kind"]
        assert row["format_code"] == {None: "ZIP-05", "image/jpeg": None, "image/png": None}.get(row["kind"], "ZIP-06")


def test_unnamed_and_long_index(spark):
    frame = spark.createDataFrame([("a", 0, "folder/"), ("a", 3, "x")], "archive STRING, idx BIGINT, filename STRING")
    got = archives.assign_object_names(frame).orderBy("idx").collect()
    assert [row["object_name"] for row in got] == ["0000_unnamed", "0001_x"]
