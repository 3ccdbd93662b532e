"""Zip files read in place: same rows as from bytes, large archives, splits, pushed filters, damage."""

import io
import zipfile

import pytest

from pageloom.sources import archives
from pageloom.sources.zipfiles import ZipEntries, _Reader


def packed(names, lead=b"\x89PNG\r\n\x1a\n"):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for name in names:
            out.writestr(name, b"" if name.endswith("/") else lead + name.encode() * 50)
    return held.getvalue()


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(ZipEntries)
    (tmp_path / "zips" / "inner").mkdir(parents=True)
    (tmp_path / "zips" / "a.zip").write_bytes(packed(["p/", "p/1.png", "q/2.png", "é.png"]))
    (tmp_path / "zips" / "inner" / "b.zip").write_bytes(packed([f"p/{i}.jpg" for i in range(300)], b"\xff\xd8\xff"))
    (tmp_path / "zips" / "cut.zip").write_bytes(packed(["x.png"])[:60])
    (tmp_path / "zips" / "_hidden").write_bytes(b"no archive")
    return tmp_path / "zips"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def entries(spark, folder, **options):
    return spark.read.format("zip_entries").options(**options).load(str(folder))


def test_same_rows_as_from_bytes(spark, folder):
    (folder / "_hidden").unlink()
    wanted = rows(archives.archive_entries(archives.read_archives(spark, str(folder))))
    assert rows(entries(spark, folder)) == wanted and len(wanted) == 305
    assert rows(entries(spark, f"file:{folder}", splitBytes="700")) == wanted
    assert entries(spark, folder, splitBytes="700").rdd.getNumPartitions() > 5


def test_larger_than_a_row_can_be(spark, folder):
    with open(folder / "large.zip", "wb") as out:
        out.truncate(5 << 30)  # holes take no room on disk
        out.seek(5 << 30)
        out.write(packed(["p/1.png", "p/2.png"]))
    got = entries(spark, folder).filter("archive = 'large.zip'")
    assert [(r["idx"], r["filename"], bytes(r["head_bytes"][:4])) for r in got.orderBy("idx").collect()] == [(0, "p/1.png", b"\x89PNG"), (1, "p/2.png", b"\x89PNG")]


def test_filters_are_pushed(spark, folder):
    found = entries(spark, folder).filter("filename LIKE 'p/%' AND archive = 'a.zip' AND size > 0")
    assert [(r["archive"], r["filename"]) for r in found.collect()] == [("a.zip", "p/1.png")]
    assert entries(spark, folder).filter("filename LIKE 'q/%'").count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("BatchScan")[0]  # nothing is left of it above the scan


def test_small_files_share_a_part(folder, tmp_path):
    sizes = [len(p.files) for p in _Reader({"path": str(folder)}).partitions()]
    assert sizes == [3]
    (tmp_path / "none").mkdir()
    assert [p.files for p in _Reader({"path": str(tmp_path / "none")}).partitions()] == [[]]
