"""Uploaded zip archives: listing, accept/reject rules, object names, pending tasks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.schemas import ENTRIES, TASKS
from pageloom.sources.objects import key_below

# Limits of an upload.
MAX_IMAGES = 100
MAX_IMAGE_BYTES = 40 * 1024 * 1024

# Leading bytes (hex) of the formats that are told apart.
SIGNATURES = (
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
)
SUPPORTED = ("image/jpeg", "image/png")
HEAD_BYTES = 16


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Zip files under ``path`` as rows (archive, content); an archive is named by its path below that folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(key_below(spark, path).alias("archive"), "content")


def _list_entries(name: str, content: bytes) -> Iterator[tuple]:
    try:
        opened = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError):
        yield (name, None, None, None, None, None, "ZIP-01")
        return
    with opened:
        for idx, info in enumerate(opened.infolist()):
            head = b""
            if not info.is_dir():
                try:
                    with opened.open(info) as member:
                        head = member.read(HEAD_BYTES)
                except Exception:  # a damaged or locked member has no readable head: "not an image"
                    head = b""
            yield (name, idx, info.filename, info.is_dir(), info.file_size, head, None)


def archive_entries(archives: DataFrame) -> DataFrame:
    """One row per zip entry with its first bytes; an archive that cannot be opened gives one ZIP-01 row.

    Only the head of each entry leaves the task, so no image bytes reach a shuffle.
    """
    columns = ENTRIES.fieldNames()

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (row for pair in zip(batch["archive"], batch["content"]) for row in _list_entries(*pair))
            while chunk := list(islice(found, 10000)):  # entry lists go out in bounded pieces
                rows = pd.DataFrame(chunk, columns=columns)
                yield rows.astype({"idx": "Int64", "size": "Int64", "is_dir": "boolean"})

    return archives.select("archive", "content").mapInPandas(listing, ENTRIES)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def drop_artifacts(entries: DataFrame) -> DataFrame:
    """Leave out folders and what archiving tools add on their own."""
    name = base_name(F.col("filename"))
    artifact = (
        F.col("is_dir") | F.col("filename").startswith("__MACOSX/") | (name == ".DS_Store") | name.startswith("._")
    )
    return entries.filter(F.col("filename").isNotNull() & ~artifact)


def media_type(head: Column) -> Column:
    """Media type by leading bytes, NULL where they belong to no known image format."""
    chain = F
    for signature, kind in SIGNATURES:
        leading = F.substring(head, 1, len(signature) // 2)
        chain = chain.when(leading == F.unhex(F.lit(signature)), kind)
    riff = (F.substring(head, 1, 4) == F.unhex(F.lit("52494646"))) & (
        F.substring(head, 9, 4) == F.unhex(F.lit("57454250"))
    )
    return chain.when(riff, "image/webp")


def sniff_media_type(entries: DataFrame) -> DataFrame:
    """Add media_type and the code of an entry that is no image (ZIP-05) or of an unsupported kind (ZIP-06)."""
    kind = F.col("media_type")
    return entries.withColumn("media_type", media_type(F.col("head_bytes"))).withColumn(
        "format_code", F.when(kind.isNull(), "ZIP-05").when(~kind.isin(*SUPPORTED), "ZIP-06")
    )


def validate_archives(
    archives: DataFrame, entries: DataFrame, max_images: int = MAX_IMAGES, max_bytes: int = MAX_IMAGE_BYTES
) -> DataFrame:
    """Per archive its count of kept entries and the first rule it breaks, NULL when accepted.

    Entry rules are checked in entry order, size before content. Everything is one aggregate with a
    map-side part, so an archive of any length costs no more than a row per task in the shuffle.
    """
    kept = sniff_media_type(drop_artifacts(entries)).select(
        "archive",
        F.lit(1).alias("kept"),
        F.lit(None).cast("string").alias("open_code"),
        "idx",
        F.when(F.col("size") > max_bytes, "ZIP-04").otherwise(F.col("format_code")).alias("entry_code"),
    )
    unopened = entries.filter("code IS NOT NULL").select(
        "archive",
        F.lit(0).alias("kept"),
        F.col("code").alias("open_code"),
        F.lit(None).cast("long").alias("idx"),
        F.lit(None).cast("string").alias("entry_code"),
    )
    first_bad = F.min(F.when(F.col("entry_code").isNotNull(), F.struct("idx", "entry_code")))
    found = (
        kept.unionByName(unopened)
        .groupBy("archive")
        .agg(F.sum("kept").alias("images"), F.max("open_code").alias("open_code"), first_bad.alias("first_bad"))
    )
    images = F.coalesce("images", F.lit(0)).cast("long")
    return archives.select("archive").join(found, "archive", "left").select(
        "archive",
        images.alias("images"),
        F.coalesce(
            "open_code",
            F.when(images == 0, "ZIP-02").when(images > max_images, "ZIP-03"),
            F.col("first_bad.entry_code"),
        ).alias("code"),
    )


def accepted_images(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Kept entries of the archives that broke no rule."""
    return drop_artifacts(entries).join(verdicts.filter("code IS NULL"), "archive", "left_semi")


def assign_object_names(images: DataFrame) -> DataFrame:
    """Number the images of each accepted archive from 0 and name their objects by it.

    Takes ``accepted_images``: an accepted archive has at most ``max_images`` entries, which bounds the window.
    """
    place = F.row_number().over(Window.partitionBy("archive").orderBy("idx")) - 1
    base = base_name(F.col("filename"))
    name = F.when(base == "", "unnamed").otherwise(base)
    return (
        images.withColumn("object_index", place.cast("long"))
        .withColumn("original_file_name", name)
        .withColumn("object_name", F.format_string("%04d_%s", "object_index", "original_file_name"))
    )


def enqueue_tasks(named: DataFrame, now: Column, priority: str = "standard") -> DataFrame:
    """One pending task per image. Needs context_id and created_by next to the columns of assign_object_names.

    The id is a digest of the object's path, so replaying an upload gives the same ids.
    """
    payload = F.to_json(
        F.struct(
            "object_name", F.concat_ws("/", "context_id", "object_name").alias("file_path"), "original_file_name"
        )
    )
    never = F.lit(None)
    columns = {
        "id": F.sha2(F.concat_ws("/", "context_id", "object_name"), 256),
        "status": F.lit("pending"),
        "payload": payload,
        "failure_reason": never,
        "created_at": now,
        "started_at": never,
        "finished_at": never,
        "priority": F.lit(priority),
    }
    return named.select(
        *(columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in TASKS.fields)
    )
