"""Objects of a context: page texts, transcripts, inventory, leftovers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _qualified(spark: SparkSession, path: str):
    """A path with its file system and from its root on, and the file system."""
    context = spark.sparkContext
    named = context._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(context._jsc.hadoopConfiguration())
    return system.makeQualified(named), system


def key_below(spark: SparkSession, root: str) -> Column:
    """Key of a file of the binary source: its path below ``root``, or its name where ``root`` is the file or a pattern."""
    folder = _qualified(spark, root)[0].toString().rstrip("/") + "/"
    below = F.col("path").substr(F.lit(len(folder) + 1), F.length("path"))
    return F.when(F.col("path").startswith(folder), below).otherwise(F.element_at(F.split("path", "/"), -1))


def object_inventory(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Objects under ``root`` whose key starts with ``prefix``: key, length, modification time, no content.

    Only folders and files that begin with the prefix are listed; a prefix that nothing has gives no rows.
    """
    pattern = root.rstrip("/") + "/" + re.sub(r"([\\*?\[\]{}])", r"\\\1", prefix) + "*"
    path, system = _qualified(spark, pattern)
    if not system.globStatus(path):
        return spark.createDataFrame([], "key STRING, length LONG, modificationTime TIMESTAMP")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    return files.select(key_below(spark, root).alias("key"), "length", "modificationTime").filter(F.col("key").startswith(prefix))


def orphan_objects(objects: DataFrame, tasks: DataFrame) -> DataFrame:
    """Objects whose context (first part of the key) has no task: a failed upload left them behind."""
    owned = tasks.select("context_id").distinct()
    keyed = objects.withColumn("context_id", F.split("key", "/")[0])
    return keyed.join(owned, "context_id", "left_anti")


def bucket_of(column: str) -> Column:
    """Two hex digits that spread contexts over 256 folders."""
    return F.substring(F.md5(column), 1, 2)


def write_page_text(pages: DataFrame, path: str, batch_id: int) -> None:
    """Store page texts of one batch: (context_id, object_name, text).

    A folder per batch, overwritten as a whole, makes a replayed batch harmless; one file per page would
    drown a file system at scale.
    """
    stored = pages.select(
        "context_id",
        "object_name",
        F.concat("context_id", F.lit("/outputs/"), "object_name", F.lit(".txt")).alias("key"),
        "text",
    )
    stored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """Page texts, the latest batch of a page winning, as if each write had replaced the object."""
    stored = spark.read.schema("context_id STRING, object_name STRING, key STRING, text STRING, batch BIGINT").parquet(
        path
    )
    newest = Window.partitionBy("key").orderBy(F.desc("batch"))
    return stored.withColumn("_age", F.row_number().over(newest)).filter("_age = 1").drop("_age", "batch")


def write_transcripts(merged: DataFrame, path: str) -> None:
    """Store transcripts (context_id, part, text) in 256 folders, in order of context.

    Range-partitioned, so a task writes few large files and a lookup reads few row groups. What stood at ``path`` is
    replaced as a whole, so a job that failed half-way can be repeated.
    """
    layout = ["bucket", "context_id", "part"]
    (
        merged.withColumn("bucket", bucket_of("context_id"))
        .repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("context_id STRING, part BIGINT, text STRING, bucket STRING").parquet(path)


def export_transcripts(merged: DataFrame, path: str, by: str = "context_id") -> None:
    """Plain text for download: a folder per value of ``by``, its transcripts in order of file name and line.

    The default suits the contexts of one export; a whole store is exported by a coarser column, as a
    folder per context does not scale.
    """
    order = list(dict.fromkeys([by, "context_id", "part"]))
    (
        merged.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(by, "text")
        .write.partitionBy(by)
        .text(path)
    )
