"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_shipped: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="pageloom-")
    return _own_dirs[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage so that a lost executor costs a re-read and not a re-computation, and pins
    values that must be the same in every branch that reads them.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, *packages: str) -> None:
    """Give the Python workers these packages, as ``--py-files`` would; each once per application."""
    for name in packages:
        key = (spark.sparkContext.applicationId, name)
        if key in _shipped:
            continue
        root = os.path.dirname(os.path.dirname(os.path.abspath(importlib.import_module(name).__file__)))
        # a file of the driver's own, which Spark hands out
        packed = os.path.join(tempfile.mkdtemp(prefix="ship-"), name)
        spark.sparkContext.addPyFile(shutil.make_archive(packed, "zip", root, name))
        _shipped.add(key)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on. Sizes (shuffle partitions, memory) stay the cluster's own."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # rows hold whole archives, images and texts: batches for Python are bounded by bytes, not by rows alone
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
    # per-row work is heavy here (texts, models), so small stages are kept spread over the cores
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    # sources written in Python take filters too
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark
