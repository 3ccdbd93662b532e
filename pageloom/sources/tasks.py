"""The task table: snapshots partitioned by status, row checks, payload fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.schemas import PAYLOAD, STATUSES, TASKS

_BROKEN = "_broken"


def write_snapshot(tasks: DataFrame, path: str) -> None:
    """Write a new snapshot to a path of its own; never the one being read."""
    tasks.write.partitionBy("status").parquet(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Read a snapshot. A filter on status prunes folders, others reach the Parquet scan."""
    return spark.read.schema(TASKS).parquet(path).select(*TASKS.fieldNames())


def scan_tasks(tasks: DataFrame) -> DataFrame:
    """Add ``valid``: whether the row meets the table's rules (status known, required columns present)."""
    required = ("id", "context_id", "created_by", "payload", "created_at", "priority")
    present = F.lit(True)
    for name in required:
        present = present & F.col(name).isNotNull()
    return tasks.withColumn("valid", present & F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def quarantine(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows set aside)"""
    checked = scan_tasks(tasks)
    return checked.filter("valid").drop("valid"), checked.filter("NOT valid").drop("valid")


def payload_fields(tasks: DataFrame) -> DataFrame:
    """Add the payload's three fields and ``payload_valid``, false if one is missing or the JSON is broken."""
    names = PAYLOAD.fieldNames()
    layout = T.StructType([*PAYLOAD.fields, T.StructField(_BROKEN, T.StringType())])
    parsed = tasks.withColumn("_payload", F.from_json("payload", layout, {"columnNameOfCorruptRecord": _BROKEN}))
    whole = F.col("_payload").isNotNull() & F.col(f"_payload.{_BROKEN}").isNull()
    fields = {name: F.when(whole, F.col(f"_payload.{name}")) for name in names}
    complete = whole
    for name in names:
        complete = complete & F.col(f"_payload.{name}").isNotNull()
    return parsed.withColumns({**fields, "payload_valid": complete}).drop("_payload")
