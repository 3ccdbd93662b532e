"""What the operators of this subpackage share: reading, staging and session settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.session import ship


BATCH_BYTES = 16 * 1024 * 1024


def opened(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Gives the workers this package and bounds an Arrow batch by bytes, as texts may be very long."""
    ship(spark, "pageloom")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
