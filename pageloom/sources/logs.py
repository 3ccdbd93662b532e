"""Service log lines as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: layout of a line.
LINE = (
    r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) ([A-Z]+) \[([^\]]*)\] trace=(\S*) span=(\S*) "
    r"(?:\[task=(\S*) ctx=(\S*)\] )?(.*)$"
)
FIELDS = ("time", "level", "logger", "trace", "span", "task_id", "context_id", "message")


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """(value) to the eight fields of a line; lines of another layout, as in stack traces, give NULLs."""
    parts = {
        name: F.when(F.col("value").rlike(LINE), F.regexp_extract("value", LINE, group))
        for group, name in enumerate(FIELDS, 1)
    }
    parts["time"] = F.try_to_timestamp(parts["time"], F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
    for name in ("task_id", "context_id"):
        parts[name] = F.when(parts[name] != "", parts[name])
    return lines.select(*(parts[name].alias(name) for name in FIELDS))


def log_activity(lines: DataFrame) -> DataFrame:
    """Lines per level, logger and context."""
    return parse_log_lines(lines).groupBy("level", "logger", "context_id").agg(F.count("*").alias("lines"))
