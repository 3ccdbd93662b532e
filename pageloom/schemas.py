"""Record layouts, stated and never inferred."""

from pyspark.sql import types as T

STATUSES = ("pending", "running", "done", "failed")

# status changes a task may go through; None stands for "did not exist before"
TRANSITIONS = (
    (None, "pending"),
    ("pending", "running"),
    ("running", "done"),
    ("running", "failed"),
    ("failed", "pending"),
    ("done", "failed"),
    ("running", "running"),
)


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BINARY": T.BinaryType(),
    "TIMESTAMP": T.TimestampType(),
}


def layout(columns: str) -> T.StructType:
    """Layout from "name TYPE, ..." without a running session, which the DDL reader would need."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TASKS = layout(
    "id STRING, context_id STRING, status STRING, created_by STRING, payload STRING, failure_reason STRING, "
    "created_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP, priority STRING"
)
PAYLOAD = layout("object_name STRING, file_path STRING, original_file_name STRING")
ARCHIVES = layout("archive STRING, content BINARY")
ENTRIES = layout(
    "archive STRING, idx BIGINT, filename STRING, is_dir BOOLEAN, size BIGINT, head_bytes BINARY, code STRING"
)
BINARY_FILES = layout("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
EVAL_MAP = T.MapType(T.StringType(), layout("image STRING, text STRING"))
SEARCH_HIT = layout(
    "url STRING, title STRING, description STRING, snippet STRING, position INT, score DOUBLE, category STRING"
)
SEARCH_RESPONSE = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField("data", T.StructType([T.StructField("results", T.ArrayType(SEARCH_HIT))])),
    ]
)
GPU_FIELDS = ("utilization", "memory_used", "memory_total", "power_draw", "power_limit", "temperature")
OUTCOMES = layout("task_id STRING, status STRING, failure_reason STRING, finished_at TIMESTAMP, attempt INT")
TASK_EVENTS = layout("task_id STRING, context_id STRING, status STRING, ts TIMESTAMP")
