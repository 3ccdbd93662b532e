"""Result codes: the dimension table and how to find a code in a failure reason."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, HTTP status of its class, what it says.
CODES = (
    ("ZIP-01", 400, "archive cannot be opened"),
    ("ZIP-02", 400, "archive holds no usable file"),
    ("ZIP-03", 400, "archive holds too many files"),
    ("ZIP-04", 400, "file is too large"),
    ("ZIP-05", 400, "file is not an image"),
    ("ZIP-06", 400, "image format is not supported"),
    ("TS-01", 500, "upload failed"),
    ("TS-02", 500, "media type unknown"),
    ("TS-03", 500, "transcription truncated"),
    ("TS-04", 400, "context unknown"),
    ("TS-05", 400, "context cannot be retried"),
    ("TS-06", 500, "file name missing"),
    ("TS-07", 400, "context belongs to someone else"),
    ("TS-08", 404, "transcript not found"),
    ("TS-09", 500, "file size missing"),
    ("WSP-01", 400, "search limit too high"),
    ("WSP-02", 500, "search found nothing"),
    ("WSP-03", 500, "no page could be read"),
    ("CRWC-01", 400, "search query missing"),
    ("CRWC-02", 500, "search answered with an error"),
    ("CRWC-03", 500, "search unreachable"),
    ("CRWC-04", 500, "search answer malformed"),
    ("CRWC-09", 400, "no URLs given"),
    ("CRWC-10", 200, "page unreachable, left out"),
    ("CRWC-11", 200, "page malformed, left out"),
)
CODE_PATTERN = "((?:ZIP|TS|WSP|CRWC)-[0-9]{2})"


def error_dimension(spark: SparkSession) -> DataFrame:
    """The code table; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame(list(CODES), "code STRING, http_status INT, message STRING")


def code_of(reason: Column) -> Column:
    """The code named in a failure reason, NULL where it names none."""
    found = F.regexp_extract(reason, CODE_PATTERN, 1)
    return F.when(found != "", found)
