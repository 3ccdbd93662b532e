"""Page texts to transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.ordered import position
from pageloom.operators.results import context_progress, finished_contexts

# default number of pages per transcript row: an accepted archive has no more pages than this
PAGES_PER_PART = 100


def format_page(pages: DataFrame) -> DataFrame:
    """Replace text by the page as it is stored: a heading with the original file name, the text, a blank line."""
    page = F.concat(F.lit("=== "), "original_file_name", F.lit(" ===\n"), "text", F.lit("\n\n"))
    return pages.withColumn("text", page)


def merge_transcripts(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """(context_id, object_name, text) to (context_id, part, pages, text), pages in order of object name.

    Pages are ordered by the number that leads their name, those without one first, then by name. Parts 0, 1, ...
    have ``pages_per_part`` pages each by place in that order, the last one the rest, so no task ever
    holds more than one part's pages whatever they are called. Pages that failed have no text and are absent.
    """
    number = F.regexp_extract("object_name", r"^(\d+)_", 1).try_cast("long")
    order = [number.asc_nulls_first(), F.col("object_name").asc_nulls_first()]
    read = pages.filter("text IS NOT NULL").select("context_id", "object_name", "text")
    part = F.floor((F.col("page_no") - 1) / pages_per_part).alias("part")
    return (
        position(read, ["context_id"], order, "page_no")
        .groupBy("context_id", part)
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
        .select(
            "context_id",
            "part",
            F.size("pages").cast("long").alias("pages"),
            F.array_join("pages.text", "").alias("text"),
        )
    )


def due_contexts(tasks: DataFrame, generations: DataFrame, completed: DataFrame) -> DataFrame:
    """(context_id, generation) of finished contexts whose present generation has no transcript yet.

    ``generations`` (context_id, generation) counts the retries; a context without a row is at 0.
    """
    finished = finished_contexts(context_progress(tasks)).select("context_id")
    at = finished.join(generations, "context_id", "left").select(
        "context_id", F.coalesce("generation", F.lit(0)).cast("long").alias("generation")
    )
    return at.join(completed, ["context_id", "generation"], "left_anti")


def complete_contexts(
    tasks: DataFrame, pages: DataFrame, completed: DataFrame, generations: DataFrame | None = None
) -> DataFrame:
    """Transcripts of the contexts that are due, once per generation. One without page texts gets an empty one."""
    if generations is None:
        generations = tasks.sparkSession.createDataFrame([], "context_id STRING, generation LONG")
    due = due_contexts(tasks, generations, completed)
    merged = merge_transcripts(pages.join(due, "context_id", "left_semi"))
    return due.join(merged, "context_id", "left").select(
        "context_id",
        "generation",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
