"""One round of work on the queue: claim, transcribe, record, complete."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators import claims, inference, lifecycle, merge
from pageloom.session import stage
from pageloom.sources.objects import read_page_text, write_page_text
from pageloom.sources.tasks import payload_fields
from pageloom.sources.versions import Version, VersionedTable


@dataclass
class Round:
    tasks: DataFrame
    changes: DataFrame
    outcomes: DataFrame
    transcripts: DataFrame


def process_round(
    tasks: DataFrame,
    images: DataFrame,
    open_model: Callable,
    page_store: str,
    round_no: int,
    now: Column,
    n_licq: int,
    n_fifo: int = 0,
    completed: DataFrame | None = None,
    generations: DataFrame | None = None,
    concurrency: int | None = None,
    window: int = 1,
) -> Round:
    """Claim up to n tasks, run the model on their images and return the next snapshot and due transcripts.

    ``images`` is (file_path, image); a task without an image fails. Model answers are staged before anything
    reads them, so the model runs once per claimed page even though outcomes and texts are used apart. The tasks
    in work are staged too: where they are small by their measured size, they go to the images and not the other way.
    ``changes`` are the rows that the round has changed, and all that it computes anew; a task ends as long after ``now`` as its answer took.
    """
    spark = tasks.sparkSession
    revived = lifecycle.reclaim_stale(tasks, now)
    again = lifecycle.stale_tasks(tasks, now).select("id", "context_id")
    claimed = claims.claim_mixed(revived, n_fifo, n_licq) if n_fifo else claims.claim_licq(revived, n_licq)
    claimed = stage(claimed.select("id", "context_id"), "claimed")
    in_work = claimed.select("id").unionByName(again.select("id"))
    running = lifecycle.apply_claim(revived.join(in_work, "id", "left_semi").select(*tasks.columns), claimed, now)

    chosen = payload_fields(tasks).join(in_work, "id", "left_semi")
    todo = stage(chosen.select("id", "context_id", "object_name", "original_file_name", "file_path"), "todo")
    with_image = images.join(todo.select("id", "file_path"), "file_path").select("id", "image")
    answers = stage(inference.transcribe(with_image, open_model, concurrency=concurrency, window=window, cost=True), "answers")

    without = todo.join(answers.select("id"), "id", "left_anti").select(
        "id", F.lit("failed").alias("status"), F.lit(inference.NO_IMAGE).alias("failure_reason")
    )
    outcomes = answers.select("id", "status", "failure_reason", "duration_s").unionByName(without, allowMissingColumns=True)
    took = F.make_dt_interval(secs=F.coalesce("duration_s", F.lit(0.0)).cast("decimal(18,6)"))
    outcomes = outcomes.select(
        F.col("id").alias("task_id"), "status", "failure_reason", (now + took).alias("finished_at"), F.lit(1).alias("attempt")
    )
    changes = stage(lifecycle.record_outcomes(running, outcomes), "changes")
    after = tasks.join(changes.select("id"), "id", "left_anti").select(*tasks.columns).unionByName(changes)

    pages = answers.filter("status = 'done'").join(
        todo.select("id", "context_id", "object_name", "original_file_name"), "id"
    )
    write_page_text(merge.format_page(pages), page_store, round_no)
    if completed is None:
        completed = spark.createDataFrame([], "context_id STRING, generation LONG")
    transcripts = merge.complete_contexts(after, read_page_text(spark, page_store), completed, generations)
    return Round(after, changes, outcomes, transcripts)


def advance(table: VersionedTable, images: DataFrame, open_model: Callable, page_store: str, round_no: int, now: Column, n_licq: int, **more) -> tuple[Version, Round | None]:
    """``process_round`` on the newest version of a task table, of which only the changed rows are written.

    A round whose number has been committed is not run again (None). Raises ``Conflict`` if the table was changed meanwhile; the
    round can then be repeated, as its page texts replace themselves.
    """
    read = table.version()
    if read.applied.get("rounds", -1) >= round_no:
        return read, None
    done = process_round(table.read(read), images, open_model, page_store, round_no, now, n_licq, **more)
    return table.commit(done.changes, read, "rounds", round_no), done
