"""Applying a model or any user function to rows, with the outcome of each row kept."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.sources.archives import SIGNATURES, SUPPORTED

# What the transcription model is told, and its settings.
INSTRUCTIONS = (
    "You are an image-to-text transcription agent."
    "Given an image containing text (handwritten or printed), output exactly what is written as a string."
    "Output only the transcribed text, nothing else."
    "If the image contains no text, output an empty string."
)
REQUEST = "Transcribe the text in this image."
# what is recorded of an image whose kind the model does not take
NO_MEDIA_TYPE = "Failed image media_type parse for llm"
MAX_DIM = 1536

# what a task records whose image is not there
NO_IMAGE = repr(FileNotFoundError("no image"))


@dataclass(frozen=True)
class ModelSettings:
    """Shipped to the tasks; a model callable reads what it needs."""

    model: str = "transcriber"
    instructions: str = INSTRUCTIONS
    request: str = REQUEST
    temperature: float = 0.0
    max_tokens: int = 600
    timeout_s: float = 120.0
    retries: int = 1
    backoff_s: float = 0.5


class AppError(Exception):
    """A failure with a code; its repr is what a failed task records."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Limits:
    """How rows are worked on inside a task: ``window`` at once, each attempt for ``timeout_s`` at most, failed ones tried
    again ``retries`` times after ``backoff_s``, then twice that, and so on. An AppError is an answer and not tried again.
    """

    window: int = 1
    timeout_s: float | None = None
    retries: int = 0
    backoff_s: float = 0.5


def _within(handler: Callable[[dict], dict], row: dict, timeout_s: float | None) -> dict:
    """The handler's answer, or TimeoutError when the time is over.

    A thread cannot be stopped: what hangs is left behind and no longer waited for. Clients should have time limits of their own.
    """
    if timeout_s is None:
        return handler(row)
    told: dict = {}

    def work() -> None:
        try:
            told["answer"] = handler(row)
        except Exception as problem:
            told["problem"] = problem

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(timeout_s)
    if "problem" in told:
        raise told["problem"]
    if "answer" not in told:
        raise TimeoutError(f"no answer within {timeout_s:g} s")
    return told["answer"]


def _outcome(handler: Callable[[dict], dict], row: dict, limits: Limits) -> tuple[dict | None, Exception | None, int, float]:
    """Answer or problem of a row, the number of attempts and the seconds they took, waits included."""
    begun = time.monotonic()
    for attempt in range(1, limits.retries + 2):
        try:
            return _within(handler, row, limits.timeout_s), None, attempt, time.monotonic() - begun
        except Exception as problem:
            if isinstance(problem, AppError) or attempt > limits.retries:
                return None, problem, attempt, time.monotonic() - begun
            time.sleep(limits.backoff_s * 2 ** (attempt - 1))
    raise AssertionError("unreachable")


# what a row cost, where it is asked for
COST = "attempts INT, duration_s DOUBLE"


def run_handler(
    rows: DataFrame,
    key: str,
    open_handler: Callable[[], Callable[[dict], dict]],
    result: str,
    concurrency: int | None = None,
    limits: Limits = Limits(),
    cost: bool = False,
) -> DataFrame:
    """Run a handler on every row: (key, status, failure_reason, *result), with ``cost`` also attempts and duration_s.

    ``open_handler`` is called once per task of the job and returns the handler, so a client is opened
    where it is used. A handler that raises makes its row 'failed' with ``repr`` of the error; no row
    fails the job. ``limits`` holds inside a task; ``concurrency`` spreads the rows over so many tasks, which shuffles them:
    let rows name what is large and handlers fetch it. A lost
    executor repeats its rows, so handlers must be safe to repeat; write the outcome before reading it twice.
    """
    fields = T.StructType.fromDDL(f"{result}, {COST}" if cost else result)
    schema = T.StructType(
        [rows.schema[key], T.StructField("status", T.StringType()), T.StructField("failure_reason", T.StringType())]
        + fields.fields
    )
    names = fields.fieldNames()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handler = open_handler()

        def told(row: dict) -> tuple:
            answer, problem, attempts, seconds = _outcome(handler, row, limits)
            answer = (answer or {}) | {"attempts": attempts, "duration_s": seconds}
            ended = ("done", "") if problem is None else ("failed", repr(problem))
            return (row[key], *ended, *(answer.get(name) for name in names))

        with ThreadPoolExecutor(limits.window) as pool:
            for batch in batches:
                rows_of = batch.to_dict("records")
                outcomes = list(pool.map(told, rows_of) if limits.window > 1 else map(told, rows_of))
                yield pd.DataFrame(outcomes, columns=schema.fieldNames())

    spread = rows.repartition(concurrency) if concurrency else rows
    return spread.mapInPandas(work, schema)


TRANSCRIPTION = "text STRING, model STRING, finish_reason STRING, input_tokens LONG, output_tokens LONG"


def _media_type(image: bytes) -> str | None:
    """The kind of an image that the model takes, by its leading bytes."""
    return next((kind for signature, kind in SIGNATURES if kind in SUPPORTED and image.startswith(bytes.fromhex(signature))), None)


def transcribe(
    images: DataFrame,
    open_model: Callable[[ModelSettings], Callable[..., dict]],
    settings: ModelSettings | None = None,
    concurrency: int | None = None,
    window: int = 1,
    media_types: bool = False,
    open_fetch: Callable[[], Callable[[str], bytes | None]] | None = None,
    cost: bool = False,
) -> DataFrame:
    """(id, image) to outcomes with text and usage; ``open_model`` gives image bytes -> answer.

    An answer has text, finish_reason, input_tokens and output_tokens. Usage counts even when the answer
    was cut; the cut itself is an outcome, see ``truncation_check``. The settings' time limit and retries hold for each image,
    ``window`` images are in work at once in a task. With ``media_types`` the model is given the image's media type as well,
    and an image of another kind fails with TS-02. With ``open_fetch`` the images are (id, file_path): tasks are spread by
    path alone and fetch the bytes where they use them. ``cost`` adds attempts and duration_s.
    """
    chosen = settings or ModelSettings()

    def open_handler():
        model, fetch = open_model(chosen), open_fetch() if open_fetch else None

        def read(row: dict) -> dict:
            image = fetch(row["file_path"]) if fetch else row["image"]
            if image is None:
                raise FileNotFoundError("no image")
            if not media_types:
                return {"model": chosen.model, **model(image)}
            kind = _media_type(bytes(image))
            if kind is None:
                raise AppError("TS-02", NO_MEDIA_TYPE)
            return {"model": chosen.model, **model(image, kind)}

        return read

    limits = Limits(window, chosen.timeout_s, chosen.retries, chosen.backoff_s)
    rows = images.select("id", "file_path" if open_fetch else "image")
    return truncation_check(run_handler(rows, "id", open_handler, TRANSCRIPTION, concurrency, limits, cost))


def truncation_check(answers: DataFrame) -> DataFrame:
    """An answer that stopped at the token limit is a failure: TS-03 with its token count, and no text."""
    cut = F.col("finish_reason").eqNullSafe("length")
    # fixed value: what a cut answer records
    reason = F.format_string(
        "AppError('TS-03: Transcription truncated (finish_reason=length, output=%d)')", F.col("output_tokens")
    )
    return (
        answers.withColumn("status", F.when(cut, "failed").otherwise(F.col("status")))
        .withColumn("failure_reason", F.when(cut, reason).otherwise(F.col("failure_reason")))
        .withColumn("text", F.when(~cut, F.col("text")))
    )


def _short_side(exact: Column, error: Callable[[Column], Column]) -> Column:
    """Of the two whole numbers around ``exact`` the one that keeps the ratio better, at least 1."""
    low, high = F.floor(exact), F.ceil(exact)
    return F.greatest(F.when(error(low) <= error(high), low).otherwise(high), F.lit(1))


def resize_plan(images: DataFrame, max_dim: int = MAX_DIM) -> DataFrame:
    """(width, height, orientation) to the turned size and the size fitted in max_dim x max_dim, never larger.

    Orientations 5 to 8 lie on their side. Pixels are the image codec's work; what is planned here is
    what each page costs.
    """
    turned = F.col("orientation").between(5, 8)
    sized = images.withColumns(
        {
            "turned_width": F.when(turned, F.col("height")).otherwise(F.col("width")).cast("long"),
            "turned_height": F.when(turned, F.col("width")).otherwise(F.col("height")).cast("long"),
        }
    )
    width, height = F.col("turned_width"), F.col("turned_height")
    ratio = width / height
    wide = width >= height
    side = F.lit(max_dim)
    short_height = _short_side(side / ratio, lambda n: F.when(n == 0, 0.0).otherwise(F.abs(ratio - side / n)))
    short_width = _short_side(side * ratio, lambda n: F.abs(ratio - n / side))
    fits = (width <= max_dim) & (height <= max_dim)
    return sized.withColumns(
        {
            "out_width": F.when(fits, width).when(wide, side).otherwise(short_width).cast("long"),
            "out_height": F.when(fits, height).when(wide, short_height).otherwise(side).cast("long"),
        }
    )


def resize_savings(images: DataFrame, max_dim: int = MAX_DIM) -> DataFrame:
    """Per context: pages, pages shrunk, pixels before and saved."""
    before = F.col("turned_width") * F.col("turned_height")
    after = F.col("out_width") * F.col("out_height")
    return (
        resize_plan(images, max_dim)
        .groupBy("context_id")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(before > after).alias("shrunk"),
            F.sum(before).alias("pixels"),
            F.sum(before - after).alias("saved"),
        )
    )
