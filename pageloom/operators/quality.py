"""Transcription quality against a gold text."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import edit
from pageloom.functions.text import normalise_text
from pageloom.schemas import layout

# The marks that are scored, and what a page must reach.
MARKS = string.punctuation + "—"
MIN_ACCURACY = 99
MIN_RECALL = 95
MIN_PRECISION = 95


def pair_eval(gold: DataFrame, output: DataFrame) -> DataFrame:
    """Gold and output texts by key: (key, gold, output, pairing); pairing names a side that is missing."""
    both = gold.select("key", F.col("text").alias("gold")).join(
        output.select("key", F.col("text").alias("output")), "key", "full"
    )
    return both.withColumn(
        "pairing",
        F.when(F.col("output").isNull(), "gold only").when(F.col("gold").isNull(), "output only").otherwise("paired"),
    )


@F.pandas_udf(T.LongType())
def _distance(gold: pd.Series, output: pd.Series) -> pd.Series:
    counts = [None if a is None or b is None else edit.distance(a, b) for a, b in zip(gold, output, strict=True)]
    return pd.Series(counts, dtype="Int64")


def cer(pairs: DataFrame) -> DataFrame:
    """Add gold_chars, distance, cer and accuracy (percent) of the normalised texts.

    cer is NULL for an empty gold text. Nothing is shuffled: a pair is scored where it is.
    """
    gold, output = normalise_text(F.col("gold")), normalise_text(F.col("output"))
    return (
        pairs.withColumn("gold_chars", F.char_length(gold).cast("long"))
        .withColumn("distance", _distance(gold, output))
        .withColumn("cer", F.try_divide("distance", "gold_chars"))
        .withColumn("accuracy", (1 - F.col("cer")) * 100)
    )


@F.pandas_udf(layout("kept BIGINT, missing BIGINT, added BIGINT"))
def _marks(gold: pd.Series, output: pd.Series) -> pd.DataFrame:
    rows = []
    for source, target in zip(gold, output, strict=True):
        if source is None or target is None:
            rows.append((None, None, None))
            continue
        script = edit.alignment(source, target)
        missing = sum(source[at] in MARKS for tag, at, _ in script if tag != "insert")
        added = sum(target[at] in MARKS for tag, _, at in script if tag != "delete")
        total = sum(map(source.count, MARKS))
        rows.append((total - missing, missing, added))
    return pd.DataFrame(rows, columns=["kept", "missing", "added"], dtype="Int64")


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def punctuation_scores(pairs: DataFrame) -> DataFrame:
    """Add kept, missing, added punctuation marks, recall and precision in percent, on the texts as they are.

    Texts without marks have no recall or precision (NULL).
    """
    kept = F.col("kept")
    return (
        pairs.withColumn("_marks", _marks("gold", "output"))
        .select("*", "_marks.*")
        .drop("_marks")
        .withColumn("recall", percent(kept, kept + F.col("missing")))
        .withColumn("precision", percent(kept, kept + F.col("added")))
    )


def quality_gate(scores: DataFrame) -> DataFrame:
    """Add pass flags for accuracy, recall, precision and all of them; a score that is NULL does not pass."""
    accurate = F.coalesce(F.col("accuracy") >= MIN_ACCURACY, F.lit(False))
    recalled = F.coalesce(F.col("recall") > MIN_RECALL, F.lit(False))
    precise = F.coalesce(F.col("precision") > MIN_PRECISION, F.lit(False))
    return scores.withColumns(
        {
            "accuracy_ok": accurate,
            "recall_ok": recalled,
            "precision_ok": precise,
            "passed": accurate & recalled & precise,
        }
    )
