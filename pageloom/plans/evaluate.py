"""Scores of a transcription run against gold texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.operators import quality


def evaluate(gold: DataFrame, output: DataFrame) -> DataFrame:
    """(key, text) frames to accuracy, punctuation scores and pass flags per key present on both sides."""
    pairs = quality.pair_eval(gold, output).filter("pairing = 'paired'").drop("pairing")
    return quality.quality_gate(quality.punctuation_scores(quality.cer(pairs))).drop("gold", "output")
