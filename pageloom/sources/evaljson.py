"""Evaluation files: JSON objects that map a key to its image name and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.ordered import position
from pageloom.schemas import EVAL_MAP


# hex digits of a key's digest that name its shard: 256 objects, whatever the number of records
SHARD_DIGITS = 2
RECORDS_PER_OBJECT = 1000


def eval_json(records: DataFrame, digits: int = SHARD_DIGITS, per_object: int = RECORDS_PER_OBJECT) -> DataFrame:
    """Rows (key, image, text) to JSON objects (shard, json), keys sorted.

    A shard is named by the leading ``digits`` hex digits of the key's digest: 0 for one object, 2 for up to 256, 4
    for up to 65,536. The layout follows the parameter alone. Keys are unique, so shards are of like size. A shard of more than
    ``per_object`` records has further rows, each an object with the next keys in order, so nothing is cut.
    """
    shard = F.substring(F.md5("key"), 1, digits) if digits else F.lit("")
    entry = F.struct("key", F.struct("image", "text").alias("value"))
    placed = position(records.select(shard.alias("shard"), "key", "image", "text"), ["shard"], [F.col("key")], "place")
    return (
        placed.groupBy("shard", F.expr(f"(place - 1) DIV {per_object}").alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select("shard", F.to_json(F.map_from_entries("entries")).alias("json"))
    )


def write_eval_json(records: DataFrame, path: str, digits: int = SHARD_DIGITS, per_object: int = RECORDS_PER_OBJECT) -> None:
    """One JSON object per line, spread over files by shard."""
    eval_json(records, digits, per_object).select("json").write.text(path)


# what an object that cannot be parsed is given
BROKEN = "EVAL-01"


def read_eval_json(spark: SparkSession, path: str, whole_file: bool = False, with_code: bool = False) -> DataFrame:
    """Rows (key, image, text). ``whole_file`` reads pretty-printed files of one object each.

    With ``with_code`` rows have a code, and an object that is broken is one row of nulls with EVAL-01; else it is left out.
    """
    lines = spark.read.text(path, wholetext=whole_file)
    parsed = lines.select(F.from_json("value", EVAL_MAP).alias("entries"), (F.trim("value") == "").alias("blank"))
    if not with_code:
        return parsed.select(F.explode("entries").alias("key", "value")).select("key", "value.image", "value.text")
    told = parsed.filter("NOT blank AND (entries IS NULL OR size(entries) > 0)")
    code = F.when(F.col("entries").isNull(), BROKEN).alias("code")
    return told.select(code, F.explode_outer("entries").alias("key", "value")).select("key", "value.image", "value.text", "code")
