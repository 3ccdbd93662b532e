"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage works on all that the one before kept, and each but the last returns the columns of its input. Rows are told apart
by their place in the table that a stage reads, so null and repeated ids are no special case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.decontaminate import contaminated, question_and_answer
from pageloom.llm.line_dedup import line_dedup
from pageloom.llm.ngram_join import ngram_join
from pageloom.llm.packing import pack_documents
from pageloom.llm.quality import CUT, fit_quality, score_quality
from pageloom.llm.queries import tokenizer_path
from pageloom.llm.tables import opened, table, unused
from pageloom.session import stage

# the last stages run in executors that the ones before have filled, and what they hold goes with the batch
SMALL_BATCH = 4 * 1024 * 1024
_ROW, _SCORE = "_row_of_stage", "_score_of_stage"


def _numbered(docs: DataFrame) -> DataFrame:
    """With a number per row that is the same whenever this written table is read in the session."""
    return docs.withColumn(_ROW, F.monotonically_increasing_id())


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from all labels of documents in ``docs``, does not reject.

    Null texts are judged as empty ones. Without labels of both kinds every document stays.
    """
    opened(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, name=_SCORE).filter(F.col(_SCORE) >= CUT).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more sources share; every document stays and ``n_chars`` follows its text.

    Null and empty texts stay as they are, repeated rows are all kept, an empty table stays empty, other columns may have any names.
    """
    opened(spark)
    columns = docs.columns
    removed = unused("removed_lines", columns)
    cleaned = line_dedup(docs, name=removed)
    if "n_chars" in columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(removed) > 0, length).otherwise(F.col("n_chars")))
    return cleaned.select(*columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard the one with the smallest doc_id, null first; texts without words all stay."""
    opened(spark)
    numbered = _numbered(docs)
    linked = ngram_join(numbered.select(F.struct("doc_id", _ROW).alias("id"), "text"), "id")
    others = linked.filter("id <> component_id").select(F.col(f"id.{_ROW}").alias(_ROW))
    return numbered.join(others, _ROW, "left_anti").select(*docs.columns)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts stay."""
    opened(spark, SMALL_BATCH)
    numbered = _numbered(docs)
    items = question_and_answer(table(spark, sf_dir, "benchmark"))
    found = contaminated(numbered.select(_ROW, "text"), items, _ROW).select(_ROW).distinct()
    return numbered.join(stage(found, "contaminated"), _ROW, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of up to 1024 tokens, with the token ids.

    A null or empty text is the end token alone, a repeated row is packed again, an empty table gives no pieces.
    """
    opened(spark, SMALL_BATCH)
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmarks),
    ("packing", pack),
]

# a learned model and token ids are nothing that SQL says; the tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(opened(spark), sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "corpus")
    return docs
