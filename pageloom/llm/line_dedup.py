"""Boilerplate lines, found by the spread of each line over distinct sites, and taken out of documents.

A HyperLogLog sketch of the sites per line hash merges in the map-side and the final aggregate, so a line that
a third of all documents carry costs one sketch per task. Only lines whose estimate is near the threshold
get an exact distinct count, over the rows of those lines. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import unused
from pageloom.session import stage

MIN_SITES = 5
MIN_CHARS = 20
# of a text more than this in shared lines makes it worth asking whether it is a copy
MINOR_PERCENT = 50
PRECISION = 12
# three standard errors of a sketch of that precision
BAND = 3 * 1.04 / 2 ** (PRECISION / 2)

_SPACE = " \t\r"


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_SPACE)))


def _candidates(text: Column, min_chars: int) -> Column:
    """Hashes of a text's lines that are long enough to count."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)))
    return F.array_distinct(F.transform(F.filter(trimmed, lambda x: F.char_length(x) >= min_chars), lambda x: F.xxhash64(x)))


def boilerplate_lines(
    docs: DataFrame,
    text_column: str = "text",
    site_column: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(line, sites): hash of each line on at least ``min_sites`` distinct sites, and how many (estimated far above)."""
    lines = docs.select(
        F.explode(_candidates(F.col(text_column).cast("string"), min_chars)).alias("line"),
        F.col(site_column).cast("string").alias("site"),
    ).filter("site IS NOT NULL")
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", PRECISION)).alias("estimate"))
    sketched = stage(sketched.filter(F.col("estimate") >= min_sites * (1 - BAND)), "spread")
    near = F.col("estimate") <= min_sites * (1 + BAND)
    exact = (
        lines.join(sketched.filter(near), "line", "left_semi")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    return stage(sketched.filter(~near).select("line", F.col("estimate").alias("sites")).unionByName(exact), "boilerplate")


def _judged(docs: DataFrame, lines: DataFrame, text_column: str, site_column: str, min_sites: int, min_chars: int, minor_percent: int) -> DataFrame:
    """(_key, _bad): per text, told by its hash, the lines to take out."""
    text = F.col(text_column).cast("string")
    listed = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(
            i.alias("at"), _line_hash(x).alias("line"), F.char_length(x).alias("chars"), F.char_length(F.btrim(x, F.lit(_SPACE))).alias("n")
        ),
    )
    found = docs.select(
        F.xxhash64(text).alias("_key"),
        F.char_length(F.regexp_replace(text, "\n", "")).alias("total"),
        F.explode(F.filter(listed, lambda x: x["n"] >= min_chars)).alias("x"),
    ).select("_key", "total", "x", F.col("x.line").alias("_line"))
    # one row per text: its shared lines in order, and how many rows have it
    texts = (
        found.join(lines, "_line", "left_semi")
        .groupBy("_key")
        .agg(F.array_sort(F.collect_set("x")).alias("x"), F.max("total").alias("total"), F.count("*").alias("places"))
        .withColumns({"rows": F.expr("places DIV size(x)"), "chars": F.expr("aggregate(x, 0L, (a, v) -> a + v.chars)")})
        .select("_key", F.col("x.line").alias("_all"), "rows", (F.col("chars") * 100 > F.col("total") * minor_percent).alias("mostly"))
    )
    texts = stage(texts, "shared")
    doubtful = texts.filter("mostly")

    # lines that are spread over enough sites even by the texts which they are a minor part of
    asked = doubtful.select(F.explode("_all").alias("_line")).distinct()
    spread = (
        docs.select(F.xxhash64(text).alias("_key"), F.col(site_column).cast("string").alias("site"), F.explode(_candidates(text, min_chars)).alias("_line"))
        .filter("site IS NOT NULL")
        .join(asked, "_line", "left_semi")
        .join(doubtful.select("_key"), "_key", "left_anti")
        .groupBy("_line")
        .agg(F.count_distinct("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("_line", F.lit(True).alias("_own"))
    )
    each = doubtful.select("_key", "rows", F.posexplode("_all").alias("at", "_line")).join(stage(spread, "spread"), "_line", "left")
    each = each.groupBy("_key", "rows").agg(F.array_sort(F.collect_list(F.struct("at", "_line", "_own"))).alias("x"))
    each = stage(
        each.select(
            "_key",
            "rows",
            F.expr("transform(filter(x, v -> v._own), v -> v._line)").alias("_free"),
            F.expr("transform(filter(x, v -> v._own IS NULL), v -> v._line)").alias("_tied"),
        ),
        "doubtful",
    )
    pairs = each.select(
        "_key",
        F.explode(F.expr("array_distinct(transform(slice(_tied, 2, size(_tied)), (v, i) -> xxhash64(_tied[i], v)))")).alias("pair"),
    )
    again = pairs.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1")
    copies = each.filter("rows > 1").select("_key").unionAll(pairs.join(again, "pair", "left_semi").select("_key")).distinct()
    kept = each.join(copies, "_key").select("_key", "_free")
    # of copies only what is spread without them
    judged = texts.join(kept, "_key", "left").select("_key", F.coalesce("_free", "_all").alias("_bad"))
    return judged.filter(F.size("_bad") > 0)


def line_dedup(
    docs: DataFrame,
    text_column: str = "text",
    site_column: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    minor_percent: int = MINOR_PERCENT,
    name: str = "removed_lines",
) -> DataFrame:
    """All columns of ``docs`` with the boilerplate lines taken out of the text, and ``name``, how many went.

    A line is what stands between line feeds, compared without spaces, tabs and carriage returns at its ends; one
    of fewer than ``min_chars`` characters is never boilerplate. A document loses all its lines that are on ``min_sites`` sites,
    whatever their share, unless it is a copy of a whole document, which is left for document deduplication. Copies are told by
    evidence: lines on enough sites are more than ``minor_percent`` of the text, and another row has the same text, or another
    such document has the same two shared lines one after the other (freely spread and own lines between them aside). A
    copy still loses the lines that are on ``min_sites`` sites by documents which they are a minor part of.

    A null text stays null with 0 lines removed, an empty one stays empty; texts may be of any length. A null site counts
    as no site. Repeated rows are all kept; a line repeated inside a document goes at each place. An empty table gives no
    rows. A column that is already named as ``name`` is replaced; other columns may have any names.
    """
    text = F.col(text_column).cast("string")
    lines = boilerplate_lines(docs, text_column, site_column, min_sites, min_chars).select(F.col("line").alias("_line"))
    judged = _judged(docs, lines, text_column, site_column, min_sites, min_chars, minor_percent)
    key, bad = unused("_key", docs.columns), unused("_bad", docs.columns)
    judged = judged.withColumnsRenamed({"_key": key, "_bad": bad})
    joined = docs.withColumn(key, F.xxhash64(text)).join(judged, key, "left")
    parts = F.split(text, "\n")
    is_bad = lambda x: F.array_contains(bad, _line_hash(x))
    touched = F.col(bad).isNotNull()
    return joined.withColumns(
        {
            name: F.when(touched, F.size(F.filter(parts, is_bad))).otherwise(0),
            text_column: F.when(touched, F.array_join(F.filter(parts, lambda x: ~is_bad(x)), "\n")).otherwise(text),
        }
    ).drop(key, bad)
