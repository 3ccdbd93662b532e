"""URL verdicts: fixed rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import stage

FEATURES = 1 << 14
GRAMS = (3, 4)
# the labelled URL table is small: at most so many rows, those with the lowest hash, are learned from
LABELLED = 10_000
THRESHOLD = 0.5

Rule = tuple[str, str]  # verdict, host followed by the path's beginning


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty where there is no ``://`` or the URL is null."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def _ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Rules are a short list of the caller's."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: len(x[1])):
        name, begin = text.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path with their ends marked; repeats count once."""

    def of(part: str, text: Column) -> Column:
        letters = F.split(F.concat(F.lit("<"), text, F.lit(">")), "")

        # by index into the list of characters: taking substrings would walk a long URL from its start at every place
        def runs(n: int) -> Column:
            def at(c: Column) -> Column:
                places = F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0)))
                return F.transform(places, lambda i: F.concat(F.lit(part), *(F.coalesce(F.get(c, i + k), F.lit("")) for k in range(n))))

            return F.transform(F.array(letters), at)[0]

        return F.concat(*map(runs, GRAMS))

    return F.array_distinct(F.concat(of("h", host), of("p", path)))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labelled: DataFrame | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    most: int = LABELLED,
) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule``, ``score`` (of being blocked) and ``verdict``.

    A rule fits its host and all subdomains where the path starts with the rule's, and the longest wins. Elsewhere a
    score of at least 0.5 blocks. The model learns from ``labelled`` (url, blocked boolean); without that table,
    from the pages that rules decide. At most ``most`` different labelled (host, path) are used, chosen by hash over all
    rows, so repeated rows weigh nothing extra. A null URL or one without ``://`` has empty parts and is
    judged by the model like any other. If labels are all of one kind, the model gives that kind's verdict;
    without labels it allows. An empty table gives no rows. Other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))
    parts = pages.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = _ruled(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        known = parts.filter("ruled IS NOT NULL").select("host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        known = labelled.filter("blocked IS NOT NULL").select(
            host.alias("host"), path.alias("path"), F.col("blocked").cast("double").alias("label")
        )
    known = known.groupBy("host", "path").agg(F.max("label").alias("label"))
    known = stage(known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most), "labelled")

    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    featured = lambda df: hashed.transform(df.withColumn("grams", _grams(F.col("host"), F.col("path")))).drop("grams")
    kinds = [row.label for row in known.select("label").distinct().collect()]
    if len(kinds) == 2:
        model = LogisticRegression(regParam=1e-3, maxIter=50).fit(featured(known).coalesce(1))
        scored = model.transform(featured(parts)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = parts.withColumn("score", F.lit(kinds[0] if kinds else 0.0))
    method = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_column), "host", "path", "rule", "score", F.coalesce("ruled", method).alias("verdict"))
