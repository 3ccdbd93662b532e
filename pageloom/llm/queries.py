"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.decontaminate import contaminated, question_and_answer
from pageloom.llm.density import extract_pages
from pageloom.llm.edit_counts import build_trees, edited_counts
from pageloom.llm.fingerprints import compare_with_edits
from pageloom.llm.hilbert import hilbert_shards
from pageloom.llm.line_dedup import line_dedup
from pageloom.llm.manifest import leaf_hash, lower_letters, manifest
from pageloom.llm.ngram_join import ngram_join
from pageloom.llm.packing import pack_documents
from pageloom.llm.phrases import collocations
from pageloom.llm.quality import CUT, fit_quality, score_quality
from pageloom.llm.tables import opened, table
from pageloom.llm.topk import top_inner_products
from pageloom.llm.url_filter import judge_urls
from pageloom.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(opened(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by components of 5-word shingle Jaccard of at least 0.8."""
    return ngram_join(table(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more sources share."""
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "removed_lines")


ORACLE["op2_line_dedup"] = r"""
WITH lines AS (
 SELECT DISTINCT trim(line, e' \t\r') AS line, source FROM (SELECT unnest(string_split(text, chr(10))) AS line, source FROM documents)
 WHERE source IS NOT NULL),
bad AS (SELECT line FROM lines WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT source) >= 5),
places AS (
 SELECT text, n_rows, unnest(range(1, len(parts) + 1)) AS place, trim(unnest(parts), e' \t\r') AS line, length(unnest(parts)) AS chars
 FROM (SELECT text, count(*) AS n_rows, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL GROUP BY text)),
shared AS (SELECT * FROM places SEMI JOIN bad USING (line)),
texts AS (
 SELECT text, n_rows, sum(chars) * 100 > length(replace(text, chr(10), '')) * 50 AS mostly FROM shared GROUP BY text, n_rows),
own AS (
 SELECT line FROM shared JOIN documents USING (text) WHERE text NOT IN (SELECT text FROM texts WHERE mostly)
 GROUP BY line HAVING count(DISTINCT source) >= 5),
tied AS (
 SELECT text, line, lead(line) OVER (PARTITION BY text ORDER BY place) AS following
 FROM shared SEMI JOIN (SELECT text FROM texts WHERE mostly) AS m USING (text) WHERE line NOT IN (SELECT line FROM own)),
again AS (SELECT line, following FROM tied WHERE following IS NOT NULL GROUP BY ALL HAVING count(DISTINCT text) > 1),
copies AS (SELECT text FROM texts WHERE mostly AND n_rows > 1 UNION SELECT text FROM tied SEMI JOIN again USING (line, following)),
taken AS (
 SELECT text, list(DISTINCT line) AS taken FROM shared
 WHERE text NOT IN (SELECT text FROM copies) OR line IN (SELECT line FROM own) GROUP BY text)
SELECT doc_id,
 CASE WHEN taken IS NULL THEN text
  ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(taken, trim(x, e' \t\r'))), chr(10)) END AS text,
 cast(CASE WHEN taken IS NULL THEN 0
  ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(taken, trim(x, e' \t\r')))) END AS INTEGER) AS removed_lines
FROM documents LEFT JOIN taken USING (text)
"""

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages' URLs: the rules', else the model's that learns from pages decided by rules."""
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


SHARDS = 40


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of equally many rows along a Hilbert curve over language, source and size."""
    docs = table(spark, sf_dir, "documents")
    encoded = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    listed = docs.select(
        "doc_id", "lang", "source", (F.octet_length(encoded) + 16).cast("long").alias("size"), F.crc32(encoded).alias("text_crc32")
    )
    placed = hilbert_shards(listed, ["lang", "source", "size"], SHARDS, ties=[F.col("text_crc32"), F.col("doc_id")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def quality_model(spark: SparkSession, sf_dir: str, held_out: bool = True):
    """The quality model of a folder; with ``held_out`` every fifth document by crc32 of its id is not learned from."""
    labels = table(spark, sf_dir, "labels")
    if held_out:
        labels = labels.filter(~_held_out())
    return fit_quality(table(spark, sf_dir, "documents"), labels)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from a Bradley-Terry model."""
    scored = score_quality(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = extract_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 128 to 1024 tokens."""
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_group")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they contain."""
    items = question_and_answer(table(spark, sf_dir, "benchmark"))
    return contaminated(table(spark, sf_dir, "documents"), items)


@query
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE["op8_topk_search"] = """
WITH v AS (
 SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
 SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_dot_product(q.v, c.v) AS BIGINT) AS score
 FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.place <> q.place)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


# personal data that is replaced before training: mail addresses and runs of digits as in phone and card numbers
PERSONAL = [(r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+", "[EMAIL]"), (r"\+?\d(?:[ .-]?\d){6,}", "[NUMBER]")]


def redactions(texts: Column) -> Column:
    """Edits that replace personal data in a text."""
    import re

    patterns = [(re.compile(p), by) for p, by in PERSONAL]

    @F.pandas_udf("array<struct<start:int,end:int,replacement:string>>")
    def found(column):
        def edits(text):
            return [{"start": m.start(), "end": m.end(), "replacement": by} for p, by in patterns for m in p.finditer(text or "")]

        return column.map(edits, na_action=None)

    return found(texts)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data is replaced."""
    trees = stage(build_trees(table(spark, sf_dir, "documents"), tokenizer_path()), "trees")
    counted = edited_counts(trees.withColumn("edits", redactions(F.col("text"))), tokenizer_path())
    return counted.select("doc_id", "tokens_before", "tokens_after", "edits_applied", "reencoded_chars")


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE["op11_phrase_mining"] = r"""
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
 FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
 SELECT lang, 1 AS size, unnest(w) AS phrase FROM split
 UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: concat_ws(' ', w[i], w[i + 1]))) FROM split
 UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) FROM split),
f AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
inside AS (
 SELECT lang, phrase, max(a) AS longer
 FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (
 SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, k, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
 FROM cuts c
 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
 JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of an edit of each, and how alike they are."""
    return compare_with_edits(table(spark, sf_dir, "documents"))


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a Merkle tree by source, every fifth by crc32 of its id checked with a tampered text."""
    tampered = leaf_hash(*(lower_letters(F.col(x)) if x == "text" else F.col(x) for x in MANIFEST_FIELDS))
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    return manifest(table(spark, sf_dir, "documents"), MANIFEST_FIELDS, "source", "doc_id", forged)


ORACLE["op13_merkle_manifest"] = """
WITH RECURSIVE d AS (
 SELECT doc_id, source,
  concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
   coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
   lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))) AS crc
 FROM documents),
leaves AS (
 SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(octet_length(encode(lowered)) || ':' || lowered, '-')) AS tampered, coalesce(crc % 5 = 0, false) AS hit FROM d),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS total FROM leaves),
tree AS (
 SELECT source, 0 AS lvl, i, leaf AS h, total FROM placed
 UNION ALL
 SELECT source, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (total + 15) // 16 FROM tree WHERE total > 1 GROUP BY source, lvl, i // 16, total),
subroots AS (
 SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS total FROM tree WHERE total = 1),
top AS (
 SELECT 0 AS lvl, i, subroot AS h, total FROM subroots
 UNION ALL
 SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (total + 15) // 16 FROM top WHERE total > 1 GROUP BY lvl, i // 16, total),
depth AS (SELECT source, max(lvl) AS depth FROM tree GROUP BY source),
ways AS (
 SELECT p.doc_id, p.source, p.leaf, p.i AS leaf_at, t.lvl,
  coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < (p.i >> (4 * t.lvl))), '') AS l,
  coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > (p.i >> (4 * t.lvl))), '') AS r
 FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.total > 1 AND t.i // 16 = (p.i >> (4 * t.lvl)) // 16
 GROUP BY ALL),
top_ways AS (
 SELECT s.source, t.lvl,
  coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < (s.i >> (4 * t.lvl))), '') AS l,
  coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > (s.i >> (4 * t.lvl))), '') AS r
 FROM subroots s JOIN top t ON t.total > 1 AND t.i // 16 = (s.i >> (4 * t.lvl)) // 16
 GROUP BY s.source, s.i, t.lvl),
steps AS (
 SELECT source, leaf_at, lvl, l, r FROM ways
 UNION ALL
 SELECT p.source, p.i, d.depth + t.lvl, t.l, t.r
 FROM placed p JOIN depth d ON d.source IS NOT DISTINCT FROM p.source JOIN top_ways t ON t.source IS NOT DISTINCT FROM p.source),
folds AS (
 SELECT source, i AS leaf_at, 0::BIGINT AS lvl, CASE WHEN hit THEN tampered ELSE leaf END AS h FROM placed
 UNION ALL
 SELECT f.source, f.leaf_at, f.lvl + 1, sha256(s.l || f.h || s.r)
 FROM folds f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.leaf_at = f.leaf_at AND s.lvl = f.lvl),
ends AS (SELECT source, leaf_at, arg_max(h, lvl) AS folded_root FROM folds GROUP BY ALL),
proofs AS (SELECT source, leaf_at, string_agg(l || r, '' ORDER BY lvl) AS siblings FROM steps GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.subroot, top.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN top ON top.total = 1
JOIN ends e ON e.source IS NOT DISTINCT FROM p.source AND e.leaf_at = p.i
LEFT JOIN proofs o ON o.source IS NOT DISTINCT FROM p.source AND o.leaf_at = p.i
"""
