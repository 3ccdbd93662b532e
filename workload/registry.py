"""The registered queries: a Spark job per operator and, where SQL can say it, the same for DuckDB.

Times are returned as text with microseconds and floats rounded to six digits, so that both engines
hash alike; everything else is what the operator returns.
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.text import normalise_text
from pageloom.operators import claims, inference, lifecycle, merge, opmetrics, quality, results, search
from pageloom.plans import process
from pageloom.plans.enhance import enhance_prompts
from pageloom.plans.evaluate import evaluate
from pageloom.plans.submit import submit
from pageloom.schemas import ARCHIVES, OUTCOMES
from pageloom.session import fresh_path, prepare, ship, stage
from pageloom.sources import archives, evaljson, logs, objects, zipfiles
from pageloom.sources import tasks as task_table
from pageloom.sources.tasks import payload_fields
from pageloom.sources.versions import Version, VersionedTable
from pageloom.streaming import processors, queue
from workload import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLE = "transcription_tasks"
BASE_URL = "https://pages.example.org/contexts"
SQL_NOW = f"TIMESTAMP '{views.NOW}'"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def now() -> Column:
    return F.to_timestamp(F.lit(views.NOW))


def _ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


class Inputs:
    """Views and tables of one folder, opened when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)

    def stream(self, name: str) -> DataFrame:
        """A view over its base tables read as streams."""

        def opened(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
            schema = views.table(spark, sf_dir, table).schema
            # a pattern, as a stream takes one for a single file and for a folder of files
            return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")

        return views.view(self.spark, self.sf_dir, name, opened)

    def fresh(self, label: str) -> str:
        return fresh_path(self.spark, label)


def _present(df: DataFrame) -> DataFrame:
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, TIME_FORMAT)
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def query(name: str, sql: str | None = None):
    """Register a function of Inputs, with its DuckDB text."""

    def add(function: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark, "pageloom", "workload")
            return _present(function(Inputs(prepare(spark), sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = views.with_views(sql)
        return function

    return add


def _tasks_sql(changes: dict[str, str] | None = None, source: str = "tasks t") -> str:
    """SELECT of the task columns with some of them replaced."""
    columns = {name: f"t.{name}" for name in (
        "id context_id status created_by payload failure_reason created_at started_at finished_at priority".split())}
    columns |= changes or {}
    for name in ("created_at", "started_at", "finished_at"):
        columns[name] = _ts(columns[name])
    return "SELECT " + ", ".join(f"{text} AS {name}" for name, text in columns.items()) + f" FROM {source}"


# --- sources and sinks -------------------------------------------------------------------------------


def packed_archives(i: Inputs) -> DataFrame:
    """Zip files made of conversations: an entry per turn, up to 100 turns to an archive.

    Archives that open with a system turn are cut in half on their way.
    """
    archive = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 100)).alias("archive")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")

    def pack(batches):
        for batch in batches:
            packed = []
            for listed in batch["turns"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
                    for turn in listed:
                        lead = b"\xff\xd8\xff\xe0" if turn["role"] == "user" else b"\x89PNG\r\n\x1a\n"
                        out.writestr(f"scans/{turn['turn']}_{turn['role']}.img", lead + turn["text"].encode())
                whole = held.getvalue()
                packed.append(whole[: len(whole) // 2] if listed[0]["role"] == "system" else whole)
            yield pd.DataFrame({"archive": batch["archive"], "content": packed})

    return i.conversations.groupBy(archive).agg(turns).mapInPandas(pack, ARCHIVES)


PACKED_SQL = """a AS (SELECT concat(cast(conv_id AS varchar), '-', cast(floor(turn / 100) AS bigint)) AS archive, turn, role, text,
  row_number() OVER (PARTITION BY conv_id, floor(turn / 100) ORDER BY turn) - 1 AS idx FROM conversations),
 broken AS (SELECT archive FROM a WHERE idx = 0 AND role = 'system')"""


LISTED_SQL = f"""WITH {PACKED_SQL}
SELECT archive, idx, concat('scans/', turn, '_', role, '.img') AS filename, false AS is_dir,
 CASE WHEN role = 'user' THEN 4 ELSE 8 END + strlen(text) AS size,
 left(concat(CASE WHEN role = 'user' THEN 'FFD8FFE0' ELSE '89504E470D0A1A0A' END, hex(encode(text))), 32) AS head, NULL AS code
FROM a WHERE archive NOT IN (SELECT archive FROM broken)
UNION ALL SELECT archive, -1, NULL, false, -1, NULL, 'ZIP-01' FROM broken"""


def _listed(entries: DataFrame) -> DataFrame:
    return entries.select(
        "archive", F.coalesce("idx", F.lit(-1)).alias("idx"), "filename",
        F.coalesce("is_dir", F.lit(False)).alias("is_dir"),
        F.coalesce("size", F.lit(-1)).alias("size"), F.hex("head_bytes").alias("head"), "code",
    )


@query("archive_entries", LISTED_SQL)
def _(i):
    return _listed(archives.archive_entries(packed_archives(i)))


def _as_files(packed: DataFrame, folder: str) -> None:
    """Each archive as a file of its own, written where its row is."""

    def write(rows):
        files, root = zipfiles._opened(folder)
        files.create_dir(root)
        for row in rows:
            with files.open_output_stream(f"{root}/{row['archive']}") as out:
                out.write(bytes(row["content"]))

    packed.foreachPartition(write)


@query("zip_entries", LISTED_SQL)
def _(i):
    """Archives listed where they lie, without their bytes in a row."""
    folder = i.fresh("zips")
    _as_files(packed_archives(i), folder)
    i.spark.dataSource.register(zipfiles.ZipEntries)
    return _listed(i.spark.read.format("zip_entries").load(folder))


KEPT = """NOT is_dir AND filename NOT LIKE '\\_\\_MACOSX/%' ESCAPE '\\'
 AND regexp_extract(filename, '[^/]*$') <> '.DS_Store' AND regexp_extract(filename, '[^/]*$') NOT LIKE '.\\_%' ESCAPE '\\'"""


@query("drop_artifacts", f"SELECT archive, idx, filename, size FROM entries WHERE {KEPT}")
def _(i):
    return archives.drop_artifacts(i.entries).select("archive", "idx", "filename", "size")


KIND = """CASE WHEN hex(head_bytes) LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN hex(head_bytes) LIKE '89504E470D0A1A0A%' THEN 'image/png'
 WHEN hex(head_bytes) LIKE '47494638%' THEN 'image/gif' END"""


@query("sniff_media_type", f"""WITH k AS (SELECT *, {KIND} AS media_type FROM entries)
SELECT archive, idx, media_type, CASE WHEN media_type IS NULL THEN 'ZIP-05' WHEN media_type = 'image/gif' THEN 'ZIP-06' END AS format_code
FROM k""")
def _(i):
    return archives.sniff_media_type(i.entries).select("archive", "idx", "media_type", "format_code")


VERDICTS = f"""k AS (SELECT *, {KIND} AS media_type FROM entries WHERE {KEPT}),
 e AS (SELECT *, CASE WHEN size > 41943040 THEN 'ZIP-04' WHEN media_type IS NULL THEN 'ZIP-05'
   WHEN media_type = 'image/gif' THEN 'ZIP-06' END AS entry_code FROM k),
 v AS (SELECT archive, count(*) AS images, arg_min(entry_code, idx) FILTER (WHERE entry_code IS NOT NULL) AS first_code
   FROM e GROUP BY archive),
 verdict AS (SELECT n.archive, coalesce(images, 0) AS images, CASE WHEN images IS NULL THEN 'ZIP-02'
   WHEN images > {views.MAX_IMAGES} THEN 'ZIP-03' ELSE first_code END AS code FROM archive_names n LEFT JOIN v USING (archive))"""


def _verdicts(i: Inputs) -> DataFrame:
    return archives.validate_archives(i.archive_names, i.entries, views.MAX_IMAGES)


@query("validate_archives", f"WITH {VERDICTS} SELECT * FROM verdict")
def _(i):
    return _verdicts(i)


NAMED = f"""{VERDICTS}, named AS (SELECT e.archive, e.idx,
  row_number() OVER (PARTITION BY e.archive ORDER BY e.idx) - 1 AS object_index,
  regexp_extract(filename, '[^/]*$') AS original_file_name FROM e JOIN verdict d USING (archive) WHERE d.code IS NULL)"""


def _named(i: Inputs) -> DataFrame:
    return archives.assign_object_names(archives.accepted_images(i.entries, _verdicts(i)))


@query("assign_object_names", f"""WITH {NAMED}
SELECT archive, idx, object_index, printf('%04d', object_index) || '_' || original_file_name AS object_name FROM named""")
def _(i):
    return _named(i).select("archive", "idx", "object_index", "object_name")


ENQUEUED = f"""sha256(context_id || '/' || object_name) AS id, context_id, 'pending' AS status, created_by,
 to_json({{'object_name': object_name, 'file_path': context_id || '/' || object_name,
 'original_file_name': original_file_name}})::varchar AS payload, NULL::varchar AS failure_reason,
 {_ts(SQL_NOW)} AS created_at, NULL::varchar AS started_at, NULL::varchar AS finished_at, 'standard' AS priority"""


@query("enqueue_tasks", f"""WITH {NAMED}, o AS (SELECT archive AS context_id, 'u' || o_custkey % 10 AS created_by,
 printf('%04d', object_index) || '_' || original_file_name AS object_name, original_file_name
 FROM named JOIN orders ON archive = cast(o_orderkey AS varchar))
SELECT {ENQUEUED} FROM o""")
def _(i):
    uploads = i.orders.select(
        F.col("o_orderkey").cast("string").alias("archive"),
        F.col("o_orderkey").cast("string").alias("context_id"),
        F.concat(F.lit("u"), F.col("o_custkey") % 10).alias("created_by"),
    )
    return archives.enqueue_tasks(_named(i).join(uploads, "archive"), now())


@query("scan_tasks", """SELECT id, context_id, status, priority, status IN ('pending', 'running', 'done', 'failed') AS valid
FROM raw_tasks""")
def _(i):
    path = i.fresh("tasks")
    task_table.write_snapshot(i.raw_tasks, path)
    checked = task_table.scan_tasks(task_table.read_tasks(i.spark, path))
    return checked.select("id", "context_id", "status", "priority", "valid")


@query("payload_fields", """WITH p AS (SELECT id, CASE WHEN json_valid(payload) THEN payload END AS j FROM raw_tasks)
SELECT id, json_extract_string(j, '$.object_name') AS object_name, json_extract_string(j, '$.file_path') AS file_path,
 j IS NOT NULL AND json_extract_string(j, '$.file_path') IS NOT NULL AS payload_valid FROM p""")
def _(i):
    return task_table.payload_fields(i.raw_tasks).select("id", "object_name", "file_path", "payload_valid")


STORED = "'=== ' || original_file_name || ' ===' || chr(10) || text || chr(10) || chr(10)"


@query("object_inventory", f"""WITH t AS (SELECT context_id, string_agg({STORED}, '' ORDER BY object_name) AS text
 FROM pages_text GROUP BY 1)
SELECT left(md5(context_id), 2) AS bucket, sum(strlen(text) + 1)::bigint AS length FROM t GROUP BY 1""")
def _(i):
    path = i.fresh("export")
    merged = merge.merge_transcripts(merge.format_page(i.pages_text))
    objects.export_transcripts(merged.withColumn("bucket", objects.bucket_of("context_id")), path, "bucket")
    listed = objects.object_inventory(i.spark, path, "bucket=")
    folder = F.substring_index(F.split("key", "/")[0], "=", -1)
    return listed.groupBy(folder.alias("bucket")).agg(F.sum("length").alias("length"))


@query("orphan_objects", """SELECT key, length FROM objects
WHERE split_part(key, '/', 1) NOT IN (SELECT context_id FROM tasks)""")
def _(i):
    return objects.orphan_objects(i.objects, i.tasks).select("key", "length")


@query("write_page_text", f"""SELECT context_id || '/outputs/' || object_name || '.txt' AS key, {STORED} AS text FROM pages_text""")
def _(i):
    path = i.fresh("pages")
    pages = merge.format_page(i.pages_text)
    objects.write_page_text(pages.withColumn("text", F.lit("first try")), path, 0)
    objects.write_page_text(pages, path, 1)
    return objects.read_page_text(i.spark, path).select("key", "text")


MERGED = f"""placed AS (SELECT *, (row_number() OVER (PARTITION BY context_id ORDER BY object_name) - 1) // 100 AS part
 FROM pages_text WHERE text IS NOT NULL),
 merged AS (SELECT context_id, part, count(*) AS pages, string_agg({STORED}, '' ORDER BY object_name) AS text FROM placed GROUP BY 1, 2)"""


@query("write_transcripts", f"WITH {MERGED} SELECT context_id, part, text, left(md5(context_id), 2) AS bucket FROM merged")
def _(i):
    path = i.fresh("transcripts")
    objects.write_transcripts(
        merge.merge_transcripts(merge.format_page(i.pages_text)).select("context_id", "part", "text"), path
    )
    return objects.read_transcripts(i.spark, path)


@query("read_eval_json", "SELECT key, image, text FROM eval_gold")
def _(i):
    path = i.fresh("eval")
    evaljson.write_eval_json(i.eval_gold, path)
    return evaljson.read_eval_json(i.spark, path)


@query("write_eval_json", """SELECT left(md5(key), 2) AS shard,
 '{' || string_agg(to_json(key)::varchar || ':' || to_json({'image': image, 'text': text})::varchar, ',' ORDER BY key) || '}' AS json
FROM eval_gold GROUP BY 1""")
def _(i):
    return evaljson.eval_json(i.eval_gold)


@query("log_activity", """SELECT CASE WHEN status = 'failed' THEN 'WARNING' ELSE 'INFO' END AS level,
 CASE WHEN status = 'pending' THEN 'api' ELSE 'queue' END AS logger,
 CASE WHEN status <> 'pending' THEN context_id END AS context_id, count(*) AS lines FROM tasks GROUP BY 1, 2, 3""")
def _(i):
    return logs.log_activity(i.log_lines)


# --- filters and results -----------------------------------------------------------------------------


@query("tasks_by_status", f"SELECT id, context_id, status, {_ts('started_at')} AS started_at FROM tasks WHERE status IN ('running', 'failed')")
def _(i):
    return results.tasks_by_status(i.tasks, "running", "failed").select("id", "context_id", "status", "started_at")


@query("stale_tasks", f"""SELECT id, context_id, {_ts('started_at')} AS started_at FROM tasks
WHERE status = 'running' AND started_at < {SQL_NOW} - INTERVAL {views.STALE_MINUTES} MINUTE""")
def _(i):
    return lifecycle.stale_tasks(i.tasks, now(), views.STALE_MINUTES).select("id", "context_id", "started_at")


@query("context_owner", "SELECT context_id, min(created_by) AS owner FROM tasks GROUP BY 1")
def _(i):
    return results.context_owner(i.tasks)


OWNERS = "o AS (SELECT context_id, min(created_by) AS owner FROM tasks GROUP BY 1)"


@query("owned_contexts", f"""WITH {OWNERS} SELECT request_id, r.context_id, user_id,
 CASE WHEN owner IS NULL OR owner <> user_id THEN 'TS-07' END AS code FROM requests r LEFT JOIN o USING (context_id)""")
def _(i):
    return results.owned_contexts(i.requests, i.tasks).select("request_id", "context_id", "user_id", "code")


@query("failure_reasons", f"""SELECT context_id, row_number() OVER (PARTITION BY context_id ORDER BY finished_at DESC NULLS FIRST, id) AS reason_no,
 id, failure_reason, {_ts('finished_at')} AS finished_at FROM tasks WHERE status = 'failed'""")
def _(i):
    return results.failure_reasons(i.tasks)


@query("derive_result", f"""WITH p AS (SELECT context_id, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done,
  count(*) FILTER (WHERE status = 'failed') AS failed FROM tasks GROUP BY 1),
 n AS (SELECT context_id, id || '=' || failure_reason AS reason,
  row_number() OVER (PARTITION BY context_id ORDER BY finished_at DESC NULLS FIRST, id) AS reason_no FROM tasks WHERE status = 'failed'),
 r AS (SELECT context_id, ((reason_no - 1) // 100)::bigint AS reasons_page, string_agg(reason, '; ' ORDER BY reason_no) AS failure_reasons
  FROM n GROUP BY 1, 2)
SELECT context_id, CASE WHEN done + failed = total THEN 'done' WHEN done + failed > 0 THEN 'running' ELSE 'pending' END AS status,
 total, done, failed, coalesce(reasons_page, 0) AS reasons_page, coalesce(failure_reasons, '') AS failure_reasons,
 CASE WHEN done + failed = total THEN '{BASE_URL}/' || context_id || '/download' ELSE '' END AS download_link
FROM p LEFT JOIN r USING (context_id)""")
def _(i):
    reasons = F.transform("failure_reasons", lambda r: F.concat(r["id"], F.lit("="), r["failure_reason"]))
    return results.derive_result(i.tasks, BASE_URL).withColumn("failure_reasons", F.array_join(reasons, "; "))


@query("downloadable", f"""WITH {OWNERS}, c AS (SELECT request_id, r.context_id, user_id, owner, generation
 FROM requests r LEFT JOIN o USING (context_id) LEFT JOIN completed_before b ON r.context_id = b.context_id)
SELECT request_id, context_id, CASE WHEN owner IS NULL OR owner <> user_id THEN 'TS-07' WHEN generation IS NULL THEN 'TS-08' END AS code,
 CASE WHEN owner = user_id THEN coalesce(generation, -1) ELSE -1 END AS generation FROM c""")
def _(i):
    found = results.downloadable(i.requests, i.tasks, i.completed_before)
    return found.select("request_id", "context_id", "code", F.coalesce("generation", F.lit(-1)).alias("generation"))


CODE_SQL = "nullif(regexp_extract(failure_reason, '((?:ZIP|TS|WSP|CRWC)-[0-9]{2})', 1), '')"


def _codes_sql() -> str:
    from pageloom.functions.codes import CODES

    rows = ", ".join(f"('{code}', {status}, '{message}')" for code, status, message in CODES)
    return f"d(code, http_status, message) AS (VALUES {rows})"


@query("error_dimension", f"""WITH {_codes_sql()}, f AS (SELECT {CODE_SQL} AS code, count(*) AS tasks FROM tasks
 WHERE status = 'failed' GROUP BY 1)
SELECT d.code, http_status::bigint AS http_status, message, coalesce(tasks, 0) AS tasks FROM d LEFT JOIN f USING (code)""")
def _(i):
    return opmetrics.code_usage(i.tasks)


# --- claims ------------------------------------------------------------------------------------------

NAME = "json_extract_string(payload, '$.object_name')"
TIER = "CASE priority WHEN 'enterprise' THEN 0 WHEN 'premium' THEN 1 WHEN 'standard' THEN 2 ELSE 3 END"


def _numbered(order: str, source: str, n: int = views.CLAIM) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {order}) AS claim_no, id, context_id FROM {source}
 QUALIFY claim_no <= {n}"""


@query("claim_fifo", _numbered(f"created_at, {NAME}, id", "tasks WHERE status = 'pending'"))
def _(i):
    return claims.claim_fifo(i.tasks, views.CLAIM)


def _licq_sql(n: int, lead: str = "", served: str = "NULL::bigint", where: str = "true") -> str:
    return f"""p AS (SELECT *, {NAME} AS object_name, {TIER} AS tier FROM tasks WHERE status = 'pending' AND {where}),
 q AS (SELECT *, row_number() OVER (PARTITION BY context_id{lead} ORDER BY created_at, object_name, id) AS round FROM p),
 c AS (SELECT context_id, max(started_at) AS last, {served} AS served FROM tasks t WHERE {where} GROUP BY context_id)"""


@query("claim_licq", f"""WITH {_licq_sql(views.CLAIM)},
 f AS (SELECT context_id, created_at AS c1, object_name AS c2, id AS c3 FROM q WHERE round = 1),
 j AS (SELECT q.id, context_id, round, last, c1, c2, c3 FROM q JOIN c USING (context_id) JOIN f USING (context_id))
{_numbered('round, last NULLS FIRST, c1, c2, c3', 'j')}""")
def _(i):
    return claims.claim_licq(i.tasks, views.CLAIM)


@query("claim_priority", _numbered(f"{TIER}, created_at, {NAME}, id", "tasks WHERE status = 'pending'"))
def _(i):
    return claims.claim_fifo(i.tasks, views.CLAIM, claims.TIERS)


@query("claim_priority_licq", f"""WITH {_licq_sql(views.CLAIM, ', tier')},
 w AS (SELECT context_id, count(*) FILTER (WHERE tier = 0) AS w0, count(*) FILTER (WHERE tier = 1) AS w1 FROM p GROUP BY 1),
 f AS (SELECT context_id, tier AS c0, created_at AS c1, object_name AS c2, id AS c3 FROM q
  QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY tier, created_at, object_name, id) = 1),
 j AS (SELECT q.id, context_id, tier, round, last, c0, c1, c2, c3, CASE WHEN tier > 1 THEN w1 ELSE 0 END AS t1,
  CASE WHEN tier > 0 THEN w0 ELSE 0 END AS t0
  FROM q JOIN c USING (context_id) JOIN f USING (context_id) JOIN w USING (context_id))
{_numbered('tier, round, t1, t0, last NULLS FIRST, c0, c1, c2, c3', 'j')}""")
def _(i):
    return claims.claim_licq(i.tasks, views.CLAIM, claims.TIERS)


HALF = views.CLAIM // 2


@query("claim_mixed", f"""WITH fifo AS (SELECT *, 'fifo' AS kind FROM ({_numbered(f"created_at, {NAME}, id", "tasks WHERE status = 'pending'", HALF)})),
 {_licq_sql(HALF, where='id NOT IN (SELECT id FROM fifo)',
            served='(SELECT max(claim_no) FROM fifo WHERE fifo.context_id = t.context_id)')},
 f AS (SELECT context_id, created_at AS c1, object_name AS c2, id AS c3 FROM q WHERE round = 1),
 j AS (SELECT q.id, context_id, round, last, served, c1, c2, c3 FROM q JOIN c USING (context_id) JOIN f USING (context_id))
SELECT claim_no, id, context_id, kind FROM fifo
UNION ALL SELECT *, 'licq' FROM ({_numbered('round, served NULLS FIRST, last NULLS FIRST, c1, c2, c3', 'j', HALF)})""")
def _(i):
    return claims.claim_mixed(i.tasks, HALF, HALF)


@query("claim_custom", _numbered(f"created_by, priority DESC, created_at, {NAME}, id", "tasks WHERE status = 'pending'"))
def _(i):
    return claims.claim_custom(i.tasks, views.CLAIM, [F.col("created_by").asc(), F.col("priority").desc()])


@query("apply_claim", "WITH k AS (" + _numbered(f"created_at, {NAME}, id", "tasks WHERE status = 'pending'") + ") " + _tasks_sql({
    "status": "CASE WHEN k.id IS NULL THEN t.status ELSE 'running' END",
    "started_at": f"CASE WHEN k.id IS NULL THEN t.started_at ELSE {SQL_NOW} END"}, "tasks t LEFT JOIN k ON t.id = k.id"))
def _(i):
    return lifecycle.apply_claim(i.tasks, claims.claim_fifo(i.tasks, views.CLAIM), now())


@query("queue_position", f"""SELECT id, context_id, row_number() OVER (ORDER BY created_at, {NAME}, id) - 1 AS ahead
FROM tasks WHERE status = 'pending'""")
def _(i):
    return claims.queue_position(i.tasks)


# --- aggregates and metrics --------------------------------------------------------------------------

PROGRESS = """p AS (SELECT context_id, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done,
 count(*) FILTER (WHERE status = 'failed') AS failed FROM tasks GROUP BY 1)"""


@query("context_progress", f"WITH {PROGRESS} SELECT * FROM p")
def _(i):
    return results.context_progress(i.tasks)


@query("finished_contexts", f"WITH {PROGRESS} SELECT * FROM p WHERE done + failed = total")
def _(i):
    return results.finished_contexts(results.context_progress(i.tasks))


@query("context_idle", f"""SELECT context_id, {_ts('max(started_at)')} AS last_started,
 coalesce(trunc((epoch_us({SQL_NOW}) - epoch_us(max(started_at))) / 1e6)::bigint, -1) AS idle_s FROM tasks GROUP BY 1""")
def _(i):
    return results.context_idle(i.tasks, now()).withColumn("idle_s", F.coalesce("idle_s", F.lit(-1)))


@query("task_counters", f"""SELECT '{TABLE}' AS "table", status, count(*) AS tasks FROM tasks WHERE status IN ('done', 'failed') GROUP BY ALL""")
def _(i):
    return opmetrics.task_counters(i.tasks, TABLE)


def _hist_sql(keys: str, value: str, source: str) -> str:
    bounds = ", ".join(f"('{bound}', {bound}.0)" for bound in opmetrics.BOUNDS)
    return f"""WITH s AS (SELECT {keys}, {value} AS v FROM {source}), b(le, bound) AS (VALUES {bounds}, ('+Inf', 1e300)),
 g AS (SELECT {keys.split(' AS ')[-1]} AS k, round(sum(v), 6) AS total FROM s GROUP BY 1)
SELECT g.k AS {keys.split(' AS ')[-1]}, le, total, count(*) FILTER (WHERE v <= bound) AS count
FROM s JOIN g ON s.{keys.split(' AS ')[-1]} = g.k CROSS JOIN b GROUP BY ALL"""


@query("task_duration_hist", _hist_sql(f"""'{TABLE}' AS "table\"""", "(epoch_us(finished_at) - epoch_us(started_at)) / 1e6",
                                       "tasks WHERE finished_at IS NOT NULL"))
def _(i):
    return opmetrics.task_duration_hist(i.tasks, TABLE)


@query("llm_duration_hist", _hist_sql("model", "duration_s", "page_outputs"))
def _(i):
    return opmetrics.model_duration_hist(i.page_outputs)


@query("tokens_by_model", """SELECT model, 'input' AS direction, sum(input_tokens)::bigint AS tokens FROM page_outputs GROUP BY 1
UNION ALL SELECT model, 'output', sum(output_tokens)::bigint FROM page_outputs GROUP BY 1""")
def _(i):
    return opmetrics.tokens_by_model(i.page_outputs)


def _gauge_rows() -> str:
    parts = []
    for place, name in enumerate(("utilization", "memory_used", "memory_total", "power_draw", "power_limit", "temperature"), 1):
        factor = " * 1048576" if name.startswith("memory") else ""
        parts.append(f"SELECT ts, '{name}' AS gauge, trim(split_part(line, ',', {place}))::double{factor} AS value FROM gpu_samples")
    return "s AS (" + " UNION ALL ".join(parts) + ")"


@query("gpu_gauges", f"WITH {_gauge_rows()} SELECT gauge, {_ts('max(ts)')} AS ts, round(arg_max(value, ts), 6) AS value FROM s GROUP BY 1")
def _(i):
    return opmetrics.gpu_gauges(i.gpu_samples)


# means of two-digit numbers often end in an exact half, which engines round either way
NEAR_HALF = 0.500001


@query("gpu_windows", f"""WITH {_gauge_rows()} SELECT gauge, {_ts("date_trunc('hour', ts)")} AS window_start, count(*) AS samples,
 floor(avg(value) * 1000 + {NEAR_HALF}) / 1000 AS mean, round(max(value), 6) AS peak, round(arg_max(value, ts), 6) AS last FROM s GROUP BY gauge, date_trunc('hour', ts)""")
def _(i):
    mean = F.floor(F.col("mean") * 1000 + NEAR_HALF) / 1000
    return opmetrics.gpu_windows(i.gpu_samples).withColumn("mean", mean)


@query("throughput", f"""WITH m AS (SELECT date_trunc('minute', finished_at) AS w, context_id FROM tasks WHERE status = 'done')
SELECT {_ts('w')} AS window_start, context_id, count(*) AS pages FROM m GROUP BY w, context_id
UNION ALL SELECT {_ts('w')}, NULL, count(*) FROM m GROUP BY w""")
def _(i):
    return opmetrics.throughput(i.tasks)


@query("context_batches", """WITH s AS (SELECT context_id, count(*) FILTER (WHERE status = 'done') AS pages,
 (epoch_us(max(finished_at)) - epoch_us(min(started_at))) / 1e6 AS span_s FROM tasks WHERE finished_at IS NOT NULL GROUP BY 1)
SELECT context_id, pages, round(span_s, 6) AS span_s, round(pages * 60 / span_s, 6) AS per_min FROM s""")
def _(i):
    return opmetrics.context_batches(i.tasks)


@query("errors_by_code", f"""WITH {_codes_sql()}, f AS (SELECT {CODE_SQL} AS code, count(*) AS tasks FROM tasks
 WHERE status = 'failed' GROUP BY 1)
SELECT f.code, http_status::bigint AS http_status, message, tasks FROM f LEFT JOIN d USING (code)""")
def _(i):
    return opmetrics.errors_by_code(i.tasks)


@query("tasks_inflight", f"""WITH e AS (SELECT started_at AS ts, 1 AS step FROM tasks WHERE started_at IS NOT NULL
 UNION ALL SELECT finished_at, -1 FROM tasks WHERE finished_at IS NOT NULL),
 g AS (SELECT ts, sum(step) AS step FROM e GROUP BY 1)
SELECT '{TABLE}' AS "table", {_ts('ts')} AS ts, (sum(step) OVER (ORDER BY ts))::bigint AS inflight FROM g""")
def _(i):
    return opmetrics.tasks_inflight(i.tasks, TABLE)


# --- state changes -----------------------------------------------------------------------------------

LAST_OUTCOME = """o AS (SELECT task_id, arg_max(status, finished_at) AS s, arg_max(failure_reason, finished_at) AS r, max(finished_at) AS f
 FROM outcomes GROUP BY 1)"""
RECORDED = f"WITH {LAST_OUTCOME} " + _tasks_sql({
    "status": "coalesce(o.s, t.status)",
    "failure_reason": "CASE WHEN o.s IS NULL THEN t.failure_reason ELSE o.r END",
    "finished_at": "CASE WHEN o.s IS NULL THEN t.finished_at ELSE o.f END"}, "tasks t LEFT JOIN o ON t.id = o.task_id")


@query("record_outcomes", RECORDED)
def _(i):
    return lifecycle.record_outcomes(i.tasks, i.outcomes)


HIT = "(t.status = 'failed' AND r.context_id IS NOT NULL)"


@query("retry_failed", f"""WITH {PROGRESS}, r AS (SELECT context_id FROM p WHERE done + failed = total AND failed > 0) """ + _tasks_sql({
    "status": f"CASE WHEN {HIT} THEN 'pending' ELSE t.status END",
    "failure_reason": f"CASE WHEN {HIT} THEN '' ELSE t.failure_reason END",
    "started_at": f"CASE WHEN {HIT} THEN NULL ELSE t.started_at END",
    "finished_at": f"CASE WHEN {HIT} THEN NULL ELSE t.finished_at END"}, "tasks t LEFT JOIN r ON t.context_id = r.context_id"))
def _(i):
    return lifecycle.retry_failed(i.tasks)


@query("retry_verdicts", f"""WITH {PROGRESS} SELECT *, CASE WHEN done + failed <> total OR failed = 0 THEN 'TS-05' END AS code FROM p""")
def _(i):
    return lifecycle.retry_verdicts(i.tasks)


@query("fail_contexts", _tasks_sql({
    "status": "CASE WHEN f.reason IS NULL THEN t.status ELSE 'failed' END",
    "failure_reason": "coalesce(f.reason, t.failure_reason)"}, "tasks t LEFT JOIN completion_failures f ON t.context_id = f.context_id"))
def _(i):
    return lifecycle.fail_contexts(i.tasks, i.completion_failures)


@query("reclaim_stale", _tasks_sql({
    "started_at": f"""CASE WHEN t.status = 'running' AND t.started_at < {SQL_NOW} - INTERVAL {views.STALE_MINUTES} MINUTE
 THEN {SQL_NOW} ELSE t.started_at END"""}))
def _(i):
    return lifecycle.reclaim_stale(i.tasks, now(), views.STALE_MINUTES)


@query("invalid_transitions", f"""WITH l AS (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY ts,
 CASE status WHEN 'pending' THEN 1 WHEN 'running' THEN 2 WHEN 'done' THEN 3 ELSE 4 END) AS from_status FROM task_log)
SELECT task_id, context_id, {_ts('ts')} AS ts, from_status, status FROM l
WHERE coalesce(from_status, '-') || '>' || status NOT IN
 ('->pending', 'pending>running', 'running>done', 'running>failed', 'failed>pending', 'done>failed', 'running>running')""")
def _(i):
    return lifecycle.invalid_transitions(i.task_log)


# --- inference and merge -----------------------------------------------------------------------------


def _shouting_handler():
    """A stand-in for a handler: refuses pages that do not end in a full stop, else counts words."""

    def handle(row: dict) -> dict:
        if not row["text"].rstrip().endswith("."):
            raise ValueError("page has no end")
        return {"words": len(row["text"].split()), "chars": len(row["text"])}

    return handle


@query("run_handler", r"""SELECT task_id, CASE WHEN ok THEN 'done' ELSE 'failed' END AS status,
 CASE WHEN ok THEN '' ELSE 'ValueError(''page has no end'')' END AS failure_reason,
 CASE WHEN ok THEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) ELSE -1 END AS words,
 CASE WHEN ok THEN length(text) ELSE -1 END AS chars
FROM (SELECT *, regexp_matches(text, '\.\s*$') AS ok FROM page_outputs)""")
def _(i):
    done = inference.run_handler(i.page_outputs.select("task_id", "text"), "task_id", _shouting_handler, "words LONG, chars LONG")
    return done.withColumns({name: F.coalesce(name, F.lit(-1)) for name in ("words", "chars")})


def _reading_model(settings: inference.ModelSettings):
    """A stand-in for a vision model: the page's text stands in the image after its signature."""

    def read(image: bytes, media_type: str = "image/png") -> dict:
        text = image[8:].decode()
        used = len(text) // 4
        stop = "length" if used >= settings.max_tokens else "stop"
        return {"text": text, "finish_reason": stop, "input_tokens": len(text) // 5, "output_tokens": used}

    return read


TRUNCATED = "'AppError(''TS-03: Transcription truncated (finish_reason=length, output=' || output_tokens || ')'')'"


def _page_images(i: Inputs) -> DataFrame:
    image = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("text", "UTF-8"))
    return i.page_outputs.select(F.col("task_id").alias("id"), image.alias("image"))


@query("transcribe", f"""SELECT task_id AS id, CASE WHEN finish_reason = 'length' THEN 'failed' ELSE 'done' END AS status,
 CASE WHEN finish_reason = 'length' THEN {TRUNCATED} ELSE '' END AS failure_reason, CASE WHEN finish_reason <> 'length' THEN text END AS text,
 'transcriber' AS model, finish_reason, input_tokens, output_tokens FROM page_outputs""")
def _(i):
    settings = inference.ModelSettings(max_tokens=views.MAX_TOKENS)
    return inference.transcribe(_page_images(i), _reading_model, settings, window=4, media_types=True)


def _unsteady_model(settings: inference.ModelSettings):
    """The stand-in, which drops the first request of every page with an even length and never answers some others."""
    reading, asked = _reading_model(settings), set()

    def read(image: bytes, media_type: str) -> dict:
        if len(image) % 97 == 5:
            time.sleep(60)
        if len(image) % 2 == 0 and id(image) not in asked:
            asked.add(id(image))
            raise ConnectionError("dropped")
        asked.discard(id(image))
        return reading(image)

    return read


LIMITED = """(SELECT *, 8 + octet_length(encode(text)) AS bytes, CAST(split_part(task_id, '/', 1) AS BIGINT) % 5 = 0 AS gif FROM page_outputs
 WHERE CAST(split_part(task_id, '/', 2) AS BIGINT) = 1)"""


@query("transcribe_limits", f"""SELECT task_id AS id, CASE WHEN gif OR bytes % 97 = 5 OR finish_reason = 'length' THEN 'failed' ELSE 'done' END AS status,
 CASE WHEN gif THEN 'AppError(''TS-02: Failed image media_type parse for llm'')' WHEN bytes % 97 = 5 THEN 'TimeoutError(''no answer within 0.5 s'')'
  WHEN finish_reason = 'length' THEN {TRUNCATED} ELSE '' END AS failure_reason,
 CASE WHEN gif THEN 1 WHEN bytes % 97 = 5 OR bytes % 2 = 0 THEN 2 ELSE 1 END::bigint AS attempts, bytes % 97 = 5 AND NOT gif AS late FROM {LIMITED}""")
def _(i):
    """The first turn of every conversation, by path: kinds the model does not take, lost requests and requests without an answer."""
    turns = i.page_outputs.filter("split_part(task_id, '/', 2) = '1'")
    gif = F.split_part("task_id", F.lit("/"), F.lit(1)).cast("long") % 5 == 0
    signature = F.when(gif, F.unhex(F.lit("4749463839610000"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    folder = i.fresh("images")  # a folder of small files stands in for an object store
    turns.select(F.col("task_id").alias("id"), F.concat(signature, F.encode("text", "UTF-8")).alias("image")).write.parquet(folder)
    images = i.spark.read.schema("id STRING, image BINARY").parquet(folder)
    settings = inference.ModelSettings(max_tokens=views.MAX_TOKENS, timeout_s=0.5, backoff_s=0.01)
    done = inference.transcribe(images, _unsteady_model, settings, window=16, media_types=True, cost=True)
    return done.select("id", "status", "failure_reason", "attempts", (F.col("duration_s") >= 1).alias("late"))


def _answering_model(settings: inference.ModelSettings):
    return lambda image: {"text": f"p{len(image)}", "finish_reason": "length" if len(image) % 11 == 0 else "stop", "input_tokens": 1, "output_tokens": 7}


WORKED = f"""WITH {_licq_sql(views.CLAIM)},
 f AS (SELECT context_id, created_at AS c1, object_name AS c2, id AS c3 FROM q WHERE round = 1),
 j AS (SELECT q.id, context_id, round, last, c1, c2, c3 FROM q JOIN c USING (context_id) JOIN f USING (context_id)),
 k AS ({_numbered('round, last NULLS FIRST, c1, c2, c3', 'j')}),
 w AS (SELECT t.*, CAST(id AS BIGINT) AS n, id IN (SELECT id FROM k)
   OR (status = 'running' AND started_at < {SQL_NOW} - INTERVAL 5 MINUTE) AS worked FROM tasks t),
 a AS (SELECT id, context_id, created_by, priority, n, CASE WHEN NOT worked THEN status WHEN n % 7 = 0 OR n % 11 = 0 THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN NOT worked THEN failure_reason WHEN n % 7 = 0 THEN 'FileNotFoundError(''no image'')'
   WHEN n % 11 = 0 THEN 'AppError(''TS-03: Transcription truncated (finish_reason=length, output=7)'')' ELSE '' END AS failure_reason FROM w)"""


def _one_round(i: Inputs) -> tuple[VersionedTable, Version, process.Round]:
    table = VersionedTable(i.spark, i.fresh("tasks"), task_table.TASKS)
    table.create(i.tasks.select(*task_table.TASKS.names))
    number = F.col("id").cast("long")
    paths = payload_fields(i.tasks).filter(number % 7 != 0)
    images = paths.select("file_path", F.expr("CAST(repeat('x', CAST(11 + CAST(id AS BIGINT) % 11 AS INT)) AS BINARY)").alias("image"))
    return table, *process.advance(table, images, _answering_model, i.fresh("pages"), 0, now(), views.CLAIM)


@query("process_round", f"{WORKED} SELECT id, context_id, status, failure_reason FROM a")
def _(i):
    """A round of work on a versioned task table; only what it changed is written."""
    table, version, _ = _one_round(i)
    return table.read(version).select("id", "context_id", "status", "failure_reason")


@query("process_changes", f"{WORKED} SELECT a.id, a.status FROM a JOIN w USING (id) WHERE worked")
def _(i):
    table, version, _ = _one_round(i)
    return table.changes(version).select("id", "status")


@query("task_versions", f"""{WORKED}, due AS (SELECT context_id FROM a GROUP BY 1
  HAVING count(*) FILTER (WHERE status IN ('done', 'failed')) = count(*) AND count(*) FILTER (WHERE status = 'failed') > 0)
SELECT id, context_id, CASE WHEN status = 'failed' AND context_id IN (SELECT * FROM due) THEN 'pending' ELSE status END AS status, 3::bigint AS version FROM a""")
def _(i):
    """Submission, a round, its replay, a retry and a compaction, of which the replay changes nothing."""
    table, read, _ = _one_round(i)
    replayed, again = process.advance(table, i.tasks.limit(0), _answering_model, i.fresh("pages"), 0, now(), views.CLAIM)
    if again is not None or replayed != read:
        raise AssertionError("a committed round ran again")
    tasks = table.read(read)
    retried = lifecycle.retry_failed(tasks).join(tasks.filter("status = 'failed'").select("id"), "id", "left_semi").filter("status = 'pending'")
    last = table.compact(table.commit(retried.select(*tasks.columns), read))
    return table.read(last).select("id", "context_id", "status", F.lit(last.number).cast("long").alias("version"))


@query("truncation_check", f"""SELECT task_id, CASE WHEN finish_reason = 'length' THEN 'failed' ELSE 'done' END AS status,
 CASE WHEN finish_reason = 'length' THEN {TRUNCATED} ELSE '' END AS failure_reason FROM page_outputs""")
def _(i):
    answers = i.page_outputs.withColumn("status", F.lit("done")).withColumn("failure_reason", F.lit(""))
    return inference.truncation_check(answers).select("task_id", "status", "failure_reason")


RESIZED = """a AS (SELECT id, context_id, CASE WHEN orientation BETWEEN 5 AND 8 THEN height ELSE width END AS w,
  CASE WHEN orientation BETWEEN 5 AND 8 THEN width ELSE height END AS h FROM image_dims),
 b AS (SELECT *, w::double / h::double AS r FROM a),
 x AS (SELECT *, floor(1536 / r) AS hl, ceil(1536 / r) AS hh, floor(1536 * r) AS wl, ceil(1536 * r) AS wh FROM b),
 y AS (SELECT *, greatest(CASE WHEN (CASE WHEN hl = 0 THEN 0 ELSE abs(r - 1536 / hl) END) <= (CASE WHEN hh = 0 THEN 0 ELSE abs(r - 1536 / hh) END)
   THEN hl ELSE hh END, 1) AS sh, greatest(CASE WHEN abs(r - wl / 1536) <= abs(r - wh / 1536) THEN wl ELSE wh END, 1) AS sw FROM x),
 z AS (SELECT *, CASE WHEN w <= 1536 AND h <= 1536 THEN w WHEN w >= h THEN 1536 ELSE sw END::bigint AS ow,
   CASE WHEN w <= 1536 AND h <= 1536 THEN h WHEN w >= h THEN sh ELSE 1536 END::bigint AS oh FROM y)"""


@query("resize_plan", f"WITH {RESIZED} SELECT id, w AS turned_width, h AS turned_height, ow AS out_width, oh AS out_height FROM z")
def _(i):
    return inference.resize_plan(i.image_dims).select("id", "turned_width", "turned_height", "out_width", "out_height")


@query("resize_savings", f"""WITH {RESIZED} SELECT context_id, count(*) AS pages, count(*) FILTER (WHERE w * h > ow * oh) AS shrunk,
 sum(w * h)::bigint AS pixels, sum(w * h - ow * oh)::bigint AS saved FROM z GROUP BY 1""")
def _(i):
    return inference.resize_savings(i.image_dims)


@query("format_page", f"SELECT context_id, object_name, {STORED} AS text FROM pages_text")
def _(i):
    return merge.format_page(i.pages_text).select("context_id", "object_name", "text")


@query("merge_transcripts", f"WITH {MERGED} SELECT * FROM merged")
def _(i):
    return merge.merge_transcripts(merge.format_page(i.pages_text))


@query("complete_contexts", f"""WITH {PROGRESS}, {MERGED}, due AS (SELECT context_id FROM p WHERE done + failed = total
 AND context_id NOT IN (SELECT context_id FROM completed_before))
SELECT context_id, 0::bigint AS generation, coalesce(part, 0) AS part, coalesce(pages, 0) AS pages, coalesce(text, '') AS text
FROM due LEFT JOIN merged USING (context_id)""")
def _(i):
    return merge.complete_contexts(i.tasks, merge.format_page(i.pages_text), i.completed_before)


# --- search ------------------------------------------------------------------------------------------

DAY = views.NOW[:10]
ASKED = f"""q AS (SELECT prompt_id, 0 AS query_no, prompt AS query FROM prompts
 UNION ALL SELECT prompt_id, 1, 'what is ' || prompt FROM prompts
 UNION ALL SELECT prompt_id, 2, 'background of ' || prompt FROM prompts
 UNION ALL SELECT prompt_id, 3, 'latest on ' || prompt || ' as of {DAY}' FROM prompts)"""


def _plain_sql(html: str) -> str:
    text = rf"regexp_replace({html}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"),
                         ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g'))"


def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


PLAIN = f"plain AS (SELECT url, {_plain_sql('html')} AS text FROM pages)"
HITS = f"""{ASKED}, {PLAIN},
 asked AS (SELECT DISTINCT prompt_id, query_no, unnest({_words_sql('query')}) AS word FROM q),
 post AS (SELECT url, word, count(*) AS tf FROM (SELECT url, unnest({_words_sql('text')}) AS word FROM plain) GROUP BY 1, 2),
 df AS (SELECT word, count(*) AS seen FROM post GROUP BY 1),
 wt AS (SELECT word, ln(1 + ((SELECT count(*) FROM pages) - seen + 0.5::double) / (seen + 0.5::double)) AS weight FROM df),
 sc AS (SELECT prompt_id, query_no, url, round(sum(weight * tf / (tf + 1.2::double)), 6) AS score, count(*) AS matched
  FROM asked JOIN wt USING (word) JOIN post USING (word) GROUP BY 1, 2, 3),
 hits AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, query_no ORDER BY score DESC, url) AS position FROM sc
  QUALIFY position <= 8)"""


def _queries(i: Inputs) -> DataFrame:
    return search.expand_queries(i.prompts, search.template_queries(F.col("prompt"), now()))


def _hits(i: Inputs) -> DataFrame:
    return search.search_topk(_queries(i), i.pages)


@query("expand_queries", f"WITH {ASKED} SELECT prompt_id, query_no::bigint AS query_no, query FROM q")
def _(i):
    return _queries(i)


@query("search_topk", f"WITH {HITS} SELECT prompt_id, query_no::bigint AS query_no, position, url, score, matched FROM hits")
def _(i):
    return _hits(i).select("prompt_id", "query_no", "position", "url", "score", "matched")


@query("search_codes", f"""WITH {HITS}, h AS (SELECT prompt_id, count(*) AS hits FROM hits GROUP BY 1)
SELECT p.prompt_id, coalesce(h.hits, 0) AS hits, CASE WHEN h.hits IS NULL THEN 'WSP-02' END AS code FROM prompts p LEFT JOIN h USING (prompt_id)""")
def _(i):
    return search.search_codes(_queries(i), _hits(i))


def _search_json_sql() -> str:
    return """WITH r AS (SELECT concat(conv_id, '-', turn // 10) AS query, *, concat('https://example.org/', conv_id, '/', turn) AS url FROM conversations),
 bad AS (SELECT query FROM r GROUP BY 1 HAVING arg_max(role, turn) = 'user' OR count(*) FILTER (WHERE role = 'system') > 0)
SELECT query, NULL AS code, url, role AS title, text AS description, role || ' ' || turn AS snippet, turn + 1 AS position,
 round(1 / (turn + 1)::double, 6) AS score, 'general' AS category FROM r WHERE query NOT IN (SELECT query FROM bad)
UNION ALL SELECT query, 'CRWC-04', NULL, NULL, NULL, NULL, -1, -1, NULL FROM bad"""


@query("parse_search_json", _search_json_sql())
def _(i):
    found = search.parse_search_json(i.search_json)
    return found.withColumns({name: F.coalesce(name, F.lit(-1)) for name in ("position", "score")})


def _inner_sql(tag: str) -> str:
    return _plain_sql(rf"replace(regexp_extract(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), '<', ' <')")


REVIEW = f"""{HITS}, fields AS (SELECT url, {_inner_sql('title')} AS title, {_inner_sql('h1')} AS description FROM pages),
 review AS (SELECT prompt_id, string_agg('[URL: ' || url || chr(10) || 'Title: ' || title || chr(10) || 'Description: ' || description || chr(10)
  || 'Snippet: ' || matched || ' matching words]' || chr(10) || chr(10), '' ORDER BY query_no, position) AS content
  FROM hits JOIN fields USING (url) GROUP BY 1)"""


@query("page_plain_text", f"WITH {PLAIN} SELECT url, text FROM plain")
def _(i):
    return search.page_fields(i.pages).select("url", "text")


def _described(i: Inputs) -> DataFrame:
    return search.describe_hits(_hits(i), i.pages)


@query("review_text", f"WITH {REVIEW} SELECT prompt_id, content FROM review")
def _(i):
    return search.review_text(_described(i))


URL_LINE = re.compile(r"^\[URL: (.*)$", re.M)


def _choose(message: str) -> list[str]:
    """A stand-in for the relevancy model: takes English pages, as often as they are listed, and makes one up."""
    listed = URL_LINE.findall(message)
    return [url for url in listed if "/en/" in url] + ["https://made-up.example.org/"]


PICKED = """ordered AS (SELECT prompt_id, url, query_no, position FROM hits WHERE url LIKE '%/en/%'),
 picked AS (SELECT prompt_id, url, row_number() OVER (PARTITION BY prompt_id ORDER BY query_no, position) - 1 AS pos FROM ordered)"""


def _messages(i: Inputs, hits: DataFrame) -> DataFrame:
    return search.relevancy_message(i.prompts, _queries(i), search.review_text(hits))


@query("relevant_urls", f"""WITH {HITS}, {PICKED}, asked_prompts AS (SELECT DISTINCT prompt_id FROM hits)
SELECT prompt_id, pos, url FROM picked UNION ALL
SELECT a.prompt_id, (SELECT count(*) FROM picked k WHERE k.prompt_id = a.prompt_id), 'https://made-up.example.org/' FROM asked_prompts a""")
def _(i):
    return search.relevant_urls(_messages(i, _described(i)), _choose)


def _grounded(i: Inputs) -> DataFrame:
    hits = stage(_described(i), "hits")
    return stage(search.ground_urls(search.relevant_urls(_messages(i, hits), _choose), hits), "picked")


@query("ground_urls", f"WITH {HITS}, {PICKED} SELECT prompt_id, pos, url FROM picked")
def _(i):
    return _grounded(i)


SCRAPED = f"""{HITS}, {PICKED}, scraped AS (SELECT prompt_id, pos, url, CASE WHEN NOT coalesce(reachable, false) THEN 'CRWC-10' WHEN html = '' THEN 'CRWC-11' END AS code,
  {_plain_sql('html')} AS page FROM picked LEFT JOIN corpus USING (url))"""


@query("scrape_pages", f"WITH {SCRAPED} SELECT prompt_id, pos, url, code, CASE WHEN code IS NULL THEN page END AS text FROM scraped")
def _(i):
    return search.scrape_pages(_grounded(i), i.corpus)


@query("scrape_codes", f"""WITH {SCRAPED}, g AS (SELECT prompt_id, count(*) AS urls, count(*) FILTER (WHERE code IS NULL) AS texts FROM scraped GROUP BY 1)
SELECT prompt_id, coalesce(urls, 0) AS urls, coalesce(texts, 0) AS texts, CASE WHEN urls IS NULL THEN 'CRWC-09' WHEN texts = 0 THEN 'WSP-03' END AS code
FROM prompts LEFT JOIN g USING (prompt_id)""")
def _(i):
    return search.scrape_codes(i.prompts, search.scrape_pages(_grounded(i), i.corpus))


CONTEXT = f"""{SCRAPED}, data AS (SELECT prompt_id, string_agg(page, chr(10) ORDER BY pos) AS data FROM scraped WHERE code IS NULL GROUP BY 1),
 context AS (SELECT prompt_id, 'Prompt: ' || prompt || chr(10) || 'Website data:[' || chr(10) || data || chr(10) || ']' AS context
  FROM prompts JOIN data USING (prompt_id))"""


@query("assemble_context", f"WITH {CONTEXT} SELECT * FROM context")
def _(i):
    return search.assemble_context(i.prompts, search.scrape_pages(_grounded(i), i.corpus))


def _counting_model():
    """A stand-in for the summary model."""
    return lambda context: f"{len(context)} characters, {context.count(' ')} spaces"


SUMMARY = """'done' AS status, '' AS failure_reason, length(context) || ' characters, ' ||
 (length(context) - length(replace(context, ' ', ''))) || ' spaces' AS answer"""


@query("summarise", f"WITH {CONTEXT} SELECT prompt_id, {SUMMARY} FROM context")
def _(i):
    scraped = search.scrape_pages(_grounded(i), i.corpus)
    return search.summarise(search.assemble_context(i.prompts, scraped), _counting_model)


@query("enhance_prompts", f"""WITH {HITS}, {PICKED},
 data AS (SELECT prompt_id, string_agg(text, chr(10) ORDER BY pos) AS data FROM picked JOIN plain USING (url) GROUP BY 1),
 context AS (SELECT prompt_id, 'Prompt: ' || prompt || chr(10) || 'Website data:[' || chr(10) || data || chr(10) || ']' AS context
  FROM prompts JOIN data USING (prompt_id))
SELECT prompt_id, {SUMMARY} FROM context""")
def _(i):
    pages = i.pages.withColumn("reachable", F.lit(True))
    generated = search.template_queries(F.col("prompt"), now())
    return enhance_prompts(i.prompts, pages, generated, _choose, _counting_model)


# --- quality -----------------------------------------------------------------------------------------

PAIRS = "pair AS (SELECT key, g.text AS gold, o.text AS output FROM eval_gold g FULL JOIN eval_output o USING (key))"


def _pairs(i: Inputs) -> DataFrame:
    return quality.pair_eval(i.eval_gold, i.eval_output)


@query("pair_eval", f"""WITH {PAIRS} SELECT key, gold, output, CASE WHEN output IS NULL THEN 'gold only' WHEN gold IS NULL THEN 'output only'
 ELSE 'paired' END AS pairing FROM pair""")
def _(i):
    return _pairs(i)


def _normal_sql(text: str) -> str:
    return (rf"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), "
            "lambda x: x <> ''), chr(10))")


@query("normalise_text", f"SELECT key, {_normal_sql('text')} AS text FROM eval_output")
def _(i):
    return i.eval_output.select("key", normalise_text(F.col("text")).alias("text"))


# DuckDB measures bytes: accented letters are first renamed one to one to single bytes that no text has
ONE_BYTE = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '0123456789!#$%&*+-/:;')"
SCORED = f"""{PAIRS}, n AS (SELECT key, {_normal_sql('gold')} AS gold, {_normal_sql('output')} AS output FROM pair
  WHERE gold IS NOT NULL AND output IS NOT NULL),
 d AS (SELECT key, length(gold) AS gold_chars, levenshtein({ONE_BYTE.format('gold')}, {ONE_BYTE.format('output')}) AS distance FROM n)"""


@query("cer", f"""WITH {SCORED} SELECT key, gold_chars, distance, round(distance / gold_chars, 6) AS cer,
 round((1 - distance / gold_chars) * 100, 6) AS accuracy FROM d""")
def _(i):
    return quality.cer(_pairs(i).filter("pairing = 'paired'")).select("key", "gold_chars", "distance", "cer", "accuracy")


# what the stand-in transcriber adds and drops: a comma per ', ', a full stop per '. An'
PUNCTUATION = rf"""marks AS (SELECT key, length(gold) - length(regexp_replace(gold, '[!-/:-@\[-`{{-~—]', '', 'g')) AS marks,
  (length(gold) - length(replace(gold, ', ', ''))) // 2 AS added, (length(gold) - length(replace(gold, '. An', ''))) // 4 AS missing
  FROM pair WHERE gold IS NOT NULL AND output IS NOT NULL),
 s AS (SELECT key, marks - missing AS kept, missing, added, (marks - missing) / nullif(marks, 0) * 100 AS recall,
  (marks - missing) / nullif(marks - missing + added, 0) * 100 AS precision FROM marks)"""
GATE = """(1 - distance / gold_chars) * 100 AS accuracy, recall, precision,
 coalesce((1 - distance / gold_chars) * 100 >= 99, false) AS accuracy_ok, coalesce(recall > 95, false) AS recall_ok,
 coalesce(precision > 95, false) AS precision_ok, accuracy_ok AND recall_ok AND precision_ok AS passed"""


@query("punctuation_scores", f"WITH {PAIRS}, {PUNCTUATION} SELECT * FROM s")
def _(i):
    pairs = _pairs(i).filter("pairing = 'paired'")
    return quality.punctuation_scores(pairs).select("key", "kept", "missing", "added", "recall", "precision")


@query("quality_gate", f"WITH {SCORED}, {PUNCTUATION} SELECT key, {GATE} FROM d JOIN s USING (key)")
def _(i):
    scored = quality.punctuation_scores(quality.cer(_pairs(i).filter("pairing = 'paired'")))
    return quality.quality_gate(scored).select(
        "key", "accuracy", "recall", "precision", "accuracy_ok", "recall_ok", "precision_ok", "passed"
    )


@query("evaluate", f"""WITH {SCORED}, {PUNCTUATION} SELECT key, gold_chars, distance, distance / gold_chars AS cer, kept, missing, added, {GATE}
FROM d JOIN s USING (key)""")
def _(i):
    return evaluate(i.eval_gold, i.eval_output)


# --- streaming ---------------------------------------------------------------------------------------

DELAY = "1 hour"
PAST = "(SELECT max(ts) - INTERVAL 1 HOUR FROM task_changes)"


def _changes(i: Inputs) -> DataFrame:
    return i.stream("task_changes")


def _appended(i: Inputs, stream: DataFrame) -> DataFrame:
    path = i.fresh("stream")
    schema = stream.schema
    queue.run_available(stream, i.fresh("checkpoint"), path=path)
    return i.spark.read.schema(schema).parquet(path)


@query("stream_progress", f"WITH {PROGRESS} SELECT * FROM p")
def _(i):
    path = i.fresh("stream")
    counts = queue.stream_progress(_changes(i))
    queue.run_available(counts, i.fresh("checkpoint"), "update", each=queue.keep_batch(path))
    return queue.latest_rows(i.spark, path, "context_id STRING, total BIGINT, done BIGINT, failed BIGINT", ["context_id"])


@query("stream_completion", f"""WITH {PROGRESS} SELECT context_id, 0::bigint AS generation, total, done, failed FROM p
WHERE done + failed = total""")
def _(i):
    return _appended(i, processors.stream_completion(_changes(i), "60 days"))


@query("stream_completion_retries", f"""WITH {PROGRESS}, c AS (SELECT * FROM p WHERE done + failed = total)
SELECT context_id, 0::bigint AS generation, total, done, failed FROM c
UNION ALL SELECT context_id, 1, failed, failed, 0 FROM c WHERE failed > 0""")
def _(i):
    """Submissions, then outcomes, then repeats of them with a retry of all that failed: a batch each."""
    changes, ended = i.task_changes, F.col("status").isin("done", "failed")
    again = changes.filter("status = 'failed'").join(results.finished_contexts(results.context_progress(i.tasks)), "context_id", "left_semi")
    retried = again.withColumn("generation", F.lit(1).cast("long")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    done = retried.withColumns({"from_status": F.lit("running"), "status": F.lit("done"), "ts": F.col("ts") + F.expr("INTERVAL 1 HOUR")})
    retried = retried.withColumns({"from_status": F.lit("failed"), "status": F.lit("pending")})
    batches = [changes.filter("status = 'pending'"), changes.filter(ended), changes.filter(ended).unionByName(retried).unionByName(done)]
    log, checkpoint, path = i.fresh("log"), i.fresh("checkpoint"), i.fresh("stream")
    for batch in batches:  # each run starts from the checkpoint of the one before
        batch.write.mode("append").parquet(log)
        arriving = i.spark.readStream.schema(changes.schema).parquet(log)
        queue.run_available(processors.stream_completion(arriving, "90 days"), checkpoint, path=path)
    return i.spark.read.schema(processors.COMPLETIONS).parquet(path)


@query("stream_stale", f"""WITH s AS (SELECT task_id, context_id, ts FROM task_changes WHERE status = 'running'),
 e AS (SELECT task_id, ts FROM task_changes WHERE status IN ('done', 'failed')),
 w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM e)) - INTERVAL 1 HOUR AS mark)
SELECT task_id, context_id, {_ts('ts')} AS started_at FROM s
WHERE ts + INTERVAL 5 MINUTE < (SELECT mark FROM w) AND NOT EXISTS (SELECT 1 FROM e WHERE e.task_id = s.task_id
 AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 5 MINUTE)""")
def _(i):
    return _appended(i, processors.stream_stale(_changes(i), 5, DELAY))


@query("stream_dedup", f"""SELECT DISTINCT task_id, status, failure_reason, {_ts('finished_at')} AS finished_at, attempt::bigint AS attempt
FROM outcomes""")
def _(i):
    return _appended(i, queue.stream_dedup(i.stream("outcomes"), DELAY))


@query("stream_metrics", f"""WITH w AS (SELECT time_bucket(INTERVAL 15 SECOND, ts) AS w, status, count(*) AS changes FROM task_changes GROUP BY 1, 2)
SELECT {_ts('w')} AS window_start, status, changes FROM w WHERE w + INTERVAL 15 SECOND <= {PAST}""")
def _(i):
    return _appended(i, queue.stream_metrics(_changes(i), DELAY))


CURRENT = "coalesce(t.status = 'running' AND o.f >= t.started_at, false)"


@query("stream_upsert", f"WITH {LAST_OUTCOME} " + _tasks_sql({
    "status": f"CASE WHEN {CURRENT} THEN o.s ELSE t.status END",
    "failure_reason": f"CASE WHEN {CURRENT} THEN o.r ELSE t.failure_reason END",
    "finished_at": f"CASE WHEN {CURRENT} THEN o.f ELSE t.finished_at END"}, "tasks t LEFT JOIN o ON t.id = o.task_id"))
def _(i):
    path = i.fresh("outcomes")
    queue.run_available(i.stream("outcomes"), i.fresh("checkpoint"), each=queue.append_outcomes(path))
    return queue.current_tasks(i.tasks, i.spark.read.schema(OUTCOMES).parquet(path).drop("batch"))


@query("stream_ingest", f"""WITH {PACKED_SQL}, o AS (SELECT archive AS context_id, 'u0' AS created_by,
  printf('%04d', idx) || '_' || turn || '_' || role || '.img' AS object_name, turn || '_' || role || '.img' AS original_file_name
  FROM a WHERE archive NOT IN (SELECT archive FROM broken))
SELECT {ENQUEUED} FROM o""")
def _(i):
    landed, path = i.fresh("landed"), i.fresh("stream")
    packed_archives(i).write.parquet(landed)
    incoming = i.spark.readStream.schema(ARCHIVES).parquet(landed)

    def pending(batch: DataFrame) -> DataFrame:
        uploads = batch.select("archive", F.col("archive").alias("context_id"), F.lit("u0").alias("created_by"))
        return submit(batch, uploads, now())[0]

    queue.run_available(incoming, i.fresh("checkpoint"), each=queue.ingest_batch(pending, path))
    return i.spark.read.schema(task_table.TASKS).parquet(path).drop("batch")
