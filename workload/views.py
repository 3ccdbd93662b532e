"""Inputs of the registered queries, derived from the given tables.

Every view is one SELECT over base tables or other views, so the same text (with the few functions that
are spelled differently filled in) serves Spark and DuckDB. All rows and whole texts are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

NOW = "2024-01-31 00:00:00"
STALE_MINUTES = 14400
CLAIM = 500
MAX_IMAGES = 6  # count limit for the archives made of orders, which have 13 lines at most
MAX_TOKENS = 400


@dataclass(frozen=True)
class Dialect:
    """Spellings that differ."""

    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def plus_ms(self, ts: str, ms: str) -> str:
        return f"timestampadd(MILLISECOND, {ms}, {ts})" if self.spark else f"({ts} + to_milliseconds({ms}))"

    def pad4(self, n: str) -> str:
        return f"format_string('%04d', {n})" if self.spark else f"printf('%04d', {n})"

    def text_of_time(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss,SSS')" if self.spark else f"strftime({ts}, '%Y-%m-%d %H:%M:%S,%g')"

    def utf8(self, text: str) -> str:
        return f"encode({text}, 'UTF-8')" if self.spark else f"encode({text})"

    def json(self, fields: dict[str, str]) -> str:
        if self.spark:
            return "to_json(struct(" + ", ".join(f"{v} AS {k}" for k, v in fields.items()) + "))"
        return "to_json({" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "})::varchar"

    def newline(self) -> str:
        return "chr(10)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def _tasks(d: Dialect) -> str:
    return f"""
SELECT cast(event_id AS string) AS id, cast(user_id AS string) AS context_id, status,
 concat('u', cast(user_id % 10 AS string)) AS created_by,
 {d.json({
     "object_name": "object_name",
     "file_path": "concat(cast(user_id AS string), '/', object_name)",
     "original_file_name": "'page.jpg'"})} AS payload,
 CASE WHEN status = 'failed' THEN concat('AppError(''TS-0', cast(1 + event_id % 3 AS string), ': simulated'')')
      WHEN status = 'done' THEN '' END AS failure_reason,
 ts AS created_at,
 CASE WHEN status <> 'pending' THEN {d.plus_ms('ts', 'ms')} END AS started_at,
 CASE WHEN status IN ('done', 'failed') THEN {d.plus_ms('ts', 'ms + 1000 * (event_id % 50 + 1)')} END AS finished_at,
 CASE event_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'premium' ELSE 'enterprise' END AS priority
FROM (
 SELECT event_id, user_id, cast(ts AS timestamp) AS ts, cast(round(value * 1000) AS bigint) AS ms,
  concat({d.pad4('event_id')}, '_page.jpg') AS object_name,
  CASE WHEN user_id % 7 = 0 THEN 'pending'
       WHEN user_id % 5 = 1 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END
       WHEN event_type IN ('view', 'click') THEN 'pending'
       WHEN event_type = 'signup' THEN 'running'
       WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS status
 FROM events)"""


def _raw_tasks(d: Dialect) -> str:
    """Tasks as they arrive: cheap events have an unknown status, the next ones a payload without a path."""
    return f"""
SELECT t.id, t.context_id, CASE WHEN e.value < 5 THEN 'cancelled' ELSE t.status END AS status, t.created_by,
 CASE WHEN e.value >= 5 AND e.value < 10 THEN {d.json({"object_name": "'page.jpg'"})}
      WHEN e.value >= 10 AND e.value < 12 THEN left(t.payload, length(t.payload) - 1) ELSE t.payload END AS payload,
 t.failure_reason, t.created_at, t.started_at, t.finished_at, t.priority
FROM tasks t JOIN events e ON t.id = cast(e.event_id AS string)"""


def _outcomes(d: Dialect) -> str:
    """One outcome per running task; failures are reported twice."""
    one = """SELECT id AS task_id, CASE WHEN cast(id AS bigint) % 4 <> 0 THEN 'done' ELSE 'failed' END AS status,
 CASE WHEN cast(id AS bigint) % 4 <> 0 THEN '' ELSE 'AppError(''TS-02: simulated'')' END AS failure_reason,
 {finish} AS finished_at, 1 AS attempt FROM tasks WHERE status = 'running'""".format(
        finish=d.plus_ms("started_at", "7000")
    )
    return f"{one} UNION ALL SELECT * FROM ({one}) AS again WHERE status = 'failed'"


FINISHED = """SELECT context_id FROM tasks GROUP BY context_id
 HAVING count(*) = sum(CASE WHEN status IN ('done', 'failed') THEN 1 ELSE 0 END)"""


def _completion_failures(d: Dialect) -> str:
    """Merging failed for the finished contexts of which more than a fifth of the pages had failed."""
    return f"""SELECT context_id, 'OSError(''merge failed'')' AS reason FROM ({FINISHED}
 AND 5 * sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) > count(*))"""


def _completed_before(d: Dialect) -> str:
    """Finished contexts whose last page was done before the last day."""
    return f"""SELECT context_id, cast(0 AS bigint) AS generation FROM ({FINISHED}
 AND max(finished_at) < TIMESTAMP '2024-01-30 00:00:00')"""


def _requests(d: Dialect) -> str:
    return """SELECT c_custkey AS request_id, concat('u', cast(c_custkey % 10 AS string)) AS user_id,
 cast(c_custkey % 400 AS string) AS context_id FROM customer"""


def _task_changes(d: Dialect) -> str:
    """A row per status change of each task; where a value is above 200 the start was not logged."""
    zero = "cast(0 AS bigint) AS generation"
    if d.spark:
        return f"""SELECT task_id, context_id, c.from_status, c.status, {zero}, c.ts FROM (
 SELECT id AS task_id, context_id, explode(array(
  struct(cast(NULL AS string) AS from_status, 'pending' AS status, created_at AS ts),
  struct('pending' AS from_status, 'running' AS status, started_at AS ts),
  struct('running' AS from_status, status AS status, finished_at AS ts))) AS c FROM tasks) WHERE c.ts IS NOT NULL"""
    return f"""SELECT id AS task_id, context_id, NULL::varchar AS from_status, 'pending' AS status, {zero},
 created_at AS ts FROM tasks
UNION ALL SELECT id, context_id, 'pending', 'running', 0, started_at FROM tasks WHERE started_at IS NOT NULL
UNION ALL SELECT id, context_id, 'running', status, 0, finished_at FROM tasks WHERE finished_at IS NOT NULL"""


def _task_log(d: Dialect) -> str:
    """Status changes as a log that has gaps: starts of tasks that took over 200 seconds to start are missing."""
    return """SELECT c.task_id, c.context_id, c.status, c.ts FROM task_changes c
 JOIN events e ON c.task_id = cast(e.event_id AS string) WHERE NOT (c.status = 'running' AND e.value > 200)"""


def _page_outputs(d: Dialect) -> str:
    """Model calls: every turn of a conversation is a page."""
    return f"""SELECT concat(cast(conv_id AS string), '/', cast(turn AS string)) AS task_id,
 cast(conv_id AS string) AS context_id, concat({d.pad4('turn')}, '_', role) AS object_name,
 concat('model-', role) AS model, cast(floor(length(text) / 5) AS bigint) AS input_tokens,
 cast(floor(length(text) / 4) AS bigint) AS output_tokens, length(text) / 100.0e0 AS duration_s,
 CASE WHEN floor(length(text) / 4) >= {MAX_TOKENS} THEN 'length' ELSE 'stop' END AS finish_reason, text
FROM conversations"""


def _pages_text(d: Dialect) -> str:
    return f"""SELECT cast(conv_id AS string) AS context_id, concat({d.pad4('turn')}, '_', role) AS object_name,
 concat(role, '.jpg') AS original_file_name, text FROM conversations"""


def _image_dims(d: Dialect) -> str:
    return """SELECT p_partkey AS id, p_brand AS context_id, cast(100 + p_size * 80 AS bigint) AS width,
 cast(100 + p_partkey % 4000 AS bigint) AS height, cast(1 + p_partkey % 8 AS bigint) AS orientation FROM part"""


def _entries(d: Dialect) -> str:
    """Orders as archives, their lines as entries; names, sizes and first bytes follow from the line."""
    return """SELECT cast(l_orderkey AS string) AS archive, idx,
 CASE WHEN l_quantity < 2 THEN 'scans/'
      WHEN l_quantity < 4 THEN '__MACOSX/scans/page.jpg'
      WHEN l_quantity < 6 THEN 'scans/.DS_Store'
      WHEN l_quantity < 8 THEN concat('scans/._', cast(l_partkey AS string), '.jpg')
      ELSE concat('scans/', l_linestatus, '/', cast(l_partkey AS string), '.jpg') END AS filename,
 l_quantity < 2 AS is_dir, cast(round(l_extendedprice * 420) AS bigint) AS size,
 CASE WHEN l_quantity < 2 THEN unhex('')
      WHEN l_discount < 0.005 THEN unhex('6E6F7420616E20696D616765')
      WHEN l_discount < 0.015 THEN unhex('47494638396101000100')
      WHEN l_returnflag = 'R' THEN unhex('89504E470D0A1A0A0000000D')
      ELSE unhex('FFD8FFE000104A464946') END AS head_bytes,
 cast(NULL AS string) AS code
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx FROM lineitem)"""


def _archive_names(d: Dialect) -> str:
    return "SELECT cast(o_orderkey AS string) AS archive FROM orders"


def _objects(d: Dialect) -> str:
    """Stored objects: one per part, in a context per brand and size; parts without lines have no tasks."""
    return """SELECT concat(cast(o_custkey AS string), '/', cast(o_orderkey AS string), '.jpg') AS key,
 cast(round(o_totalprice) AS bigint) AS length FROM orders"""


def _prompts(d: Dialect) -> str:
    return "SELECT item_id AS prompt_id, text AS prompt FROM benchmark"


def _corpus(d: Dialect) -> str:
    """Pages; those served without TLS cannot be reached, ad pages have come back empty."""
    return """SELECT page_id, url, CASE WHEN url LIKE '%?page=%' THEN '' ELSE html END AS html,
 url LIKE 'https://%' AS reachable FROM pages"""


def _gpu_samples(d: Dialect) -> str:
    return """SELECT cast(ts AS timestamp) AS ts, concat(cast(event_id % 101 AS string), ', ',
 cast(4096 + user_id * 13 % 20000 AS string), ', 24576, ', cast(cast(round(value * 100) AS bigint) % 35000 / 100.0e0 AS string),
 ', 350, ', cast(35 + event_id % 50 AS string)) AS line FROM events"""


def _log_lines(d: Dialect) -> str:
    return f"""SELECT concat({d.text_of_time('created_at')},
 CASE status WHEN 'failed' THEN ' WARNING' ELSE ' INFO' END, ' [', CASE WHEN status = 'pending' THEN 'api' ELSE 'queue' END,
 '] trace=', id, ' span=0 ', CASE WHEN status = 'pending' THEN 'queued' ELSE
 concat('[task=', id, ' ctx=', context_id, '] task ', status, CASE WHEN status = 'failed' THEN concat(' ', failure_reason) ELSE '' END) END) AS value
FROM tasks"""


def _eval_gold(d: Dialect) -> str:
    return """SELECT concat(cast(conv_id AS string), '/', cast(turn AS string)) AS key,
 concat(role, '.jpg') AS image, text FROM conversations"""


def _eval_output(d: Dialect) -> str:
    """What a transcriber made of the page: some commas doubled, spaces inserted, letters changed, blank lines added.

    Pages cut at the token limit have no output.
    """
    noisy = "text"
    for old, new in (("', '", "',, '"), ("'tion t'", "'ti on t'"), ("'The '", "'the '"), ("'. An'", "' An'"), ("'. '", "'.  '")):
        noisy = f"replace({noisy}, {old}, {new})"
    noisy = f"replace({noisy}, chr(10), concat(' ', chr(10), chr(10)))"
    return f"SELECT task_id AS key, concat(model, '.jpg') AS image, {noisy} AS text FROM page_outputs WHERE finish_reason <> 'length'"


def _search_json(d: Dialect) -> str:
    """Search answers: the turns of a conversation as hits, ten to an answer.

    Hits of system turns lack a score; an answer that ends with a question from the user was cut on its way.
    """
    hit = d.json({
        "url": "concat('https://example.org/', cast(conv_id AS string), '/', cast(turn AS string))",
        "title": "role", "description": "text", "snippet": "concat(role, ' ', cast(turn AS string))",
        "position": "turn + 1", "score": "1.0e0 / (turn + 1)", "category": "'general'", "extra": "turn"})
    bare = d.json({"url": "'https://example.org/'", "title": "role", "description": "text"})
    if d.spark:
        listed = "array_join(array_sort(collect_list(struct(turn, hit))).hit, ',')"
        last = "max_by(role, turn)"
    else:
        listed = "string_agg(hit, ',' ORDER BY turn)"
        last = "arg_max(role, turn)"
    cut = f"CASE WHEN {last} = 'user' THEN '' ELSE ']' END"
    return f"""SELECT concat(cast(conv_id AS string), '-', cast(cast(floor(turn / 10) AS bigint) AS string)) AS query,
 concat(chr(123), '"success":true,"data":', chr(123), '"results":[', {listed}, {cut}, chr(125), chr(125)) AS body
FROM (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN {bare} ELSE {hit} END AS hit FROM conversations)
GROUP BY conv_id, floor(turn / 10)"""


VIEWS = {
    "tasks": _tasks,
    "raw_tasks": _raw_tasks,
    "outcomes": _outcomes,
    "completion_failures": _completion_failures,
    "completed_before": _completed_before,
    "requests": _requests,
    "task_changes": _task_changes,
    "task_log": _task_log,
    "page_outputs": _page_outputs,
    "pages_text": _pages_text,
    "image_dims": _image_dims,
    "entries": _entries,
    "archive_names": _archive_names,
    "objects": _objects,
    "prompts": _prompts,
    "corpus": _corpus,
    "gpu_samples": _gpu_samples,
    "log_lines": _log_lines,
    "eval_gold": _eval_gold,
    "eval_output": _eval_output,
    "search_json": _search_json,
}


def _needed(text: str, seen: list[str], d: Dialect) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", text):
            body = VIEWS[name](d)
            _needed(body, seen, d)
            if name not in seen:
                seen.append(name)


def with_views(text: str) -> str:
    """A DuckDB statement with the views it reads put in front."""
    seen: list[str] = []
    _needed(text, seen, DUCK)
    parts = [f"{name} AS ({VIEWS[name](DUCK)})" for name in seen]
    if text.lstrip().upper().startswith("WITH "):
        text = text.lstrip()[5:]
        return "WITH " + ",\n".join([*parts, text]) if parts else f"WITH {text}"
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, base=table) -> DataFrame:
    """A view, or a base table, as a DataFrame; ``base`` opens the tables."""
    if name in TABLES:
        return base(spark, sf_dir, name)
    text = VIEWS[name](SPARK)
    inputs = {}
    for part in [*VIEWS, *TABLES]:
        if part != name and re.search(rf"\b(FROM|JOIN) {part}\b", text):
            inputs[part] = view(spark, sf_dir, part, base)
            text = re.sub(rf"\b(FROM|JOIN) {part}\b", rf"\1 {{{part}}}", text)
    return spark.sql(text, **inputs)
