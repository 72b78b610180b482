"""Inputs of the registered queries, derived from the driver's tables.

Each input exists twice: as a DataFrame and as the SQL text of a common table expression.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.session import checkpoint_dir, spread

NOW = "2024-02-01 12:30:45"
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def now() -> Column:
    return ntz(NOW)


def show_ts(ts: Column | str) -> Column:
    """A time as text, the same in both engines."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_ts(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder the cluster names; local sessions without one use a temporary folder."""
    local = spark.sparkContext.master.startswith("local")
    base = checkpoint_dir(spark, tempfile.gettempdir() if local else None)
    return f"{base.rstrip('/')}/corpusmap-{uuid.uuid4().hex}"


# --- files ------------------------------------------------------------------------------------------------

_DOC_PATH = (
    "concat('d', cast(doc_id % 7 as string), '/m', cast(doc_id % 3 as string), '/f', cast(doc_id as string), "
    "CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.ts' WHEN 4 THEN '.log' "
    "ELSE '' END)"
)

FILES_DOCS_SQL = f"""files_docs AS (
  SELECT source AS repo, {_DOC_PATH.replace('as string', 'as varchar')} AS path, text, doc_id,
         CAST(strlen(text) AS BIGINT) AS size_bytes,
         TIMESTAMP '{EPOCH}' + to_seconds(doc_id) AS mtime
  FROM documents)"""


def files_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("source").alias("repo"), F.expr(_DOC_PATH).alias("path"), "text", "doc_id",
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        (ntz(EPOCH) + F.expr("make_dt_interval(0, 0, 0, doc_id)")).alias("mtime"),
    )


_CODE_PATH = (
    "concat('src/p', cast(o_orderkey % 50 as string), '/o', cast(o_orderkey as string), "
    "CASE o_orderkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END)"
)
_CODE_TEXT = r"""CASE o_orderkey % 3
  WHEN 0 THEN concat('import x from "y"', chr(10), 'export const c', cast(o_custkey as string), ' = 1', chr(10),
    'export function f', cast(o_orderkey % 97 as string), '() {', chr(10), '  return 1', chr(10), '}', chr(10),
    'class K', cast(o_custkey % 13 as string), ' {', chr(10), '}', chr(10))
  WHEN 1 THEN concat('import os', chr(10), 'def f', cast(o_orderkey % 97 as string), '():', chr(10), '    pass',
    chr(10), chr(10), 'class K', cast(o_custkey % 13 as string), ':', chr(10), '    pass', chr(10))
  ELSE concat('package main', chr(10), 'func F', cast(o_orderkey % 97 as string), '() {', chr(10), '}', chr(10),
    'type T', cast(o_custkey % 13 as string), ' struct {', chr(10), '}', chr(10)) END"""


def _orders_sql(name: str, path: str, text: str) -> str:
    fix = lambda s: s.replace("as string", "as varchar")
    return f"""{name}_base AS (
  SELECT concat('r', CAST(o_custkey % 10 AS varchar)) AS repo, o_orderkey, {fix(path)} AS path, {fix(text)} AS text
  FROM orders), {name} AS (
  SELECT *, CAST(strlen(text) AS BIGINT) AS size_bytes, TIMESTAMP '{EPOCH}' + to_seconds(o_orderkey) AS mtime
  FROM {name}_base)"""


def _orders_files(spark: SparkSession, sf_dir: str, path: str, text: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.expr("concat('r', cast(o_custkey % 10 as string))").alias("repo"), "o_orderkey",
        F.expr(path).alias("path"), F.expr(text).alias("text"),
    ).select(
        "*", F.octet_length("text").cast("bigint").alias("size_bytes"),
        (ntz(EPOCH) + F.expr("make_dt_interval(0, 0, 0, o_orderkey)")).alias("mtime"),
    )


FILES_CODE_SQL = _orders_sql("files_code", _CODE_PATH, _CODE_TEXT)


def files_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_files(spark, sf_dir, _CODE_PATH, _CODE_TEXT)


# Code that only a lexer reads right: for each kind the extension, what stands before a first declaration, that
# declaration, what stands between, a second declaration, and the end. n lines inside are none of the file's own.
_N = "cast(o_orderkey % 6 as int)"
_X, _Y = "cast(o_orderkey % 97 as string)", "cast(o_custkey % 13 as string)"
HARD_CODE = (
    ("java", "concat('package x;', chr(10))",
     f"concat('public class B', {_X}, chr(10), chr(123), chr(10), repeat(concat('  int a;', chr(10)), {_N}), '}}')",
     "concat(chr(10), '/* class Ghost {', chr(10), '*/', chr(10))",
     f"concat('interface S', {_Y}, chr(10), chr(123), chr(10), '}}')", "chr(10)"),
    ("ts", "''",
     f"concat('export function f', {_X}, '() {{', chr(10), '  return `', chr(10), "
     f"repeat(concat('function inside() {{', chr(10)), {_N}), '`', chr(10), '}}')",
     "chr(10)", f"concat('const c', {_Y}, ' = /[{{\"]/')", "concat(' // }', chr(10))"),
    ("py", "concat('\"\"\"about', chr(10), 'def no(): pass', chr(10), '\"\"\"', chr(10))",
     f"concat('def f', {_X}, '():', chr(10), '    \"\"\"', chr(10), repeat(concat('class Inside:', chr(10)), {_N}), "
     "'    \"\"\"', chr(10), '    return 1')",
     "concat(chr(10), chr(10), '# class Ghost:', chr(10))",
     f"concat('class K', {_Y}, ':', chr(10), '    pass')", "chr(10)"),
    ("go", "concat('package main', chr(10))",
     f"concat('func F', {_X}, '() {{', chr(10), '  s := `', chr(10), repeat(concat('func G() {{', chr(10)), {_N}), '`', "
     "chr(10), '  r := ', chr(39), '{', chr(39), chr(10), '}')",
     "chr(10)", f"concat('type T', {_Y}, ' struct {{', chr(10), '}}')", "chr(10)"),
)
_HARD_PATH = "concat('hard/o', cast(o_orderkey as string), CASE o_orderkey % 4 " + " ".join(
    f"WHEN {i} THEN '.{kind[0]}'" for i, kind in enumerate(HARD_CODE)) + " END)"
_HARD_TEXT = "CASE o_orderkey % 4 " + " ".join(
    f"WHEN {i} THEN concat({', '.join(kind[1:])})" for i, kind in enumerate(HARD_CODE)) + " END"
FILES_HARD_SQL = _orders_sql("files_hard", _HARD_PATH, _HARD_TEXT)


def files_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_files(spark, sf_dir, _HARD_PATH, _HARD_TEXT)


_WEB_PATH = "concat('web/o', cast(o_orderkey as string), '.ts')"
_WEB_TEXT = r"""concat(
  CASE WHEN o_orderkey % 4 = 0 THEN concat(
    'router.get("/c/', cast(o_custkey as string), '", list)', chr(10),
    'app.post("/o", create)', chr(10), 'router.get("/c/', cast(o_custkey as string), '", again)', chr(10),
    'server.Delete("/o/', cast(o_orderkey % 9 as string), '", drop)', chr(10),
    CASE WHEN o_orderkey % 8 = 0 THEN concat('app.put("/a", a)', chr(10), 'app.put("/b", b)', chr(10)) ELSE '' END,
    CASE WHEN o_orderkey % 16 = 0 THEN concat('app.get("/a", a)', chr(10), 'app.get("/b", b)', chr(10),
      'app.get("/d", d)', chr(10), 'app.patch("/a", a)', chr(10), 'app.post("/b", b)', chr(10)) ELSE '' END)
   ELSE '' END,
  CASE WHEN o_orderkey % 4 = 1 THEN concat('const S = z.object({})', chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 4 <= 2 THEN concat('export const a', cast(o_custkey as string), ' = 1', chr(10),
    'export async function b() {}', chr(10), 'export class C {}', chr(10), 'export type D = 1', chr(10),
    'export enum E {}', chr(10), 'export let g = 2', chr(10),
    CASE WHEN o_orderkey % 3 = 0 THEN concat('export default b', chr(10)) ELSE '' END) ELSE '' END,
  'class Z', cast(o_orderkey % 5 as string), ' {}', chr(10))"""
FILES_WEB_SQL = _orders_sql("files_web", _WEB_PATH, _WEB_TEXT)


def files_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_files(spark, sf_dir, _WEB_PATH, _WEB_TEXT)


_RUST_PATH = "concat('crate/o', cast(o_orderkey as string), '.rs')"
_RUST_TEXT = r"""concat('// file', chr(10),
  CASE WHEN o_orderkey % 2 = 0 THEN concat('pub fn f', cast(o_orderkey as string), '() {}', chr(10),
    'pub(crate) struct S {}', chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('mod m', cast(o_custkey as string), ';', chr(10), 'pub mod n;', chr(10))
    ELSE '' END, 'let x = 1;', chr(10))"""
FILES_RUST_SQL = _orders_sql("files_rust", _RUST_PATH, _RUST_TEXT)


def files_rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_files(spark, sf_dir, _RUST_PATH, _RUST_TEXT)


_JSON_PATH = "concat('pkg/o', cast(o_orderkey as string), '/package.json')"
_JSON_TEXT = r"""CASE o_orderkey % 5
  WHEN 0 THEN concat('{"name": "p', cast(o_custkey as string), '", "description": "package ', o_orderpriority, '"}')
  WHEN 1 THEN concat('{"name": "p', cast(o_custkey as string), '"}')
  WHEN 2 THEN concat('{"name": "p', cast(o_custkey as string), '", "description": ', cast(o_orderkey as string), '}')
  WHEN 3 THEN concat('{"name": ["p"]}') ELSE concat('{"name": "broken', chr(10)) END"""
FILES_JSON_SQL = _orders_sql("files_json", _JSON_PATH, _JSON_TEXT)


def files_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_files(spark, sf_dir, _JSON_PATH, _JSON_TEXT)


# --- listings ---------------------------------------------------------------------------------------------

LISTING_SQL = f"""{FILES_DOCS_SQL}, manifest AS (
  SELECT repo, path, size_bytes, mtime FROM files_docs WHERE doc_id % 7 <> 0), listing AS (
  SELECT repo, path, size_bytes + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes,
         mtime + to_seconds(CASE WHEN doc_id % 13 = 0 THEN 5 ELSE 0 END) AS mtime
  FROM files_docs WHERE doc_id % 11 <> 0)"""


def manifest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_docs(spark, sf_dir).filter("doc_id % 7 <> 0").select("repo", "path", "size_bytes", "mtime")


def listing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_docs(spark, sf_dir).filter("doc_id % 11 <> 0").select(
        "repo", "path",
        F.expr("size_bytes + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END").cast("bigint").alias("size_bytes"),
        F.expr("mtime + make_dt_interval(0, 0, 0, CASE WHEN doc_id % 13 = 0 THEN 5 ELSE 0 END)").alias("mtime"),
    )


def changed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed files with their texts, one character longer where the listing says so."""
    return files_docs(spark, sf_dir).filter("doc_id % 11 <> 0").select(
        "repo", "path", F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END").alias("text"),
        F.expr("size_bytes + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END").cast("bigint").alias("size_bytes"),
        F.expr("mtime + make_dt_interval(0, 0, 0, CASE WHEN doc_id % 13 = 0 THEN 5 ELSE 0 END)").alias("mtime"),
        "doc_id",
    )


# Heads: every third repository (by the number in its name) moved, and one in five is unknown now.
_HEAD_NO = "cast(regexp_extract(repo, '([0-9]+)$', 1) as int)"
HEADS_SQL = f"""heads AS (
  SELECT repo, CASE WHEN {_HEAD_NO} % 5 = 4 THEN NULL WHEN {_HEAD_NO} % 3 = 0 THEN 'bbb' ELSE 'aaa' END AS git_head
  FROM (SELECT DISTINCT source AS repo FROM documents))"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    number = F.expr(_HEAD_NO)
    return repos.withColumn("git_head", F.when(number % 5 == 4, None).when(number % 3 == 0, "bbb").otherwise("aaa"))


SCAN_STATE_SQL = f"""scan_state AS (
  SELECT source AS repo, TIMESTAMP '{NOW}' - to_hours({_HEAD_NO.replace('repo', 'source')}) AS last_scanned,
         'aaa' AS git_head, count(*) AS total_files,
         CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS total_lines
  FROM documents GROUP BY source)"""


def scan_state_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_docs(spark, sf_dir).groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(F.expr("length(text) - length(replace(text, '\n', ''))")).cast("bigint").alias("total_lines"),
    ).select(
        "repo", (now() - F.expr(f"make_dt_interval(0, {_HEAD_NO}, 0, 0)")).alias("last_scanned"),
        F.lit("aaa").alias("git_head"), "total_files", "total_lines",
    )


# --- activity ---------------------------------------------------------------------------------------------

_OP = (
    "CASE e.event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'signup' THEN 'edit' "
    "WHEN 'purchase' THEN 'write' ELSE 'compact' END"
)
ACCESS_SQL = f"""{FILES_DOCS_SQL}, access_log AS (
  SELECT concat('s', CAST(e.user_id AS varchar), '-', CAST(CAST(e.ts AS date) AS varchar)) AS session_id, e.ts,
         e.event_id AS seq, {_OP} AS op, d.repo, d.path, e.event_id % 17 = 0 AS is_error
  FROM events e JOIN files_docs d ON d.doc_id = CAST(json_extract_string(e.props, '$.k') AS bigint))"""


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").alias("e")
    docs = files_docs(spark, sf_dir).select("doc_id", "repo", "path").alias("d")
    key = F.get_json_object("e.props", "$.k").cast("bigint")
    return events.join(docs, F.col("d.doc_id") == key).select(
        F.expr("concat('s', cast(e.user_id as string), '-', cast(cast(e.ts as date) as string))").alias("session_id"),
        "e.ts", F.col("e.event_id").alias("seq"), F.expr(_OP).alias("op"), "d.repo", "d.path",
        F.expr("e.event_id % 17 = 0").alias("is_error"),
    )


# The same log with paths that must not be counted, and with every fifth event in a second repository of equal paths.
_ODD_PATH = (
    "CASE WHEN seq % 23 = 0 THEN 'a/.env' WHEN seq % 29 = 0 THEN '' WHEN seq % 31 = 0 THEN NULL "
    "WHEN seq % 37 = 0 THEN '.corpusmap/state.json' ELSE path END"
)
_ODD_REPO = "CASE WHEN seq % 5 = 0 THEN concat(repo, 'b') ELSE repo END"
ODD_ACCESS_SQL = ACCESS_SQL.replace("access_log AS (", "access_plain AS (") + f""", access_raw AS (
  SELECT session_id, ts, seq, op, {_ODD_REPO} AS repo, {_ODD_PATH} AS path, is_error FROM access_plain), access_log AS (
  SELECT * FROM access_raw WHERE path <> '' AND path <> 'a/.env' AND path NOT LIKE '.corpusmap/%')"""


def odd_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log(spark, sf_dir).withColumns({"repo": F.expr(_ODD_REPO), "path": F.expr(_ODD_PATH)})


# Half of the files are in the index the hints use, so that some reads miss it.
INDEX_SQL = """idx AS (
  SELECT repo, path, doc_id, size_bytes, mtime, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens,
         CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines
  FROM files_docs WHERE doc_id % 2 = 0)"""


USAGE_SQL = f"""usage_events AS (
  SELECT concat('c', CAST(conv_id AS varchar)) AS session_id,
         CASE WHEN role = 'system' THEN NULL ELSE role END AS agent,
         TIMESTAMP '{EPOCH}' + to_minutes(conv_id * 10 + turn) AS ts, turn AS seq,
         CASE WHEN turn % 4 = 3 THEN 0 ELSE CAST(ceil(length(text) / 4.0) AS BIGINT) END AS input_tokens,
         CASE WHEN turn % 2 = 1 THEN turn * 10 END AS output_tokens, turn AS cache_read_tokens,
         CAST(NULL AS BIGINT) AS cache_write_tokens, CAST(length(text) AS BIGINT) AS meter_tokens
  FROM conversations), measured AS (
  SELECT *, CASE WHEN input_tokens + coalesce(output_tokens, 0) + cache_read_tokens = 0 THEN meter_tokens
            ELSE input_tokens + coalesce(output_tokens, 0) + cache_read_tokens END AS measured_tokens
  FROM usage_events)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int), 0)")
    return table(spark, sf_dir, "conversations").select(
        F.expr("concat('c', cast(conv_id as string))").alias("session_id"),
        F.expr("CASE WHEN role = 'system' THEN NULL ELSE role END").alias("agent"),
        at.alias("ts"), F.col("turn").alias("seq"),
        F.expr("CASE WHEN turn % 4 = 3 THEN 0L ELSE cast(ceil(length(text) / 4.0) as bigint) END").alias(
            "input_tokens"),
        F.expr("CASE WHEN turn % 2 = 1 THEN turn * 10 END").alias("output_tokens"),
        F.col("turn").alias("cache_read_tokens"), F.lit(None).cast("bigint").alias("cache_write_tokens"),
        F.length("text").cast("bigint").alias("meter_tokens"),
    )


def empty_ledger(spark: SparkSession) -> DataFrame:
    from corpusmap.schemas import LEDGER

    return spark.createDataFrame([], LEDGER)


# --- knowledge --------------------------------------------------------------------------------------------

BUGS_SQL = rf"""all_bugs AS (
  SELECT source AS repo, doc_id AS seq, doc_id, trim(split_part(text, chr(10), 1)) AS error_message,
         regexp_replace(text, '^[^\n]*\n', '') AS fix, source AS file,
         TIMESTAMP '{EPOCH}' + to_minutes(doc_id) AS "at" FROM documents), bugs AS (
  SELECT repo, concat('bug-', CAST(doc_id AS varchar)) AS id, error_message, fix, file, "at" FROM all_bugs
  WHERE doc_id % 2 = 0)"""


def all_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.col("doc_id").alias("seq"), "doc_id",
        F.expr("trim(split_part(text, chr(10), 1))").alias("error_message"),
        F.regexp_replace("text", r"^[^\n]*\n", "").alias("fix"), F.col("source").alias("file"),
        F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("at"),
    )


def bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_bugs(spark, sf_dir).filter("doc_id % 2 = 0").select(
        "repo", F.expr("concat('bug-', cast(doc_id as string))").alias("id"), "error_message", "fix", "file", "at"
    )


_SECTION = "CASE turn % 3 WHEN 0 THEN 'Preferences' WHEN 1 THEN 'Do-Not-Repeat' ELSE 'Conventions' END"
LEARNED_SQL = f"""learned AS (
  SELECT concat('src', CAST(conv_id % 20 AS varchar)) AS repo, {_SECTION} AS section, conv_id * 10 + turn AS seq,
         replace(text, chr(10), ' ') AS entry,
         TIMESTAMP '{EPOCH}' + to_minutes(conv_id * 10 + turn) AS "at"
  FROM conversations), handoff AS (
  SELECT concat('src', CAST(conv_id % 20 AS varchar)) AS repo,
         concat('# STATUS', chr(10), chr(10), '## 🚀 Next phase', chr(10), chr(10), text, chr(10), chr(10),
                '## ✅ Done', chr(10), 'x') AS body,
         TIMESTAMP '{EPOCH}' + to_minutes(conv_id * 10 + turn) AS "at"
  FROM conversations)"""


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.expr("concat('src', cast(conv_id % 20 as string))").alias("repo"), F.expr(_SECTION).alias("section"),
        F.expr("conv_id * 10 + turn").alias("seq"),
        F.expr("replace(text, '\n', ' ')").alias("entry"),
        F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int), 0)").alias("at"),
    )


def handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.expr("concat('src', cast(conv_id % 20 as string))").alias("repo"),
        F.expr("concat('# STATUS\n\n## 🚀 Next phase\n\n', text, '\n\n## ✅ Done\nx')").alias("body"),
        F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int), 0)").alias("at"),
    )


# --- schedules --------------------------------------------------------------------------------------------

EXPRS = (
    "*/15 * * * *", "0 9-17 * * 1-5", "5,10 2 1 * 0", "@daily", "0 9 * JAN MON-FRI", "60 * * * *",
    "* * 32 * *", "* * * *", "* * * * wat", "30 12 1 2 *", "0 0 * * 7", "*/0 * * * *", "9-5 * * * *",
)
_EXPR = "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXPRS)) + " END"
TASKS_SQL = f"""tasks AS (
  SELECT concat('r', CAST(o_custkey % 10 AS varchar)) AS repo, concat('t', CAST(o_orderkey AS varchar)) AS id,
         concat('task ', CAST(o_orderkey AS varchar)) AS name, {_EXPR} AS expr,
         CASE WHEN o_orderkey % 2 = 0 THEN 'scan' ELSE 'check' END AS action, o_orderkey % 7 <> 0 AS enabled,
         CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '{NOW}' - to_seconds(5)
              ELSE TIMESTAMP '{NOW}' - to_minutes(o_orderkey % 100 + 1) END AS last_run,
         CASE WHEN o_orderkey % 4 <> 0 THEN 'ok' END AS last_status, CAST(NULL AS varchar) AS last_detail,
         CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderkey
  FROM orders)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.expr("concat('r', cast(o_custkey % 10 as string))").alias("repo"),
        F.expr("concat('t', cast(o_orderkey as string))").alias("id"),
        F.expr("concat('task ', cast(o_orderkey as string))").alias("name"), F.expr(_EXPR).alias("expr"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'scan' ELSE 'check' END").alias("action"),
        F.expr("o_orderkey % 7 <> 0").alias("enabled"),
        F.expr(
            f"CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN timestamp_ntz'{NOW}' - make_dt_interval(0,0,0,5) "
            f"ELSE timestamp_ntz'{NOW}' - make_dt_interval(0, 0, cast(o_orderkey % 100 + 1 as int), 0) END"
        ).alias("last_run"),
        F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN 'ok' END").alias("last_status"),
        F.lit(None).cast("string").alias("last_detail"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )
