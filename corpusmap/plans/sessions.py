"""Queries for access logs and the token ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap import ScanOptions
from corpusmap.operators import access as E
from corpusmap.operators import ledger as L
from corpusmap.operators.filters import loggable_events
from corpusmap.operators.index import analyze_files
from corpusmap.plans import files as PF
from corpusmap.plans import inputs as X
from corpusmap.plans import scalars as S
from corpusmap.plans.registry import query, with_

ALL = ScanOptions(ignore=(), hidden=True, symbols=False)
LOG = with_(X.ODD_ACCESS_SQL, X.INDEX_SQL)


def half_index(spark, sf):
    """Every second document is in the index, so that some reads miss it."""
    return analyze_files(X.files_docs(spark, sf).filter("doc_id % 2 = 0"), ALL)


REPEATS_SQL = """repeats AS (
  SELECT a.*, row_number() OVER (PARTITION BY session_id, repo, path ORDER BY ts, seq) AS rn FROM access_log a
  WHERE op = 'read')"""


@query("e1_repeated_reads", LOG + f""", {REPEATS_SQL}
SELECT r.session_id, r.repo, r.path, r.seq, {X.sql_ts('r.ts')} AS ts, coalesce(tokens, 0) AS tokens,
  concat('⚡ ', r.path, ' has been read before in this session (~', CAST(greatest(1, coalesce(tokens, 0)) AS varchar),
    ' tokens); what is known of it may do.') AS warning
FROM repeats r LEFT JOIN idx i ON r.repo = i.repo AND r.path = i.path WHERE rn > 1""")
def e1(spark, sf):
    return E.repeated_reads(X.odd_access_log(spark, sf), half_index(spark, sf)).withColumn("ts", X.show_ts("ts"))


# Reads of the code-shaped files, which have symbols: one file in three changed since it was indexed.
_HINT_EVENTS = "concat('u', cast(user_id as string))"
ACCESS_CODE_SQL = f"""access_code AS (
  SELECT concat('u', CAST(user_id AS varchar)) AS session_id, f.repo, f.path, f.o_orderkey, e.ts, e.event_id AS seq,
         {X._OP} AS op
  FROM events e JOIN files_code f ON f.o_orderkey = e.event_id // 3)"""


def access_code(spark, sf):
    events = X.table(spark, sf, "events").alias("e")
    files = X.files_code(spark, sf).select("repo", "path", "o_orderkey")
    return events.join(files, F.expr("o_orderkey = e.event_id div 3")).select(
        F.expr(_HINT_EVENTS).alias("session_id"), "repo", "path", "e.ts", F.col("e.event_id").alias("seq"),
        F.expr(X._OP).alias("op"))


@query("e2_read_hints", with_(X.FILES_CODE_SQL, PF.SPANS_SQL, ACCESS_CODE_SQL) + f""", about AS ({S.DESCRIBE_CODE_SQL}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY tokens DESC, line, name) AS rn FROM symbols),
labels AS (
  SELECT repo, path, string_agg(concat(name, ' L', CAST(line AS varchar),
      CASE WHEN end_line <> line THEN concat('-', CAST(end_line AS varchar)) ELSE '' END, ' ~',
      CAST(tokens AS varchar), ' tok'), '; ' ORDER BY rn) AS label FROM ranked WHERE rn <= 5 GROUP BY repo, path),
facts AS (
  SELECT f.repo, f.path, about AS summary, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens, label,
         o_orderkey % 3 <> 0 AS fresh
  FROM files_code f JOIN about a ON f.repo = a.repo AND f.path = a.path
  JOIN labels l ON f.repo = l.repo AND f.path = l.path WHERE o_orderkey % 4 <> 0),
first_seen AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, repo, path ORDER BY ts, seq) AS rn FROM access_code
  WHERE op = 'read')
SELECT r.session_id, r.repo, r.path, r.seq, {X.sql_ts('r.ts')} AS ts, f.path IS NOT NULL AS hit,
  CASE WHEN f.path IS NOT NULL THEN concat('📋 indexed: ', r.path, ' — ', summary, ' (~', CAST(tokens AS varchar), ' tok)',
    CASE WHEN fresh THEN concat(chr(10), '   ↳ parts: ', label,
        '. Reading can begin at the line that is wanted.')
      ELSE concat(chr(10), '   ↳ changed after it was indexed, so its line ranges may be off.') END) END AS hint
FROM first_seen r LEFT JOIN facts f ON r.repo = f.repo AND r.path = f.path WHERE rn = 1""")
def e2(spark, sf):
    files = X.files_code(spark, sf)
    index = analyze_files(files.filter("o_orderkey % 4 <> 0"), PF.MAP_OPTS)
    listing = files.select(
        "repo", "path", "size_bytes",
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN mtime + make_dt_interval(1) ELSE mtime END").alias("mtime"))
    return E.read_hints(access_code(spark, sf), index, listing).withColumn("ts", X.show_ts("ts"))


SESSION_FILES_SQL = """session_files AS (
  SELECT a.session_id, a.repo, a.path, count_if(op = 'read') AS reads, min(CASE WHEN op = 'read' THEN ts END) AS first_read,
         count_if(op <> 'read') AS edits, coalesce(any_value(i.tokens), 0) AS tokens,
         any_value(i.tokens) IS NOT NULL AS indexed
  FROM access_log a LEFT JOIN idx i ON a.repo = i.repo AND a.path = i.path WHERE op <> 'compact'
  GROUP BY a.session_id, a.repo, a.path)"""


@query("e3_session_files", LOG + f""", {SESSION_FILES_SQL}
SELECT session_id, repo, path, reads, {X.sql_ts('first_read')} AS first_read, edits, tokens, indexed
FROM session_files""")
def e3_files(spark, sf):
    out = E.session_files(X.odd_access_log(spark, sf), half_index(spark, sf))
    return out.withColumn("first_read", X.show_ts("first_read"))


@query("e3_session_state", LOG + f""", {SESSION_FILES_SQL}
SELECT session_id, count_if(reads > 0 AND indexed) AS index_hits, count_if(reads > 0 AND NOT indexed) AS index_misses,
       CAST(sum(CASE WHEN reads > 0 THEN reads - 1 ELSE 0 END) AS BIGINT) AS repeated_reads,
       CAST(sum(edits) AS BIGINT) AS writes, count_if(reads > 0) AS files_read, count_if(edits > 0) AS files_written
FROM session_files GROUP BY session_id""")
def e3(spark, sf):
    return E.session_state(X.odd_access_log(spark, sf), half_index(spark, sf))


@query("e4_prune_session", LOG + f""", reads AS (
  SELECT session_id, repo, path, count(*) AS n, min(ts) AS first_ts, min(seq) % 9 = 0 AS broken FROM access_log WHERE op = 'read'
  GROUP BY session_id, repo, path), kept AS (
  SELECT * FROM reads WHERE NOT broken AND first_ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOURS), w AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS rn FROM access_log
  WHERE op IN ('write', 'edit') AND seq % 3 = 0), ed AS (
  SELECT session_id, repo, path, count(*) AS n FROM access_log WHERE op = 'edit' GROUP BY session_id, repo, path)
SELECT 'read' AS kind, session_id, repo, path, n FROM kept UNION ALL
SELECT 'write', session_id, repo, path, seq FROM w UNION ALL
SELECT 'edit', session_id, repo, path, n FROM ed WHERE (session_id, repo, path) IN (SELECT session_id, repo, path FROM kept)
  OR (session_id, repo, path) IN (SELECT session_id, repo, path FROM w)""")
def e4(spark, sf):
    log = loggable_events(X.odd_access_log(spark, sf))
    reads = log.filter("op = 'read'").groupBy("session_id", "repo", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.min("seq") % 9 == 0, "not-a-date").otherwise(F.min("ts").cast("string")).alias("first_read"))
    writes = log.filter("op IN ('write', 'edit') AND seq % 3 = 0").select(
        "session_id", "repo", "path", F.col("ts").alias("at"), "seq")
    edits = log.filter("op = 'edit'").groupBy("session_id", "repo", "path").agg(F.count(F.lit(1)).alias("n"))
    r, w, e = E.prune_session(reads, writes, edits, X.ntz("2024-01-20 12:00:00"))
    columns = ["kind", "session_id", "repo", "path", "n"]
    return (
        r.withColumn("kind", F.lit("read")).select(columns)
        .unionByName(w.withColumn("kind", F.lit("write")).withColumn("n", F.col("seq")).select(columns))
        .unionByName(e.withColumn("kind", F.lit("edit")).select(columns)))


LOG_ROWS_SQL = """log_rows AS (
  SELECT session_id, repo, seq, ts, op AS action, path, CASE WHEN is_error THEN 'error' ELSE 'ok' END AS outcome,
         concat('| ', strftime(ts, '%Y-%m-%d %H:%M'), ' | ', op, ' | `', path, '` | ',
                CASE WHEN is_error THEN 'error' ELSE 'ok' END, ' | 0 |') AS row
  FROM access_log WHERE op IN ('write', 'edit'))"""


@query("e5_action_log", LOG + f""", {LOG_ROWS_SQL}
SELECT session_id, repo, seq, action, path AS files, outcome, row FROM log_rows""")
def e5(spark, sf):
    return E.action_log(X.odd_access_log(spark, sf)).select(
        "session_id", "repo", "seq", "action", F.array_join("files", ",").alias("files"), "outcome", "row")


@query("e6_compaction_digest", LOG + f""", firsts AS (
  SELECT session_id, repo, path, min(struct_pack(ts := ts, seq := seq)) AS f FROM access_log
  WHERE op IN ('write', 'edit') GROUP BY session_id, repo, path), before AS (
  SELECT c.session_id, c.ts, c.seq, f.path, f.f,
         row_number() OVER (PARTITION BY c.seq ORDER BY f.f DESC) AS back, count(*) OVER (PARTITION BY c.seq) AS n_all
  FROM access_raw c JOIN firsts f ON c.session_id = f.session_id AND f.f <= struct_pack(ts := c.ts, seq := c.seq)
  WHERE c.op = 'compact')
SELECT session_id, seq, {X.sql_ts('ts')} AS ts, count(*) AS n_files, any_value(n_all) AS n_all, string_agg(path, ', ' ORDER BY f) AS files,
  concat('## After a compaction', chr(10), 'Written so far in this session: ',
    string_agg(path, ', ' ORDER BY f), CASE WHEN any_value(n_all) > 2 THEN concat(' and ',
      CAST(any_value(n_all) - 2 AS varchar), ' earlier') ELSE '' END, '. The action log tells what was done to them.') AS message
FROM before WHERE back <= 2 GROUP BY session_id, seq, ts""")
def e6(spark, sf):
    return E.compaction_digest(X.odd_access_log(spark, sf), shown=2).withColumn("ts", X.show_ts("ts"))


# --- ledger -----------------------------------------------------------------------------------------------

LEDGER_SQL = """ledger AS (
  SELECT session_id, arg_max(agent, seq) FILTER (agent IS NOT NULL) AS agent, arg_max(measured_tokens, seq) AS measured_tokens,
         min(ts) AS first_seen, max(ts) AS "at" FROM measured GROUP BY session_id)"""


def ledger(spark, sf):
    """The ledger after two rounds of upserts."""
    usage = X.usage_events(spark, sf)
    early = L.ledger_upsert(X.empty_ledger(spark), usage.filter("seq < 2"))
    return L.ledger_upsert(early, usage.filter("seq >= 2"))


@query("l1_ledger_upsert", with_(X.USAGE_SQL, LEDGER_SQL) + f"""
SELECT session_id, agent, measured_tokens, {X.sql_ts('first_seen')} AS first_seen, {X.sql_ts('"at"')} AS "at" FROM ledger""")
def l1(spark, sf):
    return ledger(spark, sf).select(
        "session_id", "agent", "measured_tokens", X.show_ts("first_seen").alias("first_seen"),
        X.show_ts("at").alias("at"))


@query("l2_ledger_cap", with_(X.USAGE_SQL, LEDGER_SQL) + """
SELECT session_id, measured_tokens, (SELECT count(*) FROM ledger) AS lifetime FROM ledger
ORDER BY first_seen DESC, session_id DESC LIMIT 50""")
def l2(spark, sf):
    whole = ledger(spark, sf)
    kept = L.ledger_cap(whole, 50)
    return kept.select("session_id", "measured_tokens", L.lifetime_sessions(whole).scalar().alias("lifetime"))


@query("l3_usage_report", with_(X.USAGE_SQL, LEDGER_SQL) + """
SELECT session_id, agent, measured_tokens, (SELECT count(*) FROM ledger) AS all_sessions,
       (SELECT CAST(sum(measured_tokens) AS BIGINT) FROM ledger) AS all_measured
FROM ledger ORDER BY first_seen DESC, session_id DESC LIMIT 10""")
def l3(spark, sf):
    return L.usage_report(ledger(spark, sf), 10).select(
        "session_id", "agent", "measured_tokens", "all_sessions", "all_measured")


@query("l4_digest_budget", with_(X.USAGE_SQL, LEDGER_SQL) + """
SELECT session_id, agent, CASE agent WHEN 'assistant' THEN 400 ELSE 900 END AS budget FROM ledger""")
def l4(spark, sf):
    agents = ledger(spark, sf).select("session_id", "agent")
    return L.digest_budget(agents, 900, {"assistant": 400})
