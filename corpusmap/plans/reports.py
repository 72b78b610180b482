"""Queries for schedules, audits, the register and report views."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap import ScanOptions
from corpusmap.operators import audit as Q
from corpusmap.operators import fleet as R
from corpusmap.operators import schedule as T
from corpusmap.operators import views as V
from corpusmap.plans import inputs as X
from corpusmap.plans import scalars as S
from corpusmap.plans import stores as ST
from corpusmap.plans.changes import STALE_SQL
from corpusmap.plans.registry import query, with_
from corpusmap.sources import documents as D

# --- schedules --------------------------------------------------------------------------------------------

# What each expression of the inputs allows, written out by hand; '-' stands for a mistake.
_DAYS, _MONTHS = "range(1, 32)", "range(1, 13)"
_ALLOWED = {
    "*/15 * * * *": ("[0, 15, 30, 45]", "range(0, 24)", _DAYS, _MONTHS, "range(0, 7)"),
    "0 9-17 * * 1-5": ("[0]", "range(9, 18)", _DAYS, _MONTHS, "range(1, 6)"),
    "5,10 2 1 * 0": ("[5, 10]", "[2]", "[1]", _MONTHS, "[0]"),
    "@daily": ("[0]", "[0]", _DAYS, _MONTHS, "range(0, 7)"),
    "0 9 * JAN MON-FRI": ("[0]", "[9]", _DAYS, "[1]", "range(1, 6)"),
    "30 12 1 2 *": ("[30]", "[12]", "[1]", "[2]", "range(0, 7)"),
    "0 0 * * 7": ("[0]", "[0]", _DAYS, _MONTHS, "[0]"),
}
_MISTAKES = {
    "60 * * * *": "cron value out of range: 60", "* * 32 * *": "cron value out of range: 32",
    "* * * *": "cron needs 5 fields, got 4: * * * *", "* * * * wat": "invalid cron field: wat",
    "*/0 * * * *": "invalid cron step: */0", "9-5 * * * *": "invalid cron range: 9-5",
}
_FIELD_NAMES = ("minute", "hour", "dom", "month", "dow")
ALLOWED_SQL = "allowed AS (" + " UNION ALL ".join(
    f"SELECT '{e}' AS expr, " + ", ".join(f"{v} AS {n}s" for n, v in zip(_FIELD_NAMES, vs))
    + ", CAST(NULL AS varchar) AS error" for e, vs in _ALLOWED.items()
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{e}', NULL, NULL, NULL, NULL, NULL, '{m}'" for e, m in _MISTAKES.items()) + ")"


@query("t1_parse_schedules", with_(X.TASKS_SQL, ALLOWED_SQL) + "SELECT repo, id, error, " + ", ".join(
    f"array_to_string({n}s, ',') AS {n}s" for n in _FIELD_NAMES) + " FROM tasks t JOIN allowed a ON t.expr = a.expr")
def t1(spark, sf):
    parsed = T.parse_schedules(X.tasks(spark, sf))
    return parsed.select(
        "repo", "id", "error", *[F.array_join(n, ",").alias(f"{n}s") for n in _FIELD_NAMES])


_DAY_OK = """list_contains(months, month(day)) AND CASE WHEN len(doms) < 31 AND len(dows) < 7
    THEN list_contains(doms, day(day)) OR list_contains(dows, dayofweek(day))
  WHEN len(doms) < 31 THEN list_contains(doms, day(day)) ELSE list_contains(dows, dayofweek(day)) END"""


@query("t2_expand_schedule", with_(X.TASKS_SQL, ALLOWED_SQL) + f""", days AS (
  SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS date) AS day),
fires AS (
  SELECT expr, day + to_hours(h) + to_minutes(m) AS fire_at FROM (
    SELECT expr, day, unnest(hours) AS h, minutes FROM allowed, days WHERE error IS NULL AND {_DAY_OK}),
    LATERAL (SELECT unnest(minutes) AS m))
SELECT repo, id, {X.sql_ts('fire_at')} AS fire_at FROM tasks t JOIN fires f ON t.expr = f.expr
WHERE fire_at BETWEEN TIMESTAMP '2024-01-30 10:10:00' AND TIMESTAMP '2024-02-04 08:00:00'""")
def t2(spark, sf):
    fires = T.expand_schedule(X.tasks(spark, sf), X.ntz("2024-01-30 10:10:00"), X.ntz("2024-02-04 08:00:00"))
    return fires.withColumn("fire_at", X.show_ts("fire_at"))


@query("t3_due_tasks", with_(X.TASKS_SQL) + f"""
SELECT repo, id, action, last_status FROM tasks WHERE enabled AND expr IN ('*/15 * * * *', '30 12 1 2 *')
  AND (last_run IS NULL OR last_run < date_trunc('minute', TIMESTAMP '{X.NOW}'))""")
def t3(spark, sf):
    return T.due_tasks(X.tasks(spark, sf), X.now()).select("repo", "id", "action", "last_status")


@query("t4_apply_task_changes", with_(X.TASKS_SQL) + f""", changed AS (
  SELECT repo, id, o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'renamed' ELSE name END AS name, last_run, last_status, last_detail
  FROM tasks WHERE o_orderkey % 10 <> 4 UNION ALL
  SELECT repo, concat(id, '-new'), o_orderkey, 'renamed', last_run, last_status, last_detail FROM tasks WHERE o_orderkey % 10 = 5)
SELECT repo, id, name, {X.sql_ts(f"CASE WHEN o_orderkey % 6 = 0 AND id NOT LIKE '%-new' THEN TIMESTAMP '{X.NOW}' ELSE last_run END")} AS last_run,
  CASE WHEN o_orderkey % 6 = 0 AND id NOT LIKE '%-new' THEN 'error' ELSE last_status END AS last_status,
  CASE WHEN o_orderkey % 6 = 0 AND id NOT LIKE '%-new' THEN repeat('x', 400) ELSE last_detail END AS last_detail
FROM changed""")
def t4(spark, sf):
    tasks = X.tasks(spark, sf)
    number = F.substring("id", 2, 20).cast("bigint")
    upserts = tasks.filter(number % 10 == 3).withColumn("name", F.lit("renamed")).unionByName(
        tasks.filter(number % 10 == 5).withColumn("name", F.lit("renamed")).withColumn("id", F.concat("id", F.lit("-new"))))
    removals = tasks.filter(number % 10 == 4).select("repo", "id")
    ran = tasks.filter(number % 6 == 0).select("repo", "id")
    runs = ran.select("repo", "id", X.now().alias("at"), F.lit("error").alias("status"), F.lit(None).cast("string").alias("detail")).unionByName(
        ran.select("repo", "id", (X.now() - F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit("ok").alias("status"),
                   F.repeat(F.lit("x"), 400).alias("detail")))
    out = T.apply_task_changes(tasks, upserts, removals, runs)
    return out.select("repo", "id", "name", X.show_ts("last_run").alias("last_run"), "last_status", "last_detail")


# --- audits -----------------------------------------------------------------------------------------------

_PLANTED = (
    "concat(text, chr(10), CASE doc_id % 12 WHEN 0 THEN 'password = \"hunter22\"' WHEN 1 THEN '  api_key: abcdef123456' "
    "WHEN 2 THEN 'Authorization: Bearer abcdef.123456' WHEN 3 THEN '-----BEGIN RSA PRIVATE KEY-----' "
    "WHEN 4 THEN 'x = eval(y) + exec (z)' WHEN 5 THEN 'subprocess.call(cmd, shell=True)' "
    "WHEN 6 THEN 'q = \"SELECT * FROM t WHERE a=\" + b' WHEN 7 THEN '<a dangerouslySetInnerHTML={x}>' "
    "WHEN 8 THEN '\"postinstall\": \"x\"' WHEN 9 THEN 'postgres://me:pw@host/db' "
    "WHEN 10 THEN 'Access-Control-Allow-Origin: *' ELSE 'nothing' END)"
)
_AUDIT_PATH = "CASE WHEN doc_id % 10 = 0 THEN concat('d', cast(doc_id as string), '/package.json') ELSE path END"
AUDIT_SQL = X.FILES_DOCS_SQL + f""", audit_files AS (
  SELECT repo, {_AUDIT_PATH.replace('as string', 'as varchar')} AS path, {_PLANTED} AS text FROM files_docs), audit_lines AS (
  SELECT repo, path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT repo, path, string_split(text, chr(10)) AS ls FROM audit_files)), findings AS (""" + " UNION ALL ".join(
    (f"SELECT repo, path, 0 AS line_no, '{r.name}' AS rule, '{r.layer}' AS layer, '{r.severity}' AS severity, "
     f"regexp_extract(path, '[^/]*$') AS line FROM audit_files WHERE regexp_matches(regexp_extract(path, '[^/]*$'), {S._q(r.pattern)})")
    if r.on_path else
    (f"SELECT repo, path, line_no, '{r.name}', '{r.layer}', '{r.severity}', trim(line, chr(13) || chr(9) || ' ') "
     f"FROM audit_lines WHERE regexp_matches(line, {S._q(r.pattern)})")
    for r in Q.AUDIT_RULES) + ")"
_RANK_SQL = "list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity)"


def audit_files(spark, sf):
    docs = X.files_docs(spark, sf)
    return docs.select("repo", F.expr(_AUDIT_PATH).alias("path"), F.expr(_PLANTED).alias("text"))


@query("q1_audit_lines", with_(AUDIT_SQL) + """
SELECT repo, path, CAST(line_no AS BIGINT) AS line_no, rule, layer, severity, line FROM findings""")
def q1(spark, sf):
    return Q.audit_lines(audit_files(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("q2_audit_listing", with_(AUDIT_SQL) + f"""
SELECT repo, CAST({_RANK_SQL} AS BIGINT) AS severity_rank,
       concat('- ', severity, ': ', rule, ' (', path, ':', CAST(line_no AS varchar), ')') AS report FROM findings""")
def q2_listing(spark, sf):
    return Q.audit_listing(Q.audit_lines(audit_files(spark, sf))).select(
        "repo", F.col("severity_rank").cast("bigint").alias("severity_rank"), "report")


@query("q2_audit_report", with_(AUDIT_SQL) + ", checks AS (" + " UNION ALL ".join(
    f"SELECT '{r.name}' AS rule, '{r.layer}' AS layer, '{r.severity}' AS severity" for r in Q.AUDIT_RULES) + f""")
SELECT r.repo, c.rule, c.layer, c.severity, CAST({_RANK_SQL.replace('severity)', 'c.severity)')} AS BIGINT) AS severity_rank,
  count(f.rule) AS findings, count(DISTINCT f.path) AS files, count(f.rule) = 0 AS passed
FROM (SELECT DISTINCT source AS repo FROM documents) r CROSS JOIN checks c
LEFT JOIN findings f ON f.repo = r.repo AND f.rule = c.rule GROUP BY r.repo, c.rule, c.layer, c.severity""")
def q2(spark, sf):
    report = Q.audit_report(Q.audit_lines(audit_files(spark, sf)), X.heads(spark, sf))
    return report.withColumn("severity_rank", F.col("severity_rank").cast("bigint"))


@query("q3_findings_to_bugs", with_(AUDIT_SQL, X.BUGS_SQL) + f""", grave AS (
  SELECT DISTINCT repo, concat(severity, ': ', rule) AS error_message, path AS file FROM findings
  WHERE severity IN ('CRITICAL', 'HIGH')), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY error_message, file) AS n FROM grave)
SELECT g.repo, concat('bug-', CAST(n + (SELECT count(*) FROM bugs b WHERE b.repo = g.repo) AS varchar), '-',
    lower(to_base(epoch_ms(TIMESTAMP '{X.NOW}'), 36))) AS id, error_message, '' AS fix, file FROM numbered g""")
def q3(spark, sf):
    bugs = Q.findings_to_bugs(Q.audit_lines(audit_files(spark, sf)), X.bugs(spark, sf), X.now())
    return bugs.select("repo", "id", "error_message", "fix", "file")


# --- register and views -----------------------------------------------------------------------------------

# Every customer number names a repository; orders register and unregister them over time.
REPOS_SQL = f"""known AS (SELECT concat('org/r', CAST(c_custkey AS varchar)) AS repo, TIMESTAMP '1990-01-01' AS "at" FROM customer
  WHERE c_custkey % 3 = 0), changes AS (
  SELECT concat('org/r', CAST(o_custkey AS varchar)) AS repo, CASE WHEN o_orderkey % 4 = 0 THEN 'unregister' ELSE 'register' END AS action,
         CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey) AS "at" FROM orders), events_all AS (
  SELECT repo, 'register' AS action, "at" FROM known UNION ALL SELECT repo, action, "at" FROM changes), repos AS (
  SELECT repo, split_part(repo, '/', 2) AS name, max("at") FILTER (action = 'register') AS registered_at
  FROM events_all GROUP BY repo HAVING arg_max(action, "at") = 'register')"""


def repos(spark, sf):
    known = X.table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(
        F.expr("concat('org/r', cast(c_custkey as string))").alias("repo"),
        X.ntz("1990-01-01 00:00:00").alias("registered_at"))
    changes = X.table(spark, sf, "orders").select(
        F.expr("concat('org/r', cast(o_custkey as string))").alias("repo"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'unregister' ELSE 'register' END").alias("action"),
        F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, o_orderkey)").alias("at"))
    return R.register_repos(known, changes)


@query("r1_register_repos", with_(REPOS_SQL) + f"SELECT repo, name, {X.sql_ts('registered_at')} AS registered_at FROM repos")
def r1(spark, sf):
    return repos(spark, sf).withColumn("registered_at", X.show_ts("registered_at"))


_SOME_REPOS = "cast(regexp_extract(repo, '([0-9]+)$', 1) as int) % 3 = 1"
SOME_SQL = f"""some_repos AS (SELECT repo FROM (SELECT DISTINCT source AS repo FROM documents) WHERE {_SOME_REPOS} UNION ALL SELECT 'gone')"""


def some_repos(spark, sf):
    repos = X.heads(spark, sf).filter(_SOME_REPOS).select("repo")
    gone = spark.createDataFrame([("gone",)], "repo string")
    return repos.unionByName(gone).withColumn("name", F.col("repo"))


_UPDATE_OPTS = ScanOptions(ignore=(), symbols=False)


@query("r2_update_all", with_(X.FILES_DOCS_SQL, SOME_SQL) + f"""
SELECT s.repo, CASE WHEN count(f.path) > 0 THEN 'ok' ELSE 'no files' END AS status, count(f.path) AS files,
       CAST(coalesce(sum(length(text) - length(replace(text, chr(10), ''))), 0) AS BIGINT) AS lines
FROM some_repos s LEFT JOIN files_docs f ON f.repo = s.repo GROUP BY s.repo""")
def r2(spark, sf):
    mine = some_repos(spark, sf)
    index = R.update_all(mine, X.files_docs(spark, sf), _UPDATE_OPTS)
    return R.update_status(mine, index, X.now()).select("repo", "status", "files", "lines")


@query("v1_status_view", with_(X.ACCESS_SQL, X.SCAN_STATE_SQL, X.HEADS_SQL, STALE_SQL, X.BUGS_SQL, SOME_SQL) + f"""
SELECT r.repo, {X.sql_ts('s.last_scanned')} AS last_scanned, coalesce(total_files, 0) AS files,
  coalesce(total_lines, 0) AS lines, s.git_head, coalesce(s.git_head <> h.git_head, false) AS head_moved,
  t.reason AS stale_reason, CAST(1500 AS BIGINT) AS digest_budget,
  (SELECT count(DISTINCT session_id) FROM access_log a WHERE a.repo = r.repo) AS sessions,
  (SELECT count(*) FROM bugs b WHERE b.repo = r.repo) AS bugs
FROM some_repos r LEFT JOIN scan_state s ON s.repo = r.repo LEFT JOIN heads h ON h.repo = r.repo
LEFT JOIN stale t ON t.repo = r.repo""")
def v1(spark, sf):
    view = V.status_view(
        some_repos(spark, sf), X.scan_state_docs(spark, sf), X.heads(spark, sf),
        X.access_log(spark, sf).select("repo", "session_id"), X.bugs(spark, sf), 6, X.now())
    return view.withColumn("last_scanned", X.show_ts("last_scanned"))


@query("v2_activity_view", with_(X.ACCESS_SQL, ST.PARSED_LOG_SQL) + """
SELECT repo, time, action, files, outcome, tokens FROM parsed_log WHERE time <> 'Time'""")
def v2(spark, sf):
    return V.activity_view(D.parse_action_log(ST.log_docs(spark, sf)))


@query("v3_bug_view", with_(X.BUGS_SQL) + """
SELECT repo, id, error_message, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "at" DESC, id DESC) AS rank FROM bugs) WHERE rank <= 50""")
def v3(spark, sf):
    return V.bug_view(X.bugs(spark, sf)).select(
        "repo", "id", "error_message", F.col("rank").cast("bigint").alias("rank"))


@query("v4_schedule_view", with_(X.TASKS_SQL) + f"""
SELECT repo, id, name, expr, action, CASE WHEN enabled THEN 'enabled' ELSE 'disabled' END AS state,
       {X.sql_ts('last_run')} AS last_run, coalesce(last_status, 'never run') AS last_status FROM tasks""")
def v4(spark, sf):
    view = V.schedule_view(X.tasks(spark, sf)).withColumn("last_run", X.show_ts("last_run"))
    return view.drop("last_detail")
