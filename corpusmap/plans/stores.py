"""Queries for documents, knowledge stores, digests and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmap.operators import digest as G
from corpusmap.operators import knowledge as K
from corpusmap.operators import merge as M
from corpusmap.plans import inputs as X
from corpusmap.plans import scalars as S
from corpusmap.plans import sessions as PS
from corpusmap.plans.changes import STALE_SQL
from corpusmap.plans.registry import query, with_
from corpusmap.sources import documents as D
from corpusmap.sources import store

# --- documents --------------------------------------------------------------------------------------------

_BUG_DOC = (
    "CASE WHEN doc_id % 10 = 9 THEN '{\"bugs\": [' ELSE concat('{\"version\": 1, \"bugs\": [{\"id\": \"b', "
    "cast(doc_id as string), '\", \"error_message\": \"err ', lang, '\", \"fix\": \"fix\", \"n\": ', "
    "cast(n_chars as string), ', \"tags\": [\"a\",\"', source, '\"]}, {\"summary\": \"s\"}]}') END"
)


def _varchar(text: str) -> str:
    return text.replace("as string", "as varchar")


@query("s4_read_bugs_json", f"""
SELECT concat('k', CAST(doc_id AS varchar)) AS repo, seq,
  CASE seq WHEN 0 THEN concat('b', CAST(doc_id AS varchar)) END AS id,
  CASE seq WHEN 0 THEN concat('err ', lang) END AS error_message, CASE seq WHEN 0 THEN CAST(n_chars AS varchar) END AS n,
  CASE seq WHEN 0 THEN concat('["a","', source, '"]') END AS tags, CASE seq WHEN 1 THEN 's' END AS summary
FROM documents, (SELECT unnest([0, 1]) AS seq) WHERE doc_id % 10 <> 9""")
def s4(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        F.expr("concat('k', cast(doc_id as string))").alias("repo"), F.expr(_BUG_DOC).alias("text"))
    f = F.col("fields")
    rows = D.read_bugs_json(docs)
    return rows.select(
        "repo", F.col("seq").cast("int").alias("seq"),
        *[f[k].alias(k) for k in ("id", "error_message", "n", "tags", "summary")])


_LEDGER_DOC = (
    "concat('{\"version\": 1, \"sessions\": [{\"session_id\": \"c', cast(conv_id as string), '\", \"agent\": \"', role, "
    "'\", \"measured_tokens\": ', cast(turn as string), ', \"at\": \"2024-01-01T00:0', cast(turn as string), "
    "':00Z\"}, {\"session_id\": \"z\", \"estimated_tokens\": 7}]}')"
)


@query("s5_read_ledger_json", """
SELECT concat('k', CAST(conv_id * 10 + turn AS varchar)) AS repo, seq,
  CASE seq WHEN 0 THEN concat('c', CAST(conv_id AS varchar)) ELSE 'z' END AS session_id, CASE seq WHEN 0 THEN role END AS agent,
  CASE seq WHEN 0 THEN turn END AS measured_tokens, CASE seq WHEN 1 THEN 7 END AS estimated_tokens,
  CASE seq WHEN 0 THEN concat('2024-01-01 00:0', CAST(turn AS varchar), ':00.000000') END AS "at"
FROM conversations, (SELECT unnest([0, 1]) AS seq)""")
def s5(spark, sf):
    docs = X.table(spark, sf, "conversations").select(
        F.expr("concat('k', cast(conv_id * 10 + turn as string))").alias("repo"), F.expr(_LEDGER_DOC).alias("text"))
    return D.read_ledger_json(docs).select(
        "repo", F.col("seq").cast("int").alias("seq"), "session_id", "agent", "measured_tokens",
        F.col("estimated_tokens").cast("int").alias("estimated_tokens"), X.show_ts("at").alias("at"))


def log_docs(spark, sf):
    """One log document per session and hour: a table of its writes, in order."""
    log = PS.E.action_log(X.access_log(spark, sf))
    hour = F.concat_ws("@", "session_id", F.date_format("at", "yyyy-MM-dd HH"))
    rows = log.groupBy(hour.alias("session_id")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "row"))).alias("rows"))
    head = "# Log\n\n| Time | Action | Files | Outcome | Tokens |\n| --- | :---: | --- | --- | --- |\n"
    return rows.select(
        F.col("session_id").alias("repo"),
        F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n")).alias("text"))


PARSED_LOG_SQL = f"""{PS.LOG_ROWS_SQL.replace("log_rows AS (", "whole_log AS (")}, log_rows AS (
  SELECT * REPLACE (concat(session_id, '@', strftime(ts, '%Y-%m-%d %H')) AS session_id) FROM whole_log), parsed_log AS (
  SELECT session_id AS repo, 4 + row_number() OVER (PARTITION BY session_id ORDER BY seq) AS row_no, row,
         strftime(ts, '%Y-%m-%d %H:%M') AS time, action, path AS files, outcome, '0' AS tokens
  FROM log_rows UNION ALL
  SELECT DISTINCT session_id, 3, '| Time | Action | Files | Outcome | Tokens |', 'Time', 'Action', 'Files', 'Outcome', 'Tokens'
  FROM log_rows)"""


@query("s6_parse_action_log", with_(X.ACCESS_SQL, PARSED_LOG_SQL) + "SELECT * FROM parsed_log")
def s6(spark, sf):
    return D.parse_action_log(log_docs(spark, sf)).withColumn("row_no", F.col("row_no").cast("bigint"))


_SECTION_DOC = (
    "concat('# Title', chr(10), 'intro', chr(10), '## ', role, '  ', chr(10), '- one', chr(10), text, chr(10), "
    "'## Empty', chr(10), '##  Last', chr(10), '- two')"
)
SECTION_DOCS_SQL = f"""section_docs AS (
  SELECT concat('k', CAST(conv_id * 10 + turn AS varchar)) AS repo, {_SECTION_DOC} AS text FROM conversations)"""


def section_docs(spark, sf):
    return X.table(spark, sf, "conversations").select(
        F.expr("concat('k', cast(conv_id * 10 + turn as string))").alias("repo"), F.expr(_SECTION_DOC).alias("text"))


SECTIONS_SQL = f"""{SECTION_DOCS_SQL}, doc_lines AS (
  SELECT repo, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT repo, string_split(text, chr(10)) AS ls FROM section_docs)), marked AS (
  SELECT *, regexp_matches(line, '^##\\s+(.+?)\\s*$') AS head, count_if(regexp_matches(line, '^##\\s+(.+?)\\s*$'))
           OVER (PARTITION BY repo ORDER BY line_no) AS section_no FROM doc_lines), sections AS (
  SELECT m.repo, m.section_no, regexp_extract(h.line, '^##\\s+(.+?)\\s*$', 1) AS heading, m.line_no, m.line
  FROM marked m LEFT JOIN marked h ON m.repo = h.repo AND m.section_no = h.section_no AND h.head WHERE NOT m.head)"""


@query("s7_parse_sections", with_(SECTIONS_SQL) + """
SELECT repo, section_no, CASE WHEN section_no > 0 THEN heading END AS heading, line_no, line FROM sections""")
def s7(spark, sf):
    out = D.parse_sections(section_docs(spark, sf))
    return out.select("repo", F.col("section_no").cast("bigint").alias("section_no"), "heading",
                      F.col("line_no").cast("bigint").alias("line_no"), "line")


PHASE = r"trim(regexp_extract({0}, '(?s)(## 🚀.*?)\n(?:## |---[ \t]*\n)', 1), chr(10) || chr(13) || chr(9) || ' ')"


@query("s8_extract_section", with_(X.LEARNED_SQL) + f"""
SELECT repo, {X.sql_ts('"at"')} AS "at", {PHASE.format('body')} AS section FROM handoff""")
def s8(spark, sf):
    notes = X.handoff(spark, sf)
    docs = notes.select(F.concat_ws("@", "repo", X.show_ts("at")).alias("repo"), F.col("body").alias("text"))
    return D.extract_section(docs, G.NEXT_PHASE).select(
        F.substring_index("repo", "@", 1).alias("repo"), F.substring_index("repo", "@", -1).alias("at"), "section")


# --- knowledge --------------------------------------------------------------------------------------------

_RAW_SECTION = f"CASE WHEN turn % 3 = 0 THEN NULL ELSE {X._SECTION} END"


@query("k1_append_learned", with_(X.LEARNED_SQL) + """, old AS (SELECT * FROM learned WHERE seq % 10 < 3), fresh AS (
  SELECT repo, section, (SELECT coalesce(max(seq), 0) FROM old o WHERE o.repo = l.repo AND o.section = l.section)
           + row_number() OVER (PARTITION BY repo, section ORDER BY "at", entry) AS seq, entry, "at"
  FROM learned l WHERE seq % 10 >= 3)
SELECT repo, section, seq, entry FROM old UNION ALL SELECT repo, section, seq, entry FROM fresh""")
def k1(spark, sf):
    old = X.learned(spark, sf).filter("seq % 10 < 3")
    new = X.table(spark, sf, "conversations").filter("turn >= 3").select(
        F.expr("concat('src', cast(conv_id % 20 as string))").alias("repo"), F.expr(_RAW_SECTION).alias("section"),
        F.col("text").alias("entry"),
        F.expr(f"timestamp_ntz'{X.EPOCH}' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int), 0)").alias("at"))
    return K.append_learned(old, new).select("repo", "section", "seq", "entry")


@query("k2_log_bugs", with_(X.BUGS_SQL) + """, fresh AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "at", error_message, fix, file) AS n FROM all_bugs
  WHERE doc_id % 2 = 1)
SELECT repo, id, error_message, fix, file FROM bugs UNION ALL
SELECT f.repo, concat('bug-', CAST(n + (SELECT count(*) FROM bugs b WHERE b.repo = f.repo) AS varchar), '-',
  lower(to_base(epoch_ms("at"), 36))), error_message, fix, file FROM fresh f""")
def k2(spark, sf):
    new = X.all_bugs(spark, sf).filter("doc_id % 2 = 1").drop("seq", "doc_id")
    return K.log_bugs(X.bugs(spark, sf), new).select("repo", "id", "error_message", "fix", "file")


FOUND_SQL = with_(X.BUGS_SQL) + """
SELECT repo, id, error_message, fix, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "at" DESC, id DESC) AS rank FROM bugs
  WHERE contains(lower(error_message), 'the ') OR contains(lower(fix), 'the ') OR contains(lower(file), 'the '))
WHERE rank <= 10"""


def _found(df):
    return df.select("repo", "id", "error_message", "fix", F.col("rank").cast("bigint").alias("rank"))


@query("k3_search_bugs", FOUND_SQL)
def k3(spark, sf):
    return _found(K.search_bugs(X.bugs(spark, sf), "The "))


@query("k3_search_bug_index", FOUND_SQL)
def k3_index(spark, sf):
    """The same search by stored postings of runs of three characters."""
    path, bugs = X.work_dir(spark), X.bugs(spark, sf)
    store.write_bug_index(bugs, path)
    return _found(K.search_bug_index(bugs, *store.read_bug_index(spark, path), "The "))


RECENT_SQL = """dnr AS (
  SELECT repo, entry, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq DESC, entry DESC) AS rank FROM learned
    WHERE section = 'Do-Not-Repeat') WHERE rank <= 10)"""
BUG_LINES_SQL = """bug_lines AS (
  SELECT repo, rank, CASE WHEN length(l) > 140 THEN concat(substr(l, 1, 137), '...') ELSE l END AS line FROM (
    SELECT repo, concat(error_message, ' → ', fix) AS l, row_number() OVER (PARTITION BY repo ORDER BY "at" DESC, id DESC) AS rank
    FROM bugs) WHERE rank <= 5)"""


@query("k4_recent_do_not_repeat", with_(X.LEARNED_SQL, RECENT_SQL) + "SELECT * FROM dnr")
def k4(spark, sf):
    return K.recent_do_not_repeat(X.learned(spark, sf)).select(
        "repo", "entry", F.col("rank").cast("bigint").alias("rank"))


@query("k5_recent_bug_lines", with_(X.BUGS_SQL, BUG_LINES_SQL) + "SELECT * FROM bug_lines")
def k5(spark, sf):
    return K.recent_bug_lines(X.bugs(spark, sf)).select("repo", F.col("rank").cast("bigint").alias("rank"), "line")


def _digest_sql(budget: str, cost: str) -> str:
    price = lambda t: f"CASE WHEN coalesce({t}, '') = '' THEN 1000000000 ELSE {cost.format(t)} END"
    return f"""notes AS (SELECT repo, arg_max(body, "at") AS body FROM handoff GROUP BY repo), parts AS (
  SELECT r.repo, (SELECT {PHASE.format('body')} FROM notes n WHERE n.repo = r.repo) AS t1,
    (SELECT concat('## Do-Not-Repeat', chr(10), string_agg(concat('- ', entry), chr(10) ORDER BY rank)) FROM dnr d
      WHERE d.repo = r.repo HAVING count(*) > 0) AS t2,
    (SELECT concat('## Bugs with a known fix', chr(10),
        string_agg(line, chr(10) ORDER BY rank DESC)) FROM bug_lines b WHERE b.repo = r.repo HAVING count(*) > 0) AS t3,
    (SELECT concat('the index tracks ', CAST(total_files AS varchar),
        ' files with what they hold and how long they are.') FROM scan_state s
      WHERE s.repo = r.repo) AS t4
  FROM (SELECT repo FROM handoff UNION SELECT repo FROM learned UNION SELECT repo FROM bugs UNION SELECT repo FROM scan_state) r),
priced AS (SELECT *, {price('t1')} AS c1, {price('t2')} AS c2, {price('t3')} AS c3, {price('t4')} AS c4, {budget} AS b FROM parts),
s1 AS (SELECT *, CASE WHEN c1 <= b THEN c1 ELSE 0 END AS u1 FROM priced),
s2 AS (SELECT *, u1 + CASE WHEN u1 + c2 <= b THEN c2 ELSE 0 END AS u2 FROM s1),
s3 AS (SELECT *, u2 + CASE WHEN u2 + c3 <= b THEN c3 ELSE 0 END AS u3 FROM s2),
s4 AS (SELECT *, u3 + CASE WHEN u3 + c4 <= b THEN c4 ELSE 0 END AS u4 FROM s3), digests AS (
  SELECT repo, concat_ws(chr(10) || chr(10), CASE WHEN c1 <= b THEN t1 END, CASE WHEN u1 + c2 <= b THEN t2 END,
      CASE WHEN u2 + c3 <= b THEN t3 END, CASE WHEN u3 + c4 <= b THEN t4 END) AS digest, CAST(u4 AS BIGINT) AS tokens
  FROM s4)"""


_PROSE = "greatest(1, CAST(ceil(length({0}) / CAST(4.2 AS DOUBLE)) AS BIGINT))"
DIGEST_IN = with_(X.LEARNED_SQL, X.BUGS_SQL, X.SCAN_STATE_SQL, X.HEADS_SQL, STALE_SQL, RECENT_SQL, BUG_LINES_SQL)


def digest(spark, sf, budget, **kw):
    return G.session_digest(
        X.handoff(spark, sf), X.learned(spark, sf), X.bugs(spark, sf), X.scan_state_docs(spark, sf), budget, **kw)


@query("k6_session_digest", DIGEST_IN + ", " + _digest_sql("300", _PROSE) + "\nSELECT repo, digest, tokens FROM digests")
def k6(spark, sf):
    return digest(spark, sf, 300).select("repo", "digest", "tokens")


@query("u1_digest_estimator", DIGEST_IN + ", " + _digest_sql(
    "100 + 20 * CAST(regexp_extract(repo, '([0-9]+)$', 1) AS int)",
    "CASE WHEN length({0}) % 2 = 0 THEN length({0}) // 3 ELSE CAST(ceil(length({0}) / 4.0) AS BIGINT) END",
) + "\nSELECT repo, digest, tokens FROM digests")
def u1(spark, sf):
    """Budgets by repository, and an estimator that gives no price for some texts."""
    budgets = X.heads(spark, sf).select(
        "repo", F.expr("100 + 20 * cast(regexp_extract(repo, '([0-9]+)$', 1) as int)").alias("budget"))
    return digest(
        spark, sf, budgets, estimate=lambda t: F.when(F.length(t) % 2 == 0, F.floor(F.length(t) / 3))
    ).select("repo", "digest", "tokens")


@query("k7_digest_with_warning", DIGEST_IN + ", " + _digest_sql("300", _PROSE) + """
SELECT d.repo, CASE WHEN reason IS NOT NULL THEN concat('⚠ the index is out of date (', reason,
  '); a refresh is due.', chr(10), chr(10), digest) ELSE digest END AS digest
FROM digests d LEFT JOIN stale s ON d.repo = s.repo""")
def k7(spark, sf):
    return G.digest_with_warning(
        digest(spark, sf, 300), X.scan_state_docs(spark, sf), X.heads(spark, sf), 6, X.now())


@query("k8_housekeeping", with_(X.LEARNED_SQL, X.BUGS_SQL) + """, r AS (
  SELECT repo, (SELECT count(*) FROM learned l WHERE l.repo = r.repo) AS n,
         (SELECT count(*) FROM bugs b WHERE b.repo = r.repo) AS bugs
  FROM (SELECT DISTINCT source AS repo FROM documents UNION SELECT concat('new', source) FROM documents) r)
SELECT repo, concat_ws(chr(10), CASE WHEN n < 3 THEN concat('💡 only ', CAST(n AS varchar),
    CASE WHEN n = 1 THEN ' entry' ELSE ' entries' END,
    ' learned yet; add what this session shows.') END,
  CASE WHEN bugs = 0 THEN '📋 no bug is on record yet.' END) AS reminders
FROM r WHERE n < 3 OR bugs = 0""")
def k8(spark, sf):
    """Each repository, and for each one without any record."""
    repos = X.heads(spark, sf).select("repo")
    every = repos.unionByName(repos.select(F.concat(F.lit("new"), "repo").alias("repo")))
    return K.housekeeping(X.learned(spark, sf), X.bugs(spark, sf), every)


@query("k9_latest_handoff", with_(X.LEARNED_SQL) + f"""
SELECT repo, arg_max(body, "at") AS body, {X.sql_ts('max("at")')} AS "at" FROM handoff GROUP BY repo""")
def k9(spark, sf):
    return K.latest_handoff(X.handoff(spark, sf)).withColumn("at", X.show_ts("at"))


# --- merges -----------------------------------------------------------------------------------------------

# Target: the entries of even conversations, decorated. Source: all entries, so about half are known.
_TARGET_LINE = "concat('* [2024-01-01]  ', replace(replace(entry, ' ', '  '), 'e', 'E'))"


def learned_lines(spark, sf):
    rows = X.learned(spark, sf)
    source = rows.select(
        "repo", F.col("section").alias("heading"), F.col("seq").alias("line_no"),
        F.concat(F.lit("- "), F.col("entry")).alias("line"))
    target = rows.filter("(seq div 10) % 2 = 0").select(
        "repo", F.col("section").alias("heading"), F.col("seq").alias("line_no"), F.expr(_TARGET_LINE).alias("line"))
    return target, source


MERGE_LEARNED_SQL = f"""l_source AS (SELECT repo, section AS heading, seq AS line_no, concat('- ', entry) AS line FROM learned),
l_target AS (SELECT repo, section AS heading, {_TARGET_LINE} AS line FROM learned WHERE (seq // 10) % 2 = 0),
new_lines AS (SELECT * FROM l_source s WHERE trim(line, chr(10) || ' ') <> '' AND NOT EXISTS (
  SELECT 1 FROM l_target t WHERE t.repo = s.repo AND t.heading = s.heading
    AND {S.ENTRY_KEY_SQL.format('t.line')} = {S.ENTRY_KEY_SQL.format('s.line')}))"""


@query("m1_merge_learned", with_(X.LEARNED_SQL, MERGE_LEARNED_SQL) + "SELECT * FROM new_lines")
def m1(spark, sf):
    return M.merge_learned(*learned_lines(spark, sf))


@query("m1_merged_target", with_(X.LEARNED_SQL, MERGE_LEARNED_SQL) + """, old AS (
  SELECT repo, section AS heading, seq AS line_no, line FROM (SELECT *, """ + _TARGET_LINE + """ AS line FROM learned)
  WHERE (seq // 10) % 2 = 0), every AS (
  SELECT *, false AS added FROM old UNION ALL SELECT repo, heading, line_no, line, true FROM new_lines), sections AS (
  SELECT repo, heading, min(line_no) FILTER (NOT added) AS old_at, min(line_no) FILTER (added) AS new_at FROM every
  GROUP BY repo, heading)
SELECT e.repo, row_number() OVER (PARTITION BY e.repo ORDER BY old_at IS NULL, coalesce(old_at, new_at), added, line_no) AS n,
       e.heading, line, added FROM every e JOIN sections s ON e.repo = s.repo AND e.heading = s.heading""")
def m1_target(spark, sf):
    merged = M.merged_learned(*learned_lines(spark, sf))
    n = F.row_number().over(Window.partitionBy("repo").orderBy("place", "line_no")).cast("bigint")
    return merged.select("repo", n.alias("n"), "heading", "line", "added")


def table_rows(spark, sf):
    rows = PS.E.action_log(X.access_log(spark, sf)).select("repo", F.col("seq").alias("row_no"), "row")
    return rows.filter("row_no % 3 = 0").withColumn("row", F.concat(F.lit("  "), F.col("row"))), rows


MERGE_LOG_SQL = f"""{PS.LOG_ROWS_SQL}, new_rows AS (
  SELECT repo, seq AS row_no, row FROM log_rows s WHERE NOT EXISTS (
    SELECT 1 FROM log_rows t WHERE t.seq % 3 = 0 AND t.repo = s.repo AND t.row = s.row))"""


@query("m2_merge_log", with_(X.ACCESS_SQL, MERGE_LOG_SQL) + "SELECT * FROM new_rows")
def m2(spark, sf):
    return M.merge_log(*table_rows(spark, sf))


@query("m2_merged_target", with_(X.ACCESS_SQL, MERGE_LOG_SQL) + """
SELECT repo, seq AS row_no, concat('  ', row) AS row, false AS added FROM log_rows WHERE seq % 3 = 0 UNION ALL
SELECT repo, row_no, row, true FROM new_rows""")
def m2_target(spark, sf):
    return M.merged_log(*table_rows(spark, sf))


MERGE_BUGS_SQL = """keyed AS (
  SELECT *, lower(trim(error_message, chr(10) || chr(13) || chr(9) || ' ')) AS e FROM all_bugs), fresh_bugs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, e ORDER BY seq) AS rn FROM keyed
    WHERE error_message <> '' OR fix <> '') k WHERE rn = 1
    AND NOT EXISTS (SELECT 1 FROM keyed t WHERE t.doc_id % 2 = 0 AND t.repo = k.repo AND t.e = k.e)), added AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "at", error_message, fix, file) AS n FROM fresh_bugs)"""


@query("m3_merge_bugs", with_(X.BUGS_SQL, MERGE_BUGS_SQL) + """
SELECT repo, id, error_message, fix, file FROM bugs UNION ALL
SELECT a.repo, concat('bug-', CAST(n + (SELECT count(*) FROM bugs b WHERE b.repo = a.repo) AS varchar), '-',
  lower(to_base(epoch_ms("at"), 36))), error_message, fix, file FROM added a""")
def m3(spark, sf):
    source = X.all_bugs(spark, sf).drop("doc_id")
    return M.merge_bugs(X.bugs(spark, sf), source).select("repo", "id", "error_message", "fix", "file")


BUGS_REPORT_SQL = """bug_counts AS (
  SELECT repo, (SELECT count(*) FROM added a WHERE a.repo = k.repo) AS added, count(*) AS n FROM keyed k GROUP BY repo)"""


@query("m3_merge_bugs_report", with_(X.BUGS_SQL, MERGE_BUGS_SQL, BUGS_REPORT_SQL) + """
SELECT repo, added, n - added AS skipped FROM bug_counts""")
def m3_report(spark, sf):
    return M.merge_bugs_report(X.bugs(spark, sf), X.all_bugs(spark, sf).drop("doc_id"))


# Source: the last note of each repository, blank for some. Target: a template, a note of its own, or nothing.
_NOTE_NO = "cast(regexp_extract(repo, '([0-9]+)$', 1) as int)"
_OURS = (
    f"CASE {_NOTE_NO} % 4 WHEN 0 THEN concat('## 🚀 Next phase', chr(10), "
    "'_Describe the next phase here; the session digest picks up this section._') WHEN 1 THEN 'my own note' "
    "WHEN 2 THEN '  ' END"
)
_THEIRS = f"CASE WHEN {_NOTE_NO} % 5 = 3 THEN '  ' ELSE body END"
HANDOFFS_SQL = f"""notes_in AS (SELECT repo, arg_max(body, "at") AS body FROM handoff GROUP BY repo), theirs AS (
  SELECT repo, {_THEIRS} AS body FROM notes_in), ours AS (
  SELECT * FROM (SELECT repo, {_OURS} AS body FROM notes_in) WHERE body IS NOT NULL), merged AS (
  SELECT t.repo, CASE WHEN trim(t.body) = '' THEN 'missing'
    WHEN trim(coalesce(o.body, '')) = '' OR contains(o.body, '_Describe the next phase here') THEN 'imported'
    ELSE 'kept' END AS action, t.body AS theirs, o.body AS ours
  FROM theirs t LEFT JOIN ours o ON t.repo = o.repo)"""


def notes(spark, sf):
    last = K.latest_handoff(X.handoff(spark, sf)).select("repo", "body")
    theirs = last.withColumn("body", F.expr(_THEIRS))
    ours = last.withColumn("body", F.expr(_OURS)).filter("body IS NOT NULL")
    return ours, theirs


@query("m4_merge_handoff", with_(X.LEARNED_SQL, HANDOFFS_SQL) + """
SELECT repo, 'auto' AS policy, action, CASE WHEN action = 'imported' THEN theirs ELSE ours END AS body FROM merged UNION ALL
SELECT repo, 'overwrite', CASE WHEN trim(theirs) <> '' THEN 'overwritten' ELSE 'missing' END,
  CASE WHEN trim(theirs) <> '' THEN theirs ELSE ours END FROM merged UNION ALL
SELECT repo, 'keep', 'kept', ours FROM merged UNION ALL SELECT repo, 'skip', 'skipped', ours FROM merged""")
def m4(spark, sf):
    ours, theirs = notes(spark, sf)
    parts = [
        M.merge_handoff(ours, theirs, p).select("repo", F.lit(p).alias("policy"), "action", "body")
        for p in ("auto", "overwrite", "keep", "skip")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("m5_merge_report", with_(
    X.ACCESS_SQL, X.LEARNED_SQL, X.BUGS_SQL, MERGE_LEARNED_SQL, MERGE_LOG_SQL, MERGE_BUGS_SQL, BUGS_REPORT_SQL,
    HANDOFFS_SQL) + """, report AS (
  SELECT repo, 'learned' AS store, count(*) AS added, 0 AS skipped FROM new_lines GROUP BY repo UNION ALL
  SELECT repo, 'log', count(*), 0 FROM new_rows GROUP BY repo UNION ALL
  SELECT repo, 'bugs', added, n - added FROM bug_counts UNION ALL
  SELECT repo, 'handoff', CASE WHEN action = 'imported' THEN 1 ELSE 0 END, CASE WHEN action = 'imported' THEN 0 ELSE 1 END
  FROM merged)
SELECT *, added > 0 AS changed FROM report""")
def m5(spark, sf):
    counts = M.merge_bugs_report(X.bugs(spark, sf), X.all_bugs(spark, sf).drop("doc_id"))
    return M.merge_report(
        M.merge_learned(*learned_lines(spark, sf)), M.merge_log(*table_rows(spark, sf)), counts,
        M.merge_handoff(*notes(spark, sf)))
