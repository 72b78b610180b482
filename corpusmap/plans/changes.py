"""Queries for drift, refresh and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap import ScanOptions
from corpusmap.operators import drift as J
from corpusmap.operators import ignore as I
from corpusmap.operators.index import analyze_files, dir_rollup
from corpusmap.plans import inputs as X
from corpusmap.plans.registry import query, with_
from corpusmap.sources import store

ALL = ScanOptions(ignore=(), hidden=True, symbols=False)

DRIFT_SQL = f"""{X.LISTING_SQL}, drifted AS (
  SELECT coalesce(m.repo, l.repo) AS repo, coalesce(m.path, l.path) AS path,
    CASE WHEN m.path IS NULL THEN false WHEN l.path IS NULL THEN true ELSE m.size_bytes <> l.size_bytes END AS size_changed,
    CASE WHEN m.path IS NULL THEN false WHEN l.path IS NULL THEN true ELSE m.mtime <> l.mtime END AS mtime_changed,
    CASE WHEN m.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'missing' ELSE 'changed' END AS status
  FROM manifest m FULL JOIN listing l ON m.repo = l.repo AND m.path = l.path
  WHERE m.path IS NULL OR l.path IS NULL OR m.size_bytes <> l.size_bytes OR m.mtime <> l.mtime)"""


@query("j1_drift", with_(DRIFT_SQL) + "SELECT * FROM drifted")
def j1(spark, sf):
    return J.drift(X.manifest_docs(spark, sf), X.listing_docs(spark, sf))


@query("j2_drift_report", with_(DRIFT_SQL, X.SCAN_STATE_SQL, X.HEADS_SQL) + """, listed AS (
  SELECT repo, count(*) AS n, string_agg(note, chr(10) ORDER BY path) FILTER (rn <= 8) AS first_paths FROM (
    SELECT *, concat(path, CASE WHEN size_changed THEN ' (size)' ELSE '' END,
             CASE WHEN mtime_changed THEN ' (mtime)' ELSE '' END) AS note,
           row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM drifted) GROUP BY repo)
SELECT s.repo, coalesce(n, 0) AS drifted, coalesce(first_paths, '') AS first_paths,
       greatest(coalesce(n, 0) - 8, 0) AS more, coalesce(s.git_head <> h.git_head, false) AS head_moved,
       coalesce(n, 0) = 0 AND NOT coalesce(s.git_head <> h.git_head, false) AS fresh
FROM scan_state s LEFT JOIN heads h ON s.repo = h.repo LEFT JOIN listed l ON s.repo = l.repo""")
def j2(spark, sf):
    drifted = J.drift(X.manifest_docs(spark, sf), X.listing_docs(spark, sf))
    return J.drift_report(drifted, X.scan_state_docs(spark, sf), X.heads(spark, sf))


def old_index(spark, sf):
    return analyze_files(X.files_docs(spark, sf).filter("doc_id % 7 <> 0"), ALL)


_STATES_SQL = X.FILES_DOCS_SQL + """, state AS (
  SELECT repo, path, doc_id, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 13 <> 0 AS reused,
         CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END AS text
  FROM files_docs WHERE doc_id % 11 <> 0)"""
_MEASURES_SQL = """sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines,
  greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens"""


@query("j3_refresh_index", with_(_STATES_SQL) + f"SELECT repo, path, reused, {_MEASURES_SQL} FROM state")
def j3(spark, sf):
    fresh = J.refresh_index(old_index(spark, sf), X.listing_docs(spark, sf), X.changed_docs(spark, sf), ALL)
    return fresh.select("repo", "path", "reused", "sha256", "n_chars", "lines", "tokens")


def stored(spark, **tables):
    """The tables, stored in buckets by (repo, path) and read back."""
    root = X.work_dir(spark)
    for name, df in tables.items():
        store.write_bucketed(df, f"{root}/{name}")
    return [store.read_bucketed(spark, f"{root}/{name}") for name in tables]


@query("s3_stored_drift", with_(DRIFT_SQL) + "SELECT * FROM drifted")
def s3_drift(spark, sf):
    """Drift between two stored tables; their buckets meet where they lie."""
    return J.drift(*stored(spark, manifest=X.manifest_docs(spark, sf), listing=X.listing_docs(spark, sf)))


@query("s3_stored_refresh", with_(_STATES_SQL) + f"SELECT repo, path, reused, {_MEASURES_SQL} FROM state")
def s3_refresh(spark, sf):
    """A refresh between stored tables: neither index rows nor texts are shuffled."""
    index, listing, files = stored(
        spark, index=old_index(spark, sf), listing=X.listing_docs(spark, sf), files=X.changed_docs(spark, sf))
    return J.refresh_index(index, listing, files, ALL).select(
        "repo", "path", "reused", "sha256", "n_chars", "lines", "tokens")


# The rules of each repository stand in a `.gitignore` at its root; they differ by the number in its name.
_RULES = "concat('# rules', chr(10), '*.log', chr(10), 'd', substr(repo, 4), '/', chr(10), '!d', substr(repo, 4), '/m1/', chr(10))"


@query("j3_refresh_rules", with_(_STATES_SQL) + f"""
SELECT repo, path, reused, {_MEASURES_SQL} FROM state
WHERE path NOT LIKE '%.log' AND split_part(path, '/', 1) <> concat('d', substr(repo, 4))""")
def j3_rules(spark, sf):
    """Ignored files neither stay in the index nor come back with a refresh."""
    repos = X.heads(spark, sf).select("repo")
    rule_files = repos.select("repo", F.lit(".gitignore").alias("path"), F.expr(_RULES).alias("text"))
    rules = I.compile_rules(I.gitignore_lines(rule_files))
    old = I.apply_ignore(old_index(spark, sf), rules)
    fresh = J.refresh_index(old, X.listing_docs(spark, sf), X.changed_docs(spark, sf), ALL, rules)
    return fresh.select("repo", "path", "reused", "sha256", "n_chars", "lines", "tokens")


@query("j3_refresh_report", with_(_STATES_SQL) + """
SELECT repo, count_if(reused) AS reused, count_if(NOT reused) AS analyzed FROM state GROUP BY repo""")
def j3_report(spark, sf):
    return J.refresh_report(
        J.refresh_index(old_index(spark, sf), X.listing_docs(spark, sf), X.changed_docs(spark, sf), ALL))


def patched(spark, sf):
    changed = analyze_files(X.changed_docs(spark, sf).filter("doc_id % 5 = 0"), ALL)
    return J.patch_files(old_index(spark, sf), changed)


_PATCHED_SQL = X.FILES_DOCS_SQL + """, patched AS (
  SELECT repo, path, CASE WHEN doc_id % 5 = 0 AND doc_id % 11 <> 0 THEN concat(text, '!') ELSE text END AS text
  FROM files_docs WHERE doc_id % 7 <> 0)"""


@query("j4_patch_files", with_(_PATCHED_SQL) + f"SELECT repo, path, {_MEASURES_SQL} FROM patched")
def j4(spark, sf):
    return patched(spark, sf).select("repo", "path", "sha256", "n_chars", "lines", "tokens")


@query("j4_patched_rollup", with_(_PATCHED_SQL) + """, up AS (
  SELECT repo, unnest(['', split_part(path, '/', 1), concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))]) AS dir,
         length(text) - length(replace(text, chr(10), '')) AS lines, strlen(text) AS bytes FROM patched)
SELECT repo, dir, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes
FROM up GROUP BY repo, dir""")
def j4_rollup(spark, sf):
    return dir_rollup(patched(spark, sf))


STALE_SQL = f"""stale AS (
  SELECT s.repo, CASE WHEN s.git_head <> h.git_head THEN 'git HEAD moved since last scan'
    WHEN epoch(TIMESTAMP '{X.NOW}' - last_scanned) / 3600 > 6
      THEN concat('last scanned ', CAST(CAST(floor(epoch(TIMESTAMP '{X.NOW}' - last_scanned) / 3600) AS BIGINT) AS varchar), 'h ago')
    END AS reason
  FROM scan_state s LEFT JOIN heads h ON s.repo = h.repo)"""


@query("j5_staleness", with_(X.SCAN_STATE_SQL, X.HEADS_SQL, STALE_SQL) + "SELECT * FROM stale")
def j5(spark, sf):
    return J.staleness(X.scan_state_docs(spark, sf), X.heads(spark, sf), 6, X.now())


@query("j6_hint_freshness", with_(X.LISTING_SQL) + """
SELECT m.repo, m.path, coalesce(m.size_bytes = l.size_bytes AND m.mtime = l.mtime, false) AS fresh
FROM manifest m LEFT JOIN listing l ON m.repo = l.repo AND m.path = l.path""")
def j6(spark, sf):
    return J.hint_freshness(X.manifest_docs(spark, sf), X.listing_docs(spark, sf))
