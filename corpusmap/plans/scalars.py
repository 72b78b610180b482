"""Queries for the column functions and the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap.functions import describe as D
from corpusmap.functions import text as T
from corpusmap.functions.paths import LANG_BY_EXT, ancestors, base_name, detect_lang, parent_dir, to_posix
from corpusmap.operators import filters as P
from corpusmap.operators import ignore as I
from corpusmap.plans import inputs as X
from corpusmap.plans.registry import query, with_

DOCS = X.FILES_DOCS_SQL


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LANG_SQL = "CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) " + " ".join(
    f"WHEN '{e}' THEN '{t}'" for e, t in LANG_BY_EXT.items()) + " ELSE 'text' END"


@query("c1_detect_lang", with_(DOCS) + f"SELECT repo, path, {LANG_SQL} AS lang FROM files_docs")
def c1(spark, sf):
    return X.files_docs(spark, sf).select("repo", "path", detect_lang(F.col("path")).alias("lang"))


@query("c2_path_parts", with_(DOCS) + """
SELECT repo, path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS parent,
       concat(',', split_part(path, '/', 1), ',', split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS dirs,
       replace(path, '/', '_') AS flat
FROM files_docs""")
def c2(spark, sf):
    path = F.col("path")
    windows = F.replace(path, F.lit("/"), F.lit("\\"))
    return X.files_docs(spark, sf).select(
        "repo", "path", base_name(path).alias("base"), parent_dir(path).alias("parent"),
        F.array_join(ancestors(path), ",").alias("dirs"),
        F.replace(to_posix(windows), F.lit("/"), F.lit("_")).alias("flat"),
    )


@query("c3_line_count", with_(DOCS) + """
SELECT repo, path, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS lines FROM files_docs""")
def c3(spark, sf):
    return X.files_docs(spark, sf).select("repo", "path", T.line_count(F.col("text")).alias("lines"))


def _tokens_sql(n: str, k: str) -> str:
    return f"greatest(1, CAST(ceil({n} / CAST({k} AS DOUBLE)) AS BIGINT))"


@query("c4_estimate_tokens", with_(DOCS) + f"""
SELECT repo, path, {_tokens_sql('length(text)', '3.8')} AS code, {_tokens_sql('length(text)', '4.2')} AS prose,
       {_tokens_sql('length(text)', '4.0')} AS mixed FROM files_docs""")
def c4(spark, sf):
    return X.files_docs(spark, sf).select(
        "repo", "path", *[T.estimate_tokens(F.col("text"), k).alias(k) for k in ("code", "prose", "mixed")]
    )


def meaningful_sql(n: int, text: str = "text") -> str:
    """First line that is neither blank nor noise, cut to n characters."""
    starts = " OR ".join(
        f"starts_with(lower(trim(l, chr(9) || chr(13) || ' ')), '{p.replace(chr(39), chr(39) * 2)}')"
        for p in T.COMMENT_PREFIXES + T.IMPORT_PREFIXES)
    lines = f"string_split({text}, chr(10))"
    trimmed = "trim(l, chr(9) || chr(13) || ' ')"
    found = f"coalesce(list_filter({lines}, lambda l: {trimmed} <> '' AND NOT ({starts}))[1], '')"
    clean = f"trim({found}, chr(9) || chr(13) || ' ')"
    return f"CASE WHEN length({clean}) > {n} THEN concat(substr({clean}, 1, {n}), '…') ELSE {clean} END"


@query("c5_first_meaningful_line", with_(DOCS) + f"SELECT repo, path, {meaningful_sql(40)} AS line FROM files_docs")
def c5(spark, sf):
    return X.files_docs(spark, sf).select("repo", "path", T.first_meaningful_line(F.col("text"), 40).alias("line"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


EXPORTS_SQL = f"""CASE WHEN len(ex) > 0 THEN concat('Exports ', array_to_string(ex[1:5], ', '),
  CASE WHEN len(ex) > 5 THEN concat(' +', CAST(len(ex) - 5 AS varchar), ' more') ELSE '' END,
  CASE WHEN dx <> '' THEN concat(', default ', dx) ELSE '' END) END"""
EXPORTS_IN = f"""SELECT *, regexp_extract_all(text, {_q(D.EXPORT)}, 1) AS ex,
  regexp_extract(text, {_q(D.DEFAULT_EXPORT)}, 1) AS dx"""


@query("c6_describe_exports", with_(X.FILES_WEB_SQL) + f"""
SELECT repo, path, {EXPORTS_SQL} AS about FROM ({EXPORTS_IN} FROM files_web)""")
def c6(spark, sf):
    return X.files_web(spark, sf).select("repo", "path", D.describe_exports(F.col("text")).alias("about"))


@query("c7_describe_routes", with_(X.FILES_WEB_SQL) + f""", hits AS (
  SELECT repo, path, regexp_extract_all(text, {_q(D.ROUTE)}, 1) AS verbs,
         regexp_extract_all(text, {_q(D.ROUTE)}, 2) AS targets FROM files_web), one AS (
  SELECT repo, path, generate_subscripts(verbs, 1) AS i, concat(upper(unnest(verbs)), ' ', unnest(targets)) AS r
  FROM hits), once AS (SELECT repo, path, r, min(i) AS i FROM one GROUP BY repo, path, r), told AS (
  SELECT repo, path, list(r ORDER BY i) AS rs FROM once GROUP BY repo, path)
SELECT h.repo, h.path, CASE WHEN rs IS NOT NULL THEN concat('Defines ', array_to_string(rs[1:4], ', '),
  CASE WHEN len(rs) > 4 THEN concat(' +', CAST(len(rs) - 4 AS varchar), ' more') ELSE '' END) END AS about
FROM hits h LEFT JOIN told t ON h.repo = t.repo AND h.path = t.path""")
def c7(spark, sf):
    return X.files_web(spark, sf).select("repo", "path", D.describe_routes(F.col("text")).alias("about"))


@query("c8_describe_schema_or_class", with_(X.FILES_WEB_SQL) + """
SELECT repo, path, CASE WHEN regexp_matches(text, 'z\\.object\\(')
    THEN concat('Defines a zod schema in ', regexp_extract(path, '[^/]*$'))
  WHEN regexp_matches(text, 'class\\s+\\w+') THEN concat('Class ', regexp_extract(text, 'class\\s+(\\w+)', 1))
  END AS about FROM files_web""")
def c8(spark, sf):
    return X.files_web(spark, sf).select(
        "repo", "path", D.describe_schema_or_class(F.col("text"), base_name(F.col("path"))).alias("about"))


def _count_sql(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


PY_SQL = f"""CASE WHEN doc <> '' THEN split_part(doc, chr(10), 1) ELSE nullif(concat_ws(', ',
  CASE WHEN nc > 0 THEN concat(CAST(nc AS varchar), CASE WHEN nc > 1 THEN ' classes' ELSE ' class' END) END,
  CASE WHEN nd > 0 THEN concat(CAST(nd AS varchar), ' functions') END), '') END"""
PY_IN = f"""SELECT *, trim(regexp_extract(text, {_q(D.PY_DOCSTRING)}, 1), chr(10) || chr(13) || chr(9) || ' ') AS doc,
  {_count_sql(D.PY_CLASS)} AS nc, {_count_sql(D.PY_DEF)} AS nd"""
_DOCSTRING = """CASE WHEN o_orderkey % 2 = 0 THEN concat('\"\"\" About ', path, chr(10), 'more \"\"\"', chr(10), text)
  ELSE text END"""


@query("c9_describe_python", with_(X.FILES_CODE_SQL) + f""", py AS (
  SELECT repo, path, {_DOCSTRING} AS text FROM files_code WHERE path LIKE '%.py')
SELECT repo, path, {PY_SQL} AS about FROM ({PY_IN} FROM py)""")
def c9(spark, sf):
    py = X.files_code(spark, sf).filter(F.col("path").endswith(".py")).withColumn("text", F.expr(_DOCSTRING))
    return py.select("repo", "path", D.describe_python(F.col("text")).alias("about"))


GO_SQL = """nullif(concat_ws(' · ', CASE WHEN pk <> '' THEN concat('package ', pk) END,
  CASE WHEN nh > 0 THEN concat(CAST(nh AS varchar), CASE WHEN nh > 1 THEN ' HTTP handlers' ELSE ' HTTP handler' END)
  END, CASE WHEN nf > 0 THEN concat(CAST(nf AS varchar), ' funcs') END), '')"""
GO_IN = f"""SELECT *, regexp_extract(text, {_q(D.GO_PACKAGE)}, 1) AS pk, {_count_sql(D.GO_HANDLER)} AS nh,
  {_count_sql(D.GO_FUNC)} AS nf"""
_HANDLERS = "concat(text, repeat(concat('func H(w http.ResponseWriter) {}', chr(10)), CAST(o_orderkey % 3 AS int)))"


@query("c10_describe_go", with_(X.FILES_CODE_SQL) + f""", go AS (
  SELECT repo, path, {_HANDLERS} AS text FROM files_code WHERE path LIKE '%.go')
SELECT repo, path, {GO_SQL} AS about FROM ({GO_IN} FROM go)""")
def c10(spark, sf):
    go = X.files_code(spark, sf).filter(F.col("path").endswith(".go")).withColumn("text", F.expr(_HANDLERS))
    return go.select("repo", "path", D.describe_go(F.col("text")).alias("about"))


RUST_SQL = """nullif(concat_ws(', ', CASE WHEN np > 0 THEN concat(CAST(np AS varchar), ' public items') END,
  CASE WHEN nm > 0 THEN concat(CAST(nm AS varchar), ' modules') END), '')"""
RUST_IN = f"SELECT *, {_count_sql(D.RS_PUBLIC)} AS np, {_count_sql(D.RS_MOD)} AS nm"


@query("c11_describe_rust", with_(X.FILES_RUST_SQL) + f"""
SELECT repo, path, {RUST_SQL} AS about FROM ({RUST_IN} FROM files_rust)""")
def c11(spark, sf):
    return X.files_rust(spark, sf).select("repo", "path", D.describe_rust(F.col("text")).alias("about"))


JSON_SQL = """CASE WHEN json_valid(text) THEN coalesce(
  CASE WHEN json_type(text, '$.description') = 'VARCHAR' THEN json_extract_string(text, '$.description') END,
  CASE WHEN json_type(text, '$.name') = 'VARCHAR' THEN json_extract_string(text, '$.name') END) END"""


@query("c12_describe_json", with_(X.FILES_JSON_SQL) + f"SELECT repo, path, {JSON_SQL} AS about FROM files_json")
def c12(spark, sf):
    return X.files_json(spark, sf).select("repo", "path", D.describe_json(F.col("text")).alias("about"))


# The descriptions of all languages, put together as the dispatch does, for the files derived from orders.
DESCRIBE_CODE_SQL = f"""
SELECT repo, path, CASE WHEN length(a) > 140 THEN concat(substr(a, 1, 139), '…') ELSE a END AS about FROM (
  SELECT repo, path, coalesce(CASE WHEN path LIKE '%.ts' THEN {EXPORTS_SQL} WHEN path LIKE '%.py' THEN {PY_SQL}
    ELSE {GO_SQL} END, {meaningful_sql(140)}) AS a
  FROM ({EXPORTS_IN} FROM ({PY_IN} FROM ({GO_IN} FROM files_code))))"""


@query("c13_describe", with_(X.FILES_CODE_SQL) + DESCRIBE_CODE_SQL)
def c13(spark, sf):
    return X.files_code(spark, sf).select("repo", "path", D.describe(F.col("text"), F.col("path")).alias("about"))


@query("c14_ellipsize", with_(DOCS) + """
SELECT repo, path, CASE WHEN length(text) > 50 THEN concat(substr(text, 1, 49), '…') ELSE text END AS short,
       CASE WHEN length(text) > 140 THEN concat(substr(text, 1, 137), '...') ELSE text END AS line FROM files_docs""")
def c14(spark, sf):
    text = F.col("text")
    return X.files_docs(spark, sf).select(
        "repo", "path", T.ellipsize(text, 50).alias("short"), T.ellipsize(text, 140, "...").alias("line"))


@query("c15_preview", with_(DOCS) + """
SELECT repo, path, substr(text, 1, 1000) AS head, length(text) > 1000 AS cut, substr(text, 1, 256) AS least
FROM files_docs""")
def c15(spark, sf):
    text = F.col("text")
    return X.files_docs(spark, sf).select(
        "repo", "path", T.preview(text, 1000).alias("head"), T.preview_truncated(text, 1000).alias("cut"),
        T.preview(text, 10).alias("least"))


@query("c16_content_hash", with_(DOCS) + "SELECT repo, path, sha256(text) AS sha256 FROM files_docs")
def c16(spark, sf):
    return X.files_docs(spark, sf).select("repo", "path", T.content_hash(F.col("text")).alias("sha256"))


ENTRY_KEY_SQL = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}, chr(9) || chr(10) || chr(13) || ' '),
  '^[-*]\s+', ''), '^\[\d{{4}}-\d{{2}}-\d{{2}}\]\s*', ''), '\s+', ' ', 'g')))"""
_ENTRY = "concat('- [2024-01-0', cast(turn % 9 as string), ']  ', text, '  ')"


@query("c17_normalize_entry", f"""
SELECT conv_id, turn, {ENTRY_KEY_SQL.format('entry')} AS entry_key FROM (
  SELECT *, {_ENTRY.replace('as string', 'as varchar')} AS entry FROM conversations)""")
def c17(spark, sf):
    return X.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.normalize_entry(F.expr(_ENTRY)).alias("entry_key"))


@query("c18_usage_total", with_(X.USAGE_SQL) + "SELECT session_id, seq, measured_tokens AS total FROM measured")
def c18(spark, sf):
    parts = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "meter_tokens")
    return X.usage_events(spark, sf).select(
        "session_id", "seq", T.usage_total(*[F.col(c) for c in parts]).alias("total"))


@query("c19_bug_key", with_(X.BUGS_SQL) + """
SELECT seq, concat(lower(trim(error_message, chr(10) || ' ')), '|', lower(trim(file))) AS bug_key FROM all_bugs""")
def c19(spark, sf):
    return X.all_bugs(spark, sf).select("seq", T.bug_key(F.col("error_message"), F.col("file")).alias("bug_key"))


# --- filters: paths get parts that the filters look for ------------------------------------------------------

_ODD_PATH = (
    "CASE doc_id % 11 WHEN 0 THEN concat('.git/', path) WHEN 1 THEN concat('.cache/', path) "
    "WHEN 2 THEN concat('a/.env', CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.local' ELSE '.Example' END) "
    "WHEN 3 THEN concat(path, '.PEM') WHEN 4 THEN concat('x/', CASE doc_id % 2 WHEN 0 THEN 'id_rsa' ELSE "
    "'ID_RSA' END) WHEN 5 THEN concat('/', path) WHEN 6 THEN concat('a/../', path) "
    "WHEN 7 THEN concat('C:', chr(92), path) WHEN 8 THEN concat('build/', path) ELSE path END"
)
ODD_SQL = DOCS + f""", odd AS (SELECT repo, doc_id, {_ODD_PATH} AS path, text, size_bytes, mtime FROM files_docs)"""


def odd_docs(spark, sf):
    return X.files_docs(spark, sf).withColumn("path", F.expr(_ODD_PATH))


SENSITIVE_SQL = f"""(regexp_extract(path, '[^/]*$') IN ({_in(P.SENSITIVE_BASENAMES)})
  OR (regexp_matches(regexp_extract(path, '[^/]*$'), {_q(P.ENV_FILE)})
      AND lower(regexp_extract(regexp_extract(path, '[^/]*$'), {_q(P.ENV_FILE)}, 1))
          NOT IN ({_in('.' + s for s in P.ENV_TEMPLATE_SUFFIXES)}))
  OR lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.[^.]*$')) IN ({_in(P.SENSITIVE_EXTENSIONS)}))"""
HIDDEN_SQL = "regexp_matches(path, '(^|/)\\.')"
VALID_SQL = """NOT (starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:[\\\\/]')
  OR regexp_matches(path, '(^|[\\\\/])\\.\\.($|[\\\\/])'))"""


@query("p1_drop_hidden", with_(ODD_SQL) + f"""
SELECT doc_id, path, NOT {HIDDEN_SQL} AS plain FROM odd WHERE NOT regexp_matches(path, '(^|/)\\.git(/|$)')""")
def p1(spark, sf):
    seen = P.drop_hidden(odd_docs(spark, sf), hidden=True).select("doc_id", "path")
    plain = P.drop_hidden(seen).select("doc_id", F.lit(True).alias("plain"))
    return seen.join(plain, "doc_id", "left").select(
        "doc_id", "path", F.coalesce("plain", F.lit(False)).alias("plain"))


# Rules of every repository: a few that all have, and some of its own.
_RULES = (
    "'# comment'", "''", "'*.log'", "concat('!f', {n}, '.log')", "concat('d', {n} % 7, '/')", "'/d1/m1/*.txt'",
    "'**/m2/**'", "concat('!/d', {n} % 7, '/')", "concat('m', {n} % 3, '/  ')", "concat('!**/m', {n} % 3, '/f1?.md')",
)


def _rule_rows(cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT repo, CASE WHEN {i} < 5 THEN 'gitignore' ELSE 'extra' END AS source, {i} AS rule_no, "
        + r.replace("{n} % 7", f"cast(n % 7 as {cast})").replace("{n} % 3", f"cast(n % 3 as {cast})")
        .replace("{n}", f"cast(n as {cast})") + " AS line FROM numbered"
        for i, r in enumerate(_RULES))


RULE_LINES_SQL = f"""numbered AS (
  SELECT DISTINCT source AS repo, CAST(regexp_extract(source, '([0-9]+)$', 1) AS int) AS n FROM documents),
rule_lines AS ({_rule_rows('varchar')}), parsed AS (
  SELECT repo, source, rule_no, starts_with(l, '!') AS negate,
         CASE WHEN starts_with(l, '!') THEN substr(l, 2) ELSE l END AS b
  FROM (SELECT *, regexp_replace(line, '[ \\t]+$', '') AS l FROM rule_lines) WHERE l <> '' AND NOT starts_with(l, '#')),
rules AS (
  SELECT repo, source, rule_no, negate, b LIKE '%/' AS dir_only,
         regexp_replace(b, '/$', '') LIKE '%/%' AS anchored,
         replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '/$', ''), '^/', ''), '.', '\\.'),
           '**', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '.*') AS glob
  FROM parsed)"""


def rule_lines(spark, sf):
    numbered = X.table(spark, sf, "documents").select(F.col("source").alias("repo")).distinct().withColumn(
        "n", F.expr("cast(regexp_extract(repo, '([0-9]+)$', 1) as int)"))
    rows = F.array(*[
        F.struct(
            F.lit("gitignore" if i < 5 else "extra").alias("source"), F.lit(i).alias("rule_no"),
            F.expr(r.replace("{n} % 7", "cast(n % 7 as string)").replace("{n} % 3", "cast(n % 3 as string)")
                   .replace("{n}", "cast(n as string)")).alias("line"))
        for i, r in enumerate(_RULES)
    ])
    return numbered.select("repo", F.explode(rows).alias("r")).select("repo", "r.*")


@query("p2_compile_rules", with_(RULE_LINES_SQL) + """
SELECT repo, source, CAST(rule_no AS BIGINT) AS rule_no, negate, dir_only, anchored FROM rules""")
def p2(spark, sf):
    return I.compile_rules(rule_lines(spark, sf)).select(
        "repo", "source", F.col("rule_no").cast("bigint").alias("rule_no"), "negate", "dir_only", "anchored")


@query("p3_apply_ignore", with_(DOCS, RULE_LINES_SQL) + """, cands AS (
  SELECT repo, path, path AS cand, false AS is_dir, doc_id FROM files_docs UNION ALL
  SELECT repo, path, split_part(path, '/', 1), true, doc_id FROM files_docs UNION ALL
  SELECT repo, path, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)), true, doc_id FROM files_docs),
subjects AS (
  SELECT c.repo, c.doc_id, c.cand, r.source, r.rule_no, r.negate,
    CASE WHEN NOT r.dir_only
      THEN regexp_full_match(CASE WHEN r.anchored THEN c.cand ELSE regexp_extract(c.cand, '[^/]*$') END, r.glob)
      ELSE (c.is_dir AND regexp_full_match(CASE WHEN r.anchored THEN c.cand ELSE regexp_extract(c.cand, '[^/]*$') END, r.glob))
        OR (c.cand LIKE '%/%' AND regexp_full_match(split_part(c.cand, '/', 1), r.glob))
        OR (c.cand LIKE '%/%/%' AND regexp_full_match(
             CASE WHEN r.anchored THEN regexp_replace(c.cand, '/[^/]*$', '') ELSE split_part(c.cand, '/', 2) END, r.glob))
      END AS hit
  FROM cands c JOIN rules r ON c.repo = r.repo),
verdicts AS (
  SELECT repo, doc_id, cand, source, arg_max(NOT negate, rule_no) AS ignored FROM subjects WHERE hit
  GROUP BY repo, doc_id, cand, source)
SELECT repo, path FROM files_docs f
WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.repo = f.repo AND v.doc_id = f.doc_id AND v.ignored)""")
def p3(spark, sf):
    rules = I.compile_rules(rule_lines(spark, sf))
    return I.apply_ignore(X.files_docs(spark, sf).select("repo", "path"), rules)


@query("p3_rules_by_path", with_(DOCS) + """
SELECT repo, path FROM files_docs WHERE doc_id % 10 = 0 OR (doc_id % 5 <> 0 AND path NOT LIKE '%.log')""")
def p3_by_path(spark, sf):
    """As many rules as a fifth of the files, in every repository: every fifth path is ignored, every tenth taken back."""
    docs = X.files_docs(spark, sf)
    at = F.col("doc_id") * 2
    named = docs.filter("doc_id % 5 = 0").select("repo", at.alias("rule_no"), F.concat(F.lit("/"), "path").alias("line"))
    back = docs.filter("doc_id % 10 = 0").select("repo", (at + 1).alias("rule_no"), F.concat(F.lit("!/"), "path").alias("line"))
    logs = docs.select("repo", F.lit(-1).cast("bigint").alias("rule_no"), F.lit("*.log").alias("line")).distinct()
    lines = named.unionByName(back).unionByName(logs).withColumn("source", F.lit("gitignore"))
    return I.apply_ignore(docs.select("repo", "path"), I.compile_rules(lines))


@query("p4_drop_sensitive", with_(ODD_SQL) + f"SELECT doc_id, path FROM odd WHERE NOT {SENSITIVE_SQL}")
def p4(spark, sf):
    return P.drop_sensitive(odd_docs(spark, sf)).select("doc_id", "path")


_SKIP_TEXT = (
    "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN concat(substr(text, 1, 5), chr(0), text) "
    "ELSE text END"
)


@query("p5_classify_skipped", with_(DOCS) + """
SELECT repo, path, CASE WHEN size_bytes > 4000 THEN '[file too large]' WHEN doc_id % 9 = 0 THEN '[unreadable]'
  WHEN doc_id % 9 = 1 THEN '[binary]' END AS reason,
  size_bytes > 4000 OR doc_id % 9 <= 1 AS skipped FROM files_docs""")
def p5(spark, sf):
    files = X.files_docs(spark, sf).withColumn("text", F.expr(_SKIP_TEXT))
    return P.classify_skipped(files, 4000).select("repo", "path", F.col("skip_reason").alias("reason"), "skipped")


@query("p6_cap_files", with_(DOCS) + """, ranked AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn, count(*) OVER (PARTITION BY repo) AS n
  FROM files_docs)
SELECT repo, path, greatest(n - 20, 0) AS skipped_files, n > 20 AS truncated FROM ranked WHERE rn <= 20""")
def p6(spark, sf):
    docs = X.files_docs(spark, sf).select("repo", "path")
    return P.cap_files(docs, 20).join(P.cap_report(docs, 20), "repo").select(
        "repo", "path", "skipped_files", "truncated")


@query("p7_valid_paths", with_(ODD_SQL) + f"SELECT doc_id, path FROM odd WHERE {VALID_SQL}")
def p7(spark, sf):
    return P.valid_paths(odd_docs(spark, sf)).select("doc_id", "path")


_EVENT_PATH = (
    "CASE seq % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a/.env' WHEN 3 THEN concat('.corpusmap', chr(92), 'x') "
    "ELSE path END"
)


@query("p8_loggable_events", with_(X.ACCESS_SQL) + """
SELECT session_id, seq, path FROM access_log WHERE seq % 10 > 3""")
def p8(spark, sf):
    odd = X.access_log(spark, sf).withColumn("path", F.expr(_EVENT_PATH))
    return P.loggable_events(odd).select("session_id", "seq", "path")
