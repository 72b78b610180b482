"""Queries for symbols, the index, rendered texts, and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap import ScanOptions
from corpusmap.operators import audit as Q
from corpusmap.operators import index as A
from corpusmap.operators import render as R
from corpusmap.operators import symbols as Y
from corpusmap.plans import inputs as X
from corpusmap.plans import scalars as S
from corpusmap.plans.registry import query, with_
from corpusmap.sources import files as SF
from corpusmap.sources import store

CODE, DOCS = X.FILES_CODE_SQL, X.FILES_DOCS_SQL
ALL = ScanOptions(ignore=(), hidden=True)

# --- symbols --------------------------------------------------------------------------------------------

_SCRIPT = Y.SYMBOL_PATTERNS["ts"]
_PY = Y.SYMBOL_PATTERNS["py"]
_GO = Y.SYMBOL_PATTERNS["go"]


def _passes_sql() -> str:
    parts = []
    for ext, patterns in ((".ts", _SCRIPT), (".py", _PY), (".go", _GO)):
        for n, p in enumerate(patterns, 1):
            q = S._q(p)
            name = (f"concat(regexp_extract(line, {q}, 1), regexp_extract(line, {q}, 2))" if p is _SCRIPT[0]
                    else f"regexp_extract(line, {q}, 1)")
            parts.append(
                f"SELECT repo, path, {n} AS pass, line_no, {name} AS name FROM code_lines WHERE path LIKE '%{ext}'")
    return " UNION ALL ".join(parts)


LINES_SQL = """code_lines AS (
  SELECT repo, path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT repo, path, string_split(text, chr(10)) AS ls FROM files_code))"""
HITS_SQL = f"""{LINES_SQL}, hits AS ({_passes_sql()}), firsts AS (
  SELECT repo, path, name, min(pass * 1000000 + line_no) AS k FROM hits WHERE name <> '' GROUP BY repo, path, name),
symbols_raw AS (
  SELECT repo, path, name, k % 1000000 AS line, k // 1000000 AS pass,
         row_number() OVER (PARTITION BY repo, path ORDER BY k) AS pos FROM firsts)"""


@query("y1_extract_symbols", with_(CODE, HITS_SQL) + """
SELECT repo, path, name, CAST(line AS BIGINT) AS line, CAST(pass AS BIGINT) AS pass, pos
FROM symbols_raw""")
def y1(spark, sf):
    found = Y.extract_symbols(X.files_code(spark, sf))
    return found.select("repo", "path", "name", *[F.col(c).cast("bigint").alias(c) for c in ("line", "pass", "pos")])


SPANS_SQL = f"""{HITS_SQL}, file_lines AS (SELECT repo, path, max(line_no) - 1 AS total FROM code_lines GROUP BY repo, path),
spans AS (
  SELECT s.repo, s.path, name, line, greatest(line, coalesce(
    lead(line) OVER (PARTITION BY s.repo, s.path ORDER BY line) - 1, total)) AS end_line
  FROM symbols_raw s JOIN file_lines f ON s.repo = f.repo AND s.path = f.path),
symbols AS (
  SELECT s.repo, s.path, s.name, CAST(s.line AS BIGINT) AS line, CAST(s.end_line AS BIGINT) AS end_line,
         greatest(1, CAST(ceil((sum(length(l.line) + 1) - 1) / 4.0) AS BIGINT)) AS tokens
  FROM spans s JOIN code_lines l ON s.repo = l.repo AND s.path = l.path AND l.line_no BETWEEN s.line AND s.end_line
  GROUP BY s.repo, s.path, s.name, s.line, s.end_line)"""


def _spans_out(df):
    return df.select(
        "repo", "path", "name", F.col("line").cast("bigint").alias("line"),
        F.col("end_line").cast("bigint").alias("end_line"), "tokens")


@query("y2_symbol_spans", with_(CODE, SPANS_SQL) + "SELECT * FROM symbols")
def y2(spark, sf):
    return _spans_out(Y.symbol_spans(X.files_code(spark, sf)))


def _tops_sql() -> str:
    names = " ".join(
        f"WHEN path LIKE '%{e}' THEN regexp_extract(line, {S._q(Y.SPAN_PATTERNS[t])}, 1)"
        for e, t in ((".ts", "ts"), (".py", "py"), (".go", "go")))
    return f"""solid AS (
  SELECT repo, path, line_no, line, lag(line_no) OVER (PARTITION BY repo, path ORDER BY line_no) AS prev,
         max(line_no) OVER (PARTITION BY repo, path) AS last_no
  FROM code_lines WHERE regexp_matches(line, '\\S')), margin AS (
  SELECT *, lead(line_no) OVER w AS next_no, lead(line) OVER w AS next_line, lead(prev) OVER w AS next_prev
  FROM solid WHERE regexp_matches(line, '^\\S') WINDOW w AS (PARTITION BY repo, path ORDER BY line_no)), named AS (
  SELECT repo, path, CASE {names} END AS name, line_no, line, CASE WHEN next_no IS NULL THEN last_no
    WHEN regexp_matches(next_line, '^[}})\\]]') THEN next_no ELSE greatest(line_no, next_prev) END AS end_no FROM margin),
tops AS (
  SELECT n.repo, n.path, n.name, n.line_no AS line, n.end_no AS end_line, greatest(1, CAST(ceil((
      length(string_agg(l.line, chr(10) ORDER BY l.line_no))
      - length(regexp_extract(n.line, {S._q(Y.EXPORT_PREFIX)}))) / 4.0) AS BIGINT)) AS tokens
  FROM named n JOIN code_lines l ON n.repo = l.repo AND n.path = l.path AND l.line_no BETWEEN n.line_no AND n.end_no
  WHERE n.name <> '' GROUP BY n.repo, n.path, n.name, n.line_no, n.end_no, n.line)"""


@query("y3_toplevel_spans", with_(CODE, LINES_SQL, _tops_sql()) + """
SELECT repo, path, name, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, tokens FROM tops""")
def y3(spark, sf):
    return _spans_out(Y.toplevel_spans(X.files_code(spark, sf)))


def _hard_sql() -> str:
    """The spans written by hand: for each kind where both declarations begin and end, with n lines in the first."""
    lines = {"java": ("B", 2, "4 + n", "S", "7 + n", "9 + n"), "ts": ("f", 1, "4 + n", "c", "5 + n", "5 + n"),
             "py": ("f", 4, "7 + n", "K", "10 + n", "11 + n"), "go": ("F", 2, "6 + n", "T", "7 + n", "8 + n")}
    rows = []
    for i, (kind, _, first, _, second, _) in enumerate(X.HARD_CODE):
        a, a_line, a_end, b, b_line, b_end = lines[kind]
        for name, x, at, end, text, off in ((a, "o_orderkey % 97", a_line, a_end, first, 7 if kind == "ts" else 0),
                                            (b, "o_custkey % 13", b_line, b_end, second, 0)):
            text = text.replace("as string", "as varchar").replace("as int", "as bigint")
            rows.append(f"""SELECT repo, path, concat('{name}', CAST({x} AS varchar)) AS name, CAST({at} AS BIGINT) AS line,
              CAST({end} AS BIGINT) AS end_line, CAST(ceil((length({text}) - {off}) / 4.0) AS BIGINT) AS tokens
              FROM hard WHERE o_orderkey % 4 = {i}""")
    return " UNION ALL ".join(rows)


@query("y3_spans_of_hard_code", with_(X.FILES_HARD_SQL) + f""", hard AS (
  SELECT f.repo, f.path, o.o_orderkey, o.o_custkey, o.o_orderkey % 6 AS n
  FROM files_hard f JOIN orders o ON f.o_orderkey = o.o_orderkey)
{_hard_sql()}""")
def y3_hard(spark, sf):
    return _spans_out(Y.toplevel_spans(X.files_hard(spark, sf)))


@query("y4_route_symbol_backend", with_(CODE, SPANS_SQL, _tops_sql()) + """
SELECT repo, path, name, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, tokens FROM tops UNION ALL
SELECT * FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM tops t WHERE t.repo = s.repo AND t.path = s.path)""")
def y4(spark, sf):
    return _spans_out(Y.route_symbol_backend(X.files_code(spark, sf)))


@query("y5_top_symbols", with_(CODE, SPANS_SQL) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY tokens DESC, line, name) AS rank
  FROM symbols) WHERE rank <= 2""")
def y5(spark, sf):
    top = Y.top_symbols(Y.with_symbol_spans(X.files_code(spark, sf)), 2)
    return top.select("repo", "path", "name", *[F.col(c).cast("bigint").alias(c) for c in ("line", "end_line", "tokens", "rank")])


@query("y6_symbol_lists", with_(CODE, SPANS_SQL) + """
SELECT repo, path, array_to_string(list(name ORDER BY line, name), ',') AS names FROM symbols
GROUP BY repo, path""")
def y6(spark, sf):
    lists = Y.symbol_lists(Y.with_symbol_spans(X.files_code(spark, sf)))
    return lists.select("repo", "path", F.array_join("symbols", ",").alias("names"))


# Patterns written out, as a user would add them.
_USER_RULES = (
    (".py", 1, r"^import\s+(\w+)"), (".go", 1, r"^type\s+(\w+)"), (".go", 2, r"^(package|func)\b"),
    (".ts", 1, r"^class\s+(\w+)"),
)


def _user_rules_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT repo, path, {n} AS pass, line_no, regexp_extract(line, '{p}', 1) AS name FROM code_lines "
        f"WHERE path LIKE '%{ext}'" for ext, n, p in _USER_RULES)


@query("u2_symbol_rules", with_(CODE, LINES_SQL) + f""", hits AS ({_user_rules_sql()}), firsts AS (
  SELECT repo, path, name, min(pass * 1000000 + line_no) AS k FROM hits WHERE name <> '' GROUP BY repo, path, name)
SELECT repo, path, name, k % 1000000 AS line, k // 1000000 AS pass,
       row_number() OVER (PARTITION BY repo, path ORDER BY k) AS pos FROM firsts""")
def u2(spark, sf):
    rules = spark.createDataFrame(_USER_RULES, 'extension string, pass int, pattern string')
    found = Y.extract_by_rules(X.files_code(spark, sf), rules)
    return found.select("repo", "path", "name", *[F.col(c).cast("bigint").alias(c) for c in ("line", "pass", "pos")])


@query("u2_symbol_index", with_(CODE, LINES_SQL) + f""", hits AS ({_user_rules_sql()}), firsts AS (
  SELECT repo, path, name, min(pass * 1000000 + line_no) % 1000000 AS line FROM hits WHERE name <> '' GROUP BY repo, path, name)
SELECT h.repo, h.path, name, line, greatest(line, coalesce(lead(line) OVER (PARTITION BY h.repo, h.path ORDER BY line) - 1,
         CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT))) AS end_line
FROM firsts h JOIN files_code f ON h.repo = f.repo AND h.path = f.path""")
def u2_index(spark, sf):
    """The symbols that an index holds when the user's rules stand for the built-in ones."""
    rules = spark.createDataFrame(_USER_RULES, "extension string, pass int, pattern string")
    index = A.build_index(X.files_code(spark, sf), symbol_rules=rules)
    return Y.explode_symbols(index).select(
        "repo", "path", "name", *[F.col(c).cast("bigint").alias(c) for c in ("line", "end_line")])


_USER_CHECKS = (
    (".py", "empty body", "style", "LOW", r"^\s+pass$"), (".py", "wide import", "dependencies", "MEDIUM", r"^import\s+os$"),
    (".ts", "bare number", "style", "LOW", r"return\s+[0-9]+"), (".go", "short name", "style", "LOW", r"^func\s+F[0-9]\("),
)


@query("u2_audit_rules", with_(CODE, LINES_SQL) + " UNION ALL ".join(
    f"""SELECT repo, path, line_no, '{rule}' AS rule, '{layer}' AS layer, '{severity}' AS severity, trim(line) AS line
FROM code_lines WHERE path LIKE '%{ext}' AND regexp_matches(line, '{p}')""" for ext, rule, layer, severity, p in _USER_CHECKS))
def u2_audit(spark, sf):
    rules = spark.createDataFrame(_USER_CHECKS, "extension string, rule string, layer string, severity string, pattern string")
    return Q.audit_by_rules(X.files_code(spark, sf), rules).withColumn("line_no", F.col("line_no").cast("bigint"))


# --- index ----------------------------------------------------------------------------------------------

# The index of all code-shaped files.
INDEX_CODE_SQL = f"""{SPANS_SQL}, about AS ({S.DESCRIBE_CODE_SQL}), sym AS (
  SELECT repo, path, array_to_string(list(name ORDER BY line, name), ',') AS symbols,
         array_to_string(list(concat(name, ' ', CAST(line AS varchar), '-', CAST(end_line AS varchar), ' ',
           CAST(tokens AS varchar)) ORDER BY line, name), ',') AS spans
  FROM symbols GROUP BY repo, path), full_index AS (
  SELECT f.repo, f.path, CASE WHEN f.path LIKE '%.ts' THEN 'ts' WHEN f.path LIKE '%.py' THEN 'py' ELSE 'go' END AS lang,
         size_bytes, CAST(length(text) AS BIGINT) AS n_chars,
         CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines,
         greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens, about AS summary, sha256(text) AS sha256,
         symbols, spans, mtime
  FROM files_code f JOIN about a ON f.repo = a.repo AND f.path = a.path
  JOIN sym s ON f.repo = s.repo AND f.path = s.path)"""
CODE_OPTS = ScanOptions(symbol_backend="regex")


def index_code(spark, sf, opts=CODE_OPTS):
    return A.build_index(X.files_code(spark, sf), opts)


def flat_index(index):
    """Index rows with the arrays joined."""
    spans = F.transform(
        "symbol_lines",
        lambda s: F.concat(s["name"], F.lit(" "), s["line"].cast("string"), F.lit("-"), s["end_line"].cast("string"),
                           F.lit(" "), s["tokens"].cast("string")))
    return index.select(
        "repo", "path", "lang", "size_bytes", "n_chars", "lines", "tokens", "summary", "sha256",
        F.array_join("symbols", ",").alias("symbols"), F.array_join(spans, ",").alias("spans"))


_INDEX_OUT = "repo, path, lang, size_bytes, n_chars, lines, tokens, summary, sha256, symbols, spans"


@query("a1_build_index", with_(CODE, INDEX_CODE_SQL) + f"SELECT {_INDEX_OUT} FROM full_index")
def a1(spark, sf):
    return flat_index(index_code(spark, sf))


# Every text of the documents, whole.
_DOC_INDEX_SQL = f"""docs_index AS (
  SELECT repo, path, doc_id, size_bytes, mtime, text, CAST(length(text) AS BIGINT) AS n_chars,
         CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines,
         greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens, false AS skipped
  FROM files_docs)"""
DOC_OPTS = ScanOptions(ignore=(), symbols=False)


def index_docs(spark, sf):
    return A.build_index(X.files_docs(spark, sf), DOC_OPTS)


@query("a1_build_index_docs", with_(DOCS, _DOC_INDEX_SQL) + f"""
SELECT repo, path, CASE WHEN skipped THEN size_bytes ELSE n_chars END AS n_chars,
       CASE WHEN skipped THEN 0 ELSE lines END AS lines,
       CASE WHEN skipped THEN CAST(ceil(size_bytes / 4.0) AS BIGINT) ELSE tokens END AS tokens, skipped,
       CASE WHEN skipped THEN '[file too large]'
            WHEN path LIKE '%.ts' AND regexp_matches(text, 'class\\s+\\w+')
              THEN concat('Class ', regexp_extract(text, 'class\\s+(\\w+)', 1))
            ELSE {S.meaningful_sql(140)} END AS summary,
       CASE WHEN NOT skipped THEN sha256(text) END AS sha256
FROM docs_index""")
def a1_docs(spark, sf):
    return index_docs(spark, sf).select(
        "repo", "path", "n_chars", "lines", "tokens", "skipped", "summary", "sha256")


@query("a2_corpus_totals", with_(DOCS, _DOC_INDEX_SQL) + """, r AS (
  SELECT *, count(*) OVER (PARTITION BY repo) AS n FROM docs_index)
SELECT repo, least(count(*), 30) AS files, CAST(sum(CASE WHEN skipped THEN 0 ELSE lines END) AS BIGINT) AS lines,
       CAST(sum(size_bytes) AS BIGINT) AS bytes,
       CAST(sum(CASE WHEN skipped THEN CAST(ceil(size_bytes / 4.0) AS BIGINT) ELSE tokens END) AS BIGINT) AS tokens,
       count_if(skipped) + greatest(count(*) - 30, 0) AS skipped_files, count(*) > 30 AS truncated
FROM r GROUP BY repo""")
def a2(spark, sf):
    totals = A.corpus_totals(index_docs(spark, sf), max_files=30)
    return totals.select(
        "repo", *[F.col(c).cast("bigint").alias(c) for c in ("files", "lines", "bytes", "tokens", "skipped_files")],
        "truncated")


@query("a3_dir_rollup", with_(DOCS) + """, measured AS (
  SELECT repo, path, size_bytes, length(text) - length(replace(text, chr(10), '')) AS lines,
         greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM files_docs), up AS (
  SELECT *, '' AS dir FROM measured UNION ALL
  SELECT *, split_part(path, '/', 1) FROM measured UNION ALL
  SELECT *, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) FROM measured)
SELECT repo, dir, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(size_bytes) AS BIGINT) AS bytes,
       CAST(sum(tokens) AS BIGINT) AS tokens FROM up GROUP BY repo, dir""")
def a3(spark, sf):
    return A.dir_rollup(A.analyze_files(X.files_docs(spark, sf), ALL), "tokens")


@query("a4_sort_index", with_(DOCS) + """
SELECT repo, path, size_bytes, doc_id FROM files_docs ORDER BY repo, size_bytes DESC, path""")
def a4(spark, sf):
    return A.sort_index(X.files_docs(spark, sf).select("repo", "path", "size_bytes", "doc_id"), "size")


# A map of 40 of 50 directories, 60 files each at most, cut only in the last column.
_MAP_SQL = f"""m AS (
  SELECT repo, regexp_replace(path, '/[^/]*$', '') AS dir, path, concat('- `', path, '` — ',
    concat_ws(' · ', concat(CAST(lines AS varchar), ' lines'),
      array_to_string(string_split(symbols, ',')[1:6], ', '), nullif(summary, ''))) AS line, lines
  FROM full_index), ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY repo ORDER BY dir) AS dr,
         row_number() OVER (PARTITION BY repo, dir ORDER BY path) AS fr,
         count(*) OVER (PARTITION BY repo, dir) AS n FROM m), dirs AS (
  SELECT repo, dir, concat(chr(10), chr(10), '## ', dir, chr(10), string_agg(line, chr(10) ORDER BY path),
    CASE WHEN any_value(n) > 60 THEN concat(chr(10), '- … ', CAST(any_value(n) - 60 AS varchar), ' files more') ELSE '' END) AS body
  FROM ranked WHERE dr <= 40 AND fr <= 60 GROUP BY repo, dir), totals AS (
  SELECT repo, count(*) AS files, sum(lines) AS lines, count(DISTINCT dir) AS n_dirs FROM m GROUP BY repo), maps AS (
  SELECT t.repo, concat('# Code Map', chr(10), 'Generated 2024-02-01T12:30:45Z · ', CAST(files AS varchar), ' files · ',
    CAST(CAST(lines AS BIGINT) AS varchar), ' lines', (SELECT string_agg(body, '' ORDER BY dir) FROM dirs d WHERE d.repo = t.repo),
    CASE WHEN n_dirs > 40 THEN concat(chr(10), chr(10), '… ', CAST(n_dirs - 40 AS varchar),
      CASE WHEN n_dirs = 41 THEN ' more directory not shown' ELSE ' more directories not shown' END) ELSE '' END) AS body
  FROM totals t)"""
MAP_OPTS = CODE_OPTS


def _cut_sql(n: int) -> str:
    return (f"CASE WHEN length(body) > {n} THEN concat(substr(body, 1, {n}), '…', chr(10), "
            f"'(map cut after {n} characters)') ELSE body END")


@query("a5_render_map", with_(CODE, INDEX_CODE_SQL, _MAP_SQL) + f"""
SELECT repo, {_cut_sql(16384)} AS text, length(body) > 16384 AS truncated FROM maps""")
def a5(spark, sf):
    return R.render_map(index_code(spark, sf, MAP_OPTS), X.now())


@query("a5_render_map_whole", with_(CODE, INDEX_CODE_SQL, _MAP_SQL) + "SELECT repo, body AS text FROM maps")
def a5_whole(spark, sf):
    return R.render_map(index_code(spark, sf, MAP_OPTS), X.now(), 1 << 24).select("repo", "text")


@query("a6_render_anatomy", with_(CODE, INDEX_CODE_SQL) + """, labels AS (
  SELECT repo, path, string_agg(concat(name, ' L', CAST(line AS varchar),
      CASE WHEN end_line <> line THEN concat('-', CAST(end_line AS varchar)) ELSE '' END, ' ~',
      CAST(tokens AS varchar), ' tok'), ', ' ORDER BY line) AS label FROM symbols GROUP BY repo, path)
SELECT f.repo, f.path, concat('- `', f.path, '` (~', CAST(tokens AS varchar), ' tok) — ', summary, chr(10),
  '  symbols: ', label) AS body FROM full_index f JOIN labels l ON f.repo = l.repo AND f.path = l.path UNION ALL
SELECT repo, '', concat('# Anatomy (auto-generated)', chr(10), chr(10), 'Files: ', CAST(count(*) AS varchar),
  ' tracked · ', CAST(CAST(sum(lines) AS BIGINT) AS varchar), ' lines · scanned 2024-02-01T12:30:45Z', chr(10))
FROM full_index GROUP BY repo""")
def a6(spark, sf):
    return R.render_anatomy(index_code(spark, sf, MAP_OPTS), X.now())


# Documents of the repositories: one third without a block, one third with one, the others do not exist.
_BODY = (
    "CASE cast(substr(repo, 2, 2) as int) % 3 WHEN 0 THEN concat('# Project', chr(10), repo, chr(10), '  ') "
    "WHEN 1 THEN concat('top', chr(10), '<!-- corpusmap:start -->', chr(10), 'old', chr(10), "
    "'<!-- corpusmap:end -->', chr(10), 'tail', chr(10)) END"
)
DOCS_OF_REPOS_SQL = f"""bodies AS (
  SELECT * FROM (SELECT repo, {_BODY} AS body FROM (SELECT DISTINCT repo FROM files_code)) WHERE body IS NOT NULL)"""


def bodies(spark, sf):
    repos = X.files_code(spark, sf).select("repo").distinct()
    return repos.withColumn("body", F.expr(_BODY)).filter("body IS NOT NULL")


@query("a7_splice_block", with_(CODE, INDEX_CODE_SQL, _MAP_SQL, DOCS_OF_REPOS_SQL) + f""", blocks AS (
  SELECT repo, concat('<!-- corpusmap:start -->', chr(10), {_cut_sql(1 << 24)}, chr(10), '<!-- corpusmap:end -->') AS block
  FROM maps)
SELECT k.repo, CASE WHEN b.body LIKE 'top%' THEN concat('top', chr(10), block, chr(10), 'tail', chr(10))
    ELSE concat(rtrim(coalesce(b.body, ''), chr(10) || ' '), chr(10), chr(10), block, chr(10)) END AS text,
  true AS changed, CAST(length(block) AS BIGINT) AS block_chars
FROM blocks k LEFT JOIN bodies b ON k.repo = b.repo""")
def a7(spark, sf):
    return R.splice_block(bodies(spark, sf), R.render_block(index_code(spark, sf, MAP_OPTS), X.now(), 1 << 24))


@query("a8_absorb_edits", with_(CODE, INDEX_CODE_SQL, _MAP_SQL, DOCS_OF_REPOS_SQL) + f""", fresh AS (
  SELECT repo, {_cut_sql(1 << 24)} AS fresh FROM maps)
SELECT f.repo, CASE WHEN b.body LIKE 'top%' THEN 'absorbed' ELSE 'replaced' END AS action,
  CASE WHEN b.body LIKE 'top%' THEN concat(rtrim(b.body, chr(10)), chr(10), chr(10),
    '## Index as of now', chr(10), chr(10), fresh) ELSE fresh END AS text
FROM fresh f LEFT JOIN bodies b ON f.repo = b.repo""")
def a8(spark, sf):
    existing = bodies(spark, sf)
    fresh = R.render_map(index_code(spark, sf, MAP_OPTS), X.now(), 1 << 24).select("repo", F.col("text").alias("body"))
    written = existing.select(
        "repo", F.when(F.col("body").startswith("top"), F.sha2(F.lit("other"), 256))
        .otherwise(F.sha2("body", 256)).alias("hash"))
    return R.absorb_edits(existing, fresh, written).select("repo", "action", "text")


@query("a9_file_digest", with_(DOCS) + """, req AS (
  SELECT repo, path, 'as is' AS kind FROM files_docs UNION ALL
  SELECT repo, concat('../', path), 'outside' FROM files_docs UNION ALL
  SELECT repo, concat(path, '.gone'), 'missing' FROM files_docs)
SELECT r.repo, r.path, r.kind, f.path IS NOT NULL AS exists, size_bytes,
  CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines,
  CASE WHEN text IS NOT NULL THEN greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS tokens,
  substr(text, 1, 300) AS preview, length(text) > 300 AS preview_truncated
FROM req r LEFT JOIN files_docs f ON r.repo = f.repo AND r.path = f.path""")
def a9(spark, sf):
    docs = X.files_docs(spark, sf)
    wanted = docs.select("repo", F.explode(F.array(
        F.struct("path", F.lit("as is").alias("kind")),
        F.struct(F.concat(F.lit("../"), F.col("path")).alias("path"), F.lit("outside").alias("kind")),
        F.struct(F.concat(F.col("path"), F.lit(".gone")).alias("path"), F.lit("missing").alias("kind")),
    )).alias("r")).select("repo", "r.path", "r.kind")
    digest = A.file_digest(wanted, docs, ScanOptions(), 300)
    return digest.select(
        "repo", "path", "kind", "exists", "size_bytes", "lines", "tokens", "preview", "preview_truncated")


# --- sources and sinks: written to a new folder, then read back -----------------------------------------

# One file per document; some hold Latin-1 bytes, some a NUL, and some that the inventory names are not there.
_FILE_BYTES = (
    "CASE WHEN doc_id % 50 = 1 THEN encode(text, 'ISO-8859-1') WHEN doc_id % 50 = 2 THEN concat(encode(text, 'UTF-8'), X'00') "
    "ELSE encode(text, 'UTF-8') END"
)


@query("s2_read_text_files", with_(DOCS) + """, f AS (
  SELECT repo, path, doc_id, CASE WHEN doc_id % 50 = 1 THEN regexp_replace(text, '[^\x00-\xFF]', '?', 'g') ELSE text END AS text
  FROM files_docs), t AS (
  SELECT repo, path, doc_id, CASE WHEN doc_id % 50 = 1 THEN regexp_replace(text, '[^\x00-\x7F]', chr(65533), 'g') ELSE text END AS text
  FROM f)
SELECT repo, path, CASE doc_id % 50 WHEN 2 THEN '[binary]' WHEN 3 THEN '[unreadable]' END AS skip_reason,
       CASE WHEN doc_id % 50 NOT IN (2, 3) THEN CAST(length(text) AS BIGINT) END AS chars,
       CASE WHEN doc_id % 50 NOT IN (2, 3) THEN CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) END AS lines,
       CASE WHEN doc_id % 50 NOT IN (2, 3) THEN sha256(text) END AS sha256 FROM t""")
def s2(spark, sf):
    docs = X.files_docs(spark, sf)
    root, key = _written(spark, docs.filter("doc_id % 50 <> 3"))
    files = SF.read_text_files(spark, root, docs.select("repo", "path", "size_bytes", "mtime"), key=key)
    text = F.regexp_replace("text", "\x01$", "")  # Spark's text files end their lines
    return files.select(
        "repo", "path", "skip_reason", F.length(text).cast("bigint").alias("chars"),
        F.length(F.regexp_replace(text, "[^\n]", "")).cast("bigint").alias("lines"), F.sha2(text, 256).alias("sha256"))


def _written(spark, docs):
    """The files in a new folder, and how repository and path follow from their places."""
    root = X.work_dir(spark)
    return root, SF.write_files(docs.select("repo", "path", F.expr(_FILE_BYTES).alias("content")), root, "\x01")


@query("s2_index_tree", with_(DOCS) + f"""
SELECT repo, path, CASE doc_id % 50 WHEN 2 THEN '[binary]' WHEN 3 THEN '[unreadable]' END AS skip_reason,
       size_bytes, {X.sql_ts('mtime')} AS mtime,
       CASE WHEN doc_id % 50 IN (2, 3) THEN 0 ELSE CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) END AS lines,
       CASE WHEN doc_id % 50 NOT IN (2, 3) THEN CAST(length(text) + 1 AS BIGINT) END AS n_chars,
       CASE WHEN doc_id % 50 NOT IN (1, 2, 3) THEN sha256(concat(text, chr(1))) END AS sha256
FROM files_docs""")
def s2_index(spark, sf):
    """The index of a written tree by its inventory; the files hold Spark's line end (\\x01) behind each text."""
    docs = X.files_docs(spark, sf)
    root, key = _written(spark, docs.filter("doc_id % 50 <> 3"))
    inventory = docs.select("repo", "path", "size_bytes", "mtime", (F.col("doc_id") % 50 == 1).alias("latin"))
    index = SF.index_tree(spark, root, inventory, ALL, key=key)
    return index.join(inventory.select("repo", "path", "latin"), ["repo", "path"]).select(
        "repo", "path", "skip_reason", "size_bytes", X.show_ts("mtime").alias("mtime"), "lines",
        F.when(~F.col("skipped"), F.col("n_chars")).alias("n_chars"), F.when(~F.col("latin"), F.col("sha256")).alias("sha256"))


@query("s3_write_read_index", with_(CODE, INDEX_CODE_SQL) + f"SELECT {_INDEX_OUT} FROM full_index")
def s3(spark, sf):
    path = X.work_dir(spark)
    store.write_index(index_code(spark, sf), path)
    return flat_index(store.read_index(spark, path))


@query("s9_snapshots", with_(DOCS) + """
SELECT repo, path, size_bytes, 3 AS n_snapshots FROM files_docs WHERE doc_id % 2 = 1""")
def s9(spark, sf):
    path = X.work_dir(spark)
    docs = X.files_docs(spark, sf).select("repo", "path", "size_bytes", "doc_id")
    for tag, keep in (("20240101-000000", "true"), ("20240102-000000", "doc_id % 3 = 0"),
                      ("20240103-000000", "doc_id % 2 = 1")):
        store.write_snapshot(docs.filter(keep), path, tag)
    n = store.list_snapshots(spark, path).agg(F.count(F.lit(1)).cast("int"))
    newest = store.read_snapshot(spark, path)
    return newest.select("repo", "path", "size_bytes", n.scalar().alias("n_snapshots"))


@query("s10_write_rendered", with_(CODE, INDEX_CODE_SQL) + """
SELECT repo, concat('- ', path) AS value FROM full_index""")
def s10(spark, sf):
    path = X.work_dir(spark)
    rows = index_code(spark, sf, MAP_OPTS).select("repo", "path", F.concat(F.lit("- "), F.col("path")).alias("body"))
    store.write_rendered(rows, path)
    return spark.read.schema("value string, repo string").text(path)


@query("s11_scan_state", with_(DOCS, X.HEADS_SQL) + f"""
SELECT f.repo, {X.sql_ts(f"TIMESTAMP '{X.NOW}'")} AS last_scanned, any_value(h.git_head) AS git_head,
       count(*) AS total_files, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS total_lines
FROM files_docs f LEFT JOIN heads h ON f.repo = h.repo GROUP BY f.repo""")
def s11(spark, sf):
    index = A.analyze_files(X.files_docs(spark, sf), ALL)
    state = A.scan_state(index, X.heads(spark, sf), X.now())
    return state.withColumn("last_scanned", X.show_ts("last_scanned"))


@query("s12_manifest", with_(DOCS) + f"SELECT repo, path, size_bytes, {X.sql_ts('mtime')} AS mtime FROM files_docs")
def s12(spark, sf):
    out = A.manifest(A.analyze_files(X.files_docs(spark, sf), ALL))
    return out.withColumn("mtime", X.show_ts("mtime"))
