"""Symbols of source files, found inside each row: no shuffle, no per-line rows.

A file's lines are an array, so a file must fit in a task. All symbols are kept unless `max_symbols` is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.paths import detect_lang
from corpusmap.functions.text import split_lines
from corpusmap.options import ScanOptions

# Patterns of declarations by language, in the order in which they are tried.
_SCRIPT = (
    r"^\s*(?:export\s+)?(?:async\s+)?(?:default\s+)?(?:function\s+([A-Za-z_$][\w$]*)|class\s+([A-Za-z_$][\w$]*))",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=",
    r"^\s*(?:export\s+)?(?:interface|type|enum)\s+([A-Za-z_$][\w$]*)",
)
_JVM = (
    r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+|static\s+|open\s+)*class\s+([A-Z]\w*)",
    r"^\s*(?:public|private|protected)?\s*interface\s+([A-Z]\w*)",
    r"^\s*(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\],\s]+\s+"
    r"(?!if|for|while|switch|return|catch|do|case|else|new|try)\b([a-z]\w*)\s*\(",
)
_C = (
    r"^\s*(?:public|private|protected)?\s*(?:static\s+|virtual\s+|override\s+|inline\s+)*"
    r"(?:class|struct|enum)\s+([A-Za-z_]\w*)",
    r"^\s*(?:[A-Za-z_][\w:*<>,\s&]*\s+)?(?!if|for|while|switch|return|catch|do|case|else|new|try)"
    r"\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const)?\s*\{",
)
SYMBOL_PATTERNS: dict[str, tuple[str, ...]] = {
    "ts": _SCRIPT, "tsx": _SCRIPT, "js": _SCRIPT, "jsx": _SCRIPT,
    "py": (
        r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)",
        r"^\s*class\s+([A-Za-z_]\w*)",
    ),
    "go": (
        r"^\s*func\s+([A-Za-z_]\w*)",
        r"^\s*func\s+\([^)]*\)\s+([A-Z]\w*)",
        r"^\s*type\s+([A-Z]\w*)\s+(?:struct|interface)\b",
    ),
    "rs": (
        r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([a-z_]\w*)",
        r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type|mod)\s+([A-Za-z_]\w*)",
    ),
    "java": _JVM, "kt": _JVM,
    "c": _C, "cpp": _C, "cs": _C,
    "rb": (r"^\s*(?:def|class|module)\s+([A-Za-z_]\w*(?:::\w+)*)",),
    "php": (
        r"^\s*(?:public|private|protected)?\s*(?:static\s+|function\s+)+([A-Za-z_]\w*)\s*\(",
        r"^\s*(?:abstract\s+|final\s+)?class\s+([A-Za-z_]\w*)",
    ),
    "swift": (
        r"^\s*(?:public|private|internal|fileprivate|open)?\s*"
        r"(?:static\s+|class\s+|struct\s+|enum\s+|func\s+)+([A-Za-z_]\w*)",
    ),
}

# Declarations that start at the left margin, one pattern with one name group per language.
_SCRIPT_TOP = (
    r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?"
    r"(?:function\s*\*?|class|interface|type|enum|const\s+enum|const|let|var)\s+([A-Za-z_$][\w$]*)"
)
_JVM_TOP = (
    r"^(?:(?:public|private|protected|abstract|final|static|open)\s+)*(?:class|interface)\s+([A-Za-z_]\w*)"
)
SPAN_PATTERNS: dict[str, str] = {
    "ts": _SCRIPT_TOP, "tsx": _SCRIPT_TOP, "js": _SCRIPT_TOP, "jsx": _SCRIPT_TOP,
    "py": r"^(?:async\s+def|def|class)\s+([A-Za-z_]\w*)",
    "go": r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([A-Za-z_]\w*)",
    "rs": (
        r"^(?:pub(?:\([^)]*\))?\s+)?(?:(?:async\s+)?fn|struct|enum|trait|impl(?:\s*<[^>]*>)?)\s+([A-Za-z_]\w*)"
    ),
    "java": _JVM_TOP, "kt": _JVM_TOP,
}
# What may stand before a declaration without belonging to it, and lines that go on with the one before.
EXPORT_PREFIX = r"^(?:export\s+)?(?:default\s+)?"
GOES_ON = r"^[{})\]]"

# Stretches of text that are no code, by language: comments, then literals. Loops are possessive, so that the length of
# a stretch costs no stack; a stretch that nothing closes reaches to the end of the text.
_C_COMMENT = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
_ONE_LINE = r"\x22[^\x22\\\n]*+(?:\\.[^\x22\\\n]*+)*+\x22"
_ONE_LINE_TICK = _ONE_LINE.replace("x22", "x27")
_ONE_CHAR = r"\x27(?:\\[^\x27\n]{1,9}|[^\x27\\\n])\x27|\x27\\\x27\x27"
_TEXT_BLOCK = r"\x22{3}[^\x22\\]*+(?:(?:\\[\s\S]|\x22(?!\x22\x22))[^\x22\\]*+)*+(?:\x22{3}|\z)"
# A template may hold ${...} with literals, braces and further templates one level down.
_INNER_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_HOLE = rf"\$\{{(?:[^{{}}`]|\{{[^{{}}`]*+\}}|{_INNER_TEMPLATE})*+\}}"
_TEMPLATE = rf"`(?:[^`\\$]++|\\[\s\S]|{_HOLE}|\$)*+(?:`|\z)"
_PATTERN = r"(?<=[=(,:!&|?;{}\[]\s{0,2})/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/"
_SCRIPT_ASIDE = "|".join((_C_COMMENT, _TEMPLATE, _ONE_LINE, _ONE_LINE_TICK, _PATTERN))
_JVM_ASIDE = "|".join((_C_COMMENT, _TEXT_BLOCK, _ONE_LINE, _ONE_CHAR))
ASIDES: dict[str, str] = {
    **dict.fromkeys(("ts", "tsx", "js", "jsx"), _SCRIPT_ASIDE),
    "py": "|".join((r"#[^\n]*+", _TEXT_BLOCK, _TEXT_BLOCK.replace("x22", "x27"), _ONE_LINE, _ONE_LINE_TICK)),
    "go": "|".join((_C_COMMENT, r"`[^`]*+(?:`|\z)", _ONE_LINE, _ONE_CHAR)),
    "rs": "|".join((_C_COMMENT, r"\br(#*+)\x22[\s\S]*?(?:\x22\1|\z)", _ONE_LINE.replace(r"\n", ""), _ONE_CHAR)),
    "java": _JVM_ASIDE, "kt": _JVM_ASIDE,
}

# Stands for an aside between two stretches of code. A text that holds it itself is split by the pattern.
_MARK = "\uffff"

_HITS = "array<struct<name:string,line:int,pass:int>>"
_SPANS = "array<struct<name:string,line:int,end_line:int,tokens:bigint>>"


# The expressions below are SQL texts over the columns `lines` and `lang`: lambdas inside lambdas read better
# so, and a text is one call to the JVM. `transform(array(x), v -> …)[0]` computes x once and names it v.


def _by_lang(table: dict, value, default: str) -> str:
    """CASE over the languages, with one branch for all languages that share an entry."""
    branches: dict = {}
    for tag, entry in table.items():
        branches.setdefault(entry, []).append(f"'{tag}'")
    return "CASE " + " ".join(
        f"WHEN lang IN ({', '.join(tags)}) THEN {value(entry)}" for entry, tags in branches.items()
    ) + f" ELSE {default} END"


def _name_sql(pattern: str) -> str:
    """The name a pattern finds in the line r.text, '' if none; a group that took no part gives ''."""
    first = f"regexp_extract(r.text, r'{pattern}', 1)"
    return f"concat({first}, regexp_extract(r.text, r'{pattern}', 2))" if pattern is _SCRIPT[0] else first


def _hits_sql(max_symbols: int | None) -> str:
    likely = _by_lang(
        SYMBOL_PATTERNS, lambda ps: "t RLIKE r'" + "|".join(f"(?:{p})" for p in ps) + "'", "false"
    )
    rows = (
        f"filter(transform(lines, (t, i) -> IF({likely}, named_struct('text', t, 'line', i + 1), NULL)), "
        "r -> r IS NOT NULL)"
    )
    passes = max(len(ps) for ps in SYMBOL_PATTERNS.values())

    def hits(n: int) -> str:
        name = _by_lang(SYMBOL_PATTERNS, lambda ps: _name_sql(ps[n]) if n < len(ps) else "''", "''")
        return (
            f"filter(transform(rows, r -> named_struct('name', {name}, 'line', r.line, 'pass', {n + 1})), "
            "h -> h.name <> '')"
        )

    found = ", ".join(hits(n) for n in range(passes))
    return _once_sql(f"transform(array({rows}), rows -> concat({found}))[0]", max_symbols)


def _once_sql(every: str, max_symbols: int | None) -> str:
    """Each name where it is found first: equal names stand side by side once sorted, the first one in front."""
    firsts = (
        "sort_array(filter(transform(named, (r, j) -> IF(j > 0 AND get(named, j - 1).name = r.name, NULL, r.at)), "
        "a -> a IS NOT NULL))"
    )
    named = "sort_array(transform(hits, (h, i) -> named_struct('name', h.name, 'at', i)))"
    once = (
        f"transform(array({every}), hits -> transform(transform(array({named}), named -> {firsts})[0], "
        "a -> get(hits, a)))[0]"
    )
    return f"CAST({_first_sql(once, max_symbols)} AS {_HITS})"


def _rule_hits_sql(max_symbols: int | None) -> str:
    """Names that the file's own rules, the array `symbol_rules`, find in `lines`, in the order of the rules."""
    every = """flatten(transform(symbol_rules, r -> filter(transform(lines, (t, i) -> named_struct(
      'name', regexp_extract(t, r.pattern, 1), 'line', i + 1, 'pass', r.pass)), h -> h.name <> '')))"""
    return _once_sql(every, max_symbols)


def _first_sql(array: str, n: int | None) -> str:
    return array if n is None else f"slice({array}, 1, {n})"


def symbol_hits(max_symbols: int | None = None) -> Column:
    """Declared names with line and pattern number, in pattern order, each name once."""
    return F.expr(_hits_sql(max_symbols))


def _tokens_sql(chars: str) -> str:
    return f"greatest(1L, CAST(ceil(({chars}) / 4.0D) AS BIGINT))"


def _spans_sql(hits: str) -> str:
    end = "greatest(h.line, coalesce(get(hits, i + 1).line - 1, size(lines) - 1))"
    return f"""transform(
      array(array_sort(transform({hits}, h -> named_struct('line', h.line, 'name', h.name)))),
      hits -> transform(transform(hits, (h, i) -> named_struct('name', h.name, 'line', h.line, 'end_line', {end})),
        s -> named_struct('name', s.name, 'line', s.line, 'end_line', s.end_line, 'tokens',
          {_tokens_sql("length(array_join(slice(lines, s.line, s.end_line - s.line + 1), '\\n'))")})))[0]"""


def span_hits(max_symbols: int | None = None) -> Column:
    """Symbols by pattern with end line and tokens: one reaches to the line before the next, the last to the end.

    The spans do not overlap, so together they touch each line once.
    """
    return F.expr(_spans_sql(_hits_sql(max_symbols))).cast(_SPANS)


def by_extension(rules: DataFrame, out: str) -> DataFrame:
    """Rules with an `extension` as one row per extension, the others of their columns as the sorted array `out`."""
    columns = [c for c in rules.columns if c != "extension"]
    return rules.filter(F.col("extension").isNotNull() & F.col("pattern").isNotNull()).groupBy("extension").agg(
        F.array_sort(F.collect_set(F.struct(*columns))).alias(out))


def with_rules(files: DataFrame, rules: DataFrame, out: str) -> DataFrame:
    """Adds the rules of each file's extension as the array `out`, null where there are none.

    Rules are few, one row per extension, so Spark sends them to the files.
    """
    own = by_extension(rules, out).withColumnRenamed("extension", "_extension")
    extension = F.concat(F.lit("."), F.substring_index(files["path"], ".", -1))
    return files.join(own, extension == own["_extension"], "left").drop("_extension")


def with_symbol_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `symbol_rules`, the rules (extension, pass, pattern) of each file's extension, in the order of passes."""
    return with_rules(files, rules.select("extension", F.col("pass").cast("int").alias("pass"), "pattern"), "symbol_rules")


def rule_spans(max_symbols: int | None = None) -> Column:
    """Symbols by the file's own rules, with end line and tokens as `span_hits` gives them."""
    return F.expr(_spans_sql(_rule_hits_sql(max_symbols))).cast(_SPANS)


def _code_sql() -> str:
    """The text of `lines` with its comments blank and its literals as empty brackets, each as long as before."""
    aside = lambda fn: _by_lang(ASIDES, fn, "NULL")
    comment = "t LIKE '//%' OR t LIKE '/*%' OR t LIKE '#%'"
    blank = lambda t: f"IF(instr({t}, '\n') = 0, repeat(' ', length({t})), regexp_replace({t}, r'[^\n]', ' '))"
    inside = blank("substring(t, 2, length(t) - 2)")
    shown = f"CASE WHEN t IS NULL THEN '' WHEN {comment} OR length(t) < 2 THEN {blank('t')} ELSE concat('(', {inside}, ')') END"
    # A split by a pattern compiles it anew for each text, a replacement does not; see `_MARK`.
    between = f"""IF(instr(text, '{_MARK}') > 0, {aside(lambda p: f"split(text, r'{p}', -1)")},
      split({aside(lambda p: f"regexp_replace(text, r'{p}', '{_MARK}')")}, '{_MARK}', -1))"""
    found = aside(lambda p: f"regexp_extract_all(text, r'{p}', 0)")
    return f"""transform(array(array_join(lines, '\n')), text ->
      array_join(zip_with({between}, {found}, (code, t) -> concat(code, {shown})), ''))[0]"""


def _depths_sql() -> str:
    """How many brackets are open before each line of `code`, and after the last.

    Running sums in pieces of about the square root of all lines, so that no array grows line by line to full length.
    """
    opened = r"length(translate(t, ')]}', '')) - length(translate(t, '([{', ''))"
    running = lambda array, start: f"""aggregate({array}, named_struct('sum', {start}, 'before', CAST(array() AS array<int>)),
      (a, n) -> named_struct('sum', a.sum + n, 'before', concat(a.before, array(a.sum))))"""  # noqa: E731
    sums = "transform(pieces, piece -> aggregate(piece, 0, (a, n) -> a + n))"
    inside = running("piece", "get(starts.before, c)") + ".before"
    return f"""transform(array(transform(code, t -> {opened})), opened -> transform(array(
        CAST(ceil(sqrt(size(opened))) AS int)), width -> transform(array(transform(
          sequence(0, CAST((size(opened) - 1) DIV width AS int)), c -> slice(opened, c * width + 1, width))),
        pieces -> transform(array({running(sums, "0")}), starts -> named_struct('last', starts.sum, 'before',
          flatten(transform(pieces, (piece, c) -> {inside}))))[0])[0])[0])[0]"""


def toplevel_hits(max_symbols: int | None = None) -> Column:
    """Top-level declarations with exact spans, from a lexer's view of the text.

    Comments and the insides of literals are no code. A line on the left margin outside all brackets begins a
    statement, unless it opens with a brace or closes a bracket; a statement ends at the last line with code before the
    next one. In a file whose brackets do not balance, every such line on the margin begins a statement.
    """
    solid = (
        r"filter(transform(code, (t, i) -> IF(t RLIKE r'\S', named_struct('text', t, 'line', i + 1, 'depth', "
        "IF(depths.last = 0, get(depths.before, i), 0)), NULL)), r -> r IS NOT NULL)"
    )
    margin = (
        "filter(transform(solid, (r, i) -> named_struct('text', r.text, 'line', r.line, 'depth', r.depth, "
        rf"'prev', get(solid, i - 1).line)), r -> r.depth <= 0 AND r.text RLIKE r'^\S' AND NOT r.text RLIKE r'{GOES_ON}')"
    )
    name = _by_lang(SPAN_PATTERNS, lambda p: f"regexp_extract(r.text, r'{p}', 1)", "''")
    end = "coalesce(get(margin, i + 1).prev, get(solid, size(solid) - 1).line)"
    named = _first_sql(f"""filter(transform(margin, (r, i) -> named_struct(
      'name', {name}, 'line', r.line, 'end_line', {end}, 'text', r.text)), s -> s.name <> '')""", max_symbols)
    body = "rtrim(array_join(slice(code, s.line, s.end_line - s.line + 1), '\n'))"
    outside = f"length(regexp_extract(s.text, r'{EXPORT_PREFIX}', 0))"
    measured = f"""transform({named}, s -> named_struct('name', s.name, 'line', s.line, 'end_line', s.end_line,
      'tokens', {_tokens_sql(f"length({body}) - {outside}")}))"""
    return F.expr(f"""transform(array(split({_code_sql()}, '\n', -1)), code -> transform(array({_depths_sql()}), depths ->
      transform(array({solid}), solid -> transform(array({margin}), margin -> {measured})[0])[0])[0])[0]""").cast(_SPANS)


def with_symbols(files: DataFrame, opts: ScanOptions = ScanOptions()) -> DataFrame:
    """Adds `symbol_lines` by the chosen method to files with `text`, `lang` and `lines`.

    Spans serve the languages that have them, the patterns serve the others and files in which spans find
    nothing. Files whose `lines` is null have no symbols. Where a column `symbol_rules` holds rules for a file, they take
    the place of the patterns of its language.
    """
    none = F.array().cast(_SPANS)
    if opts.symbol_backend == "regex":
        spans = F.lit(None).cast(_SPANS)
    else:
        spans = F.when(F.col("lang").isin(*SPAN_PATTERNS), toplevel_hits(opts.max_symbols))
    known = F.col("lines").isNotNull()
    ruled = "symbol_rules" in files.columns
    if ruled:
        spans = F.when(F.col("symbol_rules").isNull(), spans)
    # One column per step keeps Spark from computing the spans once for the test and once for the value.
    stepped = files.withColumn("_spans", F.when(known, spans))
    chosen = F.when(F.size("_spans") > 0, F.col("_spans"))
    if ruled:
        chosen = chosen.when(known & F.col("symbol_rules").isNotNull(), rule_spans(opts.max_symbols))
    chosen = chosen.when(known, span_hits(opts.max_symbols)).otherwise(none)
    return stepped.withColumn("symbol_lines", chosen).drop("_spans")


def has_symbols(lang: Column) -> Column:
    return lang.isin(*SYMBOL_PATTERNS)


def with_lines(files: DataFrame) -> DataFrame:
    """Adds `lang` and `lines`, the line array; only languages with patterns are split."""
    files = files.withColumn("lang", detect_lang(F.col("path")))
    return files.withColumn("lines", F.when(has_symbols(F.col("lang")), split_lines(F.col("text"))))


def extract_symbols(files: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """Names declared in each file: (repo, path, name, line, pass, pos), pos counting in pattern order."""
    found = with_lines(files).filter(has_symbols(F.col("lang"))).select(
        "repo", "path", symbol_hits(max_symbols).alias("hits")
    )
    hits = found.select("repo", "path", F.posexplode_outer("hits").alias("pos", "hit"))
    return hits.filter(F.col("hit").isNotNull()).select(
        "repo", "path", "hit.name", "hit.line", "hit.pass", (F.col("pos") + 1).alias("pos")
    )


def extract_by_rules(files: DataFrame, rules: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """Names found by rules given as a table: (repo, path, name, line, pass, pos), as `extract_symbols` gives them.

    `rules` has (extension, pass, pattern); an extension starts with a dot, a pattern's first group is the name, and
    passes are tried in order. The rules of an extension are one array, folded over the lines inside the row of each
    file; a name counts where it is found first. Rules without extension or pattern are left out, files without text
    have no names.
    """
    ruled = with_symbol_rules(files.select("repo", "path", "text"), rules).filter(F.col("symbol_rules").isNotNull())
    found = ruled.withColumn("lines", split_lines(F.col("text"))).select(
        "repo", "path", F.posexplode_outer(F.expr(_rule_hits_sql(max_symbols))).alias("pos", "hit"))
    return found.filter(F.col("hit").isNotNull()).select(
        "repo", "path", "hit.name", "hit.line", "hit.pass", (F.col("pos") + 1).alias("pos"))


def explode_symbols(files: DataFrame) -> DataFrame:
    """Symbol rows (repo, path, name, line, end_line, tokens) of anything with `symbol_lines`.

    The outer form keeps Spark from testing for empty arrays first, which would compute each array twice.
    """
    rows = files.select("repo", "path", F.explode_outer("symbol_lines").alias("s")).filter(F.col("s").isNotNull())
    return rows.select("repo", "path", "s.name", "s.line", "s.end_line", "s.tokens")


def with_symbol_spans(files: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """The files whose language has patterns, with `symbol_lines`, their symbols by pattern."""
    coded = with_lines(files).filter(has_symbols(F.col("lang")))
    return coded.withColumn("symbol_lines", span_hits(max_symbols))


def symbol_spans(files: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """Symbols by pattern with end line and tokens."""
    return explode_symbols(with_symbol_spans(files, max_symbols))


def toplevel_spans(files: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """Top-level declarations with exact spans, for the languages that have them."""
    coded = with_lines(files).filter(F.col("lang").isin(*SPAN_PATTERNS))
    return explode_symbols(coded.withColumn("symbol_lines", toplevel_hits(max_symbols)))


def route_symbol_backend(files: DataFrame, opts: ScanOptions = ScanOptions()) -> DataFrame:
    """Symbols by the method `with_symbols` picks for each file."""
    return explode_symbols(with_symbols(with_lines(files), opts))


def top_symbols(files: DataFrame, n: int = 5) -> DataFrame:
    """The n largest symbols of each file with their `rank`, ties by line: picked inside the row of the file."""
    largest = F.slice(F.array_sort(F.transform("symbol_lines", lambda s: F.struct(
        (-s["tokens"]).alias("less"), s["line"].alias("line"), s["name"].alias("name"),
        s["end_line"].alias("end_line"), s["tokens"].alias("tokens")))), 1, n)
    rows = files.select("repo", "path", F.posexplode_outer(largest).alias("at", "s")).filter(F.col("s").isNotNull())
    return rows.select("repo", "path", "s.name", "s.line", "s.end_line", "s.tokens", (F.col("at") + 1).alias("rank"))


def symbol_lists(files: DataFrame, n: int | None = None) -> DataFrame:
    """The names of each file that has symbols, in line order, all or the first n."""
    ordered = F.array_sort(F.transform("symbol_lines", lambda s: F.struct(s["line"].alias("line"), s["name"].alias("name"))))
    names = F.transform(ordered, lambda s: s["name"])
    named = files.select("repo", "path", (names if n is None else F.slice(names, 1, n)).alias("symbols"))
    return named.filter(F.size("symbols") > 0)
