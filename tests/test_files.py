"""Choosing, describing and indexing files."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmap import ScanOptions
from corpusmap.functions import describe as D
from corpusmap.functions import paths as P
from corpusmap.functions import text as T
from corpusmap.operators import audit as Q
from corpusmap.operators import drift as J
from corpusmap.operators import filters as L
from corpusmap.operators import ignore as I
from corpusmap.operators import index as A
from corpusmap.operators import render as R
from corpusmap.operators import symbols as Y
from corpusmap.sources import files as SF
from corpusmap.sources import store

def now():
    return F.expr("timestamp_ntz'2024-02-01 12:00:00'")

SCRIPT = "\n".join([
    'import { tides } from "./moon"', "", "export async function forecast(days: number) {", "  const out = tides(days)",
    "  return out.map((t) => t.height)", "}", "export const MAX_DAYS = 14", "class Buoy {", "  ping() {", "  }", "}",
    "type Knots = number", "export interface Reading {", "  at: Date", "}", "enum Sea { Calm, Rough }", "",
])


def one(spark, column, **values):
    """The value of an expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("v")).first()["v"]


def files(spark, *rows):
    """(path, text) pairs of one repository as a files table."""
    df = spark.createDataFrame([("r", p, t) for p, t in rows], "repo string, path string, text string")
    return df.withColumn("size_bytes", F.octet_length("text").cast("bigint")).withColumn("mtime", now())


@pytest.mark.parametrize("path, lang", [
    ("src/index.ts", "ts"), ("main.py", "py"), ("main.go", "go"), ("lib.rs", "rs"), ("README.MD", "md"),
    ("Makefile", "text"), ("a.d.ts", "ts"), ("x.tar.gz", "text"), ("dir.py/file", "text"),
])
def test_lang(spark, path, lang):
    assert one(spark, P.detect_lang(F.col("p")), p=path) == lang


def test_paths(spark):
    assert one(spark, P.ancestors(F.col("p")), p="a/b/c.ts") == ["", "a", "a/b"]
    assert one(spark, P.ancestors(F.col("p")), p="c.ts") == [""]
    assert one(spark, P.to_posix(F.col("p")), p="a\\b") == "a/b"


def test_first_meaningful_line(spark):
    text = "# tide tables\n\nimport sea\n// by harbour\n  class Tide:\n    high = 3\n"
    assert one(spark, T.first_meaningful_line(F.col("t"), 50), t=text) == "class Tide:"
    assert one(spark, T.first_meaningful_line(F.col("t"), 50), t="\t\n \n") == ""
    assert one(spark, T.first_meaningful_line(F.col("t"), 7), t="ebb and flow") == "ebb and…"
    assert one(spark, T.first_meaningful_line(F.col("t"), 10), t="\r\n  x  \r\ny") == "x"


@pytest.mark.parametrize("path, text, expected", [
    ("sea/kelp.ts", "export const depth = 3\nexport async function dive() {}\nexport class Reef {}\nexport type Fish = string\n"
     "export default dive", "Exports depth, dive, Reef, Fish, default dive"),
    ("quay.ts", "export const n = 1\nserver.get('/tides', now)\napp.put('/boats/:id/berth', moor)\n",
     "Defines GET /tides, PUT /boats/:id/berth"),
    ("s/haul.ts", "const Haul = z.object({ kg: z.number() })\n", "Defines a zod schema in haul.ts"),
    ("ebb.py", '"""Sort boats by draught."""\n\nclass Hull:\n    pass\n', "Sort boats by draught."),
    ("knots.py", "def reef(): ...\ndef bowline(): ...\ndef hitch(): ...\n", "3 functions"),
    ("quay.go", "package quay\n\nfunc dock() {}\nfunc (q *Quay) ServeHTTP(w http.ResponseWriter) {}\n",
     "package quay · 1 HTTP handler · 2 funcs"),
    ("package.json", '{"description": "Rope lengths by mast", "name": "halyard"}', "Rope lengths by mast"),
    ("package.json", '{"name": "halyard", "private": true}', "halyard"),
    ("package.json", '{"name": [', '{"name": ['),
    ("chart.xyz", "# soundings\n// in metres\n\nlet fathom = 1.83\n", "let fathom = 1.83"),
    ("a.txt", "", ""),
])
def test_describe(spark, path, text, expected):
    assert one(spark, D.describe(F.col("t"), F.col("p")), t=text, p=path) == expected


def test_ignore(spark):
    rules = ["# comment", "", "*.log", "!keep.log", "build/", "**/temp/**", "/anchored.txt"]
    extra = ["dist/", "src/generated/", "node_modules"]
    lines = [("r", "gitignore", i, x) for i, x in enumerate(rules)] + [("r", "extra", i, x) for i, x in enumerate(extra)]
    compiled = I.compile_rules(spark.createDataFrame(lines, "repo string, source string, rule_no int, line string"))
    dropped = [
        ("a.log", False), ("build", True), ("x/y/temp/z.txt", False), ("anchored.txt", False), ("dist", True),
        ("src/generated", True), ("src/generated/types.ts", False), ("dist/bundle.js", False),
        ("other/dist/bundle.js", False), ("node_modules", True), ("a/b/node_modules", True),
        ("build/keep.log", False), ("node_modules/dep.js", False),
    ]
    kept = [("keep.log", False), ("sub/anchored.txt", False), ("readme.md", False), ("src/index.ts", False),
            ("build", False), ("temp/z.txt", False)]
    paths = spark.createDataFrame([("r", p, d) for p, d in dropped + kept], "repo string, path string, is_dir boolean")
    assert {(r.path, r.is_dir) for r in I.apply_ignore(paths, compiled).collect()} == set(kept)
    # The same rules as literals, one source at a time.
    ignored = I.ignored_by(F.col("path"), rules, F.col("is_dir")) | I.ignored_by(F.col("path"), extra, F.col("is_dir"))
    assert {(r.path, r.is_dir) for r in paths.filter(~ignored).collect()} == set(kept)
    # A rule of another repository does not apply.
    other = paths.withColumn("repo", F.lit("other"))
    assert I.apply_ignore(other, compiled).count() == len(dropped + kept)


def test_negated_directory_rule_keeps_its_files(spark):
    rules = spark.createDataFrame(
        [("r", "gitignore", 0, "*.log"), ("r", "gitignore", 1, "!logs/")],
        "repo string, source string, rule_no int, line string")
    paths = spark.createDataFrame([("r", "logs/a.log"), ("r", "a.log")], "repo string, path string")
    assert [r.path for r in I.apply_ignore(paths, I.compile_rules(rules)).collect()] == ["logs/a.log"]


RULE_LINES = "repo string, source string, rule_no int, line string"


def test_rules_by_name_agree_with_patterns(spark):
    """Rules that meet paths by equality decide like the same rules as regular expressions."""
    rng = random.Random(11)
    names = ["a", "b", "a.b", "log", "x.log", ".log", "c d", "$v"]
    pool = [*names, "*.log", "*.b", "/a", "a/b", "a/*", "a/**", "b/a/**", "a/*/", "**/a", "*", "a?", "b*/", "/*.b", "a/**/b", "$v/**/"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    rows = [("r", p, d) for p in paths for d in (False, True)]
    df = spark.createDataFrame(rows, "repo string, path string, is_dir boolean").cache()
    for trial in range(3):
        lines = [("!" if rng.random() < 0.3 else "") + rng.choice(pool) + rng.choice(["", "", "/"]) for _ in range(3 + 3 * trial)]
        rules = spark.createDataFrame([("r", "gitignore", i, x) for i, x in enumerate(lines)], RULE_LINES)
        got = {(r.path, r.is_dir) for r in I.apply_ignore(df, I.compile_rules(rules)).collect()}
        want = df.filter(~I.ignored_by(F.col("path"), lines, F.col("is_dir"))).collect()
        assert got == {(r.path, r.is_dir) for r in want}, lines


def test_many_rules_of_one_repository(spark):
    """10,000 rules that name paths, one hot repository; no regular expression is needed, and texts stay out of the lookup."""
    lines = spark.range(10_000).selectExpr(
        "'hot' AS repo", "'gitignore' AS source", "cast(id AS int) AS rule_no",
        "CASE id % 4 WHEN 0 THEN concat('/src/f', id, '.py') WHEN 1 THEN concat('d', id, '/') "
        "WHEN 2 THEN concat('*.e', id) ELSE concat('!src/f', id - 3, '.py') END AS line")
    rules = I.compile_rules(lines.union(lines.filter("rule_no % 8 = 0").selectExpr("repo", "source", "rule_no + 20000", "line")))
    assert {r.kind for r in rules.select("kind").distinct().collect()} == {"path", "name", "ending"}
    made = spark.range(30_000).selectExpr(
        "CASE WHEN id % 10 = 9 THEN 'cold' ELSE 'hot' END AS repo", "id",
        "CASE id % 3 WHEN 0 THEN concat('src/f', id, '.py') WHEN 1 THEN concat('x/d', id, '/y.txt') ELSE concat('z.e', id) END AS path",
        "repeat('t', 50) AS text")
    kept = I.apply_ignore(made, rules)

    def dropped(n):
        if n % 10 == 9 or n >= 10_000:
            return False
        # Every fourth path is named, taken back by the rule after it, and named again at the end for every eighth.
        return (n % 3 == 0 and n % 8 == 0) or (n % 3 == 1 and n % 4 == 1) or (n % 3 == 2 and n % 4 == 2)

    assert {r.id for r in kept.collect()} == {n for n in range(30_000) if not dropped(n)}
    plan = I.ignored_paths(made, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "Cartesian" not in plan
    assert {r.path for r in I.apply_ignore(made.limit(0), rules).collect()} == set()
    assert I.apply_ignore(made, rules.filter("false")).count() == 30_000


def test_odd_keys_of_ignored_files(spark):
    """Null repositories and paths stay, repeated rows go or stay together, columns may bear the names of helpers."""
    rules = I.compile_rules(spark.createDataFrame([("r", "gitignore", 0, "a"), ("r", "extra", 0, "b*")], RULE_LINES))
    rows = [("r", "a", 1), ("r", "a", 2), (None, "a", 3), ("r", None, 4), ("r", "c", 5), ("r", "c", 5), ("r", "bb", 6), ("r", "", 7)]
    odd = spark.createDataFrame(rows, "repo string, path string, level int").withColumn("key", F.lit("a")).withColumn("_repo", F.lit("r"))
    assert sorted(r.level for r in I.apply_ignore(odd, rules).collect()) == [3, 4, 5, 5, 7]


SYMBOL_RULES = "extension string, pass int, pattern string"


def test_rules_of_a_user_in_the_index(spark):
    """A language of the user's own has symbols; its rules replace built-in ones; other files stay as they are."""
    rules = spark.createDataFrame(
        [(".knot", 1, r"^tie\s+(\w+)"), (".knot", 2, r"^(?:tie|bend)\s+(\w+)"), (".py", 1, r"^([A-Z]+)\s*="), (None, 1, "(x)"), (".ts", 1, None)],
        SYMBOL_RULES)
    made = files(spark, ("a.knot", "bend sheet\ntie reef\n  over\ntie reef\n"), ("b.py", "DEPTH = 3\ndef dive():\n    pass\n"),
                 ("c.ts", "export function sail() {\n}\n"), ("d.knot", ""), ("e.knot", None), ("f.txt", "tie x\n"))
    found = {(r.path, r.name, r.line, r["pass"], r.pos) for r in Y.extract_by_rules(made, rules).collect()}
    assert found == {("a.knot", "reef", 2, 1, 1), ("a.knot", "sheet", 1, 2, 2), ("b.py", "DEPTH", 1, 1, 1)}
    index = A.build_index(made, symbol_rules=rules)
    got = {r.path: [(s.name, s.line, s.end_line) for s in r.symbol_lines] for r in index.collect()}
    assert got == {"a.knot": [("sheet", 1, 1), ("reef", 2, 4)], "b.py": [("DEPTH", 1, 3)], "c.ts": [("sail", 1, 2)],
                   "d.knot": [], "e.knot": [], "f.txt": []}
    assert A.build_index(made, symbol_rules=rules.filter("false")).select("symbol_lines").exceptAll(
        A.build_index(made).select("symbol_lines")).count() == 0
    # The rules are the only thing that is shuffled.
    plan = Y.extract_by_rules(made, rules)._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_audit_rules_as_a_table(spark):
    rules = spark.createDataFrame(
        [(".sh", "remove all", "files", "HIGH", r"rm\s+-rf"), (".sh", "remove all", "files", "HIGH", r"rm\s+-rf"),
         (".sh", "curl", "net", "LOW", "curl"), (None, "none", "x", "LOW", "."), (".py", "none", "x", "LOW", None)],
        "extension string, rule string, layer string, severity string, pattern string")
    made = files(spark, ("a.sh", "  rm  -rf x; curl y\nls\n"), ("b.py", "rm -rf\n"), ("c.sh", None), ("d.sh", ""))
    found = {(r.path, r.line_no, r.rule, r.severity, r.line) for r in Q.audit_by_rules(made, rules).collect()}
    assert found == {("a.sh", 1, "remove all", "HIGH", "rm  -rf x; curl y"), ("a.sh", 1, "curl", "LOW", "rm  -rf x; curl y")}
    assert Q.audit_by_rules(made, rules).count() == 2 and Q.audit_by_rules(made, rules.filter("false")).count() == 0


def test_sensitive_hidden_valid(spark):
    secret = [".env", ".env.local", "keys/id_rsa", "prod/credentials.json", "a/.npmrc", "b/.pem", "c/.key", "x.PEM"]
    safe = [".env.example", "keys/README.md", "src/app.ts", "ID_RSA"]
    df = spark.createDataFrame([(p,) for p in secret + safe], "path string")
    assert {r.path for r in L.drop_sensitive(df).collect()} == set(safe)
    bad = ["../x", "a/../../x", "C:\\abs.ts", "/abs.ts", "..\\escape.ts", "....//..//x.ts", "../" * 8 + "etc/passwd"]
    df = spark.createDataFrame([(p,) for p in [*bad, "src/app.ts", "a..b/c"]], "path string")
    assert {r.path for r in L.valid_paths(df).collect()} == {"src/app.ts", "a..b/c"}
    df = spark.createDataFrame([(p,) for p in [".git/x", "a/.git", ".cache/x", "a.b"]], "path string")
    assert {r.path for r in L.drop_hidden(df).collect()} == {"a.b"}
    assert {r.path for r in L.drop_hidden(df, hidden=True).collect()} == {".cache/x", "a.b"}


@pytest.mark.parametrize("path, text, names", [
    ("a.ts", SCRIPT, ["forecast", "Buoy", "out", "MAX_DAYS", "Knots", "Reading", "Sea"]),
    ("a.py", "class Mast:\n    async def raise_sail(self): ...\ndef lower(): ...\nclass Mast: ...\n",
     ["raise_sail", "lower", "Mast"]),
    ("a.go", "package sea\ntype Wave interface {}\nfunc (w *swell) Break() {}\nfunc ebb() int { return 2 }\n",
     ["ebb", "Break", "Wave"]),
    ("a.c", "static long fathoms(long m)  {\n  while (m) { m--; }\n  return (m);\n}\nvoid drop_anchor() { if (1) { go(); } }\n",
     ["fathoms", "drop_anchor"]),
    ("a.java", "interface Rig {}\nabstract class Yawl {\n  protected Map<Rig, Long> trim(long wind) {\n    while (wind > 0) { ease(); }\n"
     "  }\n}\n", ["Yawl", "Rig", "trim"]),
    ("a.rb", "module M\n  class A::B\n    def go\n", ["M", "A::B", "go"]),
    ("a.php", "public static function run($a) {\nfinal class K {\n", ["run", "K"]),
    ("a.swift", "public func go() {}\nstruct S {}\n", ["go", "S"]),
    ("a.rs", "pub fn main() {}\npub(crate) struct S {}\nmod m;\n", ["main", "S", "m"]),
    ("a.md", "class X\n", []),
])
def test_symbols(spark, path, text, names):
    rows = Y.extract_symbols(files(spark, (path, text))).orderBy("pos").collect()
    assert [r.name for r in rows] == names


def test_symbol_cap(spark):
    text = "\n".join(f"export const v{i} = {i}" for i in range(30))
    assert Y.extract_symbols(files(spark, ("a.ts", text)), 8).count() == 8


def test_toplevel_spans(spark):
    rows = Y.toplevel_spans(files(spark, ("a.ts", SCRIPT))).orderBy("line").collect()
    assert [(r.name, r.line, r.end_line) for r in rows] == [
        ("forecast", 3, 6), ("MAX_DAYS", 7, 7), ("Buoy", 8, 11), ("Knots", 12, 12), ("Reading", 13, 15), ("Sea", 16, 16)]
    assert all(r.tokens > 0 for r in rows)


@pytest.mark.parametrize("path, text, names", [
    ("a.py", "class Mast:\n    def bend(self): ...\nasync def hoist(): ...\n", ["Mast", "hoist"]),
    ("a.go", "package sea\ntype Wave interface {}\nfunc (w *swell) Break() {}\nfunc ebb() int { return 2 }\n",
     ["Wave", "Break", "ebb"]),
    ("a.rs", "trait Float {}\nimpl<T> Raft {\n    fn drift() {}\n}\npub(crate) enum Tide { Ebb }\nasync fn steer() {}\nstruct Oar;\n",
     ["Float", "Raft", "Tide", "steer", "Oar"]),
    ("a.java", "interface Rig {}\nabstract class Yawl {\n  class Mizzen {}\n}\n", ["Rig", "Yawl"]),
    ("a.txt", "class Yawl {}\n", []),
])
def test_span_languages(spark, path, text, names):
    rows = Y.toplevel_spans(files(spark, (path, text))).orderBy("line").collect()
    assert [r.name for r in rows] == names


@pytest.mark.parametrize("path, text, spans", [
    ("a.java", "package p;\npublic class Box\n{\n  void go()\n  {\n  }\n}\n// class No\nclass Lid { }\n",
     [("Box", 2, 7), ("Lid", 9, 9)]),
    ("b.java", 'class T {\n  String s = """\nclass No {\n""";\n  char c = \'}\', q = \'\\\'\';\n}\nclass U {}\n',
     [("T", 1, 6), ("U", 7, 7)]),
    ("a.ts", "export function view() {\n  return `\nfunction no() {\n${a ? `x}` : \"}\"}\n`\n}\nconst low = 1 // }\n/*\n"
     "function ghost() {}\n*/\nfunction last() {}\n", [("view", 1, 6), ("low", 7, 7), ("last", 11, 11)]),
    ("b.js", 'const mark = /[{"]/g\nfunction swap(x) {\n  return x.replace(/\\/}/, "{")\n}\n', [("mark", 1, 1), ("swap", 2, 4)]),
    ("a.py", '"""about\ndef no(): pass\n"""\ndef f(x):\n    """\nat the margin\ndef ghost(): pass\n    """\n    return """\n'
     'class G:\n"""\n\n# note\nclass K:\n    pass\nx = {\n}\ndef g(): pass\n', [("f", 4, 11), ("K", 14, 15), ("g", 18, 18)]),
    ("a.go", "package m\nfunc F() {\n s := `\nfunc G() {\n`\n r := '{'\n}\ntype T struct {\n}\n", [("F", 2, 7), ("T", 8, 9)]),
    ("a.rs", "pub fn a<'a>(x: &'a str) {\n    let s = r#\"\nfn ghost() {\n\"#;\n    let t = \"\nstruct No;\n\";\n}\nstruct S;\n",
     [("a", 1, 8), ("S", 9, 9)]),
    ("a.kt", "class A(\n  val x: Int,\n)\n{\n}\n\nclass B\n", [("A", 1, 5), ("B", 7, 7)]),
    # Brackets that do not balance: the margin decides. Texts that end inside a literal, and none at all.
    ("bad.ts", "function a() {\n}}\nfunction b() {\n}\n", [("a", 1, 2), ("b", 3, 4)]),
    ("open.ts", "function a() {}\nconst s = `\nfunction no() {}\n", [("a", 1, 1), ("s", 2, 3)]), ("tick.ts", "`", []), ("none.ts", "", []),
    ("crlf.ts", "function a()\r\n{\r\n}\r\nclass B {}\r\n", [("a", 1, 3), ("B", 4, 4)]),
])
def test_exact_spans(spark, path, text, spans):
    rows = Y.toplevel_spans(files(spark, (path, text))).orderBy("line").collect()
    assert [(r.name, r.line, r.end_line) for r in rows] == spans


def test_large_files(spark):
    """Long literals cost no stack, and many declarations no square of their number."""
    long = "const a = `" + "x\n$ {" * 50_000 + "`\nconst b = \"" + '\\"' * 50_000 + '"\n/*' + "*" * 90_000 + "*/\nlet d = 2"
    many = "".join(f"export function f{i}(a) {{\n  return a\n}}\n" for i in range(30_000))
    rows = Y.toplevel_spans(files(spark, ("a.ts", long), ("b.ts", many))).groupBy("path").agg(
        F.count("*").alias("n"), F.max("end_line").alias("end"), F.sum(F.col("end_line") - F.col("line")).alias("inside"))
    assert {tuple(r) for r in rows.collect()} == {("a.ts", 3, 50_004, 50_000), ("b.ts", 30_000, 90_000, 60_000)}
    assert Y.extract_symbols(files(spark, ("b.ts", many + "function f7() {}\n"))).count() == 30_000


def test_routes_are_all_counted(spark):
    text = "".join(f'app.get("/r{i % 10}", f)\n' for i in range(13))
    assert one(spark, D.describe_routes(F.col("t")), t=text, p="a.ts") == "Defines GET /r0, GET /r1, GET /r2, GET /r3 +6 more"


def test_spans_never_end_before_they_start(spark):
    # Pattern order differs from line order here, and the last line is not terminated.
    rows = Y.symbol_spans(files(spark, ("a.ts", "const a = 1\nfunction b() {}\nconst c = 3"))).orderBy("line").collect()
    assert [(r.name, r.line, r.end_line) for r in rows] == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]


def test_backends_agree_and_fall_back(spark):
    tree = files(
        spark, ("sea/tide.ts", "export const LOW = 1\nexport interface Gauge { mm: number }\nclass Pier {}\nfunction ebb() {}\n"),
        ("sea/mast.py", "class Mast:\n    pass\ndef hoist():\n    pass\n"),
        ("sea/wave.go", "package sea\ntype Wave interface {}\nfunc ebb() {}\n"))

    def names(**kw):
        index = A.build_index(tree, ScanOptions(**kw))
        return {r.path: r.symbols for r in index.select("path", "symbols").collect()}

    assert names() == names(symbol_backend="regex")
    indented = files(spark, ("a.ts", "  function inner() {}\n"))
    for backend in ("spans", "auto", "regex"):
        opts = ScanOptions(symbol_backend=backend)
        assert A.build_index(indented, opts).first().symbols == ["inner"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, body in {
        "src/index.ts": "export const LOW = 1\nexport function ebb() {\n  return LOW\n}\nclass Pier {}\n",
        "src/wave.go": "package sea\n", "README.md": "# Demo\n\nHello wörld\n", "node_modules/dep.js": "x\n",
        ".hidden-dir/secret.txt": "s\n", "src/__init__.py": "", "debug.log": "l\n", "keys/id_rsa": "k\n", "bin.dat": "a\0b", "big.txt": "x" * 2000,
    }.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_text(body)
    (root / "latin.md").write_bytes("café noir\n".encode("latin-1"))
    return str(root)


def test_scan_tree(spark, tree):
    opts = ScanOptions(max_file_bytes=1024)
    index = A.build_index(SF.read_text_files(spark, tree, opts=opts, repo="r"), opts).cache()
    rows = {r.path: r for r in index.collect()}
    # Spark's source leaves out names that begin with an underscore or a dot.
    assert set(rows) == {"src/index.ts", "src/wave.go", "README.md", "latin.md", "bin.dat", "big.txt"}
    whole = A.build_index(SF.read_text_files(spark, tree, repo="r"))
    assert {r.path: r.tokens for r in whole.collect()}["big.txt"] == 500 and whole.filter("skipped").count() == 1
    ts = rows["src/index.ts"]
    assert (ts.lang, ts.lines, ts.summary) == ("ts", 5, "Exports LOW, ebb")
    assert ts.symbols == ["LOW", "ebb", "Pier"]
    assert (rows["bin.dat"].summary, rows["bin.dat"].lang, rows["bin.dat"].skipped) == ("[binary]", "binary", True)
    assert (rows["big.txt"].summary, rows["big.txt"].lines, rows["big.txt"].tokens) == ("[file too large]", 0, 500)
    assert rows["README.md"].size_bytes == rows["README.md"].n_chars + 1
    assert rows["latin.md"].summary == "caf\ufffd noir"
    assert "src/index.ts" in {r.path for r in SF.list_files(spark, tree, "r").collect()}
    capped = A.build_index(SF.read_text_files(spark, tree, repo="r"), ScanOptions(max_files=2))
    assert sorted(r.path for r in capped.collect()) == ["README.md", "big.txt"]
    for totals in (A.corpus_totals(index, max_files=2).first(), A.corpus_totals(capped).first()):
        assert (totals.files, totals.truncated, totals.skipped_files >= 4) == (2, True, True)


def test_inventory_tells_what_cannot_be_read(spark, tree):
    inventory = spark.createDataFrame(
        [("r", "README.md", 21), ("r", "gone.md", 5), ("r", "src/__init__.py", 0)], "repo string, path string, size_bytes bigint"
    ).withColumn("mtime", now())
    got = {r.path: (r.text, r.skip_reason) for r in SF.read_text_files(spark, tree, inventory, repo="r").collect()}
    assert got == {"README.md": ("# Demo\n\nHello wörld\n", None), "gone.md": (None, "[unreadable]"),
                   "src/__init__.py": (None, "[unreadable]")}


def moved_columns(df):
    """The columns that a shuffle or a broadcast of the plan carries."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    inputs = re.findall(r"(?:Exchange|BroadcastExchange)\s*\nInput \[\d+\]: \[(.*)\]", text)
    return len(inputs), {c.split("#")[0].strip() for i in inputs for c in i.split(",")}


def test_index_of_an_inventory_moves_no_text(spark, tree):
    inventory = SF.list_files(spark, tree, "r").filter("path <> 'README.md'").unionByName(
        spark.createDataFrame([("r", "gone.ts", 5)], "repo string, path string, size_bytes bigint").withColumn("mtime", now()))
    plain = A.build_index(SF.read_text_files(spark, tree, inventory, repo="r"))
    index = SF.index_tree(spark, tree, inventory, repo="r")
    assert index.columns == plain.columns
    got = sorted(map(str, index.collect()))
    assert got == sorted(map(str, plain.collect())) and any("gone.ts" in r for r in got) and not any("README" in r for r in got)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for an inventory too long to send
    try:
        n, columns = moved_columns(SF.index_tree(spark, tree, inventory, repo="r"))
        assert n >= 4 and "path" in columns and not columns & {"content", "text"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert SF.index_tree(spark, tree, inventory.limit(0), repo="r").count() == 0


def test_written_files_make_no_folder_each(spark, tmp_path):
    """One folder per repository; a name that comes twice is one file, nulls have Spark's name, contents stay as they are."""
    rows = [("r/1", f"a b/f{i}.txt", f"täxt {i}".encode()) for i in range(40)]
    rows += [("r/1", "twice", b"x"), ("r/1", "twice", b"x"), ("q", "latin", b"caf\xe9"), ("q", "none", None), (None, "p", b"p")]
    root = str(tmp_path / "out")
    key = SF.write_files(spark.createDataFrame(rows, "repo string, path string, content binary"), root, "\x01")
    folders = sorted(os.path.relpath(at, root) for at, _, _ in os.walk(root))
    assert folders == [".", "repo=__HIVE_DEFAULT_PARTITION__", "repo=q", "repo=r%2F1"]
    found = {(r.repo, r.path): (r.text, r.size_bytes) for r in SF.read_text_files(spark, root, key=key).collect()}
    assert len(found) == 44 and found["r/1", "a b/f7.txt"] == ("täxt 7\x01", 8) and found["r/1", "twice"] == ("x\x01x\x01", 4)
    assert found["q", "latin"] == ("caf\ufffd\x01", 5) and found["q", "none"] == ("\x01", 1)
    assert ("__HIVE_DEFAULT_PARTITION__", "p") in found
    empty = str(tmp_path / "empty")
    key = SF.write_files(spark.createDataFrame([], "repo string, path string, content binary"), empty, "\x01")
    assert SF.read_text_files(spark, empty, key=key).count() == 0


def test_small_inventory_is_sent_to_the_files(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    for i in range(5):
        (tmp_path / "tree" / f"f{i}.txt").write_text(f"{i}\n" * 100_000)
    root = str(tmp_path / "tree")
    SF.list_files(spark, root, "r").filter("path <> 'f3.txt'").write.parquet(str(tmp_path / "inventory"))
    files = SF.read_text_files(spark, root, spark.read.parquet(str(tmp_path / "inventory")), repo="r")
    n, columns = moved_columns(files)
    assert n >= 1 and not columns & {"content", "text"}
    assert {r.path: len(r.text) for r in files.collect()} == {f"f{i}.txt": 200_000 for i in (0, 1, 2, 4)}


def test_nothing_drifts_between_two_listings(spark, tree):
    index = A.build_index(SF.read_text_files(spark, tree, repo="r"))
    # Nothing drifted between two listings, although a file holds more bytes than characters.
    assert J.drift(A.manifest(index), SF.list_files(spark, tree, "r").join(index, ["repo", "path"], "left_semi")).count() == 0


def test_rules_from_the_tree(spark):
    texts = files(spark, (".gitignore", "# rules\r\ngen/\n*.dat\n!keep.dat\n"), ("sub/.gitignore", "*"), ("a.py", "x = 1\n"),
                  ("gen/b.py", "y = 1\n"), ("c.dat", "c"), ("keep.dat", "k"))
    rules = I.compile_rules(I.gitignore_lines(texts))
    index = A.build_index(texts, gitignore=rules)
    assert sorted(r.path for r in index.collect()) == ["a.py", "keep.dat"]
    # A refresh does not bring ignored files back, and takes newly ignored ones out.
    listing = texts.drop("text")
    assert sorted(r.path for r in J.refresh_index(index, listing, texts, gitignore=rules).collect()) == ["a.py", "keep.dat"]
    every = A.build_index(texts)
    assert sorted(r.path for r in J.refresh_index(every, listing, texts, gitignore=rules).collect()) == ["a.py", "keep.dat"]


def test_nothing_is_cut_by_default(spark):
    many = files(spark, *[(f"d/f{i:04}.md", "x\n") for i in range(5000)])
    index = A.build_index(many)
    totals = A.corpus_totals(index).first()
    assert (index.count(), totals.files, totals.truncated) == (5000, 5000, False)
    long = files(spark, ("long.py", "".join(f"def f{i}():\n    pass\n" for i in range(3000))), ("nul.md", "x" * 20_000 + "\0"))
    rows = {r.path: r for r in A.build_index(long).collect()}
    assert len(rows["long.py"].symbols) == 3000 and rows["long.py"].lines == 6000 and rows["nul.md"].skipped


def test_repo_per_folder(spark, tree):
    listed = SF.list_files(spark, tree)
    assert {r.path for r in listed.filter("repo = 'src'").collect()} == {"index.ts", "wave.go"}


def test_dir_rollup(spark):
    index = spark.createDataFrame(
        [("r", "src/a.ts", 10, 5), ("r", "src/deep/b.ts", 20, 8), ("r", "root.ts", 30, 3)],
        "repo string, path string, size_bytes long, lines long")
    got = {r.dir: (r.files, r.lines, r.bytes) for r in A.dir_rollup(index).collect()}
    assert got == {"": (3, 16, 60), "src": (2, 13, 30), "src/deep": (1, 8, 20)}


def test_map_and_block(spark):
    tree = files(spark, ("src/index.ts", "export function main() {}\n"), ("src/util.ts", "export const util = 1\n"),
                 ("README.md", "# Demo\n"))
    index = A.build_index(tree)
    text = R.render_map(index, now(), 65536).first()
    assert not text.truncated
    assert text.text == (
        "# Code Map\nGenerated 2024-02-01T12:00:00Z · 3 files · 3 lines\n\n## ./\n- `README.md` — 1 lines\n\n"
        "## src\n- `src/index.ts` — 1 lines · main · Exports main\n- `src/util.ts` — 1 lines · util · Exports util")
    cut = R.render_map(index, now(), 128).first()
    assert cut.truncated and len(cut.text) <= 128 + 64
    block = R.render_block(index, now(), 4096)
    none = spark.createDataFrame([], "repo string, body string")
    first = R.splice_block(none, block)
    assert first.first().changed
    docs = first.select("repo", F.col("text").alias("body"))
    assert not R.splice_block(docs, block).first().changed
    framed = docs.select("repo", F.concat(F.lit("# Project\n\n"), F.col("body"), F.lit("\n\nCustom footer.\n")).alias("body"))
    later = R.render_block(index, F.expr("timestamp_ntz'2025-01-01 00:00:00'"), 4096)
    updated = R.splice_block(framed, later).first()
    assert updated.changed and updated.text.startswith("# Project\n\n") and updated.text.endswith("\n\nCustom footer.\n")
    assert updated.text.count(R.BLOCK_START) == 1


def test_map_limits(spark):
    rows = [("r", f"d{d:02}/f{f:02}.md", "x\n") for d in range(41) for f in range(61 if d == 0 else 1)]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    df = df.withColumn("size_bytes", F.lit(2).cast("bigint")).withColumn("mtime", now())
    text = R.render_map(A.build_index(df), now(), 1 << 20).first().text
    assert text.count("## d") == 40 and "… 1 files more" in text and text.endswith("… 1 more directory not shown")


def test_anatomy_and_edits(spark):
    index = A.build_index(files(spark, ("src/a.ts", "export function main() {\n  go()\n}\n")))
    rows = {r.path: r.body for r in R.render_anatomy(index, now()).collect()}
    assert rows[""].startswith("# Anatomy") and "Files: 1 tracked" in rows[""]
    assert rows["src/a.ts"] == "- `src/a.ts` (~9 tok) — Exports main\n  symbols: main L1-3 ~7 tok"
    fresh = spark.createDataFrame([("r", "new")], "repo string, body string")
    digest = lambda s: T.content_hash(F.lit(s))

    def run(existing, last):
        have = spark.createDataFrame([("r", existing)] if existing is not None else [], "repo string, body string")
        seen = spark.createDataFrame([("r",)], "repo string").withColumn("hash", digest(last) if last else F.lit(None))
        return R.absorb_edits(have, fresh, seen).first()

    assert run("new", "new").action == "unchanged"
    assert run("old", "old").action == "replaced" and run(None, None).action == "replaced"
    edited = run("old\n\nkeep this\n", "old")
    assert edited.action == "absorbed"
    assert edited.text == "old\n\nkeep this\n\n## Index as of now\n\nnew"


def test_file_digest(spark):
    tree = files(spark, ("a.ts", "const x = 1\n" * 100), ("big.txt", "x" * 3000))
    wanted = spark.createDataFrame([("r", p) for p in ("a.ts", "big.txt", "../a.ts", "gone")], "repo string, path string")
    got = {r.path: r for r in A.file_digest(wanted, tree, ScanOptions(max_file_bytes=2000), 300).collect()}
    assert got["a.ts"].exists and got["a.ts"].symbols[0] == "x" and got["a.ts"].tokens == 300
    assert len(got["a.ts"].preview) == 300 and got["a.ts"].preview_truncated
    assert got["big.txt"].preview == "[file too large]" and got["big.txt"].preview_truncated
    assert not got["../a.ts"].exists and not got["gone"].exists


def test_store(spark, tmp_path):
    index = A.build_index(files(spark, ("a.ts", SCRIPT)))
    store.write_index(index, str(tmp_path / "index"))
    back = store.read_index(spark, str(tmp_path / "index"))
    assert back.select(index.columns).collect() == index.collect()
    path = str(tmp_path / "snap")
    for tag, n in (("20240101", 1), ("20240102", 2)):
        store.write_snapshot(spark.range(n), path, tag)
        store.write_snapshot(spark.range(n), path, tag)
    assert [r.snapshot_id for r in store.list_snapshots(spark, path).collect()] == ["20240102", "20240101"]
    assert store.read_snapshot(spark, path).count() == 2 and store.read_snapshot(spark, path, "20240101").count() == 1
    with pytest.raises(ValueError, match="snapshot not found: x"):
        store.read_snapshot(spark, path, "x")


def test_snapshots_store_what_changed(spark, tmp_path):
    path = str(tmp_path / "history")
    with pytest.raises(ValueError, match="no snapshots found"):
        store.read_snapshot(spark, path)
    made = {}
    for day in range(10):
        tag = f"0{day}"  # not a number to the store
        df = spark.range(3000).select("id", F.when(F.col("id") % 100 == day, F.lit(day)).alias("v"), (F.col("id") % 7).alias("g"))
        store.write_snapshot(df, path, tag)
        made[tag] = df
    sizes = {r.snapshot_id: (r.n_rows, r.n_changes) for r in store.list_snapshots(spark, path).collect()}
    assert sizes["00"] == (3000, 3000) and all(n == (3000, 120) for tag, n in sizes.items() if tag != "00")
    for tag in ("00", "04", "09"):
        back = store.read_snapshot(spark, path, tag)
        assert back.columns == made[tag].columns and sorted(map(str, back.collect())) == sorted(map(str, made[tag].collect()))
    with pytest.raises(ValueError, match="a later snapshot"):
        store.write_snapshot(made["03"], path, "03")


def test_snapshots_keep_copies_and_returns(spark, tmp_path):
    """Equal rows are counted, a row may go and come back, a table may be empty, columns may be added."""
    path, schema = str(tmp_path / "bag"), "a int, m map<string,int>, s struct<x:string>"
    x, y, none = (1, {"k": 1}, ("é\n",)), (2, None, (None,)), (None, None, None)
    tables = {"a": [x, x, y, none], "b": [x, none, none], "c": [], "d": [x, x, y]}
    for tag, rows in tables.items():
        store.write_snapshot(spark.createDataFrame(rows, schema), path, tag)
    store.write_snapshot(spark.createDataFrame([x], schema).withColumn("new", F.lit(5)), path, "e")
    store.write_snapshot(spark.createDataFrame([y], schema).withColumn("new", F.lit(6)), path, "e")
    as_text = lambda rows: sorted(str(tuple(r)) for r in rows)
    for tag, rows in tables.items():
        want = spark.createDataFrame(rows, schema).collect()
        assert as_text(store.read_snapshot(spark, path, tag).collect()) == as_text(want)
    assert as_text(store.read_snapshot(spark, path).collect()) == as_text(
        spark.createDataFrame([(*y, 6)], schema + ", new int").collect())
    with pytest.raises(ValueError, match="names that the store uses"):
        store.write_snapshot(spark.range(1).withColumnRenamed("id", "_key"), path, "f")


def test_refresh(spark):
    opts = ScanOptions(max_files=2)
    old = A.build_index(files(spark, ("a.md", "a\n"), ("b.md", "b\n"), ("gone.md", "g\n")), ScanOptions())
    new = files(spark, ("a.md", "a\n"), ("b.md", "b, longer\n"), ("c.md", "c\n"))
    out = {r.path: r.reused for r in J.refresh_index(old, new.drop("text"), new).collect()}
    assert out == {"a.md": True, "b.md": False, "c.md": False}
    assert J.refresh_index(old, new.drop("text"), new, opts).count() == 2
    patched = {r.path: r.n_chars for r in J.patch_files(old, A.build_index(new)).collect()}
    assert patched == {"a.md": 2, "b.md": 10, "gone.md": 2}


def test_staleness(spark):
    state = spark.createDataFrame(
        [("old", "2024-02-01 00:00:00", "abc"), ("fresh", "2024-02-01 11:00:00", "abc"), ("never", None, None),
         ("moved", "2024-02-01 11:00:00", "abc")], "repo string, at string, git_head string",
    ).select("repo", F.col("at").cast("timestamp_ntz").alias("last_scanned"), "git_head")
    heads = spark.createDataFrame([("moved", "def"), ("fresh", None)], "repo string, git_head string")
    got = {r.repo: r.reason for r in J.staleness(state, heads, 6, now()).collect()}
    assert got == {"old": "last scanned 12h ago", "fresh": None, "never": None, "moved": "git HEAD moved since last scan"}


def test_a_large_file_is_spread_by_its_rows(spark, tmp_path):
    """Splits of one row group leave all its rows in one task; what counts is the rows that a task gets."""
    from corpusmap import session

    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        spread = session.spread(table, "id")
        sizes = [n for (n,) in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 100_000 and max(sizes) < 2 * session.ROWS_A_TASK
    assert session.spread(spark.createDataFrame([], "id long"), "id").count() == 0


def test_rules_need_what_their_matches_hold(spark):
    """Texts are searched for what rules need first; the findings are those of the patterns alone."""
    lines = [
        '"postinstall": "x"', '"prepare" : 1', "-----BEGIN RSA PRIVATE KEY-----", "PassWord = hunter22", "pwd:abcd", 'PASSWD="abcd"',
        "Api-Key: abcdefgh1", "apikey=abcdefgh1", "SECRET = abcdefgh1", "access_token:abcdefgh1", "AccessToken=abcdefgh1", "bEARER abcdefgh",
        "Postgres://a:b@c", "eval (x)", "exec(x)", "child_process", "os.system(x)", "shell = True", "subprocess.call(x)",
        "\"SELECT a\" + b", "'delete x' % y", "`Update t`.format", "'insert x' + y", "dangerouslySetInnerHTML", "a.innerHTML = b",
        "Access-Control-Allow-Origin: *", "secret", "a bearer of news", "İnnerHTML=", "seKret=abcdefgh1",
    ]
    rows = [("r", f"f{i}", f"plain\r\n{line}\nmore") for i, line in enumerate(lines)] + [("r", "none", None), ("r", "all", "\n".join(lines))]
    files = spark.createDataFrame(rows, "repo string, path string, text string")
    found = {tuple(r) for r in Q.audit_lines(files).collect()}
    plain = [r._replace(needs=()) for r in Q.AUDIT_RULES]
    assert all(r.needs or r.on_path for r in Q.AUDIT_RULES) and len(found) > 50
    assert found == {tuple(r) for r in Q.audit_lines(files, plain).collect()}


def test_no_split_by_a_pattern_where_the_text_lacks_the_mark(spark):
    """Comments and literals go by a replacement; a text that holds its mark is split by the pattern, with equal spans."""
    text = "// a\nexport function f() {{\n  return `{0}` // {{\n}}\n/* class No {{\n*/\nclass K {{\n}}\n"
    rows = [("r", "a.ts", text.format("x")), ("r", "b.ts", text.format("￿")), ("r", "c.ts", "")]
    files = spark.createDataFrame(rows, "repo string, path string, text string")
    spans = {p: sorted((r.name, r.line, r.end_line, r.tokens) for r in Y.toplevel_spans(files).collect() if r.path == p) for p in ("a.ts", "b.ts")}
    assert spans["a.ts"] == spans["b.ts"] and [s[:3] for s in spans["a.ts"]] == [("K", 7, 8), ("f", 2, 4)]
    assert "regexp_replace(text" in Y._code_sql()
