"""Knowledge, digests, merges, ledgers, sessions and schedules."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmap.operators import access as E
from corpusmap.operators import digest as G
from corpusmap.operators import drift as J
from corpusmap.operators import fleet as R
from corpusmap.operators import knowledge as K
from corpusmap.operators import ledger as L
from corpusmap.operators import merge as M
from corpusmap.operators import schedule as T
from corpusmap.operators import views as V
from corpusmap.schemas import BUGS, HANDOFF, LEARNED, LEDGER, SCAN_STATE, TASKS, USAGE_EVENTS
from corpusmap.sources import documents as D
from corpusmap.sources import store as Store
from corpusmap.streaming import usage as U

DAY = dt.datetime(2026, 8, 15, 2, 30, 45)


def at(text):
    return F.expr(f"timestamp_ntz'{text}'")


def test_extract_section(spark):
    docs = spark.createDataFrame([
        ("a", "## 🚀 Next phase\n\nfinish the port\n\n## ✅ Done\n\nthings\n"), ("b", "no heading"),
        ("c", "x\n## 🚀 One\nbody\n---\nrest"), ("d", "## 🚀 Last\r\nline")], "repo string, text string")
    got = {r.repo: r.section for r in D.extract_section(docs, G.NEXT_PHASE).collect()}
    assert got == {"a": "## 🚀 Next phase\n\nfinish the port", "c": "## 🚀 One\nbody", "d": "## 🚀 Last\nline"}


def digest(spark, note, budget, estimate=G.prose_tokens, learned=(), bugs=(), files=None):
    out = G.session_digest(
        spark.createDataFrame([("r", DAY, note)], HANDOFF), spark.createDataFrame(list(learned), LEARNED),
        spark.createDataFrame(list(bugs), BUGS),
        spark.createDataFrame([("r", DAY, "abc", files, 1)] if files else [], SCAN_STATE), budget, estimate).collect()
    return out[0].digest if out else ""


def test_digest(spark):
    note = "# STATUS\n\n## 🚀 Next phase\n\nship v0.2\n\n## ✅ Done\n"
    learned = [("r", "Do-Not-Repeat", i, f"entry {i}", DAY) for i in range(12)]
    bugs = [("r", f"b{i}", f"error {i}", "x" * 200, None, DAY + dt.timedelta(minutes=i), None) for i in range(6)]
    text = digest(spark, note, 2000, learned=learned, bugs=bugs, files=7)
    parts = text.split("\n\n## ")
    assert text.startswith("## 🚀 Next phase\n\nship v0.2") and "tracks 7 files" in text
    assert "entry 11" in text and "entry 1\n" not in text and text.count("- entry") == 10
    lines = [p for p in parts if p.startswith("Bugs with a known fix")][0].split("\n")[1:6]
    assert [x[:7] for x in lines] == [f"error {i}" for i in range(1, 6)]
    assert all(len(x) == 140 and x.endswith("...") for x in lines)


def test_digest_budget(spark):
    long = "## 🚀 Next phase\n\n" + "x" * 6000 + "\n"
    assert digest(spark, long, 50) == "" and digest(spark, long, 2000).startswith("## 🚀")
    # The first section is too large, a later one still fits.
    assert "tracks 7 files" in digest(spark, long, 50, files=7)
    short = "## 🚀 Next phase\n\n" + "y" * 40 + "\n"
    assert digest(spark, short, 50, lambda t: F.length(t)) == ""
    assert "Next phase" in digest(spark, short, 100)
    assert digest(spark, short, 100, lambda t: F.length(t) * 10) == ""
    # No price: a quarter of the characters, 58 / 4.
    assert "Next phase" in digest(spark, short, 15, lambda t: F.lit(None)) and digest(spark, short, 14, lambda t: F.lit(None)) == ""


def test_digest_warning(spark):
    state = spark.createDataFrame([("r", DAY, "abc", 1, 1)], SCAN_STATE)
    heads = spark.createDataFrame([("r", "abc")], "repo string, git_head string")
    none = spark.createDataFrame([], "repo string, digest string")
    out = G.digest_with_warning(none, state, heads, 6, at("2026-08-16 02:30:45")).first()
    assert out.digest == "⚠ the index is out of date (last scanned 24h ago); a refresh is due.\n\n"


def test_bugs(spark):
    none = spark.createDataFrame([], BUGS)
    new = spark.createDataFrame(
        [("r", "Rudder: no answer at the helm", "took up the slack", "sea/helm.py", DAY),
         ("r", "E" * 600, "F" * 3000, None, DAY + dt.timedelta(hours=3))],
        "repo string, error_message string, fix string, file string, at timestamp_ntz")
    log = K.log_bugs(none, new).cache()
    rows = log.orderBy("at").collect()
    assert rows[0].id.startswith("bug-1-") and rows[1].id.startswith("bug-2-")
    millis = int(rows[0].id.split("-")[2], 36)
    assert millis == int(DAY.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert (len(rows[1].error_message), len(rows[1].fix)) == (600, 3000)
    assert K.search_bugs(log, "rudder: NO").count() == 1 and K.search_bugs(log, "").count() == 2
    assert K.search_bugs(log, "HELM.PY").count() == 1 and K.search_bugs(log, "nothing").count() == 0
    assert [r["rank"] for r in V.bug_view(log).collect()] == [1, 2]


TERMS = ["", "a", "ab", "abc", "rope", "ROPE  fr", "é", "ée😀", "😀😀", "winch.py", "not there", "xyzx", "aaaa", "fix 7"]


def test_search_by_an_index(spark, tmp_path):
    """The rows of the plain search, also for short terms, other scripts, null fields and records added later."""
    rng = random.Random(3)
    pieces = ["rope frays", "abcabc", "ée😀😀", "yard/Winch.PY", "aaaaa", "xyz", "xyx", "", "Rope  Frets", "fix 7", None]
    rows = [(rng.choice("rq"), f"b{i}", rng.choice(pieces[:-1]), rng.choice(pieces), rng.choice(pieces), DAY + dt.timedelta(minutes=i), None)
            for i in range(120)]
    bugs = spark.createDataFrame(rows, BUGS).cache()
    path = str(tmp_path / "grams")
    Store.write_bug_index(bugs.filter("id < 'b5'"), path)
    Store.write_bug_index(bugs.filter("id >= 'b5'"), path, append=True)
    grams, counts = Store.read_bug_index(spark, path)
    rows_of = lambda df: sorted((r["repo"], r["rank"], r["id"]) for r in df.collect())
    for term in TERMS:
        assert rows_of(K.search_bug_index(bugs, grams, counts, term)) == rows_of(K.search_bugs(bugs, term)), term
    assert K.search_bug_index(bugs, grams, counts, "abc", limit=1).count() <= 2
    assert counts.agg(F.sum("n")).first()[0] == grams.count() == grams.distinct().count()
    plan = grams.filter(F.col("gram").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    # What is read through is what holds the rarest runs, not the table.
    held = grams.filter(F.col("gram") == F.xxhash64(F.lit("fix"))).count()
    assert 0 < held < bugs.count() / 2


def test_append_learned(spark):
    old = spark.createDataFrame([("r", "Preferences", 4, "old", DAY)], LEARNED)
    new = spark.createDataFrame(
        [("r", None, "two\nlines", DAY), ("r", "Conventions", "use 2-space indent", DAY)],
        "repo string, section string, entry string, at timestamp_ntz")
    got = {(r.section, r.seq, r.entry) for r in K.append_learned(old, new).collect()}
    assert got == {("Preferences", 4, "old"), ("Preferences", 5, "two lines"), ("Conventions", 1, "use 2-space indent")}


LEARNED_MD = ("# The yard\n\n## Conventions\n- paint hulls in spring\n- [2025-04-11] sand before paint\n- [2025-04-12] two coats\n\n"
              "## Do-Not-Repeat\n- launching at low tide\n")
LOG_MD = "| 2025-05-04 07:15 | Edited yard/slip.py | widened | ~45 |\n| --- | --- | --- | --- |\n| 2025-05-05 18:40 | Moved x \\| y | — | ~9 |\n"
BUG = {"file": "yard/winch.py", "fix": "Greased the drum", "tags": ["metal"], "id": "b7", "error_message": "Winch jams",
       "timestamp": "2025-05-04T07:15:30.000Z", "root_cause": "rust", "occurrences": 3}


def store(spark, text, path, name):
    (path / "r").mkdir(parents=True, exist_ok=True)
    (path / "r" / name).write_text(text)
    return D.read_documents(spark, str(path), name)


def test_merge_is_idempotent(spark, tmp_path):
    learned = D.parse_sections(store(spark, LEARNED_MD, tmp_path, "learned.md")).filter("section_no > 0")
    rows = D.log_table_rows(store(spark, LOG_MD, tmp_path, "log.md"))
    bugs = json.dumps({"version": 1, "bugs": [BUG, {**BUG, "id": "b8", "error_message": "Rope frays"}, {**BUG, "fix": "again"}, {}]})
    source = M.normalize_bugs(D.read_bugs_json(store(spark, bugs, tmp_path, "bugs.json")), at("2026-09-01 00:00:00"))
    none = spark.createDataFrame([], BUGS)
    empty_lines, empty_rows = learned.filter("false"), rows.filter("false")

    assert M.merge_learned(empty_lines, learned).count() == 4
    assert M.merge_learned(learned, learned).count() == 0
    assert {r.line for r in M.merge_learned(learned.filter("line like '%spring%'"), learned).collect()} == {
        "- [2025-04-11] sand before paint", "- [2025-04-12] two coats", "- launching at low tide"}
    assert M.merge_log(empty_rows, rows).count() == 2 and M.merge_log(rows, rows).count() == 0
    assert {r.action for r in D.split_log_rows(rows).collect()} == {"Edited yard/slip.py", "Moved x | y"}

    merged = M.merge_bugs(none, source).cache()
    report = M.merge_bugs_report(none, source).first()
    assert (report.added, report.skipped) == (2, 2) and merged.count() == 2
    row = merged.filter("error_message = 'Winch jams'").first()
    assert row.extra["root_cause"] == "rust" and json.loads(row.extra["tags"]) == ["metal"]
    assert str(row["at"]) == "2025-05-04 07:15:30" and row.fix == "Greased the drum" and row.id == "b7"
    again = M.merge_bugs_report(merged, source).first()
    assert (again.added, again.skipped) == (0, 4) and M.merge_bugs(merged, source).count() == 2


@pytest.mark.parametrize("ours, theirs, policy, action", [
    (None, "new", "auto", "imported"), (f"# S\n{M.TEMPLATE_LINE}", "new", "auto", "imported"),
    ("mine", "new", "auto", "kept"), ("mine", " ", "auto", "missing"), ("mine", "new", "overwrite", "overwritten"),
    ("mine", None, "overwrite", "missing"), ("", "new", "keep", "kept"), ("", "new", "skip", "skipped"),
])
def test_merge_handoff(spark, ours, theirs, policy, action):
    side = lambda b: spark.createDataFrame([("r", b)] if b is not None else [], "repo string, body string")
    row = M.merge_handoff(side(ours), side(theirs), policy).first()
    assert row.action == action
    assert row.body == (theirs if action in ("imported", "overwritten") else ours)


def test_broken_documents_give_no_rows(spark):
    docs = spark.createDataFrame([("a", "{"), ("b", "[]"), ("c", '{"bugs": 5}'), ("d", "")], "repo string, text string")
    assert D.read_bugs_json(docs).count() == 0 and D.read_ledger_json(docs).count() == 0
    index = spark.createDataFrame([("a", json.dumps({"version": v, "files": [{"path": "x", "size": 3}]})) for v in (1, 2)], "repo string, text string")
    assert [r.path for r in D.read_index_json(index).collect()] == ["x"]


def usage(spark, *rows):
    data = [(s, a, DAY + dt.timedelta(seconds=i), i, n, None, None, None, None) for i, (s, a, n) in enumerate(rows)]
    return spark.createDataFrame(data, USAGE_EVENTS)


def test_ledger(spark):
    none = spark.createDataFrame([], LEDGER)
    first = L.ledger_upsert(none, usage(spark, ("sess-1", "a", 1000), ("sess-2", None, 500)))
    later = usage(spark, ("sess-1", None, 2500)).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    second = L.ledger_upsert(first, later)
    got = {r.session_id: (r.agent, r.measured_tokens) for r in second.collect()}
    assert got == {"sess-1": ("a", 2500), "sess-2": (None, 500)}
    assert L.ledger_upsert(second, later).exceptAll(second).count() == 0
    many = L.ledger_upsert(none, usage(spark, *[(f"s{i:03}", None, 1) for i in range(520)]))
    assert L.ledger_cap(many, 500).agg(F.min("session_id")).first()[0] == "s020" and L.ledger_cap(many, 500).count() == 500
    assert L.lifetime_sessions(many).first()[0] == 520


def test_budget(spark):
    agents = spark.createDataFrame([("agent-a",), (None,)], "agent string")
    get = lambda df: [r.budget for r in df.orderBy(F.desc_nulls_last("agent")).collect()]
    assert get(L.digest_budget(agents)) == [1500, 1500]
    assert get(L.digest_budget(agents, 900, {"agent-a": 400})) == [400, 900]


def test_prune(spark):
    now, old = "2026-08-15 12:00:00", "2026-08-13 12:00:00"
    reads = spark.createDataFrame(
        [("s", "r", "old.ts", old), ("s", "r", "recent.ts", now), ("s", "r", "bad.ts", "not-a-date")],
        "session_id string, repo string, path string, first_read string")
    writes = spark.createDataFrame([("s", "r", f"w{i}.ts", DAY, i) for i in range(520)],
                                   "session_id string, repo string, path string, at timestamp_ntz, seq int")
    edits = spark.createDataFrame(
        [("s", "r", "old.ts", 3), ("s", "r", "recent.ts", 1), ("s", "r", "w3.ts", 2), ("s", "other", "recent.ts", 4)],
        "session_id string, repo string, path string, n int")
    r, w, e = E.prune_session(reads, writes, edits, at(now))
    assert [x.path for x in r.collect()] == ["recent.ts"] and w.count() == 520
    assert {(x.repo, x.path) for x in e.collect()} == {("r", "recent.ts"), ("r", "w3.ts")}
    _, newest, _ = E.prune_session(reads, writes, edits, at(now), keep_writes=500)
    assert newest.count() == 500 and newest.agg(F.min("seq")).first()[0] == 20


def test_compaction_keeps_the_last_distinct_files(spark):
    rows = [("s", "r", DAY + dt.timedelta(minutes=i), i, "write", f"f{i % 20:02}") for i in range(40)]
    rows += [("s", "r", DAY + dt.timedelta(minutes=5, seconds=1), 100, "compact", None),
             ("s", "r", DAY + dt.timedelta(hours=5), 101, "compact", None), ("t", "r", DAY, 102, "compact", None)]
    log = spark.createDataFrame(rows, "session_id string, repo string, ts timestamp_ntz, seq long, op string, path string")
    got = {r.seq: r.files.split(", ") for r in E.compaction_digest(log).collect()}
    assert got == {100: [f"f{i:02}" for i in range(6)], 101: [f"f{i:02}" for i in range(5, 20)]}


def test_events_that_must_not_count(spark):
    rows = [("s", "r", DAY + dt.timedelta(minutes=i), i, op, path) for i, (op, path) in enumerate([
        ("read", ".env"), ("read", ".env"), ("write", ".env"), ("write", None), ("read", ""), ("write", ".corpusmap/log.md"),
        ("write", "a.ts"), ("compact", None)])]
    rows += [("s", "q", DAY, 50, "write", "a.ts"), ("s", "r", DAY + dt.timedelta(days=1), 51, "compact", None)]
    log = spark.createDataFrame(rows, "session_id string, repo string, ts timestamp_ntz, seq long, op string, path string")
    index = spark.createDataFrame([], "repo string, path string, tokens bigint")
    assert E.repeated_reads(log, index).count() == 0 and E.first_reads(log).count() == 0
    assert [(r.writes, r.files_written) for r in E.session_state(log, index).collect()] == [(2, 2)]
    assert {(r.repo, r.files[0]) for r in E.action_log(log).collect()} == {("r", "a.ts"), ("q", "a.ts")}
    # One path in two repositories is two files.
    assert {r.seq: r.n_files for r in E.compaction_digest(log).collect()} == {7: 2, 51: 2}
    short = {r.seq: r.message for r in E.compaction_digest(log, shown=1).collect()}
    assert "a.ts and 1 earlier." in short[51] and ".env" not in short[51]


def test_ledger_stream_goes_on_with_a_new_checkpoint(spark, tmp_path):
    def events(name, *rows):
        usage(spark, *rows).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/{name}")
        schema = spark.read.parquet(f"{tmp_path}/{name}").schema
        return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")

    ledger = f"{tmp_path}/ledger"
    U.stream_ledger(events("one", ("a", "x", 100), ("b", None, 50)), ledger, f"{tmp_path}/c1", once=True).awaitTermination()
    U.stream_ledger(events("two", ("c", "y", 7)), ledger, f"{tmp_path}/c2", once=True).awaitTermination()
    U.stream_ledger(events("one", ("d", "y", 9)), ledger, f"{tmp_path}/c1", once=True).awaitTermination()
    # A part that no commit names does not count.
    U.fold_ledger(U.usage_rows(usage(spark, ("e", "z", 1)))).write.parquet(f"{ledger}/part-broken")
    got = {r.session_id: r.measured_tokens for r in U.read_ledger(spark, ledger).collect()}
    assert got == {"a": 100, "b": 50, "c": 7, "d": 9}
    U.compact_ledger(spark, ledger, f"{tmp_path}/next")
    assert {r.session_id: r.measured_tokens for r in U.read_ledger(spark, f"{tmp_path}/next").collect()} == got


def test_ledger_parts_are_folded(spark, tmp_path):
    """Some parts a level are left of many batches; a batch counts once; readers see the state before or after a fold."""
    ledger = tmp_path / "ledger"
    parts = U.LedgerParts(spark, str(ledger), fan=3)
    sums = lambda df: {r.session_id: r.measured_tokens for r in df.collect()}
    want, before = {}, None
    for n in range(13):
        if n == 8:
            before = U.read_ledger(spark, str(ledger))
        parts.add(usage(spark, (f"s{n}", "x", n + 1)), "run", n)
        want[f"s{n}"] = n + 1
        if n == 8:
            # Two levels were folded at once; who began to read before still finds all parts.
            assert list(parts.state()["parts"].values()) == [2]
            assert sums(before) == {f"s{i}": i + 1 for i in range(8)}
    assert sorted(parts.state()["parts"].values()) == [0, 1, 2]
    assert sums(U.read_ledger(spark, str(ledger))) == want
    # A batch that comes again, even after its part was folded, adds nothing.
    for n in (3, 12):
        parts.add(usage(spark, (f"s{n}", "x", 999)), "run", n)
    assert sums(U.read_ledger(spark, str(ledger))) == want
    assert len(list((ledger / "_commits").glob("[0-9]*"))) <= U.KEPT_COMMITS


def test_killed_fold_of_a_ledger(spark, tmp_path, monkeypatch):
    """A fold that dies before its commit changes nothing; the next one takes its place and what was left goes."""
    ledger = tmp_path / "ledger"
    parts = U.LedgerParts(spark, str(ledger), fan=2)
    parts.add(usage(spark, ("a", "x", 1)), "run", 0)
    state = parts.state()
    real = U.LedgerParts.commit
    monkeypatch.setattr(U.LedgerParts, "commit", lambda self, s: real(self, s) if "part-run-1" in s["parts"] else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        parts.add(usage(spark, ("b", "x", 2)), "run", 1)
    assert parts.state()["number"] == state["number"] + 1 and (ledger / "fold-3").exists()
    sums = lambda: {r.session_id: r.measured_tokens for r in U.read_ledger(spark, str(ledger)).collect()}
    assert sums() == {"a": 1, "b": 2}
    monkeypatch.undo()
    parts.add(usage(spark, ("c", "x", 3)), "run", 2)
    assert sums() == {"a": 1, "b": 2, "c": 3}
    assert list(parts.state()["parts"]) == ["fold-4"] and not (ledger / "fold-3").exists()
    # A part left by a killed batch is written again under its name.
    U.fold_ledger(U.usage_rows(usage(spark, ("d", "x", 9)))).write.parquet(f"{ledger}/part-run-3")
    assert "d" not in sums()
    parts.add(usage(spark, ("d", "x", 4)), "run", 3)
    assert sums() == {"a": 1, "b": 2, "c": 3, "d": 4}
    with pytest.raises(RuntimeError, match="another writer"):
        parts.commit(state)


def test_log_row(spark):
    row = spark.range(1).select(E.log_row(
        at("2026-08-15 02:30:45"), F.lit("a|b"), F.array(*[F.lit(f"f{i}") for i in range(6)]), F.lit("ok"), F.lit(3)).alias("x"))
    assert row.first().x == "| 2026-08-15 02:30 | a\\|b | `f0, f1, f2, f3 +2` | ok | 3 |"


def task(expr, enabled=True, last_run=None, id="t"):
    return ("r", id, "n", expr, "scan", enabled, last_run, None, None, DAY)


def parse(spark, *exprs):
    rows = T.parse_schedules(spark.createDataFrame([task(e, id=str(i)) for i, e in enumerate(exprs)], TASKS))
    return rows.orderBy(F.col("id").cast("int")).collect()


def test_parse_schedules(spark):
    rows = parse(spark, "*/15 * * * *", "0 9-17 * * 1-5", "5,10 * * * *", "0 9 * JAN MON-FRI", "0 9 * jan sun",
                 " @Daily ", "0 0 * * *", "0 0 * * 7", "10-20/5 */12 * * *")
    assert rows[0].minute == [0, 15, 30, 45] and rows[1].hour == list(range(9, 18)) and rows[1].dow == [1, 2, 3, 4, 5]
    assert rows[2].minute == [5, 10] and (rows[3].month, rows[3].dow) == ([1], [1, 2, 3, 4, 5])
    assert (rows[4].month, rows[4].dow) == ([1], [0]) and rows[5][10:] == rows[6][10:] and rows[7].dow == [0]
    assert (rows[8].minute, rows[8].hour) == ([10, 15, 20], [0, 12])
    bad = parse(spark, "* * * *", "60 * * * *", "* * 32 * *", "* * * * wat", "*/0 * * * *", "9-5 * * * *", "99999999999 * * * *")
    assert [r.error.split(":")[0] for r in bad] == [
        "cron needs 5 fields, got 4", "cron value out of range", "cron value out of range", "invalid cron field",
        "invalid cron step", "invalid cron range", "cron value out of range"]


@pytest.mark.parametrize("expr, now, due", [
    ("30 2 * * *", "2026-08-15 02:30:00", True), ("30 2 * * *", "2026-08-15 02:31:00", False),
    ("30 2 * * *", "2026-08-15 03:30:00", False), ("0 0 1 * 0", "2026-08-01 00:00:00", True),
    ("0 0 1 * 0", "2026-08-02 00:00:00", True), ("0 0 1 * 0", "2026-08-05 00:00:00", False),
    ("0 0 * * 7", "2026-08-02 00:00:00", True), ("0 0 * * 7", "2026-08-03 00:00:00", False),
    ("0 9 * * 1-5", "2026-08-01 09:00:00", False), ("bogus", "2026-08-01 09:00:00", False),
])
def test_due(spark, expr, now, due):
    assert T.due_tasks(spark.createDataFrame([task(expr)], TASKS), at(now)).count() == int(due)


def test_due_guards(spark):
    tasks = [task("30 2 * * *", id="never"), task("30 2 * * *", last_run=DAY.replace(second=5), id="this minute"),
             task("30 2 * * *", last_run=DAY.replace(minute=29), id="before"), task("30 2 * * *", enabled=False, id="off")]
    due = T.due_tasks(spark.createDataFrame(tasks, TASKS), F.lit(DAY).cast("timestamp_ntz"))
    assert {r.id for r in due.collect()} == {"never", "before"}


def test_register(spark):
    none = spark.createDataFrame([], "repo string, registered_at timestamp_ntz")
    changes = spark.createDataFrame(
        [("org/a", "register", DAY), ("org/a", "register", DAY + dt.timedelta(1)), ("org/b", "register", DAY),
         ("org/b", "unregister", DAY + dt.timedelta(1))], "repo string, action string, at timestamp_ntz")
    assert [(r.name, r.registered_at) for r in R.register_repos(none, changes).collect()] == [("a", DAY + dt.timedelta(1))]


def bucketed_table(spark, rows, path, buckets=8):
    Store.write_bucketed(spark.createDataFrame(rows, "repo string, path string, size_bytes bigint, mtime timestamp_ntz"), path, buckets)
    return Store.read_bucketed(spark, path)


def shuffles(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return text.count("Exchange hashpartitioning"), text.count("Exchange ")


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    rows = [("hot", f"f{i}", i, DAY) for i in range(3000)] + [(f"r{i}", "a", 1, DAY) for i in range(1000)]
    old = bucketed_table(spark, rows, str(tmp_path / "old"))
    new = bucketed_table(spark, [*rows[1:-1], ("hot", "f1", 7, DAY), ("new", None, 2, DAY)], str(tmp_path / "new"))
    files = [f for f in (tmp_path / "old" / "rows").iterdir() if f.name.endswith(".parquet")]
    assert len(files) == 8  # one file a bucket, no folder a repository
    parts = [r["n"] for r in old.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 4000 and max(parts) < 2 * 4000 / 8
    drifted = J.drift(old, new)
    assert shuffles(drifted) == (0, 0)
    assert sorted((r.repo, r.path or "", r.status) for r in drifted.collect()) == [
        ("hot", "f0", "missing"), ("hot", "f1", "changed"), ("new", "", "added"), ("r999", "a", "missing")]


def test_refresh_of_stored_tables_moves_no_rows(spark, tmp_path):
    from corpusmap import ScanOptions
    from corpusmap.plans import changes, inputs

    opts, sf = ScanOptions(ignore=(), hidden=True, symbols=False), "/root/testdata/sf0.001"
    tables = dict(index=changes.old_index(spark, sf), listing=inputs.listing_docs(spark, sf), files=inputs.changed_docs(spark, sf))
    for name, df in tables.items():
        Store.write_bucketed(df, str(tmp_path / name), 8)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to send
    try:
        got = J.refresh_index(*[Store.read_bucketed(spark, str(tmp_path / name)) for name in tables], opts)
        assert shuffles(got) == (0, 0)
        plain = J.refresh_index(*tables.values(), opts)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_bucketed_table_of_another_session(spark, tmp_path):
    """A session whose catalog does not know the table finds its layout in the folder; an empty table is one too."""
    path = str(tmp_path / "it's")
    written = bucketed_table(spark, [("r", "a", 1, DAY)], path, 3)
    for table in spark.catalog.listTables():
        if table.name.startswith("corpusmap_"):
            spark.sql(f"DROP TABLE {table.name}")
    again = Store.read_bucketed(spark, path)
    assert again.collect() == [("r", "a", 1, DAY)] and again.schema == written.schema
    Store.write_bucketed(again.limit(0), str(tmp_path / "none"), 3)
    assert Store.read_bucketed(spark, str(tmp_path / "none")).count() == 0
    # Written again with other buckets, the folder holds the new rows only.
    assert bucketed_table(spark, [("q", "b", 2, DAY)], path, 5).collect() == [("q", "b", 2, DAY)]
    assert shuffles(Store.read_bucketed(spark, path).groupBy("repo", "path").count()) == (0, 0)
