from corpusmap.llm.lines import LineRuns, line_dedup
from tests.llm.common import awkward, frame, lower

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, min_chars=1):
    keys = [{lower(line.strip(SPACE)) for line in (t or "").split("\n")} for _, t in rows]
    count = {}
    for found in keys:
        for k in found:
            count[k] = count.get(k, 0) + 1
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines
                if not (len(lower(x.strip(SPACE))) >= min_chars and count[lower(x.strip(SPACE))] >= min_docs)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def lined():
    rows = [(i, f"head {i}\n  Shared LINE\t\nbody {i} é\n\nÉtoile\nfoot") for i in range(12)]
    rows += [(50, "shared line\nshared line"), (51, None), (52, ""), (53, "\n\n"), (54, "étoile"), (None, "foot\nx")]
    rows += [(60, "once\nhead 1")] * 4 + [(61, "\n".join(f"l{i}" for i in range(30_000)) + "\nfoot")]
    return rows


def run(spark, rows, **options):
    got = line_dedup(frame(spark, rows), **options).collect()
    return sorted(((r["doc_id"], r["lines"]["text"], r["lines"]["n_lines"], r["lines"]["n_dropped"]) for r in got), key=str)


def test_equals_brute_force(spark):
    for min_docs, batches, fanout in ((10, 4, 4), (3, 6, 2), (1, 1, 4)):
        assert run(spark, lined(), min_docs=min_docs, batches=batches, fanout=fanout) == brute(lined(), min_docs)
    assert run(spark, lined(), min_docs=3, min_chars=6) == brute(lined(), 3, 6)
    assert run(spark, awkward(), min_docs=2) == brute(awkward(), 2)


def test_runs_are_compacted_and_frequent_keys_left_out(spark):
    runs = LineRuns(spark, min_docs=5, fanout=2)
    batch = [(1, 1, 6), (2, 2, 2), (3, 3, 1)]
    for _ in range(5):
        runs.add(spark.createDataFrame(batch, "h1 bigint, h2 bigint, n bigint"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    stored = [sorted(tuple(r) for r in d.collect()) for d in runs._all()]
    # The frequent key is in the first run only, the others are summed.
    assert sum(r[2] for d in stored for r in d if r[0] == 1) == 6
    assert {tuple(r) for r in runs.frequent().collect()} == {(1, 1), (2, 2), (3, 3)}


def test_plan_has_no_python(spark):
    plan = line_dedup(frame(spark, lined()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_columns_and_empty(spark):
    docs = frame(spark, lined(), extra=True)
    done = line_dedup(docs, into="n")
    assert done.columns == docs.columns and done.count() == docs.count()
    assert line_dedup(docs.where("false")).count() == 0
