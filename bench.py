"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs once to warm up and then BENCH_RUNS times
(three by default); the median counts, in seconds from the call to the last row written to a sink that discards them.
Files per second are those of the whole index build. `scan_tree_ms` is the time to list, read and index a tree of 200
files of 11 lines.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

from corpusmap.operators.index import build_index
from corpusmap.plans import catalog
from corpusmap.plans import inputs as X
from corpusmap.session import builder
from corpusmap.sources.files import read_text_files

HEADLINE = (
    "a1_build_index", "a1_build_index_docs", "a2_corpus_totals", "a3_dir_rollup", "a5_render_map", "c13_describe",
    "e1_repeated_reads", "e3_session_state", "e6_compaction_digest", "j1_drift", "j3_refresh_index", "k6_session_digest",
    "l1_ledger_upsert", "m3_merge_bugs", "p3_apply_ignore", "q1_audit_lines", "y1_extract_symbols",
    "y2_symbol_spans", "y3_toplevel_spans", "t1_parse_schedules", "t2_expand_schedule", "t3_due_tasks", "w1_stream_change_bursts",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(fn, spark, sf_dir: str) -> float:
    run(fn(spark, sf_dir))
    times = []
    for _ in range(RUNS):
        start = time.time()
        run(fn(spark, sf_dir))
        times.append(time.time() - start)
    print(fn.__module__.rsplit(".", 1)[-1], fn.__name__, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    return round(statistics.median(times), 3)


TREE_FILES = 200


def tree_index(spark, root: str):
    """The index of a file tree, from its listing and bytes."""
    return build_index(read_text_files(spark, root, repo="tree"))


def write_tree(root: str) -> None:
    body = "import x from 'y'\n" + "".join(f"export function part{i}(a) {{ return a + {i} }}\n" for i in range(10))
    for i in range(TREE_FILES):
        os.makedirs(f"{root}/src/p{i % 20}", exist_ok=True)
        with open(f"{root}/src/p{i % 20}/f{i}.ts", "w") as f:
            f.write(body)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench", f"local[{cpus}]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: seconds(catalog.QUERIES[name], spark, sf_dir) for name in HEADLINE}
    files = X.table(spark, sf_dir, "orders").count()
    lines = X.files_code(spark, sf_dir).select(F.sum(F.size(F.split("text", "\n")) - 1)).first()[0]
    with tempfile.TemporaryDirectory() as root:
        write_tree(root)
        tree = seconds(tree_index, spark, root)
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus),
        "files_per_sec": {"index_build": round(files / queries["a1_build_index"]),
                          "symbols": round(files / queries["y2_symbol_spans"])},
        "scan_tree_ms": round(1000 * tree),
        "symbol_lines_per_sec": round(lines / queries["y2_symbol_spans"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
