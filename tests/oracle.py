"""Runs registered queries beside their SQL: python tests/oracle.py [sf] [name prefix …]"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str:
    """'' when both give the same rows, else what differs."""
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not left:
        return "no rows"
    if len(left) != len(right):
        diff = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}: {diff}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ of {len(left)}: {bad[0]}" if bad else ""


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from corpusmap.session import builder

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"{DATA}/sf{sf}"
    spark = (
        builder("oracle", "local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                error = compare(spark, con, name, fn, sql[name], sf_dir)
                note = "ok"
            else:
                n = fn(spark, sf_dir).count()
                error, note = ("" if n else "no rows"), f"rows only: {n}"
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(error)
        print(f"{'FAIL' if error else note:>5} {name} {time.time() - start:.1f}s {error}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
