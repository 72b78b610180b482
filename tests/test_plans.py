"""What the plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA

# Streams and sinks run jobs when they are built; their operators are plain plans of other queries.
OPTIONAL = entry._optional()[0]  # these may use Python; they have tests of their own
BATCH = sorted(n for n in entry.queries() if n not in OPTIONAL and not re.match(r"(w\d|s2_|s3_|s9_|s10_)", n))
SF_DIR = f"{DATA}/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Python|Pandas|Arrow", text)


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(spark, "c1_detect_lang")
    assert "text" not in re.findall(r"ReadSchema: (\S+)", plan(spark, "c2_path_parts"))[0]


def final_plan(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_index_build_shuffles_no_texts(spark):
    """After the spread of the one-file input, the index build has no exchange."""
    from corpusmap.operators.index import build_index
    from corpusmap.plans import inputs as X

    files = X.files_docs(spark, SF_DIR)
    base = files._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert build_index(files)._jdf.queryExecution().executedPlan().toString().count("Exchange") == base <= 1


def test_symbols_are_picked_inside_the_row(spark):
    base = plan(spark, "y2_symbol_spans").count("Exchange")
    for name in ("y5_top_symbols", "y6_symbol_lists"):
        text = plan(spark, name)
        assert text.count("Exchange") == base and "Join" not in text and "Window" not in text


def test_refresh_scans_little(spark):
    assert final_plan(spark, "j3_refresh_index").count("Scan parquet") <= 4
