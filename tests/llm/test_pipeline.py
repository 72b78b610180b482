import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
import corpus_pipeline
from corpusmap.llm import queries
from tests.llm import test_lines, test_near
from tests.llm.common import awkward, prose
from tests.oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean"


def docs(spark):
    line = "this line is found in many documents of the corpus"
    rows = [(i, prose(40 + i, 70 + i) + "\n" + line) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), *awkward(), (200, "bad " * 300)]
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), True) for d, t in rows], COLUMNS)


def test_stages_on_awkward_documents(spark):
    stages, now = dict(corpus_pipeline.STAGES), docs(spark)
    assert list(stages) == ["quality", "lines", "near", "mixing", "packing"]
    kept = corpus_pipeline.work.save(stages["quality"](spark, now, SF), "t")
    assert kept.columns == now.columns and 200 not in {r["doc_id"] for r in kept.collect()}
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lined = corpus_pipeline.work.save(stages["lines"](spark, kept, SF), "t")
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in lined.collect()), key=str)
    assert got == sorted(((d, t, len(t)) for d, t, *_ in test_lines.brute(before, 10)), key=str)
    before = [(r["doc_id"], r["text"]) for r in lined.collect()]
    alone = corpus_pipeline.work.save(stages["near"](spark, lined, SF), "t")
    stays = {d for d, _, _, kept in test_near.brute(before, size=5) if kept or d is None}
    assert alone.columns == now.columns and {r["doc_id"] for r in alone.collect()} == stays
    mixed = corpus_pipeline.work.save(stages["mixing"](spark, alone, SF), "t")
    assert mixed.columns == now.columns and {r["doc_id"] for r in mixed.collect()} == stays
    packed = stages["packing"](spark, mixed, SF).collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_stages_on_an_empty_table(spark):
    now = docs(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.work.save(stage(spark, now, SF), name)
        assert now.count() == 0


def test_stages_hold_few_texts_at_a_time(spark):
    """Tasks get small batches and files small row groups of long texts, also when the caller writes a stage's rows."""
    work, pipeline_docs = corpus_pipeline.work, docs(spark)
    text = "concat_ws(' ', transform(sequence(1, 400), i -> sha2(concat(id, '-', i), 256)))"
    large = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")  # 39 MB in one partition
    path, small = work.write(large, "large"), 2 * int(work.LONG_TEXTS["spark.sql.execution.arrow.maxBytesPerBatch"])

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes])})

    for name, stage in corpus_pipeline.STAGES:
        for key in work.LONG_TEXTS:
            spark.conf.unset(key)
        stage(spark, pipeline_docs.where("false"), SF)
        got = work.load(spark, path, large.schema)
        assert got.mapInArrow(sizes, "n bigint").agg({"n": "max"}).first()[0] <= small, name
        got = work.save(got.coalesce(1), "again")  # within the operators' own writing
        assert work.load(spark, path, large.schema).count() == got.count() == 1500
        groups = pq.ParquetFile(got.inputFiles()[0].removeprefix("file:").replace("//", "/")).metadata
        assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) < 750, name


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_registered_queries_equal_their_sql(spark):
    con = connect(SF)
    for name, sql in queries.SQL.items():
        assert compare(spark, con, name, queries.QUERIES[name], sql, SF) == "", name


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in names)
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
