"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes and returns whole tables. All but the last return the columns of their input. A stage's rows are long
texts, and its last step runs when the caller writes them, so each stage leaves the session with small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.lines import line_dedup
from corpusmap.llm.mixing import Target, mixture, take_copies
from corpusmap.llm.near import Options, near_duplicates
from corpusmap.llm.packing import pack
from corpusmap.llm.quality import keep_good
from corpusmap.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    work.for_long_texts(spark)
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; the documents stay."""
    work.for_long_texts(spark)
    into = work.free_prefix(docs) + "lines"
    done = line_dedup(docs, min_docs=10, min_chars=1, into=into)
    changed = {"text": F.col(into)["text"]}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length(F.col(into)["text"]).cast(docs.schema["n_chars"].dataType)
    return done.withColumns(changed).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8 or more."""
    work.for_long_texts(spark)
    found = near_duplicates(docs, Options(size=5, percent=80))
    gone = found.groupBy("id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are evened out by repeating documents of smaller ones, at most 1.5 times; each is taken at least once."""
    work.for_long_texts(spark)
    into = work.free_prefix(docs) + "mix"
    return take_copies(mixture(docs, Target(entropy=None, max_repeat=1.5, cover=True), into=into), into)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 4096 tokens; a row for each piece."""
    work.for_long_texts(spark)
    return pack(docs, tokenizer_path(), capacity=4096).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixing", mixing), ("packing", packing)]

# Compression, signatures and tokens cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
