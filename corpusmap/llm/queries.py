"""Registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.functions.binding import let
from corpusmap.llm import work
from corpusmap.llm.alignment import align
from corpusmap.llm.hmm import score_texts
from corpusmap.llm.lines import line_dedup
from corpusmap.llm.mixing import Target, mixture
from corpusmap.llm.near import near_duplicates
from corpusmap.llm.neighbours import nearest
from corpusmap.llm.packing import pack
from corpusmap.llm.pii import BASE, as_text, count_of, find_pii
from corpusmap.llm.quality import FIELDS as QUALITY
from corpusmap.llm.quality import quality_rules
from corpusmap.llm.repeats import substring_dedup
from corpusmap.llm.runs import as_text as runs_text
from corpusmap.llm.runs import periodic_runs, strongest
from corpusmap.llm.simhash import edits, likeness, with_near
from corpusmap.llm.toxicity import learn, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *[F.col("quality")[n].alias(n) for n, _ in QUALITY])


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""


@query("op9_line_dedup", LINES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )


def remainder(doc_id, n: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = toxicity(docs, learn(docs, labels)).withColumnRenamed("toxicity", "score")
    return scored.select(
        "doc_id", (F.coalesce(remainder("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d WHERE len(w) >= 20
), k AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 19], ' ')) AS key FROM s
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE n > 1
), t AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), j AS (
  SELECT t.doc_id, t.pos, t.word, g.pos IS NOT NULL AS gone FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.pos = g.pos
), a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


@query("op7_substring_dedup", REPEATS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return done.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op1_hmm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query("op6_minhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_source_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    work.for_long_texts(spark)  # the last step reads the texts again when the caller writes it
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixture(docs, Target(entropy=1.0, max_repeat=4.0))
    return mixed.select("doc_id", "source", "mix.n_tokens", "mix.copies", "mix.weight", "mix.exponent")


@query("op11_simhash_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_near(work.save(edits(table(spark, sf_dir, "documents")), "edits"))
    near = {f"near_{side}": likeness(F.col("fingerprint"), F.col(f"{side}_fingerprint")) for side in ("edited", "next")}
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        *[value.alias(name) for name, value in near.items()], "n_same", "n_near",
    )


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"), "n_group_links",
    )


WORDS = r"([^\x20\x09-\x0D]+)"


def with_planted_runs(doc_id, text):
    """Texts of every tenth id, by a hash, repeat what stands at a place that the hash gives; others stay."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda word, i: F.when(i < a, word).otherwise(
            F.get(w, (a + (i - a) % p).cast("int")))), " ")

    return F.when(h % 10 == 0, let(F.regexp_extract_all(F.col(text), F.lit(WORDS)), repeated)).otherwise(F.col(text))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark hands no expression with a lambda to Python; behind a generator the text is a plain column.
    planted = F.explode(F.array(with_planted_runs("doc_id", "text"))).alias("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", planted)
    found = periodic_runs(docs).select("doc_id", "periodic", strongest(F.col("periodic.runs")).alias("best"))
    return found.select(
        "doc_id", F.size("periodic.runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(runs_text(F.col("periodic.runs")), 256).alias("runs_sha256"),
        F.sha2("periodic.text", 256).alias("collapsed_sha256"), F.col("periodic.n_words"),
    )
