"""Building the file index, its totals and rollups, and lookups of single files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.describe import describe
from corpusmap.functions.paths import detect_lang, dir_chain, parent_dir
from corpusmap.functions.text import (
    content_hash, line_count, preview, preview_truncated, split_lines, tokens_of_length,
)
from corpusmap.operators.filters import (
    BINARY, cap_files, classify_skipped, is_hidden, is_sensitive, is_valid_path,
)
from corpusmap.operators.ignore import apply_ignore, ignored_by
from corpusmap.operators.symbols import _SPANS, has_symbols, with_symbol_rules, with_symbols
from corpusmap.options import ScanOptions


def choose_files(files: DataFrame, opts: ScanOptions = ScanOptions()) -> DataFrame:
    """The files a scan looks at, by their path alone."""
    path = F.col("path")
    return files.filter(
        is_valid_path(path) & ~is_hidden(path, opts.hidden) & ~is_sensitive(path) & ~ignored_by(path, opts.ignore)
    )


def analyze_files(
    files: DataFrame, opts: ScanOptions = ScanOptions(), keep: Sequence[str] = (), symbol_rules: DataFrame | None = None,
) -> DataFrame:
    """One index row per file, computed inside the row; `keep` names columns to carry along.

    `symbol_rules` (extension, pass, pattern) say how names are declared in languages of the user's own, and replace
    the built-in patterns of an extension.

    `files` has repo, path, size_bytes, mtime and text (null when it could not be read), and may come with a
    `skip_reason` set by the reader.
    """
    judged = classify_skipped(files, opts.max_file_bytes).withColumn("lang", detect_lang(F.col("path")))
    skipped, text, zero = F.col("skipped"), F.col("text"), F.lit(0).cast("bigint")
    if opts.symbols:
        coded = has_symbols(F.col("lang"))
        if symbol_rules is not None:
            judged = with_symbol_rules(judged, symbol_rules)
            coded |= F.col("symbol_rules").isNotNull()
        cut = F.when(~skipped & coded, split_lines(text))
        judged = with_symbols(judged.withColumn("lines", cut), opts)
        spans = F.col("symbol_lines")
    else:
        spans = F.array().cast(_SPANS)
    rows = judged.select(
        "repo", "path",
        F.when(F.col("skip_reason") == BINARY, F.lit("binary")).otherwise(F.col("lang")).alias("lang"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.when(skipped, F.col("size_bytes")).otherwise(F.length(text)).cast("bigint").alias("n_chars"),
        F.when(skipped, zero).otherwise(line_count(text)).alias("lines"),
        tokens_of_length(F.when(skipped, F.col("size_bytes")).otherwise(F.length(text))).alias("tokens"),
        F.when(skipped, F.col("skip_reason"))
        .otherwise(describe(text, F.col("path"), opts.summary_chars)).alias("summary"),
        "skipped", "skip_reason", "mtime",
        F.when(~skipped, content_hash(text)).alias("sha256"),
        spans.alias("symbol_lines"), *keep,
    )
    return rows.withColumn("symbols", F.transform("symbol_lines", lambda s: s["name"]))


def build_index(
    files: DataFrame, opts: ScanOptions = ScanOptions(), gitignore: DataFrame | None = None,
    symbol_rules: DataFrame | None = None,
) -> DataFrame:
    """The index of every repository: choose, drop ignored, analyse; cap where `max_files` is given.

    `gitignore` holds the compiled rules of single repositories. Texts meet them only as a list of ignored paths.
    `symbol_rules` are those of `analyze_files`. A capped index has the column `left_out`.
    """
    chosen = choose_files(files, opts)
    if gitignore is not None:
        chosen = apply_ignore(chosen, gitignore)
    index = analyze_files(chosen, opts, symbol_rules=symbol_rules)
    return index if opts.max_files is None else cap_files(index, opts.max_files)


def corpus_totals(index: DataFrame, max_files: int | None = None) -> DataFrame:
    """Totals per repository, with what a cap left out of a capped index.

    Given the rows before a cap and `max_files`, they tell what that cap would leave out.
    """
    n = F.count(F.lit(1))
    capped = "left_out" in index.columns
    over = F.greatest(n - max_files, F.lit(0)).cast("bigint") if max_files else F.lit(0).cast("bigint")
    if capped:
        over = F.coalesce(F.max("left_out"), F.lit(0)).cast("bigint")
    return index.groupBy("repo").agg(
        (n if capped else n - over).alias("files"),
        F.sum("lines").alias("lines"),
        F.sum("size_bytes").alias("bytes"),
        F.sum("tokens").alias("tokens"),
        (F.count_if("skipped") + over).alias("skipped_files"),
        (over > 0).alias("truncated"),
    )


def dir_rollup(index: DataFrame, *extra: str) -> DataFrame:
    """Files, lines and bytes below every directory, the root '' included; `extra` names more columns to sum.

    Sums per directory come first, so what is copied to the ancestors is one row per directory, not per file.
    """
    sums = [F.sum("lines").alias("lines"), F.sum("size_bytes").alias("size_bytes")]
    direct = (
        index.groupBy("repo", parent_dir(F.col("path")).alias("leaf"))
        .agg(F.count(F.lit(1)).alias("files"), *sums, *[F.sum(c).alias(c) for c in extra])
    )
    return (
        direct.withColumn("dir", F.explode(dir_chain(F.col("leaf"))))
        .groupBy("repo", "dir")
        .agg(
            F.sum("files").alias("files"), F.sum("lines").alias("lines"), F.sum("size_bytes").alias("bytes"),
            *[F.sum(c).alias(c) for c in extra],
        )
    )


def sort_index(index: DataFrame, by: str = "path") -> DataFrame:
    """By repository, then path, or largest first."""
    order = [F.desc("size_bytes"), F.col("path")] if by == "size" else [F.col("path")]
    return index.orderBy("repo", *order)


def file_digest(
    requests: DataFrame, files: DataFrame, opts: ScanOptions = ScanOptions(), preview_chars: int = 4096
) -> DataFrame:
    """What is known of each requested (repo, path): existence, measures, symbols and a preview.

    Spark decides by the size of the requests how to find the wanted texts.
    """
    wanted = requests.select("repo", "path").filter(is_valid_path(F.col("path"))).distinct()
    found = files.join(wanted, ["repo", "path"], "left_semi")
    reason, text = F.col("skip_reason"), F.col("text")
    headed = (
        classify_skipped(found, opts.max_file_bytes)
        .withColumn("preview", F.coalesce(reason, preview(text, preview_chars, opts.max_file_bytes)))
        .withColumn(
            "preview_truncated", F.coalesce(preview_truncated(text, preview_chars, opts.max_file_bytes), F.lit(True))
            | reason.isNotNull()
        )
    )
    digests = analyze_files(headed, opts, keep=["preview", "preview_truncated"]).select(
        "repo", "path", "size_bytes", "lines", "lang", "tokens", "symbols", "preview", "preview_truncated",
        F.lit(True).alias("found"),
    )
    return (
        requests.join(digests, ["repo", "path"], "left")
        .withColumn("exists", F.coalesce(F.col("found"), F.lit(False)))
        .drop("found")
    )


def scan_state(index: DataFrame, heads: DataFrame, now: Column) -> DataFrame:
    """One row per repository: scan time, pinned head, files and lines. `heads` has repo and git_head."""
    return (
        index.groupBy("repo")
        .agg(F.count(F.lit(1)).alias("total_files"), F.sum("lines").alias("total_lines"))
        .join(heads.select("repo", "git_head"), "repo", "left")
        .select("repo", now.alias("last_scanned"), "git_head", "total_files", "total_lines")
    )


def manifest(index: DataFrame) -> DataFrame:
    """What drift is measured against."""
    return index.select("repo", "path", "size_bytes", "mtime")


