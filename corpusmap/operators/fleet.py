"""The register of repositories, and updating all of them in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.paths import base_name, to_posix
from corpusmap.operators.index import build_index, corpus_totals
from corpusmap.operators.ranking import last_by
from corpusmap.options import ScanOptions


def register_repos(repos: DataFrame, changes: DataFrame) -> DataFrame:
    """The register after changes (repo, action 'register'|'unregister', at); the last change of each decides."""
    events = repos.select("repo", F.lit("register").alias("action"), F.col("registered_at").alias("at"))
    return (
        events.unionByName(changes.select("repo", "action", "at")).groupBy("repo")
        .agg(
            last_by("action", "at", "action").alias("action"),
            F.max(F.when(F.col("action") == "register", F.col("at"))).alias("registered_at"),
        )
        .filter(F.col("action") == "register")
        .select("repo", base_name(to_posix(F.col("repo"))).alias("name"), "registered_at")
    )


def update_all(
    repos: DataFrame, files: DataFrame, opts: ScanOptions = ScanOptions(), gitignore: DataFrame | None = None
) -> DataFrame:
    """A new index of every registered repository, in one job."""
    mine = files.join(repos.select("repo"), "repo", "left_semi")
    return build_index(mine, opts, gitignore)


def update_status(repos: DataFrame, index: DataFrame, now: Column) -> DataFrame:
    """One row per registered repository telling how its update went."""
    totals = corpus_totals(index).select("repo", "files", "lines", "truncated")
    zero = F.lit(0).cast("bigint")
    ok = F.coalesce("files", zero) > 0
    return repos.select("repo", "name").join(totals, "repo", "left").select(
        "repo", "name", F.when(~ok, "no files").when(F.col("truncated"), "truncated").otherwise("ok").alias("status"),
        F.coalesce("files", zero).alias("files"), F.coalesce("lines", zero).alias("lines"), now.alias("at"),
    )
