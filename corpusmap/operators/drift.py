"""Comparing an index with a new listing, and refreshing only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.filters import cap_files
from corpusmap.operators.ignore import apply_ignore
from corpusmap.operators.index import analyze_files, choose_files, dir_rollup
from corpusmap.operators.ranking import top_n
from corpusmap.options import ScanOptions

KEY = ["repo", "path"]


def _millis(ts: Column) -> Column:
    """Time in milliseconds, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / 1000.0


def _mtime_moved(old: Column, new: Column) -> Column:
    return F.abs(_millis(new) - _millis(old)) >= 1


def _same(old_size: Column, old_mtime: Column, new_size: Column, new_mtime: Column) -> Column:
    return (old_size == new_size) & ~_mtime_moved(old_mtime, new_mtime)


def drift(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Every path that differs: changed, missing (both flags set) or added (no flag set)."""
    old = manifest.select(*KEY, F.col("size_bytes").alias("old_size"), F.col("mtime").alias("old_mtime"),
                          F.lit(True).alias("known"))
    new = listing.select(*KEY, F.col("size_bytes").alias("new_size"), F.col("mtime").alias("new_mtime"),
                         F.lit(True).alias("present"))
    both = old.join(new, KEY, "full_outer")
    added, missing = F.col("known").isNull(), F.col("present").isNull()
    size = F.when(added, False).when(missing, True).otherwise(F.col("old_size") != F.col("new_size"))
    moved = F.when(added, False).when(missing, True).otherwise(
        F.coalesce(_mtime_moved(F.col("old_mtime"), F.col("new_mtime")), F.lit(True))
    )
    status = F.when(added, "added").when(missing, "missing").otherwise("changed")
    return both.select(
        *KEY, size.alias("size_changed"), moved.alias("mtime_changed"), status.alias("status")
    ).filter((F.col("status") != "changed") | F.col("size_changed") | F.col("mtime_changed"))


def heads_moved(scan_state: DataFrame, heads: DataFrame) -> DataFrame:
    """Per repository whether its head differs from the pinned one; unknown heads do not count."""
    now = heads.select("repo", F.col("git_head").alias("head_now"))
    return scan_state.select("repo", "git_head").join(now, "repo", "left").select(
        "repo",
        F.coalesce(F.col("git_head") != F.col("head_now"), F.lit(False)).alias("head_moved"),
    )


def drift_report(drifted: DataFrame, scan_state: DataFrame, heads: DataFrame, shown: int = 8) -> DataFrame:
    """Per scanned repository: number of drifted paths, the first few by path, head moved, fresh or not."""
    note = F.concat(
        F.col("path"),
        F.when(F.col("size_changed"), " (size)").otherwise(""),
        F.when(F.col("mtime_changed"), " (mtime)").otherwise(""),
    )
    counts = drifted.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    first = (
        top_n(drifted, ["repo"], [F.col("path")], shown, salt_by=["path"])
        .groupBy("repo")
        .agg(F.array_join(F.array_sort(F.collect_list(note)), "\n").alias("first_paths"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        heads_moved(scan_state, heads)
        .join(counts, "repo", "left").join(first, "repo", "left")
        .select(
            "repo",
            F.coalesce("n", zero).alias("drifted"),
            F.coalesce("first_paths", F.lit("")).alias("first_paths"),
            F.greatest(F.coalesce("n", zero) - shown, zero).alias("more"),
            "head_moved",
            ((F.coalesce("n", zero) == 0) & ~F.col("head_moved")).alias("fresh"),
        )
    )


def refresh_work(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Keys of the listed files that the index does not hold in their present state."""
    known = index.select(*KEY, F.col("size_bytes").alias("old_size"), F.col("mtime").alias("old_mtime"))
    same = _same(F.col("old_size"), F.col("old_mtime"), F.col("size_bytes"), F.col("mtime"))
    return (
        listing.select(*KEY, "size_bytes", "mtime").join(known, KEY, "left")
        .filter(~F.coalesce(same, F.lit(False)))
        .select(*KEY)
    )


def refresh_index(
    index: DataFrame, listing: DataFrame, files: DataFrame, opts: ScanOptions = ScanOptions(),
    gitignore: DataFrame | None = None,
) -> DataFrame:
    """The index of the listed files: unchanged rows reused, changed and new files analysed, deleted ones gone.

    `gitignore` holds the compiled rules of the repositories, as for `build_index`. `reused` tells the two kinds of
    rows apart. Listing and index meet once; both kinds follow from that join.
    """
    listing = choose_files(listing, opts)
    if gitignore is not None:
        listing = apply_ignore(listing, gitignore)
    columns = [c for c in index.columns if c != "left_out"]
    old = index.select(*KEY, F.struct(*columns).alias("old"))
    known = listing.select(*KEY, "size_bytes", "mtime").join(old, KEY, "left")
    same = F.coalesce(
        _same(F.col("old.size_bytes"), F.col("old.mtime"), F.col("size_bytes"), F.col("mtime")), F.lit(False))
    known = known.select(*KEY, "old", same.alias("same"))
    reused = known.filter("same").select("old.*").withColumn("reused", F.lit(True))
    work = known.filter("NOT same").select(*KEY)
    fresh = analyze_files(files.join(work, KEY, "left_semi"), opts).withColumn("reused", F.lit(False))
    merged = reused.unionByName(fresh)
    return merged if opts.max_files is None else cap_files(merged, opts.max_files)


def refresh_report(refreshed: DataFrame) -> DataFrame:
    """Rows reused and analysed per repository."""
    return refreshed.groupBy("repo").agg(
        F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("analyzed")
    )


def patch_files(index: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace the rows of changed files the index already knows; unknown ones are left to a refresh."""
    known = changed.join(index.select(*KEY), KEY, "left_semi")
    kept = index.join(changed.select(*KEY), KEY, "left_anti")
    return kept.unionByName(known.select(*index.columns))


def patch_with_rollup(index: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The patched index and its directory sums."""
    patched = patch_files(index, changed)
    return patched, dir_rollup(patched)


def staleness(scan_state: DataFrame, heads: DataFrame, hours: float, now: Column) -> DataFrame:
    """Why the index of a repository is stale, null when it is fresh or was never scanned."""
    age = F.floor((_millis(now) - _millis(F.col("last_scanned"))) / 3_600_000)
    exact = (_millis(now) - _millis(F.col("last_scanned"))) / 3_600_000
    moved = heads_moved(scan_state, heads)
    reason = (
        F.when(F.col("last_scanned").isNull(), F.lit(None))
        .when(F.col("head_moved"), "git HEAD moved since last scan")
        .when(exact > hours, F.concat(F.lit("last scanned "), age.cast("string"), F.lit("h ago")))
    )
    return scan_state.drop("git_head").join(moved, "repo", "inner").select("repo", reason.alias("reason"))


def hint_freshness(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Per indexed file whether the listing still shows the same size and time."""
    now = listing.select(*KEY, F.col("size_bytes").alias("new_size"), F.col("mtime").alias("new_mtime"))
    same = _same(F.col("size_bytes"), F.col("mtime"), F.col("new_size"), F.col("new_mtime"))
    return index.select(*KEY, "size_bytes", "mtime").join(now, KEY, "left").select(
        *KEY, F.coalesce(same, F.lit(False)).alias("fresh")
    )
