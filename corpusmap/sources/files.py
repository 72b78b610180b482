"""Files as tables.

What there is to read comes as an inventory table (repo, path, size_bytes, mtime), as version control and object
stores give it. The bytes are read by Spark's binary file source; what the inventory names and the source does not
deliver is reported as unreadable. Spark leaves out names that begin with `_` or `.`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.operators.filters import BINARY, TOO_LARGE, UNREADABLE, cap_files
from corpusmap.operators.ignore import apply_ignore
from corpusmap.operators.index import analyze_files, choose_files
from corpusmap.options import ScanOptions

KEY = ["repo", "path"]


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below the root; `content` is read only where it is used."""
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    path = F.col("path")
    return tree.select(
        F.substr(path, F.instr(path, F.lit(base)) + len(base)).alias("below"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), "content",
    )


def _key(below: Column, repo: str | None) -> tuple[Column, Column]:
    """Repository and path: below the root lies one repository, or one folder per repository."""
    if repo is not None:
        return F.lit(repo), below
    name = F.substring_index(below, "/", 1)
    return name, F.substr(below, F.length(name) + 2)


def list_files(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """An inventory (repo, path, size_bytes, mtime) from Spark's own listing of a folder; no file is opened."""
    name, path = _key(F.col("below"), repo)
    return _tree(spark, root).select(name.alias("repo"), path.alias("path"), "size_bytes", "mtime")


def write_files(files: DataFrame, root: str, end: str) -> tuple[Column, Column]:
    """Write `content` of every row (repo, path, content) to a file below a new root; gives the `key` to read them by.

    Each content is followed by `end`, as Spark's writer of texts has it; null is empty, contents of the same (repo,
    path) stand in one file. On a mounted file system tasks write the files themselves, under their final names in one
    folder per repository: no folder is made, committed and listed for each file. Elsewhere Spark's writer does that.
    """
    spark = files.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(target).toUri()
    raw = files.select("repo", "path", "content")
    part = F.split("below", "/")
    key = tuple(F.url_decode(F.regexp_replace(part[i], "^[a-z]+=", "")) for i in (0, 1))
    if uri.getScheme() != "file":
        text = raw.select("repo", "path", F.col("content").cast("string").alias("value"))
        # Tasks commit their own files; the folder is new, so nothing reads a part of it.
        text.write.partitionBy("repo", "path").option("lineSep", end).option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
        return key
    system.mkdirs(target)
    base, tail = uri.getPath(), end.encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid
        from urllib.parse import quote

        name = lambda kind, v: f"{kind}={quote(v, safe='') if v else '__HIVE_DEFAULT_PARTITION__'}"
        temporary, now, out, n = f".{uuid.uuid4().hex}", None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(f"{base}/{temporary}", f"{base}/{now[0]}/{now[1]}")

        for batch in batches:
            for repo, path, content in zip(*(column.to_pylist() for column in batch.columns)):
                place = name("repo", repo), name("path", path)
                if place != now:
                    close()
                    os.makedirs(f"{base}/{place[0]}", exist_ok=True)
                    now, out, n = place, open(f"{base}/{temporary}", "wb"), n + 1
                out.write((content or b"") + tail)
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    # All rows of a file meet in one task, side by side.
    raw.repartition("repo", "path").sortWithinPartitions("repo", "path").mapInArrow(write, "n bigint").agg(F.sum("n")).first()
    return key


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are none become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def read_text_files(
    spark: SparkSession, root: str, inventory: DataFrame | None = None, opts: ScanOptions = ScanOptions(),
    repo: str | None = None, key: tuple[Column, Column] | None = None,
) -> DataFrame:
    """The files of the inventory with their text: (repo, path, size_bytes, mtime, text, skip_reason).

    Without an inventory all files below the root are taken. A NUL byte marks a binary file; files above
    `opts.max_file_bytes`, where it is given, are listed but not decoded; a file that is in the inventory only is
    unreadable. `key` gives repository and path from the column `below`, the path below the root.

    What is unreadable follows from the names alone. Contents stay where they are read as long as the inventory is
    small enough to be sent to them; a longer one costs one shuffle of the contents, which `index_tree` does without.
    """
    name, path = key or _key(F.col("below"), repo)
    found = _tree(spark, root).select(name.alias("repo"), path.alias("path"), "size_bytes", "mtime", "content")
    if inventory is not None:
        listed = inventory.select("repo", "path", "size_bytes", "mtime")
        gone = listed.join(found.select("repo", "path"), KEY, "left_anti").withColumn("content", F.lit(None).cast("binary"))
        found = found.select("repo", "path", "content").join(listed, KEY, "inner").unionByName(gone)
    large = F.lit(False) if opts.max_file_bytes is None else F.col("size_bytes") > opts.max_file_bytes
    reason = (
        F.when(large, F.lit(TOO_LARGE)).when(F.col("content").isNull(), F.lit(UNREADABLE))
        .when(F.position(F.lit(b"\x00"), F.col("content")) > 0, F.lit(BINARY))
    )
    return found.withColumn("skip_reason", reason).select(
        "repo", "path", "size_bytes", "mtime",
        F.when(F.col("skip_reason").isNull(), decoded(F.col("content"))).alias("text"), "skip_reason",
    )


def index_tree(
    spark: SparkSession, root: str, inventory: DataFrame, opts: ScanOptions = ScanOptions(), repo: str | None = None,
    key: tuple[Column, Column] | None = None, gitignore: DataFrame | None = None, symbol_rules: DataFrame | None = None,
) -> DataFrame:
    """The index of the files of an inventory, as `build_index` gives it, without moving a file's text.

    Files are analysed in the task that reads them, and only index rows meet the inventory, whatever its size. Sizes
    and times are those of the inventory; what it names and the source does not deliver is unreadable, told from the
    names alone. Files that the inventory does not name are read for nothing, so the root should hold few of them.
    """
    listed = choose_files(inventory.select("repo", "path", "size_bytes", "mtime"), opts)
    if gitignore is not None:
        listed = apply_ignore(listed, gitignore)
    there = choose_files(read_text_files(spark, root, None, opts, repo, key), opts)
    read = analyze_files(there, opts, symbol_rules=symbol_rules)
    columns = read.columns
    gone = listed.join(there.select(*KEY), KEY, "left_anti").select(
        "*", F.lit(None).cast("string").alias("text"), F.lit(UNREADABLE).alias("skip_reason"))
    index = read.drop("size_bytes", "mtime").join(listed, KEY, "inner").select(*columns).unionByName(
        analyze_files(gone, opts, symbol_rules=symbol_rules))
    return index if opts.max_files is None else cap_files(index, opts.max_files)
