"""Knowledge documents: JSON records, markdown tables and markdown sections.

A document is one row (repo, text); it is read whole, and parsed inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.functions.binding import let
from corpusmap.functions.text import split_lines, trim_space

# Headings, and what separates the head of a table from its rows.
HEADING = r"^##\s+(.+?)\s*$"
SECTION_END = r"^## |^---\s*$"
TABLE_RULE = r"^\|[\s\-:|]+\|$"
CELL_SPLIT = r"(?<!\\)\|"
INDEX_VERSION = 1


def read_documents(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The documents `<root>/<repo>/<name>` as (repo, text)."""
    docs = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return docs.select(F.element_at(parts, -2).alias("repo"), F.col("value").alias("text"))


def _records(docs: DataFrame, key: str) -> DataFrame:
    """The objects in an array of each document as (repo, seq, fields, v); broken documents give none."""
    items = F.try_variant_get(F.try_parse_json("text"), f"$.{key}", "array<variant>")
    rows = docs.select("repo", F.posexplode_outer(items).alias("seq", "v")).filter(F.col("v").isNotNull())
    return rows.withColumn("fields", F.from_json(F.to_json("v"), "map<string,string>"))


def read_bugs_json(docs: DataFrame) -> DataFrame:
    """Bug log documents -> (repo, seq, fields), every field of a record as text, nested ones as JSON."""
    return _records(docs, "bugs").select("repo", F.col("seq").cast("bigint").alias("seq"), "fields")


def bugs_of_fields(records: DataFrame) -> DataFrame:
    """Records of our own log as rows of the bug table; other keys go to `extra`."""
    f = F.col("fields")
    own = ("id", "error_message", "fix", "file", "at")
    return records.select(
        "repo", "seq", f["id"].alias("id"), f["error_message"].alias("error_message"), f["fix"].alias("fix"),
        f["file"].alias("file"), F.try_to_timestamp(f["at"]).cast("timestamp_ntz").alias("at"),
        F.map_filter("fields", lambda k, v: ~k.isin(*own)).alias("extra"),
    )


def read_ledger_json(docs: DataFrame) -> DataFrame:
    """Ledger documents -> one row per session, `seq` telling the order of first sight."""
    f = F.col("fields")
    return _records(docs, "sessions").select(
        "repo", F.col("seq").cast("bigint").alias("seq"), f["session_id"].alias("session_id"),
        f["agent"].alias("agent"),
        f["measured_tokens"].try_cast("bigint").alias("measured_tokens"),
        f["estimated_tokens"].try_cast("bigint").alias("estimated_tokens"),
        F.try_to_timestamp(f["at"]).cast("timestamp_ntz").alias("at"),
    )


def read_index_json(docs: DataFrame) -> DataFrame:
    """Index documents -> index rows; a document of another version gives none."""
    spans = "array<struct<name:string,line:int,endLine:int,tokens:bigint>>"
    schema = (
        "struct<version:int,files:array<struct<path:string,size:bigint,lines:bigint,lang:string,tokens:bigint,"
        f"mtimeMs:double,skipped:boolean,summary:string,symbols:array<string>,symbolLines:{spans}>>>"
    )
    doc = docs.select("repo", F.from_json("text", schema).alias("d")).filter(F.col("d.version") == INDEX_VERSION)
    rows = doc.select("repo", F.explode("d.files").alias("f"))
    return rows.select(
        "repo", "f.path", "f.lang", F.col("f.size").alias("size_bytes"), "f.lines", "f.tokens", "f.summary",
        F.coalesce("f.skipped", F.lit(False)).alias("skipped"),
        F.timestamp_micros((F.col("f.mtimeMs") * 1000).cast("bigint")).cast("timestamp_ntz").alias("mtime"),
        F.coalesce("f.symbols", F.array().cast("array<string>")).alias("symbols"),
        F.col("f.symbolLines").cast(
            "array<struct<name:string,line:int,end_line:int,tokens:bigint>>"
        ).alias("symbol_lines"),
    )


def numbered_lines(text: Column) -> Column:
    """Lines of a text as array<struct<line, line_no>>."""
    return F.transform(
        split_lines(text), lambda line, i: F.struct(line.alias("line"), (i + 1).cast("int").alias("line_no"))
    )


def is_table_row(line: Column) -> Column:
    """Whether a line is a markdown table row, the separator below the head excluded."""
    trimmed = trim_space(line)
    return trimmed.startswith("|") & ~trimmed.rlike(TABLE_RULE)


def log_table_rows(docs: DataFrame) -> DataFrame:
    """Table rows of documents: (repo, row_no, row), verbatim."""
    rows = F.filter(numbered_lines(F.col("text")), lambda r: is_table_row(r["line"]))
    return docs.select("repo", F.explode_outer(rows).alias("r")).filter(F.col("r").isNotNull()).select(
        "repo", F.col("r.line_no").alias("row_no"), F.col("r.line").alias("row")
    )


def split_log_rows(rows: DataFrame) -> DataFrame:
    """`| time | action | files | outcome | tokens |` rows as columns; missing cells are null."""
    cells = F.transform(
        F.split(trim_space(F.col("row")), CELL_SPLIT), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))
    )

    def cell(i: int) -> Column:
        return F.when(F.size("cells") > i + 1, F.try_element_at(F.col("cells"), F.lit(i + 1)))

    return rows.withColumn("cells", cells).select(
        "repo", "row_no", "row", cell(1).alias("time"), cell(2).alias("action"),
        F.regexp_replace(cell(3), "^`|`$", "").alias("files"),
        cell(4).alias("outcome"), cell(5).alias("tokens"),
    )


def parse_action_log(docs: DataFrame) -> DataFrame:
    """Action log documents -> one row per entry."""
    return split_log_rows(log_table_rows(docs))


def parse_sections(docs: DataFrame) -> DataFrame:
    """Markdown documents -> lines below each `## ` heading: (repo, section_no, heading, line_no, line).

    Section 0 is the text before the first heading and has no heading.
    """
    lines = F.col("lines")
    heads = F.filter(lines, lambda r: r["line"].rlike(HEADING))
    n = F.size(lines)

    def body(head: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at(F.col("heads"), i + 2)["line_no"], n + 1)
        return F.struct(
            (i + 1).cast("int").alias("section_no"),
            F.regexp_extract(head["line"], HEADING, 1).alias("heading"),
            F.slice(lines, head["line_no"] + 1, end - head["line_no"] - 1).alias("body"),
        )

    top_end = F.coalesce(F.try_element_at(F.col("heads"), F.lit(1))["line_no"], n + 1)
    top = F.struct(
        F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("heading"),
        F.slice(lines, F.lit(1), top_end - 1).alias("body"),
    )
    sections = F.concat(F.array(top), F.transform("heads", body))
    return (
        docs.withColumn("lines", numbered_lines(F.col("text"))).withColumn("heads", heads)
        .select("repo", F.explode_outer(sections).alias("s"))
        .select("repo", "s.section_no", "s.heading", F.explode_outer("s.body").alias("r"))
        .filter(F.col("r").isNotNull())
        .select("repo", "section_no", "heading", "r.line_no", "r.line")
    )


def section_of(text: Column, pattern: str) -> Column:
    """The first line that matches the pattern and what follows it up to the next `## ` or `---`; '' if none."""
    def cut(lines: Column) -> Column:
        start = F.try_element_at(F.filter(lines, lambda r: r["line"].rlike(pattern)), F.lit(1))["line_no"]

        def until(first: Column) -> Column:
            rest = F.slice(lines, first + 1, F.size(lines))
            end = F.try_element_at(F.filter(rest, lambda r: r["line"].rlike(SECTION_END)), F.lit(1))["line_no"]
            part = F.slice(lines, first, F.coalesce(end, F.size(lines) + 1) - first)
            return trim_space(F.array_join(F.transform(part, lambda r: r["line"]), "\n"))

        return let(start, lambda first: F.when(first.isNull(), F.lit("")).otherwise(until(first)))

    return let(numbered_lines(text), cut)


def extract_section(docs: DataFrame, pattern: str) -> DataFrame:
    """One section of every document that has it: (repo, section)."""
    return docs.select("repo", section_of(F.col("text"), pattern).alias("section")).filter(F.col("section") != "")
