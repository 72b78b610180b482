"""Work on each row and the row after it, in the order of all rows, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work

DONE, HEAD, TAIL = 0, 1, 2


def _rows(kind: int, columns: dict, n: int, part: int | None, texts, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the written table; what a kind of row does not have is null."""
    columns = columns | {"_kind": pa.array([kind] * n, pa.int32()), "_part": pa.array([part] * n, pa.int32()), "_text": texts}
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if columns.get(f.name) is not None else pa.nulls(n, f.type) for f in schema],
        schema=schema)


def each_with_next(
    docs: DataFrame, pairwise: Callable[[pa.Array], dict[str, pa.Array]], fields: str, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, `fields`) for each row, from its text and that of the next row in descending order of ids.

    `pairwise` gets texts that follow each other and gives columns for all but the last. The row after the last one is
    the first one; a single row follows itself. Null ids come last; rows with equal ids stand in the order of a hash of
    their texts, and equal rows are interchangeable. Null texts count as empty.

    Ranges of the order are tasks, so that equal ids may lie in several. The last row of a range waits for the first of
    the next one: one row of each range goes through a join, and the numbers of the ranges through the driver.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    schema = StructType.fromDDL(f"id bigint, {fields}, _kind int, _part int, _text string")
    arrow = to_arrow_schema(schema)
    names = schema.names[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new_ids, new = batch.column(0), batch.column(1)
            if ids is None:
                ids, texts = new_ids, new
                yield _rows(HEAD, {}, 1, part, new.slice(0, 1), arrow)
            else:
                ids, texts = pa.concat_arrays([ids, new_ids]), pa.concat_arrays([texts, new])
            n = len(ids) - 1
            if n:
                yield _rows(DONE, {"id": ids.slice(0, n), **pairwise(texts)}, n, None, None, arrow)
            # A copy of the last row alone, so that the batch can go.
            ids, texts = (x.take(pa.array([n])) for x in (ids, texts))
        if ids is not None:
            yield _rows(TAIL, {"id": ids}, 1, part, texts, arrow)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                both = pa.concat_arrays([batch.column("_text").slice(i, 1), batch.column("_next_text").slice(i, 1)])
                yield _rows(DONE, {"id": batch.column("id").slice(i, 1), **pairwise(both)}, 1, None, None, arrow)

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        # Rows that are equal spread over ranges, too.
        F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("place")]
    ranges = max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    written = work.save(ranged.select("id", "text").mapInArrow(run, schema), "ranges")
    parts = sorted(r[0] for r in written.where(F.col("_kind") == HEAD).select("_part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_part int, _next int")
    heads = written.where(F.col("_kind") == HEAD).select(F.col("_part").alias("_next"), F.col("_text").alias("_next_text"))
    tails = written.where(F.col("_kind") == TAIL).select("id", "_part", "_text").join(after, "_part").join(heads, "_next")
    ends = tails.select("id", "_text", "_next_text").mapInArrow(finish, schema)
    return written.where(F.col("_kind") == DONE).unionAll(ends).select(*names)
