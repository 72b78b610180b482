"""Connected components: tasks contract the edges they hold, then large and small stars alternate.

Each round is one written table. Contraction replaces the edges of a task by a star for each of its components, so
that few rounds are left to connect what lies in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm import work


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # The smaller root reaches the other end, and the root of the other end.
        for end in (a, b):
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        edges = pa.Table.from_batches(parts)
        nodes, roots = local_roots(edges.column("a").to_numpy(), edges.column("b").to_numpy())
        more = nodes != roots
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[more]), "b": pa.array(roots[more])})


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_minima(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    minima = _minima(down)
    moved = down.join(minima, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(minima.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, task_edges: int = 2_000_000, max_rounds: int = 60) -> DataFrame:
    """(node, root): of each node with an edge to another, the smallest node that it is connected to.

    `edges` has two bigint columns. Loops, nulls and repeated edges do not matter. A task contracts `task_edges` edges;
    edges that fit in one task are settled by that, more of them need rounds of stars in between.
    """
    spark, schema, mark = edges.sparkSession, "a bigint, b bigint", None
    a, b = edges.columns
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    path = work.write(now, "edges")
    for _ in range(max_rounds):
        now = work.load(spark, path, schema)
        # Two sums stand for the set of edges; the tables themselves stay where they are.
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        parts = max(1, -(-n // task_edges))
        contracted = now.coalesce(parts).mapInArrow(_contract, schema)
        if parts == 1 or (n, total) == mark:
            break
        mark, old = (n, total), path
        path = work.write(_small_star(_large_star(contracted)), "edges")
        work.remove(spark, old)
    else:
        raise RuntimeError("components did not settle")
    now = work.save(contracted, "roots")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
