"""Approximate nearest neighbours in a low-dimensional stable projection.

Vectors are projected by independent normal (2-stable) directions. If two vectors are d apart, the squared distance of
their projections is d squared times a chi-square variable with as many degrees of freedom as there are directions. A
kd-tree over the projections hands out its leaves in growing distance r; their entries are verified on the original
vectors. Let d be the distance of the k-th best so far: the search ends when a nearer vector would lie within r with
probability `confidence` or more, that is when the chi-square distribution of (r / d) squared reaches it.

The upper levels of the kd-tree come from a bounded sample and cut the projected space into cells; every vector is in
the cell of its projection. A query first searches its own cell, and then, with the bound found there, the cells whose
box passes the same test. Equal vectors are one entry with their smallest ids, so that a hot vector costs one entry.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.blocks import table_from_bytes, table_to_bytes

LEAF = 48
FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class Options:
    k: int = 10
    directions: int = 8
    confidence: float = 0.98
    sample: int = 20_000  # vectors from which the cells are cut; all vectors are indexed
    cell_rows: int = 20_000  # a cell with more entries is dealt out to several parts
    query_block: int = 256
    seed: int = 7


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def chi_square_bound(p: float, m: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < p else (low, middle)
    return high


def directions(dim: int, options: Options) -> np.ndarray:
    return np.random.default_rng([options.seed, dim]).standard_normal((dim, options.directions))


class Tree:
    """A kd-tree whose leaves are runs of `order`, with the boxes of the leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, runs = np.arange(len(points)), []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[self.order[a:b]]
            spread = own.max(axis=0) - own.min(axis=0)
            axis = int(np.argmax(spread))
            if b - a > leaf and spread[axis] > 0:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                todo += [(a, a + middle), (a + middle, b)]
            else:
                runs.append((a, b))
        self.runs = sorted(runs)
        starts = [a for a, _ in self.runs]
        self.low = np.minimum.reduceat(points[self.order], starts, axis=0)
        self.high = np.maximum.reduceat(points[self.order], starts, axis=0)

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in growing distance of their boxes, and these squared distances."""
        away = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        far = (away ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        return order, far[order]

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.runs[i][0]:self.runs[i][1]] for i in leaves])


class Best:
    """The k nearest (distance, id) pairs so far."""

    def __init__(self, k: int, own: int, bound: float = math.inf):
        self.k, self.own, self.pairs, self.bound = k, own, [], bound

    def add(self, distances: np.ndarray, ids: list) -> None:
        """Entries with their lists of ids; only the k nearest can matter, one more as the query may be among them."""
        near = np.flatnonzero(distances <= self.reach)
        if len(near) > self.k + 1:
            last = np.partition(distances[near], self.k)[self.k]
            near = near[distances[near] <= last]
        if len(near):
            self.pairs += [(d, i) for d, n in zip(distances[near].tolist(), near.tolist()) for i in ids[n] if i != self.own]
            self.pairs.sort()
            del self.pairs[self.k:]

    @property
    def reach(self) -> float:
        return min(self.bound, self.pairs[-1][0] if len(self.pairs) == self.k else math.inf)


def search(tree: Tree, low: np.ndarray, vectors: np.ndarray, ids: list, query: np.ndarray, projected: np.ndarray,
           best: Best, stop: float) -> None:
    """Verify projected neighbours, a few leaves at a time, until the stopping test holds for all that are left.

    The test is strict, so entries at equal distances are all verified.
    """
    leaves, far = tree.leaves(projected)
    a, step = 0, 2
    while a < len(leaves) and far[a] <= stop * best.reach ** 2:
        rows = tree.rows(leaves[a:a + step])
        rows = rows[((low[rows] - projected) ** 2).sum(axis=1) <= stop * best.reach ** 2]
        distances = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
        best.add(distances, [ids[i] for i in rows.tolist()])
        a, step = a + step, min(2 * step, 32)


def _cells(sample: np.ndarray, count: int) -> list[tuple]:
    """Cuts (axis, value, left, right) of a kd-tree with about `count` leaves; leaves are numbers."""
    numbers = iter(range(count * 2))

    def cut(points: np.ndarray, parts: int):
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if parts < 2 or len(points) < 2 or spread.max() == 0:
            return next(numbers)
        axis = int(np.argmax(spread))
        value = float(np.median(points[:, axis]))
        left = points[:, axis] <= value
        if left.all():
            return next(numbers)
        return axis, value, cut(points[left], parts // 2), cut(points[~left], parts - parts // 2)

    return cut(sample, count)


def _cell_of(cuts, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)

    def walk(node, rows: np.ndarray) -> None:
        if isinstance(node, tuple):
            axis, value, left, right = node
            near = points[rows, axis] <= value
            walk(left, rows[near])
            walk(right, rows[~near])
        else:
            out[rows] = node

    walk(cuts, np.arange(len(points)))
    return out


def _within(cuts, q: np.ndarray, reach: float) -> list[int]:
    """Cells whose region is within a squared projected distance."""
    out, todo = [], [(cuts, np.zeros(len(q)))]
    while todo:
        node, away = todo.pop()
        if not isinstance(node, tuple):
            out.append(node)
            continue
        axis, value, left, right = node
        for side, beyond in ((left, q[axis] - value), (right, value - q[axis])):
            far = away
            if beyond > away[axis]:
                far = away.copy()
                far[axis] = beyond
            if far @ far <= reach:
                todo.append((side, far))
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _with_cell(cuts, options: Options, dim: int, field: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                low = _matrix(batch.column(field), dim) @ directions(dim, options)
                yield batch.append_column("cell", pa.array(_cell_of(cuts, low), pa.int32()))

    return run


def _other_cells(cuts, options: Options, dim: int):
    stop = chi_square_bound(options.confidence, options.directions)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low = _matrix(batch.column("vec"), dim) @ directions(dim, options)
            rows, cells = [], []
            for i, (q, own, bound) in enumerate(zip(low, batch.column("cell").to_pylist(), batch.column("bound").to_pylist())):
                found = [c for c in _within(cuts, q, math.inf if bound is None else stop * bound ** 2) if c != own]
                rows += [i] * len(found)
                cells += found
            taken = batch.select(["query_id", "vec", "bound"]).take(pa.array(rows, pa.int64()))
            yield taken.append_column("cell", pa.array(cells, pa.int32()))

    return run


def _build_part():
    """An index row for each part of a cell, with its entries."""

    def build(table: pa.Table) -> pa.Table:
        data = table_to_bytes(table.select(["vec", "ids"]))
        return pa.table({"cell": table.column("cell").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "data": pa.array([data], pa.binary())})

    return build


def _search_part(options: Options, dim: int):
    stop = chi_square_bound(options.confidence, options.directions)

    def run(parts: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(parts):
            table = table_from_bytes(parts.column("data")[0].as_py())
            vectors, ids = _matrix(table.column("vec"), dim), table.column("ids").to_pylist()
            matrix = directions(dim, options)
            low = vectors @ matrix
            tree = Tree(low)
            wanted = _matrix(queries.column("vec"), dim)
            for q, number, bound in zip(wanted, queries.column("query_id").to_pylist(), queries.column("bound").to_pylist()):
                best = Best(options.k, number, math.inf if bound is None else bound)
                search(tree, low, vectors, ids, q, q @ matrix, best, stop)
                out += [(number, i, d) for d, i in best.pairs]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()),
                         "vec_id": pa.array([x[1] for x in out], pa.int64()),
                         "score": pa.array([x[2] for x in out], pa.float64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _one_size(rows: DataFrame, dim: int, is_query: Column, options: Options) -> DataFrame:
    # Entries: distinct vectors with their k + 1 smallest ids. Spark limits each task's ranks before it shuffles them.
    first = Window.partitionBy("vec").orderBy("vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= options.k + 1)
    entries = ranked.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = work.save(entries, "entries")
    n = entries.count()
    count = 1 << max(0, math.ceil(math.log2(max(1, n / options.cell_rows))))
    some = entries.select("vec").where(work.hash_share(F.col("vec"), options.sample, n))
    sample = some.orderBy(F.xxhash64("vec")).limit(options.sample).collect()
    sample = np.array([r["vec"] for r in sample], np.float64).reshape(-1, dim) @ directions(dim, options)
    cuts = _cells(sample, count)
    celled = work.save(entries.mapInArrow(_with_cell(cuts, options, dim, "vec"),
                                          "vec array<double>, ids array<bigint>, cell int"), "cells")
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / (2 * options.cell_rows)).alias("parts"))
    dealt = celled.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
    index = work.save(dealt.groupBy("cell", "part").applyInArrow(
        _build_part(), "cell int, part int, data binary"), "index")
    names = index.select(F.col("cell").alias("cell"), F.col("part").alias("part"))

    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    queries = work.save(queries.mapInArrow(_with_cell(cuts, options, dim, "vec"),
                                           "query_id bigint, vec array<double>, cell int"), "queries")

    def searched(asked: DataFrame) -> DataFrame:
        # A part takes its queries in blocks.
        block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
        sizes = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / options.query_block).alias("blocks"))
        asked = asked.join(sizes, ["cell", "part"]).select("cell", "part", block, "query_id", "vec", "bound")
        held = index.join(sizes, ["cell", "part"]).select(
            "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "data")
        keys = ["cell", "part", "block"]
        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search_part(options, dim), FOUND)

    home = queries.join(names, "cell").withColumn("bound", F.lit(None).cast("double"))
    first = work.save(_best(searched(home), options.k).drop("rank"), "home")
    bounds = first.groupBy("query_id").agg(
        F.when(F.count("*") == options.k, F.max("score")).alias("bound"))
    # Other cells: the cuts are walked with the bound, so a query meets only cells that can pass the test.
    asked = queries.join(bounds, "query_id", "left")
    others = asked.mapInArrow(_other_cells(cuts, options, dim), "query_id bigint, vec array<double>, bound double, cell int")
    others = work.save(others.join(names, "cell"), "others")
    return _best(first.unionByName(searched(others)), options.k).drop("rank")


def nearest(rows: DataFrame, is_query: Column, options: Options = Options(), id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of all rows but the query's own, nearest first.

    The score is the Euclidean distance in double precision; ties go to the smaller id. A query with fewer candidates
    than k gets all of them. Null, zero or non-finite vectors, and rows with a null id, take no part. Vectors of
    different lengths are not compared. Rows that repeat an id are the same row if their vectors are equal; a query's
    own id is never its neighbour. An empty table gives an empty table. `is_query` may use the id column only.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    usable = F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    named = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec"), is_query.alias("asks"))
    named = work.save(named.where(F.col("vec_id").isNotNull() & usable).distinct(), "vectors")
    out = None
    for r in named.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect():
        one = _one_size(named.where(F.size("vec") == r["dim"]), r["dim"], F.col("asks"), options)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.sparkSession.createDataFrame([], FOUND)
    return _best(out, options.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
