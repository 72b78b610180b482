"""Near-duplicates by MinHash signatures and an inverted join of their coordinates.

Texts with equal shingle sets form a class, and classes take the place of texts from there on. Each class has a
signature; two classes that agree in at least `matches` of `coordinates` coordinates are compared on their full sets.
(coordinate, value) pairs are ordered from the rarest to the most frequent, by counts over the whole corpus. Two
classes with enough matches share one of their rarest `coordinates - matches + 1` pairs, so only these are posted, and
a class whose rarest pairs are its own posts nothing. Long lists of frequent pairs are never merged: they are only
probed, by comparing signatures, for classes that met in a posted list.

Classes that meet in posted lists form a group. A group is linked in one task, skipping pairs that are connected
already. A large group is dealt into chunks: chunks are linked with a few leaders first, which connects most of it;
then the classes outside its largest component are compared with all chunks, so that no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.llm import work
from corpusmap.llm.blocks import block_numbers, column, from_bytes, table_from_bytes, table_to_bytes, to_bytes
from corpusmap.llm.graph import components
from corpusmap.llm.texts import mix, one_array, slices, window_keys, windows, word_keys, words

BLOCK_ROWS = 2048
VALUE_BITS = 32
MESSAGE = "part int, block bigint, data binary"
MEMBER = ["grp", "node", "label", "role", "sig", "shingles", "posted"]


@dataclass(frozen=True)
class Options:
    """`matches` lies 5 deviations below what texts at the threshold agree in on average."""

    size: int = 4  # words in a shingle
    percent: int = 80  # least 100 * intersection / union
    coordinates: int = 64
    matches: int = 35
    chunk: int = 1024  # classes in a chunk of a large group
    chunk_shingles: int = 2_000_000
    leaders: int = 32
    block_tokens: int = 500_000

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1

    @property
    def token_bits(self) -> int:
        return VALUE_BITS + max(1, math.ceil(math.log2(self.coordinates)))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted keys of its distinct shingles; a text of fewer words is one shingle."""
    flat, counts = words(texts, lower=True)
    keys = word_keys(flat)
    starts = windows(counts, size)
    found = window_keys(keys, starts, size)
    ends = np.cumsum(counts)
    edges = np.searchsorted(starts, np.concatenate([[0], ends]))
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
        if n >= size:
            yield np.unique(found[edges[i]:edges[i + 1]])
        elif n:
            yield np.array([xxhash.xxh3_64_intdigest(keys[end - n:end].tobytes(), seed=n)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[a:a + 4096, None] * multipliers).min(axis=0))
    return (low >> np.uint64(64 - VALUE_BITS)).astype(np.uint32)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def _signed(options: Options):
    def run(batches):
        multipliers = _multipliers(options.coordinates)
        for batch in batches:
            texts = one_array(batch.column(1))
            for a, b in slices(texts):
                sets = list(shingle_sets(texts.slice(a, b - a), options.size))
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(a, b - a), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "d1": pa.array([d[0] for d in digests], pa.int64()),
                    "d2": pa.array([d[1] for d in digests], pa.int64()),
                    "sig": pa.array([signature(s, multipliers).tobytes() if len(s) else None for s in sets], pa.binary()),
                })

    return run


def _class_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = block_numbers()
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part, number = pa.Table.from_batches([batch.slice(a, BLOCK_ROWS)]), next(numbers)
            part = part.append_column("node", pa.array(number * BLOCK_ROWS + np.arange(len(part)), pa.int64()))
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([number], pa.int64()), "data": pa.array([table_to_bytes(part)], pa.binary())})


def _scatter(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2 ** bits to others, one to one, so that their upper bits are even."""
    mask, factor = np.uint64((1 << bits) - 1), np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        x = (x * factor) & mask
        x ^= x >> np.uint64(bits // 2)
    return x


def _tokens(table: pa.Table, options: Options) -> np.ndarray:
    """A row of (coordinate, value) pairs for each class, each pair as one number.

    Values are minima and crowd near 0, so the numbers are scattered: parts are cut by their upper bits.
    """
    sig = np.frombuffer(b"".join(column(table, "sig").to_pylist()), np.uint32).reshape(len(table), -1)
    shift = np.uint64(options.token_bits - VALUE_BITS)
    pairs = (sig.astype(np.uint64) << shift) | np.arange(options.coordinates, dtype=np.uint64)
    return _scatter(pairs, options.token_bits)


def _part_bits(n_tokens: int, options: Options) -> int:
    return max(1, math.ceil(math.log2(max(1, n_tokens / options.block_tokens))))


def _edges(tokens: np.ndarray, bits: int, options: Options) -> np.ndarray:
    return np.searchsorted(tokens >> np.uint64(options.token_bits - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _send_tokens(bits: int, options: Options):
    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                tokens, times = np.unique(_tokens(table_from_bytes(data.as_py()), options), return_counts=True)
                edges = _edges(tokens, bits, options)
                parts = np.flatnonzero(np.diff(edges)).tolist()
                rows = [to_bytes(np.concatenate([tokens[edges[p]:edges[p + 1]], times[edges[p]:edges[p + 1]].astype(np.uint64)]))
                        for p in parts]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(parts, pa.int32()), "block": pa.array([block] * len(parts), pa.int64()),
                    "data": pa.array(rows, pa.binary())})

    return send


def _count_tokens(messages: pa.Table) -> pa.Table:
    parts = [from_bytes(d.as_py(), np.uint64).reshape(2, -1) for d in messages.column("data")]
    both = np.concatenate(parts, axis=1)
    _, group = np.unique(both[0], return_inverse=True)
    counts = np.bincount(group, weights=both[1]).astype(np.int64)[group]
    answers = [to_bytes(x) for x in np.split(counts, np.cumsum([p.shape[1] for p in parts])[:-1])]
    return messages.select(["part", "block"]).append_column("data", pa.array(answers, pa.binary()))


def _post(options: Options):
    """The rarest pairs of each class that other classes have too."""

    def post(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        by_part = sorted(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist()))
        counts = np.concatenate([from_bytes(d, np.int64) for _, d in by_part])
        nodes, posted = [], []
        for data in blocks.column("data"):
            table = table_from_bytes(data.as_py())
            tokens = _tokens(table, options)
            _, place = np.unique(tokens, return_inverse=True)
            times = counts[place.reshape(tokens.shape)]
            order = np.lexsort((tokens, times), axis=1)[:, :options.prefix]
            shared = np.take_along_axis(times, order, 1) >= 2
            nodes.append(np.repeat(column(table, "node").to_numpy(), shared.sum(axis=1)))
            posted.append(np.take_along_axis(tokens, order, 1)[shared])
        return pa.table({"node": pa.array(np.concatenate(nodes), pa.int64()),
                         "token": pa.array(np.concatenate(posted).astype(np.int64), pa.int64())})

    return post


class Roots:
    """Union-find over a task's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


class Members:
    """Classes of a task: signatures, shingles and posted pairs."""

    def __init__(self, table: pa.Table):
        self.node = table.column("node").to_numpy()
        self.label = table.column("label").to_numpy()
        self.role = table.column("role").to_numpy()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(table), -1)
        self.shingles = [from_bytes(s, np.uint64) for s in table.column("shingles").to_pylist()]
        self.n = np.array([len(s) for s in self.shingles], np.int64)
        self.posted = table.column("posted").to_pylist()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(m: Members, options: Options) -> Iterator[tuple[int, int]]:
    """Edges between rows, enough to connect all linked rows whose labels differ.

    Rows of role 1, if there are any, are compared with the others only; equal labels mean connected rows.
    """
    lists: dict[int, list[int]] = {}
    roots, first = Roots(len(m.node)), {}
    for i, (label, posted) in enumerate(zip(m.label.tolist(), m.posted)):
        roots.join(first.setdefault(label, i), i)
        for token in posted:
            lists.setdefault(token, []).append(i)
    index = {token: np.array(rows) for token, rows in lists.items() if len(rows) > 1}
    one_sided = bool((m.role == 1).any())
    for i in range(len(m.node)):
        if one_sided and m.role[i] != 1:
            continue
        # Merge the posted lists; all other coordinates are probed only.
        met = [index[t] for t in m.posted[i] if t in index]
        if not met:
            continue
        near = np.unique(np.concatenate(met))
        near = near[m.role[near] != 1] if one_sided else near[near > i]
        near = near[(100 * np.minimum(m.n[near], m.n[i]) >= options.percent * np.maximum(m.n[near], m.n[i]))]
        matches = (m.sig[near] == m.sig[i]).sum(axis=1)
        near, matches = near[matches >= options.matches], matches[matches >= options.matches]
        for j in near[np.argsort(-matches, kind="stable")].tolist():
            if m.node[j] != m.node[i] and roots.find(i) != roots.find(j) and _similar(
                    m.shingles[i], m.shingles[j], options.percent):
                roots.join(i, j)
                yield i, j


def _link_groups(options: Options):
    def run(rows: pa.Table) -> pa.Table:
        a, b = [], []
        rows = rows.sort_by([("grp", "ascending"), ("role", "ascending"), ("node", "ascending")])
        grp = rows.column("grp").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
        for x, y in zip(cuts, cuts[1:]):
            m = Members(rows.slice(x, y - x))
            for i, j in link(m, options):
                a.append(int(m.node[i]))
                b.append(int(m.node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_shingles(options: Options):
    def run(batches):
        for batch in batches:
            texts = one_array(batch.column(1))
            for a, b in slices(texts):
                sets = list(shingle_sets(texts.slice(a, b - a), options.size))
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "d1": pa.array([d[0] for d in digests], pa.int64()),
                    "d2": pa.array([d[1] for d in digests], pa.int64()),
                    "shingles": pa.array([to_bytes(s) if len(s) else None for s in sets], pa.binary())})

    return run


def _buckets(n: int, each: int) -> int:
    return max(1, -(-n // each))


def _large_edges(members: DataFrame, sizes: DataFrame, options: Options) -> DataFrame:
    """Edges of the large groups, whose sizes are given as (grp, chunks)."""
    dealt = members.join(sizes, "grp").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = work.save(dealt, "large-groups")
    run = _link_groups(options)

    def linked(rows: DataFrame, *keys: str) -> DataFrame:
        # Else Spark takes a partitioning by group alone as good enough, and a large group stays in one task.
        return rows.repartition("grp", *keys).groupBy("grp", *keys).applyInArrow(
            lambda t: run(t.select(MEMBER)), "a bigint, b bigint")

    # Chunks with the leaders of their group: connects most of it.
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64(F.lit("leader"), "node"), "node"))
    leaders = dealt.withColumn("rank", rank).where(F.col("rank") <= options.leaders).drop("rank")
    everywhere = leaders.withColumn("own", F.col("chunk")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))).where("chunk <> own").drop("own")
    first = work.save(linked(dealt.unionByName(everywhere), "chunk"), "first-links")
    # The rest against all chunks.
    roots = components(first)
    labelled = dealt.drop("label").join(roots, "node", "left").withColumn(
        "label", F.coalesce("root", "node")).drop("root")
    labelled = work.save(labelled, "labelled-groups")
    # A row per large group, written so that Spark knows how small the table is and leaves the classes where they are.
    main = work.save(labelled.groupBy("grp", "label").count().groupBy("grp").agg(
        F.max_by("label", F.struct("count", F.col("label"))).alias("main")), "main-labels")
    rest = labelled.join(main, "grp").where("label <> main").drop("main")
    rest_chunks = work.save(
        rest.groupBy("grp").agg(F.ceil(F.count("*") / options.chunk).cast("int").alias("rests")), "rests")
    rest = rest.join(rest_chunks, "grp").withColumn("rest", F.pmod(F.xxhash64("node"), F.col("rests")).cast("int"))
    asking = rest.withColumn("role", F.lit(1)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    asked = labelled.join(rest_chunks, "grp").withColumn(
        "rest", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    cross = linked(asking.unionByName(asked), "chunk", "rest")
    return work.save(first.unionAll(cross), "large-links")


def near_duplicates(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """A row (id, n_shingles, component_id, kept) for each row of `docs`.

    Words are runs without ASCII white space with A-Z lower-cased. Rows are linked if 100 * intersection is at least
    `percent` * union of their shingle sets; component_id is the smallest id that a row reaches, its own included, and
    kept says that it is its own. Ids are integers. A row without words is linked with nothing, and neither is a row
    with a null id: it gets a null component and is kept. Rows that share an id are rows of their own, each kept if its
    id is the smallest reached. An empty table gives an empty table. Of the columns only id and text are read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = work.save(source.mapInArrow(_signed(options), "id bigint, n bigint, d1 bigint, d2 bigint, sig binary"), "signatures")
    linkable = (F.col("n") > 0) & F.col("id").isNotNull()
    classes = rows.where(linkable).groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    blocks = work.save(classes.mapInArrow(_class_blocks, "block bigint, data binary"), "classes")

    def flat(batches):
        for batch in batches:
            for data in batch.column("data"):
                yield from table_from_bytes(data.as_py()).select(["node", "rep", "n", "d1", "d2", "sig"]).to_batches()

    nodes = blocks.mapInArrow(flat, "node bigint, rep bigint, n bigint, d1 bigint, d2 bigint, sig binary")
    n_tokens = blocks.count() * BLOCK_ROWS * options.coordinates
    bits = _part_bits(n_tokens, options)
    answers = work.save(blocks.mapInArrow(_send_tokens(bits, options), MESSAGE).groupBy("part").applyInArrow(
        _count_tokens, MESSAGE), "token-counts")
    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    posted = work.save(both.applyInArrow(_post(options), "node bigint, token bigint"), "posted")

    # Groups: classes that meet in a list. A star per list connects it.
    heads = posted.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    meet = posted.join(heads, "token").select("node", "head")
    groups = work.save(components(meet).select("node", F.col("root").alias("grp")), "groups")
    own_lists = posted.join(groups.select("node"), "node", "left_semi").groupBy("node").agg(
        F.collect_list("token").alias("tokens"))  # at most `prefix` of them
    wanted = nodes.join(groups, "node").join(own_lists, "node")
    wanted = work.save(wanted, "candidates")
    # The same join at every size: candidates grow with the corpus, so they are never sent to all tasks.
    texts = source.join(wanted.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    shingles = texts.select("id", "text").mapInArrow(_with_shingles(options), "d1 bigint, d2 bigint, shingles binary")
    members = wanted.join(shingles.dropDuplicates(["d1", "d2"]), ["d1", "d2"]).select(
        "grp", "node", F.col("node").alias("label"), F.lit(0).alias("role"), "sig", "shingles",
        F.col("tokens").alias("posted"), "n")
    members = work.save(members, "members")

    sizes = members.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("rows") / options.chunk), F.ceil(F.col("total") / options.chunk_shingles))
    large = work.save(sizes.select("grp", chunks.alias("chunks")).where("chunks > 1"), "large")
    n_members, n_large = members.count(), large.count()
    small = members.join(large, "grp", "left_anti").drop("n")
    bucket = F.pmod(F.xxhash64("grp"), F.lit(_buckets(n_members, 2 * options.chunk))).alias("bucket")
    run = _link_groups(options)
    edges = small.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "a bigint, b bigint")
    if n_large:
        edges = edges.unionAll(_large_edges(members.drop("n"), large, options))

    roots = components(edges)
    reps = nodes.select("node", "rep", "d1", "d2").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = work.save(reps.join(least, "root").select("d1", "d2", "component_id"), "components")
    out = rows.join(found, ["d1", "d2"], "left")
    component = F.when(linkable, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
