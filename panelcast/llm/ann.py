"""Nearest neighbours by largest inner product with a forest of hash prefixes.

Each tree gives a vector a string of sign bits of projections; the strings of a tree, sorted, are its array. A query
descends in every tree to the entries that share the longest prefix with its own string, and then all trees ascend
together, one bit at a time, until they hold enough candidates between them. Vectors are first lifted to one sphere by one added
coordinate, so that the smallest angle is the largest inner product, whatever the lengths.

For the descent, arrays of strings alone are cut by their first bits into cells that are sorted and searched by themselves; large cells are
cut further into blocks, each of which meets the queries of its cell. A query whose own cells hold too little ascends
past their borders, up to whole trees. For the ascent each vector is dealt once, to one of a fixed number of blocks that holds its part of
every tree, so no tree carries a copy of the vectors; every block gives each query the nearest of the entries that its trees hold at the
common level, scored once each in double precision. A block holds its queries with their nearest so far, and its vectors go past
them in bounded pieces, so that it gives each query one short list however many vectors there are. Equal vectors share one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import materialise

#: Trees, bits of a string, and entries that a cell should hold at least.
TREES, BITS, CELL = 24, 64, 1500
#: Candidates that the trees hold between them before the ascent ends, as a share of all vectors (a vector found in
#: several trees counts in each): without clusters in the data, neighbours are found only where much is looked at.
SHARE = 1.4
#: And so many candidates more for each neighbour asked for: in small tables this is all there is.
PER_NEIGHBOUR = 200
BLOCK, QUERY_BLOCK = 50_000, 4_000
#: Blocks that vectors are dealt to for the ascent, whatever their number: a query gets so many lists of its nearest.
BLOCKS = 24
#: Queries that a block holds at a time; beyond so many in all, vectors are dealt once for each such chunk.
HELD_QUERIES = 250_000
#: Queries that a piece of a block's vectors meets at a time.
QUERY_SLICE = 512


@lru_cache(maxsize=2 * TREES)
def planes(tree: int, dim: int, bits: int = BITS) -> np.ndarray:
    """Projections of a tree, orthogonal to each other in runs of `dim`."""
    rng, out = np.random.default_rng(1_000 + tree), []
    while sum(len(x) for x in out) < bits:
        out.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0].T)
    return np.concatenate(out)[:bits]


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """The hash strings of a tree as 64-bit numbers, first bit highest."""
    bits = (x @ planes(tree, x.shape[1]).T > 0).astype(np.uint64)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def cell_bits(n: int, trees: int, cell: int, target: int) -> int:
    """First bits of a string that name its cell: cells hold `cell` entries at least and all trees' cells of a query
    hold `target` between them, both on average."""
    return max(0, int(np.log2(max(min(n / cell, trees * n / target), 1))))


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): each different vector with its `keep` smallest ids. Ids are cut in tasks first, so a vector that very
    many rows share brings a few ids from each task. Only so many of equal vectors can be among the nearest of any query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vec", "ids"])
            held.clear()
            return batch

        size = 0
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (np.asarray(v, "<f8") + 0.0).tobytes()
                ids = held.setdefault(raw, [])
                ids.append(i)
                size += len(raw) * (len(ids) == 1)
                if len(ids) > 4 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if size > 64 << 20:
                yield out()
                size = 0
        if held:
            yield out()

    partial = rows.mapInArrow(run, "vec binary, ids array<long>")
    return partial.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def _grouped(rows: DataFrame, schema: str, work: Callable, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Runs `work` on each group as an Arrow table, many groups to a task, streaming over sorted partitions."""
    places = [rows.columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in places)))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if held and keys[at] != last:
                        yield from work(pa.Table.from_batches(held))
                        held.clear()
                    held.append(batch.slice(at, i - at))
                    last, at = keys[at], i
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(len(column), -1)


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Entries on one sphere: scaled by the longest length, with the missing length as one more coordinate."""
    y = x / longest
    rest = np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1)))
    return np.hstack([y, rest[:, None]])


def strings_of(vectors: DataFrame, trees: int, longest: float, prefix: int, query: bool) -> DataFrame:
    """Adds dim, tree, s (the string as a signed number in string order) and cell (its first bits): a row per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                raws = part.column(1).to_pylist()
                for width in {len(r) for r in raws}:
                    rows = np.asarray([i for i, r in enumerate(raws) if len(r) == width])
                    x = np.frombuffer(b"".join(raws[i] for i in rows), "<f8").reshape(len(rows), -1)
                    y = np.hstack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))]) if query else lift(x, longest)
                    own = part.take(pa.array(rows))
                    for tree in range(trees):
                        s = strings(y, tree)
                        cell = (s >> np.uint64(BITS - prefix)).astype(np.int64) if prefix else np.zeros(len(s), np.int64)
                        extra = [np.full(len(s), x.shape[1], np.int32), np.full(len(s), tree, np.int32), (s ^ np.uint64(1 << 63)).view(np.int64), cell]
                        yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(e) for e in extra]], names=[*part.schema.names, "dim", "tree", "s", "cell"])

    first = "qid long" if query else "ids array<long>"
    return vectors.mapInArrow(run, f"{first}, vec binary, dim int, tree int, s long, cell long")


def search(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = TREES, cell: int = CELL, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its `k` nearest found rows other than itself, ties to the smaller id.

    `queries` and `rows` hold key and vector. Vectors that are null, empty, zero or not finite take no part, nor rows
    with a null key; vectors of different dimensions do not meet. Repeated ids with one vector count once. A query looks
    at `share` of all vectors and PER_NEIGHBOUR for each neighbour at least, or at its whole trees where these hold less. One whose
    trees hold fewer than `k` rows between them is held against all vectors, in blocks.
    """
    good = F.col(key).isNotNull() & usable(F.col(vector))
    slim = lambda df: df.filter(good).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    index = materialise(distinct_vectors(slim(rows), k + 1).select("ids", "vec"), "vectors")
    asked = slim(queries).dropDuplicates()
    as_binary = asked.mapInArrow(_pack, "qid long, vec binary")
    questions = materialise(as_binary, "queries")
    lengths = index.mapInArrow(_lengths, "n double")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("longest")).first()
    n, longest = stats["n"], stats["longest"] or 1.0
    target = int(share * n) + PER_NEIGHBOUR * k
    prefix = cell_bits(n, trees, cell, target)
    entries = strings_of(index, trees, longest, prefix, False)
    found = strings_of(questions, trees, longest, prefix, True)
    place = ("dim", "tree", "cell")
    held = materialise(entries.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = held.select(*place, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # a cell is cut into as many blocks as its own entries need
    entries = entries.join(sizes, list(place)).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")).drop("blocks")

    # descent: how many entries share each prefix length with the query, summed over the trees; then the common level
    def levels(t: pa.Table) -> Iterator[pa.RecordBatch]:
        role = t.column("role").to_numpy()
        s = t.column("s").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        array, at = np.sort(s[role == 0]), np.flatnonzero(role == 1)
        if not len(at) or not len(array):
            return
        counts = np.zeros((len(at), BITS + 1), np.int64)
        for d in range(prefix, BITS + 1):
            low = s[at] >> np.uint64(BITS - d) << np.uint64(BITS - d) if d else np.zeros(len(at), np.uint64)
            high = low | (np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(d) if d < BITS else np.uint64(0))
            counts[:, d] = np.searchsorted(array, high, "right") - np.searchsorted(array, low, "left")
        yield pa.RecordBatch.from_arrays([t.column("qid").combine_chunks().take(pa.array(at)), pa.array(list(counts), pa.list_(pa.int64()))], names=["qid", "n"])

    probe = found.join(sizes, list(place)).select(*place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "s", "qid")
    strings_only = entries.select(*place, "block", F.lit(0).alias("role"), "s", F.lit(None).cast("long").alias("qid")).union(probe)
    per_tree = _grouped(strings_only, "qid long, n array<long>", levels, (*place, "block"), ("role",))
    summed = per_tree.select("qid", F.posexplode("n").alias("d", "n")).groupBy("qid", "d").agg(F.sum("n").alias("n"))
    # above the cells, whole cells are counted; a query that finds too little in whole trees takes them all
    above = F.explode(F.sequence(F.lit(0), F.lit(prefix))).alias("d")
    up = lambda df: df.withColumn("top", F.expr(f"shiftright(cell, {prefix} - d)"))
    wider = up(held.select("*", above)).groupBy("dim", "tree", "d", "top").agg(F.sum("n").alias("n"))
    over = up(found.select("qid", *place, above)).join(wider, ["dim", "tree", "d", "top"]).groupBy("qid", "d").agg(F.sum("n").alias("n"))
    enough = summed.union(over).groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("n") >= target, F.col("d"))), F.lit(0)).cast("int").alias("level"))
    level = materialise(enough, "levels")

    # ascent: every tree gives the entries at the common level. Vectors are dealt once, in blocks by hash; the trees' strings
    # follow from a vector, so a block's part of every tree is sorted where the block lies. The number of blocks is fixed, so the
    # lists that a query gets are too
    chunks = max(1, -(-questions.count() // HELD_QUERIES))
    base = index.select(F.pmod(F.xxhash64("vec"), F.lit(BLOCKS)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.octet_length("vec").alias("width"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("qid"), F.lit(None).cast("int").alias("level"), "ids", "vec")
    asked_at = questions.join(level, "qid").select(F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"), F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("chunk"), F.octet_length("vec").alias("width"), F.lit(-1).alias("role"), "qid", F.col("level"), F.lit(None).cast("array<long>").alias("ids"), "vec")
    nearest = lambda batches: _ascend(batches, trees, longest, k)
    both = base.union(asked_at).repartition("block", "chunk", "width").sortWithinPartitions("block", "chunk", "width", "role")
    hits = materialise(both.mapInArrow(nearest, "query_id long, vec_id long, score double"), "hits")

    have = hits.groupBy("query_id").agg(F.count_distinct("vec_id").alias("have"))
    few = questions.join(have, F.col("qid") == F.col("query_id"), "left").filter(F.coalesce("have", F.lit(0)) < k).select("qid", "vec")
    few = materialise(few, "few")
    if few.limit(1).count():
        hits = hits.union(against_all(index, few, n, k))
    return rank_nearest(hits, k)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(np.asarray(v, "<f8") + 0.0).tobytes() for v in b.column(1).to_pylist()], pa.binary())], names=["qid", "vec"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(np.frombuffer(v, "<f8"))) for v in b.column(1).to_pylist()], pa.float64())], names=["n"])


class _Block:
    """A piece of a block's vectors with every tree's part of them: its strings in order and the entry of each."""

    def __init__(self, parts: list[pa.RecordBatch], trees: int, longest: float):
        self.x = np.concatenate([_matrix(p.column("vec")) for p in parts])
        self.ids = [i for p in parts for i in p.column("ids").to_pylist()]
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        for tree in range(trees):
            s = np.concatenate([strings(lift(self.x[at : at + 2_000], longest), tree) for at in range(0, len(self.x), 2_000)])
            order = np.argsort(s, kind="stable")
            self.lists.append((s[order], order.astype(np.int32)))

    def answer(self, q: np.ndarray, qid: np.ndarray, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of the piece for each query, among the entries that any tree holds below the query's level: the query's
        place, id and score."""
        depth = level.astype(np.uint64)
        lifted = np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])
        ranges = []
        full, whole = np.uint64(0xFFFFFFFFFFFFFFFF), depth == 0
        keep = np.where(whole, np.uint64(0), full << np.where(whole, np.uint64(0), np.uint64(BITS) - depth))
        for tree, (array, _) in enumerate(self.lists):
            low = strings(lifted, tree) & keep
            ranges.append((np.searchsorted(array, low, "left"), np.searchsorted(array, low | ~keep, "right")))
        out_q, out_id, out_s, place = [], [], [], []
        for i in range(len(q)):
            met = np.zeros(len(self.x), bool)
            for (a, b), (_, order) in zip(ranges, self.lists):
                met[order[a[i] : b[i]]] = True
            at = np.flatnonzero(met)
            if len(at):
                # where most are met, a product over the whole piece costs less than a copy of those met
                rough = (self.x @ q[i])[at] if 2 * len(at) > len(self.x) else self.x[at] @ q[i]
                _take_nearest(self.x, self.ids, q[i], qid[i], k, out_q, out_id, out_s, rough, at)
            place += [i] * (len(out_q) - len(place))
        return np.asarray(place, np.int64), np.asarray(out_id, np.int64), np.asarray(out_s, np.float64)


class _Asked:
    """The queries of a block in one chunk, with the k nearest of each from the pieces that have gone past."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        self.q = np.concatenate([_matrix(p.column("vec")) for p in parts])
        self.qid = np.concatenate([p.column("qid").to_numpy() for p in parts])
        self.level = np.concatenate([p.column("level").to_numpy() for p in parts])
        self.k = k
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * -(-len(self.q) // QUERY_SLICE)

    def meet(self, piece: _Block) -> None:
        for n, held in enumerate(self.found):
            own = slice(n * QUERY_SLICE, (n + 1) * QUERY_SLICE)
            new = piece.answer(self.q[own], self.qid[own], self.level[own], self.k)
            self.found[n] = new if held is None else _nearest_of([held, new], self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for n, held in enumerate(self.found):
            if held is not None and len(held[0]):
                place, ids, scores = held
                yield pa.RecordBatch.from_arrays([pa.array(self.qid[n * QUERY_SLICE + place]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def _nearest_of(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first different ids of each place by falling score, ties to the smaller id."""
    place, ids, scores = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((-scores, ids, place))  # of an id with several vectors the best counts
    same = (np.diff(place[order]) == 0) & (np.diff(ids[order]) == 0)
    order = order[np.concatenate([[True], ~same])] if len(order) else order
    order = order[np.lexsort((ids[order], -scores[order], place[order]))]
    first = np.searchsorted(place[order], place[order], "left")
    order = order[np.arange(len(order)) - first < k]
    return place[order], ids[order], scores[order]


def _ascend(batches: Iterator[pa.RecordBatch], trees: int, longest: float, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one chunk and width each, queries first: these are held, and the vectors go past in pieces."""
    last, asked, held, size = None, [], [], 0
    queries: _Asked | None = None

    def meet() -> None:
        nonlocal held, size, queries, asked
        if held and (asked or queries):
            if queries is None:
                queries, asked = _Asked(asked, k), []
            queries.meet(_Block(held, trees, longest))
        held, size = [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "width", "role"))))
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at]:
                continue
            if keys[at][:3] != last:
                meet()
                if queries is not None:
                    yield from queries.rows()
                last, asked, queries = keys[at][:3], [], None
            if keys[at][3] < 0:
                asked.append(batch.slice(at, i - at).select(["qid", "level", "vec"]))
            elif asked or queries:
                held.append(batch.slice(at, i - at).select(["ids", "vec"]))
                size += i - at
                if size >= BLOCK:
                    meet()
            at = i
    meet()
    if queries is not None:
        yield from queries.rows()


def _take_nearest(x: np.ndarray, ids: list, q: np.ndarray, qid: int, k: int, out_q: list, out_id: list, out_s: list, rough: np.ndarray, at: np.ndarray | None = None) -> None:
    """Appends the k nearest of the entries for one query, leaving out its own id; scores are the sums of the products, rounded once.

    `rough` holds the products up to rounding, of the entries `at` or of all."""
    if len(rough) > 2 * k + 2:
        least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
        pick = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least)))
    else:
        pick = np.arange(len(rough))
    pick = pick if at is None else at[pick]
    rows = sorted((-fsum(p), i) for j, p in zip(pick, (x[pick] * q).tolist()) for i in ids[j] if i != qid)[:k]
    out_q += [int(qid)] * len(rows)
    out_id += [i for _, i in rows]
    out_s += [-e for e, _ in rows]


def against_all(index: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """The nearest of all vectors for a stated set of queries, in blocks of vectors and of queries."""
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    base = index.select(F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("qid"), "ids", "vec")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("role"), "qid", F.lit(None).cast("array<long>").alias("ids"), "vec")

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        role, raws, ids = t.column("role").to_numpy(), t.column("vec").to_pylist(), t.column("ids").to_pylist()
        out_q, out_id, out_s = [], [], []
        qid = t.column("qid").to_pylist()
        for width in {len(raws[i]) for i in np.flatnonzero(role == 1)}:
            base = [i for i in np.flatnonzero(role == 0) if len(raws[i]) == width]
            x = np.frombuffer(b"".join(raws[i] for i in base), "<f8").reshape(len(base), -1)
            own = [ids[i] for i in base]
            for i in np.flatnonzero(role == 1):
                if len(raws[i]) == width:
                    v = np.frombuffer(raws[i], "<f8")
                    _take_nearest(x, own, v, qid[i], k, out_q, out_id, out_s, x @ v)
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    return _grouped(base.union(asked), "query_id long, vec_id long, score double", work, ("block", "chunk"), ("role",))


def rank_nearest(hits: DataFrame, k: int) -> DataFrame:
    """The k first of each query's distinct hits by falling score, ties to the smaller id."""
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    near = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("near"))
    return near.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x")["vec_id"].alias("vec_id"), (-F.col("x")["far"]).alias("score"))
