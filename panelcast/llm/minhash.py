"""Near-duplicates by an inverted join of MinHash signature coordinates.

Documents are sets of word shingles. Texts with equal sets form one class, and one document stands for it. Every class
is posted under (coordinate, value) pairs of its signature. A pair of sets that is similar enough agrees in at least T
of K coordinates, so it shares a value among the K - T + 1 rarest of either side: only values that two classes
share count at all, and each class is posted under its rarest values up to that prefix, skipping the long lists of
values that many texts share. Lists are merged without making all pairs of a list: first each class is compared with the
most central class of its lists; classes found linked are one component; then members of other components are
compared with their nearest in the list, and last all list members that are still in different components, in blocks.
Pairs with fewer collisions over the full signature than the match threshold are dropped, the others are confirmed on
the full sets. Components are closed over the confirmed links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import OWN, byte_slices
from panelcast.session import materialise, scratch_path

#: Words of a shingle, and the similarity of linked documents in percent (intersection to union).
WORDS, PERCENT = 5, 85
#: Coordinates of a signature; of these the first POSTED are posted.
COORDINATES, POSTED = 128, 32
#: Chances that a pair at exactly the asked similarity agrees in too few posted coordinates, and in too few of all.
MISS_POSTED, MISS_ALL = 1e-6, 3e-5


def least_agreement(n: int, percent: int, miss: float) -> int:
    """The most coordinates of `n` that can be asked to agree while a pair at this similarity fails with a chance under `miss`; one at least."""
    p, below = percent / 100, 0.0
    for k in range(n + 1):
        below += comb(n, k) * p**k * (1 - p) ** (n - k)
        if below >= miss:
            return max(1, k)
    return n


def shared_at(percent: int) -> int:
    """Posted coordinates in which a pair of this similarity must agree."""
    return least_agreement(POSTED, percent, MISS_POSTED)


def matches_at(percent: int) -> int:
    """Coordinates of the whole signature in which it must."""
    return least_agreement(COORDINATES, percent, MISS_ALL)


SHARED, MATCHES = shared_at(PERCENT), matches_at(PERCENT)
#: List members compared at once.
BLOCK = 1024

_WORD_HASHES: dict[bytes, int] = {}


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


MULTIPLY, ADD = _odd(7, COORDINATES), _odd(11, COORDINATES)
PLACE = _odd(13, WORDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n-word shingles; of the whole sequence where there are fewer words."""
    words = text.lower().split()  # for bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    memo = _WORD_HASHES
    if len(memo) > 100_000:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    places = PLACE if n == WORDS else _odd(13, n)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * places[k]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    """Per coordinate the least value of a hash over the set."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        x = s[at : at + 2048, None] * MULTIPLY + ADD
        np.minimum(low, (x >> np.uint64(32)).astype(np.uint32).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    """A signature for the way: posted coordinates whole, of the others one byte. Bytes agree wherever values do."""
    return low[:POSTED].astype("<u4").tobytes() + low[POSTED:].astype(np.uint8).tobytes()


def unpacked(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Posted coordinates and bytes of the others, a row per signature."""
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), 3 * POSTED + COORDINATES)
    return np.ascontiguousarray(raw[:, : 4 * POSTED]).view("<u4"), raw[:, 4 * POSTED :]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sign(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """doc_id, n_shingles, cls (128-bit hash of the set, null for an empty one), sig."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            sizes, classes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(packed(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def posted_values(classes: DataFrame, shared_least: int = SHARED) -> DataFrame:
    """(id, v, weight): the posted values of each class and its centrality, the sum of its lists' lengths."""
    schema = "id long, v long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(POSTED, dtype=np.int64) << 32
        for batch in batches:
            if batch.num_rows:
                low = unpacked(batch.column(1).to_pylist())[0]
                ids = np.repeat(batch.column(0).to_numpy(), POSTED)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((low.astype(np.int64) | high).ravel())], names=["id", "v"])

    values = classes.select("id", "sig").mapInArrow(run, schema)
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumnRenamed("v", "w")
    found = values.join(shared, F.col("v") == F.col("w")).select("id", "v", "df")
    per = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"), F.sum("df").alias("weight"))  # at most POSTED each
    # values that no other class has are the rarest; they take the first places of the prefix
    take = F.size("shared") - shared_least + 1
    return per.filter(take > 0).select("id", "weight", F.explode(F.slice("shared", F.lit(1), take)).alias("x")).select("id", F.col("x")["v"].alias("v"), "weight")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield batch.slice(at, 512)


def keep_by_id(sets: DataFrame) -> tuple[DataFrame, str]:
    """The sets as a table bucketed by id, so that no later join on id shuffles them; and the table's name."""
    spark = sets.sparkSession
    name = f"near_sets_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets.write.format("parquet").option("path", scratch_path(spark, "sets")).bucketBy(buckets, "id").sortBy("id").saveAsTable(name)
    return spark.table(name), name


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): the pairs with a column of either side. Many pairs may share b: its few values are written, so that
    the second join is one of two shuffles, which adaptive execution splits."""
    ends = pairs.select(F.col("b").alias("end")).distinct()
    right = materialise(sets.join(ends, F.col("id") == F.col("end"), "left_semi").select(F.col("id").alias("b"), F.col(column).alias("y")), "ends")
    left = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col(column).alias("x")), "a")
    return left.join(right, "b").select("a", "b", "x", "y")


def alike(pairs: DataFrame, sets: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _arrays(batches):
            (wa, ta), (wb, tb) = unpacked(batch.column(2).to_pylist()), unpacked(batch.column(3).to_pylist())
            n = (wa == wb).sum(axis=1) + (ta == tb).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(n >= matches))

    return _beside(pairs, sets, "sig").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _arrays(batches):
            ok = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _beside(pairs, sets, "shingles").mapInArrow(run, "a long, b long")


def ordered(links: DataFrame) -> DataFrame:
    """Each link once, the smaller id first."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """(id, component): every id of a link with the least id it reaches.

    Each round every vertex takes the least label among its own and its neighbours', then its label's label; rounds end
    when no label moves. Labels are written between rounds, so a lost executor costs a re-read.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    edges = materialise(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias(label)), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min(label).alias("near"))
        hop = labels.select(F.col("id").alias(label), F.col(label).alias("hop"))
        new = labels.join(near, "id").join(hop, label).select("id", F.col(label).alias("old"), F.least("near", "hop").alias(label))
        new = materialise(new, "labels")
        moved = new.filter(F.col("old") > F.col(label)).limit(1).count()
        labels = new.select("id", label)
        if not moved:
            return labels


def _by_group(rows: DataFrame, schema: str, work: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """Runs `work` on each (v, block, probe), many to a task, streaming over sorted partitions."""
    rows = rows.repartition("v", "block", "probe").sortWithinPartitions("v", "block", "probe", "role", "id")
    places = [rows.columns.index(c) for c in ("v", "block", "probe")]

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
                        yield work(pa.Table.from_batches(held))
                        held.clear()
                    held.append(batch.slice(at, i - at))
                    last, at = keys[at], i
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def candidates(t: pa.Table, nearest: bool, matches: int = MATCHES) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking row of a group with the rows of other components that have enough collisions with it; with `nearest`
    only the one with most, else only those whose first common list this is."""
    role, ids, comp, posted = (t.column(c).to_numpy() for c in ("role", "id", "comp", "posted"))
    base = np.flatnonzero(role == 0)
    if not len(base) or not role.any():
        return
    whole, tail = unpacked(t.column("sig").to_pylist())
    bits = np.uint32(1) << np.arange(POSTED, dtype=np.uint32)
    posted = posted.astype(np.uint32)[:, None] & bits != 0
    here = int(t.column("v")[0].as_py()) >> 32
    for i in np.flatnonzero(role == 1):
        other = base[(comp[base] != comp[i]) & (ids[base] != ids[i])]
        same = whole[other] == whole[i]
        n = same.sum(axis=1) + (tail[other] == tail[i]).sum(axis=1)
        if nearest:
            hit = other[[n.argmax()]] if len(n) and n.max() >= matches else other[:0]
        else:
            some = np.flatnonzero(n >= matches)
            hit = other[some[(same[some] & posted[other[some]] & posted[i]).argmax(axis=1) == here]] if len(some) else other[:0]
        if len(hit):
            yield i, hit


def open_lists(posts: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, role, block, probe, id, comp, sig, posted): members of lists that hold more than one component.

    Members are cut into blocks that stay (role 0); those outside a list's largest component also ask (role 1) and meet
    every block.
    """
    member = posts.join(comps, "id", "left").select("v", "id", F.coalesce("component", "id").alias("comp"))
    sizes = member.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("n"))
    lists = sizes.groupBy(F.col("v").alias("w")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("main_n"))
    several = lists.filter("kinds > 1").select("w", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("main_n")) / BLOCK).cast("int").alias("probes"))
    every = posts.groupBy("id").agg(F.sum(F.expr("shiftleft(1L, int(shiftright(v, 32)))")).alias("posted"))
    found = member.join(several, F.col("v") == F.col("w")).drop("w")
    wide = found.join(classes.select("id", "sig"), "id").join(every, "id")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    kept = wide.select("v", F.lit(0).alias("role"), spread("blocks", 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("probe"), "id", "comp", "sig", "posted")
    asked = wide.filter(F.col("comp") != F.col("main")).select("v", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), spread("probes", 2).alias("probe"), "id", "comp", "sig", "posted")
    return kept.union(asked)


def nearest_pairs(rows: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(a, b): of each asking member the pair with most collisions in each block of its lists."""

    def work(t: pa.Table) -> pa.RecordBatch:
        ids, hits = t.column("id").to_numpy(), list(candidates(t, True, matches))
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in hits], pa.int64()), pa.array([ids[h[0]] for _, h in hits], pa.int64())], names=["a", "b"])

    return _by_group(rows, "a long, b long", work).distinct()


def links_between(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components that share a list, on full sets.

    A first pass finds on signatures which members of a block have candidates there; only these bring their sets into
    the second, which compares inside tasks. So no pair comes out that is not a link, however many are almost alike.
    """
    matches = matches_at(percent)
    columns = ["v", "role", "block", "probe", "id", "comp", "sig", "posted"]

    def taking_part(t: pa.Table) -> pa.RecordBatch:
        part: set[int] = set()
        for i, hit in candidates(t, False, matches):
            part.add(int(i))
            part.update(hit.tolist())
        rows = t.take(pa.array(sorted(part), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else empty[c] for c in columns], names=columns)

    schema = "v long, role int, block int, probe int, id long, comp long, sig binary, posted long"
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    empty = {c: pa.array([], kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))}
    part = materialise(_by_group(rows.select(*columns), schema, taking_part), "members")
    wide = part.join(sets.select("id", "shingles"), "id")

    def compare(t: pa.Table) -> pa.RecordBatch:
        ids, sigs = t.column("id").to_numpy(), [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
        sizes = np.asarray([len(x) for x in sigs])
        words, place = np.unique(np.concatenate(sigs), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark = np.zeros(len(words), np.int64)
        out_a, out_b = [], []
        for i, hit in candidates(t, False, matches):
            own = place[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[place], starts)[hit]
            mark[own] = 0
            hit = hit[100 * both >= percent * (sizes[hit] + sizes[i] - both)]
            out_a += [int(ids[i])] * len(hit)
            out_b += ids[hit].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return _by_group(wide, "a long, b long", compare)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (least key reachable over links), n_links, kept.

    n_links counts confirmed links that were needed to close the component, at most those that exist; equal sets are one
    class. A link at exactly `percent` is missed with a chance under MISS_POSTED + MISS_ALL, more only where one shared coordinate is
    too much to ask (under 31 percent). Empty texts are linked with nothing. Rows that share a key are one document with several texts; a row with
    a null key follows its class and is kept only where nothing else has its set. An empty table gives no rows.
    """
    signed = materialise(sign(docs, key, text, words), "signatures")
    full = signed.filter(F.col("cls").isNotNull())
    classes = materialise(full.groupBy("cls").agg(F.min("doc_id").cast("long").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")).filter(F.col("id").isNotNull()), "classes")
    posts = materialise(posted_values(classes, shared_at(percent)), "posts")
    # rows of a posted class meet its hash by id; the set of a row is cut in the same task and kept where it is the class's
    wanted = classes.join(posts.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("class_id"), "cls", "sig")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(buckets, "id").join(wanted, F.col("id") == F.col("class_id")).select("id", "text", "cls", "sig")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of repeated rows, which lie side by side here, one
        last = None
        for batch in byte_slices(batches, "text"):
            ids, sets, ok = batch.column(0).to_pylist(), [], []
            for i, t, c in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if i != last:
                    seen.clear()
                    last = i
                s = shingles(t, words)
                ok.append(c not in seen and xxhash.xxh3_128_digest(s.tobytes()) == c)
                sets.append(s.astype("<u8").tobytes() if ok[-1] else b"")
                if ok[-1]:
                    seen.add(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(sets, pa.binary())], names=["id", "sig", "shingles"]).filter(pa.array(ok, pa.bool_()))

    sets, table = keep_by_id(rows.sortWithinPartitions("id").mapInArrow(cut, "id long, sig binary, shingles binary"))

    centres = posts.groupBy(F.col("v").alias("w")).agg(F.max(F.struct(F.col("weight"), (-F.col("id")).alias("minus"))).alias("top"))
    best = posts.join(centres, F.col("v") == F.col("w")).groupBy("id").agg(F.max("top").alias("top"))
    star = best.select(F.col("id").alias("a"), (-F.col("top")["minus"]).alias("b")).filter("a <> b")
    star = materialise(alike(materialise(star, "star"), sets, matches_at(percent)), "star")
    links = materialise(ordered(confirm(star, sets, percent)), "links")
    comps = components(links)
    # then what most likely joins components, and last all that could still join two
    pairs = materialise(nearest_pairs(open_lists(posts, comps, classes), matches_at(percent)), "pairs")
    links = materialise(ordered(links.union(confirm(pairs, sets, percent))), "links")
    comps = components(links)
    more = links_between(open_lists(posts, comps, classes), sets, percent)
    links = materialise(ordered(links.union(more)), "links")
    comps = components(links)
    docs.sparkSession.sql(f"DROP TABLE {table}")  # its name only
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    # a row finds its class, the class its component: the class side has one row per set, the rows may be hot
    named = classes.join(comps, "id", "left").join(degree, "id", "left").select(F.col("cls").alias("class"), "id", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("links"))
    out = signed.select("doc_id", "n_shingles", "cls").join(named, F.col("cls") == F.col("class"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id").cast("long")).otherwise(F.col("component"))
    return out.select(
        F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.col("doc_id").cast("long").eqNullSafe(component).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, one of each group of near-duplicates: that with the least key.

    Rows of one key and one text are one document, of which one row stays. Different texts under one key, and texts without a
    key, are documents of their own: the one with the least text hash goes by the key, the others by numbers beyond all keys.
    Rows without words are linked with nothing and all stay. Keys must lie under 2^62.
    """
    mark, own, kept = f"{OWN}hash", f"{OWN}row", f"{OWN}kept"
    spoken = F.coalesce(F.col(text).cast("string").rlike("[^ \\t-\\r]"), F.lit(False))
    worded = docs.filter(spoken).withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    ids = worded.select(F.col(key).cast("long").alias(own), mark).filter(F.col(own).isNotNull()).distinct()
    least = ids.groupBy(own).agg(F.min(mark).alias("least"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    # Usually empty, and written, so that the join below knows its size before any text moves.
    others = materialise(ids.join(least, own).filter(F.col(mark) != F.col("least")).select(F.col(own).alias(f"{OWN}k"), F.col(mark).alias(f"{OWN}h")), "others")
    first = F.when(F.col(key).isNull(), F.lit(3 << 61)).otherwise(F.lit(1 << 62))  # those without a key come last
    beyond = first + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(-1)), mark), 3)
    if others.isEmpty():
        numbered = worded.withColumn(own, F.coalesce(F.col(key).cast("long"), beyond))
    else:
        same = (F.col(key).cast("long") == F.col(f"{OWN}k")) & (F.col(mark) == F.col(f"{OWN}h"))
        numbered = worded.join(others, same, "left").withColumn(own, F.when(F.col(key).isNull() | F.col(f"{OWN}k").isNotNull(), beyond).otherwise(F.col(key).cast("long")))
    found = near_duplicates(numbered.select(own, F.col(text).alias("text")), own, "text", **options).filter("kept").select(F.col(own).alias(kept)).distinct()
    # the join deals rows by their number already, so taking one row of each needs no further shuffle
    single = numbered.join(found, F.col(own) == F.col(kept), "left_semi").dropDuplicates([own])
    columns = [F.col(c) for c in docs.columns]
    return single.select(*columns).union(docs.filter(~spoken))
