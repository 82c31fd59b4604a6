"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (a share of all slots) gets block k the window [floor(k / w), ceil((k + 1) / w)): its release time
and its deadline. Earliest deadline first over released blocks places every block inside its window, so that at any
time a source is less than one block away from its due share. Weights are taken as they are, as ratios of whole numbers,
and every block has its own window. Chunks of time are dealt side by side: which blocks lie before a chunk follows from
the shares, so that a schedule of any length is many tasks and every block keeps its window across their borders. A caller that names a period gets weights rounded to whole slots of it and a schedule
that repeats: block k of a source lies in period k div slots. When a source runs dry the others keep their windows, and
slots for which nothing is released stay empty; no row is dropped or repeated.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice
from math import inf, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import OWN, number_rows, spread_key

#: Slots of a period by default, where one is asked for: the resolution of its weights, and the size of its table.
PERIOD = 1000
#: Documents of a block.
BLOCK_ROWS = 8
#: Target weights by default: a source's number of documents to this power, in relation to the others.
POWER = 0.7
#: Slots that a task deals at a time, where no window is longer than a quarter of it, and the most tasks of a schedule.
CHUNK, TASKS = 1 << 15, 4096


def whole_slots(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots per source by largest remainders, at least one each; the sum is `period`."""
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    if len(names) > period:
        raise ValueError(f"{len(names)} sources need a period of at least as many slots, not {period}")
    usable = {s: float(w) if 0 < w < inf else 0.0 for s, w in weights.items()}
    total = sum(usable.values()) or 1.0
    exact = {s: usable[s] / total * (period - len(names)) for s in names}
    slots = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], names.index(s)))[: period - sum(slots.values())]:
        slots[s] += 1
    return slots


def pfair_period(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """One period by earliest deadline first: (source, block, release, deadline, slot), ties to the first source by name."""
    names = sorted(slots, key=lambda s: (s is None, s or ""))
    period = sum(slots.values())
    jobs = sorted((k * period // slots[s], -(-(k + 1) * period // slots[s]), i, k) for i, s in enumerate(names) for k in range(slots[s]))
    ready: list[tuple[int, int, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, i, k = jobs[at]
            heapq.heappush(ready, (deadline, i, k, release))
            at += 1
        deadline, i, k, release = heapq.heappop(ready)
        if slot >= deadline:
            raise ValueError("weights exceed the period")
        out.append((names[i], k, release, deadline, slot))
    return out


def whole_parts(weights: Sequence[float]) -> list[int]:
    """The weights times one factor that makes all of them whole, without rounding: a float is a ratio of whole numbers."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(x.denominator for x in exact))
    return [int(x * unit) for x in exact]


def pfair_blocks(parts: Sequence[int], blocks: Sequence[int], first: Sequence[int] | None = None, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block by earliest deadline first, ties to the first source.

    A source's weight is its share of the sum of `parts`. Only blocks that exist compete, one of each source at a time.
    With `first`, `start` and `end`, a source's blocks from `first` up to `blocks` go into the slots from `start` up to `end`.
    """
    total = sum(parts)
    begun = first or [0] * len(parts)
    waiting = [(max(start, k * total // p), i, k) for i, (p, k, n) in enumerate(zip(parts, begun, blocks)) if k < n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = start
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            deadline = -(-(k + 1) * total // parts[i])
            heapq.heappush(ready, (deadline if end is None else min(deadline, end), i, k))
        deadline, i, k = heapq.heappop(ready)
        if slot >= deadline:
            raise ValueError(f"block {k} of source {i} misses slot {deadline}")
        yield i, k, k * total // parts[i], -(-(k + 1) * total // parts[i]), slot
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, (max(start, (k + 1) * total // parts[i]), i, k + 1))
        slot += 1


def busy_runs(parts: Sequence[int], first: Sequence[int], last: Sequence[int]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of slots that blocks from `first` up to `last` fill, each as early as its release allows."""
    total = sum(parts)

    def releases(p: int, k: int, n: int) -> Iterator[int]:
        return (j * total // p for j in range(k, n))

    starts: list[int] = []
    ends: list[int] = []
    for release in heapq.merge(*map(releases, parts, first, last)):
        if not ends or release > ends[-1]:
            starts.append(release)
            ends.append(release)
        ends[-1] += 1
    return starts, ends


def blocks_before(parts: Sequence[int], blocks: Sequence[int], at: int) -> list[int]:
    """How many blocks of each source a schedule deals before slot `at`, found without dealing what lies further back.

    These are all blocks due by then and, of those whose window `at` cuts, as many as the shares before `at` add up to:
    by earliest deadline, where a slot from its release on is left by the blocks due. Blocks taken so leave a schedule
    on either side: slots before `at` are lacking for no set of released blocks, and the others have the latest deadlines.
    """
    total = sum(parts)
    count = [min(n, at * p // total) for p, n in zip(parts, blocks)]
    cut = [i for i, (p, n, k) in enumerate(zip(parts, blocks, count)) if k < n and at * p % total]
    ahead = sum(at * parts[i] % total for i in cut) // total
    if not ahead:
        return count
    windows = sorted((-(-(count[i] + 1) * total // parts[i]), i, count[i] * total // parts[i]) for i in cut)
    begin = min(release for _, _, release in windows)
    starts, ends = busy_runs(parts, [min(k, -(-begin * p // total)) for p, k in zip(parts, count)], count)
    taken: dict[int, int] = {}
    for _, i, release in windows:
        path, slot = [], release
        while True:
            run = bisect_right(starts, slot) - 1
            further = taken.get(slot) or (ends[run] if run >= 0 and ends[run] > slot else slot)
            if further == slot:
                break
            path.append(slot)
            slot = further
        if slot < at:
            path.append(slot)
            count[i] += 1
            ahead -= 1
            slot += 1
        taken.update(dict.fromkeys(path, slot))
        if not ahead:
            return count
    raise ValueError(f"no schedule passes slot {at}")


def block_schedule(spark: SparkSession, kind: T.DataType, weights: Mapping[str | None, float], counts: Mapping[str | None, int], block_rows: int, chunk: int = CHUNK) -> DataFrame:
    """s, kk, release, deadline, slot, weight: a row per block.

    Time is cut into chunks of at least `chunk` slots and four of the longest windows. A task knows from the shares alone which blocks lie
    before its chunk and which before the next one, deals those between and holds one block of each source.
    Sources whose weight is not positive and finite have no share; their rows follow after all others, by their numbers of rows.
    """
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    plans, start = [], 0
    for own in ([i for i, s in enumerate(names) if (0 < weights[s] < inf) is share] for share in (True, False)):
        given = [weights[names[i]] if not plans else counts[names[i]] for i in own]
        parts, blocks = whole_parts(given), [-(-counts[names[i]] // block_rows) for i in own]
        total = sum(parts)
        length = max([chunk, *(4 * (total // p + 2) for p in parts)])
        end = max((-(-n * total // p) for n, p in zip(blocks, parts)), default=0)
        plans.append((own, parts, blocks, length, start))
        start += end
    chunks = [-(-(after - plan[4]) // plan[3]) for plan, after in zip(plans, (plans[1][4], start))]
    fields = [f"{OWN}{c}" for c in ("i", "kk", "release", "deadline", "slot")]

    def deal(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in numbers for n in batch.column(0).to_pylist()):
            own, parts, blocks, length, start = plans[number >= chunks[0]]
            at = (number - chunks[0] * (number >= chunks[0])) * length
            dealt = pfair_blocks(parts, blocks_before(parts, blocks, at + length), blocks_before(parts, blocks, at), at, at + length)
            while rows := list(islice(dealt, 20_000)):
                moved = [(own[i], k, release + start, deadline + start, slot + start) for i, k, release, deadline, slot in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*moved)], names=fields)

    whole = sum(plans[0][1])
    share = {i: w / whole for i, w in zip(*plans[0][:2])}
    named = spark.createDataFrame(
        [(s, i, share.get(i, 0.0)) for i, s in enumerate(names)],
        T.StructType([T.StructField(f"{OWN}s", kind), T.StructField(f"{OWN}i", T.LongType()), T.StructField(f"{OWN}weight", T.DoubleType())]),
    )
    tasks = spark.range(0, sum(chunks), 1, max(1, min(sum(chunks), TASKS)))
    blocks = tasks.mapInArrow(deal, ", ".join(f"{c} long" for c in fields))
    return blocks.join(named, f"{OWN}i").drop(f"{OWN}i")


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int | None = None, power: float = POWER) -> DataFrame:
    """All columns of `docs` and: block, release, deadline, slot, place (in the block), weight, prefixed with the operator's own mark.

    Rows of a source are numbered in hash order of their key; a source may hold most rows. Sources without a weight, and
    all sources where `weights` is None, weigh their number of rows to `power`, in relation to the others. A null source is a source. Weights that
    are not positive and finite give no share: those rows follow after all others, or have one slot of a period. With a
    `period`, weights are rounded to whole slots of it, and more sources than slots are refused. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(source).count()
    counts = {r[0]: r[1] for r in (sizes if period is None else sizes.limit(period + 1)).collect()}
    natural = {s: float(n) ** power for s, n in counts.items()}
    if weights is not None:
        usable = [s for s in natural if s in weights and 0 <= weights[s] < inf]
        scale = sum(weights[s] for s in usable) / (sum(natural[s] for s in usable) or 1.0)
        natural = {s: float(weights[s]) if s in weights else n * scale for s, n in natural.items()}
    numbered = number_rows(docs.withColumn(f"{OWN}order", spread_key(key)), [source], [f"{OWN}order", key], f"{OWN}row")
    numbered = numbered.withColumn(f"{OWN}block", F.floor(F.col(f"{OWN}row") / block_rows).cast("long"))
    place = (F.col(f"{OWN}row") % block_rows).alias(f"{OWN}place")
    if period is None:
        table = block_schedule(spark, docs.schema[source].dataType, natural, counts, block_rows)
        rows = numbered.join(table, F.col(source).eqNullSafe(F.col(f"{OWN}s")) & (F.col(f"{OWN}block") == F.col(f"{OWN}kk")), "left")
        return rows.select(*[F.col(c) for c in docs.columns], *[f"{OWN}{c}" for c in ("block", "release", "deadline", "slot")], place, f"{OWN}weight")
    table = schedule_table(spark, docs.schema[source].dataType, natural, period)
    slots = F.broadcast(table.groupBy(f"{OWN}s").agg(F.count(F.lit(1)).alias(f"{OWN}w")))
    rows = numbered.join(slots, F.col(source).eqNullSafe(F.col(f"{OWN}s")), "left").drop(f"{OWN}s")
    turn, inside = F.floor(F.col(f"{OWN}block") / F.col(f"{OWN}w")), F.col(f"{OWN}block") % F.col(f"{OWN}w")
    rows = rows.withColumn(f"{OWN}turn", turn).withColumn(f"{OWN}k", inside)
    rows = rows.join(F.broadcast(table), F.col(source).eqNullSafe(F.col(f"{OWN}s")) & (F.col(f"{OWN}k") == F.col(f"{OWN}kk")), "left")
    move = F.col(f"{OWN}turn") * period
    return rows.select(
        *[F.col(c) for c in docs.columns], F.col(f"{OWN}block"), (F.col(f"{OWN}release") + move).alias(f"{OWN}release"),
        (F.col(f"{OWN}deadline") + move).alias(f"{OWN}deadline"), (F.col(f"{OWN}slot") + move).alias(f"{OWN}slot"),
        place, (F.col(f"{OWN}w") / period).alias(f"{OWN}weight"),
    )


def schedule_table(spark: SparkSession, kind, weights: Mapping[str | None, float], period: int = PERIOD) -> DataFrame:
    """The period as a table of at most `period` rows."""
    rows = pfair_period(whole_slots(weights, period)) if weights else []
    schema = T.StructType([T.StructField(f"{OWN}s", kind)] + [T.StructField(f"{OWN}{c}", T.LongType()) for c in ("kk", "release", "deadline", "slot")])
    return spark.createDataFrame(rows, schema)


def in_mixture_order(docs: DataFrame, **options) -> DataFrame:
    """The documents with their own columns, dealt and sorted by slot: written files hold the mixed stream in order."""
    mixed = mix_sources(docs, **options)
    key = options.get("key", "doc_id")
    ordered = mixed.repartitionByRange(f"{OWN}slot").sortWithinPartitions(f"{OWN}slot", f"{OWN}place", key)
    return ordered.select(*[F.col(c) for c in docs.columns])
