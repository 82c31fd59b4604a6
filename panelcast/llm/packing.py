"""Cost-balanced packing of token ids into sequences of fixed capacity.

The cost of a piece of n tokens in training is taken as linear * n + quadratic * n^2 (its own attention). Inside a
window of consecutive documents, pieces go in descending order to the sequence of lowest cost that has room. As many
sequences are opened as the window's tokens fill; a piece for which no sequence has room is cut and fills the gaps, so a
window pads less than one sequence. Texts longer than a sequence first give full sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import SLICE, byte_slices, word_ids

CAPACITY = 2048
#: Tokens of a window: bounds a task's memory; padding is under one sequence in this many tokens.
WINDOW = 4_000_000
#: Cost of a token in the dense layers, and of a pair of tokens in attention, in relation to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 6144

FIELDS = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) that cover all lengths, and the number of sequences."""
    out, sequences, rest = [], 0, []
    for doc, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((doc, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((n % capacity, doc, full * capacity))
    opened = -(-sum(n for n, _, _ in rest) // capacity)
    used, cost = [0] * opened, [0.0] * opened

    def place(s: int, doc: int, start: int, n: int) -> None:
        out.append((doc, start, n, sequences + s, used[s]))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n

    # The heap holds every sequence with room for the piece at hand; one without waits under its room until pieces are that small.
    lowest, waiting, uncut, last = [(0.0, s) for s in range(opened)], [[] for _ in range(capacity)], [], capacity
    for n, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        for room in range(n, last):
            for s in waiting[room]:
                heapq.heappush(lowest, (cost[s], s))
            waiting[room] = []
        last = n
        while lowest and used[lowest[0][1]] + n > capacity:
            s = heapq.heappop(lowest)[1]
            waiting[capacity - used[s]].append(s)
        if lowest:
            s = lowest[0][1]
            place(s, doc, start, n)
            heapq.heapreplace(lowest, (cost[s], s))
        else:
            uncut.append((n, doc, start))
    gaps = iter(sorted((s for s in range(opened) if used[s] < capacity), key=lambda s: (cost[s], s)))
    s = next(gaps, None)
    for n, doc, start in uncut:
        while n:
            if used[s] == capacity:
                s = next(gaps)
            part = min(n, capacity - used[s])
            place(s, doc, start, part)
            n, start = n - part, start + part
    return out, sequences + opened


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenised and packed in the partition that reads them, window by window, without a shuffle, so one
    key or source holding most rows costs nothing. A sequence id is the partition's number times 2^32 plus a count.
    A null or empty text holds the end id alone; null keys and repeated rows are documents like others.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, t in FIELDS]])
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = word_ids(vocabulary), TaskContext.get().partitionId() << 32
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, first
            sizes = [len(x) // 4 for x in ids]
            pieces, n = pack(sizes, capacity)
            sums = [zlib.crc32(memoryview(ids[d])[4 * a : 4 * (a + m)]) for d, a, m, _, _ in pieces]
            doc, start, length, seq, offset = (np.asarray(x, np.int64) for x in zip(*pieces))
            columns = [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.asarray(sizes, np.int64)[doc]), pa.array(seq + first), pa.array(offset)]
            keys, ids, held, first = [], [], 0, first + n
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in byte_slices(batches, "text", SLICE):
            new = [x + tail for x in encode(batch.column(1))]
            keys.append(batch.column(0))
            ids += new
            held += sum(map(len, new)) // 4
            if held >= window:
                yield flush()
        if ids:
            yield flush()

    return rows.mapInArrow(run, schema)
