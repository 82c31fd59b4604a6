"""Vector code compression: product codes whose codebooks are refined in rounds, most distances spared by norm-of-sum bounds.

A vector is cut into parts, and each part position has a codebook. Every part keeps its entry, an upper bound of the distance
to it and a lower bound of the distance to all others, each with the round in which it was exact (its stamp). The history of
all codebooks is small and goes to every task. In a later round, an entry has moved by the norm of the sum of its moves since
the stamp, that is the distance between two of its places in the history, which is never more and often much less than the
moves added up. If the upper bound plus the entry's displacement stays under the lower bound less the largest displacement of
the other entries, the assignment stands without a look at the vector; then the distance to the own entry is made exact and
the test repeated; what is still open is compared with all entries. Arithmetic on components is exact in integers; bounds are
floating-point roots with a margin, and a tie is never decided by a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import OWN, attach_totals
from panelcast.session import materialise, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Largest magnitude of a scaled component: squares of differences summed over a part stay inside 64 bits.
LARGEST = 1 << 24
#: Relative and absolute room for rounding in roots of exact squares.
MARGIN = 1e-9
#: Rows whose parts are compared with all entries at a time.
BLOCK = 2_048


def clean_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)))


def scaled(batch: pa.Array, width: int, scale: float) -> np.ndarray:
    """Components as integers floor(scale * x), one row per vector."""
    sizes = np.diff(batch.offsets.to_numpy())
    if (sizes != width).any():
        raise ValueError(f"vectors have {sorted(set(sizes.tolist()))[:3]} components, not {width}")
    x = np.floor(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(batch), width)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST}")
    return x.astype(np.int64)


def exact_scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), squared distance to it and to the nearest other one (-1: there is none)."""
    n, k = len(x), len(book)
    near, first, second = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for at in range(0, n, BLOCK):
        part = x[at : at + BLOCK]
        d = np.zeros((len(part), k), np.int64)
        for j in range(x.shape[1]):
            d += (part[:, j, None] - book[None, :, j]) ** 2
        rows = np.arange(len(part))
        a = d.argmin(1)
        near[at : at + BLOCK], first[at : at + BLOCK] = a, d[rows, a]
        if k > 1:
            d[rows, a] = np.iinfo(np.int64).max
            second[at : at + BLOCK] = d.min(1)
    return near, first, second


def below(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether `upper` is less than `lower` beyond any rounding."""
    return upper * (1 + MARGIN) + MARGIN < lower * (1 - MARGIN)


class Assigner:
    """Assigns the parts of one position, with the history of its codebook; entries (rounds, k, d)."""

    def __init__(self, history: np.ndarray):
        self.history, self.now = history, len(history) - 1
        #: moved[t, j]: how far entry j is from its place in round t; other[t, j]: the farthest that an entry but j has moved.
        self.moved = np.sqrt(((history[-1][None] - history) ** 2).sum(2).astype(np.float64))
        k = history.shape[1]
        self.other = np.zeros_like(self.moved)
        if k > 1:
            top = np.sort(self.moved, 1)[:, -2:]
            largest = self.moved.argmax(1)
            self.other[:] = top[:, 1:2]
            self.other[np.arange(len(history)), largest] = top[:, 0]

    def fresh(self, x: np.ndarray) -> tuple:
        near, first, second = exact_scan(x, self.history[-1])
        stamp = np.full(len(x), self.now, np.int8)
        lower = np.where(second >= 0, np.sqrt(np.maximum(second, 0).astype(np.float64)), np.inf)
        return near.astype(np.uint8), np.sqrt(first.astype(np.float64)), stamp, lower, stamp.copy()

    def update(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray) -> tuple[tuple, int]:
        """The state after this round, and how many parts were compared with all entries."""
        near, upper, upper_at, lower, lower_at = near.copy(), upper.copy(), upper_at.copy(), lower.copy(), lower_at.copy()
        reach = upper + self.moved[upper_at, near]
        floor = lower - self.other[lower_at, near]
        todo = np.flatnonzero(~below(reach, floor))
        if len(todo):
            own = ((x[todo] - self.history[-1][near[todo]]) ** 2).sum(1).astype(np.float64)
            upper[todo], upper_at[todo] = np.sqrt(own), self.now
            todo = todo[~below(upper[todo], floor[todo])]
        if len(todo):
            near[todo], upper[todo], upper_at[todo], lower[todo], lower_at[todo] = self.fresh(x[todo])
        return (near, upper, upper_at, lower, lower_at), len(todo)


def part_errors(x: np.ndarray, near: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((x - book[near]) ** 2).sum(1)


STATE = [("code", T.BinaryType()), ("upper", T.BinaryType()), ("upper_at", T.BinaryType()), ("lower", T.BinaryType()), ("lower_at", T.BinaryType())]
TYPES = (np.uint8, np.float64, np.int8, np.float64, np.int8)
SUMS = [("part", T.IntegerType()), ("entry", T.IntegerType()), ("n", T.LongType()), ("sums", T.ArrayType(T.LongType())), ("scans", T.LongType())]


def _column(values: np.ndarray) -> pa.Array:
    """A row of a two-dimensional array as one binary value each."""
    raw, width = np.ascontiguousarray(values), values.shape[1] * values.itemsize
    places = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(places), pa.py_buffer(raw)])


def _matrix(column: pa.Array, parts: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), parts)


def _assigners(history: Sequence[np.ndarray]) -> list[Assigner]:
    return [Assigner(np.stack([book[p] for book in history])) for p in range(len(history[0]))]


def one_round(rows: DataFrame, history: Sequence[np.ndarray], parts: int, scale: float, first: bool, final: bool) -> DataFrame:
    """Assigns all parts to the last codebook of `history`: rows of state, and rows of sums by part and entry per task.

    In one pass: state rows carry `kind` 0 with id, label, vector and bounds (or code and error at the end), sum rows `kind` 1.
    """
    books = [np.asarray(b, np.int64) for b in history]
    width = books[0].shape[0] * books[0].shape[2]
    kept = [rows.schema["id"], rows.schema["label"]]
    tail = [("code", T.BinaryType()), ("error", T.LongType())] if final else STATE
    middle = [] if final else [rows.schema["vector"]]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *kept, *middle, *[T.StructField(n, t) for n, t in (*tail, *SUMS)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks = _assigners(books)
        d, k = books[0].shape[2], books[0].shape[1]
        count, total, scans = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64), np.zeros(parts, np.int64)
        arrow = None
        for batch in batches:
            arrow = batch.schema
            n = batch.num_rows
            if not n:
                continue
            x = scaled(batch.column(2), width, scale).reshape(n, parts, d)
            old = None if first else [_matrix(batch.column(3 + i), parts, t) for i, t in enumerate(TYPES)]
            new = [np.zeros((n, parts), t) for t in TYPES]
            error = np.zeros(n, np.int64)
            for p, task in enumerate(tasks):
                xp = x[:, p, :]
                if first:
                    state, looked = task.fresh(xp), n
                else:
                    state, looked = task.update(xp, *(o[:, p] for o in old))
                scans[p] += looked
                for out, s in zip(new, state):
                    out[:, p] = s
                near = state[0].astype(np.int64)
                if final:
                    error += part_errors(xp, near, books[-1][p])
                else:
                    count[p] += np.bincount(near, minlength=k)
                    for j in range(d):
                        np.add.at(total[p, :, j], near, xp[:, j])
            if final:
                columns = [batch.column(0), batch.column(1), _column(new[0]), pa.array(error)]
            else:
                columns = [batch.column(0), batch.column(1), batch.column(2), *map(_column, new)]
            nothing = [pa.nulls(n, t) for t in SUM_TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *columns, *nothing], names=schema.names)
        if arrow is not None:
            at = [(p, e) for p in range(parts) for e in range(k)]
            blanks = [pa.nulls(len(at), arrow.field(i).type) for i in range(2 if final else 3)]
            blanks += [pa.nulls(len(at), pa.int64() if t == T.LongType() else pa.binary()) for _, t in tail]
            sums = [pa.array([p for p, _ in at], pa.int32()), pa.array([e for _, e in at], pa.int32()), pa.array([int(count[a]) for a in at], pa.int64()),
                    pa.array([total[a].tolist() for a in at], pa.list_(pa.int64())), pa.array([int(scans[p]) if e == 0 else 0 for p, e in at], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), *blanks, *sums], names=schema.names)

    return rows.mapInArrow(run, schema)


SUM_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]


def next_book(book: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, int]:
    """Every entry as the floor of its parts' mean, unused ones as they were; parts times entries rows come back."""
    out, scans = book.copy(), 0
    width = book.shape[2]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("scans").alias("scans"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]).collect():
        scans += r["scans"]
        if r["n"]:
            out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out, scans


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: float = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(key, label, code binary, error) per kept row, the codebooks (parts, entries, width), and per round how many parts were compared with all entries.

    The codebooks start as the `entries` rows of smallest key (nulls last, equal keys by vector). All kept vectors must have one
    length, a multiple of `parts`, and components under 2^16; others raise. Repeated rows are rows each; fewer rows
    than entries give smaller codebooks; no rows give none. The state of every round is written to the shared folder.
    """
    spark = rows.sparkSession
    kept = clean_vectors(rows, vector).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    start = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()  # at most `entries` rows
    if not start:
        return kept.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), []
    width = len(start[0]["vector"])
    if width % parts:
        raise ValueError(f"{width} components do not cut into {parts} equal parts")
    vectors = scaled(pa.array([r["vector"] for r in start], pa.list_(pa.float64())), width, scale)
    history = [vectors.reshape(len(start), parts, width // parts).transpose(1, 0, 2)]
    state, looked = kept.withColumn("vector", F.col("vector").cast("array<float>")) if dict(rows.dtypes)[vector] == "array<float>" else kept, []
    for i in range(rounds):
        path = scratch_path(spark, f"codes{i}")
        one_round(state, history, parts, scale, i == 0, False).write.partitionBy("kind").parquet(path)
        written = spark.read.parquet(path)
        book, scans = next_book(history[-1], written.filter("kind = 1"))
        history.append(book)
        looked.append(scans)
        state = written.filter("kind = 0").select("id", "label", "vector", *[n for n, _ in STATE])
    path = scratch_path(spark, "codes")
    one_round(state, history, parts, scale, rounds == 0, True).write.partitionBy("kind").parquet(path)
    written = spark.read.parquet(path)
    looked.append(written.filter("kind = 1").agg(F.sum("scans")).first()[0])
    return written.filter("kind = 0").select("id", "label", "code", "error"), history[-1], looked


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal text by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_table(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """key, code as lower-case hex, error, label_error (error summed over equal labels, nulls together), codebooks_sha256."""
    codes, books, _ = compress(rows, key, vector, label, **options)
    name = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n"))
    codes = attach_totals(codes.withColumn(f"{OWN}label", name), [f"{OWN}label"], ["id", "code"], {"label_error": F.sum("error")}, {"label_error": F.sum("label_error")})
    return codes.select(F.col("id").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
