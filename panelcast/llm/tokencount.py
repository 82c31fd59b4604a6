"""Token counts of whole texts: bulk encoding in Arrow functions that return lengths only.

Batches are balanced by bytes. Texts are split at safe boundaries: a byte-level vocabulary never joins a token across a
single space or line end between two other characters, except that a word takes the space before it. Each distinct
piece of a batch is encoded once; a text's count is the sum over its pieces. Texts with runs of white space are split
only where both neighbours of a space are no white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import OWN, Memo, byte_slices, load_tokenizer

SAFE = re.compile(r"(?<=\S)(?= \S)")
_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def _plain(piece: str) -> bool:
    """Whether a piece cut at spaces and line ends has no white space but the space it begins with."""
    body = piece[1:] if piece[:1] == " " else piece
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


def _pieces_counter(path: str) -> Callable[[list[str]], list[int]]:
    tokenizer = load_tokenizer(path)

    def lengths(pieces: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    simple = Memo(lambda pieces: [n if _plain(p) else None for p, n in zip(pieces, lengths(pieces))])
    other = Memo(lengths, 50_000)
    line_end = lengths(["\n"])[0]

    def count(texts: list[str]) -> list[int]:
        cut = [t.replace(" ", "\n ").split("\n") for t in texts]
        simple.learn(set().union(*cut) if cut else set())
        found, odd = [0] * len(texts), []
        for i, (text, pieces) in enumerate(zip(texts, cut)):
            sizes = list(map(simple.__getitem__, pieces))
            if None in sizes:
                odd.append((i, SAFE.split(text)))
            else:
                found[i] = sum(sizes) + line_end * text.count("\n")
        if odd:
            other.learn(set().union(*(p for _, p in odd)))
            for i, pieces in odd:
                found[i] = sum(map(other.__getitem__, pieces))
        return found

    return count


def _model_counter(path: str) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counter of whole texts for a vocabulary file, kept by the worker process. A `.model` file gets whole texts."""
    if path not in _COUNTERS:
        _COUNTERS[path] = _model_counter(path) if path.endswith(".model") else _pieces_counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: key, `keep`, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    A null text is empty: no bytes, no tokens. Repeated rows and null keys are counted as they are; no shuffle, no order.
    """
    rows = docs.select(F.col(key), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(f"{OWN}text"))
    schema = T.StructType([*rows.select(key, *keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    passed = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in byte_slices(batches, f"{OWN}text"):
            texts = batch.column(passed)
            n = pa.array(count(texts.to_pylist()), pa.int64())
            n_bytes = pa.compute.cast(pa.compute.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], n_bytes, n, pa.compute.greater(n, limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
