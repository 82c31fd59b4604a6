"""Helpers shared by the operators: row numbering, Arrow batches cut by bytes, tokenizer memos."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.session import materialise

#: Prefix of columns that an operator adds for itself, so that the caller's extra columns never clash.
OWN = "__llm_"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_key(*cols: Column | str) -> Column:
    """A deterministic hex key, uniform over the given values; SQL engines compute the same from md5."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("~")) for c in cols]))


def unit_draw(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of a hex key."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], into: str, digits: int = 2) -> DataFrame:
    """Adds a gapless number from 0 within each group, in the order of the first column of `order`, a hex key.

    A group may hold most of the rows: it is cut by the first `digits` hex digits of that key into 16^digits parts,
    each numbered by itself and moved up by the sizes of the parts before it. Only the part sizes meet per group.
    """
    part, base = f"{OWN}part", f"{OWN}base"
    rows = df.withColumn(part, F.substring(F.col(order[0]), 1, digits))
    sizes = rows.groupBy(*group, part).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    renamed = sizes.select(*[F.col(g).alias(f"{OWN}{i}") for i, g in enumerate(group)], F.col(part).alias(f"{OWN}p"), base)
    within = Window.partitionBy(*group, part).orderBy(*order)
    numbered = rows.withColumn(into, F.row_number().over(within).cast("long") - 1)
    same = F.col(part).eqNullSafe(F.col(f"{OWN}p"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"{OWN}{i}"))
    joined = numbered.join(renamed, same, "left").withColumn(into, F.col(into) + F.col(base))
    return joined.drop(part, base, f"{OWN}p", *[f"{OWN}{i}" for i in range(len(group))])


def attach_totals(rows: DataFrame, keys: Sequence[str], salt_by: Sequence[str], partial: dict[str, Column], merged: dict[str, Column], ways: int = 64) -> DataFrame:
    """Adds totals over all rows of equal `keys` (not null) to each of them; no group meets in one task.

    Rows are salted by `salt_by` into `ways` parts of their key. `partial` aggregates a part, `merged` the parts of a key,
    whose totals go back once to each part that exists. The rows come out dealt by key and `{OWN}salt`, which stays.
    """
    salt = f"{OWN}salt"
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*salt_by), F.lit(ways)).cast("int"))
    parts = salted.groupBy(*keys, salt).agg(*[c.alias(n) for n, c in partial.items()])
    totals = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merged.items()], F.collect_set(salt).alias(salt))
    return salted.join(totals.withColumn(salt, F.explode(salt)), [*keys, salt])


def number_in_order(rows: DataFrame, group: Sequence[str], order: Sequence[str], into: str, label: str) -> DataFrame:
    """Adds a gapless number from 0 within each group, ascending by `order` (nulls first), and its group's size as `{into}_of`.

    Rows are dealt by ranges of (group, order) and written with their range; each range is numbered by itself and moved up
    by the sizes of its group's earlier ranges, so a group of any size is spread over many tasks. Rows equal in `order` are
    numbered in any order. Only one row per range and group meets in a window. Groups must not be null.
    """
    part, base, size = f"{OWN}part", f"{OWN}base", f"{into}_of"
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    rows = materialise(rows.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), label)
    sizes = rows.groupBy(*group, part).agg(F.count(F.lit(1)).alias(base))
    whole = Window.partitionBy(*group)
    sizes = sizes.withColumn(size, F.sum(base).over(whole)).withColumn(
        base, F.coalesce(F.sum(base).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*group, part).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    numbered = rows.withColumn(into, place.cast("long") - 1).join(sizes, [*group, part])
    return numbered.withColumn(into, F.col(into) + F.col(base)).drop(part, base)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about `limit` bytes of `column`; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Memo(dict):
    """Values of distinct text pieces, each computed once by `encode` in bulk, in two generations.

    A piece starts among the `young`; when a later call asks for it again it joins the lasting ones, the dict itself. Young
    pieces beyond `limit` are forgotten together, so those that never come back cannot push out those that do. Lasting
    pieces beyond `limit` become young once more and return at their next use without being computed anew.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 200_000):
        super().__init__()
        self.encode, self.limit, self.young = encode, limit, {}

    def __missing__(self, piece: str):
        return self.young[piece]

    def learn(self, pieces: Collection[str]) -> None:
        """Makes every one of `pieces`, all distinct, answer until the next call."""
        if len(self) > self.limit:
            self.young = dict(self)
            self.clear()
        new = []
        for p in pieces:
            if p not in self:
                if p in self.young:
                    self[p] = self.young.pop(p)
                else:
                    new.append(p)
        if len(self.young) + len(new) > self.limit:
            self.young = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.young.update(zip(part, self.encode(part)))


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_WORD_MEMOS: dict[str, Memo] = {}
#: Bytes of text encoded together: the more, the fewer distinct words are looked up twice.
SLICE = 4 << 20
#: Letters of one code point that lower-casing keeps single, then ASCII marks to the end.
LETTERS_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Words of letters encoded in one text.
JOINED = 500


def _letters_encoder(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """Encoder of words that hold letters only: many in one text, cut where a token ends a word."""
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    ends_word[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(words: list[str]) -> list[bytes]:
        out = []
        texts = [" ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.asarray(e.ids, "<u4")
            cuts = [0, *((np.flatnonzero(ends_word[ids]) + 1) * 4).tolist()]
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(cuts, cuts[1:])]
        if len(out) != len(words):
            raise ValueError("the vocabulary does not end every word with a token of its own")
        return out

    return encode


def word_ids(path: str) -> Callable[[pa.Array], list[bytes]]:
    """Encoder of whole texts, an Arrow column without nulls, into little-endian uint32 ids for a vocabulary that drops white space and marks word ends.

    Such a vocabulary never joins characters across a space or line end, so texts are cut there, each distinct word is
    encoded once, and the ids of a text are its words' ids in a row. It also lower-cases and cuts between letters and
    marks, so letters before marks have the ids of the lower-case letters and of the marks; most such words are cut in bulk.
    One memo lives in each worker process.
    """
    if path not in _WORD_MEMOS:
        tokenizer = load_tokenizer(path)

        def plain(words: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

        encode_letters, others = _letters_encoder(tokenizer), Memo(plain, 50_000)

        def by_stem(words: list[str]) -> list[bytes]:
            cut = [m and (m[1].lower(), m[2]) for m in map(LETTERS_AND_MARKS.fullmatch, words)]
            stems = list({c[0] for c in cut if c})
            letters = dict(zip(stems, encode_letters(stems)))
            others.learn({c[1] if c else w for c, w in zip(cut, words)})
            return [letters[c[0]] + others[c[1]] if c else others[w] for c, w in zip(cut, words)]

        _WORD_MEMOS[path] = Memo(by_stem)
    memo = _WORD_MEMOS[path]

    def encode(texts: pa.Array) -> list[bytes]:
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # lower case must not turn a text into a special string
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), "([A-Za-z])([.,])", r"\1 \2")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        memo.learn(distinct)
        ids = pa.array(map(memo.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        _, places, raw = ids.buffers()
        cuts = np.frombuffer(places, np.int64)[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist() if len(ids) else [0] * (len(texts) + 1)
        raw = raw.to_pybytes() if raw is not None else b""
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    return encode


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
