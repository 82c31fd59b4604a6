import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import common, packing, tokencount, tokenfile
from panelcast.session import scratch_path

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def ids_of(tokenizer, text, end):
    return np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_counts_are_the_librarys(request, which):
    docs = request.getfixturevalue(which)
    t = Tokenizer.from_file(BYTE)
    got = tokencount.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), BYTE, keep=["text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)


def test_counts_with_a_model_file():
    count = tokencount.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert count(["", "two words"])[0] == 0 and count(["two words"]) == count(["x", "two words"])[1:]


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_files_hold_the_ids_in_key_order(request, spark, word, which):
    docs = request.getfixturevalue(which)
    path = scratch_path(spark, "t")
    tokenfile.write_tokens(docs, path, WORD, 2)
    got = sorted((tuple(r) for r in tokenfile.digests(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for g, (i, t) in zip(got, rows):
        ids = ids_of(word, t, 2)
        assert g == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = tokenfile.read_tokens(spark, path, 6, 8).collect()
    want = [(i, ids_of(word, t, 2).tolist()) for i, t in rows if i is not None and 6 <= i <= 8]
    assert sorted(((r["doc_id"], r["ids"]) for r in some)) == sorted(want)
    assert "ids" not in tokenfile.read_metadata(spark, path).columns


def test_files_have_dictionaries_deltas_and_page_indexes(spark, documents):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "t")
    tokenfile.write_tokens(documents, path, WORD, 2)
    meta = pq.ParquetFile(glob.glob(f"{path.removeprefix('file://')}/*.parquet")[0]).metadata
    by = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in by["row_no"].encodings
    assert by["doc_id"].has_column_index and by["doc_id"].has_offset_index


@pytest.mark.parametrize("which,window", [("edge", 4_000), ("documents", 4_000_000), ("documents", 50_000)])
def test_every_id_lies_in_one_piece(request, word, which, window):
    docs = request.getfixturevalue(which).filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    got = packing.pack_documents(docs, WORD, 1, window=window).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    total = 0
    for i, parts in pieces.items():
        ids, at = ids_of(word, texts[i], 1), 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(sequences) * packing.CAPACITY - total < packing.CAPACITY * (total / window + 2)


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 1500, 4_000)]
    pieces, n = packing.pack(lengths)
    cost = np.zeros(n)
    for _, _, m, s, _ in pieces:
        cost[s] += packing.LINEAR * m + packing.QUADRATIC * m * m
    assert n == -(-sum(lengths) // packing.CAPACITY) and cost.std() / cost.mean() < 0.1


def whole_pieces(lengths, capacity):
    """Brute force: each piece to the cheapest of all sequences that hold it whole."""
    rest = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    opened = -(-sum(n for n, _ in rest) // capacity)
    used, cost, home = [0] * opened, [0.0] * opened, {}
    for n, d in rest:
        fits = [s for s in range(opened) if used[s] + n <= capacity]
        if fits:
            s = min(fits, key=lambda s: (cost[s], s))
            used[s], cost[s], home[d] = used[s] + n, cost[s] + packing.LINEAR * n + packing.QUADRATIC * n * n, s
    return home, sum(n // capacity for n in lengths)


def test_every_sequence_is_asked_before_a_piece_is_cut():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        lengths = [int(x) for x in rng.choice([3, 7, 30, 61, 64, 90, 100, 250], 300)]
        pieces, _ = packing.pack(lengths, 100)
        home, full = whole_pieces(lengths, 100)
        parts = defaultdict(list)
        for d, start, n, s, _ in pieces:
            if n < 100:
                parts[d].append((n, s - full))
        assert all(parts[d] == [(lengths[d] % 100, s)] for d, s in home.items())


def test_frequent_words_outlive_an_overflow():
    asked = []
    memo = common.Memo(lambda pieces: [asked.append(p) or len(p) for p in pieces], 10)
    for i in range(50):
        memo.learn(["often", *(f"once{i}-{j}" for j in range(4))])
        assert memo["often"] == 5 and memo[f"once{i}-3"] == len(f"once{i}-3")
    assert asked.count("often") == 1 and len(memo.young) <= 10
    for i in range(30):
        memo.learn([f"w{i}", "often"])
        memo.learn([f"w{i}", "often"])
    assert asked.count("often") == 1 and len(memo) <= 12


def test_null_keys_and_repeated_rows_are_packed(edge):
    assert packing.pack_documents(edge, WORD, 1).filter("start = 0").count() == edge.count()


def test_empty_tables(spark, empty):
    path = scratch_path(spark, "t")
    tokenfile.write_tokens(empty, path, WORD, 2)
    assert tokenfile.digests(spark, path).count() == 0
    assert packing.pack_documents(empty, WORD, 1).count() == 0 and tokencount.count_tokens(empty, BYTE).count() == 0
