"""Archives, vector codes and the Merkle manifest against brute force, damaged input and odd rows."""

import base64
import glob
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from panelcast.llm import merkle, queries, vectorcode, warc
from panelcast.session import scratch_path

PAGES = [
    (1, "http://a/x", "<p>one</p>"), (2, "http://a/y", "<p>one</p>"), (2, "http://a/y", "<p>one</p>"), (3, None, None), (4, "http://b/ c\r\nd", ""),
    (None, "http://n/1", "<p>one</p>"), (None, None, "only null keys"), (None, None, "only null keys"), (5, "http://ü/", "Straße 🙂\r\n\r\nWARC/1.1"),
    (6, "u", "x" * 300_000), (7, "u", "x" * 300_000),
]


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame([(*p, 7, "clash") for p in PAGES], "page_id long, url string, html string, payload_digest long, digest string")


def archive_rows(rows):
    """Brute force: (page_id, bytes, digest, type, refers_to) per row."""
    groups, out = defaultdict(list), []
    for key, _, html in rows:
        groups[(html or "").encode()].append(key)
    for payload, keys in groups.items():
        keys.sort(key=lambda k: (k is None, -(k or 0)))
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(k, len(payload), sha, "revisit" if i else "response", keys[0] if i else None) for i, k in enumerate(keys)]
    return Counter(out)


def files(path):
    return sorted(glob.glob(f"{path.removeprefix('file:')}/*.warc.zst"))


def test_archives_round_trip_odd_pages(spark, odd_pages):
    path = scratch_path(spark, "w")
    warc.write_archives(odd_pages, path, archive_bytes=100_000)
    records = warc.read_archives(spark, path).cache()
    assert Counter(map(tuple, warc.page_digests(records).collect())) == archive_rows(PAGES)
    stored = {r["record_id"]: r for r in records.filter("record_type = 'response'").collect()}
    assert len(stored) == len({html or "" for _, _, html in PAGES})
    for r in records.collect():
        home = r if r["record_type"] == "response" else stored[r["refers_to"]]
        assert warc.base32_sha1(home["payload"]) == r["payload_digest"] and len(home["payload"]) == r["payload_bytes"] and r["error"] is None
    assert records.select("record_id").distinct().count() == len(PAGES)
    assert {r["uri"] for r in records.collect()} >= {None, "http://b/%20c%0D%0Ad", "http://ü/"}


def test_short_payloads_are_all_responses(spark, odd_pages):
    path = scratch_path(spark, "w")
    warc.write_archives(odd_pages, path, least=100)
    got = Counter((r["payload_bytes"] < 100, r["record_type"]) for r in warc.read_archives(spark, path).collect())
    assert got == {(True, "response"): 9, (False, "response"): 1, (False, "revisit"): 1}


def test_archives_of_nothing(spark, odd_pages):
    path = scratch_path(spark, "w")
    warc.write_archives(odd_pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0 and not files(path)


def test_the_dictionary_leads_and_every_record_is_one_frame(spark, small):
    path = scratch_path(spark, "w")
    pages = spark.read.parquet(f"{small}/pages.parquet").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        warc.write_archives(pages, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (name,) = files(path)
    raw = open(name, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.DICTIONARY_MAGIC and raw[8:12] == warc.RAW_DICTIONARY
    decoder, at, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])), 8 + size, 0
    while at < len(raw):
        assert zstandard.get_frame_parameters(raw[at:]).has_checksum
        frame = decoder.decompressobj()
        data = frame.decompress(raw[at:])
        assert frame.eof and data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        at, n = len(raw) - len(frame.unused_data), n + 1
    assert n == pages.count()
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(raw[8 + size :])


class Bytes:
    def __init__(self, raw, step=7):
        self.raw, self.step, self.at = raw, step, 0

    def read(self, n):
        self.at += min(n, self.step)
        return self.raw[self.at - min(n, self.step) : self.at]


def good(payload=b"hello", **change):
    return warc.record("response", "urn:uuid:1", "http://a", "2020-01-01T00:00:00Z", 1, warc.base32_sha1(payload), payload)


def test_frames_of_a_stream_in_small_pieces():
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    raw = pack(b"one") + struct.pack("<II", 0x184D2A53, 5) + b"other" + pack(b"") + pack(b"two" * 1000)
    assert [x for _, x in warc.frames(Bytes(raw))] == [b"one", b"", b"two" * 1000]
    compressed = zstandard.ZstdCompressor().compress(zstandard.train_dictionary(2000, [f"record number {i} of many".encode() * 3 for i in range(2000)], k=50, d=8).as_bytes())
    framed = struct.pack("<II", warc.DICTIONARY_MAGIC, len(compressed)) + compressed
    words = warc.load_dictionary(compressed)
    one = zstandard.ZstdCompressor(dict_data=words).compress(b"record number 5 of many")
    assert [x for _, x in warc.frames(Bytes(framed + one))] == [b"record number 5 of many"]
    flipped = bytearray(pack(b"two" * 1000))
    flipped[-1] ^= 1
    for bad in (raw[:-1], raw + b"x", raw + b"junkjunk", raw + framed, bytes(flipped), struct.pack("<II", warc.DICTIONARY_MAGIC, 4) + b"none" + pack(b"x"), raw[:3]):
        with pytest.raises(ValueError):
            list(warc.frames(Bytes(bad)))


def test_records_are_validated():
    data = good()
    assert warc.parse(data)["payload"] == b"hello" and warc.parse(data.replace(b"WARC-Date: ", b"warc-date:\r\n  "))["warc-date"] == "2020-01-01T00:00:00Z"
    broken = [
        data.replace(b"WARC/1.1", b"WARC/9.9"), data.replace(b"WARC-Date", b"X-Date"), data.replace(b"WARC-Type: ", b"WARC Type "), data[:-1], data + b"x",
        data.replace(b"hello", b"hellO"), data.replace(b"hello", b"hello!"), data.replace(b"Content-Length: 5", b"Content-Length: 6"), b"WARC/1.1\r\n",
        data.replace(b"X-Payload-Length: 5", b"X-Payload-Length: 4"), data.replace(b"HTTP/1.1", b"FTPP/1.1"), data.replace(b"http://a", b"http://\xff"),
    ]
    for x in broken:
        with pytest.raises(ValueError):
            warc.parse(x)


def test_damaged_archives_fail_or_are_reported(spark, odd_pages):
    path = scratch_path(spark, "w")
    warc.write_archives(odd_pages, path)
    name = max(files(path), key=lambda f: len(open(f, "rb").read()))
    raw = open(name, "rb").read()
    open(name, "wb").write(raw[:-3])
    with pytest.raises(Exception, match="truncated frame"):
        warc.read_archives(spark, path).collect()
    rows = warc.read_archives(spark, path, strict=False).collect()
    assert sum("truncated" in (r["error"] or "") for r in rows) == 1 and sum(r["error"] is None for r in rows) == len(PAGES) - 1


# vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Plain integers, all distances each round: {key: (code, error)} and the codebooks."""
    kept = [(k, [int(np.floor(256 * np.float64(x))) for x in v]) for k, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            homes = defaultdict(list)
            for c in cut:
                homes[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(homes[e]) for col in zip(*homes[e])] if homes[e] else c for e, c in enumerate(books[p])]
    out = []
    for (k, _), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((k, bytes(e for _, e in found).hex(), sum(d for d, _ in found)))
    return out, books


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string")


def check_codes(spark, rows, **options):
    got = vectorcode.code_table(vectors(spark, rows), **options).collect()
    want, books = brute_codes(rows, **options)
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in got) == Counter(want)
    flat = ",".join(str(x) for book in books for c in book for x in c)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}
    return got


def test_codes_equal_plain_integers(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 32))
    rows = [(i * 3 % 701, (centres[i % 9] + rng.normal(scale=0.2, size=32)).astype(np.float32).tolist(), i % 4 or None) for i in range(701)]
    rows += [(rows[5][0], rows[5][1], 1), (None, rows[7][1], 2), (9_000, None, 1), (9_001, [*rows[0][1][:-1], float("nan")], 1), (9_002, [*rows[0][1][:-1], None], 1),
             (9_003, [float("inf"), *rows[0][1][1:]], 1), (9_004, [0.0] * 32, None), (9_005, [0.0] * 32, None), (9_006, [-1 / 512] * 32, 3)]
    got = check_codes(spark, rows)
    labels = defaultdict(int)
    names = {(k): lab for k, v, lab in rows}
    for r in got:
        labels[names[r["vec_id"]]] += r["error"]
    assert all(r["label_error"] == labels[names[r["vec_id"]]] for r in got if r["vec_id"] not in (None, rows[5][0]))


def test_ties_and_fewer_rows_than_entries(spark):
    check_codes(spark, [(i, [float(i % 3)] * 16 + [0.5] * 16, None) for i in range(40)])
    check_codes(spark, [(1, [1.0] * 16, 1)])
    check_codes(spark, [(i, [float((i * 7) % 11 == j) for j in range(16)], i) for i in range(150)], entries=8, rounds=4)


def test_tables_without_vectors(spark):
    assert vectorcode.code_table(vectors(spark, [])).count() == 0
    assert vectorcode.code_table(vectors(spark, [(1, None, 1), (2, [None], 2)])).count() == 0
    with pytest.raises(ValueError):
        vectorcode.code_table(vectors(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(Exception, match="components"):
        vectorcode.code_table(vectors(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)])).collect()


def test_bounds_spare_most_comparisons_and_decide_nothing_wrong():
    """Over many rounds of moving entries, with stamps of different ages, every bound holds and the state stays exact."""
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (3_000, 4))
    history = [x[:64].copy()]
    state, scanned = None, []
    for t in range(8):
        task = vectorcode.Assigner(np.stack(history))
        if state is None:
            state, looked = task.fresh(x), len(x)
        else:
            state, looked = task.update(x, *state)
        scanned.append(looked)
        near, first, second = vectorcode.exact_scan(x, history[-1])
        assert (state[0] == near).all()
        now_upper = state[1] + task.moved[state[2], state[0]]
        now_lower = state[3] - task.other[state[4], state[0]]
        assert (now_upper + 1e-6 >= np.sqrt(first)).all() and (now_lower - 1e-6 <= np.sqrt(second)).all()
        book = history[-1].copy()
        for e in range(64):
            if (near == e).any():
                book[e] = x[near == e].sum(0) // (near == e).sum()
        history.append(book)
    assert scanned[-1] < 0.5 * scanned[0] and len({int(s) for s in state[4]}) > 1


def test_net_displacement_is_tighter_than_added_moves():
    there, away = np.array([[[0, 0], [50, 0]]]), np.array([[[30, 0], [50, 0]]])
    task = vectorcode.Assigner(np.concatenate([there, away, there + [[[1, 0], [0, 0]]]]))
    assert task.moved[0, 0] == 1.0 and task.moved[1, 0] == 29.0  # added up from round 0: 30 + 29


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree_of(leaves):
    """The root of a list of digests and the siblings (left, right) of each leaf, level by level."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            path.append((run[: at % 16], run[at % 16 + 1 :]))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r[:5]
        leaf, other = (H(*map(code, (doc_id, source, lang, n_chars, t))) for t in (text, lowered(text)))
        by[source].append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    lower = {}
    for s in order:
        by[s].sort()
        lower[s] = tree_of([x[2] for x in by[s]])
    root, upper = tree_of([lower[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for (_, _, leaf, other, doc_id), path in zip(by[s], lower[s][1]):
            way = path + above
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            h = other if bad else leaf
            for left, right in way:
                h = H(*left, h, *right)
            out.append((doc_id, leaf, lower[s][0], root, H(*[x for left, right in way for x in left + right]), h, h == root))
    return Counter(out)


def audited(docs):
    return Counter(map(tuple, merkle.audit(merkle.manifest(docs)).collect()))


def test_manifest_of_odd_rows(edge):
    rows = [tuple(r) for r in edge.collect()]
    got = audited(edge.withColumns({"leaf": F.lit("clash"), "root": F.lit(1), "path": F.lit(2)}))
    assert got == brute_manifest(rows)


def test_manifest_of_many_sources_and_of_one(spark):
    rows = [(i, f"Text {i % 7}", None, None if i % 19 == 0 else f"s{i % 300}" if i % 2 else "hot", i) for i in range(1_500)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = audited(spark.createDataFrame(rows, schema))
    assert got == brute_manifest(rows) and {x[-1] for x in got} == {True, False}
    for n in (1, 2, 16, 17, 257):
        one = [(i, "T", "en", "only", 1) for i in range(n)]
        assert audited(spark.createDataFrame(one, schema)) == brute_manifest(one)


def test_manifest_of_nothing(empty):
    assert merkle.audit(merkle.manifest(empty)).count() == 0


def test_any_change_breaks_the_proof(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", i) for i in range(200)]
    tree = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).limit(20).collect()
    for r in tree:
        path = [(p["l"], p["r"]) for p in r["path"]]

        def up(h, path):
            for left, right in path:
                h = H(left, h, right)
            return h

        assert up(r["leaf"], path) == r["root"] != up(r["other_leaf"], path)
        swapped = [(right, left) for left, right in path]
        assert up(r["leaf"], swapped) != r["root"]


@pytest.mark.parametrize("name", ["op11_warc_archives", "op12_vector_codes", "op13_merkle_manifest"])
def test_registered_queries_return_every_row(spark, small, name):
    table = {"op11": "pages", "op12": "embeddings", "op13": "documents"}[name.split("_")[0]]
    assert queries.QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{table}.parquet").count()
