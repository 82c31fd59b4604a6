"""WARC archives with one Zstandard frame per record and their dictionary in a leading skippable frame.

Writing: pages are dealt by the digest of their payload. Of equal payloads the one with the largest key is stored as a
`response`, the others as `revisit` records that name it. Each task writes archives of bounded size: a skippable frame with
a dictionary trained on the archive's first payloads, then one checked frame per record. A table of the finished archives,
committed by Spark, says which files count, so a task that ran twice leaves no double records.

Reading: archives are dealt to tasks and streamed frame by frame. The dictionary is loaded from the leading frame, every
frame must hold exactly one record, and version line, named fields, lengths and digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import OWN, attach_totals

# Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC, RAW_DICTIONARY = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528, b"\x37\xa4\x30\xec"
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "warc-type", "warc-date", "content-length")
#: Stands for a null address, since every record must name a target.
NO_URI = "unknown:"
#: Uncompressed bytes after which an archive is closed, of its first payloads a dictionary learns from, and of the dictionary.
ARCHIVE_BYTES, LEARN_BYTES, DICTIONARY_BYTES = 128 << 20, 2 << 20, 64 << 10
CHUNK = 1 << 20
CONTROL = re.compile(r"[\x00-\x20\x7f]")

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("key", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("refers_to_key", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("error", T.StringType()),
])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(path: str):
    """The file system of a path and the path inside it, for tasks that stream bytes; any store that Arrow knows."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def record(kind: str, record_id: str, uri: str | None, date: str, key, digest: str, payload: bytes, refers_to: str | None = None, refers_to_key=None) -> bytes:
    """One record: an HTTP response with the payload, or only its head for a revisit."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
              ("WARC-Target-URI", CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", uri) if uri else NO_URI),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if key is not None:
        fields.append(("X-Key", key))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
        if refers_to_key is not None:
            fields.append(("X-Refers-To-Key", refers_to_key))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return "\r\n".join([VERSION, *(f"{n}: {v}" for n, v in fields), "", ""]).encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """One archive at a time: records wait until there is enough to learn a dictionary from, then stream out as frames."""

    def __init__(self, folder: str, level: int, archive_bytes: int):
        self.store, self.folder = open_store(folder)
        self.level, self.limit = level, archive_bytes
        self.waiting: list[bytes] = []
        self.held, self.written, self.count, self.out = 0, 0, 0, None

    def add(self, data: bytes) -> tuple[str, int, int] | None:
        """Takes a record; (name, records, bytes) of the archive that it filled, else None."""
        self.count, self.written = self.count + 1, self.written + len(data)
        if self.out is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= LEARN_BYTES:
                self._open()
        else:
            self.out.write(self.compressor.compress(data))
        return self.close() if self.written >= self.limit else None

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        dictionary = None
        try:
            # k and d fix the learner's window, so it does not search for them.
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, self.held // 8), [x[: 64 << 10] for x in self.waiting], k=256, d=8)
        except zstandard.ZstdError:
            pass  # too few or too small records; the format allows an archive without a dictionary
        self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for data in self.waiting:
            self.out.write(self.compressor.compress(data))
        self.waiting, self.held = [], 0

    def close(self) -> tuple[str, int, int] | None:
        if not self.count:
            return None
        if self.out is None:
            self._open()
        size = self.out.tell()
        self.out.close()
        done = (self.name, self.count, size)
        self.written, self.count, self.out = 0, 0, None
        return done


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", content: str = "html", least: int = 0,
                   date: str = "1970-01-01T00:00:00Z", level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per row: archives under `path`, and the table of them in `path`/manifest.

    A null content is empty, a null address `unknown:`. Of equal payloads of at least `least` bytes the row with the largest
    key is the response (of equal keys that with the largest address, nulls smallest; of equal rows any one); a null key
    is left out of its record. Other columns are ignored. An empty table gives an empty manifest. Folders must be new.
    """
    payload = F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), payload.alias("payload"))
    digest = F.sha1("payload")
    rows = rows.withColumn("digest", digest)
    best = F.struct("key", "uri", F.col(f"{OWN}salt").alias("salt"))
    rows = attach_totals(rows, ["digest"], ["key", "uri"], {"best": F.max(best)}, {"best": F.max("best")})
    inside = Window.partitionBy("digest", f"{OWN}salt").orderBy(F.col("key").desc_nulls_last(), F.col("uri").desc_nulls_last())
    rows = rows.withColumn("nth", F.row_number().over(inside)).select(
        F.col("key").cast("string").alias("key"), "uri", "payload", "digest", "nth", F.col(f"{OWN}salt").alias("salt"),
        F.col("best.key").cast("string").alias("best_key"), (F.col("best.salt") == F.col(f"{OWN}salt")).alias("home"))
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])

    def name(*parts) -> str:
        return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = ArchiveWriter(path, level, archive_bytes), []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for at in range(batch.num_rows):
                k, u, data, sha, nth, salt, best_key, home = (c[at].as_py() for c in columns)
                digest, first = base64.b32encode(bytes.fromhex(sha)).decode(), home and nth == 1
                if first or len(data) < least:
                    out = record("response", name("response", sha) if first else name("response", sha, salt, nth), u, date, k, digest, data)
                else:
                    out = record("revisit", name("revisit", sha, salt, nth), u, date, k, digest, data, name("response", sha), best_key)
                full = writer.add(out)
                done += [full] if full else []
        last = writer.close()
        done += [last] if last else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=schema.names)

    spark = pages.sparkSession
    make_folder(spark, path)
    rows.mapInArrow(run, schema).write.parquet(f"{path}/manifest")


def make_folder(spark: SparkSession, path: str) -> None:
    """The folder must exist before tasks open files in it; it is made through Arrow like the files themselves."""
    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)


def load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary as it stands, or itself in a Zstandard frame."""
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    if raw[:4] != RAW_DICTIONARY:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(raw)


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every data frame of an archive; only one frame is held at a time."""
    held, base, dictionary, first = b"", 0, None, True

    def fill(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = stream.read(max(CHUNK, n - len(held)))
            if not more:
                return False
            held += more
        return True

    decoder = zstandard.ZstdDecompressor()
    while fill(1):
        if not fill(8):
            raise ValueError(f"truncated frame at {base}")
        magic, size = struct.unpack("<II", held[:8])
        if magic in SKIPPABLE:
            if not fill(8 + size):
                raise ValueError(f"truncated skippable frame at {base}")
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise ValueError(f"a dictionary at {base}, not at the start")
                decoder = zstandard.ZstdDecompressor(dict_data=load_dictionary(held[8 : 8 + size]))
            held, base, first = held[8 + size :], base + 8 + size, False
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {base}")
        frame, parts, start, first = decoder.decompressobj(), [], base, False
        try:
            while True:
                parts.append(frame.decompress(held))
                if frame.eof:
                    break
                base += len(held)
                held = stream.read(CHUNK)
                if not held:
                    raise ValueError(f"truncated frame at {start}")
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame at {start}: {e}") from e
        base, held = base + len(held) - len(frame.unused_data), frame.unused_data
        yield start, b"".join(parts)


def parse(data: bytes) -> dict:
    """The fields of one record, checked: version, field lines, required fields, lengths, ending, HTTP head and digest."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a head without end")
    try:
        version, *lines = re.sub("\r\n[ \t]+", " ", data[:end].decode()).split("\r\n")
    except UnicodeDecodeError as e:
        raise ValueError("a head that is no UTF-8") from e
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"unknown version {version[:40]!r}")
    fields = {}
    for line in lines:
        field, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", field):
            raise ValueError(f"no field line: {line[:80]!r}")
        fields[field.lower()] = value.strip()
    missing = [f for f in REQUIRED if f not in fields]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} does not end the record")
    kind = fields["warc-type"]
    fields["payload"] = payload = None
    if kind in ("response", "revisit"):
        head = block.find(b"\r\n\r\n")
        if not block.startswith(b"HTTP/") or head < 0:
            raise ValueError("no HTTP head")
        length = re.search(rb"\r\nContent-Length: *([0-9]+)", block[: head + 2], re.I)
        if kind == "response":
            fields["payload"] = payload = block[head + 4 :]
            if length and int(length[1]) != len(payload):
                raise ValueError("the payload's length is not its HTTP length")
        if payload is not None and "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError("the payload's digest differs")
        told = fields.get("x-payload-length") or (length[1].decode() if length else None)
        fields["payload-bytes"] = len(payload) if payload is not None else int(told) if told and told.isdigit() else None
        if payload is not None and told is not None and str(len(payload)) != told:
            raise ValueError("the payload's length differs")
    return fields


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def read_archives(spark: SparkSession, path: str, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in the manifest of `path`.

    `strict` fails on the first record that is not whole; otherwise such a record is a row with `error` set, and a frame
    that cannot be decoded ends its archive with one. `with_payload=False` checks payloads without returning them.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    archives = manifest.count()
    todo = manifest.select("archive", "records").repartition(max(1, archives))

    def rows(archive: str, expected: int) -> Iterator[tuple]:
        store, folder = open_store(path)
        count = 0
        try:
            with store.open_input_stream(f"{folder}/{archive}", compression=None) as stream:
                for offset, data in frames(stream):
                    count += 1
                    try:
                        f = parse(data)
                    except ValueError as e:
                        if strict:
                            raise ValueError(f"{archive}, record at {offset}: {e}") from e
                        yield (None,) * 10 + (archive, offset, str(e))
                        continue
                    uri = f.get("warc-target-uri")
                    yield (_bare(f["warc-record-id"]), f["warc-type"], None if uri == NO_URI else uri, f["warc-date"], f.get("x-key"), _bare(f.get("warc-refers-to")),
                           f.get("x-refers-to-key"), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, f.get("payload-bytes"),
                           f["payload"] if with_payload else None, archive, offset, None)
            if count != expected:
                raise ValueError(f"{archive} holds {count} records, not {expected}")
        except ValueError as e:
            if strict:
                raise
            yield (None,) * 10 + (archive, None, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, expected in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for row in rows(archive, expected):
                    held.append(row)
                    size += len(row[9] or b"") + 500
                    if size >= 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return todo.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary() if f.name == "payload" else pa.int64() if f.dataType == T.LongType() else pa.string() for f in RECORD.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=RECORD.names)


def page_digests(records: DataFrame, key_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's key for revisits) of read records."""
    refers_to: Column = F.col("refers_to_key").cast(key_type)
    return records.select(F.col("key").cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers_to.alias("refers_to"))
