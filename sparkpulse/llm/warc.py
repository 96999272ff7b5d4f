"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records; a skippable frame that maps record
identifiers to places within frames; and, as its last frame, the seek table of the seekable format, which says where
every frame begins. So a record is read by its identifier from one frame, and any tool that knows Zstandard reads the
whole file as a WARC. Spark writes and commits the files, one to a row, so that they may lie wherever Spark can write.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices

# Fixed values of the formats
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are stored again each time.
LEAST_BYTES = 1000
#: Bytes of records in a frame, and of frames in a bundle; a larger record is a frame of its own, and may end a bundle.
FRAME_BYTES, BUNDLE_BYTES = 256 * 1024, 16 * 1024 * 1024
#: Tasks that the copies of one payload are dealt out over.
SALTS = 32
#: Bytes of records that a reader hands on together.
TOGETHER = 4_000_000
RECORD = "record_id string, record_type string, url string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
PLACE = "record_id string, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"


# Records


def record_id(key: str | None) -> str:
    """The identifier of a page's record; pages without a key share one."""
    return "urn:page" if key is None else "urn:page:" + quote(key, safe="")


def key_of(identifier: str | None) -> str | None:
    return unquote(identifier[len("urn:page:") :]) if identifier and identifier != "urn:page" else None


def record(key: str | None, url: str | None, digest: str, size: int, refers_to: str | None, payload: bytes | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header alone. ``digest`` is hexadecimal SHA-1."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(key)}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else quote(c) for c in url))
    if revisit:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at a place, and where the next one does. A broken record is an error."""
    head_end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:head_end].decode("utf-8").split("\r\n")
    head = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
    start = head_end + 4
    end = start + int(head["content-length"])
    if version != "WARC/1.1" or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"no whole record at byte {at}")
    http_end = data.index(b"\r\n\r\n", start, end) + 4
    http = dict(x.partition(": ")[::2] for x in data[start : http_end - 4].decode("latin-1").lower().split("\r\n")[1:])
    return {
        "record_id": head["warc-record-id"][1:-1], "record_type": head["warc-type"], "url": head.get("warc-target-uri"), "date": head["warc-date"],
        "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(), "payload_bytes": int(http["content-length"]),
        "refers_to": head["warc-refers-to"][1:-1] if "warc-refers-to" in head else None, "payload": data[http_end:end] if head["warc-type"] == "response" else None}, end + 4


# Bundles


class Bundle:
    """Frames of records as they are gathered, up to a limit."""

    def __init__(self, level: int = 3):
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.places: list[tuple[str, int, int, int]] = []
        self.waiting: list[bytes] = []
        self.held = self.stored = 0

    def add(self, identifier: str, data: bytes) -> None:
        if self.waiting and self.held + len(data) > FRAME_BYTES:
            self.close_frame()
        self.places.append((identifier, len(self.frames), self.held, len(data)))
        self.waiting.append(data)
        self.held += len(data)

    def close_frame(self) -> None:
        if self.waiting:
            self.frames.append(self.zstd.compress(b"".join(self.waiting)))
            self.sizes.append(self.held)
            self.stored += len(self.frames[-1])
            self.waiting, self.held = [], 0

    def full(self) -> bool:
        return self.stored >= BUNDLE_BYTES

    def bytes(self) -> bytes:
        """The file: frames, the index of records, the seek table."""
        self.close_frame()
        index = self.zstd.compress(json.dumps(self.places, separators=(",", ":")).encode())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        entries = b"".join(struct.pack("<II", len(x), n) for x, n in [*zip(self.frames, self.sizes, strict=True), (index, 0)])
        table = struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames) + 1, 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, index, table])


def seek_table(data: bytes) -> list[tuple[int, int]]:
    """(start, bytes) of each frame of a bundle, that of the index last; an empty file has none."""
    if not data:
        return []
    n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for k in range(n):
        size = struct.unpack_from("<I", data, len(data) - 9 - width * (n - k))[0]
        out.append((at, size))
        at += size
    return out


def frame_at(data: bytes, start: int, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(memoryview(data)[start : start + size])


def places(data: bytes) -> list[tuple[str, int, int, int, int, int]]:
    """(identifier, frame, its start and bytes in the file, offset within it, length) of each record of a bundle."""
    table = seek_table(data)
    if not table:
        return []
    start, size = table[-1]
    return [(name, k, *table[k], offset, length) for name, k, offset, length in json.loads(frame_at(data, start + 8, size - 8))]


# Archives


def choose_responses(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Pages with _payload, _digest, _bytes and _refers: the key of the page that a page's record refers to, else null.

    Of pages with equal payloads of LEAST_BYTES at least, those of the largest key are responses, the others refer to it.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    sized = pages.withColumns({"_payload": body, "_digest": F.sha1(body), "_bytes": F.octet_length(body).cast("long")})
    large = F.col("_bytes") >= LEAST_BYTES
    last = sized.where(large).groupBy("_digest", "_bytes").agg(F.max(key).alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    last = last.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = sized.withColumn("_salt", F.pmod(F.hash(key), F.lit(SALTS))).join(last, ["_digest", "_bytes", "_salt"], "left")
    return dealt.withColumn("_refers", F.when(~F.col("_last").eqNullSafe(F.col(key)), F.col("_last"))).drop("_salt", "_last")


def write_archive(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row, as bundles in ``root``/bundles, and where each record lies in ``root``/index.

    A null payload counts as empty; a null address leaves its line out, and control characters and spaces of an address
    are percent-encoded. Rows that repeat a key get records of one identifier: those of a payload's largest key are all
    responses. Pages whose key is null refer to others, and are referred to by none. An empty table gives an archive
    without records; other columns are left out. A task holds one bundle at a time; lost tasks write theirs anew.
    """
    rows = choose_responses(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("body")), "key", "body").select(
        F.col("key").cast("string"), F.col("url").cast("string"), "_digest", "_bytes", F.col("_refers").cast("string"), F.when(F.col("_refers").isNull(), F.col("_payload")).alias("_payload"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda bundle: pa.RecordBatch.from_arrays([pa.array([bundle.bytes()[:-4]], pa.binary())], names=["body"])
        bundle = Bundle()
        for part in arrow_slices(batches, "_payload", TOGETHER, 10_000):
            for k, address, digest, size, refers, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                bundle.add(record_id(k), record(k, address, digest, size, None if refers is None else record_id(refers), data, date))
                if bundle.full():
                    yield one(bundle)
                    bundle = Bundle()
        if bundle.places:
            yield one(bundle)

    # a line of text is a bundle without its last four bytes, which are the line's end; a file has one line
    end = struct.pack("<I", SEEKABLE_MAGIC).decode("latin-1")
    lines = rows.mapInArrow(gather, "body binary").select(F.col("body").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(f"{root}/bundles")
    found_places(pages.sparkSession, root).write.mode("overwrite").parquet(f"{root}/index")


def delete_archive(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bundles(spark: SparkSession, root: str, paths: Sequence[str] = ()) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths) or f"{root}/bundles").select("path", "content")


def found_places(spark: SparkSession, root: str) -> DataFrame:
    """Where each record lies, by the bundles' own indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "content", 1, 1):
            path, data = part.column("path")[0].as_py(), part.column("content")[0].as_py()
            rows = [(name, path, *rest) for name, *rest in places(data)]
            yield pa.RecordBatch.from_pylist([dict(zip(PLACE_SCHEMA.names, r, strict=True)) for r in rows], PLACE_SCHEMA)

    return bundles(spark, root).mapInArrow(run, PLACE)


PLACE_SCHEMA = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), *[(n, pa.int64()) for n in ("frame_start", "frame_bytes", "offset", "length")]])
RECORD_SCHEMA = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "url", "date", "payload_digest")] + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])


def handed_on(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r["payload"] or b"") + 500
        if size >= TOGETHER:
            yield pa.RecordBatch.from_pylist(held, RECORD_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, RECORD_SCHEMA)


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """All records, frame by frame; a revisit has no payload of its own, but the size and digest of the whole one."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in arrow_slices(batches, "content", 1, 1):
            data = part.column("content")[0].as_py()
            for start, size in seek_table(data)[:-1]:
                frame, at = frame_at(data, start, size), 0
                while at < len(frame):
                    found, at = parsed(frame, at)
                    yield found

    return bundles(spark, root).mapInArrow(lambda batches: handed_on(every(batches)), RECORD)


def fetch(spark: SparkSession, root: str, identifiers: Sequence[str]) -> DataFrame:
    """The records of some identifiers, of which the driver holds the places: only their bundles are read, and only their frames decompressed."""
    index = spark.read.schema(PLACE).parquet(f"{root}/index")
    asked = spark.createDataFrame([(x,) for x in set(identifiers)], "record_id string")
    wanted: dict[str, dict[tuple[int, int], list[int]]] = {}
    for r in index.join(F.broadcast(asked), "record_id").collect():
        wanted.setdefault(r.bundle, {}).setdefault((r.frame_start, r.frame_bytes), []).append(r.offset)
    if not wanted:
        return spark.createDataFrame([], RECORD)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in arrow_slices(batches, "content", 1, 1):
            data = part.column("content")[0].as_py()
            for (start, size), offsets in wanted[part.column("path")[0].as_py()].items():
                frame = frame_at(data, start, size)
                for at in offsets:
                    yield parsed(frame, at)[0]

    return bundles(spark, root, sorted(wanted)).mapInArrow(lambda batches: handed_on(some(batches)), RECORD)


def summary(records: DataFrame, kind: str = "bigint") -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of what was read back (a revisit's as it tells them), record_type, refers_to."""
    response = F.col("record_type") == "response"
    key = lambda c: F.url_decode(F.nullif(F.regexp_replace(c, "^urn:page:?", ""), F.lit(""))).cast(kind)
    return records.select(
        key(F.col("record_id")).alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", key(F.col("refers_to")).alias("refers_to"))
