"""Media columns of AVI files with motion-JPEG video.

Writing: bytes are stored losslessly as the quantised coefficients of baseline JPEG blocks, 64 bytes a block, each
frame a picture of its own. Reading: the RIFF index gives the frames; their entropy-coded intervals are decoded side
by side in numpy, whatever Huffman tables they name. Luminance histograms of neighbouring frames tell shots apart:
a cut is a difference well above those before it in the same shot.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
#: Frames of our own: blocks across and down, and frames a second.
ACROSS, DOWN, RATE = 8, 8, 25
#: Histogram bins; a cut's difference: at least FLOOR, and SPREADS deviations above the mean of the last MEMORY ones.
BINS, FLOOR, SPREADS, MEMORY = 32, 0.15, 4.0, 24
#: Bytes of media decoded side by side.
TOGETHER = 4_000_000


def zigzag() -> np.ndarray:
    """Place in an 8 by 8 block of each coefficient in stored order: along the antidiagonals, in turn up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
#: Basis of the inverse cosine transform: sample x of coefficient u.
BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], dtype=np.float32)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    """Up to the entropy-coded data. One-bit codes stand for the symbols in use; each block is a restart interval."""
    direct = bytes([0, *([1] + [0] * 15), 8])  # class 0, table 0: one code of length 1, for symbol 8 (eight bits follow)
    other = bytes([0x10, *([1] + [0] * 15), 8])  # class 1, table 0: the same for (no zeros, eight bits)
    return b"".join([
        b"\xff\xd8", _segment(0xDB, bytes([0]) + bytes([1]) * 64), _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, direct), _segment(0xC4, other), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))])


def _coded(blocks: np.ndarray) -> list[bytes]:
    """Entropy-coded data of frames, for bytes in the shape (frames, blocks, 64).

    A byte b is the coefficient b, or b - 255 below 128: these are just the values of eight bits, and their bits are b.
    """
    frames, n, _ = blocks.shape
    bits = np.zeros((frames * n, UNIT, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks.reshape(-1, UNIT, 1), axis=2)
    rows = np.packbits(bits.reshape(frames * n, UNIT * 9), axis=1)
    full = rows == 255
    sizes = rows.shape[1] + full.sum(axis=1) + 2
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    at = starts[:, None] + np.arange(rows.shape[1]) + np.cumsum(full, axis=1) - full
    out[at] = rows
    ends = starts + sizes
    out[ends - 2] = 0xFF
    out[ends - 1] = 0xD0 + np.tile(np.arange(n) % 8, frames)
    out[ends[n - 1 :: n] - 1] = 0xD9  # after the last interval stands the end of the picture
    return [out[starts[f * n] : ends[f * n + n - 1]].tobytes() for f in range(frames)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE, comment: bytes = b"") -> bytes:
    """An AVI file of motion-JPEG frames with an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture)))
    chunks, index, at = [], [], 4
    for frame in frames:
        chunks.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(chunks[-1])
    return _chunk(b"RIFF", b"AVI " + head + _list(b"INFO", _chunk(b"ICMT", comment)) + _list(b"movi", *chunks) + _chunk(b"idx1", b"".join(index)))


def store(payload: bytes) -> bytes:
    """``payload``, a positive multiple of 64 bytes, as an AVI file."""
    blocks = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    across = min(ACROSS, len(blocks))
    down = min(DOWN, -(-len(blocks) // across))
    each = across * down
    frames = -(-len(blocks) // each)
    every = np.zeros((frames * each, UNIT), dtype=np.uint8)
    every[: len(blocks)] = blocks
    head = _frame_head(8 * across, 8 * down)
    return write_avi([head + c for c in _coded(every.reshape(frames, each, UNIT))], 8 * across, 8 * down, comment=b"bytes=%d" % len(payload))


# Reading


def read_avi(data: bytes) -> tuple[float, list[bytes], bytes]:
    """Frames a second, the video frames in the index's order, and the comment; ValueError for what is no AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, comment, movi, index, walked = float(RATE), b"", None, None, []

    def walk(at: int, end: int, inside: bytes) -> None:
        nonlocal rate, comment, movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, stop, data[body : body + 4])
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, per = struct.unpack_from("<II", data, body + 20)
                rate = per / scale if scale else rate
            elif name == b"ICMT":
                comment = data[body:stop]
            elif name == b"idx1":
                index = (body, stop)
            elif inside in (b"movi", b"rec ") and name[2:] in (b"dc", b"db"):
                walked.append((body, stop))
            at = body + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]), b"AVI ")
    places = walked
    if index and movi is not None:
        entries = [struct.unpack_from("<4sIII", data, p) for p in range(index[0], index[1] - 15, 16)]
        base = 0 if entries and data[entries[0][2] : entries[0][2] + 4] == entries[0][0] and entries[0][2] > movi else movi
        places = [(base + at + 8, base + at + 8 + size) for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
    return rate, [data[a:b] for a, b in places], comment


class Picture:
    """A parsed baseline JPEG frame: its tables and its entropy-coded intervals."""

    def __init__(self, data: bytes):
        self.quant, self.huffman, self.interval, at = {}, {}, 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.float32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC0 or marker == 0xC1:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("only baseline frames can be decoded")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        raw = np.frombuffer(data, dtype=np.uint8, offset=at)
        mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0))
        ends = mark[(raw[mark + 1] < 0xD0) | (raw[mark + 1] > 0xD7)]
        stop = int(ends[0]) if len(ends) else len(raw)
        cuts = mark[mark < stop]
        self.intervals = [raw[a:b] for a, b in zip(np.r_[0, cuts + 2], np.r_[cuts, stop], strict=True)]
        single = len(self.parts) == 1
        tall, broad = max(p[2] for p in self.parts), max(p[1] for p in self.parts)
        self.mcus_across = -(-self.width // (8 if single else 8 * broad))
        self.mcus_down = -(-self.height // (8 if single else 8 * tall))
        #: For each block of a unit: its part, and that part's two Huffman tables.
        self.unit = [(k, self.tables[p[0]] >> 4, self.tables[p[0]] & 15) for k, p in enumerate(self.parts) for _ in range(1 if single else p[1] * p[2])]

    def shape(self) -> tuple:
        return tuple(sorted(self.huffman.items())), tuple(self.unit), len(self.parts)


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each prefix of 16 bits; length 0 where no code fits."""
    symbols, lengths, code, k = np.zeros(65536, dtype=np.uint8), np.zeros(65536, dtype=np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            a = code << (16 - n)
            symbols[a : a + (1 << (16 - n))] = table[k]
            lengths[a : a + (1 << (16 - n))] = n
            code, k = code + 1, k + 1
        code <<= 1
    return symbols.astype(np.int64), lengths


def coefficients(pictures: list[Picture]) -> list[np.ndarray]:
    """Quantised coefficients of pictures of one shape, in stored order: (blocks in coded order, 64) for each."""
    streams = [s for p in pictures for s in p.intervals]
    units = [min(p.interval or 1 << 30, p.mcus_across * p.mcus_down - i * (p.interval or 0)) for p in pictures for i in range(len(p.intervals))]
    flat = np.concatenate([*streams, np.zeros(16, dtype=np.uint8)])
    sizes = np.array([len(s) for s in streams])
    # a 0 after 255 was stuffed in
    stuffed = np.r_[False, (flat[:-1] == 255) & (flat[1:] == 0)]
    before = np.r_[0, np.cumsum(stuffed)]
    edges = np.r_[0, np.cumsum(sizes)]
    bit = (edges[:-1] - before[edges[:-1]]) * 8
    clean = np.r_[flat[~stuffed], np.zeros(8, dtype=np.uint8)].astype(np.uint32)
    limit = 8 * (len(clean) - 8)
    window = (clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]).astype(np.int64)
    first = pictures[0]
    luts = {key: lookup(table) for key, table in first.huffman.items()}
    units = np.array(units)
    per_unit = len(first.unit)
    first_block = np.cumsum(units * per_unit) - units * per_unit
    out = np.zeros((int((units * per_unit).sum()), 64), dtype=np.int32)
    flat_out = out.reshape(-1)

    def take(who: np.ndarray, lut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol and extra value of the next code of each interval in ``who``, whose bit positions move on."""
        at = np.minimum(bit[who], limit)
        prefix = (window[at >> 3] >> (16 - (at & 7))) & 0xFFFF
        symbol = lut[0][prefix]
        at = at + np.maximum(lut[1][prefix], 1)
        size = symbol & 15
        more = (window[np.minimum(at, limit) >> 3] >> (32 - (at & 7) - size)) & ((1 << size) - 1)
        bit[who] = at + size
        value = np.where((size > 0) & (more < (1 << np.maximum(size - 1, 0))), more - (1 << size) + 1, more)
        return symbol, size, value

    past = np.zeros((len(streams), first.shape()[2]), dtype=np.int64)
    for u in range(int(units.max()) if len(units) else 0):
        live = np.flatnonzero(units > u)
        for b, (part, direct, other) in enumerate(first.unit):
            base = (first_block[live] + u * per_unit + b) * 64
            _, _, value = take(live, luts[direct])
            past[live, part] += value
            flat_out[base] = past[live, part]
            who, place, k = live, base, np.zeros(len(live), dtype=np.int64)
            while len(who):
                symbol, size, value = take(who, luts[0x10 | other])
                run = symbol >> 4
                k = k + run + 1
                inside = (k < 64) & (size > 0)
                flat_out[(place + k)[inside]] = value[inside]
                keep = (k < 63) & ((size > 0) | (run == 15))
                if not keep.all():
                    who, place, k = who[keep], place[keep], k[keep]
    counts = np.array([sum(units[i : i + len(p.intervals)]) for p, i in zip(pictures, np.cumsum([0] + [len(p.intervals) for p in pictures[:-1]]), strict=True)]) * per_unit
    return np.split(out, np.cumsum(counts)[:-1])


def decode(pictures: list[Picture]) -> list[np.ndarray]:
    """Coefficients of all pictures; those of one shape are decoded side by side."""
    by_shape: dict = {}
    for i, p in enumerate(pictures):
        by_shape.setdefault(p.shape(), []).append(i)
    out: list = [None] * len(pictures)
    for group in by_shape.values():
        for i, c in zip(group, coefficients([pictures[i] for i in group]), strict=True):
            out[i] = c
    return out


def luminance(picture: Picture, stored: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of the first part's blocks, in coded order."""
    mine = np.tile([u[0] == 0 for u in picture.unit], len(stored) // len(picture.unit))
    block = np.zeros((int(mine.sum()), 64), dtype=np.float32)
    block[:, ZIGZAG] = stored[mine] * picture.quant[picture.parts[0][3]]
    rows = block.reshape(-1, 8) @ BASIS
    square = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS
    return np.clip(np.rint(square + 128), 0, 255).astype(np.uint8)


def histograms(pictures: list[Picture], stored: list[np.ndarray]) -> np.ndarray:
    """Each picture's shares of luminance in BINS bins."""
    out = np.zeros((len(pictures), BINS))
    for i, (p, c) in enumerate(zip(pictures, stored, strict=True)):
        h = np.bincount((luminance(p, c) >> 3).ravel(), minlength=BINS)
        out[i] = h / max(1, h.sum())
    return out


def shots(h: np.ndarray) -> list[tuple[int, int, float]]:
    """Shots (first frame, frame after the last, largest difference inside) by an adaptive threshold."""
    if not len(h):
        return []
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    found, start, past = [], 0, []
    for i, x in enumerate(d, 1):
        recent = past[-MEMORY:]
        limit = max(FLOOR, float(np.mean(recent) + SPREADS * np.std(recent))) if recent else FLOOR * 2
        if x > limit:
            found.append((start, i, max(past, default=0.0)))
            start, past = i, []
        else:
            past.append(float(x))
    return [*found, (start, len(h), max(past, default=0.0))]


def slices(items: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive items of about TOGETHER bytes."""
    part, size = [], 0
    for x in items:
        part.append(x)
        size += len(x)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def clip_rows(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Rows (doc_id, clip, first_frame, end_frame, start_s, end_s, largest_change): the shots of each AVI file.

    A null value, or one that is no AVI file of baseline motion-JPEG, gives no rows; so do files without frames.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, data in zip(frame.doc_id, frame.media, strict=True):
                try:
                    rate, raw, _ = read_avi(bytes(data) if data is not None else b"")
                    pictures = [Picture(x) for x in raw]
                except (ValueError, IndexError, struct.error, KeyError, AttributeError):
                    continue
                h = histograms(pictures, decode(pictures))
                rows += [(doc, n, a, b, a / rate, b / rate, c) for n, (a, b, c) in enumerate(shots(h))]
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s", "largest_change"])

    return media.select(F.col(key).alias("doc_id"), F.col(column).alias("media")).mapInPandas(
        run, f"doc_id {kind}, clip int, first_frame int, end_frame int, start_s double, end_s double, largest_change double")


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the binary column ``media``: each text's UTF-8 bytes, padded, as an AVI file. A null text counts as empty."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([store(padded((t or "").encode("utf-8", "replace"))) for t in s], dtype=object)

    return docs.withColumn("media", F.pandas_udf(run, "binary")(F.col(text)))


def _digest(files: list[bytes], sizes: list[int]) -> list[tuple]:
    """Digest rows of files that hold bytes, read back from what is stored."""
    opened = [read_avi(f) for f in files]
    pictures = [[Picture(x) for x in frames] for _, frames, _ in opened]
    stored = decode([p for group in pictures for p in group])
    at, out = 0, []
    for data, size, group, (rate, _, comment) in zip(files, sizes, pictures, opened, strict=True):
        mine = stored[at : at + len(group)]
        at += len(group)
        values = np.concatenate(mine).ravel()
        payload = np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[: int(comment.partition(b"=")[2])]
        h = histograms(group, mine)
        found = shots(h)
        feature = f"{len(group)}f{group[0].width}x{group[0].height}@{rate:g};" + ",".join(f"{a}-{b}" for a, b, _ in found) + f";{zlib.crc32(np.rint(h * 1e4).astype('<i4').tobytes()):08x}"
        out.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    return out


def round_trip(docs: DataFrame, text: str = "text") -> DataFrame:
    """Store every text as an AVI file, read it back, and add sizes, digests and the shots' feature string.

    Added: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; columns of these
    names are replaced. A null text counts as empty and is stored as 64 zero bytes. Equal texts get equal values.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        for part in slices([(t or "").encode("utf-8", "replace") for t in series]):
            rows += _digest([store(padded(x)) for x in part], [len(x) for x in part])
        return pd.DataFrame(rows, columns=names)

    made = F.pandas_udf(run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    kept = [c for c in docs.columns if c not in names]
    return docs.withColumn("_made", made(F.col(text))).select(*kept, "_made.*")
