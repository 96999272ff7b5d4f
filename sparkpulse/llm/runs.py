"""Periodic runs of words, caught online over dyadic blocks.

A square is a stretch of words followed by its own repetition. For squares whose half has between 2b and 4b words
there is a catcher over every completed block of b words, b a power of two: as words are appended it sees the block
come back at a distance q, and compares what followed the block with what follows its return, up to q words. A square
of period q contains such a block in its first half, so none is missed. Squares of one period that touch merge into a
run. Words are compared by prefix sums of their hashes first, and exactly before a run is reported, so that hashes
can't add, lose or lengthen one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices

#: A run has this many periods at least, and this many words.
PERIODS, LEAST = 4, 6
#: Bytes of text that one line of words holds at least; words appended together.
TOGETHER, STEP = 1_000_000, 1 << 17
#: Odd base of the hash sums modulo 2^64, and its inverse there.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
RUN = "array<struct<start:long,length:long,period:long>>"


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were ever asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(INVERSE, k, 1 << 64))])


POWERS = Powers()


def scrambled(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word number, without visible order."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class SquareCatcher:
    """Runs of a line of word numbers that grows; the same runs however the line was cut into pieces.

    ``longest`` bounds the length of a run, where the line is known to consist of parts of that many words at most.
    """

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.words, self.sums = np.zeros(0, np.int64), np.zeros(1, np.uint64)
        self.seen: dict[int, int] = {}  # by least period of a level: length of the line when its catchers last looked
        self.open: dict[int, np.ndarray] = {}  # by level: squares (first start, last start, period) that may go on
        self.found: dict[tuple[int, int], int] = {}  # (period, start) -> end

    def append(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """Take more words; the runs (start, length, period) that are new or longer than before."""
        self.words = np.concatenate([self.words, ids])
        n = len(self.words)
        POWERS.reach(n + 1)
        more = np.cumsum(scrambled(ids) * POWERS.up[n - len(ids) : n])
        self.sums = np.concatenate([self.sums, self.sums[-1] + more])
        most = min(n, self.longest or n) // PERIODS
        news, low, block = [], 1, 1
        while low <= most:
            high = 2 * block if low == 1 else 4 * block
            news += self._level(block, low, high)
            low, block = high, block * 2 if low > 1 else block
        return news

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of all runs so far, by start and period."""
        rows = sorted((start, end - start, period) for (period, start), end in self.found.items())
        return np.array(rows, np.int64).reshape(-1, 3)

    def _hash(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * POWERS.down[at]

    def _level(self, b: int, low: int, high: int) -> list[tuple[int, int, int]]:
        """Let the catchers over blocks of ``b`` words look for returns at distances from ``low`` to below ``high``."""
        n, before = len(self.words), self.seen.get(low, 0)
        self.seen[low] = n
        first = max(0, before - 2 * high) // b * b  # earlier blocks have seen all their distances
        size = n - b + 1 - first
        if size <= 0:
            return []
        values = (self.sums[first + b : n + 1] - self.sums[first : n + 1 - b]) * POWERS.down[first : n + 1 - b]
        rows = (size - 1) // b + 1
        beyond = np.zeros(rows * b + high - size, np.uint64)  # never a square: its end lies beyond the line
        values = np.concatenate([values, beyond])
        returns = np.lib.stride_tricks.as_strided(values[low:], (rows, high - low), (8 * b, 8))
        row, distance = np.nonzero(returns == values[: rows * b : b, None])
        start, period = first + row * b, distance + low
        new = (start + 2 * period <= n) & (start + 2 * period > before)
        start, period = start[new], period[new]
        if not len(start) and low not in self.open:
            return []
        cover = self._cover(low)
        fresh = cover(start) < start + 2 * period  # else it repeats a shorter period
        start, period = start[fresh], period[fresh]
        square = self._hash(start, period) == self._hash(start + period, period)
        start, period = start[square], period[square]
        spans = np.stack([start, start, period], axis=1)
        if low in self.open:
            spans = np.concatenate([self.open.pop(low), spans])
        if not len(spans):
            return []
        # squares of one period whose halves touch are parts of one run
        spans = spans[np.lexsort((spans[:, 0], spans[:, 2]))]
        cut = np.flatnonzero(np.r_[True, (np.diff(spans[:, 2]) != 0) | (spans[1:, 0] > spans[:-1, 1] + spans[:-1, 2])])
        spans = np.stack([spans[cut, 0], np.maximum.reduceat(spans[:, 1], cut), spans[cut, 2]], axis=1)
        going_on = spans[:, 1] + b + 2 * spans[:, 2] > n
        if going_on.any():
            self.open[low] = spans[going_on]
        # a run goes on by less than a block to each side of the squares found in it
        long = spans[:, 1] - spans[:, 0] + 2 * spans[:, 2] + 2 * b >= np.maximum(PERIODS * spans[:, 2], LEAST)
        news = []
        for s0, s1, q in spans[long].tolist():
            for x, y in self._exact(s0, s1 + 2 * q, q):
                if y - x >= max(PERIODS * q, LEAST) and cover(x) < y and self.found.get((q, x)) != y:
                    self.found[q, x] = y
                    news.append((x, y - x, q))
        return news

    def _cover(self, below: int):
        """A function from positions to how far the runs of periods under ``below`` that start there or before reach."""
        known = sorted((start, end) for (period, start), end in self.found.items() if period < below)
        starts, ends = np.array([(-1, -1), *known]).T  # no run starts before the line
        ends = np.maximum.accumulate(ends)
        return lambda at: ends[np.searchsorted(starts, at, side="right") - 1]

    def _exact(self, start: int, end: int, q: int) -> list[tuple[int, int]]:
        """The longest stretches of period ``q`` that meet the words from ``start`` to ``end``, by comparing words."""
        w, n = self.words, len(self.words)
        same = np.r_[False, w[start : end - q] == w[start + q : end], False]
        out = []
        for a, z in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            x, y = start + a, start + z + q
            if x == start:
                x -= agreeing(lambda k: (w[start - k : start][::-1], w[start + q - k : start + q][::-1]), start)
            if y == end:
                y += agreeing(lambda k: (w[end - q : end - q + k], w[end : end + k]), n - end)
            out.append((x, y))
        return out


def agreeing(pieces, most: int) -> int:
    """How many words two lines have in common from their starts; ``pieces`` gives their first k words, k at most ``most``."""
    k = 16
    while True:
        k = min(k, most)
        unlike = np.flatnonzero(np.not_equal(*pieces(k)))
        if len(unlike):
            return int(unlike[0])
        if k == most:
            return most
        k *= 2


def find_in(texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Of each text its words, its runs (start, length, period), and which of its words are kept."""
    split = [t.split() for t in texts]  # bytes are split at the six ASCII white-space characters, and no others
    sizes = np.array([len(x) for x in split], np.int64)
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    catcher = SquareCatcher(int(sizes.max(initial=0)))
    line = []
    for k, words in enumerate(split):
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        line += [ids, np.array([-1 - k])]  # a word of its own ends each text, so that no run leaves it
    line = np.concatenate(line) if line else np.zeros(0, np.int64)
    for at in range(0, len(line), STEP):
        catcher.append(line[at : at + STEP])
    runs = catcher.runs()
    starts = np.cumsum(sizes + 1) - sizes - 1
    edges = np.zeros(len(line) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges) == 0
    first = np.searchsorted(runs[:, 0], np.r_[starts, len(line)])
    out = []
    for k, (words, a) in enumerate(zip(split, starts.tolist(), strict=True)):
        mine = runs[first[k] : first[k + 1]] - [a, 0, 0]
        out.append((words, mine, kept[a : a + len(words)]))
    return out


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, runs, collapsed): each text's runs of words, and its words without their repetitions.

    Words are what stands between the ASCII characters for white space, numbered from 0. A run is a stretch of words
    with a least period q, of max(6, 4 q) words at least, that no neighbouring word extends; runs come by start, then
    period. A word goes if any run contains it after its first q words; the others are joined by one space. A null
    text counts as empty: no words, no runs, an empty text. Rows are taken as they come, so repeated rows and null
    keys give rows of their own; an empty table gives none; other columns are left out, whatever their names. No row
    is shuffled; a task holds about a megabyte of text at a time, or one longer text.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text", TOGETHER, 10_000):
            found = find_in([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            runs = np.concatenate([r for _, r, _ in found])
            ends = np.cumsum([0, *[len(r) for _, r, _ in found]])
            collapsed = [b" ".join(words if kept.all() else compress(words, kept.tolist())) for words, _, kept in found]
            fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array([len(words) for words, _, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_words long, runs {RUN}, collapsed string").withColumnRenamed("key", key)


def repeated_tail(key: Column, text: Column) -> Column:
    """Texts for trying the operator: a tenth, by CRC-32 of the key, has a tail that repeats a few words to the end.

    With h the CRC-32 and g = floor(h / 10), a text of n words is changed if h % 10 = 0: from word a = g % n on, the
    first p = 1 + floor((n - a) / (3 + g % 8)) words repeat. Words are then joined by one space.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), changed), 1)).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per text: the number of runs, the run of greatest exponent (ties: least start, then period), and two digests."""
    least = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs are in the order of ties, so that only a greater exponent takes the place of one before
    best = F.aggregate("runs", least, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
