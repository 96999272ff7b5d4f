"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on shared seeds of five words. For each pair that meets, running Karp-Rabin finds
the longest matches of words not yet marked, marks them, and goes on with shorter ones down to five words. The
share of an item's words under tiles is its coverage: a passage whose sentences were put in another order is
covered all the same.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a seed and of a tile, and the share of an item's words from which a document counts as leaked.
LEAST = 5
COVERAGE = 0.8
#: Bytes of test items sent to the executors at a time; larger benchmarks go in several passes over the documents.
BLOCK_BYTES = 8 * 1024 * 1024
WORD = re.compile(r"\w+")
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all windows of n numbers."""
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for j in range(n if len(h) else 0):
        h = h * np.uint64(MULTIPLIER) + ids[j : j + len(h)].astype(np.uint64) + np.uint64(1)
    return h


class Rolling:
    """Karp-Rabin hashes of a sequence's windows of any length, from running sums; and which of its words are free."""

    def __init__(self, ids: np.ndarray):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), MULTIPLIER, dtype=np.uint64)], dtype=np.uint64)
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), INVERSE, dtype=np.uint64)], dtype=np.uint64)
        self.ids, self.powers = ids, powers
        self.sums = np.r_[np.uint64(0), np.cumsum((ids + 2).astype(np.uint64) * back[:-1], dtype=np.uint64)]
        self.taken = np.r_[0, np.cumsum(ids < 0)]
        self.marked = ids < 0

    def mark(self, start: int, n: int) -> None:
        self.marked[start : start + n] = True

    def settle(self) -> None:
        self.taken = np.r_[0, np.cumsum(self.marked)]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of n free words."""
        starts = np.flatnonzero(self.taken[n:] == self.taken[: len(self.taken) - n])
        return starts, (self.sums[starts + n] - self.sums[starts]) * self.powers[starts]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in the document, start in the item, length), the longest first; ties go to the earliest.

    The length of the longest match of free words comes from a binary search: where n words match, n - 1 do. All
    matches of that length that don't overlap are marked in one go over the document's windows; each step is a
    sort of the windows' hashes, whatever repeats in them.
    """
    a, b = Rolling(np.asarray(doc, dtype=np.int64)), Rolling(np.asarray(item, dtype=np.int64))
    found: list[tuple[int, int, int]] = []

    def common(n: int) -> bool:
        return bool(np.isin(a.windows(n)[1], b.windows(n)[1]).any())

    most = min(len(a.ids), len(b.ids))
    while most >= least and common(least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        where = defaultdict(list)
        for p, h in zip(*(x.tolist() for x in b.windows(low)), strict=True):
            where[h].append(p)
        starts, hashes = a.windows(low)
        hit = np.isin(hashes, np.fromiter(where, dtype=np.uint64, count=len(where)))
        end = 0
        for d, h in zip(starts[hit].tolist(), hashes[hit].tolist(), strict=True):
            if d < end:
                continue
            places = where[h]
            while places and b.marked[places[0] : places[0] + low].any():
                places.pop(0)
            # equal hashes of unlike words are passed over
            p = next((p for p in places if not b.marked[p : p + low].any() and np.array_equal(a.ids[d : d + low], b.ids[p : p + low])), None)
            if p is not None:
                a.mark(d, low)
                b.mark(p, low)
                found.append((d, p, low))
                end = d + low
        a.settle()
        b.settle()
        most = low - 1
    return found


class Items(dict):
    """Test items by the numbers of their words, and their seeds. As a dict: word -> number, -1 for other words."""

    def __init__(self, rows: list[tuple]):
        super().__init__()
        self.ids, self.words, self.short = [], [], defaultdict(list)
        for item_id, text in rows:
            words = WORD.findall((text or "").lower())
            if len(words) >= LEAST:
                self.ids.append(item_id)
                self.words.append(np.array([self.setdefault(w, len(self)) for w in words], dtype=np.int64))
            elif words:
                self.short[tuple(words)].append(item_id)
        self.seeds_of = [np.unique(window_hashes(w, LEAST)) for w in self.words]
        flat = np.concatenate(self.seeds_of) if self.seeds_of else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(self.seeds_of)), [len(h) for h in self.seeds_of]) if self.seeds_of else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owners = flat[order], owner[order]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)

    def __missing__(self, word: str) -> int:
        return -1

    def leaks(self, text: str, least_coverage: float) -> list[tuple]:
        words = WORD.findall(text.lower())
        if len(words) < LEAST:
            return [(i, 1.0, 1) for i in self.short.get(tuple(words), ())]
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        known = np.r_[0, np.cumsum(ids >= 0)]
        at = np.flatnonzero(known[LEAST:] - known[:-LEAST] == LEAST)
        if not len(at) or not len(self.seeds):
            return []
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(LEAST):
            h = h * np.uint64(MULTIPLIER) + ids[at + j].astype(np.uint64) + np.uint64(1)
        seeds, times = np.unique(h, return_counts=True)
        low, high = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
        n = high - low
        ends = np.cumsum(n)
        spots = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(low, n)
        # a seed covers LEAST words at most each time it stands, which rules out nearly all items that share one
        hits = np.bincount(self.owners[spots], weights=np.repeat(times, n), minlength=len(self.ids))
        out = []
        for owner in np.flatnonzero((hits > 0) & (hits * LEAST >= least_coverage * self.sizes)):
            # only stretches of seeds can hold tiles; others keep apart as unmatched words
            part = np.full(len(ids), -1)
            for j in range(LEAST):
                spot = at[np.isin(h, self.seeds_of[owner])] + j
                part[spot] = ids[spot]
            keep = (part >= 0) | np.r_[False, part[:-1] >= 0]
            item = self.words[owner]
            if np.count_nonzero(part >= 0) < least_coverage * len(item):
                continue
            found = tiles(part[keep], item)
            coverage = sum(n for *_, n in found) / len(item)
            if coverage >= least_coverage:
                out.append((self.ids[owner], coverage, len(found)))
        return out


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text"):
    """The items in blocks of about BLOCK_BYTES, each small enough to send to every executor."""
    rows = benchmark.select(item, text).where(F.col(text).isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == k)
        yield [tuple(r) for r in part.orderBy(item, text).collect()]


def _leaks(block: list[tuple], kind: str, least_coverage: float):
    items = Items(block)

    def run(series: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "coverage": c, "n_tiles": n} for i, c, n in items.leaks(t or "", least_coverage)] for t in series], dtype=object)

    return F.pandas_udf(run, f"array<struct<item_id:{kind},coverage:double,n_tiles:int>>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, coverage, n_tiles) of documents that hold a test item.

    Null texts hold none, and null items and items without words are never found. An item of one to four words is
    held only by documents that have no other words: within longer texts it would stand by chance. Rows that repeat a
    document or an item with equal text give equal results, a repeated item once. An empty table gives no rows.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for block in item_blocks(benchmark):
        found = docs.select(F.col(key).alias("doc_id"), F.explode(_leaks(block, kind, least_coverage)(F.col(text))).alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema[key].dataType.simpleString()}, item_id {kind}, coverage double, n_tiles int")
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, least_coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns as they are."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    for block in item_blocks(benchmark):
        docs = docs.where(F.size(_leaks(block, kind, least_coverage)(F.col(text))) == 0)
    return docs
