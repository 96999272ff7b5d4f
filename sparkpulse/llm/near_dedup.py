"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

Weighted sets: a text's five-word shingles with their counts. Every unit of weight of a shingle throws a Poisson
number of hashed darts onto a rank axis that is cut into doubling regions; each dart hits one coordinate, and each
coordinate keeps its earliest dart. Only as many regions are opened as the set's total weight needs. Texts whose
darts agree in one band meet in a bucket; there they are compared with a pivot, and only those that this leaves open
with others, by rare shingles: never all with all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_slices, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Darts expected for one set: enough that a coordinate stays empty with probability e^-2 / COORDINATES or so.
DARTS = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES
#: The first region ends at rank 2^LOWEST; each later one at twice the rank.
LOWEST = -12
#: Texts, and about how many of their bytes, in one pass of numpy, which bounds its arrays.
TEXTS, TOGETHER = 256, 500_000
#: Words whose hashes a task remembers; beyond it the table starts anew.
REMEMBERED = 100_000
#: Steps of set sizes by which prefix probes are joined.
GRAIN = 1.05
WORD = re.compile(r"\w+")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Word -> hash, computed once a task; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def units(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All texts' units of weight as hashes, the text each belongs to, and each text's fingerprint.

    The n-th occurrence of a shingle is a unit of its own, so the Jaccard similarity of units is the weighted one
    of shingles. Texts of one to four words have one unit, texts without words none. Equal word sequences have
    equal fingerprints; texts without words are told apart by their characters.
    """
    parts, owner, prints = [], [], []
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        if not words:
            prints.append(hashlib.blake2b(b"\0" + text.encode("utf-8", "replace"), digest_size=16).digest())
            continue
        h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        prints.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
        n = max(1, len(h) - WORDS + 1)
        s = np.zeros(n, dtype=np.uint64)
        for j in range(min(WORDS, len(h))):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        parts.append(mixed(s))
        owner.append(np.full(n, i))
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), prints
    shingle, text_of = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((shingle, text_of))
    shingle, text_of = shingle[order], text_of[order]
    first = np.r_[True, (shingle[1:] != shingle[:-1]) | (text_of[1:] != text_of[:-1])]
    at = np.arange(len(shingle))
    nth = at - at[first][np.cumsum(first) - 1]
    return mixed(shingle + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), text_of, prints


def poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable, up to where they reach 1."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
    logs = k * np.log(mean) - mean - np.r_[0.0, np.cumsum(np.log(k[1:]))]
    return np.cumsum(np.exp(logs))


def bands(unit: np.ndarray, text_of: np.ndarray, n_texts: int) -> np.ndarray:
    """Bucket keys, one row of BANDS a text; rows of texts without units are 0."""
    best = np.full(n_texts * COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    weight = np.bincount(text_of, minlength=n_texts)
    present = weight > 0
    need = np.full(n_texts, LOWEST)
    need[present] = np.maximum(LOWEST, np.ceil(np.log2(DARTS / weight[present]))).astype(int)
    level, waiting = LOWEST, present.copy()
    while waiting.any():
        take = waiting[text_of]
        u, t = unit[take], text_of[take]
        low, high = (0.0 if level == LOWEST else 2.0 ** (level - 1)), 2.0**level
        salt = mixed(u + np.uint64((level - LOWEST + 1) * 0xA0761D6478BD642F % 2**64))
        n = np.searchsorted(poisson_steps(high - low), (salt >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        some = n > 0
        n, salt, t = n[some], salt[some], t[some]
        ends = np.cumsum(n)
        nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        dart = mixed(np.repeat(salt, n) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        place = mixed(dart ^ np.uint64(0x8EBC6AF09C88C6E3))
        rank = (low + (high - low) * ((dart >> np.uint64(40)).astype(np.float64) + 0.5) * 2.0**-24).astype(np.float32)
        value = (rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (place & np.uint64(0xFFFFFFFF))
        spot = np.repeat(t, n) * COORDINATES + ((place >> np.uint64(32)) % np.uint64(COORDINATES)).astype(np.int64)
        np.minimum.at(best, spot, value)
        full = (best.reshape(n_texts, COORDINATES) != np.iinfo(np.uint64).max).all(axis=1)
        waiting &= ~((need <= level) & full)
        level += 1
    rows = best.reshape(n_texts, BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n_texts, 1))
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    key[~present] = 0
    return key.view(np.int64)


def with_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add row_a and row_b, 96 bits of hash of a row's key and text: rows that share them are repeated rows."""
    return docs.withColumns({"row_a": F.xxhash64(key, F.coalesce(text, F.lit(""))), "row_b": F.hash(F.coalesce(text, F.lit("")), key)})


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row_a, row_b, fp, b0 ..): fingerprint and bucket keys of every row; keys are null for texts without words."""
    names = [f"b{i}" for i in range(BANDS)]
    source = with_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in arrow_slices(batches, "text", TOGETHER, TEXTS):
            unit, text_of, prints = units([t or "" for t in part.column("text").to_pylist()], hashes)
            keys = bands(unit, text_of, part.num_rows)
            absent = np.bincount(text_of, minlength=part.num_rows) == 0
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "row_a", "row_b")), pa.array(prints, pa.binary()), *(pa.array(keys[:, j].copy(), mask=absent) for j in range(BANDS))], names=["doc_id", "row_a", "row_b", "fp", *names])

    schema = source.drop("text").schema.add("fp", "binary")
    for n in names:
        schema = schema.add(n, "long")
    return source.mapInArrow(run, schema)


def unit_sets(texts: DataFrame) -> DataFrame:
    """Rows (fp, grams) for rows (fp, text): the text's units, cut to 32 bits, sorted and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in arrow_slices(batches, "text", TOGETHER, TEXTS):
            unit, text_of, prints = units(part.column("text").to_pylist(), hashes)
            ends = np.searchsorted(text_of, np.arange(part.num_rows + 1))
            packed = [np.unique((unit[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(packed, pa.binary())], names=["fp", "grams"])

    return texts.select("fp", "text").mapInArrow(run, "fp binary, grams binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose unit sets have SIMILARITY or more."""
    left = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame.x, frame.y, strict=True):
                p, q = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = 0
                if min(len(p), len(q)) >= SIMILARITY * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(p) + len(q) - both))
            yield frame.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a binary, b binary")


def smallest_reachable(edges: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Rows (node, root): each node's smallest reachable node, by alternating large-star and small-star steps.

    Every step is an aggregation and a join, over tables of ``rows`` or so edges that are written between steps.
    Nodes without edges are left out.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = scratch.written(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least", rows)
        linked = near.join(least, "a")
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return scratch.written(out.where("a <> b").distinct(), "cc-edges", rows)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges", rows)
    now = state(e)
    while now[0]:
        e = star(star(e, large=True), large=False)
        before, now = now, state(e)
        if now == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def prefixes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (fp, token, place, size) for rows (fp, grams, family): of each set the rarest units that also stand in other sets, within its prefix.

    Two sets of SIMILARITY or more share a unit among the first (1 - o) * size + 1 of each, o being the share of
    itself that a set must then have in common with the other, when units are ordered by how many sets hold them.
    Sets are packed in slices, families side by side, so that a unit is counted once a slice before any shuffle;
    each slice then gets the counts of its own units, no more than it has bytes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "grams", TOGETHER, TEXTS):
            tokens, counts = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in part.column("grams").to_pylist()]), return_counts=True)
            one = [[part.column("fp")[0].as_py()], [part.column("fp").to_pylist()], [part.column("grams").to_pylist()], [tokens.astype(np.int64)], [counts]]
            kinds = pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], names=["slice", "fps", "grams", "tokens", "counts"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                held = np.array([(h["token"], h["held_by"]) for h in r["held"]], dtype=np.int64).reshape(-1, 2)
                held = held[np.argsort(held[:, 0])]
                for fp, packed in zip(r["fps"], r["grams"], strict=True):
                    units_of = np.frombuffer(packed, dtype=np.uint32).astype(np.int64)
                    at = np.minimum(np.searchsorted(held[:, 0], units_of), len(held) - 1)
                    common = at[held[at, 0] == units_of]
                    common = common[np.lexsort((held[common, 0], held[common, 1]))]
                    # units of one set alone come first, and match nothing
                    own, size = len(units_of) - len(common), len(units_of)
                    n = max(0, int((1 - SIMILARITY) * size + 1e-9) + 1 - own)
                    tokens = held[common[:n], 0]
                    yield pa.RecordBatch.from_arrays([pa.array([fp] * len(tokens), pa.binary()), pa.array(tokens), pa.array(own + 1 + np.arange(len(tokens))), pa.array(np.full(len(tokens), size))], names=["fp", "token", "place", "size"])

    packed = scratch.written(sets.repartitionByRange("family", "fp").sortWithinPartitions("family", "fp").select("fp", "grams").mapInArrow(
        pack, "slice binary, fps array<binary>, grams array<binary>, tokens array<long>, counts array<long>"), "near-slices")
    counted = packed.select("slice", F.inline(F.arrays_zip("tokens", "counts")).alias("token", "n"))
    held_by = scratch.written(counted.groupBy("token").agg(F.sum("n").alias("held_by")).where("held_by > 1"), "near-held")
    known = counted.join(held_by, "token").groupBy("slice").agg(F.collect_list(F.struct("token", "held_by")).alias("held"))
    return packed.select("slice", "fps", "grams").join(scratch.written(known, "near-known"), "slice").mapInArrow(place, "fp binary, token long, place long, size long")


def step(size) -> Column:
    """The step of GRAIN that a set's size falls into."""
    return F.floor(F.log(F.greatest(size, F.lit(1.0)).cast("double")) / float(np.log(GRAIN)))


def comparable(crowd: DataFrame) -> DataFrame:
    """Rows (fp, root, outside, family) of the texts that still need a comparison, for rows (bucket, fp, root, largest, size).

    Those are texts outside their bucket's largest class that meet a text of another class whose size permits
    SIMILARITY, and the texts that they meet.
    """
    reach = F.explode(F.sequence(step(F.ceil(SIMILARITY * F.col("size") - 1e-9)), step(F.floor(F.col("size") / SIMILARITY + 1e-9))))
    outside = F.col("root") != F.col("largest")
    met = crowd.groupBy("bucket", step(F.col("size")).alias("step")).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    asked = crowd.where(outside).select("bucket", "fp", "root", "largest", reach.alias("step")).join(met, ["bucket", "step"]).where("low <> root OR high <> root")
    asking = crowd.where(outside).select("bucket", "root", reach.alias("step")).groupBy("bucket", "step").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    meeting = crowd.withColumn("step", step(F.col("size"))).join(asking, ["bucket", "step"]).where("low <> root OR high <> root")
    both = asked.select("fp", "root", "largest", F.lit(True).alias("outside")).unionByName(meeting.select("fp", "root", "largest", F.lit(False).alias("outside")))
    return both.groupBy("fp").agg(F.max("outside").alias("outside"), F.first("root").alias("root"), F.min("largest").alias("family"))


def probes(found: DataFrame) -> DataFrame:
    """Pairs (p, q) of sets that may be similar, for rows (fp, token, place, size, root, outside): an outside one with one of another root.

    Units before a shared one are lost to the overlap, so a set of s units that shares its p-th can only be similar
    to sets of SIMILARITY * s up to (s - p + 1) * (1 + SIMILARITY) / SIMILARITY - s units. These ranges are part of
    the join, in steps of GRAIN: sets of a family that is less alike, whose first places are all their own, don't
    meet at all. Families whose members are within a step of SIMILARITY do meet, each pair some times.
    """
    least = F.ceil(SIMILARITY * F.col("size") - 1e-9)
    most = F.floor((F.col("size") - F.col("place") + 1) * (1 + SIMILARITY) / SIMILARITY - F.col("size") + 1e-9)
    ranged = found.withColumns({"least": least, "most": most}).where("most >= least").withColumn("own", step(F.col("size")))
    ranged = ranged.withColumn("other", F.explode(F.sequence(step(F.col("least")), step(F.col("most"))))).drop("least", "most")
    asked = ranged.where("outside").select("token", F.col("fp").alias("p"), F.col("root").alias("p_root"), F.col("place").alias("p_place"), F.col("size").alias("p_size"), F.col("own").alias("mine"), F.col("other").alias("yours"))
    asked_of = ranged.select("token", F.col("fp").alias("q"), "root", "place", "size", F.col("own").alias("yours"), F.col("other").alias("mine"))
    overlap = SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("p_size")) - 1e-9
    return asked.join(asked_of, ["token", "mine", "yours"]).where("p <> q AND root <> p_root").where(
        F.least(F.col("size") - F.col("place"), F.col("p_size") - F.col("p_place")) + 1 >= overlap).select("p", "q")


def links(signed: DataFrame, docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (node, root) that join the fingerprints of similar texts into classes.

    Each bucket's members are first compared with its pivot, the one that shares the most and largest buckets. If
    the others then lie in more than one class, those outside the largest class are compared with all texts of such
    buckets they may be similar to, which their prefixes tell without loss.
    """
    names = [f"b{i}" for i in range(BANDS)]
    nodes = scratch.written(signed.where("b0 IS NOT NULL").groupBy("fp").agg(F.min(F.struct("row_a", "row_b")).alias("rep"), *[F.first(n).alias(n) for n in names]), "near-nodes")
    rows = nodes.select("fp", F.explode(F.array(*names)).alias("bucket"))
    shared = scratch.written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    members = scratch.written(rows.join(shared, "bucket"), "near-members")
    n_members = members.count()
    wanted = members.groupBy("fp").agg(F.sum(F.floor(F.log2("n"))).alias("rank"))
    wanted = scratch.written(wanted.join(nodes.select("fp", "rep.*"), "fp"), "near-wanted", n_members)
    # the same plan at every size: texts are dealt out by their rows' hashes
    texts = with_rows(docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))).join(wanted.hint("merge"), ["row_a", "row_b"]).select("fp", "text")
    sets = scratch.written(unit_sets(texts).groupBy("fp").agg(F.min("grams").alias("grams")), "near-sets", n_members)

    def ordered(x: DataFrame) -> DataFrame:
        return x.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    pivots = members.join(wanted.select("fp", "rank"), "fp").groupBy("bucket").agg(F.max(F.struct("rank", "fp")).alias("x")).select("bucket", F.col("x.fp").alias("q"))
    led = scratch.written(members.select("bucket", F.col("fp").alias("p")).join(scratch.written(pivots, "near-pivots", n_members), "bucket").where("p <> q"), "near-led", n_members)
    edges = scratch.written(verified(scratch.written(ordered(led), "near-pairs", n_members), sets), "near-links", n_members)
    roots = smallest_reachable(edges, edges.count(), scratch)

    here = led.select("bucket", F.col("p").alias("fp")).join(roots, F.col("fp") == F.col("node"), "left").select("bucket", "fp", F.coalesce("root", "fp").alias("root"))
    here = scratch.written(here, "near-here", n_members)
    parts = scratch.written(here.groupBy("bucket", "root").agg(F.count("*").alias("n")), "near-parts", n_members)
    split = parts.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "root")).alias("x")).where("classes > 1").select("bucket", F.col("x.root").alias("largest"))
    crowd = scratch.written(here.join(scratch.written(split, "near-split", n_members), "bucket"), "near-crowd", n_members)
    if crowd.isEmpty():
        return roots
    n_crowd = crowd.count()
    everyone = scratch.written(comparable(crowd.join(sets.select("fp", (F.length("grams") / 4).alias("size")), "fp")), "near-everyone", n_crowd)
    found = scratch.written(prefixes(sets.join(everyone.select("fp", "family"), "fp"), scratch).join(everyone.drop("family"), "fp"), "near-prefixes")
    more = scratch.written(verified(scratch.written(ordered(probes(found)), "near-pairs"), sets), "near-links")
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return smallest_reachable(stars, stars.count(), scratch)


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row_a, row_b, root, class_id), one for each row of ``docs``: as below, with the hashes of the row and of its class."""
    signed = written(signatures(docs, key, text), "near-signatures")
    with Scratch(docs.sparkSession) as scratch:
        roots = links(signed, docs, scratch, key, text)
        least = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
        own = scratch.written(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "near-own")
        named = scratch.written(own.groupBy("root").agg(F.min("least").alias("class_id")), "near-named")
        classes = written(own.join(named, "root").select("fp", "root", "class_id"), "near-classes")
    return signed.select("doc_id", "row_a", "row_b", "fp").join(classes, "fp").select("doc_id", "row_a", "row_b", "root", "class_id")


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, class_id): the least id of the documents that copies and near copies link to each row.

    Linked are texts whose five-word shingles have a weighted Jaccard similarity of SIMILARITY or more, and texts of
    equal words. A null text counts as empty; texts without words are alike only if equal. Rows with a null id count
    for their class but name it only if all its ids are null. Repeated rows give repeated results; an empty table
    gives none. Further columns are left out.
    """
    return classified(docs, key, text).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, as it stands in ``docs``: that of least id, ids before null, once if it is repeated.

    Null texts are copies of empty ones. An empty table gives no rows; all columns stay, whatever their names, save row_a and row_b.
    """
    chosen = classified(docs, key, text).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_a", "row_b")).alias("x"))
    chosen = written(chosen.select("x.row_a", "x.row_b"), "near-chosen")
    # repeated rows lie side by side after the join, so they go without another shuffle
    return with_rows(docs, key, text).join(chosen.hint("merge"), ["row_a", "row_b"]).dropDuplicates(["row_a", "row_b"]).select(*docs.columns)
