"""Quality classifier by compression.

One zstandard dictionary is trained on good and one on bad labelled text. A text is compressed in small blocks
under each; the normalised difference of the two sizes, with how far the text compresses at all and how long it
is, goes through a logistic calibration fitted on other labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of a block: each is compressed alone, so the dictionary counts throughout a long text.
BLOCK = 512
LEVEL = 3
DICTIONARY_BYTES = 112_640
#: Bounds of what is learned from: labelled documents, and blocks of each label for its dictionary.
SAMPLE_DOCUMENTS = 24_000
SAMPLE_BLOCKS = 12_000
#: A score from here on predicts label 1.
CUT = 0.7


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


@lru_cache(maxsize=4)
def compressors(good: bytes, bad: bytes) -> tuple:
    """Compressors under a good and a bad dictionary; empty bytes stand for no dictionary."""
    made = []
    for raw in (good, bad):
        extra = {}
        if raw:
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            extra["dict_data"] = data
        made.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, **extra))
    return tuple(made)


def sizes(text: str, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """Normalised size difference, log of the compressed share, log of the length; zeros for an empty text."""
    parts = blocks(text)
    if not parts:
        return 0.0, 0.0, 0.0
    a, b = (sum(len(c.compress(p)) for p in parts) for c in compressors(good, bad))
    n = sum(map(len, parts))
    return (b - a) / (a + b), float(np.log(a / n)), float(np.log(n))


def design(f: np.ndarray) -> np.ndarray:
    """Inputs of the calibration: the difference with a kink at 0, the share with a kink at about a fifth, the length."""
    d, share, length = f.T
    return np.c_[10 * d, 10 * np.minimum(d, 0), share, np.minimum(share + 1.5, 0), length - 6, np.ones(len(f))]


def calibrate(f: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x, w = design(f), np.zeros(6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(6), x.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; for samples too few to train on, their plain content; b'' for none."""
    samples = [s for s in samples if len(s) >= 8]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Model:
    """Dictionaries and calibration; ``prior`` is the score where either label is missing."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None, prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def score(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        f = np.array([sizes(t or "", self.good, self.bad) for t in texts], dtype=float).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(design(f) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents whose remainder isn't 2, bounded by SAMPLE_DOCUMENTS and SAMPLE_BLOCKS.

    Both samples go by hash order, so they are the same on every run. Documents of remainder 0 and 1 feed the
    dictionaries, those of remainder 3 the calibration. Null ids, labels and texts are left out; a document
    labelled more than once takes the lower label.
    """
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder(F.col("doc_id")) != 2)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_DOCUMENTS)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    sample = written(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id"), "quality-sample")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                [(q, zlib.crc32(f"{d}:{i}".encode()), p) for d, t, q in zip(frame.doc_id, frame.text, frame.quality, strict=True) for i, p in enumerate(blocks(t))],
                columns=["quality", "rank", "block"])

    cuts = sample.where(remainder(F.col("doc_id")) != 3).mapInPandas(cut, "quality int, rank long, block binary")
    found = {q: [bytes(r.block) for r in cuts.where(F.col("quality") == q).orderBy("rank", "block").limit(SAMPLE_BLOCKS).collect()] for q in (1, 0)}
    good, bad = train_dictionary(found[1]), train_dictionary(found[0])

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            f = np.array([sizes(t, good, bad) for t in frame.text], dtype=float).reshape(-1, 3)
            yield pd.DataFrame({"a": f[:, 0], "b": f[:, 1], "c": f[:, 2], "quality": frame.quality, "doc_id": frame.doc_id.astype(str)})

    # SAMPLE_DOCUMENTS rows of three numbers at most
    seen = sample.where(remainder(F.col("doc_id")) == 3).mapInPandas(measure, "a double, b double, c double, quality int, doc_id string").orderBy("doc_id", "a", "b").toPandas()
    y = seen.quality.to_numpy(dtype=float)
    if len(set(y)) < 2 or not good or not bad:
        every = np.array([r[0] for r in known.select("quality").collect()], dtype=float)
        return Model(good, bad, None, float(every.mean()) if len(every) else 0.5)
    return Model(good, bad, calibrate(seen[["a", "b", "c"]].to_numpy(), y), float(y.mean()))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from CUT on) to every row; columns of these names are replaced.

    A null text counts as empty. Equal texts get equal scores; an empty table gives no rows.
    """

    def run(series: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(series)))

    out = docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
