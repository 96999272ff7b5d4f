"""Anomaly models over vectors: an isolation forest and an autoencoder.

A row's features are one array of doubles from end to end, whether they come as an array column or as columns of
their own, so that plans don't grow with the number of features. Rows of which a number is missing or not finite, and
arrays of another length than the longest, aren't learned from and get no score.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Features = Sequence[str] | str
#: Trees that one task grows; rows that are scored together.
TREES_A_TASK, ROWS = 8, 4096


def vector(features: Features) -> Column:
    """An array column by its name, or columns put together, as an array of doubles; null if any number is missing."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    return F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), x)


def vectors(df: DataFrame, features: Features, *kept: Column) -> DataFrame:
    """Rows (kept, _x) that have a whole vector."""
    return df.select(*kept, vector(features).alias("_x")).where("_x IS NOT NULL AND size(_x) > 0")


def scored(df: DataFrame, features: Features, length: int, name: str, score) -> DataFrame:
    """Add ``score`` of whole vectors, a function from a matrix to a number a row, null elsewhere."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            whole, out = x.notna().to_numpy(), np.full(len(x), np.nan)
            if whole.any():
                rows = np.stack(x[whole].to_list())
                out[whole] = np.concatenate([score(rows[k : k + ROWS]) for k in range(0, len(rows), ROWS)])
            yield pd.Series(out)

    x = vector(features)
    found = F.pandas_udf(run, "double")(F.when(F.size(x) == length, x))
    return df.withColumn(name, F.nanvl(found, F.lit(None).cast("double")))


# Isolation forest


def path_constant(n: int) -> float:
    """Mean path length of unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, seed: int) -> dict[str, list]:
    """One random tree as lists by node: feature (-1 at a leaf), cut, lo and hi (nodes below), and the leaf's path length."""
    rng, limit = np.random.default_rng(seed), int(np.ceil(np.log2(max(len(x), 2))))
    tree: dict[str, list] = {k: [] for k in ("feature", "cut", "lo", "hi", "path")}

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(tree["feature"])
        for k, v in (("feature", -1), ("cut", 0.0), ("lo", at), ("hi", at), ("path", depth + float(path_constant(len(rows))))):
            tree[k].append(v)
        spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if depth < limit and len(rows) > 1 else ()
        if len(spread):
            f = int(rng.choice(spread))
            low, high = x[rows, f].min(), x[rows, f].max()
            c = low + (high - low) * (1 - rng.random())  # above the least and up to the greatest, so that both sides have rows
            below = x[rows, f] < c
            tree["feature"][at], tree["cut"][at] = f, float(c)
            tree["lo"][at] = grow(rows[below], depth + 1)
            tree["hi"][at] = grow(rows[~below], depth + 1)
        return at

    grow(np.arange(len(x)), 0)
    return tree


def isolation_forest(df: DataFrame, key: str, features: Features, trees: int = 200, sample: int = 256, seed: int = 42) -> dict:
    """A forest of ``trees`` trees, each grown on ``sample`` rows chosen by hash; some trees to a task.

    Every row is offered to one tree by its hash, so one shuffle of at most trees x sample x 4 rows serves all. The
    forest, at most 2 x sample nodes a tree, comes to the driver.
    """
    n, length = vectors(df, features).agg(F.count("*"), F.coalesce(F.max(F.size("_x")), F.lit(0))).first()
    copies = int(np.ceil(min(trees, 4.0 * trees * sample / max(n, 1))))  # a small table serves several trees with one row
    keep = min(1.0, 2.0 * trees * sample / (max(n, 1) * copies))
    hashed = {"_tree": F.pmod(F.xxhash64("_key", F.lit(seed), "_r"), F.lit(trees)), "_h": F.xxhash64("_key", F.lit(seed + 1), "_r")}
    turn = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0)
    offered = df.withColumns({"_key": F.col(key), "_r": turn}).withColumns(hashed)
    offered = offered.where(F.pmod("_h", F.lit(1_000_000)) < int(keep * 1_000_000) + 1)
    # few rows are offered, and only of these vectors are made
    offered = vectors(offered, features, F.col("_key"), F.col("_tree"), F.col("_h")).where(F.size("_x") == length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, part in pdf.groupby("_tree"):
            part = part.sort_values(["_h", "_key"]).drop_duplicates("_key").head(sample)
            out.append({"tree": tree, "rows": len(part)} | grow_tree(np.stack(part["_x"].to_list()), int(tree) + seed))
        return pd.DataFrame(out)

    grown = offered.groupBy(F.floor(F.col("_tree") / TREES_A_TASK).alias("_task")).applyInPandas(
        run, "tree long, rows long, feature array<int>, cut array<double>, lo array<int>, hi array<int>, path array<double>")
    found = sorted(grown.collect(), key=lambda r: r.tree)
    roots = np.cumsum([0, *[len(r.feature) for r in found]])
    flat = {k: np.concatenate([np.zeros(0), *[np.asarray(r[k], float) for r in found]]) for k in ("feature", "cut", "path")}
    below = {k: np.concatenate([np.zeros(0, int), *[np.asarray(r[k], int) + a for r, a in zip(found, roots, strict=False)]]) for k in ("lo", "hi")}
    return flat | below | {
        "feature": flat["feature"].astype(int), "roots": roots[:-1], "features": features if isinstance(features, str) else list(features), "length": int(length),
        "scale": max(path_constant(max((r.rows for r in found), default=1)), 1e-9)}


def forest_scores(forest: dict, x: np.ndarray) -> np.ndarray:
    """Scores of rows, which go down all trees side by side."""
    at = np.tile(forest["roots"], (len(x), 1))
    row = np.arange(len(x))[:, None]
    while (inner := forest["feature"][at] >= 0).any():
        lower = x[row, forest["feature"][at]] < forest["cut"][at]  # a leaf leads to itself
        at = np.where(inner & lower, forest["lo"][at], forest["hi"][at])
    return 2.0 ** (-forest["path"][at].mean(axis=1) / forest["scale"]) if at.size else np.full(len(x), np.nan)


def anomaly_scores(df: DataFrame, forest: dict, name: str = "score") -> DataFrame:
    """Add the isolation score, 1 for rows that part at once; the forest goes to executors once."""
    sent = df.sparkSession.sparkContext.broadcast(forest)
    return scored(df, forest["features"], forest["length"], name, lambda x: forest_scores(sent.value, x))


def flag_anomalies(df: DataFrame, contamination: float = 0.05, name: str = "score") -> DataFrame:
    """Add ``risk``, the score stretched to [0, 1] over the batch, and ``is_anomaly`` above the contamination's quantile.

    ``df`` is read twice, so scores that cost much should be stored before.
    """
    limits = df.agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"), F.percentile_approx(name, 1 - contamination, F.lit(10_000)).alias("_cut"))
    out = df.crossJoin(F.broadcast(limits))  # one row
    risk = F.when(F.col("_hi") > F.col("_lo"), (F.col(name) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return out.withColumns({"risk": risk, "is_anomaly": (F.col(name) > F.col("_cut")).cast("int")}).drop("_lo", "_hi", "_cut")


# Autoencoder


def first_weights(length: int, hidden: int, seed: int) -> list[np.ndarray]:
    rng, scale = np.random.default_rng(seed), np.sqrt(2.0 / (length + hidden))
    return [rng.normal(0, scale, (length, hidden)), np.zeros(hidden), rng.normal(0, scale, (hidden, length)), np.zeros(length)]


def one_epoch(w: list[np.ndarray], x: np.ndarray, batch: int, rate: float, seed: Sequence[int]) -> tuple[list[np.ndarray], float]:
    """Weights after steps through all rows in a shuffled order, ``batch`` at a time, and the sum of the rows' mean squared errors on the way."""
    w, loss, order = [a.copy() for a in w], 0.0, np.random.default_rng(seed).permutation(len(x))
    for k in range(0, len(x), batch):
        rows = x[order[k : k + batch]]
        z = rows @ w[0] + w[1]
        h = np.maximum(z, 0)
        error = h @ w[2] + w[3] - rows
        loss += float((error**2).mean(axis=1).sum())
        out = 2 * error / len(rows)
        back = (out @ w[2].T) * (z > 0)
        for a, step in zip(w, (rows.T @ back, back.sum(axis=0), h.T @ out, out.sum(axis=0)), strict=True):
            a -= rate * step
    return w, loss


def averaged(parts: Sequence[tuple[list[np.ndarray], int]], otherwise: list[np.ndarray]) -> list[np.ndarray]:
    """Weights of several tasks, each counting by its rows."""
    total = sum(n for _, n in parts)
    return [sum(w[k] * (n / total) for w, n in parts if n) for k in range(len(otherwise))] if total else otherwise


def dealt(df: DataFrame, features: Features, key: str, workers: int) -> DataFrame:
    """Whole vectors by key, in as many parts as there are workers, each in the key's order."""
    return vectors(df, features, F.col(key).alias("_key")).repartition(workers, F.xxhash64("_key")).sortWithinPartitions("_key")


def autoencoder(df: DataFrame, key: str, features: Features, hidden: int = 8, epochs: int = 30, rate: float = 0.01, batch: int = 256, workers: int | None = None, seed: int = 42) -> dict:
    """One hidden layer, fitted by mini-batches in one Spark job.

    ``workers`` tasks (by default as many as cores, four at most) run together, each over its own rows: in every epoch a
    task steps through its rows in batches, then all exchange their weights and go on from the average, weighted by rows.
    A task holds its rows in memory, so a larger table wants more workers, each of which needs a core at once, without
    dynamic allocation; if one is lost, all begin again. The weights are the same for the same number of workers, however the table is laid out.
    """
    rows = vectors(df, features, F.col(key).alias("_key"))
    length = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    stats = rows.where(F.size("_x") == length).select(Summarizer.metrics("count", "mean", "std").summary(array_to_vector("_x")).alias("s")).first().s if length else None
    n = stats["count"] if stats else 0
    mean = stats["mean"].toArray() if n else np.zeros(length)
    std = stats["std"].toArray() * np.sqrt((n - 1) / n) if n else np.ones(length)
    std = np.where(std > 0, std, 1)
    workers = workers or min(4, df.sparkSession.sparkContext.defaultParallelism)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        parts = [np.stack(f["_x"].to_list()) for f in frames if len(f)]
        x = (np.concatenate(parts) - mean) / std if parts else np.zeros((0, length))
        w, history = first_weights(length, hidden, seed), []
        for epoch in range(epochs):
            mine, loss = one_epoch(w, x, batch, rate, (seed, epoch, context.partitionId()))
            told = np.concatenate([[len(x), loss], *[a.ravel() for a in mine]])
            heard = [np.frombuffer(base64.b64decode(m)) for m in context.allGather(base64.b64encode(told.tobytes()).decode())]
            w = averaged([(unpacked(m[2:], w), int(m[0])) for m in heard], w)
            history.append(sum(m[1] for m in heard) / max(sum(m[0] for m in heard), 1))
        if context.partitionId() == 0:
            yield pd.DataFrame({"w": [np.concatenate([a.ravel() for a in w])], "history": [history]})

    fitted = dealt(df.where(F.size(vector(features)) == length), features, key, workers).select("_x").mapInPandas(run, "w array<double>, history array<double>", barrier=True).collect()
    w, history = first_weights(length, hidden, seed), []
    if fitted:  # a table without rows may have no tasks
        w, history = unpacked(np.asarray(fitted[0].w), w), list(fitted[0].history)
    return {"w": w, "mean": mean, "std": std, "features": features if isinstance(features, str) else list(features), "length": length, "history": history}


def unpacked(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, ends[:-1]), like, strict=True)]


def reconstruction_errors(df: DataFrame, model: dict, name: str = "error") -> DataFrame:
    """Add the mean squared error of each row's reconstruction."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def error(rows: np.ndarray) -> np.ndarray:
        m = sent.value
        x = (rows - m["mean"]) / m["std"]
        return ((np.maximum(x @ m["w"][0] + m["w"][1], 0) @ m["w"][2] + m["w"][3] - x) ** 2).mean(axis=1)

    return scored(df, model["features"], model["length"], name, error)


def flag_errors(df: DataFrame, quantile: float = 0.95, name: str = "error") -> DataFrame:
    """Add ``threshold``, the quantile of the errors, and ``is_anomaly``, 1 above it; ``df`` is read twice."""
    cut = df.agg(F.percentile_approx(name, quantile, F.lit(10_000)).alias("threshold"))
    return df.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", (F.col(name) > F.col("threshold")).cast("int"))  # one row
