"""Networks of who works with whom: weights, centrality, roles and communities, on edge lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import Temporary, removed, stored


def pair_stats(df: DataFrame, src: str, dst: str, duration: str, kind: str | None = None, least: int = 1) -> DataFrame:
    """Count, sum and mean for each directed pair, with a map of counts by kind; the heaviest first."""
    by = df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("n"), F.sum(duration).alias("total"), F.avg(duration).alias("mean")).where(F.col("n") >= least)
    if kind:
        kinds = df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"), kind).count().groupBy("src", "dst").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "count")))).alias("kinds"))
        by = by.join(kinds, ["src", "dst"])
    return by.orderBy(F.desc("n"), "src", "dst")


def build_network(df: DataFrame, src: str, dst: str, least: int = 3) -> DataFrame:
    """Edges (src, dst, weight) in both directions: counts of at least ``least``, summed over directions; a loop stays once."""
    counts = df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("c")).where(F.col("c") >= least)
    both = counts.unionByName(counts.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c"))
    return both.groupBy("src", "dst").agg(F.sum("c").alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def node_metrics(edges: DataFrame) -> DataFrame:
    """Degree, strength, and the share of it that a node keeps to itself."""
    loop = F.col("src") == F.col("dst")
    by = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.when(~loop, 1)).alias("degree"), F.sum("weight").alias("total"), F.coalesce(F.sum(F.when(loop, F.col("weight"))), F.lit(0)).alias("internal"))
    return by.withColumns({"strength": F.col("total") - F.col("internal"), "internal_ratio": F.when(F.col("total") > 0, F.col("internal") / F.col("total")).otherwise(0.0)})


def network_metrics(edges: DataFrame, raw: DataFrame, crosses: str) -> DataFrame:
    """One row: nodes, ordered pairs, density, means, and the share of raw rows that cross groups."""
    e = edges.where("src <> dst").agg(F.count("*").alias("edges"), F.avg("weight").alias("mean_weight"))
    n = nodes_of(edges).agg(F.count("*").alias("nodes"))
    x = raw.agg(F.avg(F.col(crosses).cast("double")).alias("cross_share"))
    out = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(x))  # one row each
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return out.withColumns({"density": F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0), "mean_degree": F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0)})


def degree_centrality(edges: DataFrame) -> DataFrame:
    n = nodes_of(edges).agg(F.count("*").alias("n"))
    by = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("d")).crossJoin(F.broadcast(n))
    return by.select("node", F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1)).otherwise(0.0).alias("degree_centrality"))


def eigenvector_centrality(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration from an even start, each round a join and a sum; a zero vector gives even values.

    The scores of a round are stored as a table, which cuts the lineage, and go when the next round has its own.
    """
    with Temporary() as kept:
        edges = kept.stored(edges.select("src", "dst", F.col("weight").cast("double")), "eigenvector-edges")
        nodes = kept.stored(nodes_of(edges), "eigenvector-nodes")
        n = max(nodes.count(), 1)
        scores, table = nodes.withColumn("x", F.lit(n**-0.5)), None
        for _ in range(rounds):
            raw = edges.join(scores, F.col("dst") == F.col("node")).groupBy("src").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
            after = stored(scores.join(raw, F.col("node") == F.col("src"), "left").select("node", "x", F.coalesce("y", F.lit(0.0)).alias("y")), "eigenvector")
            if table is not None:
                removed(table)
            table = after
            # both vectors have length 1, so their distance follows from one product
            yy, xy = after.agg(F.sum(F.col("y") * F.col("y")), F.sum(F.col("x") * F.col("y"))).first()
            if not yy:
                return stored(nodes.select("node", F.lit(1.0 / n).alias("eigenvector")), "eigenvector")
            norm = yy**0.5
            scores = after.select("node", (F.col("y") / norm).alias("x"))
            if max(0.0, 2 - 2 * xy / norm) ** 0.5 < tolerance:
                break
        out = stored(scores.withColumnRenamed("x", "eigenvector"), "eigenvector")
        if table is not None:
            removed(table)
        return out


#: Sources whose paths are followed together.
SOURCES = 1_000


def shortest_paths(steps: DataFrame, sources: DataFrame, temporary: Temporary) -> DataFrame:
    """Rows (source, node, dist, path): one shortest path from each source to each node that it reaches, itself included.

    ``steps`` are (at, to, length), lengths above 0. In every round the paths that got better in the one before grow by a
    step, a join on their last nodes, and each source and node keep the best path, a minimum over length and then the
    sequence of nodes. Rounds end when none gets better: as many as the longest of the paths has steps, and one.
    """
    at = sources.select(F.col("node").alias("source"), "node")
    best = temporary.stored(at.select("source", "node", F.struct(F.lit(0.0).alias("dist"), F.array("node").alias("path")).alias("best"), F.lit(True).alias("new")), "paths")
    while True:
        grown = best.where("new").join(steps, F.col("node") == F.col("at")).where(~F.array_contains("best.path", F.col("to"))).select(
            "source", F.col("to").alias("node"), F.struct((F.col("best.dist") + F.col("length")).alias("dist"), F.concat("best.path", F.array("to")).alias("path")).alias("best"), F.lit(False).alias("old"))
        both = best.select("source", "node", "best", F.lit(True).alias("old")).unionByName(grown)
        merged = both.groupBy("source", "node").agg(F.min("best").alias("best"), F.min(F.when(F.col("old"), F.col("best"))).alias("before"))
        best = temporary.stored(merged.select("source", "node", "best", (~F.col("best").eqNullSafe(F.col("before"))).alias("new")), "paths")
        if best.where("new").isEmpty():
            return best.select("source", "node", "best.*")


def sources_for(n: int, error: float | None, failure: float = 0.05) -> int:
    """How many of ``n`` sources hold every node's betweenness within ``error``, but for the given probability; all if no error is allowed.

    By Hoeffding's inequality for the share of a source's paths that pass a node, over all nodes.
    """
    return n if not error or not n else min(n, int(np.ceil(np.log(2 * n / failure) / (2 * error * error))))


def betweenness(edges: DataFrame, error: float | None = None, failure: float = 0.05, together: int = SOURCES) -> DataFrame:
    """Share of ordered pairs whose one shortest path passes a node; distance is the largest weight over the weight.

    Of equal paths the one with the least sequence of nodes from the source counts. Sources go in batches of about
    ``together``, so that no more than their paths to all nodes are held, as tables; neither edges nor nodes reach the
    driver or meet in a task. With an ``error``, a sample of sources by hash stands for all, and every share is within the
    error of the true one but for the probability ``failure``.
    """
    with Temporary() as temporary:
        rows = temporary.stored(edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double")), "betweenness-edges")
        top = rows.agg(F.max("weight")).first()[0] or 1.0
        steps = rows.select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.lit(top) / F.col("weight")).alias("length"))
        nodes = temporary.stored(nodes_of(edges), "betweenness-nodes")
        n = nodes.count()
        m = sources_for(n, error, failure)
        chosen = nodes if m == n else nodes.orderBy(F.xxhash64("node"), "node").limit(m)
        batches = -(-m // together)
        chosen = temporary.stored(chosen.withColumn("batch", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(batches, 1)))), "betweenness-sources")
        passed = nodes.select("node", F.lit(0).cast("long").alias("c"))
        for k in range(batches):
            with Temporary() as paths:
                found = shortest_paths(steps, chosen.where(F.col("batch") == k), paths)
                inner = found.where(F.size("path") > 2).select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("node"))
                passed = passed.unionByName(temporary.stored(inner.groupBy("node").agg(F.count("*").alias("c")), "betweenness-counts"))
        scale = float(max((n - 1) * (n - 2), 1)) * m / max(n, 1)
        return stored(passed.groupBy("node").agg((F.sum("c") / (scale or 1.0)).alias("betweenness")), "betweenness")


def influence_profile(degree: DataFrame, between: DataFrame, eigen: DataFrame) -> DataFrame:
    """Weighted influence (.3, .4, .3) and a role.

    Above the median of betweenness a node below the median degree is a bottleneck and one above it a connector;
    of the others those above the upper quartile of degree are hubs, and all else is peripheral.
    """
    joined = degree.join(between, "node").join(eigen, "node")
    cuts = joined.agg(F.percentile("degree_centrality", F.lit(0.75)).alias("d75"), F.median("degree_centrality").alias("d50"), F.median("betweenness").alias("b50"))
    between_many = F.col("betweenness") > F.col("b50")
    role = (
        F.when(between_many & (F.col("degree_centrality") < F.col("d50")), "bottleneck")
        .when(between_many & (F.col("degree_centrality") > F.col("d50")), "connector")
        .when(F.col("degree_centrality") > F.col("d75"), "hub").otherwise("peripheral"))
    score = 0.3 * F.col("degree_centrality") + 0.4 * F.col("betweenness") + 0.3 * F.col("eigenvector")
    return joined.crossJoin(F.broadcast(cuts)).select(*joined.columns, score.alias("influence"), role.alias("role"))  # one row of cuts


def connectors(profile: DataFrame, n: int = 5) -> DataFrame:
    return profile.orderBy(F.desc("betweenness"), "node").limit(n)


def bottlenecks(profile: DataFrame) -> DataFrame:
    return profile.where("role = 'bottleneck'")


#: Added to the weight of every pair of nodes, neighbours or not, so that no node stands alone.
FLOOR = 1e-6


def _weights(edges: DataFrame) -> DataFrame:
    """Edges in both directions with a double weight, loops once, repeated pairs summed."""
    return edges.groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("weight"))


def _mapped(df: DataFrame, name: str, matrix: np.ndarray) -> DataFrame:
    """``df`` with an array column's row vectors times a small matrix."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(np.stack(x.to_list()) @ matrix) if len(x) else [], dtype=object)

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(name))


def _products(line: DataFrame, size: int) -> np.ndarray:
    """Sums over all nodes of the products of all pairs of their numbers: basis, block, and scale."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_list())
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(size * size), "p": total.ravel()})

    sums = line.select(F.concat("v", "y", F.array("s")).alias("x")).mapInPandas(run, "i int, p double").groupBy("i").agg(F.sum("p").alias("p"))
    out = np.zeros(size * size)
    for r in sums.collect():
        out[r.i] = r.p
    return out.reshape(size, size)


def spectral_embedding(edges: DataFrame, k: int, rounds: int = 40, tolerance: float = 1e-4, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Rows (node, embedding), each node's numbers in the first ``k`` vectors of the normalised Laplacian, and their eigenvalues.

    The Laplacian is that of the weights and a small one for every pair. Its vectors come from a block Krylov space: each
    round multiplies the last ``k`` basis vectors by the weights, a join and a sum over edges, and makes the product
    orthogonal to all before; small matrices of sums over nodes are all that reaches the driver. Rounds end once the first
    ``k`` vectors leave a residual below ``tolerance``, or the space has no more dimensions. A node holds k numbers a
    round. Starting numbers are hashes of the nodes, so the result doesn't depend on the layout. Vectors' signs are such
    that the number of largest size, or of the first of such nodes, is positive.
    """
    edges = stored(_weights(edges), "spectral-edges")
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d"))
    nodes = nodes_of(edges).join(degree, "node", "left")
    n = nodes.count()
    k = min(k, n)
    if not n:
        return nodes.select("node", F.array().cast("array<double>").alias("embedding")), []
    noise = F.array(*[(F.pmod(F.xxhash64("node", F.lit(seed + i)), F.lit(1_000_003)) / 1_000_003 - 0.5) for i in range(k)])
    line = stored(nodes.select("node", (1 / F.sqrt(F.coalesce("d", F.lit(0.0)) + FLOOR * n)).alias("s"), F.array().cast("array<double>").alias("v"), noise.alias("y")), "spectral-nodes")
    width, block, projected, inner, found = 0, k, np.zeros((0, 0)), None, None
    for _ in range(rounds):
        # the new block, free of the basis; twice, since once leaves what rounding has put in
        if width:
            line = _without(line, inner)
        m = _products(line, width + block + 1)
        again, gram, scaled = m[:width, width:-1], m[width:-1, width:-1], m[-1, width:-1]
        if width:
            line, gram, scaled = _without(line, again), gram - again.T @ again, scaled - m[-1, :width] @ again
        size, direction = np.linalg.eigh(gram)
        good = size > 1e-10 * max(1.0, size.max(initial=0.0))
        if not good.any():
            break
        unit = direction[:, good] / np.sqrt(size[good])
        line, total, block = _mapped(line, "y", unit).withColumn("v", F.concat("v", "y")), scaled @ unit, int(good.sum())
        width += block
        # the weights times the new block
        z = line.select("node", F.transform("y", lambda x: x * F.col("s")).alias("z"))
        sums = edges.join(z, F.col("dst") == F.col("node")).groupBy("src").agg(*[F.sum(F.col("weight") * F.get("z", F.lit(i))).alias(f"p{i}") for i in range(block)])
        times = F.array(*[F.col("s") * (F.coalesce(f"p{i}", F.lit(0.0)) + FLOOR * float(total[i])) for i in range(block)])
        line = stored(line.join(sums, F.col("node") == F.col("src"), "left").select("node", "s", "v", times.alias("y")), "spectral-nodes")
        m = _products(line, width + block + 1)
        inner = m[:width, width:-1]
        old = width - block
        projected = np.block([[projected, inner[:old]], [inner[:old].T, (inner[old:] + inner[old:].T) / 2]])
        values, vectors = np.linalg.eigh(projected)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        rest, ends = m[width:-1, width:-1] - inner.T @ inner, vectors[old:]
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", ends, rest, ends), 0))
        found = line.select("node", "s", "v"), values, vectors
        if width >= n or residual.max() < tolerance:
            break
    base, values, vectors = found
    out = stored(_mapped(base, "v", vectors).select("node", F.transform("v", lambda x: x * F.col("s")).alias("embedding")), "spectral-embedding")
    far = out.agg(*[F.max_by(F.get("embedding", F.lit(i)), F.struct(F.round(F.abs(F.get("embedding", F.lit(i))), 9), F.xxhash64("node"))) for i in range(len(values))]).first()
    return _mapped(out, "embedding", np.diag([1.0 if x >= 0 else -1.0 for x in far])), [1 - float(x) for x in values]


def _without(line: DataFrame, shares: np.ndarray) -> DataFrame:
    """``line`` with its block y less the basis v times the block's shares of it."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, y in batches:
            yield pd.Series(list(np.stack(y.to_list()) - np.stack(v.to_list()) @ shares) if len(v) else [], dtype=object)

    return line.withColumn("y", F.pandas_udf(run, "array<double>")("v", "y"))


def communities(edges: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Rows (node, community) by spectral clustering: k-means over the first ``k`` vectors of the normalised Laplacian.

    Communities are numbered by their first nodes. A network of at most ``k`` nodes has one to a node.
    """
    embedding, _ = spectral_embedding(edges, k, seed=seed)
    # k-means starts from rows far from each other; one part makes its choice the same in every layout of small networks
    points = embedding.select("node", array_to_vector("embedding").alias("x")).sort("node")
    if points.isEmpty():
        return points.select("node", F.lit(0).alias("community"))
    model = KMeans(k=min(k, max(points.limit(k).count(), 2)), featuresCol="x", predictionCol="_c", seed=seed, initSteps=5, maxIter=50).fit(points)
    found = model.transform(points).select("node", "_c")
    order = found.groupBy("_c").agg(F.min("node").alias("_least"))
    names = order.select(F.col("_c").alias("_of"), (F.row_number().over(Window.orderBy("_least")) - 1).alias("community"))  # k rows
    return found.join(F.broadcast(names), F.col("_c") == F.col("_of")).select("node", "community")


def silo_report(edges: DataFrame, membership: DataFrame, limit: float = 0.7) -> DataFrame:
    """Internal and external weight of each community, its share kept inside, and whether that makes it a silo."""
    m = membership
    e = edges.where("src <> dst").join(m.withColumnsRenamed({"node": "src", "community": "cs"}), "src").join(m.withColumnsRenamed({"node": "dst", "community": "cd"}), "dst")
    inside = F.col("cs") == F.col("cd")
    by = e.groupBy(F.col("cs").alias("community")).agg(F.avg(F.when(inside, F.col("weight"))).alias("mean_internal"), F.count(F.when(~inside, 1)).alias("external_links"),
                                                       F.coalesce(F.sum(F.when(inside, F.col("weight"))), F.lit(0)).alias("_in"), F.sum("weight").alias("_all"))
    sizes = m.groupBy("community").agg(F.count("*").alias("members"))
    out = sizes.join(by, "community", "left").withColumn("internal_ratio", F.coalesce(F.col("_in") / F.col("_all"), F.lit(0.0)))
    silo = F.col("internal_ratio") >= limit
    return out.select("community", "members", F.coalesce("mean_internal", F.lit(0.0)).alias("mean_internal"), F.coalesce("external_links", F.lit(0)).alias("external_links"), "internal_ratio", silo.alias("is_silo"),
                      F.when(silo, "start work across groups").otherwise("keep links alive").alias("recommendation"))
