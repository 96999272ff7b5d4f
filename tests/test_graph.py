"""Spectral clustering against dense eigenvectors, on planted groups."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpulse.operators import graph


def both_ways(spark, w):
    n = len(w)
    return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src long, dst long, weight double")


def planted(sizes, inside, outside, seed):
    rng = np.random.default_rng(seed)
    group = np.repeat(np.arange(len(sizes)), sizes)
    p = np.where(group[:, None] == group[None, :], inside, outside)
    w = np.triu(np.where(rng.random(p.shape) < p, rng.integers(1, 6, p.shape), 0), 1)
    return (w + w.T).astype(float), group


def dense(w, k):
    a = w + graph.FLOOR
    s = 1 / np.sqrt(a.sum(axis=1))
    values, vectors = np.linalg.eigh(s[:, None] * a * s[None, :])
    return 1 - values[::-1][:k], vectors[:, ::-1][:, :k] * s[:, None]


def test_embedding_agrees_with_dense_eigenvectors(spark):
    w, _ = planted([14, 11, 9], 0.7, 0.08, 3)
    w[4, 4] = 7.0
    found, values = graph.spectral_embedding(both_ways(spark, w), 3, tolerance=1e-7)
    want_values, want = dense(w, 3)
    assert np.allclose(values, want_values, atol=1e-8)
    got = np.stack([r.embedding for r in found.sort("node").collect()])
    for k in range(3):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-5


@pytest.mark.parametrize("partitions", [1, 7])
def test_planted_groups_are_found(spark, partitions):
    w, group = planted([30, 20, 10], 0.8, 0.05, 5)
    found = graph.communities(both_ways(spark, w).repartition(partitions), 3)
    got = {r.node: r.community for r in found.collect()}
    assert [got[i] for i in range(60)] == group.tolist()


def test_groups_without_links_between_them(spark):
    """Like groups have like numbers in any one vector of a walk, so that only several vectors tell them apart."""
    w = np.kron(np.eye(4), np.ones((5, 5))) - np.eye(20)
    got = {r.node: r.community for r in graph.communities(both_ways(spark, w), 4).collect()}
    assert [got[i] for i in range(20)] == np.repeat(range(4), 5).tolist()


def test_small_networks(spark):
    empty = spark.createDataFrame([], "src long, dst long, weight double")
    assert graph.communities(empty).count() == 0
    two = both_ways(spark, np.array([[0.0, 1.0], [1.0, 0.0]]))
    assert sorted(r.community for r in graph.communities(two, 3).collect()) == [0, 1]
    named = spark.createDataFrame([("a", "b", 2), ("b", "a", 2), ("c", "d", 2), ("d", "c", 2)], "src string, dst string, weight long")
    got = {r.node: r.community for r in graph.communities(named, 2).collect()}
    assert got["a"] == got["b"] == 0 and got["c"] == got["d"] == 1


def test_silo_report_of_a_given_membership(spark):
    w = np.kron(np.eye(2), np.ones((3, 3))) - np.eye(6)
    w[0, 3] = w[3, 0] = 1.0
    of = spark.range(6).select(F.col("id").alias("node"), F.floor(F.col("id") / 3).cast("int").alias("community"))
    got = {r.community: r for r in graph.silo_report(both_ways(spark, w), of).collect()}
    assert got[0].members == 3 and got[0].external_links == 1 and abs(got[0].internal_ratio - 6 / 7) < 1e-9 and got[0].is_silo


def paths_by_hand(w):
    """The share of ordered pairs whose least path, by length and then nodes, passes each node."""
    n, top, passed = len(w), w.max(), np.zeros(len(w))
    for source in range(n):
        done, heap = set(), [(0.0, (source,))]
        while heap:
            dist, path = heapq.heappop(heap)
            if path[-1] not in done:
                done.add(path[-1])
                passed[list(path[1:-1])] += 1
                for to in np.flatnonzero(w[path[-1]]).tolist():
                    if to not in done:
                        heapq.heappush(heap, (dist + top / w[path[-1], to], (*path, to)))
    return passed / max((n - 1) * (n - 2), 1)


@pytest.mark.parametrize("together", [1000, 7])
def test_betweenness_agrees_with_a_walk(spark, together):
    w, _ = planted([12, 8], 0.4, 0.1, 11)
    w[3, 3] = 9.0
    got = {r.node: r.betweenness for r in graph.betweenness(both_ways(spark, w), together=together).collect()}
    np.fill_diagonal(w, 0)
    want = paths_by_hand(w)
    assert len(got) == 20 and all(abs(got[k] - want[k]) < 1e-12 for k in range(20)) and want.max() > 0.1


def test_betweenness_of_ties_and_odd_networks(spark):
    ring = np.zeros((6, 6))
    for k in range(6):
        ring[k, (k + 1) % 6] = ring[(k + 1) % 6, k] = 2.0
    got = {r.node: r.betweenness for r in graph.betweenness(both_ways(spark, ring)).collect()}
    assert [round(got[k], 9) for k in range(6)] == np.round(paths_by_hand(ring), 9).tolist()
    lone = spark.createDataFrame([("a", "a", 1)], "src string, dst string, weight long")
    assert [(r.node, r.betweenness) for r in graph.betweenness(lone).collect()] == [("a", 0.0)]
    assert graph.betweenness(lone.where("1 = 0")).count() == 0


def test_sampled_betweenness_keeps_its_bound(spark):
    assert graph.sources_for(10**9, 0.01) < 150_000 and graph.sources_for(50, 0.01) == 50 and graph.sources_for(50, None) == 50
    star = np.zeros((120, 120))
    star[0, 1:] = star[1:, 0] = 1.0
    got = {r.node: r.betweenness for r in graph.betweenness(both_ways(spark, star), error=0.25).collect()}
    assert graph.sources_for(120, 0.25) < 120 and abs(got[0] - 1.0) < 0.25 and max(got[k] for k in range(1, 120)) == 0


def test_eigenvector_centrality_agrees_with_numpy(spark):
    w, _ = planted([10, 6], 0.5, 0.2, 2)
    got = np.array([r.eigenvector for r in graph.eigenvector_centrality(both_ways(spark, w)).sort("node").collect()])
    v = np.abs(np.linalg.eigh(w)[1][:, -1])
    assert np.allclose(got, v, atol=1e-4)
    none = both_ways(spark, np.array([[0.0, 1.0], [1.0, 0.0]])).withColumn("weight", F.lit(0.0))
    assert [r.eigenvector for r in graph.eigenvector_centrality(none).collect()] == [0.5, 0.5]
