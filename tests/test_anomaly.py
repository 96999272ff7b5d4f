"""Anomaly models over vectors: many components, odd rows, and numpy twins."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkpulse.operators import anomaly, ml


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("length", [64, 512])
def test_plans_do_not_grow_with_components(spark, length):
    x = np.random.default_rng(1).normal(size=(60, length))
    wide = table(spark, x).select("id", *[F.col("x")[i].alias(f"x{i}") for i in range(length)])
    names = wide.columns[1:]
    for df, features in ((table(spark, x), "x"), (wide, names)):
        spark.range(1).count()
        began = time.time()
        anomaly.vectors(df, features, F.col("id")).where("id > 3")._jdf.queryExecution().optimizedPlan()
        assert time.time() - began < (1 if features == "x" else 5)
    forest = anomaly.isolation_forest(table(spark, x), "id", "x", trees=8)
    assert anomaly.anomaly_scores(table(spark, x), forest).where("score > 0 AND score < 1").count() == 60


def test_a_forest_parts_outliers_in_few_of_64_components(spark):
    x = np.random.default_rng(8).normal(size=(600, 64))
    x[590:, 40:] += 9.0
    df = table(spark, x)
    forest = anomaly.isolation_forest(df, "id", "x", trees=60)
    assert len(forest["roots"]) == 60 and forest["length"] == 64
    got = anomaly.flag_anomalies(anomaly.anomaly_scores(df, forest)).toPandas().set_index("id")
    assert got.is_anomaly[590:].all() and got.is_anomaly[:590].mean() < 0.06 and got.risk.between(0, 1).all()


def test_scores_agree_with_a_walk_down_each_tree(spark):
    x = np.random.default_rng(3).normal(size=(200, 5))
    df = table(spark, x)
    f = anomaly.isolation_forest(df, "id", "x", trees=12, sample=64)
    got = anomaly.anomaly_scores(df, f).toPandas().set_index("id").score
    for i in range(0, 200, 17):
        paths = []
        for at in f["roots"]:
            while f["feature"][at] >= 0:
                at = f["lo"][at] if x[i, f["feature"][at]] < f["cut"][at] else f["hi"][at]
            paths.append(f["path"][at])
        assert abs(got[i] - 2.0 ** (-np.mean(paths) / anomaly.path_constant(64))) < 1e-12


def test_trees_are_the_same_in_every_layout(spark):
    df = table(spark, np.random.default_rng(4).normal(size=(3000, 6)))
    one, many = (anomaly.isolation_forest(df.repartition(n), "id", "x", trees=10, sample=32) for n in (1, 7))
    assert all(np.array_equal(one[k], many[k]) for k in ("feature", "cut", "lo", "hi", "path", "roots"))


ODD = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, []), (8, [3.0, 4.0]), (8, [3.0, 4.0]), (9, [0.0, 0.0])]


def test_odd_rows_get_no_score(spark):
    df = spark.createDataFrame(ODD, "id long, x array<double>").withColumn("_x", F.lit("taken"))
    forest = anomaly.isolation_forest(df, "id", "x", trees=5)
    model = anomaly.autoencoder(df, "id", "x", hidden=2, epochs=2, workers=2)
    for got in (anomaly.anomaly_scores(df, forest, "s"), anomaly.reconstruction_errors(df, model, "s")):
        assert sorted(r.id for r in got.where("s IS NOT NULL").collect()) == [1, 8, 8, 9] and got.count() == len(ODD)
    empty = df.where("id > 99")
    assert anomaly.anomaly_scores(df, anomaly.isolation_forest(empty, "id", "x", trees=5), "s").where("s IS NOT NULL").isEmpty()
    assert anomaly.reconstruction_errors(empty, anomaly.autoencoder(empty, "id", "x", epochs=2, workers=2)).count() == 0
    same = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(1.0)).alias("x"))
    assert anomaly.flag_anomalies(anomaly.anomaly_scores(same, anomaly.isolation_forest(same, "id", "x", trees=5))).where("is_anomaly = 1 OR risk <> 0").isEmpty()


def test_an_autoencoder_agrees_with_its_numpy_twin(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3)) @ rng.normal(size=(3, 12)) + rng.normal(size=(900, 12)) * 0.1
    x[880:] = rng.normal(size=(20, 12)) * 3
    df = table(spark, x).repartition(5)
    model = anomaly.autoencoder(df, "id", "x", hidden=3, epochs=12, rate=0.05, batch=64, workers=3)
    parts = anomaly.dealt(df, "x", "id", 3).withColumn("part", F.spark_partition_id()).toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w, history = anomaly.first_weights(12, 3, 42), []
    for epoch in range(12):
        told = [(anomaly.one_epoch(w, z[g["_key"].to_numpy()], 64, 0.05, (42, epoch, p)), len(g)) for p, g in parts.groupby("part")]
        w = [sum(t[0][k] * n for t, n in told) / 900 for k in range(4)]
        history.append(sum(t[1] for t, _ in told) / 900)
    assert all(np.allclose(a, b) for a, b in zip(model["w"], w, strict=True)) and np.allclose(model["history"], history)
    assert history[-1] < 0.5 * history[0]
    want = ((np.maximum(z @ w[0] + w[1], 0) @ w[2] + w[3] - z) ** 2).mean(axis=1)
    got = anomaly.flag_errors(anomaly.reconstruction_errors(df, model)).toPandas().set_index("id").sort_index()
    assert np.allclose(got.error, want) and got.is_anomaly[880:].mean() > 0.9
    assert (got.is_anomaly == (want > np.sort(want)[int(np.ceil(0.95 * 900)) - 1])).all()


def test_an_autoencoder_takes_one_job_to_fit(spark):
    df = table(spark, np.random.default_rng(6).normal(size=(300, 4)))
    spark.sparkContext.setJobGroup("fit", "fit")
    anomaly.autoencoder(df, "id", "x", hidden=2, epochs=25, batch=16, workers=2)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) < 10  # length, moments, and the fit: none a step or an epoch


def test_queries_see_every_component(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(400, 64))
    x[390:, 50:] += 12.0
    spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    flags = entry.queries()["isolation_forest"](spark, str(tmp_path)).toPandas().set_index("vec_id").is_anomaly
    errors = entry.queries()["autoencoder_errors"](spark, str(tmp_path)).toPandas().set_index("vec_id").error
    assert flags[390:].all() and errors[390:].mean() > 2 * errors[:390].mean()


def test_rows_are_scored_once_before_they_are_flagged(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def score(x):
        calls.add(len(x))
        return x[:, 0]

    monkeypatch.setattr(ml, "anomaly_scores", lambda df, forest: anomaly.scored(df, forest["features"], forest["length"], "score", score))
    df = spark.range(300).select("id", (F.col("id") % 2).alias("m"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    out = ml.anomaly_pipeline(df, "m", "ts", "id", ["x", "y"], {}, trees=5)
    assert out["scored"].count() == 300 and out["alerts"].count() > 0 and calls.value == 300
