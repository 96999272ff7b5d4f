"""Which features count: permutations that no layout changes, and minimal sets by sums of folds."""

import hashlib

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkpulse.operators import fairness, ml


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (2 * x[:, 0] - x[:, 2] + 0.1 * rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y int"), x, y


def test_permutations_are_the_same_in_every_layout(spark):
    df, x, y = table(spark)
    told = lambda rows: rows.withColumn("prediction", (2 * F.col("a") - F.col("c") > 0).cast("int"))
    got = [{r.feature: (round(r.importance, 9), round(r.std, 9)) for r in fairness.permutation_importance(df.repartition(n), "id", ["a", "b", "c"], "y", told, 3).collect()} for n in (1, 4, 64)]
    assert got[0] == got[1] == got[2]
    whole, lost = np.mean((2 * x[:, 0] - x[:, 2] > 0) == y), {f: [] for f in "abc"}
    for r in range(3):
        order = sorted(range(len(x)), key=lambda i, r=r: hashlib.md5(f"42:{r}:{i}".encode()).hexdigest())
        for k, f in enumerate("abc"):
            z = x.copy()
            z[:, k] = x[order, k]
            lost[f].append(whole - np.mean((2 * z[:, 0] - z[:, 2] > 0) == y))
    assert got[0] == {f: (round(float(np.mean(v)), 9), round(float(np.std(v)), 9)) for f, v in lost.items()}
    assert got[0]["b"] == (0.0, 0.0) and got[0]["a"][0] > got[0]["c"][0] > 0


def test_a_fitted_model_is_scored_by_its_own_predictions(spark):
    df = table(spark)[0].withColumn("y", F.col("y").cast("double"))
    model = ml.logistic_pipeline(["a", "b", "c", "d"], [], "y", 600).fit(df)
    got = {r.feature: r.importance for r in fairness.permutation_importance(df, "id", ["a", "b", "c", "d"], "y", model.transform, 2).collect()}
    assert got["a"] > 0.2 and got["c"] > 0.05 and abs(got["b"]) < 0.02 and abs(got["d"]) < 0.02
    assert isinstance(model.stages[0], VectorAssembler)


def test_irrelevant_features_go(spark):
    df, x, y = table(spark)
    rows = ml.minimal_features(df.repartition(5), "id", ["b", "a", "d", "c"], "y").collect()
    assert [r.step for r in rows] == [0, 1, 2] and {r.removed for r in rows[1:]} == {"b", "d"} and rows[-1].features == ["a", "c"]
    assert all(r.drop <= 0.01 for r in rows) and abs(rows[0].score - sum(r.drop for r in rows) - rows[-1].score) < 1e-9
    folds = np.array([int(hashlib.md5(f"11:{i}".encode()).hexdigest()[:8], 16) % 5 for i in range(len(x))])
    error = 0.0
    for f in range(5):
        learn, rest = np.c_[np.ones((folds != f).sum()), x[folds != f]], np.c_[np.ones((folds == f).sum()), x[folds == f]]
        b = np.linalg.lstsq(learn, y[folds != f], rcond=None)[0]
        error += ((y[folds == f] - rest @ b) ** 2).sum()
    assert abs(rows[0].score - (1 - error / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_minimal_sets_of_odd_tables(spark):
    df = table(spark)[0]
    copies = df.withColumns({"e": F.col("a"), "f": F.lit(1.0), "b": F.when(F.col("id") > 5, F.col("b"))})
    last = ml.minimal_features(copies, "id", ["a", "b", "c", "e", "f"], "y").collect()[-1]
    assert last.features in (["a", "c"], ["c", "e"])
    assert [r.features for r in ml.minimal_features(df.where("id < 0"), "id", ["a", "b"], "y").collect()] == [["a", "b"]]


def test_cross_validation_ends_with_mean_and_deviation(spark):
    df = table(spark)[0].withColumn("y", F.col("y").cast("double"))
    rows = ml.cross_validate_auc(df, "id", ml.logistic_pipeline(["a", "b"], [], "y", 600), "y", 3).collect()
    aucs = [r.auc for r in rows if r.fold is not None]
    assert len(aucs) == 3 and rows[-1].fold is None and abs(rows[-1].auc - np.mean(aucs)) < 1e-12 and abs(rows[-1].std - np.std(aucs)) < 1e-12
