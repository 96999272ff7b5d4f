"""Model fitting and scoring on DataFrames: regressions, anomaly models, metrics and drift."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import score_band, share
from ..sources.io import removed, stored
from . import rolling
from .anomaly import anomaly_scores, autoencoder, flag_anomalies, flag_errors, isolation_forest, reconstruction_errors  # noqa: F401
from .quality import validate_and_clean


def hash_bucket(key: str, n: int, seed: int) -> Column:
    """A number from 0 to n - 1 by the MD5 sum of seed and key: the same on every run, in every layout and in other engines."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % n


def hash_split(df: DataFrame, key: str, test_share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key."""
    bucket = hash_bucket(key, 1000, seed)
    return df.where(bucket >= int(test_share * 1000)), df.where(bucket < int(test_share * 1000))


def linear_regression(df: DataFrame, key: str, features: Sequence[str], label: str) -> tuple[PipelineModel, DataFrame]:
    """A model of 80 % of the rows, and one row of MAE, RMSE and R2 on the rest."""
    train, test = hash_split(df, key, 0.2)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), LinearRegression(featuresCol="_x", labelCol=label)]).fit(train)
    scored = model.transform(test)
    rows = [tuple(float(RegressionEvaluator(labelCol=label, metricName=m).evaluate(scored)) for m in ("mae", "rmse", "r2"))]
    return model, df.sparkSession.createDataFrame(rows, "mae double, rmse double, r2 double")


def coefficient_table(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    rows = [*zip(features, map(float, last.coefficients), strict=True), ("intercept", float(last.intercept))]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, coefficient double")


def encoders(columns: Sequence[str]) -> StringIndexer:
    """Codes in the order of the alphabet; values not seen in fitting share one code of their own."""
    return StringIndexer(inputCols=list(columns), outputCols=[f"{c}_code" for c in columns], stringOrderType="alphabetAsc", handleInvalid="keep")


def logistic_pipeline(numeric: Sequence[str], categorical: Sequence[str], label: str, n_rows: int) -> Pipeline:
    """Codes, scaling and logistic regression with ridge weight 1 / n, the usual default of unit strength."""
    inputs = [*numeric, *[f"{c}_code" for c in categorical]]
    return Pipeline(stages=[*([encoders(categorical)] if categorical else []), VectorAssembler(inputCols=inputs, outputCol="_raw", handleInvalid="skip"),
                            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False)])


def probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability")[1])


def binary_metrics(df: DataFrame, prediction: Column, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy; 0 where a denominator is 0."""
    p, a = prediction == 1, label == 1
    out = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    c = {n: F.col(n) for n in ("tp", "fp", "fn", "tn")}
    out = out.withColumns({"precision": F.round(share(c["tp"], c["tp"] + c["fp"]), 4), "recall": F.round(share(c["tp"], c["tp"] + c["fn"]), 4), "accuracy": F.round(share(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["fn"] + c["tn"]), 4)})
    f1 = share(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])
    return out.withColumn("f1", F.round(f1, 4))


def detection_summary(df: DataFrame, prediction: Column, label: Column, error: str, by: Sequence[str] = ()) -> DataFrame:
    """How many rows are predicted and are in fact anomalies, and the mean error of each class; null for a class without rows."""
    return df.groupBy(*by).agg(
        F.count_if(prediction == 1).alias("predicted"), F.count_if(label == 1).alias("actual"),
        F.avg(F.when(label == 1, F.col(error))).alias("mean_error_anomaly"), F.avg(F.when(label != 1, F.col(error))).alias("mean_error_normal"))


def attrition_risk(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], left: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``risk`` (4 digits) and its band, and the rows (feature, coefficient) by size of a logistic model fitted on them all."""
    model = logistic_pipeline(numeric, categorical, left, df.count()).fit(df)
    scored = probability(model.transform(df)).withColumn("risk", F.bround("p", 4)).withColumn("band", score_band(F.col("risk")))
    return scored.select(*df.columns, "risk", "band"), coefficient_table(model, [*numeric, *[f"{c}_code" for c in categorical]]).orderBy(F.desc(F.abs("coefficient")), "feature")


def department_risk(scored: DataFrame, department: str, risk: str, active: Column, high: float = 0.7) -> DataFrame:
    """Each department's mean risk, people of high risk, and share of people who left."""
    return scored.groupBy(department).agg(
        F.bround(F.avg(risk), 4).alias("mean_risk"), F.count_if(F.col(risk) >= high).alias("high_risk"), F.bround(F.avg((~active).cast("double")), 4).alias("attrition_rate"))


def roc_points(scored: DataFrame, p: str, label: str, steps: int = 100) -> DataFrame:
    """Rows (threshold, tpr, fpr) over a grid of thresholds, from counts by bin."""
    bins = scored.groupBy(F.floor(F.col(p) * steps).cast("int").alias("bin")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    down, whole = Window.orderBy(F.desc("bin")), Window.partitionBy()
    return bins.select((F.col("bin") / steps).alias("threshold"), share(F.sum("pos").over(down), F.sum("pos").over(whole)).alias("tpr"), share(F.sum("neg").over(down), F.sum("neg").over(whole)).alias("fpr"))


def cross_validate_auc(df: DataFrame, key: str, pipeline: Pipeline, label: str, k: int = 5) -> DataFrame:
    """Rows (fold, auc, std) with folds by hash of the key; the row without a fold has the mean and the deviation over folds."""
    fold = hash_bucket(key, k, 7)
    found = []
    for i in range(k):
        model = pipeline.fit(df.where(fold != i))
        found.append(float(BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(df.where(fold == i)))))
    rows = [(i, auc, None) for i, auc in enumerate(found)] + [(None, float(np.mean(found)), float(np.std(found)))]
    return df.sparkSession.createDataFrame(rows, "fold int, auc double, std double")


# Drift


def ks_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Rows (feature, statistic, p_value, drifted): two-sample Kolmogorov-Smirnov tests of all columns at once.

    Values are counted, then dealt by range: each range's totals carry over to the next ones, so no task sees a
    whole column. An unknown column is an error.
    """
    if unknown := [c for c in columns if c not in reference.columns or c not in current.columns]:
        raise ValueError(f"unknown features: {unknown}")

    def melt(df: DataFrame, side: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("feature", "v").agg(F.count("*").alias("n")).select("feature", "v", F.when(F.lit(side == 0), F.col("n")).otherwise(0).alias("r"), F.when(F.lit(side == 1), F.col("n")).otherwise(0).alias("c"))

    counts = melt(reference, 0).unionByName(melt(current, 1)).groupBy("feature", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    dealt = stored(counts.repartitionByRange("feature", "v").withColumn("_part", F.spark_partition_id()), "drift-values")
    parts = dealt.groupBy("feature", "_part").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    before = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    offsets = parts.select("feature", "_part", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.sum("r").over(whole).alias("nr"), F.sum("c").over(whole).alias("nc"))
    inside = Window.partitionBy("feature", "_part").orderBy("v")
    walked = dealt.withColumns({"rr": F.sum("r").over(inside), "cc": F.sum("c").over(inside)}).join(F.broadcast(offsets), ["feature", "_part"])
    gap = F.abs((F.col("rr") + F.col("r0")) / F.col("nr") - (F.col("cc") + F.col("c0")) / F.col("nc"))
    by = walked.groupBy("feature").agg(F.max(gap).alias("d"), F.max("nr").alias("nr"), F.max("nc").alias("nc"))
    en = F.sqrt(F.col("nr") * F.col("nc") / (F.col("nr") + F.col("nc")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + 2.0 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("_l") * F.col("_l")))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("_l") < 0.2, 1.0).otherwise(series)))
    out = stored(by.withColumn("_l", lam).withColumn("p", p).select("feature", F.round("d", 4).alias("statistic"), F.round("p", 6).alias("p_value"), (F.col("p") < alpha).alias("drifted")), "drift")
    removed(dealt)
    return out


def drift_summary(drift: DataFrame, retrain_share: float = 0.3) -> DataFrame:
    out = drift.agg(F.count("*").alias("features"), F.count_if("drifted").alias("n_drifted"), F.max("statistic").alias("max_statistic"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))), ",").alias("names"))
    return out.withColumn("retrain", F.col("n_drifted") > retrain_share * F.col("features"))


# Alerts

ALERTS = ((0.9, "CRITICAL"), (0.7, "WARNING"), (0.5, "INFO"))


def severity(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for limit, name in reversed(ALERTS):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def alerts_with_cooldown(scored: DataFrame, machine: str, ts: str, score: str, minutes: int = 15) -> DataFrame:
    """Alerts in event time: within the cooldown after a machine's last alert only critical ones pass, and each resets it.

    Critical rows and those a cooldown or more after the row before always pass, and cut a machine's line into
    stretches. Stretches are dealt out and read in order, a batch at a time, with nothing carried on but the time of
    the last alert; so neither a hot machine nor a long stretch is held as a whole.
    """
    named = scored.select(machine, ts, score, severity(F.col(score)).alias("severity")).where("severity IS NOT NULL")
    line = Window.partitionBy(machine).orderBy(ts, score)
    wait = minutes * 60 * 1_000_000
    timed = named.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    gap = F.col("_t") - F.lag("_t").over(line)
    cut = timed.withColumn("_start", (F.col("severity") == "CRITICAL") | gap.isNull() | (gap >= wait))
    cut = cut.withColumn("_stretch", F.sum(F.col("_start").cast("int")).over(line))
    dealt = cut.repartition(machine, "_stretch").sortWithinPartitions(machine, "_stretch", "_t", score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0  # every stretch begins with a row that passes
        for batch in batches:
            t, starts = batch.column("_t").to_numpy(), np.flatnonzero(batch.column("_start").to_numpy(zero_copy_only=False))
            passes = np.zeros(len(t), bool)
            passes[starts] = True
            # the rest of the stretch before, then those that begin here
            for k, (at, end) in enumerate(zip([0, *starts], [*starts, len(t)], strict=True)):
                last = t[at] if k else last
                while (at := at + int(np.searchsorted(t[at:end], last + wait))) < end:
                    passes[at], last = True, t[at]
            yield batch.filter(pa.array(passes)).select([machine, ts, score, "severity"])

    return dealt.select(machine, ts, score, "severity", F.coalesce("_t", F.lit(0)).alias("_t"), "_start").mapInArrow(run, named.schema)


def anomaly_pipeline(readings: DataFrame, machine: str, ts: str, key: str, columns: Sequence[str], bounds: Mapping[str, tuple[float, float]], label: Column | None = None, trees: int = 200, minutes: int = 15) -> dict[str, DataFrame]:
    """From readings to alerts: checked rows get rolling features, a forest scores them, anomalies become alerts.

    Gives ``scored`` (key, machine, ts, score, risk, is_anomaly, actual), ``metrics`` where there is a label, and
    ``alerts`` of all anomalies, after each machine's cooldown.
    """
    rows = validate_and_clean(readings.withColumn("_label", (label if label is not None else F.lit(0)).cast("int")), [machine, ts, key], [machine, ts, *columns], bounds)
    wide = stored(rolling.features(rows, machine, [ts, key], columns), "anomaly-features")
    names = [c for c in wide.columns if c not in (*readings.columns, "_label")]
    scored = anomaly_scores(wide, isolation_forest(wide, key, [*columns, *names], trees)).select(key, machine, ts, "score", F.col("_label").alias("actual"))
    scores = stored(scored, "scores")  # the flags' limits read them first
    scored = stored(flag_anomalies(scores).select(key, machine, ts, "score", "risk", "is_anomaly", "actual"), "anomaly-scores")
    removed(wide)
    removed(scores)
    out = {"scored": scored, "alerts": alerts_with_cooldown(scored.where("is_anomaly = 1"), machine, ts, "risk", minutes)}
    return out | ({"metrics": binary_metrics(scored, F.col("is_anomaly"), F.col("actual"))} if label is not None else {})


def alert_summary(alerts: DataFrame, machine: str) -> DataFrame:
    """Alerts and machines by severity; each severity has a row, if of zeros."""
    kinds = F.array(*[F.lit(n) for _, n in ALERTS])
    every = alerts.sparkSession.range(1).select(F.explode(kinds).alias("severity"))
    by = alerts.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct(machine).alias("machines"))
    return every.join(by, "severity", "left").na.fill(0, ["n", "machines"])


def last_alerts(alerts: DataFrame, ts: str, n: int, ties: Sequence[str], severity_is: str | None = None) -> DataFrame:
    chosen = alerts if severity_is is None else alerts.where(F.col("severity") == severity_is)
    return chosen.orderBy(F.desc(ts), *ties).limit(n)


def prediction_log_summary(log: DataFrame, by: Sequence[str], anomaly: Column, score: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("samples"), F.count_if(anomaly).alias("anomalies"), F.round(F.avg(score), 6).alias("avg_score"))


# Which features a model can do without


def cross_validated_accuracy(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5) -> float:
    """Mean accuracy over folds by hash of the key, of logistic regression on numeric features."""
    fold, total = hash_bucket(key, k, 11), 0.0
    pipeline = logistic_pipeline(list(features), [], label, 100)
    for i in range(k):
        scored = pipeline.fit(df.where(fold != i)).transform(df.where(fold == i))
        total += scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0
    return total / k


def feature_necessity(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5, least_drop: float = 0.01) -> DataFrame:
    """Rows (feature, accuracy_without, drop, necessary): a feature is necessary if leaving it out costs more than ``least_drop``.

    The table is read once into the cluster's cache; models go one after the other, each fitted on all its rows.
    """
    held = df.select(key, label, *features).dropna().cache()
    whole = cross_validated_accuracy(held, key, features, label, k)
    rows = []
    for f in features:
        without = cross_validated_accuracy(held, key, [x for x in features if x != f], label, k) if len(features) > 1 else 0.0
        rows.append((f, float(without), float(whole - without), bool(whole - without > least_drop)))
    held.unpersist()
    return df.sparkSession.createDataFrame(rows, "feature string, accuracy_without double, drop double, necessary boolean")


def fold_sums(df: DataFrame, key: str, features: Sequence[str], label: str, k: int) -> np.ndarray:
    """For each fold by hash of the key, the sums of the products of all pairs among 1, the features and the label, in one pass.

    A task sums whole batches; a matrix a fold comes to the driver. Rows with a null are left out.
    """
    d = len(features) + 2
    rows = df.select(hash_bucket(key, k, 11).cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*features, label])]).dropna()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, d, d))
        for f in frames:
            x = np.c_[np.ones(len(f)), f.drop(columns="fold").to_numpy(dtype=float)]
            for i in range(k):
                mine = x[f["fold"].to_numpy() == i]
                total[i] += mine.T @ mine
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    out = np.zeros(k * d * d)
    for r in rows.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out.reshape(k, d, d)


def out_of_fold_r2(sums: np.ndarray, chosen: Sequence[int]) -> float:
    """The share of the label's variance that least squares on some features explain, each fold told by the others' fit."""
    at, whole = [0, *[c + 1 for c in chosen]], sums.sum(axis=0)
    error = 0.0
    for fold in sums:
        rest = whole - fold
        size = np.sqrt(np.maximum(np.diag(rest)[at], 1e-300))
        b = np.linalg.lstsq(rest[np.ix_(at, at)] / np.outer(size, size), rest[at, -1] / size, rcond=1e-12)[0] / size
        error += fold[-1, -1] - 2 * b @ fold[at, -1] + b @ fold[np.ix_(at, at)] @ b
    spread = whole[-1, -1] - whole[0, -1] ** 2 / whole[0, 0] if whole[0, 0] else 0.0
    return float(1.0 - error / spread) if spread > 0 else 0.0


def minimal_features(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5, least_drop: float = 0.01) -> DataFrame:
    """Backward elimination in one pass over the data: a row (step, removed, score, drop, features) for each step.

    Step 0 has all features. Each further step leaves out the one that costs least of the out-of-fold R2, the first of
    equals, as long as that is at most ``least_drop``; the last row's features are the minimal set. All sets are scored
    from the same sums by fold, so their number costs no further pass. A table without rows keeps all features.
    """
    sums, left = fold_sums(df, key, features, label, k), list(range(len(features)))
    score = out_of_fold_r2(sums, left)
    rows = [(0, None, score, 0.0, list(features))]
    while left and sums[:, 0, 0].sum() > 0:
        tried = [(out_of_fold_r2(sums, [x for x in left if x != f]), f) for f in left]
        best, out = max(tried, key=lambda x: x[0])
        if score - best > least_drop:
            break
        left.remove(out)
        rows.append((len(rows), features[out], best, score - best, [features[x] for x in left]))
        score = best
    return df.sparkSession.createDataFrame(rows, "step int, removed string, score double, drop double, features array<string>")
