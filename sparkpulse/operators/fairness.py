"""Fairness, explanation, privacy and governance measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bands, correlation, share
from ..sources.io import stored
from .ordered import numbered

FOUR_FIFTHS, GAP, SMALL_GROUP = 0.8, 0.1, 30


def _melt(df: DataFrame, attributes: Sequence[str], *kept: str) -> DataFrame:
    """Rows (attribute, value, kept...), one for each attribute; null values are left out."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    return df.select(*kept, F.inline(pairs)).where("value IS NOT NULL")


def demographic_parity(df: DataFrame, prediction: str, attributes: Sequence[str]) -> DataFrame:
    """Rate of each group, its distance from the overall rate, and the four-fifths test against the best group.

    Rates are rounded to four digits before they are compared.
    """
    overall = df.agg(F.avg(F.col(prediction).cast("double")).alias("overall"))
    by = _melt(df, attributes, prediction).groupBy("attribute", "value").agg(F.round(F.avg(F.col(prediction).cast("double")), 4).alias("rate"), F.count("*").alias("n"))
    w = Window.partitionBy("attribute")
    out = by.crossJoin(F.broadcast(overall))  # one row
    best, worst = F.max("rate").over(w), F.min("rate").over(w)
    return out.select("attribute", "value", "rate", "n", F.round(F.col("rate") - F.col("overall"), 4).alias("deviation"),
                      F.when(best > 0, F.col("rate") / best >= FOUR_FIFTHS).otherwise(True).alias("passes"), F.round(F.when(best > 0, worst / best).otherwise(1.0), 4).alias("disparate_impact"))


def equalized_odds(df: DataFrame, prediction: str, actual: str, attributes: Sequence[str]) -> DataFrame:
    """Rates of each group against real outcomes, and each attribute's largest gaps; 0 where a denominator is 0."""
    p, a = F.col(prediction) == 1, F.col(actual) == 1
    by = _melt(df, attributes, prediction, actual).groupBy("attribute", "value").agg(
        F.count("*").alias("n"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))
    out = by.select("attribute", "value", "n", *[F.round(share(x, y), 4).alias(name) for name, x, y in (
        ("tpr", F.col("tp"), F.col("tp") + F.col("fn")), ("fpr", F.col("fp"), F.col("fp") + F.col("tn")), ("tnr", F.col("tn"), F.col("fp") + F.col("tn")),
        ("fnr", F.col("fn"), F.col("tp") + F.col("fn")), ("accuracy", F.col("tp") + F.col("tn"), F.col("n")))])
    w = Window.partitionBy("attribute")
    gaps = {f"{c}_gap": F.round(F.max(c).over(w) - F.min(c).over(w), 4) for c in ("tpr", "fpr")}
    return out.withColumns(gaps).withColumn("passes", (F.col("tpr_gap") <= GAP) & (F.col("fpr_gap") <= GAP))


def intersectional(df: DataFrame, prediction: str, attributes: Sequence[str], least: int = SMALL_GROUP) -> DataFrame:
    """Rates of the groups of every pair of attributes in one pass; groups of fewer than ``least`` rows are left out."""
    pairs = list(combinations(attributes, 2))
    rows = F.array(*[F.struct(F.lit(f"{a} x {b}").alias("pair"), F.col(a).cast("string").alias("first"), F.col(b).cast("string").alias("second")) for a, b in pairs])
    overall = df.agg(F.avg(F.col(prediction).cast("double")).alias("overall"))
    by = df.select(prediction, F.inline(rows)).where("first IS NOT NULL AND second IS NOT NULL").groupBy("pair", "first", "second").agg(
        F.avg(F.col(prediction).cast("double")).alias("rate"), F.count("*").alias("n")).where(F.col("n") >= least)
    return by.crossJoin(F.broadcast(overall)).select("pair", "first", "second", F.round("rate", 4).alias("rate"), "n", F.round(F.col("rate") - F.col("overall"), 4).alias("deviation"),
                                                     F.round(share(F.col("rate"), F.col("overall")), 4).alias("relative_risk"))


def intersectional_gaps(groups: DataFrame) -> DataFrame:
    name = F.concat_ws(" & ", "first", "second")
    return groups.groupBy("pair").agg(F.round(F.max("rate") - F.min("rate"), 4).alias("max_gap"), F.max_by(name, F.struct("rate", name)).alias("best"), F.min_by(name, F.struct("rate", name)).alias("worst"))


def rate_pivot(df: DataFrame, a: str, b: str, prediction: str, values: Sequence[str], least: int = SMALL_GROUP) -> DataFrame:
    """Rates by a down and b across; small groups stay blank."""
    rates = df.groupBy(a, b).agg(F.round(F.avg(F.col(prediction).cast("double")), 4).alias("rate"), F.count("*").alias("n"))
    return rates.groupBy(a).pivot(b, list(values)).agg(F.max(F.when(F.col("n") >= least, F.col("rate"))))


def group_distribution(df: DataFrame, feature: str, attribute: str) -> DataFrame:
    return df.groupBy(attribute).agg(F.avg(feature).alias("mean"), F.stddev_samp(feature).alias("std"), F.median(feature).alias("median"), F.count(feature).alias("n"))


# Explanation of logistic models


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def linear(features: Sequence[str], weights: Mapping[str, float], bias: float) -> Column:
    z = F.lit(bias)
    for f in features:
        z = z + F.lit(float(weights[f])) * F.col(f)
    return z


def local_contributions(df: DataFrame, key: str, features: Sequence[str], weights: Mapping[str, float], bias: float, k: int = 5) -> DataFrame:
    """Rows (key, feature, contribution): the probability less the one with the feature at its mean; the k most and k least positive of each row."""
    means = df.agg(*[F.avg(f).alias(f"_{f}") for f in features])
    joined = df.crossJoin(F.broadcast(means))  # one row
    z = linear(features, weights, bias)
    parts = F.array(*[F.struct((sigmoid(z) - sigmoid(z - float(weights[f]) * (F.col(f) - F.col(f"_{f}")))).alias("contribution"), F.lit(f).alias("feature")) for f in features])
    ranked = joined.select(key, F.array_sort(parts).alias("p"))
    chosen = F.filter("p", lambda x, i: ((i < k) & (x.contribution < 0)) | ((i >= F.size("p") - k) & (x.contribution > 0)))
    return ranked.select(key, F.inline(chosen)).select(key, "feature", "contribution")


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], label: str, predict: Callable[[DataFrame], DataFrame], repeats: int = 5, seed: int = 42) -> DataFrame:
    """Rows (feature, importance, std): mean and deviation, over the repeats, of the accuracy lost when a feature's values change places.

    ``predict`` adds ``prediction`` to rows of the features, as a fitted model's ``transform`` does. In a repeat all rows,
    in the order of the key, take the values of all rows in the order of MD5 sums of seed, repeat and key: one permutation
    of the whole table, which depends on keys alone, neither on partitions nor on the cluster. Both orders are places over
    ranges, so no task sees the table, and each row meets one other a repeat. Keys should be unique.
    """
    base = stored(df.select(F.col(key).alias("_key"), F.col(label).alias("_label"), *features), "permutation-rows")
    places = numbered(base, [], ["_key"], "permutation-places")
    order = F.md5(F.concat_ws(":", F.lit(seed), "_rep", F.col("_key").cast("string")).cast("binary"))
    others = base.select("_key", F.struct(*features).alias("_other"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_rep")).withColumn("_order", order)
    others = numbered(others, ["_rep"], ["_order", "_key"], "permutation-others").select("_rep", "_pos", "_other")
    variants = F.array(*[F.struct(F.lit(f).alias("_feature"), *[F.col(f"_other.{g}" if g == f else g).alias(g) for g in features]) for f in features])
    tried = predict(places.join(others, "_pos").select("_label", "_rep", F.inline(variants)))
    right = F.avg((F.col("prediction") == F.col("_label")).cast("double"))
    whole = predict(base).agg(right.alias("_whole"))
    by = tried.groupBy("_feature", "_rep").agg(right.alias("_right")).crossJoin(F.broadcast(whole))  # one row
    lost = F.col("_whole") - F.col("_right")
    return by.groupBy(F.col("_feature").alias("feature")).agg(F.avg(lost).alias("importance"), F.stddev_pop(lost).alias("std"))


def counterfactuals(df: DataFrame, key: str, features: Sequence[str], weights: Mapping[str, float], bias: float, ranges: Mapping[str, tuple[float, float]], steps: int = 50) -> DataFrame:
    """For each row below even odds, greedy steps of a tenth of a feature's range until the decision turns, or none helps.

    Rows (key, flipped, n_steps, probability, changes), where changes is text "feature:from->to". Whole batches step
    together in numpy.
    """
    w = np.array([weights[f] for f in features], dtype=float)
    low, high = (np.array([ranges[f][i] for f in features], dtype=float) for i in (0, 1))
    width = (high - low) * 0.1
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x0 = frame[list(features)].to_numpy(dtype=float)
            x, n = x0.copy(), np.zeros(len(frame), dtype=int)
            z = x @ w + bias
            for _ in range(steps):
                open_rows = z <= 0
                moves = np.where(w > 0, np.minimum(width, high - x), -np.minimum(width, x - low))
                gain = np.where(np.abs(moves) > 1e-12, moves * w, 0)
                best = gain.argmax(axis=1)
                go = open_rows & (gain[np.arange(len(x)), best] > 1e-12)
                if not go.any():
                    break
                x[go, best[go]] += moves[go, best[go]]
                n[go] += 1
                z = x @ w + bias
            changes = [";".join(f"{f}:{a:.4g}->{b:.4g}" for f, a, b in zip(features, r0, r1, strict=True) if a != b) for r0, r1 in zip(x0, x, strict=True)]
            yield pd.DataFrame({key: frame[key], "flipped": z > 0, "n_steps": n, "probability": 1 / (1 + np.exp(-z)), "changes": changes})

    return df.where(linear(features, weights, bias) <= 0).select(key, *features).mapInPandas(run, f"{key} {kind}, flipped boolean, n_steps int, probability double, changes string")


def coefficient_importance(spark, weights: Mapping[str, float]) -> DataFrame:
    """Rows (feature, coefficient, abs_importance, rank), the largest first."""
    rows = sorted(weights.items(), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame([(f, float(c), abs(float(c)), i + 1) for i, (f, c) in enumerate(rows)], "feature string, coefficient double, abs_importance double, rank int")


def correlation_importance(df: DataFrame, features: Sequence[str], outcome: str) -> DataFrame:
    """Pearson correlation of each feature with the outcome, 0 for a constant one."""
    one = df.withColumn("_y", F.col(outcome).cast("double")).agg(*[correlation(f, "_y").alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features])))


def combined_importance(coefficients: DataFrame, correlations: DataFrame) -> DataFrame:
    """Blend of both measures, each over its largest value, at .6 and .4."""
    joined = coefficients.select("feature", "abs_importance").join(correlations.select("feature", F.abs("correlation").alias("c")), "feature")
    top = joined.agg(F.max("abs_importance").alias("ta"), F.max("c").alias("tc"))
    return joined.crossJoin(F.broadcast(top)).select("feature", (0.6 * share(F.col("abs_importance"), F.col("ta")) + 0.4 * share(F.col("c"), F.col("tc"))).alias("combined")).orderBy(F.desc("combined"), "feature")


# Privacy


def generalize_age(df: DataFrame, column: str, out: str = "age_band") -> DataFrame:
    """Bands of ten years closed on the left; the last, named 60-69, reaches to 100. The age itself goes."""
    return df.withColumn(out, bands(F.col(column), [20, 30, 40, 50, 60, 100], ["20-29", "30-39", "40-49", "50-59", "60-69"], right=False)).drop(column)


def drop_direct_identifiers(df: DataFrame, columns: Sequence[str] | None = None, marks: Sequence[str] = ("name", "email", "ssn", "phone")) -> DataFrame:
    """Without the named columns, or without those whose name holds a mark."""
    return df.drop(*(columns if columns is not None else [c for c in df.columns if any(m in c.lower() for m in marks)]))


def k_anonymity(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """One row: least group, groups, groups below k; rows with a null in a quasi-identifier don't count."""
    by = df.dropna(subset=list(quasi)).groupBy(*quasi).agg(F.count("*").alias("n"))
    out = by.agg(F.min("n").alias("k"), F.count("*").alias("groups"), F.count_if(F.col("n") < k).alias("groups_below"))
    return out.withColumn("meets", F.coalesce(F.col("k") >= k, F.lit(False)))


def suppress_rare(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """Rows whose group has k rows or more."""
    kept = df.dropna(subset=list(quasi)).groupBy(*quasi).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).drop("_n")
    return df.join(kept, list(quasi), "left_semi")


def anonymize(df: DataFrame, quasi: Sequence[str], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(table, report): without direct identifiers and rare groups; the report has k before and after, and rows lost."""
    safe = suppress_rare(drop_direct_identifiers(df), quasi, k)
    before, after = k_anonymity(df, quasi, k).select(F.col("k").alias("k_before")), k_anonymity(safe, quasi, k).select(F.col("k").alias("k_after"), "meets")
    counts = df.agg(F.count("*").alias("rows_before")).crossJoin(safe.agg(F.count("*").alias("rows_after")))  # one row each
    return safe, counts.crossJoin(before).crossJoin(after)


def mask_pii(df: DataFrame, column: str) -> DataFrame:
    """Replace e-mail addresses, US social security numbers and phone numbers, and count each kind."""
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[EMAIL]"), ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN]"), ("phone", r"\(?\b[0-9]{3}\)?[ .-]?[0-9]{3}[.-][0-9]{4}\b", "[PHONE]"))
    for name, pattern, mask in kinds:
        df = df.withColumn(f"n_{name}", F.regexp_count(column, F.lit(pattern))).withColumn(column, F.regexp_replace(column, pattern, mask))
    return df


# Governance


def governed_requests(df: DataFrame, allowed: Sequence[str], model: str = "model", tag: str = "tag", prompt: str = "prompt") -> DataFrame:
    """Add accepted, reason and a snippet of 200 characters."""
    reason = F.when(~F.coalesce(F.col(model).isin(*allowed), F.lit(False)), "model_not_allowed").when(F.trim(F.coalesce(F.col(tag), F.lit(""))) == "", "missing_tag")
    return df.withColumns({"reason": reason, "accepted": reason.isNull(), "snippet": F.substring(prompt, 1, 200)})


def fairness_scorecard(parity: DataFrame, odds: DataFrame) -> DataFrame:
    """One row of RED, AMBER or GREEN for parity and odds."""
    p = parity.agg(F.bool_and("passes").alias("ok"), F.bool_or(F.col("disparate_impact").between(0.8, 0.85)).alias("near"))
    o = odds.agg(F.bool_and("passes").alias("odds_ok"), F.max(F.greatest("tpr_gap", "fpr_gap")).alias("gap"))
    both = p.crossJoin(F.broadcast(o))  # one row each
    return both.select(F.when(~F.col("ok"), "RED").when(F.col("near"), "AMBER").otherwise("GREEN").alias("parity_status"),
                       F.when(F.col("odds_ok"), "GREEN").when(F.col("gap") <= 2 * GAP, "AMBER").otherwise("RED").alias("odds_status"))


SEVERITY = {"GREEN": 0, "AMBER": 1, "RED": 2}


def worst_status(df: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """The worst status of each pillar, or of all rows."""
    rank = F.when(F.col(status) == "RED", 2).when(F.col(status) == "AMBER", 1).otherwise(0)
    return df.groupBy(*by).agg(F.max(rank).alias("r"), F.count("*").alias("checks")).select(*by, F.when(F.col("r") == 2, "RED").when(F.col("r") == 1, "AMBER").otherwise("GREEN").alias("status"), "checks")


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count("*").alias("entries"), F.countDistinct("model").alias("models"), F.count_if(~F.col("passed")).alias("failures"))


def latest_for_model(audit: DataFrame, action: str | None = None) -> DataFrame:
    chosen = audit if action is None else audit.where(F.col("action") == action)
    rest = [c for c in audit.columns if c not in ("model", "ts")]
    return chosen.groupBy("model").agg(F.max(F.struct("ts", *rest)).alias("_r")).select("model", F.col("_r.ts").alias("ts"), *[F.col(f"_r.{c}").alias(c) for c in rest])
