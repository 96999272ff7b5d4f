"""Operators on small frames with results worked out by hand or in numpy."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpulse.functions.columns import once, score_band
from sparkpulse.operators import fairness, forecast, graph, joins, medallion, ml, quality, rolling, text
from sparkpulse.sources import io


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_nearest_takes_far_orders_and_lowest_id_on_ties(spark):
    orders = spark.createDataFrame([("a", 0.0, 0.0), ("b", 80.0, 80.0)], "order_id string, lat double, lon double")
    drivers = spark.createDataFrame([(2, 0.0, 1.0), (1, 1.0, 0.0)], "driver_id long, lat double, lon double")
    assert [r[:2] for r in rows(joins.nearest_available(orders, drivers))] == [("a", 1), ("b", 1)]
    assert rows(joins.nearest_available(orders, drivers.limit(0))) == []


def test_attribution_counts_each_earlier_ad_and_not_equal_times(spark):
    ads = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 5, "y"), (2, 1, "y")], "u long, t int, c string")
    orders = spark.createDataFrame([(1, 3, 10.0), (1, 5, 1.0)], "u long, t int, v double")
    assert rows(joins.attribute_revenue(ads, orders, "u", "t", "t", "v", "c")) == [("x", 22.0, 4)]


def test_latest_value_skips_nulls_and_falls_back_to_median(spark):
    people = spark.createDataFrame([(1, "d"), (2, "d"), (3, "e")], "id long, g string")
    history = spark.createDataFrame([(1, 1, 4.0), (1, 2, None)], "id long, t int, v double")
    assert rows(joins.latest_values(people, history, "id", "t", ["v"], "g", 3.0)) == [(1, "d", 4.0), (2, "d", 4.0), (3, "e", 3.0)]


def test_suite_reports_every_rule(spark):
    df = spark.createDataFrame([(1, 5.0, "USD"), (1, -5.0, "usd"), (None, None, None)], "id long, total double, cur string")
    q = quality
    out = {r.expectation: (r.failures, r.success) for r in q.validate(df, [q.not_null("id"), q.non_negative("total"), q.matches("cur", "^[A-Z]{3}$"), q.unique("id"), q.exists("cur"), q.exists("nope")]).collect()}
    assert out == {"not_null:id": (1, False), "between:total": (1, False), "regex:cur": (1, False), "unique:id": (1, False), "column:cur": (0, True), "column:nope": (None, False)}


def test_clean_refuses_missing_columns_and_drops_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 99.0), (3, None)], "k long, v double")
    assert rows(quality.validate_and_clean(df, ["k"], ["k", "v"], {"v": (0, 10)})) == [(1, 5.0)]
    with pytest.raises(ValueError):
        quality.validate_and_clean(df, ["k"], ["z"], {})


def test_rolling_agrees_with_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"e": "m", "t": range(200), "v": rng.normal(size=200), "w": rng.normal(size=200)})
    got = rolling.features(spark.createDataFrame(frame), "e", ["t"], ["v", "w"], peaks=True).toPandas().sort_values("t")
    r = frame.v.rolling(15, min_periods=1)
    assert np.allclose(got.v_mean_15, r.mean()) and np.allclose(got.v_std_15, r.std().fillna(0)) and np.allclose(got.v_skew_15, r.skew().fillna(0))
    assert np.allclose(got.corr_v_w, frame.v.rolling(60, min_periods=30).corr(frame.w).fillna(0))
    assert np.allclose(got.v_lag_5, frame.v.shift(5).fillna(frame.v.iloc[0]))
    x = frame.v.to_numpy()[-60:]
    assert got.v_fft_peak.iloc[-1] == np.round(np.fft.rfftfreq(60)[1:][np.abs(np.fft.rfft(x - x.mean()))[1:].argmax()], 4)


def test_rolling_of_hard_series(spark):
    """Gaps, constant stretches, a steep rise with small noise, and a spike before a quiet end, against direct frames."""
    rng = np.random.default_rng(2)
    n = 900
    gaps = pd.Series(rng.normal(size=n)).mask(rng.random(n) < 0.3)
    flat = pd.Series(np.where(np.arange(n) < 450, 0.1, 0.7))
    steep = pd.Series(1e6 * np.arange(n) + rng.normal(size=n))
    spike = pd.Series(np.where(np.arange(n) == 3, 1e9, rng.normal(size=n)))
    frame = pd.DataFrame({"e": "m", "t": range(n), "gaps": gaps, "flat": flat, "steep": steep, "spike": spike})
    df = spark.createDataFrame(frame).withColumn("gaps", F.nanvl("gaps", F.lit(None)))
    names = ["gaps", "flat", "steep", "spike"]
    got = rolling.correlations(rolling.rolling_stats(df, "e", ["t"], names), "e", ["t"], names).toPandas().sort_values("t").reset_index(drop=True)
    for c in names:
        for size in (15, 60, 360):
            frames = [frame[c][max(0, i - size + 1):i + 1].dropna() for i in range(n)]
            want = pd.DataFrame([(x.mean(), x.std() if len(x) > 1 else 0.0, x.skew() if len(x) > 2 and x.nunique() > 1 else 0.0) for x in frames])
            for k, v in enumerate(("mean", "std", "skew")):
                assert np.allclose(got[f"{c}_{v}_{size}"], want[k], rtol=1e-6, atol=1e-6, equal_nan=True), (c, v, size)
    assert (got.flat_std_15[:450] == 0).all() and (got.flat_skew_60[:450] == 0).all() and (got.corr_gaps_flat[:450] == 0).all()
    for a, b in (("gaps", "steep"), ("gaps", "flat")):
        for i in range(0, n, 7):
            both = frame.loc[max(0, i - 59):i, [a, b]].dropna()
            want = both[a].corr(both[b]) if len(both) >= 30 and both[a].nunique() > 1 and both[b].nunique() > 1 else 0.0
            assert abs(got[f"corr_{a}_{b}"][i] - want) < 1e-6
    assert not [x for x in got.columns if x.startswith("_")]


def test_sentiment_negates_and_strengthens(spark):
    df = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "very good!"), (4, ""), (5, None)], "id long, t string")
    got = {r.id: r for r in text.lexicon_sentiment(df, "t", {"good": 2.0}, ("not",), {"very": 1.5}).collect()}
    assert got[1].compound == round(2 / (4 + 15) ** 0.5, 4) and got[2].compound < 0 < got[1].compound < got[3].compound
    assert (got[4].label, got[5].compound, got[5].confidence) == ("neutral", 0.0, 0.0)


def test_topics_refuse_few_texts(spark):
    with pytest.raises(ValueError):
        text.fit_topics(spark.createDataFrame([("one text",)], "clean string"))


def test_topics_are_fitted_on_all_texts_in_each_round(spark):
    docs = spark.createDataFrame([("alpha beta gamma",), ("delta epsilon zeta",)] * 20, "clean string")
    fitted = text.fit_topics(docs, k=2, rounds=3).stages[2]
    assert fitted.getSubsamplingRate() == 1.0 and fitted.getMaxIter() == 3


def test_holt_agrees_with_a_plain_loop(spark):
    y = [5.0, 7.0, 6.0, 9.0, 12.0, 10.0, 13.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(y)], "k string, t int, y double")
    level, trend, want = y[0], y[1] - y[0], [y[0]]
    for v in y[1:]:
        new = 0.3 * v + 0.7 * (level + trend)
        trend, level = 0.1 * (new - level) + 0.9 * trend, new
        want.append(level + trend)
    fitted, ahead = forecast.holt(df, "k", "t", "y", horizon=2)
    assert np.allclose([r.fitted for r in fitted.orderBy("t").collect()], want)
    assert np.allclose([r.forecast for r in ahead.orderBy("step").collect()], [level + trend, level + 2 * trend])


def test_simulation_never_goes_below_one(spark):
    rates = spark.createDataFrame([("d", 10, 0.0, 0.5)], "k string, current long, hire_rate double, departure_rate double")
    plan = spark.createDataFrame([("s", 1.0, 2.0, 0.2, 0.0, 0, 1.0)], "scenario string, hire_multiplier double, departure_multiplier double, reduction double, growth double, freeze_months int, freeze_multiplier double")
    assert [r.headcount for r in forecast.simulate(rates, plan, "k", 3).orderBy("month").collect()] == [1, 1, 1]


def network(spark):
    return spark.createDataFrame([("a", "b", 4), ("b", "a", 4), ("b", "c", 2), ("c", "b", 2), ("c", "c", 7)], "src string, dst string, weight long")


def test_network_measures(spark):
    e = network(spark)
    assert rows(graph.node_metrics(e), "node", "degree", "internal") == [("a", 1, 0), ("b", 2, 0), ("c", 1, 7)]
    assert dict(rows(graph.betweenness(e))) == {"a": 0.0, "b": 1.0, "c": 0.0}
    plain = e.where("src <> dst")
    got = dict(rows(graph.eigenvector_centrality(e)))
    m = np.array([[0, 4, 0], [4, 0, 2], [0, 2, 7]], dtype=float)
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    assert np.allclose([got[x] for x in "abc"], v, atol=1e-4)
    assert plain.count() == 4


def test_parity_passes_fair_and_fails_biased(spark):
    fair = spark.createDataFrame([("m", i % 2) for i in range(100)] + [("f", i % 2) for i in range(100)], "g string, p int")
    biased = spark.createDataFrame([("m", int(i % 5 != 0)) for i in range(100)] + [("f", i % 2) for i in range(100)], "g string, p int")
    assert all(r.passes for r in fairness.demographic_parity(fair, "p", ["g"]).collect())
    worst = {r.value: r for r in fairness.demographic_parity(biased, "p", ["g"]).collect()}
    assert not worst["f"].passes and worst["f"].disparate_impact == 0.625


def test_odds_have_zero_rates_on_empty_denominators(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 0, 1), ("y", 0, 0)], "g string, p int, a int")
    got = {r.value: r for r in fairness.equalized_odds(df, "p", "a", ["g"]).collect()}
    assert (got["x"].tpr, got["y"].tpr, got["x"].tpr_gap, got["x"].passes) == (0.5, 0.0, 0.5, False)


def test_k_anonymity_ignores_nulls(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)], "q string")
    assert rows(fairness.k_anonymity(df, ["q"], 3)) == [(2, 2, 1, False)]
    assert fairness.suppress_rare(df, ["q"], 3).count() == 3


def test_counterfactual_turns_the_decision(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0)], "id long, x double")
    got = fairness.counterfactuals(df, "id", ["x"], {"x": 1.0}, -2.5, {"x": (0.0, 10.0)}).collect()
    assert [(r.id, r.flipped, r.n_steps) for r in got] == [(1, True, 3)]


def test_score_band_leaves_zero_out(spark):
    got = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (1.0,)], "s double").select(score_band(F.col("s"))).collect()
    assert [r[0] for r in got] == [None, "low", "moderate", "critical"]


def test_anomaly_models_part_outliers(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(500, 3)), rng.normal(8, 1, size=(25, 3))]
    df = spark.createDataFrame(pd.DataFrame({"id": range(525), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    forest = ml.isolation_forest(df, "id", ["a", "b", "c"], trees=40)
    scored = ml.flag_anomalies(ml.anomaly_scores(df, forest)).toPandas().set_index("id")
    assert scored.is_anomaly[500:].mean() > 0.7 and scored.is_anomaly[:500].mean() < 0.05 and scored.risk.between(0, 1).all()
    errors = ml.reconstruction_errors(df, ml.autoencoder(df.where("id < 500"), "id", ["a", "b", "c"], hidden=2, epochs=40)).toPandas().set_index("id").error
    assert errors[500:].mean() > errors[:500].mean()


def test_drift_finds_shifted_columns(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=400), "y": rng.normal(size=400)}))
    b = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=400), "y": rng.normal(3, 1, size=400)}))
    got = {r.feature: r.drifted for r in ml.ks_drift(a, b, ["x", "y"]).collect()}
    assert got == {"x": False, "y": True}
    with pytest.raises(ValueError):
        ml.ks_drift(a, b, ["z"])


def test_only_critical_alerts_pass_a_cooldown(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    df = spark.createDataFrame([("m", at(0), 0.75), ("m", at(5), 0.8), ("m", at(10), 0.95), ("m", at(20), 0.6), ("m", at(25), 0.6)], "machine string, ts timestamp, score double")
    assert [r.score for r in ml.alerts_with_cooldown(df, "machine", "ts", "score").orderBy("ts").collect()] == [0.75, 0.95, 0.6]


def test_dedupe_keeps_one_row_for_each_key(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "k long, v string")
    assert rows(medallion.dedupe_exact(df, ["k"]), "k", "v") == [(1, "a"), (2, None)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x,y"\n')
    assert rows(io.copy_into(spark, str(tmp_path / "a.csv"), "id int, t string")) == [(1, "x,y")]
    (tmp_path / "k.json").write_text('{"A": {"price": 1.5}, "B": {"price": 2.5}}')
    assert rows(io.read_keyed_json(spark, str(tmp_path / "k.json"), "price:double", "ticker")) == [("A", 1.5), ("B", 2.5)]
    (tmp_path / "arr.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert rows(io.read_json_array(spark, str(tmp_path / "arr.json"), "a int")) == [(1,), (2,)]
    for v in (9, 10):
        io.store_features(spark.range(v), str(tmp_path / "f"), "s", v)
    assert io.latest_version(io.feature_registry(spark, str(tmp_path / "f")), "s") == 10
    payload = spark.createDataFrame([('{"Records":[{"kinesis":{"data":"eyJhIjogMX0="}}]}',), ('[{"a": 2}, {"a": 3}]',), ('{"a": 4}',)], "value string")
    assert rows(io.decode_payloads(payload, "a int")) == [(1,), (2,), (3,), (4,)]


def test_upsert_replaces_by_key(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert rows(io.upsert(a, b, "k")) == [(1, "x"), (2, "z"), (3, "w")]


def test_jdbc_reads_recent_rows_in_parts(spark):
    url, driver = "jdbc:derby:memory:orders;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.sql("SELECT id, CASE WHEN id % 2 = 0 THEN current_timestamp() ELSE TIMESTAMP '2000-01-01 00:00:00' END AS updated FROM range(20)").write.format("jdbc").options(url=url, dbtable="orders", driver=driver).mode("overwrite").save()
    got = io.read_jdbc_incremental(spark, url, "orders", '"updated"', "TIMESTAMP('2020-01-01 00:00:00')", "id", 0, 20, 8, driver=driver)
    assert got.rdd.getNumPartitions() == 8 and sorted(r.id for r in got.collect()) == list(range(0, 20, 2))


def test_roles_by_medians_and_quartile(spark):
    rows = [(f"n{i}", d, b, 0.0) for i, (d, b) in enumerate([(0.1, 0.9), (0.9, 0.8), (1.0, 0.1), (0.5, 0.5), (0.4, 0.2)])]
    df = spark.createDataFrame(rows, "node string, degree_centrality double, betweenness double, eigenvector double")
    got = {r.node: r.role for r in graph.influence_profile(df.select("node", "degree_centrality"), df.select("node", "betweenness"), df.select("node", "eigenvector")).collect()}
    assert got == {"n0": "bottleneck", "n1": "connector", "n2": "hub", "n3": "peripheral", "n4": "peripheral"}


def test_upsert_takes_the_last_row_of_a_key(spark):
    target = spark.createDataFrame([(1, "old", 0), (2, "stays", 0)], "k int, v string, seq int")
    source = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (3, "new", 1), (3, "new", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, io.upsert(target, source, "k", "seq").collect())) == [(1, "late", 2), (2, "stays", 0), (3, "new", 1)]


def test_a_suite_without_rules_succeeds(spark):
    found = quality.validate(spark.range(3), [])
    assert found.count() == 0 and quality.overall(found).first().success


def test_all_scenarios_are_tried(spark):
    rates = spark.createDataFrame([("a", 10, 0.1, 0.1)], "dept string, current long, hire_rate double, departure_rate double")
    scenarios = spark.range(1200).select(F.col("id").cast("string").alias("scenario"), *[F.lit(1.0).alias(c) for c in ("hire_multiplier", "departure_multiplier")], F.lit(0.0).alias("reduction"), F.lit(0.0).alias("growth"), F.lit(0).alias("freeze_months"), F.lit(1.0).alias("freeze_multiplier"))
    assert forecast.simulate(rates, scenarios, "dept", 2).count() == 2400


def test_flagged_errors_lie_above_the_quantile(spark):
    got = ml.flag_errors(spark.range(100).select(F.col("id").cast("double").alias("error"))).where("is_anomaly = 1").collect()
    assert len(got) == 5 and min(r.error for r in got) > got[0].threshold


def test_anomaly_pipeline_goes_from_readings_to_alerts(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).alias("m"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), F.when(F.col("id") == 400, 900.0).otherwise(F.sin("id") + 5).alias("x"), F.cos("id").alias("y"), (F.col("id") == 400).alias("bad"))
    df = df.unionByName(df.where("id = 3")).unionByName(df.where("id = 4").withColumn("x", F.lit(-1e9)))
    out = ml.anomaly_pipeline(df, "m", "ts", "id", ["x", "y"], {"x": (-1000.0, 1000.0)}, F.col("bad"), trees=30)
    scored = {r.id: r for r in out["scored"].collect()}
    assert len(scored) == 600 and scored[400].is_anomaly == 1 and out["metrics"].first().recall == 1.0
    assert 0 < out["alerts"].count() <= sum(r.is_anomaly for r in scored.values())


def test_cooldown_agrees_with_a_walk_on_a_hot_machine(spark):
    rng = np.random.default_rng(8)
    at = np.cumsum(rng.integers(1, 400, 3000))
    made = [("hot" if i % 3 else "cold", int(t), float(x)) for i, (t, x) in enumerate(zip(at, rng.choice([0.3, 0.55, 0.75, 0.75, 0.93], 3000, p=[0.3, 0.4, 0.2, 0.08, 0.02]), strict=True))] + [("quiet", int(t), 0.6) for t in range(0, 40_000, 7)]
    df = spark.createDataFrame(made, "machine string, s long, score double").withColumn("ts", F.timestamp_seconds("s"))
    want, last = [], {}
    for m, t, x in sorted(made, key=lambda r: (r[0], r[1], r[2])):
        if x >= 0.5 and (x >= 0.9 or m not in last or t - last[m] >= 900):
            want.append((m, t, x))
            last[m] = t
    got = ml.alerts_with_cooldown(df, "machine", "ts", "score").select("machine", F.unix_seconds("ts"), "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ml.alerts_with_cooldown(df.where("1 = 0"), "machine", "ts", "score").count() == 0


def test_average_rank_agrees_with_sorting_and_puts_nulls_last(spark):
    values = [int(x) for x in np.random.default_rng(10).integers(0, 50, 500)] + [49] * 300 + [None, None]
    got = rolling.average_rank(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int"), "v").collect()
    order = sorted(values, key=lambda v: (v is None, -(v or 0)))
    want = {v: int(order.index(v) + 1 + (values.count(v) - 1) / 2) for v in set(values)}
    assert len(got) == len(values) and all(r["rank"] == want[r.v] for r in got)
    assert rolling.average_rank(spark.createDataFrame([], "v int"), "v").count() == 0


def test_flagged_rows_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def score(i):
        calls.add(1)
        return -i / 100

    df = once(spark.range(0, 100, 1, 4), "compound", F.udf(score, "double")("id"))
    got = [r.id for r in text.flagged(df).collect()]
    assert got == list(range(99, 29, -1)) and calls.value == 100


def test_topics_read_their_texts_a_few_times_however_many_rounds(spark):
    calls = spark.sparkContext.accumulator(0)

    def cleaned(i):
        calls.add(1)
        return ("alpha beta gamma", "delta epsilon zeta", "alpha zeta")[i % 3] + (" rare" if i < 2 else "") + " everywhere"

    docs = once(spark.range(0, 60, 1, 4), "clean", F.udf(cleaned, "string")("id"))
    model = text.fit_topics(docs, k=2, rounds=8)
    assert calls.value <= 180 and set(model.stages[1].vocabulary) == {"alpha", "beta", "gamma", "delta", "epsilon", "zeta"}
    assert model.stages[1].vocabulary[:2] == ["alpha", "zeta"] and text.dominant_topic(model, docs).where("topic IS NULL").isEmpty()
