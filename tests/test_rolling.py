"""Rolling features across the edges of blocks and Arrow batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpulse.operators import rolling
from sparkpulse.operators.ordered import numbered


def series(n: int, seed: int, gaps: float = 0.1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"t": range(n), **{c: pd.Series(rng.normal(size=n).cumsum()).mask(rng.random(n) < gaps) for c in "vw"}})


def walked(f: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"t": f.t})
    for c in "vw":
        for n in rolling.WINDOWS:
            r = f[c].rolling(n, min_periods=1)
            out[f"{c}_mean_{n}"], out[f"{c}_std_{n}"], out[f"{c}_skew_{n}"] = r.mean(), r.std().fillna(0), r.skew().fillna(0)
        out[f"{c}_roc"] = f[c].diff().fillna(0)
        for n in rolling.LAGS:
            out[f"{c}_lag_{n}"] = f[c].shift(n).fillna(f[c].iloc[0])
    both = f[["v", "w"]].where(f.v.notna() & f.w.notna())
    out["corr_v_w"] = both.v.rolling(60, min_periods=30).corr(both.w).fillna(0)
    return out


@pytest.mark.parametrize(("block", "batch"), [(500, 10_000), (1200, 170), (10_000, 97)])
def test_one_long_series_among_short_ones(spark, block, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        parts = {"long": series(3100, 1), None: series(900, 2), "short": series(40, 3), "one": series(1, 4, 0), "edge": series(1200, 5)}
        df = spark.createDataFrame(pd.concat([f.assign(e=k) for k, f in parts.items()])).replace(float("nan"), None)
        got = rolling.features(df.repartition(3), "e", ["t"], ["v", "w"], peaks=True, block_rows=block).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, parts.values()))
    for k, f in parts.items():
        mine = got[got.e.isna() if k is None else got.e == k].sort_values("t").reset_index(drop=True)
        want = walked(f)
        for c in want.columns:
            assert np.allclose(mine[c].astype(float), want[c].astype(float), atol=1e-6, equal_nan=True), (k, c)
        x = f.v.fillna(0).to_numpy()[-60:]
        if len(x) >= 4:
            peak = np.round(np.fft.rfftfreq(len(x))[1:][np.abs(np.fft.rfft(x - x.mean()))[1:].argmax()], 4)
            assert mine.v_fft_peak.iloc[-1] == peak


def test_a_long_series_takes_a_task_to_a_block(spark):
    df = spark.range(30_000).select(F.lit("m").alias("e"), "id", F.sin("id").alias("v"))
    blocks = rolling.in_blocks(df, "e", ["id"], ["v"], 359, 5000)
    sizes = {r._block: (r.n, r.lead) for r in blocks.groupBy("_block").agg(F.count("*").alias("n"), F.count_if("_lead").alias("lead")).collect()}
    assert sizes == {0: (5000, 0)} | {k: (5359, 359) for k in range(1, 6)}
    assert blocks.where("_block > 0 AND NOT _lead").agg(F.min("_first.f0"), F.max("_first.f0")).first() == (0.0, 0.0)


def test_80_features_of_five_sensors(spark):
    df = spark.range(50).select(F.lit(1).alias("e"), "id", *[(F.col("id") * k).cast("double").alias(f"s{k}") for k in range(5)])
    out = rolling.features(df, "e", ["id"], [f"s{k}" for k in range(5)])
    assert len(out.columns) - len(df.columns) == 80 and out.count() == 50
    assert rolling.features(df.where("id < 0"), "e", ["id"], ["s1"]).count() == 0


def test_values_that_are_not_finite_spoil_only_their_frames(spark):
    v = [float(k % 7) for k in range(100)]
    v[20], v[60] = float("inf"), float("nan")
    got = rolling.rolling_stats(spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "e string, t int, v double"), "e", ["t"], ["v"], [15]).toPandas().sort_values("t")
    bad = ~np.isfinite(got.v_mean_15.to_numpy())
    assert bad[20:35].all() and bad[60:75].all() and bad.sum() == 30


def test_places_count_on_over_ranges(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).alias("g"), F.when(F.col("id") > 10, (F.col("id") * 7919) % 1009).alias("o"), "id")
    got = numbered(df, ["g"], ["o", "id"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["o", "id"], na_position="first")
        assert part._pos.tolist() == list(range(len(part)))
    assert numbered(df.where("id < 0"), ["g"], ["o"]).count() == 0
