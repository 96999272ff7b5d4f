"""Forecasts of regular series for many keys at once, and what-if projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASON, LEAST, Z = 12, 6, 1.96


def indexed(df: DataFrame, key: str, ts: str, y: str) -> DataFrame:
    """Rows (key, ts, y, i, n) in time order, for keys of LEAST rows or more; equal times are ordered by value."""
    w = Window.partitionBy(key)
    return df.select(key, ts, F.col(y).cast("double").alias("y")).withColumns(
        {"i": F.row_number().over(w.orderBy(ts, "y")) - 1, "n": F.count("*").over(w)}).where(F.col("n") >= LEAST)


def trend_seasonal(df: DataFrame, key: str, ts: str, y: str, horizon: int = 12) -> tuple[DataFrame, DataFrame]:
    """(fitted, forecast): a line over the index, plus the mean residue at each index modulo 12.

    The forecast has step, forecast, lower and upper at 1.96 deviations of the residuals times the root of the step.
    """
    s = indexed(df, key, ts, y)
    line = s.groupBy(key).agg(F.regr_slope("y", "i").alias("slope"), F.regr_intercept("y", "i").alias("intercept"), F.max("n").alias("n"), F.max(ts).alias("last"))
    detrended = s.drop("n").join(line.drop("n"), key).withColumns({"season": F.col("i") % SEASON, "rest": F.col("y") - F.col("intercept") - F.col("slope") * F.col("i")})
    seasonal = detrended.groupBy(key, "season").agg(F.avg("rest").alias("seasonal"))
    fitted = detrended.join(seasonal, [key, "season"]).select(key, ts, "i", "y", (F.col("intercept") + F.col("slope") * F.col("i") + F.col("seasonal")).alias("fitted"))
    spread = fitted.groupBy(key).agg(F.stddev_pop(F.col("y") - F.col("fitted")).alias("sigma"))
    steps = line.join(spread, key).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("season", (F.col("n") - 1 + F.col("step")) % SEASON)
    ahead = steps.join(seasonal, [key, "season"], "left").withColumn("forecast", F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")) + F.coalesce("seasonal", F.lit(0.0)))
    return fitted, _bounds(ahead, key)


def _bounds(ahead: DataFrame, key: str) -> DataFrame:
    margin = Z * F.col("sigma") * F.sqrt("step")
    return ahead.select(key, "step", "last", "forecast", (F.col("forecast") - margin).alias("lower"), (F.col("forecast") + margin).alias("upper"))


def holt(df: DataFrame, key: str, ts: str, y: str, alpha: float = 0.3, beta: float = 0.1, horizon: int = 12) -> tuple[DataFrame, DataFrame]:
    """(fitted, forecast) by double exponential smoothing, as a fold over each key's values in order.

    The fit at a time is level plus trend after that time's value is seen; the first one is the value itself.
    """
    s = indexed(df, key, ts, y)
    rows = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", ts, "y"))).alias("rows"))
    first, second = F.get("rows", F.lit(0)).y, F.get("rows", F.lit(1)).y
    start = F.struct(first.alias("level"), (second - first).alias("trend"), F.array(first).alias("fit"))

    def step(acc: Column, row: Column) -> Column:
        level = alpha * row.y + (1 - alpha) * (acc.level + acc.trend)
        trend = beta * (level - acc.level) + (1 - beta) * acc.trend
        return F.struct(level.alias("level"), trend.alias("trend"), F.concat(acc.fit, F.array(level + trend)).alias("fit"))

    folded = rows.withColumn("f", F.aggregate(F.slice("rows", 2, F.size("rows")), start, step))
    fitted = folded.select(key, F.inline(F.transform(F.arrays_zip("rows", F.col("f.fit").alias("fit")), lambda x: F.struct(
        x.rows[ts].alias(ts), x.rows.i.alias("i"), x.rows.y.alias("y"), x.fit.alias("fitted")))))
    spread = fitted.groupBy(key).agg(F.stddev_pop(F.col("y") - F.col("fitted")).alias("sigma"))
    ahead = folded.select(key, "f.level", "f.trend", F.element_at("rows", -1)[ts].alias("last"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).join(spread, key)
    return fitted, _bounds(ahead.withColumn("forecast", F.col("level") + F.col("step") * F.col("trend")), key)


def fit_metrics(fitted: DataFrame, key: str) -> DataFrame:
    """MAPE in percent over actuals other than 0, and RMSE, both to two digits."""
    error = F.col("y") - F.col("fitted")
    return fitted.groupBy(key).agg(F.round(F.avg(F.when(F.col("y") != 0, F.abs(error / F.col("y")))) * 100, 2).alias("mape"), F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"))


def best_model(metrics: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The model of least MAPE for each key; ties go to the one named first."""
    every = None
    for i, (name, m) in enumerate(metrics):
        one = m.select(key, "mape", F.lit(i).alias("order"), F.lit(name).alias("model"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min_by("model", F.struct("mape", "order")).alias("model"), F.min("mape").alias("mape"))


def forecast_table(forecast: DataFrame, key: str) -> DataFrame:
    """Whole numbers, halves to even, and a date for each step."""
    whole = lambda c: F.bround(c, 0).cast("long")
    return forecast.select(key, F.add_months(F.to_date("last"), F.col("step")).alias("date"), "step", *[whole(F.col(c)).alias(c) for c in ("forecast", "lower", "upper")])


def baseline_rates(df: DataFrame, key: str, ts: str, headcount: str, hires: str, departures: str) -> DataFrame:
    """Current count and monthly rates for each key of three rows or more; rates are rounded before anyone uses them."""
    by = df.groupBy(key).agg(F.count("*").alias("n"), F.max_by(headcount, F.struct(ts, headcount)).alias("current"), F.avg(hires).alias("h"), F.avg(departures).alias("d"), F.avg(headcount).alias("m")).where("n >= 3")
    return by.select(key, "current", F.round("h", 2).alias("avg_hires"), F.round("d", 2).alias("avg_departures"),
                     F.round(F.when(F.col("m") > 0, F.col("h") / F.col("m")).otherwise(0.0), 4).alias("hire_rate"), F.round(F.when(F.col("m") > 0, F.col("d") / F.col("m")).otherwise(0.0), 4).alias("departure_rate"))


#: Scenarios, of some 100 bytes each, that are sent to all executors.
BROADCAST_SCENARIOS = 10_000


def simulate(rates: DataFrame, scenarios: DataFrame, key: str, months: int = 12) -> DataFrame:
    """Rows (key, scenario, month, headcount, hires, departures) of each scenario, by a fold over months.

    Scenarios have hire_multiplier, departure_multiplier, reduction (a share cut at the start), growth (hires spread
    evenly), freeze_months and freeze_multiplier. All are tried on each key; a table of scenarios is sent to all
    executors only up to BROADCAST_SCENARIOS rows.
    """
    joined = rates.crossJoin(F.broadcast(scenarios) if scenarios.count() <= BROADCAST_SCENARIOS else scenarios).withColumn("start", F.col("current") - (F.col("current") * F.col("reduction")).cast("long"))
    extra = F.col("growth") / months

    def step(acc: Column, m: Column) -> Column:
        frozen = F.when(m <= F.col("freeze_months"), F.col("freeze_multiplier")).otherwise(1.0)
        hires = F.greatest(F.lit(0), ((F.col("hire_rate") * acc.hc * F.col("hire_multiplier") + extra) * frozen).cast("long"))
        gone = F.greatest(F.lit(0), (F.col("departure_rate") * acc.hc * F.col("departure_multiplier")).cast("long"))
        hc = F.greatest(F.lit(1), acc.hc + hires - gone).cast("long")
        return F.struct(hc.alias("hc"), F.concat(acc.out, F.array(F.struct(m.alias("month"), hc.alias("headcount"), hires.cast("long").alias("hires"), gone.cast("long").alias("departures")))).alias("out"))

    empty = F.array().cast("array<struct<month:int,headcount:bigint,hires:bigint,departures:bigint>>")
    folded = joined.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(months)), F.struct(F.col("start").cast("long").alias("hc"), empty.alias("out")), step))
    return folded.select(key, "scenario", "current", F.inline("f.out"))


def compare_scenarios(simulated: DataFrame, key: str) -> DataFrame:
    """Totals of each scenario over all keys, and the change against today, the largest loss first."""
    ends = simulated.groupBy("scenario", key).agg(F.max_by("headcount", "month").alias("final"), F.first("current").alias("current"), F.sum("hires").alias("hires"), F.sum("departures").alias("departures"))
    by = ends.groupBy("scenario").agg(*[F.sum(c).alias(c) for c in ("current", "final", "hires", "departures")])
    return by.withColumn("net_change", F.col("final") - F.col("current")).withColumn("pct_change", F.round(F.col("net_change") * 100.0 / F.col("current"), 1)).orderBy("net_change", "scenario")


def impact_by_key(simulated: DataFrame, key: str) -> DataFrame:
    ends = simulated.groupBy("scenario", key).agg(F.max_by("headcount", "month").alias("final"), F.first("current").alias("current"))
    return ends.withColumn("net_change", F.col("final") - F.col("current")).orderBy("scenario", "net_change", key)
