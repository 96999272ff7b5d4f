"""Bronze, silver and gold steps: cleaning, typing, deduplication, and the aggregates built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, key_text, share

MEASURES = ("temperature", "pressure", "vibration", "production_rate", "quality_score")


def with_ingestion_time(df: DataFrame, name: str = "ingestion_ts") -> DataFrame:
    """Audit column of bronze tables."""
    return df.withColumn(name, F.current_timestamp())


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def dedupe_exact(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key; of rows that share a key the least by all other columns, so reruns agree."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedupe_latest(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``. A row's remaining columns break ties, for the same winner on every run."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = Window.partitionBy(*keys).orderBy(*order, *[F.col(c) for c in df.columns if c not in keys])
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def standardize_events(bronze: DataFrame, ts_format: str = "yyyy-MM-dd HH:mm:ss[.SSSSSS]") -> DataFrame:
    """Typed readings with a date; rows without time or device go, and one row stays for each time and device."""
    ts = F.try_to_timestamp(F.col("timestamp"), F.lit(ts_format))
    typed = bronze.select(
        ts.alias("event_ts"), key_text("device_id").alias("device_id"), key_text("facility_id").alias("facility_id"), F.upper("status").alias("status"),
        *[F.expr(f"try_cast({m} AS {'int' if m == 'production_rate' else 'double'})").alias(m) for m in MEASURES])
    kept = typed.where("event_ts IS NOT NULL AND device_id IS NOT NULL").withColumn("process_date", F.to_date("event_ts"))
    return dedupe_exact(kept, ["event_ts", "device_id"])


def normalize_json_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as typed rows: missing ids become '', numbers that don't parse null; nothing is dropped."""
    fields = ("timestamp", "device_id", "facility_id", "status", *MEASURES)
    parsed = lines.select(F.from_json(column, ", ".join(f"{f} STRING" for f in fields)).alias("j"))
    text = [F.coalesce(F.trim(F.col(f"j.{f}")), F.lit("")).alias(f) for f in ("device_id", "facility_id")]
    numbers = [F.expr(f"try_cast(j.{m} AS {'int' if m == 'production_rate' else 'double'})").alias(m) for m in MEASURES]
    return parsed.select(F.col("j.timestamp").alias("timestamp"), *text, F.coalesce(F.upper(F.trim("j.status")), F.lit("")).alias("status"), *numbers,
                         F.to_date(F.expr("try_to_timestamp(j.timestamp)")).alias("process_date"))


def clean_orders(bronze: DataFrame, order_id: str, customer_id: str, total: str, date: str) -> DataFrame:
    """Orders of text columns, typed; rows whose id is no number go."""
    typed = bronze.select(
        F.expr(f"try_cast({order_id} AS bigint)").alias("order_id"), F.expr(f"try_cast({customer_id} AS bigint)").alias("customer_id"),
        F.expr(f"try_cast({total} AS double)").alias("order_total"), F.to_date(F.expr(f"try_to_timestamp({date})")).alias("order_date"))
    return typed.where("order_id IS NOT NULL")


def stage(df: DataFrame, casts: dict[str, tuple[str, str]]) -> DataFrame:
    """A staging view: new name -> (column, type); values that don't fit become null."""
    return df.select(*[F.expr(f"try_cast({c} AS {t})").alias(name) for name, (c, t) in casts.items()])


def hourly_device_metrics(silver: DataFrame) -> DataFrame:
    """Counts, means and flags for each hour, device and facility."""
    hourly = silver.groupBy(F.date_trunc("hour", "event_ts").alias("hour"), "device_id", "facility_id").agg(
        F.count("*").alias("n_events"), *[F.avg(m).alias(f"avg_{m}") for m in MEASURES],
        count_if(F.col("status") == "WARNING").alias("warning_count"), count_if(F.col("status") == "CRITICAL").alias("critical_count"))
    return hourly.withColumns({"meets_quality": F.col("avg_quality_score") >= 95, "has_critical": F.col("critical_count") > 0, "process_date": F.to_date("hour")})


def spend_by_customer(orders: DataFrame, customer: str, total: str) -> DataFrame:
    return orders.groupBy(customer).agg(F.count("*").alias("order_count"), F.sum(total).alias("total_spend"))


def daily_sales(orders: DataFrame, date: Column, total: str) -> DataFrame:
    return orders.groupBy(date.alias("order_date")).agg(F.count("*").alias("order_count"), F.sum(total).alias("revenue"))


def current_stock(movements: DataFrame, log_id: Sequence[str], change: str, by: Sequence[str]) -> DataFrame:
    """Signed sums of movements, each log entry counted once."""
    return dedupe_exact(movements.select(*dict.fromkeys([*log_id, *by, change])), list(log_id)).groupBy(*by).agg(F.sum(change).alias("stock"))


def orders_per_customer(orders: DataFrame, customer: str) -> DataFrame:
    """Partial counts go before the shuffle; rows are not dealt out by key first."""
    return orders.groupBy(customer).agg(F.count("*").alias("order_count"))


def policy_risk(policies: DataFrame, claims: DataFrame, policy: str, claim: str, kind: str, amount: str) -> DataFrame:
    """For each kind of policy: distinct policies and claims, claims per policy, loss in sum and mean, the largest loss first."""
    joined = policies.join(claims, policy, "left")
    by = joined.groupBy(kind).agg(F.countDistinct(policy).alias("policies"), F.countDistinct(claim).alias("claims"), F.sum(amount).alias("total_loss"), F.avg(amount).alias("avg_loss"))
    return by.withColumn("claims_per_policy", F.col("claims") / F.nullif("policies", F.lit(0))).orderBy(F.desc_nulls_last("total_loss"), kind)


def platform_summary(daily: DataFrame) -> DataFrame:
    """One row over days of platform metrics; no row for no days."""
    out = daily.agg(F.count("*").alias("days"), F.avg("pipeline_success_rate").alias("avg_success_rate"), F.sum("dq_failure_count").alias("dq_failures"),
                    F.sum("p0_incidents").alias("p0_incidents"), F.avg("avg_query_runtime_seconds").alias("avg_runtime"))
    return out.where("days > 0")


def request_metrics(log: DataFrame, failed: Column, by: Sequence[str] = ()) -> DataFrame:
    out = log.groupBy(*by).agg(F.count("*").alias("requests_total"), count_if(failed).alias("errors_total"))
    return out.withColumn("error_rate", share(F.col("errors_total"), F.col("requests_total")))
