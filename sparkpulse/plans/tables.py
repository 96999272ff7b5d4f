"""Queries of the medallion steps, joins, quality checks and privacy measures over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import risk_tier, score_band
from ..operators import fairness, joins, medallion, quality, rolling
from ..sources.io import upsert
from ..streaming import jobs
from .registry import query

MEASURES = {"temperature": "value", "pressure": "value / 10", "vibration": "value % 7", "production_rate": "CAST(event_id % 100 AS INT)", "quality_score": "100 - value % 10"}


def telemetry(t) -> DataFrame:
    """Events as text readings of devices, with odd spelling to clean."""
    return t.events.selectExpr(
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS timestamp", "concat(' dev', user_id) AS device_id", "concat('fac', user_id % 5, ' ') AS facility_id",
        "CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'warning' ELSE 'normal' END AS status", *[f"CAST({e} AS STRING) AS {m}" for m, e in MEASURES.items()])


SILVER = """
  WITH raw AS (
    SELECT date_trunc('second', ts) AS event_ts, 'DEV' || user_id AS device_id, 'FAC' || user_id % 5 AS facility_id,
           CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'signup' THEN 'WARNING' ELSE 'NORMAL' END AS status,
           value AS temperature, value / 10 AS pressure, value % 7 AS vibration, (event_id % 100)::INT AS production_rate, 100 - value % 10 AS quality_score
    FROM events),
  silver AS (
    SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY event_ts, device_id
      ORDER BY facility_id, status, temperature, pressure, vibration, production_rate, quality_score) = 1)"""


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Dates and decimals as text, which both engines write alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query(SILVER + "SELECT event_ts, device_id, facility_id, status, round(temperature, 4) AS temperature, round(pressure, 4) AS pressure, round(vibration, 4) AS vibration, production_rate, round(quality_score, 4) AS quality_score, event_ts::DATE::VARCHAR AS process_date FROM silver")
def standardize_events(t):
    out = rounded(medallion.standardize_events(telemetry(t), "yyyy-MM-dd HH:mm:ss"), "temperature", "pressure", "vibration", "quality_score")
    return as_text(out, "process_date").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(SILVER + """
  SELECT date_trunc('hour', event_ts) AS hour, device_id, facility_id, count(*) AS n_events,
         round(avg(temperature), 4) AS avg_temperature, round(avg(pressure), 4) AS avg_pressure, round(avg(vibration), 4) AS avg_vibration,
         round(avg(production_rate), 4) AS avg_production_rate, round(avg(quality_score), 4) AS avg_quality_score,
         count(*) FILTER (status = 'WARNING') AS warning_count, count(*) FILTER (status = 'CRITICAL') AS critical_count,
         avg(quality_score) >= 95 AS meets_quality, count(*) FILTER (status = 'CRITICAL') > 0 AS has_critical, date_trunc('hour', event_ts)::DATE::VARCHAR AS process_date
  FROM silver GROUP BY ALL""")
def hourly_device_metrics(t):
    out = medallion.hourly_device_metrics(medallion.standardize_events(telemetry(t), "yyyy-MM-dd HH:mm:ss"))
    return as_text(rounded(out, *[f"avg_{m}" for m in medallion.MEASURES]), "process_date").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'dev' || user_id AS device_id, 'fac' || user_id % 5 AS facility_id,
          CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'signup' THEN 'WARNING' ELSE 'NORMAL' END AS status, round(value, 4) AS temperature, round(value / 10, 4) AS pressure,
          round(value % 7, 4) AS vibration, (event_id % 100)::INT AS production_rate, round(100 - value % 10, 4) AS quality_score, ts::DATE::VARCHAR AS process_date FROM events""")
def normalize_json_events(t):
    lines = telemetry(t).select(F.to_json(F.struct("*")).alias("value"))
    return as_text(rounded(medallion.normalize_json_events(lines), "temperature", "pressure", "vibration", "quality_score"), "process_date")


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS order_total, o_orderdate::DATE::VARCHAR AS order_date FROM orders WHERE o_orderkey % 50 <> 0")
def clean_orders(t):
    bronze = t.orders.selectExpr("CASE WHEN o_orderkey % 50 = 0 THEN 'NULL_ID' ELSE CAST(o_orderkey AS STRING) END AS id", "CAST(o_custkey AS STRING) AS customer", "CAST(o_totalprice AS STRING) AS total", "CAST(o_orderdate AS STRING) AS placed")
    return as_text(medallion.clean_orders(bronze, "id", "customer", "total", "placed"), "order_date")


@query("SELECT o_orderkey::BIGINT AS claim_id, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS claim_amount, o_orderdate::DATE::VARCHAR AS incident_date, o_orderstatus AS status FROM orders")
def stage_claims(t):
    return as_text(medallion.stage(t.orders, {"claim_id": ("o_orderkey", "bigint"), "claim_amount": ("o_totalprice", "decimal(18,2)"), "incident_date": ("o_orderdate", "date"), "status": ("o_orderstatus", "string")}), "claim_amount", "incident_date")


@query("SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def not_null_events(t):
    return medallion.not_null(t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "k")


@query("""SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem)
          QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) = 1""")
def dedupe_latest_lines(t):
    return medallion.dedupe_latest(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"), "l_orderkey", [F.desc("l_shipdate"), F.desc("l_linenumber")])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedupe_exact_events(t):
    return medallion.dedupe_exact(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"])


@query("SELECT o_custkey, count(*) AS order_count, round(sum(o_totalprice), 2) AS total_spend FROM orders GROUP BY ALL")
def customer_spend(t):
    return rounded(medallion.spend_by_customer(t.orders, "o_custkey", "o_totalprice"), "total_spend", digits=2)


@query("SELECT o_orderdate::DATE::VARCHAR AS order_date, count(*) AS order_count, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY ALL")
def daily_sales(t):
    return as_text(rounded(medallion.daily_sales(t.orders, F.to_date("o_orderdate"), "o_totalprice"), "revenue", digits=2), "order_date")


@query("""SELECT l_suppkey, l_partkey, round(sum(change), 4) AS stock FROM (
            SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS change FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, change) = 1) GROUP BY ALL""")
def current_stock(t):
    moves = t.lineitem.withColumn("change", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")))
    return rounded(medallion.current_stock(moves, ["l_orderkey", "l_linenumber"], "change", ["l_suppkey", "l_partkey"]), "stock")


@query("SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY ALL")
def orders_per_customer(t):
    return medallion.orders_per_customer(t.orders, "o_custkey")


@query("""SELECT c_mktsegment, count(DISTINCT c_custkey) AS policies, count(DISTINCT o_orderkey) AS claims, round(sum(o_totalprice), 2) AS total_loss, round(avg(o_totalprice), 4) AS avg_loss,
                 round(count(DISTINCT o_orderkey)::DOUBLE / nullif(count(DISTINCT c_custkey), 0), 6) AS claims_per_policy
          FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def policy_risk_mart(t):
    out = medallion.policy_risk(t.customer.withColumnRenamed("c_custkey", "policy"), t.orders.withColumnRenamed("o_custkey", "policy"), "policy", "o_orderkey", "c_mktsegment", "o_totalprice")
    return rounded(rounded(rounded(out, "total_loss", digits=2), "avg_loss"), "claims_per_policy", digits=6)


DAILY = """SELECT ts::DATE AS day, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS ok, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'error' AND value > 400) AS p0, avg(value) AS run FROM events GROUP BY ALL"""


@query(f"SELECT count(*) AS days, round(avg(ok), 6) AS avg_success_rate, sum(bad)::BIGINT AS dq_failures, sum(p0)::BIGINT AS p0_incidents, round(avg(run), 6) AS avg_runtime FROM ({DAILY})")
def platform_summary(t):
    e = F.col("event_type") == "error"
    daily = t.events.groupBy(F.to_date("ts").alias("date")).agg(F.avg(F.when(e, 0.0).otherwise(1.0)).alias("pipeline_success_rate"), F.count_if(e).alias("dq_failure_count"), F.count_if(e & (F.col("value") > 400)).alias("p0_incidents"), F.avg("value").alias("avg_query_runtime_seconds"))
    return rounded(medallion.platform_summary(daily), "avg_success_rate", "avg_runtime", digits=6)


@query("SELECT user_id, count(*) AS requests_total, count(*) FILTER (event_type = 'error') AS errors_total, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate FROM events GROUP BY ALL")
def request_metrics(t):
    return rounded(medallion.request_metrics(t.events, F.col("event_type") == "error", ["user_id"]), "error_rate", digits=6)


@query("SELECT DISTINCT user_id, event_type FROM events")
def equipment_registry(t):
    return t.events.select("user_id", "event_type").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(t):
    from ..operators.rolling import top_n

    return top_n(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""")
def upsert_orders(t):
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return upsert(target, target.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("F")), "o_orderkey")


@query("SELECT c_custkey AS key, 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier")
def union_accounts(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


# Joins


@query("""WITH ads AS (SELECT user_id, ts, (event_id % 20)::VARCHAR AS campaign FROM events WHERE event_type = 'click'), buys AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
          SELECT campaign, round(sum(value), 4) AS revenue, count(*) AS attributed_orders FROM ads JOIN buys ON ads.user_id = buys.user_id AND buys.ts > ads.ts GROUP BY ALL""")
def attribute_revenue(t):
    ads = t.events.where("event_type = 'click'").select("user_id", "ts", (F.col("event_id") % 20).cast("string").alias("campaign"))
    buys = t.events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return rounded(joins.attribute_revenue(ads, buys, "user_id", "ts", "ts", "value", "campaign"), "revenue")


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_nationkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def orders_with_customer(t):
    facts = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.with_dimension(facts, t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", ["c_nationkey", "c_mktsegment"])


@query("""WITH known AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS total, o_orderdate FROM orders),
          latest AS (SELECT o_custkey, max_by(total, (o_orderdate, total)) FILTER (total IS NOT NULL) AS total FROM known GROUP BY ALL),
          joined AS (SELECT c_custkey, c_mktsegment, total FROM customer LEFT JOIN latest ON c_custkey = o_custkey)
          SELECT c_custkey AS o_custkey, c_mktsegment, round(coalesce(total, median(total) OVER (PARTITION BY c_mktsegment), 3.0), 4) AS total FROM joined""")
def latest_survey_features(t):
    history = t.orders.select("o_custkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("total"))
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return rounded(joins.latest_values(people, history, "o_custkey", "o_orderdate", ["total"], "c_mktsegment", 3.0), "total")


@query("""WITH o AS (SELECT c_custkey AS order_id, (c_custkey * 37 % 9000)::DOUBLE / 100 AS lat, (c_custkey * 101 % 18000)::DOUBLE / 100 AS lon FROM customer),
          d AS (SELECT s_suppkey AS driver_id, (s_suppkey * 53 % 9000)::DOUBLE / 100 AS lat, (s_suppkey * 211 % 18000)::DOUBLE / 100 AS lon FROM supplier WHERE s_suppkey % 4 <> 0),
          p AS (SELECT order_id, driver_id, sqrt(pow(o.lat - d.lat, 2) + pow(o.lon - d.lon, 2)) AS distance FROM o CROSS JOIN d)
          SELECT order_id, driver_id, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY distance, driver_id) = 1""")
def nearest_available(t):
    orders = t.customer.selectExpr("c_custkey AS order_id", "CAST(c_custkey * 37 % 9000 AS DOUBLE) / 100 AS lat", "CAST(c_custkey * 101 % 18000 AS DOUBLE) / 100 AS lon")
    drivers = t.supplier.where("s_suppkey % 4 <> 0").selectExpr("s_suppkey AS driver_id", "CAST(s_suppkey * 53 % 9000 AS DOUBLE) / 100 AS lat", "CAST(s_suppkey * 211 % 18000 AS DOUBLE) / 100 AS lon")
    return rounded(joins.nearest_available(orders, drivers), "distance", digits=6)


@query("""WITH latest AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL) SELECT * FROM latest""")
def latest_per_user(t):
    return joins.latest_position(t.events.select("user_id", "ts", "event_id"), "user_id", "ts")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 450)")
def unblocked_events(t):
    blocked = t.events.where("event_type = 'error' AND value > 450").select("user_id")
    return joins.members(t.events.select("event_id", "user_id"), "user_id", blocked, there=False).select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer))")
def allowed_orders(t):
    first = t.customer.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    allowed = t.customer.join(first, "c_mktsegment", "left_semi").select("c_custkey")
    return joins.members(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", allowed).select("o_orderkey", "o_custkey")


# Quality


@query("""WITH c AS (SELECT count(*) FILTER (o_orderkey IS NULL) AS a, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) AS b, count(*) FILTER (NOT regexp_matches(o_orderstatus, '^[FO]$')) AS d, count(*) FILTER (o_totalprice < 0) AS e FROM orders),
          u AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
          SELECT expectation, failures, coalesce(failures = 0, false) AS success FROM (
            SELECT 'not_null:o_orderkey' AS expectation, a AS failures FROM c UNION ALL SELECT 'between:o_totalprice', b FROM c UNION ALL SELECT 'regex:o_orderstatus', d FROM c
            UNION ALL SELECT 'between:o_totalprice', e FROM c UNION ALL SELECT 'unique:o_custkey', n FROM u UNION ALL SELECT 'column:o_orderdate', 0 UNION ALL SELECT 'column:currency', NULL)""")
def validate_orders(t):
    q = quality
    return q.validate(t.orders, [q.not_null("o_orderkey"), q.between("o_totalprice", 1000, 400000), q.matches("o_orderstatus", "^[FO]$"), q.non_negative("o_totalprice"), q.unique("o_custkey"), q.exists("o_orderdate"), q.exists("currency")])


@query("""SELECT success, checks, failed FROM (SELECT false AS success, 4 AS checks, (count(*) FILTER (o_orderkey IS NULL) > 0)::INT + (count(*) FILTER (NOT regexp_matches(o_orderstatus, '^[FO]$')) > 0)::INT + (count(*) FILTER (o_totalprice < 0) > 0)::INT + 1 AS failed FROM orders)""")
def validation_verdict(t):
    """The suite's one row; the last rule asks for a column that isn't there."""
    q = quality
    return q.overall(q.validate(t.orders, [q.not_null("o_orderkey"), q.matches("o_orderstatus", "^[FO]$"), q.non_negative("o_totalprice"), q.exists("currency")]))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def first_orders(t):
    return rolling.first_n(t.orders.select("o_orderkey", "o_orderdate"), 25, ["o_orderdate", "o_orderkey"])


@query("""SELECT sensor, rows, nulls, round(mean, 6) AS mean, round(std, 6) AS std, low, high, out_of_bounds, (SELECT count(*) - count(DISTINCT (ts, user_id)) FROM events) AS repeated_keys FROM (
          SELECT 'value' AS sensor, count(*) AS rows, count(*) FILTER (value IS NULL) AS nulls, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, max(value) AS high, count(*) FILTER (value NOT BETWEEN 5 AND 450) AS out_of_bounds FROM events
          UNION ALL SELECT 'user_id', count(*), count(*) FILTER (user_id IS NULL), avg(user_id), stddev_samp(user_id), min(user_id), max(user_id), count(*) FILTER (user_id NOT BETWEEN 10 AND 100) FROM events)""")
def quality_report(t):
    return rounded(quality.quality_report(t.events, ["ts", "user_id"], {"value": (5, 450), "user_id": (10, 100)}), "mean", "std", digits=6)


@query("SELECT ts, user_id, min(event_id) AS event_id FROM events WHERE value BETWEEN 5 AND 450 AND user_id IS NOT NULL GROUP BY ALL")
def validate_and_clean_events(t):
    df = t.events.select("ts", "user_id", "event_id", "event_type", "value")
    return quality.validate_and_clean(df, ["ts", "user_id"], ["ts", "user_id", "value"], {"value": (5, 450)}).select("ts", "user_id", "event_id")


@query("SELECT count(*) AS rows_read, count(*) FILTER (value BETWEEN 5 AND 450 AND user_id IS NOT NULL) AS rows_valid, count(*) FILTER (NOT (value BETWEEN 5 AND 450 AND user_id IS NOT NULL)) AS rows_invalid FROM events")
def ingest_stats(t):
    return quality.ingest_stats(t.events, ["user_id"], {"value": (5, 450)})


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SSN, PHONE = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"\(?\b[0-9]{3}\)?[ .-]?[0-9]{3}[.-][0-9]{4}\b"


@query(f"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS t1 FROM documents),
  b AS (SELECT *, regexp_replace(t1, '{SSN}', '[SSN]', 'g') AS t2 FROM a)
  SELECT doc_id, regexp_replace(t2, '{PHONE}', '[PHONE]', 'g') AS text, len(regexp_extract_all(text, '{EMAIL}'))::INT AS n_email,
    len(regexp_extract_all(t1, '{SSN}'))::INT AS n_ssn, len(regexp_extract_all(t2, '{PHONE}'))::INT AS n_phone FROM b""")
def mask_pii(t):
    return fairness.mask_pii(t.documents.select("doc_id", "text"), "text").select("doc_id", "text", "n_email", "n_ssn", "n_phone")


@query("""SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'model_not_allowed' WHEN turn = 0 THEN 'missing_tag' END AS reason, role IN ('user', 'assistant') AND turn <> 0 AS accepted, substring(text, 1, 200) AS snippet FROM conversations""")
def governed_requests(t):
    asked = t.conversations.select("conv_id", "turn", F.col("role").alias("model"), F.when(F.col("turn") == 0, " ").otherwise("team").alias("tag"), F.col("text").alias("prompt"))
    return fairness.governed_requests(asked, ["user", "assistant"]).select("conv_id", "turn", "reason", "accepted", "snippet")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND (contains(text, 'License') OR contains(text, 'worthless') OR lang = 'fr')")
def keyword_route(t):
    blocked = t.documents.where("source IN ('src1', 'src2')").select("source").distinct()
    return jobs.keyword_route(t.documents, ["License", "worthless"], "fr", blocked, user="source", topic_column="lang").select("doc_id")


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_identifiers(t):
    return fairness.drop_direct_identifiers(t.customer)


@query("SELECT c_custkey, CASE WHEN a >= 20 AND a < 30 THEN '20-29' WHEN a >= 30 AND a < 40 THEN '30-39' WHEN a >= 40 AND a < 50 THEN '40-49' WHEN a >= 50 AND a < 60 THEN '50-59' WHEN a >= 60 AND a < 100 THEN '60-69' END AS age_band FROM (SELECT c_custkey, c_custkey % 110 AS a FROM customer)")
def generalize_age(t):
    return fairness.generalize_age(t.customer.select("c_custkey", (F.col("c_custkey") % 110).alias("age")), "age")


@query("SELECT o_orderkey, CASE WHEN s > 0 AND s <= .3 THEN 'low' WHEN s > .3 AND s <= .5 THEN 'moderate' WHEN s > .5 AND s <= .7 THEN 'high' WHEN s > .7 AND s <= 1 THEN 'critical' END AS band, CASE WHEN 100 * s >= 90 THEN 'HIGH' WHEN 100 * s >= 50 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM (SELECT o_orderkey, o_totalprice / 500000 AS s FROM orders)")
def score_bands(t):
    s = F.col("o_totalprice") / 500000
    return t.orders.select("o_orderkey", score_band(s).alias("band"), risk_tier(100 * s).alias("tier"))


@query("SELECT event_id, lag_ms, x AS overlay_x, y - 5 AS overlay_y FROM (SELECT event_id, event_id % 30 + value / 50 AS lag_ms, (event_id % 640)::INT AS x, (event_id % 480)::INT AS y FROM events) WHERE lag_ms <= 33")
def frame_latency_gate(t):
    frames = t.events.select("event_id", (F.col("event_id") % 30).alias("arrival_ms"), F.lit(0).alias("event_ms"), (F.col("value") / 50).alias("compute_ms"),
                             F.create_map(F.lit("nose_tip"), F.array((F.col("event_id") % 640).cast("int"), (F.col("event_id") % 480).cast("int"))).alias("landmarks"))
    return jobs.frame_latency_gate(frames).select("event_id", "lag_ms", "overlay_x", "overlay_y")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 1 MONTH FROM orders) AND o_orderstatus = 'O'")
def recent_open_orders(t):
    last = t.orders.agg(F.max("o_orderdate").alias("last"))
    recent = t.orders.where("o_orderstatus = 'O'").join(F.broadcast(last), F.col("o_orderdate") >= F.expr("last - INTERVAL 1 MONTH"))  # one row
    return recent.select("o_orderkey", "o_orderdate")


QI = ["c_nationkey", "c_mktsegment"]
GROUPS = "(SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)"


@query(f"SELECT min(n) AS k, count(*) AS groups, count(*) FILTER (n < 12) AS groups_below, min(n) >= 12 AS meets FROM {GROUPS}")
def k_anonymity(t):
    return fairness.k_anonymity(t.customer, QI, 12)


@query(f"SELECT c_custkey, c_nationkey, c_mktsegment FROM customer SEMI JOIN (SELECT * FROM {GROUPS} WHERE n >= 12) USING (c_nationkey, c_mktsegment)")
def suppress_rare(t):
    return fairness.suppress_rare(t.customer.select("c_custkey", *QI), QI, 12).select("c_custkey", *QI)


@query(f"SELECT (SELECT count(*) FROM customer) AS rows_before, (SELECT coalesce(sum(n), 0)::BIGINT FROM {GROUPS} WHERE n >= 12) AS rows_after, (SELECT min(n) FROM {GROUPS}) AS k_before, (SELECT min(n) FROM {GROUPS} WHERE n >= 12) AS k_after, (SELECT min(n) FROM {GROUPS} WHERE n >= 12) IS NOT NULL AS meets")
def anonymize_report(t):
    return fairness.anonymize(t.customer, QI, 12)[1]


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"))
