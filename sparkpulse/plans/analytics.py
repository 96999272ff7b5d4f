"""Queries of rolling features, text, forecasts, fairness, graphs, models and streaming twins over the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forecast, ml, rolling, text
from .registry import query
from .tables import as_text, rounded

COLUMNS, ORDER = ("value", "second"), ("ts", "event_id")


def series(t) -> DataFrame:
    return t.events.select("user_id", "ts", "event_id", "value", (F.col("event_id") % 97).cast("double").alias("second"))


def _features_sql() -> str:
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    out = []
    for n in rolling.WINDOWS:
        f = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for c in COLUMNS:
            out += [f"round(avg({c}) {f} + 1e-9, 4) AS {c}_mean_{n}", f"round(coalesce(stddev_samp({c}) {f}, 0), 4) AS {c}_std_{n}",
                    f"round(coalesce(CASE WHEN count({c}) {f} >= 3 AND stddev_samp({c}) {f} > 0 THEN skewness({c}) {f} END, 0), 3) AS {c}_skew_{n}"]
    for c in COLUMNS:
        d = f"coalesce({c} - lag({c}) OVER ({w}), 0)"
        out += [f"round({d}, 4) AS {c}_roc", f"round(abs({d}), 4) AS {c}_roc_abs"]
        out += [f"round(coalesce(lag({c}, {n}) OVER ({w}), first_value({c}) OVER ({w})), 4) AS {c}_lag_{n}" for n in rolling.LAGS]
    f = f"OVER ({w} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    for a, b in combinations(COLUMNS, 2):
        out.append(f"round(coalesce(CASE WHEN count(*) {f} >= 30 THEN corr({a}, {b}) {f} END, 0), 4) AS corr_{a}_{b}")
    out = [x.replace(" AS ", " + 0.0 AS ") if x.startswith("round(") else x for x in out]  # no -0
    return f"SELECT event_id, {', '.join(out)} FROM (SELECT user_id, ts, event_id, value, (event_id % 97)::DOUBLE AS second FROM events)"


@query(_features_sql())
def rolling_features(t):
    out = rolling.features(series(t), "user_id", ORDER, COLUMNS)
    names = [c for c in out.columns if c not in ("user_id", "ts", "event_id", *COLUMNS)]
    return out.select("event_id", *[(F.round(F.col(c) + 1e-9 if "_mean_" in c else F.col(c), 3 if "_skew_" in c else 4) + 0.0).alias(c) for c in names])  # ties go up in both engines


#: The discrete transform as sums over each frame; of frequencies alike to nine digits the first counts.
PEAKS = """WITH f AS (SELECT event_id, list(coalesce(value, 0)::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING) AS x FROM events),
  c AS (SELECT event_id, len(x) AS n, list_transform(x, lambda v: v - list_avg(x)) AS x FROM f),
  k AS (SELECT event_id, n, x, unnest(range(1, n // 2 + 1)) AS k FROM c WHERE n >= 4),
  p AS (SELECT event_id, n, k, sqrt(pow(list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * ((k * (i - 1)) % n) / n))), 2)
    + pow(list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * ((k * (i - 1)) % n) / n))), 2)) AS power FROM k),
  best AS (SELECT event_id, arg_min(round_even(k / n, 4), {'p': -round(power, 6), 'k': k}) AS peak FROM p GROUP BY ALL)
  SELECT event_id, coalesce(peak, 0)::DOUBLE AS value_fft_peak FROM f LEFT JOIN best USING (event_id)"""


@query(PEAKS)
def fft_peaks(t):
    return rolling.fft_peak(series(t), "user_id", ORDER, "value").select("event_id", "value_fft_peak")


TRENDS = """WITH means AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS period, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM events GROUP BY ALL HAVING count(value) >= 20),
  idx AS (SELECT period, row_number() OVER (ORDER BY period) AS i FROM (SELECT DISTINCT period FROM means)),
  tr AS (SELECT b.*, b.mean - p.mean AS change FROM (SELECT * FROM means JOIN idx USING (period)) b LEFT JOIN (SELECT * FROM means JOIN idx USING (period)) p ON p.event_type = b.event_type AND p.i = b.i - 1),
  sh AS (SELECT * FROM (SELECT *, lag(period) OVER (PARTITION BY event_type ORDER BY period) AS period_from FROM tr) WHERE abs(change) >= 15)"""


def trends(t) -> DataFrame:
    return rolling.period_change(t.events.withColumn("period", F.date_format("ts", "yyyy-MM-dd")), "event_type", "period", "value")


@query(TRENDS + " SELECT event_type, period, round(mean, 4) AS mean, round(std, 4) AS std, n, round(change, 4) AS change FROM tr")
def period_trends(t):
    return rounded(trends(t), "mean", "std", "change")


@query(TRENDS + " SELECT event_type, period_from, period AS period_to, round(change, 4) AS change, CASE WHEN abs(change) >= 30 THEN 'significant' ELSE 'notable' END AS severity, CASE WHEN change > 0 THEN 'improving' ELSE 'declining' END AS direction FROM sh")
def detect_shifts(t):
    return rounded(rolling.shifts(trends(t), "event_type", "period", 15, 30), "change")


@query(TRENDS + """, dev AS (SELECT event_type, period, mean - avg(mean) OVER (PARTITION BY period) AS d, row_number() OVER (PARTITION BY event_type ORDER BY period) - 1 AS k FROM tr),
  sl AS (SELECT event_type, regr_slope(d, k) AS slope, max_by(d, period) AS latest, count(*) AS periods FROM dev GROUP BY ALL HAVING count(*) >= 2)
  SELECT event_type, round(slope, 4) AS slope, round(latest, 4) AS latest_deviation, periods, CASE WHEN slope > .05 THEN 'diverging_up' WHEN slope < -.05 THEN 'diverging_down' ELSE 'stable' END AS trend FROM sl""")
def diverging_groups(t):
    return rounded(rolling.divergence(trends(t), "event_type", "period"), "slope", "latest_deviation")


@query(TRENDS + """ SELECT (SELECT count(DISTINCT period) FROM tr) AS periods, (SELECT count(DISTINCT event_type) FROM tr) AS groups, count(*) AS alerts, count(*) FILTER (abs(change) >= 30) AS significant,
  count(*) FILTER (change <= 0) AS declining, count(*) FILTER (change > 0) AS improving FROM sh""")
def trend_summary(t):
    tr = trends(t)
    return rolling.trend_summary(tr, rolling.shifts(tr, "event_type", "period", 15, 30), "event_type", "period")


@query("SELECT n_name, n, (rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2)::DOUBLE::VARCHAR AS r, floor(rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0)::INT AS rank FROM (SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL)".replace("(rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2)::DOUBLE::VARCHAR AS r, ", ""))
def average_rank(t):
    by = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return rolling.average_rank(by, "n")


@query("SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def top_customers_per_segment(t):
    return rolling.top_k_per_group(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@query("SELECT c_custkey, round(median(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS segment_median, count(*) OVER (PARTITION BY c_mktsegment) AS segment_size FROM customer")
def group_transform(t):
    by = t.customer.groupBy("c_mktsegment").agg(F.round(F.median("c_acctbal"), 4).alias("segment_median"), F.count("*").alias("segment_size"))
    return t.customer.join(by, "c_mktsegment").select("c_custkey", "segment_median", "segment_size")


# Text: words of the invented languages stand in for a lexicon, which is a parameter

LEXICON = {"that": 1.5, "with": 0.5, "this": 1.0, "worthless": -2.5, "from": -0.5, "trash": -2.0, "le": 0.7, "der": -0.7, "que": 0.9, "und": 0.3, "for": -1.0}
NEGATORS, MODIFIERS = ("not", "of", "de"), {"the": 1.3, "a": 0.7, "was": 1.25}


def _sql_map(m: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in m.items()) + "}"


SENTIMENT = rf"""WITH w AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']*') AS ws FROM documents),
  s AS (SELECT doc_id, lang, text, list_transform(ws, lambda x, i: coalesce({_sql_map(LEXICON)}[x], 0)
      * (CASE WHEN list_has_any(ws[greatest(i - 3, 1):i - 1], {list(NEGATORS)}) AND i > 1 THEN -0.75 ELSE 1 END)
      * (CASE WHEN i > 1 THEN coalesce({_sql_map(MODIFIERS)}[ws[i - 1]], 1) ELSE 1 END)) AS sc FROM w),
  t AS (SELECT *, coalesce(list_sum(sc), 0) AS total, least(.1 * (length(text) - length(replace(text, '!', ''))), .3) AS marks FROM s),
  u AS (SELECT *, CASE WHEN len(sc) = 0 THEN 0 WHEN total > 0 THEN total + marks ELSE total - marks END AS v FROM t),
  scored AS (SELECT doc_id, lang, round(v / sqrt(v * v + 15), 4) AS compound, CASE WHEN len(sc) = 0 THEN 0 ELSE round_even(len(list_filter(sc, lambda x: x > 0)) / len(sc), 4) END AS positive,
      CASE WHEN len(sc) = 0 THEN 0 ELSE round_even(len(list_filter(sc, lambda x: x < 0)) / len(sc), 4) END AS negative,
      CASE WHEN len(sc) = 0 THEN 0 ELSE round_even(len(list_filter(sc, lambda x: x = 0)) / len(sc), 4) END AS neutral FROM u),
  labelled AS (SELECT *, CASE WHEN compound >= .2 THEN 'positive' WHEN compound <= -.2 THEN 'negative' ELSE 'neutral' END AS label FROM scored)"""


def scored(t) -> DataFrame:
    return text.lexicon_sentiment(t.documents, "text", LEXICON, NEGATORS, MODIFIERS)


@query(SENTIMENT + " SELECT doc_id, compound, positive, negative, neutral, label, abs(compound) AS confidence FROM labelled")
def lexicon_sentiment(t):
    return scored(t).select("doc_id", "compound", "positive", "negative", "neutral", "label", "confidence")


@query(SENTIMENT + """ SELECT lang, round(avg(compound), 4) AS mean, round(median(compound), 4) AS median, round(stddev_samp(compound), 4) AS std, round(avg((label = 'positive')::INT), 4) AS pct_positive,
  round(avg((label = 'negative')::INT), 4) AS pct_negative, round(avg((label = 'neutral')::INT), 4) AS pct_neutral, count(*) AS n FROM labelled GROUP BY ALL""")
def sentiment_by_language(t):
    return text.sentiment_by(scored(t), "lang")


@query(SENTIMENT + " SELECT doc_id, compound FROM labelled WHERE compound <= -.3")
def flagged_documents(t):
    return text.flagged(scored(t).select("doc_id", "compound"))


STOP = ("the", "and", "that", "with", "for", "from", "this", "was", "are")


@query(rf"""SELECT doc_id, CASE WHEN length(text) >= 5 THEN array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), E' \t\n\r'), '\s+'), lambda x: length(x) > 2 AND NOT list_contains({list(STOP)}, x)), ' ') ELSE '' END AS clean FROM documents""")
def topic_words(t):
    return text.topic_words(t.documents, "text", STOP).select("doc_id", "clean")


@query()
def topic_prevalence(t):
    docs = text.topic_words(t.documents, "text", STOP)
    model = text.fit_topics(docs)
    found = text.dominant_topic(model, docs)
    names = text.label_topics(text.topic_table(model), {"german": ["der", "und", "die"], "french": ["les", "des", "que"], "spanish": ["los", "del", "para"]})
    counts = found.groupBy("topic").agg(F.count("*").alias("documents"))
    return counts.join(names, "topic", "left").select("topic", "documents", "label")


@query()
def topic_weights_by_language(t):
    docs = text.topic_words(t.documents, "text", STOP)
    return text.topic_weights_by(text.dominant_topic(text.fit_topics(docs), docs), "lang")


PUNCT = r"""^[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]+|[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]+$"""
TERMS = rf"list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '{PUNCT}', '', 'g')), lambda x: length(x) > 2)"


SEARCH = f"""WITH dt AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL), qt AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
  idf AS (SELECT term, ln((SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM dt GROUP BY ALL),
  d AS (SELECT doc_id, term, c / max(c) OVER (PARTITION BY doc_id) * idf AS w FROM dt JOIN idf USING (term)), q AS (SELECT item_id, term, c / max(c) OVER (PARTITION BY item_id) * idf AS w FROM qt LEFT JOIN idf USING (term)),
  nd AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM d GROUP BY ALL), nq AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM q GROUP BY ALL),
  sc AS (SELECT item_id AS query_id, doc_id, round(sum(d.w * q.w) / (any_value(nd.n) * any_value(nq.n)), 6) AS score FROM d JOIN q USING (term) JOIN nd USING (doc_id) JOIN nq USING (item_id) GROUP BY ALL)
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 5"""


@query(SEARCH)
def tfidf_search(t):
    return text.tfidf_search(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


@query(SEARCH)
def indexed_search(t):
    return text.indexed_search(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


@query()
def text_classification(t):
    rows = t.documents.select("doc_id", "text").join(t.labels.where("quality IS NOT NULL"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("quality"))
    train, test = ml.hash_split(rows, "doc_id", 0.25)
    return rounded(text.classification_report(text.text_classifier(train, "text", "quality").transform(test), "quality"), "precision", "recall", "f1")


@query("""WITH m AS (SELECT p_brand, max(p_size) AS size, min(p_size) AS low, count(*) AS parts FROM part GROUP BY ALL),
  n AS (SELECT p_brand, string_agg(p_type, ' | ' ORDER BY p_partkey, p_type) AS news FROM part WHERE p_size > 40 GROUP BY ALL)
  SELECT upper(p_brand) AS p_brand, upper(p_brand) || ' Current Price: $' || size || ' (P/E: ' || parts || ')' AS price_text, coalesce(news, 'No recent news available.') AS news, low, parts,
    CASE WHEN size >= 90 THEN 'HIGH' WHEN size >= 50 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM m LEFT JOIN n USING (p_brand)""")
def entity_brief(t):
    """Brands as entities, their larger parts as their news."""
    market = t.part.groupBy("p_brand").agg(F.max("p_size").alias("size"), F.min("p_size").alias("low"), F.count("*").alias("parts"))
    out = text.entity_brief(market, t.part.where("p_size > 40"), "p_brand", "size", "parts", "size", ["low", "parts"], "p_type", "p_partkey")
    return out.select("p_brand", "price_text", "news", "metrics.*", "tier")


# Forecasts: orders of each segment by month

MONTHS = """WITH m AS (SELECT c_mktsegment AS seg, strftime(o_orderdate, '%Y-%m-01') AS month, count(*)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  s AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY seg) AS n FROM m QUALIFY n >= 6)"""


def monthly(t) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("seg"), F.date_format("o_orderdate", "yyyy-MM-01").alias("month")).agg(F.count("*").alias("y"))


TREND = MONTHS + """, l AS (SELECT seg, regr_slope(y, i) AS b, regr_intercept(y, i) AS a, max(n) AS n, max(month) AS last FROM s GROUP BY ALL),
  d AS (SELECT s.*, a, b, i % 12 AS season, y - a - b * i AS rest FROM s JOIN l USING (seg)), se AS (SELECT seg, season, avg(rest) AS seasonal FROM d GROUP BY ALL),
  f AS (SELECT d.seg, month, i, y, a + b * i + seasonal AS fitted FROM d JOIN se USING (seg, season)), sg AS (SELECT seg, stddev_pop(y - fitted) AS sigma FROM f GROUP BY ALL)"""


@query(TREND + " SELECT seg, month, round(fitted, 4) AS fitted FROM f")
def trend_seasonal_fit(t):
    return rounded(forecast.trend_seasonal(monthly(t), "seg", "month", "y")[0].select("seg", "month", "fitted"), "fitted")


@query(TREND + """ SELECT l.seg, step::INT AS step, round(a + b * (n - 1 + step) + seasonal, 4) AS forecast, round(a + b * (n - 1 + step) + seasonal - 1.96 * sigma * sqrt(step), 4) AS lower,
  round(a + b * (n - 1 + step) + seasonal + 1.96 * sigma * sqrt(step), 4) AS upper FROM l JOIN sg USING (seg), range(1, 13) r(step) JOIN se ON se.seg = l.seg AND se.season = (n - 1 + step) % 12""")
def trend_seasonal_forecast(t):
    return rounded(forecast.trend_seasonal(monthly(t), "seg", "month", "y")[1].select("seg", "step", "forecast", "lower", "upper"), "forecast", "lower", "upper")


HOLT = MONTHS.replace("WITH m", "WITH RECURSIVE m") + """, h AS (SELECT s.seg, s.month, s.i, s.y, s.y AS level, s1.y - s.y AS trend, s.y AS fitted FROM s JOIN s s1 ON s1.seg = s.seg AND s1.i = 1 WHERE s.i = 0
  UNION ALL SELECT s.seg, s.month, s.i, s.y, .3 * s.y + .7 * (h.level + h.trend), .1 * (.3 * s.y + .7 * (h.level + h.trend) - h.level) + .9 * h.trend,
    .3 * s.y + .7 * (h.level + h.trend) + .1 * (.3 * s.y + .7 * (h.level + h.trend) - h.level) + .9 * h.trend FROM h JOIN s ON s.seg = h.seg AND s.i = h.i + 1)"""


@query(HOLT + " SELECT seg, month, round(fitted, 4) + 0.0 AS fitted FROM h")
def holt_fit(t):
    return rounded(forecast.holt(monthly(t), "seg", "month", "y")[0].select("seg", "month", "fitted"), "fitted").withColumn("fitted", F.col("fitted") + 0.0)  # no -0


@query(HOLT + """, e AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY seg ORDER BY i DESC) = 1), sg AS (SELECT seg, stddev_pop(y - fitted) AS sigma FROM h GROUP BY ALL)
  SELECT seg, step::INT AS step, round(level + step * trend, 4) AS forecast, round(level + step * trend - 1.96 * sigma * sqrt(step), 4) AS lower, round(level + step * trend + 1.96 * sigma * sqrt(step), 4) AS upper FROM e JOIN sg USING (seg), range(1, 13) r(step)""")
def holt_forecast(t):
    return rounded(forecast.holt(monthly(t), "seg", "month", "y")[1].select("seg", "step", "forecast", "lower", "upper"), "forecast", "lower", "upper")


@query(TREND + " SELECT seg, round(avg(CASE WHEN y <> 0 THEN abs((y - fitted) / y) END) * 100, 2) AS mape, round(sqrt(avg((y - fitted) * (y - fitted))), 2) AS rmse FROM f GROUP BY ALL")
def forecast_metrics(t):
    return forecast.fit_metrics(forecast.trend_seasonal(monthly(t), "seg", "month", "y")[0], "seg")


ERRORS = "avg(CASE WHEN y <> 0 THEN abs((y - fitted) / y) END) * 100"


@query(HOLT + TREND.removeprefix(MONTHS) + f""",
  q AS (SELECT seg, 'trend_seasonal' AS model, 0 AS k, round({ERRORS}, 2) AS mape FROM f GROUP BY seg
        UNION ALL SELECT seg, 'holt', 1, round({ERRORS}, 2) FROM h GROUP BY seg)
  SELECT seg, model, mape FROM q QUALIFY row_number() OVER (PARTITION BY seg ORDER BY mape NULLS FIRST, k) = 1""")
def best_forecast_model(t):
    m = monthly(t)
    parts = [(n, forecast.fit_metrics(f(m, "seg", "month", "y")[0], "seg")) for n, f in (("trend_seasonal", forecast.trend_seasonal), ("holt", forecast.holt))]
    return forecast.best_model(parts, "seg")


@query(TREND + """, p AS (SELECT l.seg, last, step::INT AS step, a + b * (n - 1 + step) + seasonal AS v, 1.96 * sigma * sqrt(step) AS margin
    FROM l JOIN sg USING (seg), range(1, 13) r(step) JOIN se ON se.seg = l.seg AND se.season = (n - 1 + step) % 12)
  SELECT seg, (last::DATE + to_months(step))::DATE::VARCHAR AS date, step, round_even(v, 0)::BIGINT AS forecast,
    round_even(v - margin, 0)::BIGINT AS lower, round_even(v + margin, 0)::BIGINT AS upper FROM p""")
def forecast_dates(t):
    return as_text(forecast.forecast_table(forecast.trend_seasonal(monthly(t), "seg", "month", "y")[1], "seg"), "date")


RATES = MONTHS + """, r AS (SELECT seg, max_by(y, month)::BIGINT * 10 AS current, round(avg(y), 2) AS avg_hires, round(avg(y * .9), 2) AS avg_departures,
  round(avg(y) / avg(y * 10), 4) AS hire_rate, round(avg(y * .9) / avg(y * 10), 4) AS departure_rate FROM m GROUP BY ALL HAVING count(*) >= 3)"""


def rates(t) -> DataFrame:
    flows = monthly(t).selectExpr("seg", "month", "CAST(y * 10 AS BIGINT) AS headcount", "y AS hires", "y * 0.9D AS departures")
    return forecast.baseline_rates(flows, "seg", "month", "headcount", "hires", "departures")


@query(RATES + " SELECT * FROM r")
def baseline_rates(t):
    return rates(t)


SCENARIOS = [("baseline", 1.0, 1.0, 0.0, 0.0, 0, 1.0), ("freeze", 1.0, 1.0, 0.0, 0.0, 6, 0.0), ("cut", 0.5, 1.2, 0.1, 0.0, 0, 1.0), ("growth", 1.1, 0.9, 0.0, 120.0, 0, 1.0)]


def simulated(t) -> DataFrame:
    plans = t.spark.createDataFrame(SCENARIOS, "scenario string, hire_multiplier double, departure_multiplier double, reduction double, growth double, freeze_months int, freeze_multiplier double")
    return forecast.simulate(rates(t), plans, "seg")


SIMULATION = RATES.replace("WITH m", "WITH RECURSIVE m") + f""", sc(scenario, hm, dm, red, growth, fm, fx) AS (VALUES {', '.join(str(x) for x in SCENARIOS)}),
  z AS (SELECT seg, scenario, current, hire_rate, departure_rate, hm, dm, growth, fm, fx, 0 AS month, current - trunc(current * red)::BIGINT AS hc, 0::BIGINT AS hires, 0::BIGINT AS departures FROM r, sc
    UNION ALL SELECT seg, scenario, current, hire_rate, departure_rate, hm, dm, growth, fm, fx, month + 1,
      greatest(1, hc + greatest(0, trunc((hire_rate * hc * hm + growth / 12) * (CASE WHEN month + 1 <= fm THEN fx ELSE 1 END))::BIGINT) - greatest(0, trunc(departure_rate * hc * dm)::BIGINT)),
      greatest(0, trunc((hire_rate * hc * hm + growth / 12) * (CASE WHEN month + 1 <= fm THEN fx ELSE 1 END))::BIGINT), greatest(0, trunc(departure_rate * hc * dm)::BIGINT) FROM z WHERE month < 12)"""


@query(SIMULATION + " SELECT seg, scenario, current, month, hc AS headcount, hires, departures FROM z WHERE month > 0")
def simulate_scenarios(t):
    return simulated(t)


@query(SIMULATION + """, e AS (SELECT seg, scenario, any_value(current) AS current, max_by(hc, month) AS final, sum(hires)::BIGINT AS hires, sum(departures)::BIGINT AS departures FROM z WHERE month > 0 GROUP BY ALL)
  SELECT scenario, sum(current)::BIGINT AS current, sum(final)::BIGINT AS final, sum(hires)::BIGINT AS hires, sum(departures)::BIGINT AS departures, (sum(final) - sum(current))::BIGINT AS net_change, round((sum(final) - sum(current)) * 100.0 / sum(current), 1) AS pct_change FROM e GROUP BY ALL""")
def compare_scenarios(t):
    return forecast.compare_scenarios(simulated(t), "seg")


@query(SIMULATION + " SELECT scenario, seg, max_by(hc, month) AS final, any_value(current) AS current, max_by(hc, month) - any_value(current) AS net_change FROM z WHERE month > 0 GROUP BY ALL")
def scenario_impact(t):
    return forecast.impact_by_key(simulated(t), "seg")
