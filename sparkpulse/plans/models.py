"""Queries of fairness, governance, graph, model and streaming-twin operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fairness, graph, ml
from ..operators.medallion import dedupe_exact
from ..sources.io import stored
from ..streaming import jobs
from .registry import query
from .tables import rounded

ATTRIBUTES = ["lang", "part", "size"]


def judged(t) -> DataFrame:
    """Labelled documents: quality as the prediction, absence of toxicity as the outcome, and three attributes."""
    labels = dedupe_exact(t.labels, ["doc_id"])
    docs = t.documents.select("doc_id", "lang", F.concat(F.lit("p"), F.substring("source", 4, 9).cast("int") % 4).alias("part"),
                              F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long").alias("size"), F.log("n_chars").alias("log_chars"), (F.col("doc_id") % 13).cast("double").alias("noise"))
    return docs.join(labels, "doc_id").select("*", (1 - F.col("toxic")).alias("actual"))


JUDGED = """WITH j AS (SELECT doc_id, lang, 'p' || (substring(source, 4)::INT % 4) AS part, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS size,
  ln(n_chars) AS log_chars, (doc_id % 13)::DOUBLE AS noise, quality, toxic, 1 - toxic AS actual FROM documents JOIN labels USING (doc_id)),
  melted AS (SELECT 'lang' AS attribute, lang AS value, quality, actual FROM j UNION ALL SELECT 'part', part, quality, actual FROM j UNION ALL SELECT 'size', size, quality, actual FROM j)"""
PARITY = JUDGED + """, rates AS (SELECT attribute, value, round(avg(quality), 4) AS rate, count(*) AS n FROM melted GROUP BY ALL),
  parity AS (SELECT attribute, value, rate, n, round(rate - (SELECT avg(quality) FROM j), 4) AS deviation, rate / max(rate) OVER (PARTITION BY attribute) >= .8 AS passes,
    round(min(rate) OVER (PARTITION BY attribute) / max(rate) OVER (PARTITION BY attribute), 4) AS disparate_impact FROM rates)"""
ODDS = PARITY + """, cm AS (SELECT attribute, value, count(*) AS n, count(*) FILTER (quality = 1 AND actual = 1) AS tp, count(*) FILTER (quality = 1 AND actual = 0) AS fp, count(*) FILTER (quality = 0 AND actual = 0) AS tn, count(*) FILTER (quality = 0 AND actual = 1) AS fn FROM melted GROUP BY ALL),
  rt AS (SELECT attribute, value, n, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS tpr, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS fpr, round(coalesce(tn / nullif(fp + tn, 0), 0), 4) AS tnr, round(coalesce(fn / nullif(tp + fn, 0), 0), 4) AS fnr, round((tp + tn) / n, 4) AS accuracy FROM cm),
  odds AS (SELECT *, round(max(tpr) OVER (PARTITION BY attribute) - min(tpr) OVER (PARTITION BY attribute), 4) AS tpr_gap, round(max(fpr) OVER (PARTITION BY attribute) - min(fpr) OVER (PARTITION BY attribute), 4) AS fpr_gap FROM rt)"""


@query(PARITY + " SELECT * FROM parity")
def demographic_parity(t):
    return fairness.demographic_parity(judged(t), "quality", ATTRIBUTES)


@query(ODDS + " SELECT *, tpr_gap <= .1 AND fpr_gap <= .1 AS passes FROM odds")
def equalized_odds(t):
    return fairness.equalized_odds(judged(t), "quality", "actual", ATTRIBUTES)


CROSS = JUDGED + """, pairs AS (SELECT 'lang x part' AS pair, lang AS first, part AS second, quality FROM j UNION ALL SELECT 'lang x size', lang, size, quality FROM j UNION ALL SELECT 'part x size', part, size, quality FROM j),
  g AS (SELECT pair, first, second, round(avg(quality), 4) AS rate, count(*) AS n, round(avg(quality) - (SELECT avg(quality) FROM j), 4) AS deviation, round(avg(quality) / (SELECT avg(quality) FROM j), 4) AS relative_risk FROM pairs GROUP BY ALL HAVING count(*) >= 30)"""


@query(CROSS + " SELECT * FROM g")
def intersectional_disparity(t):
    return fairness.intersectional(judged(t), "quality", ATTRIBUTES)


@query(CROSS + " SELECT pair, round(max(rate) - min(rate), 4) AS max_gap, max_by(first || ' & ' || second, (rate, first || ' & ' || second)) AS best, min_by(first || ' & ' || second, (rate, first || ' & ' || second)) AS worst FROM g GROUP BY ALL")
def intersectional_gaps(t):
    return fairness.intersectional_gaps(fairness.intersectional(judged(t), "quality", ATTRIBUTES))


@query(JUDGED + ", r AS (SELECT lang, size, CASE WHEN count(*) >= 30 THEN round(avg(quality), 4) END AS rate FROM j GROUP BY ALL) SELECT lang, max(rate) FILTER (size = 'short') AS short, max(rate) FILTER (size = 'middle') AS middle, max(rate) FILTER (size = 'long') AS long FROM r GROUP BY ALL")
def rate_pivot(t):
    return fairness.rate_pivot(judged(t), "lang", "size", "quality", ["short", "middle", "long"])


@query(JUDGED + " SELECT lang, round(avg(log_chars), 6) AS mean, round(stddev_samp(log_chars), 6) AS std, round(median(log_chars), 6) AS median, count(log_chars) AS n FROM j GROUP BY ALL")
def group_distribution(t):
    return rounded(fairness.group_distribution(judged(t), "log_chars", "lang"), "mean", "std", "median", digits=6)


FEATURES, WEIGHTS, BIAS = ["log_chars", "noise", "toxic"], {"log_chars": 0.9, "noise": -0.05, "toxic": -1.5}, -6.5


@query(JUDGED + """, m AS (SELECT avg(log_chars) AS a, avg(noise) AS b, avg(toxic) AS c FROM j), z AS (SELECT *, -6.5 + .9 * log_chars - .05 * noise - 1.5 * toxic AS z FROM j, m),
  p AS (SELECT doc_id, 'log_chars' AS feature, 1 / (1 + exp(-z)) - 1 / (1 + exp(-(z - .9 * (log_chars - a)))) AS contribution FROM z UNION ALL SELECT doc_id, 'noise', 1 / (1 + exp(-z)) - 1 / (1 + exp(-(z + .05 * (noise - b)))) FROM z
    UNION ALL SELECT doc_id, 'toxic', 1 / (1 + exp(-z)) - 1 / (1 + exp(-(z + 1.5 * (toxic - c)))) FROM z) SELECT doc_id, feature, round(contribution, 6) AS contribution FROM p WHERE contribution <> 0""")
def local_contributions(t):
    return rounded(fairness.local_contributions(judged(t), "doc_id", FEATURES, WEIGHTS, BIAS), "contribution", digits=6)


#: One greedy step a round: each feature's move and gain, the first of the largest gains taken.
COUNTERFACTUALS = JUDGED.replace("WITH j", "WITH RECURSIVE j") + """,
  x AS (SELECT doc_id, log_chars AS a0, noise AS b0, toxic::DOUBLE AS c0, log_chars AS a, noise AS b, toxic::DOUBLE AS c, 0 AS n, true AS go
        FROM j WHERE .9 * log_chars - .05 * noise - 1.5 * toxic - 6.5 <= 0
    UNION ALL SELECT doc_id, a0, b0, c0, CASE WHEN k = 1 THEN a + ma ELSE a END, CASE WHEN k = 2 THEN b - mb ELSE b END, CASE WHEN k = 3 THEN c - mc ELSE c END, n + 1, true
      FROM (SELECT *, CASE WHEN ga >= gb AND ga >= gc THEN 1 WHEN gb >= gc THEN 2 ELSE 3 END AS k FROM (
        SELECT *, CASE WHEN abs(ma) > 1e-12 THEN ma * .9 ELSE 0 END AS ga, CASE WHEN abs(mb) > 1e-12 THEN mb * .05 ELSE 0 END AS gb, CASE WHEN abs(mc) > 1e-12 THEN mc * 1.5 ELSE 0 END AS gc
        FROM (SELECT *, least(1.2::DOUBLE, 12 - a) AS ma, least(1.2::DOUBLE, b) AS mb, least(.1::DOUBLE, c) AS mc FROM x WHERE n < 50 AND .9 * a - .05 * b - 1.5 * c - 6.5 <= 0)))
      WHERE greatest(ga, gb, gc) > 1e-12),
  e AS (SELECT *, .9 * a - .05 * b - 1.5 * c - 6.5 AS z FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)
  SELECT doc_id, z > 0 AS flipped, n AS n_steps, round(1 / (1 + exp(-z)), 6) AS probability,
    concat_ws(';', CASE WHEN a <> a0 THEN format('log_chars:{:.4g}->{:.4g}', a0, a) END, CASE WHEN b <> b0 THEN format('noise:{:.4g}->{:.4g}', b0, b) END,
      CASE WHEN c <> c0 THEN format('toxic:{:.4g}->{:.4g}', c0, c) END) AS changes FROM e"""


@query(COUNTERFACTUALS)
def counterfactuals(t):
    return rounded(fairness.counterfactuals(judged(t), "doc_id", FEATURES, WEIGHTS, BIAS, {"log_chars": (0.0, 12.0), "noise": (0.0, 12.0), "toxic": (0.0, 1.0)}), "probability", digits=6)


#: Rows in the order of ids take the features of rows in the order of MD5 sums, five times.
PERMUTED = JUDGED + """,
  p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM j),
  o AS (SELECT r, log_chars AS a, noise AS b, toxic AS c, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || doc_id), doc_id) AS pos FROM j, range(5) x(r)),
  m AS (SELECT r, unnest(['log_chars', 'noise', 'toxic']) AS feature, quality,
    unnest([.9 * a - .05 * noise - 1.5 * toxic, .9 * log_chars - .05 * b - 1.5 * toxic, .9 * log_chars - .05 * noise - 1.5 * c]) - 6.5 > 0 AS told FROM p JOIN o USING (pos)),
  l AS (SELECT feature, r, (SELECT avg(((.9 * log_chars - .05 * noise - 1.5 * toxic - 6.5 > 0)::INT = quality)::INT) FROM j) - avg((told::INT = quality)::INT) AS lost FROM m GROUP BY ALL)
  SELECT feature, round(avg(lost), 6) AS importance, round(stddev_pop(lost), 6) AS std FROM l GROUP BY ALL"""


@query(PERMUTED)
def permutation_importance(t):
    told = (fairness.linear(FEATURES, WEIGHTS, BIAS) > 0).cast("int")
    return rounded(fairness.permutation_importance(judged(t), "doc_id", FEATURES, "quality", lambda df: df.withColumn("prediction", told)), "importance", "std", digits=6)


@query()
def fitted_importance(t):
    """Of a logistic model that is fitted on the same rows."""
    rows = stored(judged(t).select("doc_id", *FEATURES, F.col("quality").cast("double").alias("quality")), "judged")
    model = ml.logistic_pipeline(FEATURES, [], "quality", rows.count()).fit(rows)
    return rounded(fairness.permutation_importance(rows, "doc_id", FEATURES, "quality", model.transform), "importance", "std", digits=6)


@query()
def minimal_features(t):
    return rounded(ml.minimal_features(churn(t), "c_custkey", ["c_acctbal", "n", "mean_total"], "left"), "score", "drop", digits=6)


CORR = JUDGED + ", c AS (SELECT unnest(['log_chars', 'noise', 'toxic']) AS feature, unnest([corr(log_chars, quality), corr(noise, quality), corr(toxic, quality)]) AS r, unnest([.9, .05, 1.5]) AS w FROM j)"


@query(CORR + " SELECT feature, round(r, 6) AS correlation FROM c")
def correlation_importance(t):
    return rounded(fairness.correlation_importance(judged(t), FEATURES, "quality"), "correlation", digits=6)


@query(CORR + " SELECT feature, round(.6 * w / (SELECT max(w) FROM c) + .4 * abs(r) / (SELECT max(abs(r)) FROM c), 6) AS combined FROM c")
def combined_importance(t):
    a = fairness.coefficient_importance(t.spark, WEIGHTS)
    return rounded(fairness.combined_importance(a, fairness.correlation_importance(judged(t), FEATURES, "quality")), "combined", digits=6)


@query(ODDS + """ SELECT CASE WHEN NOT bool_and(passes) THEN 'RED' WHEN bool_or(disparate_impact BETWEEN .8 AND .85) THEN 'AMBER' ELSE 'GREEN' END AS parity_status,
  (SELECT CASE WHEN bool_and(tpr_gap <= .1 AND fpr_gap <= .1) THEN 'GREEN' WHEN max(greatest(tpr_gap, fpr_gap)) <= .2 THEN 'AMBER' ELSE 'RED' END FROM odds) AS odds_status FROM parity""")
def fairness_scorecard(t):
    j = judged(t)
    return fairness.fairness_scorecard(fairness.demographic_parity(j, "quality", ATTRIBUTES), fairness.equalized_odds(j, "quality", "actual", ATTRIBUTES))


@query(PARITY + " SELECT attribute, CASE WHEN bool_and(passes) THEN 'GREEN' ELSE 'RED' END AS status, count(*) AS checks FROM parity GROUP BY ALL")
def pillar_status(t):
    rows = fairness.demographic_parity(judged(t), "quality", ATTRIBUTES).withColumn("status", F.when(F.col("passes"), "GREEN").otherwise("RED"))
    return fairness.worst_status(rows, ["attribute"])


def audit(t) -> DataFrame:
    return t.events.select(F.col("user_id").alias("model"), "ts", F.col("event_type").alias("action"), "event_id", (F.col("value") < 300).alias("passed"))


@query("SELECT event_type AS action, count(*) AS entries, count(DISTINCT user_id) AS models, count(*) FILTER (value >= 300) AS failures FROM events GROUP BY ALL")
def audit_summary(t):
    return fairness.audit_summary(audit(t))


@query("SELECT user_id AS model, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_audit_for_model(t):
    return fairness.latest_for_model(audit(t), "error").select("model", "event_id")


# Graph: customers' nations order from suppliers' nations


def trade(t) -> DataFrame:
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).join(
        t.supplier.select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select("src", "dst", F.col("l_quantity").alias("duration"), "l_returnflag", (F.col("src") != F.col("dst")).alias("crosses"))


TRADE = """WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_quantity AS duration, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
  c AS (SELECT src, dst, count(*) AS c FROM e GROUP BY ALL HAVING count(*) >= 100), w AS (SELECT src, dst, sum(c)::BIGINT AS weight FROM (SELECT src, dst, c FROM c UNION ALL SELECT dst, src, c FROM c WHERE src <> dst) GROUP BY ALL)"""


@query(TRADE + """, k AS (SELECT src, dst, string_agg(l_returnflag || ':' || c, ',' ORDER BY l_returnflag) AS kinds
    FROM (SELECT src, dst, l_returnflag, count(*) AS c FROM e GROUP BY ALL) GROUP BY ALL)
  SELECT src, dst, count(*) AS n, round(sum(duration), 2) AS total, round(avg(duration), 6) AS mean, any_value(kinds) AS kinds
  FROM e JOIN k USING (src, dst) GROUP BY src, dst HAVING count(*) >= 100""")
def pair_stats(t):
    stats = graph.pair_stats(trade(t), "src", "dst", "duration", "l_returnflag", 100)
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e.key, F.lit(":"), e.value.cast("string"))), ",")
    return rounded(rounded(stats, "total", digits=2), "mean", digits=6).withColumn("kinds", kinds)


def network(t) -> DataFrame:
    return graph.build_network(trade(t), "src", "dst", 100)


@query(TRADE + " SELECT * FROM w")
def build_network(t):
    return network(t)


@query(TRADE + """ SELECT src AS node, count(*) FILTER (src <> dst) AS degree, sum(weight)::BIGINT AS total, coalesce(sum(weight) FILTER (src = dst), 0)::BIGINT AS internal,
  (sum(weight) - coalesce(sum(weight) FILTER (src = dst), 0))::BIGINT AS strength, round(coalesce(sum(weight) FILTER (src = dst), 0) / sum(weight), 6) AS internal_ratio FROM w GROUP BY ALL""")
def node_metrics(t):
    return rounded(graph.node_metrics(network(t)), "internal_ratio", digits=6)


@query(TRADE + """, n AS (SELECT count(DISTINCT src) AS nodes FROM w) SELECT (SELECT nodes FROM n) AS nodes, count(*) AS edges, round(avg(weight), 6) AS mean_weight, (SELECT round(avg((src <> dst)::INT), 6) FROM e) AS cross_share,
  coalesce(round(count(*) / nullif(any_value(nodes) * (any_value(nodes) - 1), 0), 6), 0) AS density, coalesce(round(count(*) / nullif(any_value(nodes), 0), 6), 0) AS mean_degree FROM w, n WHERE src <> dst""")
def network_metrics(t):
    return rounded(graph.network_metrics(network(t), trade(t), "crosses"), "mean_weight", "cross_share", "density", "mean_degree", digits=6)


@query(TRADE + " SELECT src AS node, round(count(*) FILTER (src <> dst) / ((SELECT count(DISTINCT src) FROM w) - 1), 6) AS degree_centrality FROM w GROUP BY ALL")
def degree_centrality(t):
    return rounded(graph.degree_centrality(network(t)), "degree_centrality", digits=6)


#: Power iteration with one round a step, and least paths by (length, nodes) that grow by one edge a step.
CENTRALITY = TRADE.replace("WITH e", "WITH RECURSIVE e") + """, nodes AS (SELECT DISTINCT src AS node FROM w), size AS (SELECT count(*) AS n FROM nodes),
  pw AS (SELECT 0 AS k, node, (SELECT n FROM size) ** -.5 AS x, 1.0::DOUBLE AS moved FROM nodes
    UNION ALL SELECT k + 1, node, y / norm, sqrt(greatest(0, 2 - 2 * xy / norm)) FROM (
      SELECT *, sqrt(sum(y * y) OVER ()) AS norm, sum(x * y) OVER () AS xy FROM (
        SELECT p.k, p.node, p.x, sum(w.weight * q.x) AS y FROM pw p JOIN w ON w.src = p.node JOIN pw q ON q.node = w.dst WHERE p.k < 100 AND p.moved >= 1e-6 GROUP BY ALL))),
  eig AS (SELECT node, x FROM pw QUALIFY k = max(k) OVER ()),
  ed AS (SELECT src, dst, (SELECT max(weight)::DOUBLE FROM w WHERE src <> dst) / weight AS d FROM w WHERE src <> dst),
  walk AS (SELECT 0 AS k, node AS source, node, {'d': 0.0::DOUBLE, 'p': [node]} AS best FROM nodes
    UNION ALL SELECT k + 1, source, node, min(best) FROM (
      SELECT k, source, node, best FROM walk UNION ALL SELECT k, source, ed.dst, {'d': best.d + ed.d, 'p': list_append(best.p, ed.dst)} FROM walk JOIN ed ON ed.src = walk.node)
      WHERE k < (SELECT n - 1 FROM size) GROUP BY ALL),
  inner_nodes AS (SELECT unnest(best.p[2:-2]) AS node FROM walk WHERE k = (SELECT n - 1 FROM size)),
  btw AS (SELECT node, count(i.node) / greatest((n - 1) * (n - 2), 1)::DOUBLE AS b FROM nodes LEFT JOIN inner_nodes i USING (node), size GROUP BY node, n),
  deg AS (SELECT src AS node, count(*) FILTER (src <> dst) / (SELECT n - 1 FROM size) AS g FROM w GROUP BY ALL),
  cuts AS (SELECT quantile_cont(g, .75) AS g75, median(g) AS g50, median(b) AS b50 FROM deg JOIN btw USING (node)),
  profile AS (SELECT node, g, b, x, .3 * g + .4 * b + .3 * x AS influence, CASE WHEN b > b50 AND g < g50 THEN 'bottleneck' WHEN b > b50 AND g > g50 THEN 'connector'
    WHEN g > g75 THEN 'hub' ELSE 'peripheral' END AS role FROM deg JOIN btw USING (node) JOIN eig USING (node), cuts)"""


@query(CENTRALITY + " SELECT node, round(x, 5) AS eigenvector FROM eig")
def eigenvector_centrality(t):
    return rounded(graph.eigenvector_centrality(network(t)), "eigenvector", digits=5)


@query(CENTRALITY + " SELECT node, round(g, 5) AS degree_centrality, round(b, 5) AS betweenness, round(x, 5) AS eigenvector, round(influence, 5) AS influence, role FROM profile")
def influence_profile(t):
    e = stored(network(t), "network")
    return rounded(graph.influence_profile(graph.degree_centrality(e), graph.betweenness(e), graph.eigenvector_centrality(e)), "degree_centrality", "betweenness", "eigenvector", "influence", digits=5)


@query()
def silo_report(t):
    e = stored(network(t), "network")
    return rounded(graph.silo_report(e, graph.communities(e, 3)), "mean_internal", "internal_ratio", digits=6)


@query(TRADE + """, x AS (SELECT a.n_regionkey AS community, b.n_regionkey AS other, weight FROM w JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE src <> dst),
  m AS (SELECT n_regionkey AS community, count(*) AS members FROM nation WHERE n_nationkey IN (SELECT src FROM w) GROUP BY ALL),
  r AS (SELECT community, avg(weight) FILTER (community = other) AS mean_internal, count(*) FILTER (community <> other) AS external_links, coalesce(sum(weight) FILTER (community = other), 0) / sum(weight) AS share FROM x GROUP BY ALL)
  SELECT community, members, round(coalesce(mean_internal, 0), 6) AS mean_internal, coalesce(external_links, 0) AS external_links, round(coalesce(share, 0), 6) AS internal_ratio, coalesce(share, 0) >= .2 AS is_silo,
    CASE WHEN coalesce(share, 0) >= .2 THEN 'start work across groups' ELSE 'keep links alive' END AS recommendation FROM m LEFT JOIN r USING (community)""")
def silo_by_region(t):
    """The report for communities that are given: the nations of a region."""
    e = network(t)
    of = graph.nodes_of(e).join(t.nation, F.col("node") == F.col("n_nationkey")).select("node", F.col("n_regionkey").alias("community"))
    return rounded(graph.silo_report(e, of, 0.2), "mean_internal", "internal_ratio", digits=6)


@query("SELECT DISTINCT n AS node FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def network_nodes(t):
    return graph.nodes_of(t.customer.select(F.col("c_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).unionByName(t.supplier.select(F.col("s_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))))


# Models


def prices(t) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "p_retailprice", F.col("p_size").cast("double").alias("p_size"), "l_extendedprice")


#: Least squares by making each feature orthogonal to those before; four fifths of the rows by hash are learned from.
LEAST_SQUARES = """WITH r AS (SELECT ('0x' || substr(md5('42:' || (l_orderkey * 10 + l_linenumber)), 1, 8))::BIGINT % 1000 >= 200 AS train, l_quantity::DOUBLE AS a, p_retailprice::DOUBLE AS b, p_size::DOUBLE AS c, l_extendedprice::DOUBLE AS y
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  m AS (SELECT r.*, a - avg(a) FILTER (train) OVER () AS u, avg(y) FILTER (train) OVER () AS mean FROM r),
  n AS (SELECT *, b - avg(b) FILTER (train) OVER () - u * (sum(u * b) FILTER (train) OVER () / sum(u * u) FILTER (train) OVER ()) AS v FROM m),
  o AS (SELECT *, c - avg(c) FILTER (train) OVER () - u * (sum(u * c) FILTER (train) OVER () / sum(u * u) FILTER (train) OVER ()) - v * (sum(v * c) FILTER (train) OVER () / sum(v * v) FILTER (train) OVER ()) AS w FROM n),
  p AS (SELECT train, y, mean + u * (sum(u * y) FILTER (train) OVER () / sum(u * u) FILTER (train) OVER ()) + v * (sum(v * y) FILTER (train) OVER () / sum(v * v) FILTER (train) OVER ())
    + w * (sum(w * y) FILTER (train) OVER () / sum(w * w) FILTER (train) OVER ()) AS told FROM o)
  SELECT round(avg(abs(y - told)), 4) AS mae, round(sqrt(avg(pow(y - told, 2))), 4) AS rmse, round(1 - sum(pow(y - told, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM p WHERE NOT train"""


@query(LEAST_SQUARES)
def price_regression(t):
    found = ml.linear_regression(prices(t), "id", ["l_quantity", "p_retailprice", "p_size"], "l_extendedprice")[1]
    return rounded(rounded(found, "mae", "rmse", digits=4), "r2", digits=6)


def churn(t) -> DataFrame:
    by = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("mean_total"), F.max("o_orderdate").alias("last"))
    return t.customer.join(by, "c_custkey").select("c_custkey", "c_mktsegment", "c_acctbal", "n", "mean_total", (F.col("last") < F.lit("2000-06-01").cast("timestamp_ntz")).cast("double").alias("left"))


@query()
def churn_classification(t):
    rows = stored(churn(t), "churn")
    train, test = ml.hash_split(rows, "c_custkey", 0.25)
    model = ml.logistic_pipeline(["c_acctbal", "n", "mean_total"], ["c_mktsegment"], "left", train.count()).fit(train)
    return ml.binary_metrics(model.transform(test), F.col("prediction"), F.col("left"))


@query()
def churn_roc(t):
    rows = stored(churn(t), "churn")
    train, test = ml.hash_split(rows, "c_custkey", 0.25)
    model = ml.logistic_pipeline(["c_acctbal", "n", "mean_total"], ["c_mktsegment"], "left", train.count()).fit(train)
    return rounded(ml.roc_points(ml.probability(model.transform(test)), "p", "left", 20), "tpr", "fpr", digits=6)


@query()
def churn_cross_validation(t):
    rows = stored(churn(t), "churn")
    return rounded(ml.cross_validate_auc(rows, "c_custkey", ml.logistic_pipeline(["c_acctbal", "n", "mean_total"], ["c_mktsegment"], "left", rows.count()), "left", 3), "auc", "std", digits=6)


@query()
def feature_necessity(t):
    return rounded(ml.feature_necessity(churn(t), "c_custkey", ["c_acctbal", "n", "mean_total"], "left", k=3), "accuracy_without", "drop", digits=6)


@query()
def attrition_risk(t):
    return ml.attrition_risk(churn(t), ["c_acctbal", "n", "mean_total"], ["c_mktsegment"], "left")[0].select("c_custkey", "risk", "band")


@query()
def attrition_importance(t):
    return rounded(ml.attrition_risk(churn(t), ["c_acctbal", "n", "mean_total"], ["c_mktsegment"], "left")[1], "coefficient", digits=6)


@query("""SELECT c_mktsegment, round_even(avg(((c_acctbal + 1000) / 11000)::DOUBLE), 4) AS mean_risk, count(*) FILTER ((c_acctbal + 1000) / 11000 >= .7) AS high_risk,
  round_even(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END), 4) AS attrition_rate FROM customer GROUP BY ALL""")
def department_risk(t):
    scored = t.customer.withColumn("risk", (F.col("c_acctbal") + 1000) / 11000)
    return ml.department_risk(scored, "c_mktsegment", "risk", F.col("c_acctbal") >= 0)


@query("""SELECT user_id % 5 AS site, count(*) FILTER (value > 250) AS predicted, count(*) FILTER (event_type = 'error') AS actual,
  round(avg(value) FILTER (event_type = 'error'), 6) AS mean_error_anomaly, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_error_normal FROM events GROUP BY ALL""")
def detection_summary(t):
    rows = t.events.withColumns({"site": F.col("user_id") % 5, "p": (F.col("value") > 250).cast("int"), "a": (F.col("event_type") == "error").cast("int")})
    return rounded(ml.detection_summary(rows, F.col("p"), F.col("a"), "value", ["site"]), "mean_error_anomaly", "mean_error_normal", digits=6)


@query(CENTRALITY + " SELECT node, role, role = 'bottleneck' AS is_bottleneck FROM profile ORDER BY b DESC, node LIMIT 5")
def network_connectors(t):
    e = stored(network(t), "network")
    profile = graph.influence_profile(graph.degree_centrality(e), graph.betweenness(e), graph.eigenvector_centrality(e))
    return graph.connectors(profile, 5).select("node", "role").withColumn("is_bottleneck", F.col("role") == "bottleneck")


@query(CENTRALITY + " SELECT node, round(b, 5) AS betweenness FROM profile WHERE role = 'bottleneck'")
def network_bottlenecks(t):
    e = stored(network(t), "network")
    profile = graph.influence_profile(graph.degree_centrality(e), graph.betweenness(e), graph.eigenvector_centrality(e))
    return rounded(graph.bottlenecks(profile).select("node", "betweenness"), "betweenness", digits=5)


SENSORS = ["temperature", "vibration", "pressure", "rpm", "power"]


def readings(t) -> DataFrame:
    """Five sensors of each event: its value and, since the table has one value only, four numbers made of its id and value."""
    k, v = F.col("event_id"), F.col("value")
    return t.events.select("event_id", "user_id", "ts", "event_type", v.alias("temperature"), (k % 97).cast("double").alias("vibration"), (v * (k % 7)).alias("pressure"), (k % 1009 + v / 10).alias("rpm"), F.sqrt(F.abs(v)).alias("power"))


@query()
def anomaly_pipeline(t):
    """Five sensors' readings of each event, 80 rolling features of a user's line and the readings themselves; ends in alerts."""
    out = ml.anomaly_pipeline(readings(t), "user_id", "ts", "event_id", SENSORS, {"temperature": (0.0, 1e6), "vibration": (0.0, 96.0)}, F.col("event_type") == "error", trees=50)
    return rounded(out["alerts"], "risk", digits=6)


@query()
def isolation_forest(t):
    """All components of the embeddings, as they lie in their array."""
    forest = ml.isolation_forest(t.embeddings, "vec_id", "embedding", trees=100)
    return rounded(ml.flag_anomalies(stored(ml.anomaly_scores(t.embeddings.select("vec_id", "embedding"), forest).select("vec_id", "score"), "scores")).select("vec_id", "score", "risk", "is_anomaly"), "score", "risk", digits=6)


@query()
def autoencoder_errors(t):
    model = ml.autoencoder(t.embeddings, "vec_id", "embedding", hidden=4, epochs=8)
    return rounded(ml.reconstruction_errors(t.embeddings.select("vec_id", "embedding"), model).select("vec_id", "error").transform(stored, "errors").transform(ml.flag_errors), "error", "threshold", digits=5)


def halves(t) -> tuple[DataFrame, DataFrame]:
    wide = t.events.select("ts", "value", (F.col("event_id") % 97).cast("double").alias("second"))
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return wide.where(F.col("ts") < middle), wide.where(F.col("ts") >= middle)


KS = """WITH m AS (SELECT 'value' AS feature, value AS v, (ts < TIMESTAMP '2024-01-16') AS old FROM events UNION ALL SELECT 'second', (event_id % 97)::DOUBLE, (ts < TIMESTAMP '2024-01-16') FROM events),
  c AS (SELECT feature, v, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM m GROUP BY ALL),
  w AS (SELECT feature, abs(sum(r) OVER x / sum(r) OVER y - sum(c) OVER x / sum(c) OVER y) AS gap FROM c WINDOW x AS (PARTITION BY feature ORDER BY v), y AS (PARTITION BY feature)),
  d AS (SELECT feature, max(gap) AS d FROM w GROUP BY ALL), n AS (SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events),
  l AS (SELECT feature, d, (sqrt(a * b / (a + b)) + .12 + .11 / sqrt(a * b / (a + b))) * d AS l FROM d, n),
  p AS (SELECT feature, d, CASE WHEN l < .2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * l * l))))) END AS p FROM l)"""


@query(KS + " SELECT feature, round(d, 4) AS statistic, round(p, 6) AS p_value, p < .05 AS drifted FROM p")
def ks_drift(t):
    return ml.ks_drift(*halves(t), ["value", "second"])


@query(KS + " SELECT count(*) AS features, count(*) FILTER (p < .05) AS n_drifted, round(max(d), 4) AS max_statistic, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (p < .05), '') AS names, count(*) FILTER (p < .05) > .3 * count(*) AS retrain FROM p")
def drift_summary(t):
    return ml.drift_summary(ml.ks_drift(*halves(t), ["value", "second"]))


@query("""WITH c AS (SELECT user_id % 5 AS site, count(*) FILTER (value > 250 AND event_type = 'error') AS tp, count(*) FILTER (value > 250 AND event_type <> 'error') AS fp, count(*) FILTER (value <= 250 AND event_type = 'error') AS fn, count(*) FILTER (value <= 250 AND event_type <> 'error') AS tn FROM events GROUP BY ALL)
  SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""")
def binary_metrics(t):
    rows = t.events.select((F.col("user_id") % 5).alias("site"), (F.col("value") > 250).cast("int").alias("p"), (F.col("event_type") == "error").cast("int").alias("a"))
    return ml.binary_metrics(rows, F.col("p"), F.col("a"), ["site"])


def alerts(t) -> DataFrame:
    return ml.alerts_with_cooldown(t.events.select("user_id", "ts", (F.col("value") / 490).alias("score")), "user_id", "ts", "score", 600)


ALERTS = """WITH RECURSIVE a AS (SELECT user_id, ts, value / 490 AS score, CASE WHEN value / 490 >= .9 THEN 'CRITICAL' WHEN value / 490 >= .7 THEN 'WARNING' ELSE 'INFO' END AS severity, row_number() OVER (PARTITION BY user_id ORDER BY ts, value / 490) AS k FROM events WHERE value / 490 >= .5),
  z AS (SELECT user_id, ts, score, severity, k, true AS passed, ts AS last FROM a WHERE k = 1
    UNION ALL SELECT a.user_id, a.ts, a.score, a.severity, a.k, a.severity = 'CRITICAL' OR a.ts - z.last >= INTERVAL 600 MINUTE, CASE WHEN a.severity = 'CRITICAL' OR a.ts - z.last >= INTERVAL 600 MINUTE THEN a.ts ELSE z.last END FROM z JOIN a ON a.user_id = z.user_id AND a.k = z.k + 1)"""


@query(ALERTS + " SELECT user_id, ts, round(score, 6) AS score, severity FROM z WHERE passed")
def cooldown_alerts(t):
    return rounded(alerts(t), "score", digits=6)


@query(ALERTS + " SELECT s AS severity, count(z.user_id) AS n, count(DISTINCT z.user_id) AS machines FROM (SELECT unnest(['CRITICAL', 'WARNING', 'INFO']) AS s) LEFT JOIN (SELECT * FROM z WHERE passed) z ON s = severity GROUP BY ALL")
def alert_summary(t):
    return ml.alert_summary(alerts(t), "user_id")


@query(ALERTS + " SELECT user_id, ts, severity FROM z WHERE passed AND severity = 'WARNING' ORDER BY ts DESC, user_id LIMIT 10")
def last_warnings(t):
    return ml.last_alerts(alerts(t), "ts", 10, ["user_id"], "WARNING").select("user_id", "ts", "severity")


@query("SELECT event_type, count(*) AS samples, count(*) FILTER (value > 400) AS anomalies, round(avg(value), 6) AS avg_score FROM events GROUP BY ALL")
def prediction_log_summary(t):
    return ml.prediction_log_summary(t.events, ["event_type"], F.col("value") > 400, "value")


# Batch twins of the streams


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(t):
    return _ntz(jobs.tumbling_counts(t.events), "window_start")


@query("""WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events))
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 5 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(t):
    return _ntz(jobs.session_counts(t.events), "session_start", "session_end")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CASE WHEN count(*) > 6 THEN 'viral' ELSE 'rising' END AS status FROM events GROUP BY ALL HAVING count(*) > 3")
def viral_velocity(t):
    return _ntz(jobs.viral_velocity(t.events, "event_type", size="1 hour", viral=6, rising=3), "window_start")


def playback(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "buffering").when(F.col("event_type") == "purchase", "end").otherwise("play")
    return t.events.select("user_id", "ts", "event_id", kind.alias("event_type"))


@query("""WITH n AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events),
  l AS (SELECT *, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM n WHERE session > 0),
  b AS (SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) FILTER (event_type = 'purchase') AS fin, count(*) FILTER (event_type = 'error') AS bufferings FROM l WHERE NOT over GROUP BY ALL)
  SELECT user_id, session, start, fin AS end, round(epoch_us(fin - start) / 1e6, 3) AS duration_s, bufferings, greatest(0, bufferings - 2) AS alerts FROM b WHERE fin IS NOT NULL""".replace("fin AS end", 'fin AS "end"'))
def playback_sessions(t):
    return rounded(jobs.playback_sessions(playback(t)), "duration_s", digits=3)


@query("""WITH s AS (SELECT event_id, user_id, ts, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id % 30 END IGNORE NULLS) OVER w, 0) AS trips, coalesce(last_value(CASE WHEN event_type = 'view' THEN 4.5 + (event_id % 6) / 10 END IGNORE NULLS) OVER w, 5.0) AS rating
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  o AS (SELECT *, (trips >= 15 AND rating >= 4.8)::INT AS ok FROM s)
  SELECT event_id, user_id, trips, round(rating, 2) AS rating, ok = 1 AND sum(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS earns_bonus FROM o""")
def cdc_state(t):
    out = jobs.cdc_state(t.events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id") % 30), F.when(F.col("event_type") == "view", 4.5 + (F.col("event_id") % 6) / 10))
    return rounded(out.select("event_id", "user_id", "trips", "rating", "earns_bonus"), "rating", digits=2)
