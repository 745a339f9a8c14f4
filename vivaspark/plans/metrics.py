"""Queries over classification, calibration, support and policy metrics, and audits."""

from pyspark.sql import functions as F

from vivaspark.operators import audit as A
from vivaspark.operators import metrics as M
from vivaspark.plans.base import query


def six(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _predictions(t):
    """labels.quality, 0 to 2 with the document's half, against a length band that abstains on the longest."""
    truth = (F.col("quality") + (F.col("doc_id") % 2).cast("int")).alias("y")
    band = F.when(F.col("n_chars") < 800, 0).when(F.col("n_chars") < 2500, 1).when(F.col("n_chars") < 6000, 2).alias("p")
    return t.labels.join(t.documents.select("doc_id", "n_chars", "source"), "doc_id").select("doc_id", "source", truth, band)


_PRED = "SELECT doc_id, source, quality + CAST(doc_id % 2 AS INT) AS y, CASE WHEN n_chars < 800 THEN 0 WHEN n_chars < 2500 THEN 1 WHEN n_chars < 6000 THEN 2 END AS p FROM labels JOIN documents USING (doc_id)"


@query(f"SELECT y, count(*) FILTER (p = 0) AS pred_0, count(*) FILTER (p = 1) AS pred_1, count(*) FILTER (p = 2) AS pred_2, count(*) FILTER (p IS NULL) AS abstained FROM ({_PRED}) GROUP BY y")
def confusion_abstain(t):
    return M.confusion(_predictions(t), "y", "p")


@query(f"""
WITH r AS ({_PRED}), m AS (SELECT c, count(*) FILTER (y = c AND p = c)::DOUBLE AS hit, count(*) FILTER (y = c) AS t, count(*) FILTER (p = c) AS g FROM r, range(3) q(c) GROUP BY c),
s AS (SELECT c, hit, g, coalesce(hit / nullif(t, 0), 0) AS rec, coalesce(hit / nullif(g, 0), 0) AS prec FROM m)
SELECT (SELECT count(*) FROM r) AS n, (SELECT count(p) FROM r) AS classified, round((SELECT count(p) / count(*) FROM r), 6) AS coverage,
  round(sum(hit) / (SELECT count(*) FROM r), 6) AS accuracy, round(sum(hit) / (SELECT count(p) FROM r), 6) AS selective_accuracy,
  round(avg(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0)), 6) AS macro_f1, round(avg(rec), 6) AS balanced_accuracy, round(min(rec), 6) AS min_recall,
  round(max(g) / (SELECT count(p) FROM r), 6) AS max_share, round((SELECT avg(coalesce(abs(y - p), 2)) FROM r), 6) AS ordinal_mae FROM s
""")
def classification_metrics(t):
    out = M.classification(_predictions(t), "y", "p")
    return six(out, *out.columns[2:])


@query("""
WITH e AS (SELECT label % 3 AS y, list_transform(embedding[1:3], lambda x: exp(4 * x::DOUBLE)) AS x FROM embeddings), p AS (SELECT y, list_transform(x, lambda v: v / list_sum(x)) AS p FROM e),
r AS (SELECT list_max(p) AS conf, (list_position(p, list_max(p)) - 1 = y)::INT::DOUBLE AS ok, list_sum(list_transform(p, lambda v, i: (v - (i - 1 = y)::INT) ** 2)) AS b FROM p),
b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, sum(conf) AS c, sum(ok) AS k, sum(b) AS b FROM r GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(c - k)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM b
""")
def ece_brier(t):
    x = F.transform(F.slice("embedding", 1, 3), lambda v: F.exp(4 * v.cast("double")))
    rows = t.embeddings.select((F.col("label") % 3).alias("y"), x.alias("x")).select("y", F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    return six(M.calibration_error(rows, F.col("y"), F.col("p")), "ece", "brier")


@query("""
WITH a AS (SELECT user_id, event_type, count(*) AS k, sum(value) AS r FROM events GROUP BY ALL), b AS (SELECT *, sum(k) OVER (PARTITION BY user_id) AS n FROM a),
c AS (SELECT user_id, sum(k) AS n, sum(r) AS r, -sum(k / n * ln(k / n + 1e-8)) AS h FROM b GROUP BY user_id)
SELECT count(*) AS episodes, round(avg(n), 6) AS mean_length, round(avg(r), 6) AS mean_return, round(avg(h), 6) AS mean_entropy FROM c
""")
def action_entropy(t):
    return six(M.action_entropy(t.events, "user_id", "event_type", "value"), "mean_length", "mean_return", "mean_entropy")


@query("""
WITH p AS (SELECT quality + toxic AS label, count(*) AS n, avg(n_chars) AS mean, var_pop(n_chars) AS variance FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT a.label, a.n, round(a.mean, 6) AS mean, round(a.variance, 4) AS variance, round((b.mean - a.mean) / sqrt((a.variance + b.variance) / 2), 6) AS effect FROM p a LEFT JOIN p b ON b.label = a.label + 1
""")
def class_separation(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select((F.col("quality") + F.col("toxic")).alias("label"), "n_chars")
    return six(M.separation(rows, "label", "n_chars"), "mean", "effect").withColumn("variance", F.round("variance", 4))


@query("""
WITH s AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS b FROM events GROUP BY user_id, event_type),
r AS (SELECT (CASE event_type WHEN 'purchase' THEN 0.4 WHEN 'click' THEN 0.3 ELSE 0.1 END)::DOUBLE / b AS raw, value / 100 AS r FROM events JOIN s USING (user_id, event_type))
SELECT count(*) AS n, round(sum(least(raw, 20) * r) / sum(least(raw, 20)), 6) AS value, round(sum(least(raw, 20)) ** 2 / sum(least(raw, 20) ** 2), 4) AS ess, round(avg((raw > 20)::INT), 6) AS clip_rate, round(max(raw), 6) AS max_ratio FROM r
""")
def wis_ope(t):
    per = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("k"))
    total = per.groupBy("user_id").agg(F.sum("k").alias("n"))
    share = per.join(total, "user_id").select("user_id", "event_type", (F.col("k") / F.col("n")).alias("b"))
    target = F.when(F.col("event_type") == "purchase", 0.4).when(F.col("event_type") == "click", 0.3).otherwise(0.1)
    out = M.importance_sampling(t.events.join(share, ["user_id", "event_type"]), target, F.col("b"), F.col("value") / 100)
    return six(out, "value", "clip_rate", "max_ratio").withColumn("ess", F.round("ess", 4))


@query("SELECT o_orderpriority AS policy, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def policy_summary(t):
    out = M.policy_summary(t.orders.withColumnRenamed("o_orderpriority", "policy"), "policy", "o_totalprice")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("""
WITH v AS (SELECT o_orderpriority AS policy, o_custkey AS scenario, round(sum(o_totalprice)) AS v FROM orders GROUP BY ALL), r AS (SELECT scenario, v AS ref FROM v WHERE policy = '1-URGENT'),
d AS (SELECT policy, v - ref AS d FROM v JOIN r USING (scenario) WHERE policy <> '1-URGENT')
SELECT policy, count(*) AS pairs, round(avg(d), 4) AS mean_difference, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM d GROUP BY policy
""")
def paired_policy_diff(t):
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("policy"), F.col("o_custkey").alias("scenario")).agg(F.round(F.sum("o_totalprice")).alias("v"))
    return M.paired(rows, "policy", "scenario", "1-URGENT", "v").withColumn("mean_difference", F.round("mean_difference", 4))


@query(f"""
WITH r AS ({_PRED}), per AS (SELECT source, count(*) AS n, count(*) FILTER (y = p) AS k FROM r GROUP BY source), num AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS g FROM per),
d AS (SELECT b, d, g FROM range(200) x(b), (SELECT any_value(g) AS g FROM num), unnest(range(g)) y(d)),
s AS (SELECT b, sum(k) / sum(n) AS rate FROM (SELECT b, ('0x' || substr(sha256('42:' || b || ':' || d), 1, 8))::BIGINT % g AS i FROM d) JOIN num USING (i) GROUP BY b)
SELECT count(*) AS resamples, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high, round((SELECT sum(k) / sum(n) FROM per), 6) AS rate_all FROM s
""")
def bootstrap_ci(t):
    rows = _predictions(t)
    out = M.bootstrap(rows, "source", F.coalesce(F.col("y") == F.col("p"), F.lit(False)), 200, 42)
    return six(out, "low", "high", "rate_all")


@query("""
SELECT lang, source, band, count(*) AS n, round(avg((text LIKE '%Licen%')::INT), 6) AS switch_share, count(*) FILTER (n_chars > 8000) AS truncated, grouping_id(lang, source, band) AS level
FROM (SELECT *, CASE WHEN n_chars < 800 THEN 'small' WHEN n_chars < 2500 THEN 'medium' ELSE 'large' END AS band FROM documents) GROUP BY GROUPING SETS ((lang), (source), (band), ())
""")
def stratified_distribution(t):
    band = F.when(F.col("n_chars") < 800, "small").when(F.col("n_chars") < 2500, "medium").otherwise("large")
    rows = t.documents.select("lang", "source", "n_chars", band.alias("band"), F.col("text").contains("Licen").cast("int").alias("sw"))
    return A.strata(rows, ["lang", "source", "band"], F.count("*").alias("n"), F.round(F.avg("sw"), 6).alias("switch_share"), F.count_if(F.col("n_chars") > 8000).alias("truncated"))


@query("""
WITH d AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'idle', 'probe', 'stop']) AS action), c AS (SELECT event_type AS action, count(*) AS n, stddev_pop(value) AS s FROM events GROUP BY 1), k AS (SELECT count(*) AS total FROM events)
SELECT action, coalesce(n, 0) AS n, n IS NULL AS missing, coalesce(n, 0) < greatest(20, 0.01 * total) AS low_support, coalesce(s, 0) < 0.01 AS flat_reward FROM d LEFT JOIN c USING (action), k
""")
def support_audit(t):
    return A.support(t.events, "event_type", "value", ["click", "view", "purchase", "signup", "error", "idle", "probe", "stop"])


@query("SELECT h AS identity, count(DISTINCT split) AS splits, count(DISTINCT source) AS names FROM (SELECT sha256(text) AS h, doc_id % 3 AS split, source FROM documents) GROUP BY h HAVING count(DISTINCT split) > 1 OR count(DISTINCT source) > 1")
def leak_and_renamed(t):
    rows = t.documents.select(F.sha2("text", 256).alias("identity"), (F.col("doc_id") % 3).alias("split"), "source")
    return A.leaks(rows, "identity", "split", "source")


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess, round(coalesce(sum(n - 1), 0) / (SELECT count(*) FROM documents), 6) AS rate FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY h HAVING count(DISTINCT source) > 1)")
def cross_component_duplicates(t):
    return A.cross_duplicates(t.documents.select("source", "text"), "text", "source").withColumn("rate", F.round("rate", 6))


@query("SELECT user_id, count(value) - count(DISTINCT round(value)) AS repeated, count(DISTINCT event_type) AS targets, count(DISTINCT CAST(event_id % 2 AS INT)) = 1 AS constant FROM events GROUP BY user_id")
def within_episode_duplicates(t):
    e = t.events.select("user_id", F.round("value").alias("q"), "event_type", (F.col("event_id") % 2).alias("v"))
    return A.within_episode(e, "user_id", "q", "event_type", "v")


@query(f"""
WITH m AS (SELECT count(p) / count(*) AS coverage, count(*) FILTER (y = p) / count(*) AS accuracy FROM ({_PRED}))
SELECT 'accuracy' AS metric, round(accuracy, 6) AS value, 0.3::DOUBLE AS threshold, accuracy >= 0.3 AS passed FROM m UNION ALL SELECT 'coverage', round(coverage, 6), 0.95, coverage >= 0.95 FROM m
""")
def belief_gate(t):
    """Metrics against thresholds, a row each."""
    m = M.classification(_predictions(t), "y", "p")
    return A.gate(m, {"accuracy": (">=", 0.3), "coverage": (">=", 0.95)})


@query("""
WITH g AS (SELECT a / 20.0 AS low, b / 15.0 AS gap FROM range(1, 21) x(a), range(1, 16) y(b)), e AS (SELECT label, (embedding[1]::DOUBLE + 0.5) AS s FROM embeddings),
m AS (SELECT low, gap, round(avg((CASE WHEN s < low THEN 0 WHEN s < low + gap THEN 1 ELSE 2 END = label % 3)::INT), 9) AS acc FROM g, e GROUP BY ALL)
SELECT round(low, 6) AS low, round(gap, 6) AS gap, round(acc, 6) AS accuracy FROM m ORDER BY acc DESC, low, gap LIMIT 1
""")
def cv_grid_search(t):
    """Best of a grid of two thresholds, the first on ties."""
    rows = t.embeddings.select((F.col("label") % 3).alias("y"), (F.get("embedding", F.lit(0)).cast("double") + 0.5).alias("s"))
    grid = t.spark.range(1, 21).select((F.col("id") / 20.0).alias("low")).crossJoin(t.spark.range(1, 16).select((F.col("id") / 15.0).alias("gap")))
    return A.best_of_grid(rows, grid)
