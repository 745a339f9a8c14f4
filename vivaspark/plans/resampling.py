"""Bootstraps and policy reports on the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vivaspark.operators import resampling as R
from vivaspark.plans.base import query
from vivaspark.plans.metrics import six


def _times(seed: int, replicate: str, unit: str) -> str:
    u = f"('0x' || substr(md5('{seed}:' || {replicate} || ':' || {unit}), 1, 8))::BIGINT"
    return f"list_sum(list_transform([{', '.join(map(str, R.CUMULATED))}], lambda c: (u >= c)::INT))::BIGINT", u


_W, _U = _times(42, "b", "unit")
_MODELS = {"base": (0, 0.40), "new": (3, 0.36)}


def _scored(t):
    """Each vector is an episode of one of 41 components; two models read three of its numbers each, and abstain where they are unsure."""
    out = t.embeddings.select((F.col("vec_id") % 41).alias("unit"), (F.col("label") % 3).alias("y"), "embedding")
    for m, (at, least) in _MODELS.items():
        x = F.transform(F.slice("embedding", at + 1, 3), lambda v: F.exp(4 * v.cast("double")))
        out = out.withColumn(f"_{m}", x)
        probs = F.transform(f"_{m}", lambda v: v / F.aggregate(f"_{m}", F.lit(0.0), lambda a, b: a + b))  # noqa: B023
        out = out.withColumn(f"{m}_probs", probs)
        top = F.array_max(f"{m}_probs")
        out = out.withColumn(m, F.when(top >= least, F.array_position(f"{m}_probs", top) - 1))
    return out


def _model_sql(m: str) -> str:
    at, least = _MODELS[m]
    sums = ", ".join([f"count(*) FILTER (y = {c} AND p = {c}) AS {m}_h{c}, count(*) FILTER (p = {c}) AS {m}_g{c}" for c in range(3)] + [f"count(p) AS {m}_n"] + [f"coalesce(sum(gap) FILTER (bin = {i}), 0) AS {m}_e{i}" for i in range(10)])
    return f"""
s_{m} AS (SELECT unit, {sums} FROM (
  SELECT unit, y, CASE WHEN list_max(q) >= {least} THEN list_position(q, list_max(q)) - 1 END AS p, list_max(q) - (list_position(q, list_max(q)) - 1 = y)::INT AS gap, least(floor(list_max(q) * 10), 9) AS bin
  FROM (SELECT unit, y, list_transform(x, lambda v: v / list_sum(x)) AS q FROM (SELECT vec_id % 41 AS unit, label % 3 AS y, list_transform(embedding[{at + 1}:{at + 3}], lambda v: exp(4 * v::DOUBLE)) AS x FROM embeddings))) GROUP BY unit)"""


_SUMS = [f"t{c}" for c in range(3)] + [f"{m}_{k}" for m in _MODELS for k in [f"{x}{c}" for x in "hg" for c in range(3)] + ["n"] + [f"e{i}" for i in range(10)]]


def _metric_sql(m: str) -> str:
    rec = [f"coalesce({m}_h{c}::DOUBLE / nullif(t{c}, 0), 0)" for c in range(3)]
    f1 = [f"coalesce(2.0 * {m}_h{c} / nullif(t{c} + {m}_g{c}, 0), 0)" for c in range(3)]
    n = "(t0 + t1 + t2)"
    return f"[({m}_h0 + {m}_h1 + {m}_h2)::DOUBLE / {n}, ({' + '.join(f1)}) / 3, least({', '.join(rec)}), ({' + '.join(f'abs({m}_e{i})' for i in range(10))}) / {n}, ({n} - {m}_n)::DOUBLE / {n}]"


_DIFFERENCE = f"list_transform(range(1, 6), lambda i: ({_metric_sql('new')})[i] - ({_metric_sql('base')})[i])"


@query(f"""
WITH y AS (SELECT vec_id % 41 AS unit, count(*) FILTER (label % 3 = 0) AS t0, count(*) FILTER (label % 3 = 1) AS t1, count(*) FILTER (label % 3 = 2) AS t2 FROM embeddings GROUP BY 1), {_model_sql('base')}, {_model_sql('new')},
per AS (SELECT * FROM y JOIN s_base USING (unit) JOIN s_new USING (unit)), whole AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in _SUMS)} FROM per),
draws AS (SELECT *, {_W} AS w FROM (SELECT *, {_U} AS u FROM per, range(200) r(b))),
reps AS (SELECT {_DIFFERENCE} AS d FROM (SELECT b, {', '.join(f'sum({c} * w) AS {c}' for c in _SUMS)} FROM draws GROUP BY b)),
jack AS (SELECT {_DIFFERENCE} AS d FROM (SELECT {', '.join(f'whole.{c} - per.{c} AS {c}' for c in _SUMS)} FROM per, whole)),
point AS (SELECT {_DIFFERENCE} AS d FROM whole)
SELECT (SELECT count(*) FROM per) AS components, (SELECT count(*) FROM reps) AS replicates, {R.METRICS}[i] AS metric, round((SELECT d[i] FROM point), 6) AS difference,
  round((SELECT quantile_cont(d[i], 0.025) FROM reps), 6) AS low, round((SELECT quantile_cont(d[i], 0.975) FROM reps), 6) AS high, round((SELECT min(d[i]) FROM jack), 6) AS least, round((SELECT max(d[i]) FROM jack), 6) AS most
FROM range(1, 6) m(i)
""".replace(str(R.METRICS), str(list(R.METRICS))))
def paired_component_bootstrap(t):
    """A30."""
    out = R.paired_bootstrap(_scored(t), "unit", "y", ("base", "base_probs"), ("new", "new_probs"), 200)
    return six(out, "difference", "low", "high", "least", "most")


@query(f"""
WITH e AS (SELECT user_id AS unit, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS label, least(greatest(value / 200, 0), 1) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events),
u AS (SELECT unit, b, {_W} AS w FROM (SELECT unit, b, {_U} AS u FROM (SELECT DISTINCT unit FROM e), range(40) r(b))),
s AS (SELECT b, label, v, sum(w::DOUBLE / n) AS w FROM e JOIN u USING (unit) WHERE w > 0 GROUP BY ALL),
c AS (SELECT b, label, v, sum(w) OVER (PARTITION BY b, label ORDER BY v) AS upto, sum(w) OVER (PARTITION BY b, label) AS total FROM s),
m AS (SELECT b, label, min(v) FILTER (upto >= total / 2 * (1 - 1e-12)) AS median FROM c GROUP BY ALL),
o AS (SELECT b, label, max(median) OVER (PARTITION BY b ORDER BY label) AS centre, coalesce(median >= lag(median) OVER (PARTITION BY b ORDER BY label), true) AS up FROM m QUALIFY count(*) OVER (PARTITION BY b) = 3)
SELECT label, count(*) AS replicates, round(avg(centre), 6) AS mean, round(stddev_pop(centre), 6) AS deviation, 1.0::DOUBLE AS ordered, (SELECT round(avg(up::INT), 6) FROM (SELECT bool_and(up) AS up FROM o GROUP BY b)) AS ordered_before FROM o GROUP BY label
""")
def fit_stability(t):
    """Users are episodes."""
    label = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    v = F.least(F.greatest(F.col("value") / 200, F.lit(0.0)), F.lit(1.0))
    return six(R.fit_stability(t.events.select("user_id", label.alias("label"), v.alias("v")), "user_id", "label", "v", 40), "mean", "deviation", "ordered_before")


#: Three policies on the same scenarios: whole triples of events.
_ROLLOUTS = "SELECT 'p' || event_id % 3 AS policy, event_id // 3 AS scenario, user_id % 3 AS truth, CASE WHEN event_id % 10 < 9 THEN floor(value / 67)::INT END AS prediction, value AS reward, (user_id % 7)::DOUBLE + event_id % 3 AS turns, event_type AS reason FROM events WHERE event_id // 3 IN (SELECT event_id // 3 FROM events GROUP BY 1 HAVING count(*) = 3)"


def _rollouts(t):
    k = F.col("event_id")
    rows = t.events.withColumn("scenario", F.floor(k / 3))
    whole = rows.groupBy("scenario").agg(F.count("*").alias("n")).filter("n = 3").select("scenario")
    prediction = F.when(k % 10 < 9, F.floor(F.col("value") / 67).cast("int"))
    return rows.join(whole, "scenario").select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("policy"), "scenario", (F.col("user_id") % 3).alias("truth"), prediction.alias("prediction"), F.col("value").alias("reward"), ((F.col("user_id") % 7).cast("double") + k % 3).alias("turns"), F.col("event_type").alias("reason"))


_DRAWS = f"SELECT *, {_W} AS w FROM (SELECT *, {_U} AS u FROM (SELECT *, scenario AS unit FROM x), range(20) q(b))"


@query(f"""
WITH r AS ({_ROLLOUTS}), x AS (SELECT o.policy, o.scenario, unnest(['reward', 'turns']) AS value, unnest([ref.reward - o.reward, ref.turns - o.turns]) AS d FROM r o JOIN r ref ON ref.scenario = o.scenario AND ref.policy = 'p0' WHERE o.policy <> 'p0'),
m AS (SELECT policy, value, sum(w * d) / sum(w) AS mean FROM ({_DRAWS}) GROUP BY policy, value, b),
i AS (SELECT policy, value, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY ALL)
SELECT policy, value, round(avg(d), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM x JOIN i USING (policy, value) GROUP BY policy, value
""")
def paired_policy_report(t):
    """A36, J07."""
    return six(R.paired_report(_rollouts(t), "policy", "scenario", "p0", ["reward", "turns"], 20), "mean", "low", "high")


@query(f"""
WITH r AS ({_ROLLOUTS}), x AS (SELECT *, coalesce(truth = prediction, false)::INT::DOUBLE AS ok FROM r),
m AS (SELECT policy, sum(w * ok) / sum(w) AS a, sum(w * reward) / sum(w) AS r FROM ({_DRAWS}) GROUP BY policy, b),
i AS (SELECT policy, quantile_cont(a, 0.025) AS low_accuracy, quantile_cont(a, 0.975) AS high_accuracy, quantile_cont(r, 0.025) AS low_reward, quantile_cont(r, 0.975) AS high_reward FROM m GROUP BY policy),
c AS (SELECT policy, c, count(*) FILTER (truth = c AND prediction = c)::DOUBLE AS hit, count(*) FILTER (truth = c) AS t, count(*) FILTER (prediction = c) AS g FROM x, range(3) q(c) GROUP BY ALL),
f AS (SELECT policy, avg(coalesce(hit / nullif(t, 0), 0)) AS balanced, avg(coalesce(2 * hit / nullif(t + g, 0), 0)) AS macro FROM c GROUP BY policy),
k AS (SELECT policy, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT policy, reason, count(*) AS n FROM x GROUP BY ALL) GROUP BY policy)
SELECT policy, count(*) AS episodes, round(avg(ok), 6) AS accuracy, round(any_value(low_accuracy), 6) AS low_accuracy, round(any_value(high_accuracy), 6) AS high_accuracy, round(any_value(balanced), 6) AS balanced_accuracy, round(any_value(macro), 6) AS macro_f1,
  round(avg(reward), 6) AS mean_reward, round(stddev_samp(reward), 6) AS std_reward, min(reward) AS min_reward, max(reward) AS max_reward, round(any_value(low_reward), 6) AS low_reward, round(any_value(high_reward), 6) AS high_reward, any_value(reasons) AS reasons
FROM x JOIN i USING (policy) JOIN f USING (policy) JOIN k USING (policy) GROUP BY policy
""")
def policy_report(t):
    """A35."""
    out = R.policy_report(_rollouts(t), "policy", "scenario", "truth", "prediction", ["reward"], "reason", 20)
    reasons = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    names = ["accuracy", "low_accuracy", "high_accuracy", "balanced_accuracy", "macro_f1", "mean_reward", "std_reward", "low_reward", "high_reward"]
    return six(out, *names).select("policy", "episodes", *names, "min_reward", "max_reward", reasons.alias("reasons"))
