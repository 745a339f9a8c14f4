"""Queries over ordered events and conversation turns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vivaspark.operators import sequence as S
from vivaspark.plans.base import query
from vivaspark.plans.metrics import six

_ORDER = ["ts", "event_id"]


def _us():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("""
WITH r AS (SELECT conv_id, turn, length(text)::DOUBLE AS x FROM conversations), b AS (SELECT *, avg(x) FILTER (turn < 2) OVER (PARTITION BY conv_id) AS b FROM r)
SELECT conv_id, turn, round(b, 6) AS baseline, round(CASE WHEN turn >= 2 THEN CASE WHEN abs(b) < 1e-6 THEN 0 ELSE (x - b) / b END END, 6) AS deviation FROM b
""")
def baseline_deviation(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("x"))
    return six(S.baseline_deviation(rows, "conv_id", "turn", "x").drop("x"), "baseline", "deviation")


@query("""
WITH r AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x FROM events), k AS (SELECT *, count(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r),
p AS (SELECT user_id, k, avg(x) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM k WHERE x IS NOT NULL)
SELECT user_id, event_id, round(coalesce(x, p.m, 0), 6) AS imputed FROM k LEFT JOIN p USING (user_id, k)
""")
def rolling_imputation(t):
    rows = t.events.select("user_id", "event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    return six(S.rolling_impute(rows, "user_id", _ORDER, "x"), "imputed").select("user_id", "event_id", "imputed")


@query("""
WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, CASE WHEN event_id % 3 <> 0 THEN value END AS x FROM events),
f AS (SELECT user_id, turn, coalesce(x, 0) AS x, [coalesce(x, 0)] AS h FROM r WHERE turn = 1
  UNION ALL SELECT r.user_id, r.turn, coalesce(r.x, list_avg(f.h)), list_append(f.h, coalesce(r.x, list_avg(f.h)))[-5:] FROM f JOIN r ON r.user_id = f.user_id AND r.turn = f.turn + 1)
SELECT user_id, turn, round(x, 6) AS x FROM f
""")
def feature_imputation(t):
    """W05 with feedback: imputed values enter the history."""
    rows = t.events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("x"))
    return six(S.impute_fold(rows, "user_id", _ORDER, ["x"]), "x").withColumn("turn", F.col("turn").cast("long"))


@query("""
WITH r AS (SELECT user_id, ts, event_id, epoch_us(ts) AS at_us, value < 50 AS below, lag(value < 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
m AS (SELECT *, last_value(CASE WHEN below AND NOT coalesce(was, FALSE) THEN at_us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS started FROM r)
SELECT user_id, started, at_us AS ended, at_us - started AS duration FROM m WHERE NOT below AND was
""")
def threshold_crossing(t):
    return S.crossings(t.events, "user_id", _ORDER, "value", 50, _us())


@query("""
WITH r AS (SELECT user_id, count(*) OVER w AS n, (last_value(epoch_us(ts)) OVER w - first_value(epoch_us(ts)) OVER w) / 1e6 AS span FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, count(*) AS windows, round(stddev_pop(4 / span) / avg(4 / span), 6) AS cv FROM r WHERE n = 4 AND span > 0 GROUP BY user_id
""")
def sliding4_cv(t):
    return six(S.sliding_rate_cv(t.events, "user_id", _ORDER, _us() / 1e6), "cv")


@query("""
WITH v AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 30 AS v FROM events)
SELECT user_id, round(avg(v), 6) AS mean_speed, round(max(v), 6) AS peak_speed, round(var_pop(value), 6) AS variance FROM v GROUP BY user_id
""")
def velocity(t):
    return six(S.velocity(t.events, "user_id", _ORDER, "value", 30.0), "mean_speed", "peak_speed", "variance")


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(*) FILTER (gap > 3600) AS pauses, CAST(coalesce(sum(gap) FILTER (gap > 3600), 0) AS BIGINT) AS paused FROM g GROUP BY user_id
""")
def gap_stats(t):
    return S.pauses(t.events, "user_id", _ORDER, F.unix_seconds(F.col("ts").cast("timestamp")), 3600)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS to_go FROM events")
def return_to_go(t):
    return S.return_to_go(t.events, "user_id", _ORDER, "value").select("event_id", F.round("to_go", 5).alias("to_go"))


@query("""
SELECT event_id, repeat('-,', CAST(12 - n AS INT)) || array_to_string(c, ',') AS context, CAST(12 - n AS INTEGER) AS padding
FROM (SELECT event_id, list(event_type) OVER w AS c, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
""")
def trailing_context(t):
    return S.trailing_context(t.events, "user_id", _ORDER, "event_type", 12, "-").select("event_id", F.array_join("context", ",").alias("context"), "padding")


@query("""
WITH c AS (SELECT *, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS INTEGER) AS run FROM i
""")
def focus_run_length(t):
    return S.run_length(t.events, "user_id", _ORDER, "event_type").select("event_id", "run")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS visits, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT event_id, round(1.5 * value / 100 + 0.5 * (visits = 0)::INT - 0.1 - 0.05 * least(visits, 3) - 1.0 * (value > 190)::INT - 0.5 * (event_id % 9 = 0)::INT
  + CASE WHEN back > 1 THEN 0 WHEN event_id % 4 = 3 THEN -2.5 WHEN abs(user_id % 3 - event_id % 4) = 0 THEN 10 WHEN abs(user_id % 3 - event_id % 4) = 1 THEN -5 ELSE -10 END, 6) AS reward FROM r
""")
def step_reward(t):
    visits = F.row_number().over(S.over(["user_id", "event_type"], _ORDER)) - 1
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = t.events.withColumn("visits", visits).withColumn("back", back)
    label = F.when(F.col("event_id") % 4 != 3, F.col("event_id") % 4)
    step = S.step_reward(F.col("value") / 100, F.col("visits") == 0, F.col("visits"), F.col("value") > 190, F.col("event_id") % 9 == 0)
    end = F.when(F.col("back") == 1, S.terminal_delta(F.col("user_id") % 3, label, 10.0)).otherwise(0.0)
    return rows.select("event_id", F.round(step + end, 6).alias("reward"))


_WEIGHTED = "SELECT user_id, event_type, round(value, 1) AS v, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id) AS w FROM events"


@query(f"""
WITH p AS (SELECT event_type, v, sum(w) AS w FROM ({_WEIGHTED}) GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY v) AS c, sum(w) OVER (PARTITION BY event_type) AS t FROM p)
SELECT event_type, min(v) FILTER (c >= 0.25 * t * (1 - 1e-12)) AS q25, min(v) FILTER (c >= 0.5 * t * (1 - 1e-12)) AS q50, min(v) FILTER (c >= 0.9 * t * (1 - 1e-12)) AS q90 FROM c GROUP BY event_type
""")
def weighted_quantile(t):
    rows = S.balanced_weights(t.events.select("user_id", "event_type", F.round("value", 1).alias("v")), "user_id")
    return S.weighted_quantiles(rows, "v", "weight", [0.25, 0.5, 0.9], ["event_type"])


@query(f"""
WITH r AS (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS label, round(v / 200, 3) AS v, w FROM ({_WEIGHTED})),
p AS (SELECT label, v, sum(w) AS w FROM r GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY label ORDER BY v) AS c, sum(w) OVER (PARTITION BY label) AS t FROM p),
m AS (SELECT label, min(v) FILTER (c >= 0.5 * t * (1 - 1e-12)) AS q FROM c GROUP BY label),
p2 AS (SELECT label, abs(r.v - m.q) AS d, sum(w) AS w FROM r JOIN m USING (label) GROUP BY ALL), c2 AS (SELECT *, sum(w) OVER (PARTITION BY label ORDER BY d) AS c, sum(w) OVER (PARTITION BY label) AS t FROM p2),
s AS (SELECT label, greatest(1.4826 * min(d) FILTER (c >= 0.5 * t * (1 - 1e-12)), 0.03) AS raw, any_value(t) AS mass FROM c2 GROUP BY label),
a AS (SELECT greatest(1.4826 * min(d) FILTER (c >= 0.5 * t * (1 - 1e-12)), 0.03) AS pooled FROM (SELECT d, sum(w) OVER (ORDER BY d) AS c, sum(w) OVER () AS t FROM (SELECT d, sum(w) AS w FROM p2 GROUP BY d)))
SELECT label, round(max(q) OVER (ORDER BY label), 6) AS centre, round(least(greatest(sqrt((mass * raw ** 2 + 5 * (SELECT pooled FROM a) ** 2) / (mass + 5)), 0.03), 0.35), 6) AS scale,
  round((mass + 1) / (sum(mass) OVER () + count(*) OVER ()), 6) AS prior FROM s JOIN m USING (label)
""")
def emission_fit(t):
    rows = S.balanced_weights(t.events.select("user_id", "event_type", F.round("value", 1).alias("v")), "user_id")
    label = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return six(S.emission_fit(rows.select(label.alias("label"), F.round(F.col("v") / 200, 3).alias("v"), "weight"), "label", "v", "weight"), "centre", "scale", "prior")


@query("SELECT user_id, event_type AS mode, n AS frames FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def turn_summary_mode(t):
    return S.turn_mode(t.events, "user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS running FROM events")
def running_maximum(t):
    """W23."""
    w = S.over(["user_id"], _ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.round(F.max("value").over(w), 6).alias("running"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE b <= 5 GROUP BY user_id")
def last_k_history(t):
    """The last five, also where there are fewer."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = t.events.select("user_id", "event_type", back.alias("back")).filter("back <= 5")
    names = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("back"), "event_type"))), lambda x: x.event_type)
    return last.groupBy("user_id").agg(F.array_join(names, ",").alias("recent"))


@query("SELECT user_id, round(quantile_cont(v, 0.9), 6) AS q90, round(max(abs(v)), 6) AS scale FROM (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def return_scale(t):
    """Linear 0.9 quantile and largest absolute return."""
    per = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return per.groupBy("user_id").agg(F.round(F.percentile("v", F.lit(0.9)), 6).alias("q90"), F.round(F.max(F.abs("v")), 6).alias("scale"))


@query("SELECT coalesce(max(try_cast(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS INT)), -1) + 1 AS next_index FROM customer")
def next_sequence(t):
    """Next number after those in ids of the right form."""
    n = F.regexp_extract("c_name", "#0*([0-9]+)$", 1).try_cast("int")
    return t.customer.agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next_index"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh FROM events),
c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY turn) AS covered FROM r)
SELECT event_id, turn >= 10 AND covered >= least(greatest(5, 3), 5) AND turn >= 5 AS may_conclude, turn > 1 AS may_follow_up FROM c
""")
def legality_mask(t):
    """May the interview end, may it follow up."""
    w = S.over(["user_id"], _ORDER)
    rows = t.events.withColumn("turn", F.row_number().over(w)).withColumn("fresh", F.row_number().over(S.over(["user_id", "event_type"], _ORDER)) == 1)
    rows = rows.withColumn("covered", F.sum(F.col("fresh").cast("int")).over(w))
    need = F.least(F.greatest(F.lit(5), F.lit(3)), F.lit(5))
    return rows.select("event_id", ((F.col("turn") >= 10) & (F.col("covered") >= need) & (F.col("turn") >= 5)).alias("may_conclude"), (F.col("turn") > 1).alias("may_follow_up"))
