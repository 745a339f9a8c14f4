"""Streams over the events table, run over all that is there."""

from pyspark.sql import functions as F

from vivaspark.plans.base import query
from vivaspark.plans.metrics import six
from vivaspark.streaming import keyed as K
from vivaspark.streaming import live as L


def _events(t):
    return L.read(t.spark, f"{t.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, CAST(round(value) AS BIGINT) AS submission, count(*) AS kept FROM (SELECT DISTINCT user_id, round(value) AS value FROM events) GROUP BY ALL")
def stream_dedupe(t):
    rows = _events(t).select("user_id", F.round("value").cast("long").alias("submission"), "ts")
    out = L.drain(L.deduplicated(rows, ["user_id", "submission"], "ts", "31 days"))
    return out.groupBy("user_id", "submission").agg(F.count("*").alias("kept"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(t):
    out = L.drain(L.windowed(_events(t), "ts", "1 hour", "1 day", None, "event_type", "value"), "complete")
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS new FROM events))
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, s
""")
def stream_sessions(t):
    out = L.drain(L.sessions(_events(t), "ts", "1 hour", "1 hour", "user_id"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("""
WITH RECURSIVE t AS (SELECT user_id, event_type, row_number() OVER w AS i, least(value / 100, 1.0) AS s FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
b AS (SELECT user_id, event_type, 0::BIGINT AS i, 1/3::DOUBLE AS p0, 1/3::DOUBLE AS p1, 1/3::DOUBLE AS p2, 0::DOUBLE AS ess FROM t WHERE i = 1
UNION ALL SELECT user_id, event_type, i, CASE WHEN w > 0 THEN f0 / (f0 + f1 + f2) ELSE p0 END, CASE WHEN w > 0 THEN f1 / (f0 + f1 + f2) ELSE p1 END, CASE WHEN w > 0 THEN f2 / (f0 + f1 + f2) ELSE p2 END, ess + greatest(w, 0)
FROM (SELECT *, greatest(e0 / (e0 + e1 + e2), 1e-4) AS f0, greatest(e1 / (e0 + e1 + e2), 1e-4) AS f1, greatest(e2 / (e0 + e1 + e2), 1e-4) AS f2
FROM (SELECT *, p0 * exp(-0.5 * w * ((s - 0.2) / 0.22) ** 2) AS e0, p1 * exp(-0.5 * w * ((s - 0.5) / 0.22) ** 2) AS e1, p2 * exp(-0.5 * w * ((s - 0.8) / 0.22) ** 2) AS e2
FROM (SELECT t.user_id, t.event_type, t.i, t.s, b.p0, b.p1, b.p2, b.ess, least(1 / (1 + b.ess) ** 0.5, greatest(5 - b.ess, 0)) AS w FROM b JOIN t ON t.user_id = b.user_id AND t.event_type = b.event_type AND t.i = b.i + 1))))
SELECT user_id, event_type, round(p0, 6) AS p0, round(p2, 6) AS p2, round(ess, 6) AS ess FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY i DESC) = 1
""")
def stream_belief(t):
    rows = _events(t).select("user_id", "event_type", "ts", F.least(F.col("value") / 100, F.lit(1.0)).alias("score"))
    out = L.drain(L.beliefs(rows, "user_id", "event_type", "score", "ts"), "update")
    last = out.groupBy("user_id", "event_type").agg(F.max_by(F.struct("p0", "p2", "ess"), "batch").alias("x")).select("user_id", "event_type", "x.*")
    return six(last, "p0", "p2", "ess")


@query()
def stream_leases(t):
    """Event types stand for writers that want a user's session."""
    rows = _events(t).select("user_id", F.col("event_type").alias("writer"), F.unix_millis("ts").alias("at_ms"))
    return L.drain(L.leases(rows, "user_id", "writer", "at_ms", 3_600_000))


def _timed(t):
    return _events(t).withColumn("at_ms", F.unix_millis("ts"))


@query("""
WITH n AS (SELECT user_id, event_id, value, event_id % 7 + 1 AS rate, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
b AS (SELECT *, avg(value) FILTER (i <= 2) OVER (PARTITION BY user_id) AS bv, avg(rate) FILTER (i <= 2) OVER (PARTITION BY user_id) AS br FROM n)
SELECT user_id, event_id, round(CASE WHEN i > 2 THEN CASE WHEN abs(bv) < 1e-6 THEN 0 ELSE (value - bv) / bv END END, 6) AS value_deviation, round(CASE WHEN i > 2 THEN (rate - br) / br END, 6) AS rate_deviation FROM b
""")
def stream_baselines(t):
    """Every user's first two events are the baseline of the others."""
    rows = _timed(t).withColumn("rate", (F.col("event_id") % 7 + 1).cast("double"))
    return six(K.drained(K.baselines(rows, "user_id", "event_id", "at_ms", ["value", "rate"])), "value_deviation", "rate_deviation")


@query("""
WITH n AS (SELECT user_id, event_id % 5 AS submission, event_id, event_type, row_number() OVER w AS i, first_value(event_type) OVER w AS had, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY epoch_ms(ts), event_id))
SELECT user_id, submission, event_id, first_id, CASE WHEN i = 1 THEN 'accepted' WHEN event_type = had THEN 'repeated' ELSE 'conflict' END AS outcome FROM n
""")
def stream_submissions(t):
    """A user's five submission ids, used again and again; what is accepted and what is not are two sinks of one stream."""
    rows = _timed(t).withColumn("submission", F.col("event_id") % 5)
    sinks = K.split(K.submissions(rows, ["user_id", "submission"], "event_type", "event_id", "at_ms"), "outcome", {"kept": ["accepted"], "aside": ["repeated", "conflict"]})
    return sinks["kept"].union(sinks["aside"])


def queue_log(events):
    """events as what workers ask of jobs: jobs are users, workers and epochs follow from the id."""
    k, kind = F.col("event_id"), F.col("event_type")
    action = F.when(kind.isin("click", "view"), "claim").when(kind == "purchase", "done").when(kind == "signup", "retry").otherwise("beat")
    return events.select(F.col("user_id").alias("job"), F.concat(F.lit("w"), (k % 2).cast("string")).alias("worker"), action.alias("action"), (k % 3 + 1).cast("long").alias("epoch"), "event_id", "at_ms")


@query()
def stream_queue(t):
    """T01."""
    return K.drained(K.queue(queue_log(_timed(t)), "job", "worker", "action", "epoch", "event_id", "at_ms", lease_ms=36_000_000, wait_ms=3_600_000))
