"""Queries over row contracts, projections, planners and small functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vivaspark.functions import signals as Y
from vivaspark.operators import contracts as C
from vivaspark.operators import features as N
from vivaspark.operators import graph as G
from vivaspark.plans.base import query
from vivaspark.plans.metrics import six


@query("""
SELECT code, count(*) AS n FROM (SELECT unnest([CASE WHEN event_id % 31 = 0 THEN 'missing_user_id' END, CASE WHEN event_type = 'error' THEN 'version_kind' END, CASE WHEN event_id % 6 <> 0 THEN NULL ELSE 'vector_obs' END]) AS code FROM events) WHERE code IS NOT NULL GROUP BY code
""")
def row_contract(t):
    e = F.col("event_id")
    rows = t.events.select(F.when(e % 31 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_type") != "error", "v3").otherwise("v2").alias("kind"), F.when(e % 6 == 0, F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("obs"))
    return rows.select(F.explode(C.row_contract({"kind": "v3"}, ["user_id"], {"obs": 2})).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_id % 3 <> 2 AS valid FROM events")
def generation_provenance(t):
    k = F.col("event_id") % 3
    ok = C.generation_provenance(F.when(k == 0, "llm").otherwise("deterministic_fallback"), F.when(k == 0, 1), F.when(k > 0, 1), F.when(k == 1, "t1"), F.lit("h"))
    return t.events.select("event_id", ok.alias("valid"))


@query("SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def grounding_provenance(t):
    h = F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("short")
    return t.documents.select("doc_id", C.grounding_valid([h], F.lit("overlap"), F.lit(0.5)).alias("valid"))


@query("SELECT event_id, CAST(least(greatest(value / 100, 0), 1) AS FLOAT)::DOUBLE AS f0, 0.0::DOUBLE AS f1 FROM events")
def policy_state(t):
    s = C.policy_state([F.col("value") / 100, F.lit(float("nan"))])
    return t.events.select("event_id", s.alias("s")).select("event_id", F.get("s", F.lit(0)).cast("double").alias("f0"), F.get("s", F.lit(1)).cast("double").alias("f1"))


@query("SELECT event_id, (42 + event_id * 1000003 + user_id * 10007 + 2 * 100000007) % 2147483647 AS seed FROM events")
def generation_seed(t):
    return t.events.select("event_id", C.generation_seed(F.lit(42), F.col("event_id"), F.col("user_id"), F.lit(2)).alias("seed"))


@query("""
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS a FROM events WHERE value > 20 GROUP BY user_id), j AS (SELECT user_id, list_distinct(list(event_type)) AS b FROM events WHERE value <= 20 GROUP BY user_id),
p AS (SELECT user_id, len(list_intersect(a, b)) AS overlap, len(b) AS n FROM s JOIN j USING (user_id))
SELECT user_id, CAST(overlap AS INTEGER) AS overlap, round(overlap / n, 6) AS ratio, CASE WHEN overlap / n >= 0.5 THEN 'domain_matched' WHEN overlap > 0 THEN 'overlap' ELSE 'disjoint' END AS pairing_class FROM p
""")
def pairing_record(t):
    part = lambda k, n: t.events.filter("value > 20" if k == 0 else "value <= 20").groupBy("user_id").agg(F.collect_set("event_type").alias(n))
    return six(part(0, "a").join(part(1, "b"), "user_id").select("user_id", C.pairing_record(F.col("a"), F.col("b")).alias("r")).select("user_id", "r.*"), "ratio")


@query("""
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS a FROM events WHERE event_id % 2 = 0 GROUP BY user_id), j AS (SELECT user_id, list_distinct(list(event_type)) AS b FROM events WHERE event_id % 2 = 1 GROUP BY user_id),
p AS (SELECT user_id, len(list_intersect(a, b)) AS overlap, len(b) AS n FROM s JOIN j USING (user_id))
SELECT user_id, CAST(overlap AS INTEGER) AS overlap, round(overlap / n, 6) AS ratio, CASE WHEN overlap / n >= 0.5 THEN 'domain_matched' WHEN overlap > 0 THEN 'overlap' ELSE 'disjoint' END AS pairing_class FROM p
""")
def pairing_record_all(t):
    """Pairing over all events, in two halves."""
    part = lambda k, n: t.events.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.collect_set("event_type").alias(n))
    return six(part(0, "a").join(part(1, "b"), "user_id").select("user_id", C.pairing_record(F.col("a"), F.col("b")).alias("r")).select("user_id", "r.*"), "ratio")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def pool_pairs(t):
    """All supplier and customer pairs of a nation."""
    a = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("pool"))
    b = t.customer.select("c_custkey", F.col("c_nationkey").alias("pool"))
    return C.paired_pools(a, b, "pool").select("s_suppkey", "c_custkey")


@query("""
WITH m AS (SELECT user_id, event_type, sum(value) - 300 AS w FROM events GROUP BY ALL), c AS (SELECT user_id, event_type, greatest(w, 0) AS w, sum(greatest(w, 0)) OVER (PARTITION BY user_id) AS s FROM m)
SELECT user_id AS condition, event_type AS policy, round(w / s, 6) AS value, FALSE AS duplicate FROM c WHERE s > 1e-8
""")
def distribution_summary(t):
    """Each user's weights by type as a distribution, one row an entry."""
    per = t.events.groupBy("user_id", "event_type").agg((F.sum("value") - 300).alias("w"))
    maps = per.groupBy(F.col("user_id").alias("condition")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "w"))).alias("m"))
    return six(C.flattened(maps.withColumn("m", C.normalised(F.col("m"))), "condition", "m"), "value")


@query("SELECT event_id, round(CASE WHEN value > 50 THEN 0.8 ELSE 0.2 END * (value - 50) ** 2, 5) AS loss, round(1 - 0.6 * least(abs(value - 60) / 30, 1) - 0.4 * least(abs(value - 50) / 25, 1), 6) AS eye, round(27.5 * 2 ** (value / 100 / 12), 6) AS hz, round(tanh(value / 200), 6) AS dev FROM events")
def signal_functions(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(C.expectile(v - 50), 5).alias("loss"), F.round(Y.eye_contact(v - 60, v - 50), 6).alias("eye"), F.round(C.hertz(v / 100), 6).alias("hz"), F.round(N.scaled("rate_deviation", v / 100), 6).alias("dev"))


@query("""
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS words, round((0.5::DOUBLE * len(w) - 0.1::DOUBLE) * 1000, 4) AS span_ms, round(len(w) / (0.5::DOUBLE * len(w) - 0.1::DOUBLE), 6) AS rate, 500.0::DOUBLE AS latency FROM w
""")
def speech_timing(t):
    """Words half a second apart, from half a second after the question."""
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (0.5 * i + 1.5).alias("start"), (0.5 * i + 1.9).alias("end")))
    rows = t.conversations.select("conv_id", "turn", words.alias("w"))
    out = rows.select("conv_id", "turn", C.speech(F.col("w")).alias("s"), C.response_latency(F.col("w"), F.lit(1.0)).alias("latency"))
    return out.select("conv_id", "turn", "s.words", F.round("s.span_ms", 4).alias("span_ms"), F.round("s.rate", 6).alias("rate"), "latency")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.5 WHEN event_id % 3 = 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS score, event_id % 3 = 1 AS valid FROM events")
def evaluation_parse(t):
    raw = F.when(F.col("event_id") % 3 == 0, "no json").when(F.col("event_id") % 3 == 1, '```json\n{"score": 0.25, "reason": "r"}\n```').otherwise('{"score": 7}')
    return t.events.select("event_id", C.parsed_evaluation(raw).alias("e")).select("event_id", "e.score", "e.valid")


@query("SELECT event_id, CASE WHEN (event_id % 10) / 10.0 < 0.2 THEN 0 WHEN (event_id % 10) / 10.0 < 0.55 THEN 1 ELSE 2 END AS action, CASE event_type WHEN 'click' THEN 0.75 WHEN 'view' THEN 0.25 ELSE 0 END::DOUBLE AS prob FROM events")
def behaviour_policy(t):
    roll = (F.col("event_id") % 10) / 10
    return t.events.select("event_id", C.draw(F.array(F.lit(0.2), F.lit(0.35), F.lit(0.45)), roll).alias("action"), C.behaviour(F.col("event_type"), {"click": 0.3, "view": 0.1, "purchase": 0.5}, ["click", "view"]).alias("prob")).withColumn("prob", F.round("prob", 6))


@query("SELECT n_name, row_number() OVER (ORDER BY k, n_regionkey) AS position FROM (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)")
def persona_interleave(t):
    out = C.interleaved(t.nation, "n_regionkey", "n_nationkey")
    return out.select("n_name", F.col("position").cast("long").alias("position"))


@query("SELECT o_custkey, count(*) AS kept FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey")
def purge_cascade(t):
    _, (orders,) = C.purge(t.customer, [(t.orders, "o_custkey")], "c_custkey", F.col("c_acctbal") < 0)
    return orders.groupBy("o_custkey").agg(F.count("*").alias("kept"))


@query()
def grouped_folds(t):
    """Three folds of whole sources, balanced by documents and languages; the source table is small."""
    per = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")).collect()
    sizes: dict = {}
    for r in per:
        n, by = sizes.get(r.source, (0, {}))
        sizes[r.source] = (n + r.n, by | {r.lang: r.n})
    plan = C.balanced_folds([(s, n, by) for s, (n, by) in sizes.items()])
    return t.spark.createDataFrame(sorted(plan.items()), "source string, fold long")


@query("SELECT event_id, epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) <= 864000000000 AS live FROM events")
def lease_freshness(t):
    return t.events.select("event_id", C.still_live(F.col("ts").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp"), 864_000).alias("live"))


@query("SELECT user_id, event_type, rank AS position FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 6) DESC, event_type) AS rank FROM (SELECT user_id, event_type, stddev_pop(value) AS s FROM events GROUP BY ALL)) WHERE rank <= 5")
def top_entropy_skills(t):
    """At most five per key, by a spread, ties by name."""
    per = t.events.groupBy("user_id", "event_type").agg(F.stddev_pop("value").alias("s"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("s", 6)), "event_type"))
    return per.select("user_id", "event_type", rank.cast("long").alias("position")).filter("position <= 5")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def turn_listing(t):
    """Each turn with its place in its conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", "role", place.cast("long").alias("place"))


@query("SELECT conv_id, turn, role FROM conversations")
def turn_listing_all(t):
    """Turns of all conversations in order."""
    return t.conversations.orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT user_id, round(avg(100 * (0.5 * least(value / 100, 1) + 0.5)), 2) AS score FROM events GROUP BY user_id")
def technical_score(t):
    """Mean over skills of a weighted belief."""
    return t.events.groupBy("user_id").agg(F.round(F.avg(100 * (0.5 * F.least(F.col("value") / 100, F.lit(1.0)) + 0.5)), 2).alias("score"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 999 END::BIGINT AS component, count(*) + 1 AS n FROM customer GROUP BY 1")
def component_of_nations(t):
    """J14 on the hub case: unknown identities all meet in one component."""
    edges = t.customer.select((F.col("c_custkey") + 1000).alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("long")).otherwise(F.lit(999)).alias("b"))
    return G.components(edges).groupBy("component").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS capacity FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
a AS (SELECT *, sum(capacity) OVER (PARTITION BY n_regionkey) AS al, CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN sum(capacity) OVER (PARTITION BY n_regionkey) WHEN 2 THEN sum(capacity) OVER (PARTITION BY n_regionkey) + 1 ELSE sum(capacity) OVER (PARTITION BY n_regionkey) * 3 // 7 END AS total FROM c),
w AS (SELECT *, total <= al AS fits, CASE WHEN total <= al THEN total * capacity // al ELSE 0 END AS whole, CASE WHEN total <= al THEN total * capacity % al ELSE 0 END AS rest FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY whole < capacity DESC, rest DESC, n_nationkey) AS k, CASE WHEN fits THEN total ELSE 0 END - sum(whole) OVER (PARTITION BY n_regionkey) AS spare FROM w)
SELECT n_regionkey, n_nationkey, capacity, fits, CAST(whole + (whole < capacity AND k <= spare)::INT AS BIGINT) AS allocated FROM r
""")
def capacity_shares(t):
    """each region's places over its nations, none above its customers: no places, all, too many, some."""
    per = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("c_custkey").alias("capacity"))
    size = F.sum("capacity").over(Window.partitionBy("n_regionkey"))
    r = F.col("n_regionkey")
    rows = per.withColumn("total", F.when(r == 0, 0).when(r == 1, size).when(r == 2, size + 1).otherwise(F.floor(size * 3 / 7)))
    return G.capacity_shares(rows, ["n_regionkey"], "capacity", "total", "n_nationkey").select("n_regionkey", "n_nationkey", "capacity", "fits", "allocated")
