"""Queries over joins, filters, projections, top-k and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vivaspark.operators import relational as R
from vivaspark.plans.base import query


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def terminal_record(t):
    return R.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'")
def left_outer_on_condition(t):
    out = R.left_on(t.orders, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), F.col("l_returnflag") == "R")
    return out.select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def outstanding_anti_topk(t):
    return R.latest_per_key(R.outstanding(t.orders, t.lineitem, "o_orderkey", "l_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_orderdate + INTERVAL 200 DAY > TIMESTAMP '1998-01-01' AND o_orderstatus <> 'F'")
def live_sessions(t):
    """Users joined to what has not expired at a given now."""
    live = t.orders.filter((F.expr("o_orderdate + INTERVAL 200 DAYS") > F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "F"))
    return t.customer.filter("c_acctbal > 0").join(live, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT n_name, r_name, (SELECT count(*) FROM nation n WHERE n.n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS missing FROM nation JOIN region ON n_regionkey = r_regionkey")
def required_lookup(t):
    missing = R.missing_lookup(t.nation.withColumnRenamed("n_regionkey", "k"), t.region.withColumnRenamed("r_regionkey", "k"), "k").agg(F.count("*").alias("missing"))
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(missing).select("n_name", "r_name", "missing")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def paged_listing(t):
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def queue_claim(t):
    """The job a worker would take next."""
    ready = t.orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1997-06-01").cast("timestamp_ntz")))
    return ready.orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("SELECT source, lang, count(DISTINCT sha256(text)) AS fingerprints, count(*) AS requests FROM documents GROUP BY ALL HAVING count(DISTINCT sha256(text)) > 1")
def idempotency_conflicts(t):
    return R.conflicts(t.documents, ["source", "lang"], F.sha2("text", 256))


_STOP = "CASE WHEN event_type = 'signup' THEN 'stop' WHEN event_id % 5 = 0 THEN NULL ELSE event_type END"


@query(f"SELECT event_type, count(*) AS questions FROM events WHERE ({_STOP}) IS DISTINCT FROM 'stop' AND (CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 8 END) IS DISTINCT FROM 7 GROUP BY event_type")
def question_stop_filter(t):
    rows = t.events.select("event_type", F.expr(_STOP).alias("kind"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 8 END").alias("action"))
    return rows.filter(R.is_question(F.col("kind"), F.col("action"))).groupBy("event_type").agg(F.count("*").alias("questions"))


@query("SELECT event_id, v AS score FROM (SELECT event_id, try_cast(CASE WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value / 80 AS VARCHAR) END AS DOUBLE) AS v, CASE WHEN event_id % 4 = 0 THEN FALSE WHEN event_id % 4 = 1 THEN NULL ELSE TRUE END AS valid FROM events) WHERE valid IS DISTINCT FROM FALSE AND v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 1")
def evidence_filter(t):
    """Not explicitly invalid, castable, finite and in [0, 1]."""
    raw = F.expr("CASE WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value / 80 AS STRING) END")
    valid = F.expr("CASE WHEN event_id % 4 = 0 THEN FALSE WHEN event_id % 4 = 1 THEN NULL ELSE TRUE END")
    rows = t.events.select("event_id", raw.try_cast("double").alias("score"), valid.alias("valid"))
    return rows.filter(~F.col("valid").eqNullSafe(F.lit(False)) & ~F.isnan("score") & F.col("score").between(0, 1)).select("event_id", "score")


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0)")
def referenced_documents(t):
    out = R.referenced(t.nation, "n_nationkey", (t.customer.filter("c_acctbal < 0"), "c_nationkey"), (t.supplier.filter("s_acctbal < 0"), "s_nationkey"))
    return out.select("n_nationkey", "n_name")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, NULL AS segment_missing FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, 'yes' FROM supplier")
def union_by_name(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.lit("yes").alias("segment_missing"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(t):
    return t.customer.select("c_custkey").exceptAll(t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")).distinct()


@query("SELECT count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both_sides FROM (SELECT DISTINCT p_partkey AS a FROM part) FULL JOIN (SELECT DISTINCT l_partkey AS b FROM lineitem WHERE l_quantity > 40) ON a = b")
def set_equality(t):
    return R.same_sets(t.part.select(F.col("p_partkey").alias("k")), t.lineitem.filter("l_quantity > 40").select(F.col("l_partkey").alias("k")), "k")


@query("SELECT user_id, event_type, n AS first_seen FROM (SELECT user_id, event_type, rn AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rn FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL)))")
def ordered_dedupe(t):
    """Distinct values of each user in order of first appearance."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("at"))
    return first.select("user_id", "event_type", place.cast("long").alias("first_seen"))


@query("SELECT doc_id, copies, doc_id = min(doc_id) OVER (PARTITION BY h) AS kept FROM (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS h, count(*) OVER (PARTITION BY sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))))) AS copies FROM documents)")
def normalized_dedupe(t):
    clean = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")))
    return R.first_by_hash(t.documents.select("doc_id", "text"), clean, ["doc_id"]).select("doc_id", "copies", "kept")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def reject_duplicates(t):
    return R.duplicated(t.customer, "c_nationkey", "c_mktsegment")


@query("SELECT p_partkey, row_number() OVER (ORDER BY seen, p_partkey) AS turn FROM (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS seen FROM part) QUALIFY turn <= 200")
def prefer_unseen(t):
    """Unseen items first, then seen ones; the first 200 are planned."""
    seen = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("s", F.lit(True))
    first = t.part.join(seen, "p_partkey", "left").orderBy(F.coalesce("s", F.lit(False)), "p_partkey").limit(200)
    turn = F.row_number().over(Window.orderBy(F.coalesce("s", F.lit(False)), "p_partkey"))  # over 200 rows
    return first.select("p_partkey", turn.cast("long").alias("turn"))


@query("SELECT c_nationkey, c_custkey, up AS rank_high, down AS rank_low FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey DESC) AS down FROM customer) WHERE up <= 3 OR down <= 3")
def top_bottom_k(t):
    return R.top_bottom(t.customer, "c_acctbal", "c_custkey", 3, ["c_nationkey"]).select("c_nationkey", "c_custkey", F.col("rank_high").cast("long").alias("rank_high"), F.col("rank_low").cast("long").alias("rank_low"))


@query("SELECT seq, n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) JOIN range(60) r(seq) ON (seq * 7) % 25 = i")
def cyclic_take(t):
    return R.cyclic_take(t.nation, "n_nationkey", F.col("seq") * 7, F.lit(25), 60).select("seq", "n_name")


@query("SELECT c_nationkey, c_custkey AS best FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) = 1")
def skill_order(t):
    """First by priority, evidence and id."""
    return t.customer.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct("c_mktsegment", -F.col("c_acctbal"), "c_custkey")).alias("best"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax_lowest(t):
    """Position of the largest entry, the lowest on ties."""
    return t.embeddings.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY event_type")
def numeric_summary(t):
    """A10: finite values only, population deviation."""
    v = F.expr("CASE WHEN event_id % 9 = 0 THEN double('NaN') WHEN event_id % 13 = 0 THEN NULL ELSE value END")
    rows = t.events.select("event_type", v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    six = lambda c: F.round(c, 6)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), six(F.avg("v")).alias("mean"), six(F.stddev_pop("v")).alias("std"), six(F.min("v")).alias("low"), six(F.max("v")).alias("high"))


@query("SELECT user_id, episode, count(*) AS turns, min(event_id) AS first_event FROM (SELECT *, CAST(sum(ended) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS episode FROM (SELECT *, coalesce(lag((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS ended FROM events)) GROUP BY user_id, episode")
def done_truncation(t):
    """Positional sessions cut after each 'error' event."""
    rows = R.sessionise(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id", "episode").agg(F.count("*").alias("turns"), F.min("event_id").alias("first_event")).select("user_id", F.col("episode").cast("long").alias("episode"), "turns", "first_event")


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE sha256(text) END, ''), CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END, 'unknown_resume') AS identity FROM documents")
def identity_fallback(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, None).otherwise(F.sha2("text", 256)).alias("digest"), F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("file"))
    return rows.select("doc_id", R.identity("digest", "file", default="unknown_resume").alias("identity"))


@query("SELECT event_id, i AS slot, CASE WHEN i = event_id % 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot FROM events, range(8) r(i) WHERE i IN (0, event_id % 8)")
def one_hot_action(t):
    rows = t.events.select("event_id", (F.col("event_id") % 8).alias("a"), F.posexplode(R.one_hot(F.col("event_id") % 8, 8)).alias("slot", "hot"))
    return rows.filter((F.col("slot") == 0) | (F.col("slot") == F.col("a"))).select("event_id", F.col("slot").cast("long").alias("slot"), "hot")


@query("""
WITH r AS (SELECT event_id, event_id % 8 AS a, list_transform(range(8), lambda i: CASE WHEN i = 5 AND event_id % 6 = 0 THEN 0.0 ELSE 1.0 END) AS mask,
  list_transform(range(8), lambda i: CASE WHEN event_id % 10 = 0 THEN 0.2 ELSE 0.125 END) AS probs FROM events)
SELECT event_id, n AS code FROM (
  SELECT event_id, unnest([CASE WHEN list_sum(list_transform(list_zip(probs, mask), lambda z: CASE WHEN z[2] = 0 AND z[1] > 0 THEN 1 ELSE 0 END)) > 0 THEN 'mass_on_masked' END,
    CASE WHEN abs(list_sum(probs) - 1) > 1e-8 + 1e-5 THEN 'sum' END, CASE WHEN abs(probs[a + 1] - 0.125) > 1e-8 + 1e-5 * 0.125 THEN 'chosen_differs' END]) AS n FROM r) WHERE n IS NOT NULL
""")
def propensity_audit(t):
    i = F.sequence(F.lit(0), F.lit(7))
    mask = F.transform(i, lambda k: F.when((k == 5) & (F.col("event_id") % 6 == 0), 0.0).otherwise(1.0))
    probs = F.transform(i, lambda k: F.when(F.col("event_id") % 10 == 0, 0.2).otherwise(0.125))
    return t.events.select("event_id", F.explode(R.propensity_violations(probs, mask, (F.col("event_id") % 8).cast("int"), F.lit(0.125))).alias("code"))


@query("SELECT o_orderkey, o_totalprice AS raw_total, o_orderstatus AS raw_status, round(o_totalprice / 1000, 6) AS total FROM orders")
def raw_projection(t):
    """Replaced fields keep their first value under raw_ names."""
    kept = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").withColumnsRenamed({"o_totalprice": "raw_total", "o_orderstatus": "raw_status"})
    return kept.withColumn("total", F.round(F.col("raw_total") / 1000, 6))


@query("SELECT lang, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ',') AS sources, count(DISTINCT source) = 1 AS compatible FROM (SELECT lang, coalesce(CASE WHEN doc_id % 50 = 0 THEN NULL ELSE source END, 'missing') AS source FROM documents) GROUP BY lang")
def append_compatibility(t):
    """The values of a contract column; only a single one is compatible."""
    value = F.coalesce(F.when(F.col("doc_id") % 50 != 0, F.col("source")), F.lit("missing"))
    got = t.documents.select("lang", value.alias("v")).groupBy("lang").agg(F.sort_array(F.collect_set("v")).alias("s"))
    return got.select("lang", F.array_join("s", ",").alias("sources"), (F.size("s") == 1).alias("compatible"))


@query("SELECT user_id, a.event_type AS type_a, b.event_type AS type_b, round(abs(a.m - b.m), 6) AS gap FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) a JOIN (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) b USING (user_id) WHERE a.event_type < b.event_type AND abs(a.m - b.m) > 15.0000005")
def fairness_pairs(t):
    """Actions of a session whose mean signal differs by more than the limit."""
    means = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    pairs = R.unordered_pairs(means, "user_id", "event_type").withColumn("gap", F.abs(F.col("m_a") - F.col("m_b")))
    return pairs.filter("gap > 15.0000005").select("user_id", F.col("event_type_a").alias("type_a"), F.col("event_type_b").alias("type_b"), F.round("gap", 6).alias("gap"))


@query("SELECT coalesce(a.k, b.k) AS k, round(a.v, 6) AS va, round(b.v, 6) AS vb FROM (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1) b ON a.k = b.k WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1e-3")
def reproduction_check(t):
    total = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    out = R.reproduced(total(t.orders), total(t.orders.filter("o_orderkey % 97 <> 0")), "k", "v", 1e-3)
    return out.select("k", F.round("va", 6).alias("va"), F.round("vb", 6).alias("vb"))
