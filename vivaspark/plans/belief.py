"""Queries over beliefs, rules, fusion and rollouts."""

from pyspark.sql import functions as F

from vivaspark.functions import rules as U
from vivaspark.operators import belief as B
from vivaspark.operators import rollout as O
from vivaspark.plans.base import query
from vivaspark.plans.metrics import six


def _turns(t):
    reliability = F.when(F.col("event_id") % 5 == 0, 0.6).otherwise(1.0)
    fingerprint = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 6).cast("string"))
    return t.events.select("user_id", "event_type", "ts", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), reliability.alias("reliability"), fingerprint.alias("fingerprint"))


_FOLD = """
WITH RECURSIVE t AS (SELECT user_id, event_type, row_number() OVER w AS i, least(value / 100, 1.0) AS s, CASE WHEN event_id % 5 = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS r, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 6 AS VARCHAR) END AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
d AS (SELECT *, f IS NOT NULL AND row_number() OVER (PARTITION BY user_id, event_type, f ORDER BY i) > 1 AS dup FROM t),
b AS (SELECT user_id, event_type, 0::BIGINT AS i, 1/3::DOUBLE AS p0, 1/3::DOUBLE AS p1, 1/3::DOUBLE AS p2, 0::BIGINT AS n, 0::DOUBLE AS ess FROM d WHERE i = 1
UNION ALL SELECT user_id, event_type, i, CASE WHEN w > 0 THEN f0 / (f0 + f1 + f2) ELSE p0 END, CASE WHEN w > 0 THEN f1 / (f0 + f1 + f2) ELSE p1 END, CASE WHEN w > 0 THEN f2 / (f0 + f1 + f2) ELSE p2 END, n + (w > 0)::INT, ess + greatest(w, 0)
FROM (SELECT *, greatest(e0 / (e0 + e1 + e2), 1e-4) AS f0, greatest(e1 / (e0 + e1 + e2), 1e-4) AS f1, greatest(e2 / (e0 + e1 + e2), 1e-4) AS f2
FROM (SELECT *, p0 * exp(-0.5 * w * ((s - 0.2) / 0.22) ** 2) AS e0, p1 * exp(-0.5 * w * ((s - 0.5) / 0.22) ** 2) AS e1, p2 * exp(-0.5 * w * ((s - 0.8) / 0.22) ** 2) AS e2
FROM (SELECT d.user_id, d.event_type, d.i, d.s, b.p0, b.p1, b.p2, b.n, b.ess, least(d.r / (1 + b.ess) ** 0.5 * CASE WHEN d.dup THEN 0.25 ELSE 1 END, greatest(5 - b.ess, 0)) AS w FROM b JOIN d ON d.user_id = b.user_id AND d.event_type = b.event_type AND d.i = b.i + 1)))),
z AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY i DESC) = 1)
"""


@query(_FOLD + "SELECT user_id, event_type, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, n, round(ess, 6) AS ess FROM z")
def belief_fold(t):
    out = B.skill_beliefs(_turns(t), "user_id", "event_type", ["ts", "event_id"])
    return out.select("user_id", "event_type", *[F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)], F.col("n").cast("long").alias("n"), F.round("ess", 6).alias("ess"))


@query(_FOLD + """
, w AS (SELECT user_id, least(ess, 5) AS w, p0, p1, p2 FROM z WHERE n > 0), g AS (SELECT user_id, sum(w) AS evidence, count(*) AS covered, exp(sum(w * ln(p0 * 3)) / sum(w)) / 3 AS a, exp(sum(w * ln(p1 * 3)) / sum(w)) / 3 AS b, exp(sum(w * ln(p2 * 3)) / sum(w)) / 3 AS c FROM w GROUP BY user_id),
s AS (SELECT user_id, evidence, covered, [greatest(a / (a + b + c), 1e-4), greatest(b / (a + b + c), 1e-4), greatest(c / (a + b + c), 1e-4)] AS q FROM g), f AS (SELECT *, list_transform(q, lambda x: x / list_sum(q)) AS p FROM s)
SELECT user_id, CASE WHEN list_max(p) >= 0.5 AND evidence >= 2 AND covered >= 3 THEN list_position(p, list_max(p)) - 1 END AS label, list_position(p, list_max(p)) - 1 AS raw_label, round(list_max(p), 6) AS confidence, round(evidence, 6) AS evidence, covered, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 6) AS entropy FROM f
""")
def belief_assessment(t):
    """Flagship: terminal belief of each user from an ordered event stream, with a class or an abstention."""
    out = B.assessment(B.skill_beliefs(_turns(t), "user_id", "event_type", ["ts", "event_id"]), "user_id").drop("pool")
    return six(out, "confidence", "evidence", "entropy")


def _signals(t):
    e = F.col("event_id")
    v = F.col("value") / 100
    raw = {"pitch_deviation": F.when(e % 3 != 0, U.sigmoid(v, 0.3, 6.0)), "rate_deviation": F.when(e % 4 != 0, U.sigmoid(v, 0.25, 6.0)), "gaze_instability": F.when(e % 5 != 0, 1 - U.unit(v)), "jitter": F.when(e % 7 != 0, U.sigmoid(v / 50, 0.02, 100.0)), "pause_density": F.when(e % 2 != 0, U.sigmoid((e % 9).cast("double"), 4.0, 0.8))}
    stress, n = U.distress(raw)
    return t.events.select("event_id", "value", stress.alias("stress"), n.alias("signals"))


_SIG = """
WITH r AS (SELECT event_id, value, CASE WHEN event_id % 3 <> 0 THEN 1 / (1 + exp(-6 * (value / 100 - 0.3))) END AS a, CASE WHEN event_id % 4 <> 0 THEN 1 / (1 + exp(-6 * (value / 100 - 0.25))) END AS b, CASE WHEN event_id % 5 <> 0 THEN 1 - least(greatest(value / 100, 0), 1) END AS c, CASE WHEN event_id % 7 <> 0 THEN 1 / (1 + exp(-100 * (value / 5000 - 0.02))) END AS d, CASE WHEN event_id % 2 <> 0 THEN 1 / (1 + exp(-0.8 * (event_id % 9 - 4))) END AS e FROM events),
s AS (SELECT event_id, value, coalesce((coalesce(a * 0.2, 0) + coalesce(b * 0.15, 0) + coalesce(c * 0.15, 0) + coalesce(d * 0.1, 0) + coalesce(e * 0.1, 0)) / nullif((a IS NOT NULL)::INT * 0.2::DOUBLE + (b IS NOT NULL)::INT * 0.15::DOUBLE + (c IS NOT NULL)::INT * 0.15::DOUBLE + (d IS NOT NULL)::INT * 0.1::DOUBLE + (e IS NOT NULL)::INT * 0.1::DOUBLE, 0), 0) AS stress,
  (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT + (e IS NOT NULL)::INT AS signals FROM r)
"""


@query(_SIG + "SELECT event_id, round(stress, 6) AS stress, signals FROM s")
def distress_redistribution(t):
    return six(_signals(t), "stress").select("event_id", "stress", "signals")


@query(_SIG + "SELECT event_id, CASE WHEN event_id % 20 >= 2 THEN CASE WHEN stress >= 0.45 AND x >= 0.55 THEN 'anxiety' WHEN stress >= 0.45 THEN 'ignorance' WHEN x >= 0.55 THEN 'low' ELSE 'confident_ignorance' END END AS label, round(least(greatest(0.4 + 0.35 * (abs(stress - 0.45) + abs(x - 0.55)) / 2 + 0.25 * signals / 7, 0), 1), 6) AS confidence, 0.9 - x > 0.4 AS bluffing FROM (SELECT *, least(value / 200, 1) AS x FROM s)")
def cognitive_quadrant(t):
    x = F.least(F.col("value") / 200, F.lit(1.0))
    return _signals(t).select("event_id", U.quadrant(F.col("stress"), x, F.col("event_id") % 20 + 1).alias("label"), F.round(U.quadrant_confidence(F.col("stress"), x, F.col("signals")), 6).alias("confidence"), U.incongruence(F.lit(0.9), x).alias("bluffing"))


@query("""
WITH r AS (SELECT event_id, value * 80 AS ms, (event_id % 20) / 100.0::DOUBLE AS cv FROM events), p AS (SELECT *, CASE WHEN ms < 5000 THEN 0 WHEN ms >= 10000 THEN 1 ELSE (ms - 5000) / 5000 END AS ramp FROM r)
SELECT event_id, round(c, 6) AS confidence, CASE WHEN c >= 0.5 THEN 'Reject (Integrity Flags)' WHEN ms / 100 <= 40 THEN 'Reject (Technical Incompetency)' WHEN ms / 100 >= 75 THEN 'Strong Hire' ELSE 'Hire' END AS verdict
FROM (SELECT *, least(greatest(CASE WHEN ms >= 5000 AND cv < 0.08 THEN 0.5 + 0.3 * ramp + 0.2 * (1 - cv / 0.08) WHEN ms >= 5000 THEN 0.15 + 0.25 * ramp WHEN cv < 0.08 THEN 0.1 + 0.15 * (1 - cv / 0.08) ELSE 0 END, 0), 1) AS c FROM p)
""")
def integrity_flags(t):
    ms, cv = F.col("value") * 80, (F.col("event_id") % 20) / 100
    c = U.ai_assist(ms, cv)
    flagged = F.size(U.flags(F.create_map(F.lit("ai_assist"), c))) > 0
    return t.events.select("event_id", F.round(c, 6).alias("confidence"), U.recommendation(ms / 100, flagged).alias("verdict"))


@query("""
WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings), v AS (SELECT vec_id, e[1:11] AS t, e[12:44] AS v, e[45:64] AS p, (label % 3 > 0)::INT AS mv, (label % 4 > 0)::INT AS mp FROM m),
n AS (SELECT *, least(greatest(1 - list_dot_product(t, v[1:11]) / sqrt(list_dot_product(t, t) * list_dot_product(v[1:11], v[1:11])), 0), 1) AS tv, least(greatest(1 - list_dot_product(t, p[1:11]) / sqrt(list_dot_product(t, t) * list_dot_product(p[1:11], p[1:11])), 0), 1) AS tp, least(greatest(1 - list_dot_product(v[1:20], p) / sqrt(list_dot_product(v[1:20], v[1:20]) * list_dot_product(p, p)), 0), 1) AS vp FROM v),
s AS (SELECT vec_id, mv, mp, 0.9 ** 1.25 * (0.5 + 0.5 * least(list_sum(list_transform(t, lambda x: abs(x))) / 11, 1)) * (1 - 0.35 * coalesce((tv * mv + tp * mp) / nullif(mv + mp, 0), 0)) AS st,
  CASE WHEN mv > 0 THEN 0.8 ** 1.25 * (0.5 + 0.5 * least(list_sum(list_transform(v, lambda x: abs(x))) / 33, 1)) * (1 - 0.35 * ((tv + vp * mp) / (1 + mp))) END AS sv, CASE WHEN mp > 0 THEN 0.7 ** 1.25 * (0.5 + 0.5 * least(list_sum(list_transform(p, lambda x: abs(x))) / 20, 1)) * (1 - 0.35 * ((tp + vp * mv) / (1 + mv))) END AS sp FROM n),
x AS (SELECT vec_id, exp(st / 0.75) AS a, coalesce(exp(sv / 0.75), 0) AS b, coalesce(exp(sp / 0.75), 0) AS c FROM s)
SELECT vec_id, round(a / (a + b + c), 6) AS text, round(b / (a + b + c), 6) AS vision, round(c / (a + b + c), 6) AS prosody FROM x
""")
def fusion_attention(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.embeddings.select("vec_id", F.slice(e, 1, 11).alias("t"), F.slice(e, 12, 33).alias("v"), F.slice(e, 45, 20).alias("p"), (F.col("label") % 3 > 0).cast("double").alias("mv"), (F.col("label") % 4 > 0).cast("double").alias("mp"))
    out = U.fuse(rows.withColumn("mt", F.lit(1.0)), {"text": ("t", 11), "vision": ("v", 33), "prosody": ("p", 20)}, {"text": "mt", "vision": "mv", "prosody": "mp"}, {"text": 0.9, "vision": 0.8, "prosody": 0.7})
    return out.select("vec_id", *[F.round(f"w_{m}", 6).alias(m) for m in ("text", "vision", "prosody")])


_FRAMES = "SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 1000.0::DOUBLE AS ms, value / 5 AS yaw, (event_id % 7) * 0.5::DOUBLE AS pitch, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events"
#: The fold over frames, a row a frame: the open segment after it, and the segment that it closed.
_SWEEPS = f"""
WITH RECURSIVE f AS ({_FRAMES}), n AS (SELECT user_id, day, max(i) AS n, max(ms) - min(ms) AS turn FROM f GROUP BY ALL),
s AS (
  SELECT user_id, day, i, 0 AS steps, 0 AS way, 0 AS back, ms AS ms0, yaw AS yaw0, pitch AS low, pitch AS high, ms, yaw, pitch, 0 AS cway, ms AS cms0, ms AS cms1, 0::DOUBLE AS cwidth, 0::DOUBLE AS cpitch FROM f WHERE i = 1
  UNION ALL
  SELECT user_id, day, i, CASE WHEN breaks THEN 1 ELSE steps + 1 END, CASE WHEN breaks OR way = 0 THEN goes ELSE way END, CASE WHEN breaks THEN 0 ELSE backs END, CASE WHEN breaks THEN pms ELSE ms0 END, CASE WHEN breaks THEN pyaw ELSE yaw0 END,
    CASE WHEN breaks THEN least(ppitch, pitch) ELSE least(low, pitch) END, CASE WHEN breaks THEN greatest(ppitch, pitch) ELSE greatest(high, pitch) END, ms, yaw, pitch,
    CASE WHEN breaks THEN way ELSE 0 END, ms0, pms, abs(pyaw - yaw0), high - low
  FROM (SELECT *, way <> 0 AND backs::DOUBLE / (steps + 1) > 0.25 AS breaks FROM (
    SELECT f.user_id, f.day, f.i, s.steps, s.way, s.ms0, s.yaw0, s.low, s.high, s.ms AS pms, s.yaw AS pyaw, s.pitch AS ppitch, f.ms, f.yaw, f.pitch, (f.yaw - s.yaw > 0.5)::INT - (f.yaw - s.yaw < -0.5)::INT AS goes, s.back + (s.way <> 0 AND s.way * (f.yaw - s.yaw) < -3)::INT AS backs
    FROM s JOIN f ON f.user_id = s.user_id AND f.day = s.day AND f.i = s.i + 1))
),
c AS (SELECT user_id, day, cway AS way, cms0 AS a, cms1 AS b, cwidth AS width, cpitch AS p FROM s UNION ALL SELECT s.user_id, s.day, way, ms0, ms, abs(yaw - yaw0), high - low FROM s JOIN n ON n.user_id = s.user_id AND n.day = s.day AND s.i = n.n),
g AS (SELECT * FROM c WHERE way <> 0 AND b - a >= 2000 AND width >= 8 AND p <= 10)
"""


def _sweeps(t):
    """A user's day is one turn of frames: yaw from value, pitch from the id."""
    ts = F.col("ts").cast("timestamp")
    frame = F.struct((F.unix_micros(ts) / 1000).alias("ms"), "event_id", (F.col("value") / 5).alias("yaw"), ((F.col("event_id") % 7) * 0.5).alias("pitch"))
    days = t.events.groupBy("user_id", ts.cast("date").alias("day")).agg(F.sort_array(F.collect_list(frame)).alias("frames"))
    return days.select("user_id", "day", U.sweeps(F.col("frames")).alias("found"), (F.element_at("frames", -1).ms - F.get("frames", F.lit(0)).ms).alias("turn_ms"), F.size("frames").alias("n"))


@query(_SWEEPS + "SELECT user_id, day, round(a, 3) AS start_ms, round(b - a, 3) AS duration_ms, round(width, 6) AS yaw_range, CASE WHEN way > 0 THEN 'left_to_right' ELSE 'right_to_left' END AS direction FROM g")
def gaze_sweeps(t):
    """W07."""
    one = _sweeps(t).select("user_id", "day", F.explode("found").alias("s"))
    return one.select("user_id", "day", F.round("s.start_ms", 3).alias("start_ms"), F.round("s.duration_ms", 3).alias("duration_ms"), F.round("s.yaw_range", 6).alias("yaw_range"), "s.direction")


@query(_SWEEPS + ", k AS (SELECT user_id, day, max(b - a) AS longest, sum(b - a) AS spent, count(*) AS sweeps FROM g GROUP BY ALL) SELECT n.user_id, n.day, coalesce(sweeps, 0) AS sweeps, round(CASE WHEN sweeps IS NULL THEN 0 ELSE 0.4 * least(longest / 4000, 1) + 0.35 * least(spent / greatest(turn, 1), 1) + 0.25 * least(sweeps / 3.0, 1) END::DOUBLE, 6) AS confidence FROM n LEFT JOIN k ON k.user_id = n.user_id AND k.day = n.day WHERE n.n >= 3")
def note_reading(t):
    """F55 of every turn with three frames or more."""
    return _sweeps(t).filter("n >= 3").select("user_id", "day", F.size("found").cast("long").alias("sweeps"), F.round(U.note_reading(F.col("found"), F.col("turn_ms")), 6).alias("confidence"))


@query(f"""
WITH e AS (SELECT event_id, event_id % 3 AS label, event_id % 30 AS turn, CASE event_id % 4 WHEN 0 THEN '{O.ACTIONS[2]}' WHEN 1 THEN '{O.ACTIONS[4]}' ELSE '{O.ACTIONS[3]}' END AS action, event_type, user_id FROM events),
j AS (SELECT *, (('0x' || substr(sha256(concat_ws('|', user_id, 'episode-' || user_id, turn, action, event_type)), 1, 16))::UBIGINT % 2001)::DOUBLE / 2000 - 0.5 AS own, (('0x' || substr(sha256('bias|' || user_id), 1, 16))::UBIGINT % 2001)::DOUBLE / 2000 - 0.5 AS bias FROM e)
SELECT event_id, round(own, 6) AS jitter, round(least(1, greatest(0, CASE label WHEN 0 THEN 0.38 WHEN 1 THEN 0.5 ELSE 0.62 END::DOUBLE + own * 0.5 + bias * 0.24 + CASE WHEN event_id % 4 < 2 THEN 0.025 ELSE 0 END)), 6) AS score FROM j
""")
def scenario_evidence(t):
    """Scores of the overlap condition, each event a question of its user's scenario."""
    c, k = O.CONDITIONS["overlap"], F.col("event_id") % 4
    action = F.when(k == 0, O.ACTIONS[2]).when(k == 1, O.ACTIONS[4]).otherwise(O.ACTIONS[3])
    rows = t.events.select("event_id", "event_type", "user_id", F.concat(F.lit("episode-"), F.col("user_id").cast("string")).alias("episode"), (F.col("event_id") % 30).alias("turn"), action.alias("action"), F.get(F.array(*map(F.lit, c.centres)), (F.col("event_id") % 3).cast("int")).alias("centre"))
    token = F.concat_ws("|", F.col("user_id").cast("string"), "episode", F.col("turn").cast("string"), "action", "event_type")
    score = O.evidence(F.col("centre"), F.lit(c.jitter), F.lit(c.bias_width), F.lit(c.shift), F.col("user_id"), F.col("episode"), F.col("turn"), F.col("action"), F.col("event_type"))
    return rows.select("event_id", F.round(O.jitter(token), 6).alias("jitter"), F.round(score, 6).alias("score"))
