"""Feature plans on the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vivaspark.functions import signals as Y
from vivaspark.operators import features as N
from vivaspark.plans.base import query

NAMES = [*N.TEXT, *N.VISION, *N.PROSODY]

_NAME_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES))


@query(f"""
WITH n(i, name) AS (VALUES {_NAME_ROWS}), x AS (
  SELECT vec_id, name, (CASE WHEN i % 9 = 8 AND vec_id % 5 = 0 THEN NULL ELSE embedding[i % 64 + 1]::DOUBLE * (1 + 40 * (i % 7)) END) AS v FROM embeddings, n)
SELECT vec_id, name, round(CASE
  WHEN name LIKE '%\\_prob' ESCAPE '\\' OR name LIKE '%confidence%' OR name LIKE '%\\_score' ESCAPE '\\' OR name LIKE '%activation%' THEN least(greatest(v, 0), 1)
  WHEN name LIKE '%\\_ms' ESCAPE '\\' OR name LIKE '%latency%' OR name LIKE '%duration%' THEN greatest(v, 0) / (greatest(v, 0) + 5000)
  WHEN contains(name, 'word_count') THEN greatest(v, 0) / (greatest(v, 0) + 100)
  WHEN contains(name, 'pause_count') OR contains(name, 'disfluency_count') THEN greatest(v, 0) / (greatest(v, 0) + 10)
  WHEN contains(name, 'blink_rate') THEN greatest(v, 0) / (greatest(v, 0) + 60)
  WHEN contains(name, 'pitch_mean') THEN greatest(v, 0) / (greatest(v, 0) + 300)
  WHEN contains(name, 'pitch_variance') OR contains(name, 'pitch_range') THEN greatest(v, 0) / (greatest(v, 0) + 150)
  WHEN contains(name, 'speech_rate') THEN greatest(v, 0) / (greatest(v, 0) + 8)
  WHEN contains(name, 'energy_mean') OR contains(name, 'jitter') OR contains(name, 'shimmer') THEN greatest(v, 0) / (greatest(v, 0) + 1)
  WHEN contains(name, 'speech_to_silence_ratio') THEN greatest(v, 0) / (greatest(v, 0) + 10)
  WHEN contains(name, 'deviation') THEN tanh(v / 2)
  WHEN name IN ('gaze_yaw', 'gaze_pitch', 'head_roll', 'head_pitch', 'head_yaw') THEN tanh(v / 45)
  WHEN starts_with(name, 'mfcc_') THEN tanh(v / 50)
  ELSE v END, 6) AS scaled
FROM x WHERE v IS NOT NULL
""")
def feature_scaling(t):
    """F32: all 72 names over the numbers of each vector, spread over their scales; missing values go."""
    e = lambda i: F.get("embedding", F.lit(i % 64)).cast("double") * (1 + 40 * (i % 7))
    raw = {n: F.when(F.col("vec_id") % 5 != 0, e(i)) if i % 9 == 8 else e(i) for i, n in enumerate(NAMES)}
    rows = t.embeddings.select("vec_id", N.raw_vector(tuple(NAMES), raw).alias("r")).select("vec_id", N.scaled_vector(tuple(NAMES), F.col("r")).alias("v"))
    out = rows.select("vec_id", F.explode(F.arrays_zip(F.array(*map(F.lit, NAMES)).alias("name"), F.col("v").alias("scaled"))).alias("x"))
    return out.select("vec_id", F.col("x.name").alias("name"), F.round("x.scaled", 6).alias("scaled")).filter("scaled IS NOT NULL")


def turns(events):
    """events as turns: type and time say which modalities are there and which fields are missing."""
    v, k = F.col("value"), F.col("event_id")
    gap = lambda x, m: F.when(k % m != 0, x)

    def some(there: Column, *fields: Column) -> Column:
        return F.when(there, F.struct(*fields))

    words = F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end")))
    mapped = lambda names, f: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[f(i) for i in range(len(names))]))
    return events.select(
        "user_id", "ts", "event_id",
        some(k % 11 != 0, gap(v / 100, 3).alias("confidence"), (v * 50).alias("response_latency_ms"), F.when(k % 4 != 0, F.concat_ws(" ", F.col("event_type"), F.lit("né it's"))).alias("transcript"), gap(words, 6).alias("word_timestamps")).alias("stt"),
        some(k % 3 != 1, (v / 90).alias("semantic_similarity"), gap(v / 80, 4).alias("question_relevance"), (v / 70).alias("answer_completeness"), gap(v / 100, 5).alias("confidence"), F.when(k % 2 == 0, "Expert ").otherwise("none").alias("predicted_competency"), F.when(k % 7 == 0, mapped(["Mid", "beginner "], lambda i: v * i / 100)).alias("competency_distribution")).alias("semantic"),
        some(F.col("event_type") != "click", gap(v / 120, 4).alias("emotion_confidence"), F.when(k % 2 == 0, "Nervous").alias("emotion_label"), F.when(k % 3 == 0, mapped(list(N.EMOTIONS), lambda i: v * i / 1000)).alias("emotion_distribution"), (v / 100).alias("eye_contact_ratio"), v.alias("blink_rate"), gap(v - 50, 5).alias("blink_rate_deviation"), F.struct((v - 50).alias("yaw"), (v - 40).alias("pitch")).alias("gaze_vector"), F.struct(v.alias("roll"), v.alias("yaw")).alias("head_pose"), mapped(list(N.ACTION_UNITS[:5]), lambda i: v * i / 300).alias("au_activations"), mapped(list(N.ACTION_UNITS[3:]), lambda i: v - 10 * i).alias("au_deviations")).alias("vision"),
        some(k % 5 != 2, (v * 3).alias("pitch_mean"), gap(v, 3).alias("pitch_variance"), (v * 2).alias("pitch_range"), (v / 20).alias("speech_rate"), (k % 9).alias("pause_count"), (v * 100).alias("pause_total_duration_ms"), (k % 4).alias("disfluency_count"), (v * 40).alias("response_latency_ms"), (v / 60).alias("energy_mean"), gap(v / 500, 7).alias("jitter"), F.when(k % 8 == 0, float("nan")).otherwise(v / 400).alias("shimmer"), (v / 9).alias("speech_to_silence_ratio"), (v / 50 - 1).alias("pitch_deviation"), F.array(*[v - 7 * i for i in range(11)]).alias("mfcc_vector")).alias("prosody"),
    )


@query()
def fused_turns(t):
    """Vectors of all events as turns of their users, with masks, confidences and imputed names."""
    rows = N.turn_features(turns(N.dealt(t.events, "user_id", ["ts", "event_id"])), ["user_id", "ts", "event_id"])
    masks = [F.col(f"{m}.{x}").alias(f"{m}_{x}") for m in N.MODALITIES for x in ("mask", "confidence")]
    out = N.walked(rows.select("user_id", "event_id", *masks, *N.MODALITIES), "user_id")
    return out.select("user_id", "event_id", *[F.round(f"{m}_{x}", 6).alias(f"{m}_{x}") for m in N.MODALITIES for x in ("mask", "confidence")], F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), "imputed")


_CLASSIFIED = ("happy", "neutral", "fear", "surprise", "sad", "disgust", "angry", "bored")


def _emotions():
    names = F.array(*map(F.lit, _CLASSIFIED))
    return F.map_from_arrays(names, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.col("event_id") % 13 == 0, 0.0).otherwise(((F.col("event_id") * (i + 3)) % 17).cast("double"))))


_SHARED = ", ".join(f"('{k}', {w})" for k, w in [*((k, list(w)) for k, w in Y.SHARES.items()), ("bored", [0.0, 0.0, 0.0, 0.0, 1.0])])


@query(f"""
WITH s(name, w) AS (VALUES {_SHARED}), r AS (SELECT event_id, i, CASE WHEN event_id % 13 = 0 THEN 0 ELSE (event_id * (i + 3)) % 17 END::DOUBLE AS v, {list(_CLASSIFIED)}[i + 1] AS name FROM events, range(8) t(i)),
t AS (SELECT event_id, v / sum(v) OVER (PARTITION BY event_id) AS p, w FROM (SELECT * FROM r WHERE event_id % 13 <> 0 AND event_id % 17 <> 0) JOIN s USING (name)),
d AS (SELECT event_id, {', '.join(f'sum(p * w[{i}]) AS d{i}' for i in range(1, 6))} FROM t GROUP BY event_id)
SELECT event_id, round(greatest(d1, d2, d3, d4, d5), 6) AS confidence, round(d1, 4) AS engaged, round(d3, 4) AS nervous FROM d
""")
def emotion_shares(t):
    """maps of eight emotions, one of them unknown; those of only zeros have no result."""
    out = t.events.select("event_id", Y.shared_emotions(_emotions()).alias("e")).filter("e IS NOT NULL")
    return out.select("event_id", F.round("e.confidence", 6).alias("confidence"), F.get("e.distribution", F.lit(0)).alias("engaged"), F.get("e.distribution", F.lit(2)).alias("nervous"))


def _xy(i: int) -> str:
    return f"e[{i % 64 + 1}]::DOUBLE AS x{i}, e[{i * 7 % 64 + 1}]::DOUBLE AS y{i}"


_P = Y.POINTS
_D = lambda i, j: f"(sqrt((x{i} - x{j}) ** 2 + (y{i} - y{j}) ** 2) / u)"
_S = lambda x, low, high: f"least(greatest(({x} - {low}) / ({high} - {low}), 0), 1)"


@query(f"""
WITH p AS (SELECT vec_id, {', '.join(_xy(i) for i in sorted({*_P.values(), *Y.LEFT_EYE, *Y.RIGHT_EYE}))} FROM (SELECT vec_id, embedding AS e FROM embeddings)),
q AS (SELECT *, CASE WHEN sqrt((x33 - x263) ** 2 + (y33 - y263) ** 2) < 1e-6 THEN 1 ELSE sqrt((x33 - x263) ** 2 + (y33 - y263) ** 2) END AS u FROM p),
g AS (SELECT *, (y1 - (y61 + y291) / 2) / u AS lift, sqrt(((x13 + x14) / 2 - (x17 + x18) / 2) ** 2 + ((y13 + y14) / 2 - (y17 + y18) / 2) ** 2) / u AS gap FROM q)
SELECT vec_id, round({_S(f'({_D(107, 159)} + {_D(336, 386)}) / 2', 0.08, 0.18)}, 6) AS au1, round({_S(f'({_D(70, 159)} + {_D(300, 386)}) / 2', 0.1, 0.22)}, 6) AS au2,
  round(1 - {_S('sqrt(((x9 + x10) / 2 - (x159 + x386) / 2) ** 2 + ((y9 + y10) / 2 - (y159 + y386) / 2) ** 2) / u', 0.06, 0.14)}, 6) AS au4, round({_S(f'0.2 - ({_D(50, 159)} + {_D(280, 386)}) / 2', 0, 0.08)}, 6) AS au6,
  round({_S(f'{_D(61, 291)} * 0.5 + lift', 0.15, 0.45)}, 6) AS au12, round({_S('0.35 - lift', 0, 0.15)}, 6) AS au15, round({_S('sqrt((x152 - (x17 + x18) / 2) ** 2 + (y152 - (y17 + y18) / 2) ** 2) / u', 0.04, 0.12)}, 6) AS au17,
  round({_S('0.08 - gap', 0, 0.06)}, 6) AS au23, round({_S('gap', 0.02, 0.1)}, 6) AS au25,
  round((({_D(160, 144)} + {_D(158, 153)}) / (2 * {_D(33, 133)}) + ({_D(385, 380)} + {_D(387, 373)}) / (2 * {_D(362, 263)})) / 2, 5) AS aspect
FROM g
""")
def action_units(t):
    """each vector's numbers as the landmarks of a face."""
    at = lambda i: tuple(F.get("embedding", F.lit(k % 64)).cast("double") for k in (i, i * 7))
    units = {k.lower(): F.round(v, 6).alias(k.lower()) for k, v in Y.action_units(at).items()}
    return t.embeddings.select("vec_id", *units.values(), F.round(Y.eye_aspect(at), 5).alias("aspect"))
