"""Delivery of answers on the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vivaspark.operators import delivery as D
from vivaspark.plans import text  # noqa: F401  its SQL is part of that of scripted_turns
from vivaspark.plans.base import ORACLE_SQL, query
from vivaspark.plans.metrics import six

#: A turn's words start half a second apart and last a quarter to a whole second: gaps of exactly a quarter, none, and overlaps.
_WORDS = """
w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
x AS (SELECT conv_id, turn, len(w) AS n, i, w[i + 1] AS word, 0.5 * i + CASE WHEN i % 11 = 10 THEN 0.25 ELSE 0 END AS s, 0.5 * i + CASE i % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.26 END + CASE WHEN i % 11 = 10 THEN 0.25 ELSE 0 END AS e FROM w, LATERAL (SELECT unnest(range(len(w))) AS i))"""


def _words(t):
    late = lambda i: F.when(i % 11 == 10, 0.25).otherwise(0.0)
    lasts = lambda i: F.when(i % 4 == 0, 0.25).when(i % 4 == 1, 0.5).when(i % 4 == 2, 1.0).otherwise(0.26)
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (0.5 * i + late(i)).alias("start"), (0.5 * i + lasts(i) + late(i)).alias("end")))
    return t.conversations.select("conv_id", "turn", words.alias("words"))


@query(f"""
WITH {_WORDS},
o AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY conv_id, turn ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM x),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
m AS (SELECT conv_id, turn, k, min(s) AS s, max(e) AS e, any_value(n) AS n FROM g GROUP BY ALL), p AS (SELECT *, s - lag(e) OVER (PARTITION BY conv_id, turn ORDER BY s) AS gap FROM m),
r AS (SELECT conv_id, turn, sum(e - s) AS speech, CASE WHEN any_value(n) % 3 = 0 THEN 0 ELSE any_value(n) * 0.5 + 2 END AS total, count(*) FILTER (gap > 0.25) AS pauses, coalesce(sum(gap) FILTER (gap > 0.25), 0) * 1000 AS paused FROM p GROUP BY ALL)
SELECT conv_id, turn, round(speech::DOUBLE, 6) AS speech, round(CASE WHEN greatest(total - speech, 0) < 1e-4 THEN 1e6 ELSE speech::DOUBLE / (total - speech)::DOUBLE END, 6) AS ratio, pauses, round(paused::DOUBLE, 6) AS paused_ms FROM r
""")
def speech_and_silence(t):
    """Overlapping words merged; every third turn has no silence at all."""
    n = F.size("words")
    total = F.when(n % 3 == 0, 0.0).otherwise(n * 0.5 + 2)
    rows = _words(t).select("conv_id", "turn", total.alias("total"), F.explode("words").alias("w")).select("conv_id", "turn", "total", "w.start", "w.end")
    return six(D.speech_and_pauses(rows, ["conv_id", "turn"], "start", "end", "total"), "speech", "ratio", "paused_ms")


@query(f"""
WITH {_WORDS}, l AS (SELECT *, regexp_replace(lower(word), '[^a-z]', '', 'g') AS a FROM x), y AS (SELECT *, len(regexp_extract_all(a, '[aeiouy]+')) AS v FROM l),
z AS (SELECT *, CASE WHEN a = '' THEN 0 ELSE greatest(v - (a LIKE '%e' AND v > 1)::INT, 1) END AS syl FROM y)
SELECT conv_id, turn, round(sum(syl) / (arg_max(e, i) - arg_min(s, i))::DOUBLE, 6) AS rate, count(*) FILTER (a IN ('um', 'uh', 'erm', 'hmm', 'ah', 'the')) AS fillers, round(coalesce(sum(s) FILTER (a IN ('um', 'uh', 'erm', 'hmm', 'ah', 'the')), 0)::DOUBLE, 6) AS said_at FROM z GROUP BY conv_id, turn
""")
def speech_rates(t):
    """Syllables a second, and the times of fillers. The table has none, so `the` is said as one of them."""
    words = F.transform("words", lambda w: F.struct(F.when(F.regexp_replace(F.lower(w.word), "[^a-z]", "") == "the", "Um,").otherwise(w.word).alias("word"), w.start.alias("start"), w.end.alias("end")))
    # `the` and `um` both have one syllable.
    rows = _words(t).select("conv_id", "turn", words.alias("words"))
    out = rows.select("conv_id", "turn", D.speech_rate(F.col("words")).alias("rate"), D.filler_times(F.col("words")).alias("at"))
    return six(out.select("conv_id", "turn", "rate", F.size("at").cast("long").alias("fillers"), F.aggregate("at", F.lit(0.0), lambda a, x: a + x).alias("said_at")), "rate", "said_at")


@query(f"""
WITH sim AS ({ORACLE_SQL["history_similarity_all"]}),
w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, text, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS n, coalesce(list_avg(list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')) - (x LIKE '%e' AND len(regexp_extract_all(x, '[aeiouy]+')) > 1)::INT + regexp_matches(x, '[^aeiouy]le$')::INT, 1))), 0) AS c FROM w),
h AS (SELECT *, avg(c) FILTER (trim(text) <> '') OVER p AS b, count(*) OVER p AS k FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT h.conv_id, h.turn, k >= 2 AND n >= 5 AS judged, CASE WHEN b > 0.01 THEN c / b ELSE 1 END AS shift, coalesce(similarity, 0) AS sim FROM h LEFT JOIN sim USING (conv_id, turn))
SELECT conv_id, turn, round(CASE WHEN judged THEN sim ELSE 0 END::DOUBLE, 6) AS similarity, round(CASE WHEN judged THEN shift ELSE 0 END::DOUBLE, 6) AS shift,
  round(CASE WHEN NOT judged THEN 0 WHEN sim >= 0.65 AND (shift >= 1.8 OR (shift > 0 AND shift <= 1 / 1.8)) THEN 0.55 + 0.35 * least((sim - 0.65) / (0.15 + 1e-6), 1) WHEN sim >= 0.65 THEN 0.3 + 0.25 * least((sim - 0.65) / (0.15 + 1e-6), 1) WHEN shift >= 1.8 OR (shift > 0 AND shift <= 1 / 1.8) THEN 0.15 ELSE 0 END::DOUBLE, 4) AS confidence FROM s
""")
def scripted_turns(t):
    """F56."""
    said = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", "text")
    out = D.scripting(said, "conv_id", "turn", "text")
    return six(out, "similarity", "shift").withColumn("confidence", F.round("confidence", 4))


@query("""
SELECT user_id, ts::DATE AS day, round(max(abs(value / 2 - 25)), 6) AS most_yaw, count(*) FILTER (abs(value / 2 - 25) >= 25) AS turned,
  round(CASE WHEN count(*) FILTER (abs(value / 2 - 25) >= 25) >= 2 THEN 0.3 + 0.4 * least((max(abs(value / 2 - 25)) - 25) / 25, 1) ELSE 0 END, 6) AS confidence FROM events GROUP BY ALL
""")
def coached_turns(t):
    """a user's day is a turn of frames."""
    rows = t.events.withColumn("day", F.col("ts").cast("date"))
    return six(D.coaching(rows, ["user_id", "day"], F.col("value") / 2 - 25), "most_yaw", "confidence")


_UNITS = "list_transform(range(15), lambda i: CASE user_id % 5 WHEN 0 THEN 0.3 WHEN 1 THEN least(value / 100, 1) * ((i + event_id) % 5) / 4 WHEN 2 THEN CASE WHEN i = 7 THEN least(value / 100, 1) ELSE 0.1 END WHEN 3 THEN CASE WHEN i = 2 THEN least(value / 60, 1) ELSE 0.1 END ELSE CASE WHEN i IN (4, 9) THEN least(value / 150, 1) ELSE 0.2 END END::DOUBLE)"


@query(f"""
WITH f AS (SELECT user_id, {_UNITS} AS u, lag({_UNITS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), l AS (SELECT user_id, i, u[i + 1] AS u, abs(u[i + 1] - p[i + 1]) * 30 AS v FROM f, range(15) r(i)),
a AS (SELECT user_id, i, count(*) AS frames, var_pop(u) AS x, avg(v) AS m, max(v) AS k FROM l GROUP BY ALL),
s AS (SELECT user_id, any_value(frames) AS frames, avg(m) AS speed, avg(x) AS variance, max(k) AS peak, max(x) FILTER (i = 2) AS b, max(x) FILTER (i = 7) AS p, max(x) FILTER (i = 10) AS t FROM a GROUP BY user_id),
c AS (SELECT *, CASE WHEN variance < 0.001 AND peak < 0.5 THEN 0 WHEN (b > 0.05 OR t > 0.05) AND p > 0.03 THEN 1 WHEN b > 0.05 OR t > 0.05 THEN 2 WHEN p > 0.04 AND b < 0.01 THEN 3 WHEN speed > 2 THEN 4 ELSE 5 END AS k FROM s)
SELECT user_id, frames, CASE WHEN frames < 2 THEN 0 ELSE round(speed, 5) END AS speed, CASE WHEN frames < 2 THEN 0 ELSE round(variance, 5) END AS variance, CASE WHEN frames < 2 THEN 0 ELSE round(peak, 5) END AS peak, CASE WHEN frames < 2 THEN 'blank' ELSE (['blank', 'confused', 'nervous', 'confident', 'engaged', 'blank'])[k + 1] END AS label,
  CASE WHEN frames < 2 THEN 0 ELSE round(CASE k WHEN 0 THEN 0.5 + 0.4 * (1 - least(variance / 0.001, 1)) WHEN 1 THEN 0.5 + 0.35 * least((b + p) / 0.12, 1) WHEN 2 THEN 0.5 + 0.35 * least((b + t) / 0.15, 1) WHEN 3 THEN 0.55 + 0.3 * least(p / 0.1, 1) WHEN 4 THEN 0.5 + 0.3 * least((speed - 2) / 8, 1) ELSE 0.4 END, 5) END AS confidence FROM c
""")
def temporal_faces(t):
    """Users of five kinds, whose frames move differently."""
    v, u, k = F.col("value"), F.col("user_id") % 5, F.col("event_id")
    unit = lambda scale: F.least(v / scale, F.lit(1.0))
    units = F.array(*[F.when(u == 0, 0.3).when(u == 1, unit(100) * ((i + k) % 5) / 4).when(u == 2, unit(100) if i == 7 else F.lit(0.1)).when(u == 3, unit(60) if i == 2 else F.lit(0.1)).otherwise(unit(150) if i in (4, 9) else F.lit(0.2)) for i in range(15)])
    out = D.faces(t.events.withColumn("units", units), ["user_id"], ["ts", "event_id"], "units")
    return out.select("user_id", "frames", "label", *[F.round(c, 5).alias(c) for c in ("speed", "variance", "peak", "confidence")])
