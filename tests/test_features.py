"""Feature plans against a plain version that follows their description row by row."""

import math
import re

import pytest
from pyspark.sql import functions as F

from vivaspark.operators import features as N
from vivaspark.plans import features as P
from vivaspark.plans import registry


def number(x):
    if x is None or isinstance(x, str) or not math.isfinite(x):
        return None
    return float(x)


def scale(name, x):
    x = number(x)
    if x is None:
        return None
    up = max(x, 0.0)
    if re.search("_prob$|confidence|_score$|activation", name):
        return min(up, 1.0)
    for pattern, s in [("_ms$|latency|duration", 5000), ("word_count", 100), ("pause_count|disfluency_count", 10), ("blink_rate", 60), ("pitch_mean", 300), ("pitch_variance|pitch_range", 150), ("speech_rate", 8), ("energy_mean|jitter|shimmer", 1), ("speech_to_silence_ratio", 10)]:
        if re.search(pattern, name):
            return up / (up + s)
    for pattern, s in [("deviation", 2), ("gaze_yaw|gaze_pitch|head_roll|head_pitch|head_yaw", 45), ("^mfcc_", 50)]:
        if re.search(pattern, name):
            return math.tanh(x / s)
    return x


@pytest.mark.parametrize("name, first", [("blink_rate_deviation", 4), ("pause_total_duration_ms", 1), ("pause_count", 3), ("au_AU1_deviation", 11), ("au_AU1_activation", 0), ("semantic_similarity", 15), ("mfcc_1", 14), ("x_mfcc_1", 15), ("probability", 15), ("scores", 15), ("pitch_deviation", 11), ("stt_response_latency_ms", 1), ("competency_mid_prob", 0), ("head_pitch", 13), ("Jitter", 9)])
def test_rule_order(name, first):
    assert N.rule_of(name) == first


def test_every_rule_has_a_name_and_its_constant(spark):
    assert {N.rule_of(n) for n in P.NAMES} == set(range(16)) and len(P.NAMES) == 72
    values = [None, float("nan"), float("inf"), -3.0, 0.0, 0.4, 2.5, 700.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    raw = rows.select("i", N.raw_vector(tuple(P.NAMES), {n: F.col("v") for n in P.NAMES}).alias("r"))
    got = raw.select("i", N.scaled_vector(tuple(P.NAMES), F.col("r")).alias("x")).collect()
    for r in got:
        for n, x in zip(P.NAMES, r.x):
            want = scale(n, values[r.i])
            assert (x is None) == (want is None) and (x is None or abs(x - want) < 1e-12), n


def shares(weights, label, confidence, labels):
    if weights:
        low = {k.lower().strip(): v for k, v in weights.items()}
        cut = [min(max(number(low.get(x)) or 0.0, 0.0), 1.0) for x in labels]
        if sum(cut) > 1e-8:
            return [c / sum(cut) for c in cut]
    label = label.lower().strip() if label else None
    if label not in labels:
        return [None] * len(labels)
    c = number(confidence)
    c = 0.7 if c is None else min(max(c, 0.0), 1.0)
    return [c if x == label else (1 - c) / (len(labels) - 1) for x in labels]


def raw_turn(r):
    """Raw values, presence, confidence of each modality of a turn of P.turns()."""
    d = r.asDict(recursive=True)
    s, m, v, p = (d[k] or {} for k in ("stt", "semantic", "vision", "prosody"))
    words = s.get("word_timestamps")
    text = {"stt_confidence": s.get("confidence"), "stt_response_latency_ms": s.get("response_latency_ms"), "transcript_word_count": len(re.findall(r"\b\w+\b", s.get("transcript") or "")), "transcript_duration_ms": max(words[-1]["end"] - words[0]["start"], 0) * 1000 if words else None, "semantic_confidence": m.get("confidence")}
    text |= {k: m.get(k) for k in ("semantic_similarity", "question_relevance", "answer_completeness")}
    text |= {f"competency_{k}_prob": x for k, x in zip(N.COMPETENCIES, shares(m.get("competency_distribution"), m.get("predicted_competency"), m.get("confidence"), N.COMPETENCIES))}
    vision = {"vision_confidence": v.get("emotion_confidence"), "emotion_confidence": v.get("emotion_confidence"), "eye_contact_score": v.get("eye_contact_ratio"), "blink_rate": v.get("blink_rate"), "blink_rate_deviation": v.get("blink_rate_deviation")}
    vision |= {f"gaze_{k}": (v.get("gaze_vector") or {}).get(k) for k in ("yaw", "pitch")} | {f"head_{k}": (v.get("head_pose") or {}).get(k) for k in ("roll", "pitch", "yaw")}
    vision |= {f"au_{a}_{k}": (v.get(f"au_{k}s") or {}).get(a) for a in N.ACTION_UNITS for k in ("activation", "deviation")}
    vision |= {f"vision_emotion_{k}_prob": x for k, x in zip(N.EMOTIONS, shares(v.get("emotion_distribution"), v.get("emotion_label"), v.get("emotion_confidence"), N.EMOTIONS))}
    prosody = {n: p.get(n) for n in N.PROSODY} | {"prosody_response_latency_ms": p.get("response_latency_ms")}
    prosody |= {f"mfcc_{i + 1}": x for i, x in enumerate(p.get("mfcc_vector") or [])}
    seen = sum(number(p.get(k)) is not None for k in ("pitch_mean", "speech_rate", "energy_mean", "jitter", "shimmer", "speech_to_silence_ratio")) / 6
    return {"text": (text, bool(s.get("transcript")) or bool(m), m.get("confidence")), "vision": (vision, bool(v), v.get("emotion_confidence")), "prosody": (prosody, bool(p), seen)}


def plain(rows):
    """Turns in order of one candidate -> vector, imputed names, masks and confidences."""
    past = {m: [] for m in N.MODALITIES}
    for r in rows:
        vector, gaps, marks = [], [], []
        for m, (raw, there, sure) in raw_turn(r).items():
            names, own = N.MODALITIES[m], past[m][-5:]
            x = [scale(n, raw.get(n)) if there else None for n in names]
            full = [(sum(h[i] for h in own) / len(own) if own else 0.0) if y is None else y for i, y in enumerate(x)]
            gaps += [n for n, y in zip(names, x) if y is None]
            c = number(sure)
            marks += [float(there), 0.0 if not there else sum(y is not None for y in x) / len(names) if c is None else min(max(c, 0.0), 1.0)]
            vector += full
            if there:
                past[m].append(full)
        yield r.event_id, vector, gaps, marks


def check(got, turns):
    got = {r.event_id: r for r in got}
    users = {}
    for r in turns:
        users.setdefault(r.user_id, []).append(r)
    for own in users.values():
        for event, vector, gaps, marks in plain(sorted(own, key=lambda r: (r.ts, r.event_id))):
            r = got.pop(event)
            assert r.imputed == gaps
            assert max(abs(a - b) for a, b in zip(r.vector, vector)) < 2e-6 and len(r.vector) == 72
            have = [r.text_mask, r.text_confidence, r.vision_mask, r.vision_confidence, r.prosody_mask, r.prosody_confidence]
            assert max(abs(a - b) for a, b in zip(have, marks)) < 2e-6
    assert not got


def test_fused_turns_equal_the_plain_version(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    check(registry.QUERIES["fused_turns"](spark, sf).collect(), P.turns(events).collect())


def test_missing_types_keys_and_tables(spark):
    bare = spark.createDataFrame([(1, 1, {"transcript": "a b"}), (1, 2, None), (None, 1, None)], "k long, t int, stt struct<transcript string>").withColumn("_key", F.lit("x")).withColumn("values", F.lit(1))
    rows = N.filled(N.turn_features(bare, ["k", "t", "_key", "values"]), "k", ["t"]).collect()
    got = {(r.k, r.t): r for r in rows}
    assert len(rows) == 3 and rows[0]._key == "x" and rows[0]["values"] == 1
    assert got[1, 1].vector[2] == 2 / 102 and got[1, 2].vector[2] == 2 / 102 and set(got[None, 1].vector) == {0.0}
    assert "transcript_word_count" not in got[1, 1].imputed and len(got[1, 2].imputed) == 72
    assert N.filled(N.turn_features(bare.limit(0), ["k", "t"]), "k", ["t"]).count() == 0


def test_shares_are_made_once_and_of_keys_that_agree_the_last_counts(spark):
    """each share stood a hundred times in the plan of a turn, a millisecond's work."""
    rows = spark.createDataFrame([(1, {"Mid": 0.9, " mid ": 0.2, "expert": 0.6}), (2, {"mid": float("nan"), "expert": None}), (3, {}), (4, None), (5, {"beginner": 7.0, "x": 3.0})], "i int, m map<string,double>")
    got = {r.i: r.x for r in rows.select("i", N.distribution(F.col("m"), N.COMPETENCIES).alias("x")).collect()}
    assert [round(x, 9) for x in got[1]] == [0.0, 0.25, 0.75] and got[5] == [1.0, 0.0, 0.0] and got[2] is got[3] is got[4] is None
    turns = rows.select("i", F.struct(F.col("m").alias("competency_distribution")).alias("semantic"))
    plan = N.turn_features(turns, ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("map_keys(") + plan.count("map_entries(") <= 2


def test_histories_pass_from_batch_to_batch(spark):
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(40).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") % 4 == 0, "click").otherwise("view").alias("event_type"), (F.col("id") * 1.5).alias("value"))
    masks = [F.col(f"{m}.{x}").alias(f"{m}_{x}") for m in N.MODALITIES for x in ("mask", "confidence")]
    turns = N.turn_features(P.turns(rows), ["user_id", "ts", "event_id"]).select("user_id", "ts", "event_id", *masks, *N.MODALITIES)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        check(N.filled(turns, "user_id", ["ts", "event_id"]).collect(), P.turns(rows).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
