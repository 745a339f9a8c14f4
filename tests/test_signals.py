import hashlib
import json
import math

from pyspark.sql import functions as F

from vivaspark.functions import signals as Y


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {v}" for k, v in kinds(values).items()) or "x int")
    return row.select(column.alias("r")).first().r


def kinds(values):
    def kind(v):
        if isinstance(v, list):
            return f"array<{kind(v[0]) if v else 'double'}>"
        if isinstance(v, dict):
            return "map<string, double>"
        return {str: "string", int: "int", float: "double", type(None): "string"}[type(v)]

    return {k: kind(v) for k, v in values.items()}


def test_labels_and_scores(spark):
    got = [one(spark, Y.emotion(F.col("a")), a=x) for x in (" Happy", "FEAR", "calm", "who", None, "confident")]
    assert got == ["engaged", "nervous", "blank", "blank", "blank", "confident"]
    assert [one(spark, Y.score_class(F.col("a")), a=x) for x in (4.0, 3.99, 2.5, 2.49)] == ["high", "medium", "medium", "low"]


def test_shared_emotions(spark):
    assert all(abs(sum(w) - 1) < 1e-9 for w in Y.SHARES.values())
    r = one(spark, Y.shared_emotions(F.col("m")), m={"Happy": 60.0, "neutral": 20.0, "odd": 20.0})
    assert r.label == "engaged" and r.distribution == [0.52, 0.0, 0.01, 0.12, 0.35] and abs(r.confidence - 0.52) < 1e-12
    assert one(spark, Y.shared_emotions(F.col("m")), m={"happy": 0.0}) is None


def test_eye_contact_and_levels(spark):
    assert [round(one(spark, Y.eye_contact(F.col("a"), F.col("b")), a=a, b=b), 9) for a, b in ((0.0, 0.0), (-15.0, 0.0), (90.0, 90.0), (30.0, -12.5))] == [1.0, 0.7, 0.0, 0.2]
    assert one(spark, Y.levelled(F.col("a")), a=[0.5, math.nan, -2.0]) == [0.25, 0.0, -1.0]
    assert one(spark, Y.levelled(F.col("a")), a=[0.5, -1.0]) == [0.5, -1.0] and one(spark, Y.levelled(F.col("a")), a=[]) is None
    assert one(spark, Y.levelled(F.col("a")), a=[math.inf, 0.0]) == [1.0, 0.0]
    assert [one(spark, Y.latency(F.col("a")), a=x) for x in ("12.5", "-1", "soon", None)] == [12.5, 0.0, 0.0, 0.0]


def test_texts(spark):
    assert one(spark, Y.request_fingerprint(F.col("a"), F.lit("text"), F.col("b")), a="q", b="é") == hashlib.sha256("q\x1ftext\x1fé".encode()).hexdigest()
    rejected = 'Say "why"\n\\ é'
    told = one(spark, Y.retry_text(F.array(F.lit("a"), F.lit("b")), F.col("t"), F.col("n")), t=rejected, n=3)
    assert told == f"Previous rejection: a; b. Rejected output: {json.dumps(rejected, ensure_ascii=False)}. Do not repeat or lightly rephrase that output. Retry 3 of 3. {Y.ANGLES[1]}"
    assert one(spark, Y.retry_text(F.array(F.lit("a")), F.col("t"), F.col("n")), t="x", n=1) is None
    assert [one(spark, Y.duration(F.col("s")), s=s) for s in (-3.0, 59.4, 59.6, 60.5, 3599.0, 3661.0, 90000.0)] == ["0s", "59s", "1m 00s", "1m 00s", "59m 59s", "1h 01m", "25h 00m"]
