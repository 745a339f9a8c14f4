"""Audio headers, the feature cache and allocation against plain versions."""

import base64
import io
import random
import struct
import wave

from pyspark.sql import functions as F

from vivaspark.functions import audio as A
from vivaspark.operators import graph as G
from vivaspark.sources.cache import FeatureCache


def wav(rate, channels, frames, extra=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0" * (2 * channels * frames))
    data = out.getvalue()
    return data[:36] + extra + data[36:]


def webm(rate, ticks, scale=None, wide=True):
    element = lambda i, body: bytes.fromhex(i) + bytes([0x80 | len(body)]) + body
    info = (element("2AD7B1", scale.to_bytes(3, "big")) if scale else b"") + (element("4489", struct.pack(">d" if wide else ">f", ticks)) if ticks else b"")
    audio = element("E1", element("9F", b"\1") + element("B5", struct.pack(">d" if wide else ">f", rate)))
    return element("1A45DFA3", element("4282", b"webm")) + element("1549A966", info) + element("AE", audio)


def test_recordings(spark):
    enc = lambda b: base64.b64encode(b).decode()
    junk = b"LIST" + (3).to_bytes(4, "little") + b"abc\0"
    short = wav(8000, 1, 8000)
    rows = {
        "plain": (enc(wav(16000, 2, 4000)), ("accepted", 16044, "wav", 16000, 0.25)),
        "url": ("data:audio/wav;base64," + enc(short), ("accepted", 16044, "wav", 8000, 1.0)),
        "chunks": (enc(wav(44100, 1, 44100, junk * 3)), ("accepted", 88280, "wav", 44100, 1.0)),
        "cut": (enc(short[:4044]), ("accepted", 4044, "wav", 8000, 0.25)),
        "no data": (enc(short[:36]), ("accepted", 36, "wav", 8000, None)),
        "long": (enc(wav(1, 1, 301)), ("too_long", 646, "wav", 1, 301.0)),
        "edge": (enc(wav(1, 1, 300)), ("accepted", 644, "wav", 1, 300.0)),
        "webm": (enc(webm(48000.0, 2500.5)), ("accepted", len(webm(48000.0, 2500.5)), "webm", 48000, 2.5005)),
        "webm32": (enc(webm(16000.0, 400.0, 2_000_000, False)), ("accepted", len(webm(16000.0, 400.0, 2_000_000, False)), "webm", 16000, 0.8)),
        "live": (enc(webm(48000.0, None)), ("accepted", len(webm(48000.0, None)), "webm", 48000, None)),
        "webm long": (enc(webm(48000.0, 300_001.0)), ("too_long", len(webm(48000.0, 300_001.0)), "webm", 48000, 300.001)),
        "other": (enc(b"hello"), ("accepted", 5, None, None, None)),
        "null": (None, ("missing", None, None, None, None)),
        "none": ("", ("empty", 0, None, None, None)),
        "bad": ("abc", ("undecodable", None, None, None, None)),
        "bad2": ("ab=d", ("undecodable", None, None, None, None)),
        "huge": ("A" * (A.MOST_ENCODED + 4), ("too_large", None, None, None, None)),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "k string, t string")
    got = A.recordings(df, "t", ["k"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.outcome, r.bytes, r.kind, r.rate, r.seconds) == rows[r.k][1], r.k


def test_cache_computes_what_is_missing(spark, tmp_path):
    seen = []
    texts = lambda *x: spark.createDataFrame([(i, t) for i, t in enumerate(x)], "i int, t string")

    def compute(df):
        seen.append(sorted(r.content for r in df.collect()))
        return df.select("digest", F.length("content").alias("n"))

    cache = FeatureCache(spark, str(tmp_path), "1", {"n": "long"})
    got = cache.of(texts("a", "bb", "a", None, ""), F.col("t"), compute)
    assert sorted((r.i, r.n) for r in got.collect() if r.n is not None) == [(0, 1), (1, 2), (2, 1), (4, 0)] and got.count() == 5
    assert cache.fill(texts("a", "bb"), F.col("t"), compute) == 0
    assert cache.fill(texts("a", "changed"), F.col("t"), compute) == 1
    assert seen == [["", "a", "bb"], [], ["changed"]]
    # Another version starts anew; a digest that two writers added is one row.
    assert FeatureCache(spark, str(tmp_path), "2", {"n": "long"}).fill(texts("a"), F.col("t"), compute) == 1
    cache.rows().limit(1).write.parquet(f"{cache.path}/batch-other")
    assert cache.rows().count() == 4


def plain_shares(total, capacities):
    whole = [total * c // sum(capacities) if sum(capacities) else 0 for c in capacities]
    rest = [total * c % sum(capacities) if sum(capacities) else 0 for c in capacities]
    for i in sorted((i for i, c in enumerate(capacities) if whole[i] < c), key=lambda i: (-rest[i], i))[: total - sum(whole)]:
        whole[i] += 1
    return whole


def test_capacity_shares(spark):
    rng = random.Random(4)
    groups = [[rng.randint(0, 9) for _ in range(rng.randint(1, 7))] for _ in range(60)] + [[3_000_000_000, 2_999_999_999, 1]]
    totals = [rng.randint(0, sum(g)) for g in groups]
    rows = [(g, i, c, totals[g]) for g, own in enumerate(groups) for i, c in enumerate(own)] + [(900, 0, 5, 6), (901, 0, 5, -1)]
    out = G.capacity_shares(spark.createDataFrame(rows, "g int, i int, c long, t long"), ["g"], "c", "t", "i").collect()
    for g, own in enumerate(groups):
        got = [r.allocated for r in sorted(out, key=lambda r: r.i) if r.g == g]
        assert got == plain_shares(totals[g], own) and sum(got) == totals[g] and all(a <= c for a, c in zip(got, own))
    assert [(r.fits, r.allocated) for r in out if r.g >= 900] == [(False, 0)] * 2
