import random
import zlib

import numpy as np

from vivaspark.llm import langid


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], 3, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, 257, (5, 4)), np.array([0, 1, 2, 1])
    _, grad = net.gradients(x, y)
    for k, w in net.w.items():
        for _ in range(4):
            at = (int(x[rng.integers(5), rng.integers(4)]), int(rng.integers(w.shape[1]))) if k[:2] == "in" else tuple(int(rng.integers(s)) for s in w.shape)
            old, loss = w[at], []
            for e in (1e-4, -1e-4):
                w[at] = old + e
                loss.append(net.gradients(x, y)[0])
            w[at] = old
            assert abs((loss[0] - loss[1]) / 2e-4 - grad[k][at]) < 1e-6


def small():
    rng = random.Random(3)
    make = lambda parts: "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(200))
    one, two = ["the", "and", "ing", "wh"], ["ñado", "que", "ción", "el"]
    return [make(one) for _ in range(30)] + [make(two) for _ in range(30)], ["x"] * 30 + ["y"] * 30


def test_learns_and_pools_every_byte():
    texts, langs = small()
    drawn = [(piece, lang) for k, (t, lang) in enumerate(zip(texts, langs)) for piece in langid.draw(t, 5, k)]
    net = langid.fit([p for p, _ in drawn], [lang for _, lang in drawn], epochs=6)
    p = net.pooled([t.encode() for t in texts])
    assert [net.langs[k] for k in p.argmax(1)] == langs and np.allclose(p.sum(1), 1, atol=1e-4)
    long = (texts[0] * 40).encode()[: langid.SEGMENT * 3 + 5]
    x = np.full((langid.SEGMENT, 4), langid.PAD)
    for k in range(4):
        piece = np.frombuffer(long[k * langid.SEGMENT : (k + 1) * langid.SEGMENT], np.uint8)
        x[: len(piece), k] = piece
    every = net.probabilities(x)
    want = (every.sum((0, 1)) - every[5:, 3].sum(0)) / len(long)
    assert np.allclose(net.pooled([long])[0], want, atol=1e-5)


def plain(net, data):
    """One byte after the other, in doubles, by the usual equations of a gated recurrent unit."""
    n, w = net.w["rec_f"].shape[0], {k: v.astype(float) for k, v in net.w.items()}
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    total = np.zeros(len(net.langs))
    for at in range(0, len(data), langid.SEGMENT):
        symbols = list(data[at : at + langid.SEGMENT])
        padded = symbols + [langid.PAD] * (langid.SEGMENT - len(symbols))
        states = {}
        for way, order in (("f", range(langid.SEGMENT)), ("b", reversed(range(langid.SEGMENT)))):
            h = np.zeros(n)
            for t in order:
                # Weights hold half of what goes into a sigmoid, and half of the candidate's recurrent part.
                a, g = w["in_" + way][padded[t]], h @ w["rec_" + way]
                reset, update = sigmoid(2 * (a[:n] + g[:n])), sigmoid(2 * (a[n : 2 * n] + g[n : 2 * n]))
                cand = np.tanh(a[2 * n :] + reset * g[2 * n :])
                h = update * h + (1 - update) * cand
                states[way, t] = h
        for t in range(len(symbols)):
            z = np.concatenate([states["f", t], states["b", t]]) @ w["out"] + w["bias"]
            e = np.exp(z - z.max())
            total += e / e.sum()
    return total / len(data)


def test_pooling_equals_a_plain_loop():
    net = langid.Network.fresh(["a", "b", "c"], 4, np.random.default_rng(2))
    texts = [b"one", bytes(range(256)), "Größe und Länge".encode() * 9]
    got = net.pooled(texts)
    for t, p in zip(texts, got):
        assert np.abs(plain(net, t) - p).max() < 1e-4


def test_defined_cases(spark):
    texts, langs = small()
    rows = [(i, t, v, "s") for i, (t, v) in enumerate(zip(texts, langs))] + [(100, None, "x", "s"), (101, "", "x", "s"), (102, "12 !!", None, "s"), (103, texts[0] * 50, None, "s"), (103, texts[0] * 50, None, "s"), (None, texts[40], "y", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(docs, langid.train(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (100, 101, 102)] == ["und"] * 3 and by[103] == "x" and by[None] == "y"
    none = langid.train(docs.filter("lang is null"))
    assert none is None and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in langid.op7_language(spark, sf).collect()]
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.96


def test_rare_and_long_languages_are_learned_from(spark):
    """5 documents among 20,000, and a language of long texts only; each gives what it has, up to per_lang."""
    common = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'a', 'b') AS lang")
    rare = [(30_000 + i, f"rare {i}", "c") for i in range(5)] + [(40_000 + i, f"long {i} " * 30_000 + "tail", "d") for i in range(3)]
    rare += [(50_000, "", "f"), (50_001, None, "f"), (30_000, "a second text of one id", "c")]
    docs = common.union(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    got = langid.segments(docs, fold=None, per_lang=6, per_fit=60).collect()
    by, ids = {}, {}
    for r in got:
        by.setdefault(r.lang, []).append(bytes(r.piece))
        ids.setdefault(r.lang, set()).add(r.doc_id)
    assert {k: len(v) for k, v in ids.items()} == {"a": 6, "b": 6, "c": 5, "d": 3}
    assert {k: len(v) for k, v in by.items()} == {"a": 60, "b": 60, "c": 60, "d": 60}
    assert max(len(p) for v in by.values() for p in v) == langid.SEGMENT
    long = " ".join(map(str, range(100_000)))
    at = [long.encode().find(p) for p in langid.draw(long, 60, 1)]
    assert min(at) >= 0 and max(at) > 0.9 * len(long) and sum(a > len(long) / 2 for a in at) > 15
