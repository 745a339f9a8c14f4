import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vivaspark.llm import simhash
from vivaspark.llm.bktree import Forest, roots
from vivaspark.llm.components import components


def slow_print(text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(items):
    """{doc: component} by all pairs of fingerprints."""
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in items:
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in items}


def test_forest_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    value = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(6))]))
    shard = rng.integers(0, 4, len(value))
    got = {(int(a), int(b)) for i, j in Forest(shard, value).links(2, rows=50) for a, b in zip(i, j)}
    want = {(i, j) for i in range(len(value)) for j in range(i) if shard[i] == shard[j] and int(value[i] ^ value[j]).bit_count() <= 2}
    assert got == want and want
    r = roots(len(value), iter([(np.array([a for a, _ in want]), np.array([b for _, b in want]))]))
    assert all(r[a] == r[b] for a, b in want)


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(d, slow_print(t)) for d, t in docs.items()]
    want = brute(items)
    got = simhash.op1_simhash(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{dict(items)[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_links_of_random_near_prints_and_hot_shards(spark, monkeypatch):
    rng = random.Random(1)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        values |= {x} | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8)}
    low = rng.getrandbits(32)
    values |= {low | rng.getrandbits(8) << 40 | rng.getrandbits(6) << 52 for _ in range(150)}
    want = brute([(v, v) for v in values])
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for most in (65_536, 20):
        monkeypatch.setattr(simhash, "SHARD", most)
        monkeypatch.setattr(simhash, "CHUNK", 64)
        root = {r.a % (1 << 64): r.b % (1 << 64) for r in components(simhash.links(df)).collect()}
        groups = {}
        for v in values:
            groups.setdefault(want[v], set()).add(root.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two three four"), (4, "One two three four"), (9, "one TWO three four"), (None, "one two three four"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = [(r.doc_id, r.component_id, r.fp) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    assert all(c == 1 and f == 0 for d, c, f in got if d in (1, 2, 3))
    assert all(c == 4 for d, c, f in got if d in (4, 9))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
    # An id that two texts share keeps both; the smaller hash of a text decides between near copies of one id.
    both = spark.createDataFrame([(5, "a b c d e f"), (5, "quite other words in this one"), (5, "a b c d e f"), (6, "a b c d e f"), (None, "p q r s t"), (None, "p q r s t")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(both).collect()) == [(0, "p q r s t"), (5, "a b c d e f"), (5, "quite other words in this one")]


def test_parts_of_a_crowd_share_48_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 30)
    rng = random.Random(9)
    values = {rng.getrandbits(32) << 32 | 7 for _ in range(400)}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for r in simhash.shards(df).groupBy("k", "bits").agg(F.count("*").alias("n"), F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).collect():
        assert r.n <= 30 or r.k >= 36
        if r.k >= 36:
            assert ((r["all"] ^ r["any"]) % (1 << 64)).bit_count() <= 16


def test_blocks_of_a_long_text():
    rng = random.Random(5)
    text = "".join(rng.choice(["wort ", "a\n", "zwei\t", "Überall ", "x\u00a0y "]) for _ in range(4000)) + "z" * 3000
    for cut_to in (text, text[:7], "one", "one two", "one two three", "one two three four", " "):
        for block in (1, 40, 1 << 18):
            assert simhash.fingerprint(cut_to, block=block) == slow_print(cut_to)


def test_keep_one_leaves_columns_of_any_name(spark):
    rows = [(2, "a b c d e f", 7, 8, 9), (1, "a b c d e f", 4, 5, 6), (3, "something else here now", 1, 2, 3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "_id", "_key", "_c0"])
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [rows[1], rows[2]]


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def near_copies(rng):
    """Texts of 90 to 110 words, each with copies at 0.75 to 0.95, chains of such, and exact copies."""
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for _ in range(12):
        text = [word() for _ in range(rng.randrange(90, 110))]
        texts.append(text)
        for _ in range(5):
            text = list(rng.choice(texts[-3:]))
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
            texts.append(text)
    return [" ".join(t) for t in texts] + [" ".join(t) for t in texts[::7]] + ["", None, "short text", "Short text", "a short text"]


def test_similar_texts_far_beyond_the_radius_are_linked(spark, monkeypatch):
    texts = near_copies(random.Random(2))
    sets = [five(t) for t in texts]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    root, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            bits = (prints[i] ^ prints[j]).bit_count()
            far += alike and bits > 2
            if alike or bits <= 2:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert far > 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for part in (4096, 9):  # a crowd in one piece, and in pairs of parts
        monkeypatch.setattr(simhash, "PART", part)
        kept = simhash.keep_one(docs, words_each=5, similarity=0.8)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert simhash.keep_one(docs.limit(0), words_each=5, similarity=0.8).count() == 0


def test_few_edges_take_few_partitions(spark):
    """Every task of a round leaves files, so their number must follow the edges, not the session's setting."""
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 100 != 99], "a long, b long")
        got = components(edges)
        assert got.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, got.collect())) == [(i, i - i % 100) for i in range(301) if i % 100]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_texts_outside_crowds_stay_out_of_the_shuffle(spark, monkeypatch):
    """Of many different texts two are near copies; the filter loses no wanted row, though null ids and full bits."""
    rows = spark.range(3000).select(F.expr("nullif(id, 7)").alias("_id"), F.xxhash64("id").alias("key"))
    wanted = rows.filter("coalesce(_id, 7) % 300 = 7").withColumnRenamed("_id", "_first")
    keys = {r.key for r in wanted.collect()}
    for bits, most in ((23, 20), (7, 3000)):
        monkeypatch.setattr(simhash, "SIEVE", bits)
        got = [r.key for r in simhash.sieve(rows, ["key", "_id"], wanted, ["key", "_first"]).collect()]
        assert keys <= set(got) and len(keys) == 10 and len(got) <= most
    assert simhash.sieve(rows, ["key", "_id"], wanted.limit(0), ["key", "_first"]).count() == 0
    # The whole stage passes its texts through it.
    seen, sieve = [], simhash.sieve
    monkeypatch.setattr(simhash, "SIEVE", 23)
    monkeypatch.setattr(simhash, "sieve", lambda *a: seen.append(sieve(*a)) or seen[-1])
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(200)]
    texts.append(texts[5].replace("w5x30 ", ""))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, words_each=5, similarity=0.8).collect()) == list(range(200))
    assert sorted(r._id for r in seen[0].collect()) == [5, 200]
