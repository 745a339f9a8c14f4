import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.oracle import same
from vivaspark.llm import collocations as C


def plain(rows, least=30, most=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, g in f.items():
        found = []
        for p, a in g.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and n >= least and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in g.items() if n >= least)
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:most]):
            out.add((lang, i + 1, p.decode(), -a, l, r, total[lang], -s))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_intervals_are_counts(longest):
    rng = np.random.default_rng(longest)
    for size in (0, 1, 5, 4000):
        ids = rng.integers(-1, 6, size).astype(np.int32)
        for length, at, n in C.intervals(ids, longest):
            want = Counter(tuple(w) for i in range(size - length + 1) if (w := ids[i : i + length]).min() >= 0)
            assert {tuple(ids[a : a + length]): int(k) for a, k in zip(at, n)} == want and len(at) == len(want)


def test_query_equals_sql(spark):
    assert same(C.op11_collocations(spark, "/root/testdata/sf0.01"), C.ORACLE_SQL, "/root/testdata/sf0.01") > 100


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, shard):
    """Overlaps, pieces, ties, repeated rows, clashing columns; shards of a text each and one shard."""
    monkeypatch.setattr(C.shards, "__defaults__", (shard,))
    monkeypatch.setattr(C.slices, "__defaults__", (shard,))
    rng = random.Random(7)
    rows = []
    for i in range(300):
        w = rng.choices(["A", "b", "c", "É", "d\x1c", "of", "the", " "], [9, 5, 3, 2, 1, 4, 6, 1], k=rng.randint(0, 40))
        rows.append((rng.choice(["en", None, "und", "de"]), "".join(x + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for x in w)))
    rows += [("en", "ha " * 500), (None, None), ("en", ""), ("fr", "only a few"), *rows[:20]]
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, phrase string, words int")
    assert got(C.collocations(df)) == plain(rows)
    assert got(C.collocations(df, least=5, most=9)) == plain(rows, 5, 9)
    assert C.collocations(df.limit(0)).count() == 0


def test_a_saturated_filter_loses_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choices([f"w{i}" for i in range(40)], [40 // (i + 1) + 1 for i in range(40)], k=60))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = got(C.collocations(df, least=3))
    assert want == plain(rows, 3)
    monkeypatch.setattr(C, "frequent_filter", lambda docs, least: np.full(1 << C.FILTER - 6, 2**64 - 1, np.uint64))
    assert got(C.collocations(df, least=3)) == want


def test_exact_above_64_bits(spark):
    big = 9_000_000_000_000_000_001
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 2), ("en", "a b", 2, big - 7), ("en", "", 0, big), ("en", "a b b", 3, big - 9), ("en", "b b", 2, big - 8)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    score = {r.phrase: r.score for r in C.scored(counts).collect()}
    assert score == {"a b": 2_000_000 * (big - 7) // (2 * big - 2), "b b": 2_000_000 * (big - 8) // (2 * big - 4), "a b b": min(2_000_000 * (big - 9) // (2 * big - 8), 2_000_000 * (big - 9) // (2 * big - 9))}
    assert {r.phrase for r in C.swallowed(counts).collect()} == {"a b", "b b"}


def test_long_text(spark):
    text = " ".join(f"w{i % 7919} of the w{i % 31}" for i in range(400_000))
    rows = [("en", text), ("de", "kurz")]
    df = spark.createDataFrame(rows, "lang string, text string")
    f = Counter(zip(*(text.split()[i:] for i in range(2))))
    have = {r.phrase: r.n for r in C.phrase_counts(df, 30).filter("words = 2").collect()}
    assert have == {" ".join(p): n for p, n in f.items() if n >= 30}
