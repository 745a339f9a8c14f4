import re

from vivaspark.llm import mixing


def test_targets_cap_and_share_on():
    t = mixing.targets({"a": 10, "b": 100, "c": 100, None: 5})
    assert t["a"] == 30 and t[None] == 15
    assert abs(sum(t.values()) - 215) < 1e-9 and abs(t["b"] / t["c"] - 2) < 1e-9
    assert mixing.targets({}) == {}


def check(rows, sizes, near):
    """sizes: doc rows as (doc_id, source, size)."""
    by = {}
    for d, s, n in sizes:
        by[s] = by.get(s, 0) + n
    want = mixing.targets(by)
    got = {}
    source = {}
    for d, s, n in sizes:
        source[d] = s
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == by[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        got[s] = got.get(s, 0) + r.taken
    for s in by:
        assert abs(got[s] - want[s]) <= near, (s, got[s], want[s])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs]
    first = mixing.op5_mixing(spark, sf).collect()
    assert len(first) == len(docs) and {r.doc_id: r.size for r in first} == {d: n for d, _, n in sizes}
    check(first, sizes, 1)
    assert sorted(first) == sorted(mixing.op5_mixing(spark, sf).collect())


def test_rates_tilt_with_size(spark):
    """Within a source that gives words up, a longer document is taken at a lower rate."""
    rows = [(i, "w " * (10 if i % 2 else 200), "a") for i in range(400)] + [(1000 + i, "w " * 150, "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix(docs, weights=(1, 3)).collect() if r.source == "a"]
    rate = {n: sum(r.taken for r in got if r.size == n) / sum(r.size for r in got if r.size == n) for n in (10, 200)}
    assert rate[200] < rate[10] < 1.0


def test_defined_cases(spark, monkeypatch):
    rows = [(1, None, "a"), (2, "", None), (3, "one two three", None), (3, "one two three", None), (None, "x y", "b"), (4, "z " * 500, "b"), (5, " ", "empty")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, s string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check([r for r in got], [(d, s, len((t or "").split())) for d, t, s in rows], 2)
    assert mixing.mix(docs.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "MANY", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.take_copies(docs).columns == docs.columns
