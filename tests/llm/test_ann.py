import numpy as np

from vivaspark.llm import ann


def exact(rows, k=5):
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] ** 2).sum()))
        s[ids == ids[i]] = -np.inf
        out[ids[i]] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k]]
    return out


def test_beam_is_no_worse_than_greedy():
    x = np.random.default_rng(2).normal(size=(2000, 16))
    aq = ann.AdditiveQuantiser.fit(x, books=4, words=16)

    def error(beam):
        codes, norm = aq.encode(x, beam)
        total = sum(aq.books[b][codes[:, b]] for b in range(4))
        assert np.allclose((total**2).sum(1), norm, atol=1e-3)
        return ((x - total) ** 2).sum()

    assert error(8) < error(1)


def test_recall_of_a_full_block_of_noise():
    """Vectors without any structure are the hardest; the shortlist of a block must hold their neighbours."""
    x = np.random.default_rng(3).normal(size=(ann.BLOCK, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aq = ann.AdditiveQuantiser.fit(x[: ann.SAMPLE], rounds=4)
    codes, norms = (np.concatenate(c) for c in zip(*(aq.encode(x[k : k + 1024]) for k in range(0, len(x), 1024))))
    hits = 0
    for q in range(0, 100):
        approx = aq.tables(x[q : q + 1])[0][np.arange(ann.BOOKS)[None, :], codes].sum(1) / np.sqrt(norms)
        short = set(np.argpartition(-approx, ann.RERANK)[: ann.RERANK])
        exact = x @ x[q]
        exact[q] = -9
        hits += sum(k in short for k in np.argpartition(-exact, 5)[:5])
    assert hits / 500 >= 0.95


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    want = exact(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    got = {}
    for r in ann.op8_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert all(a.score >= b.score for a, b in zip(rows, rows[1:]))
        assert len({r.vec_id for r in rows}) == 5
        near = dict(want[q])
        hits += sum(r.vec_id in near for r in rows)
        assert all(abs(near[r.vec_id] - r.score) < 1e-12 for r in rows if r.vec_id in near)
    assert hits / (5 * len(want)) >= 0.98


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (100, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(v, v.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert ann.search(v.limit(0), v).count() == 0


def test_every_row_is_indexed_and_layout_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(2500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    blocks = ann.index(ann.usable(v), ann.train(ann.usable(v), 4), 4).collect()
    assert len(blocks) == 4 and sorted(i for r in blocks for i in np.frombuffer(r.ids, np.int64)) == list(range(2500))
    found = [sorted(map(tuple, ann.search(v.repartition(n), v.filter("vec_id % 50 = 0").repartition(n), rerank=60).collect())) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 50 * 5


def test_each_row_is_encoded_once(spark, monkeypatch, tmp_path):
    """Four query blocks meet four index blocks; tasks note the rows that they encode."""
    from pyspark import cloudpickle

    encode, log = ann.AdditiveQuantiser.encode, str(tmp_path / "rows")

    def noted(self, x, beam=ann.BEAM):
        with open(log, "a") as f:
            f.write(f"{len(x)}\n")
        return encode(self, x, beam)

    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 15)
    monkeypatch.setattr(ann.AdditiveQuantiser, "encode", noted)
    cloudpickle.register_pickle_by_value(ann)
    try:
        v = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(2500)], "vec_id long, embedding array<double>")
        assert ann.search(v, v.filter("vec_id % 50 = 0"), rerank=60).count() == 250
    finally:
        cloudpickle.unregister_pickle_by_value(ann)
    assert sum(map(int, open(log))) == 2500


def test_copies_of_one_block_give_the_smallest_ids(spark):
    """5,000 copies and 2,000 of twice the vector: all of cosine one, far over RERANK."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=8)
    rows = [(i, v.tolist()) for i in range(1, 5001)] + [(i, (2 * v).tolist()) for i in range(5001, 7001)] + [(i, rng.normal(size=8).tolist()) for i in range(8000, 9500)]
    rows += [(3, v.tolist())] * 9 + [(40, w) for w in rng.normal(size=(8, 8)).tolist()]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), x) for i, x in rows], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.search(df, df.filter("vec_id IN (3, 2000, 6000)").dropDuplicates(["vec_id"])).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {3: [1, 2, 4, 5, 6], 2000: [1, 2, 3, 3, 3], 6000: [1, 2, 3, 3, 3]}
