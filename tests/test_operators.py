"""Fixtures worked out by hand, and properties: row order, nulls, ties, tampering."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vivaspark.functions import rules as U
from vivaspark.functions import text as X
from vivaspark.operators import governance as G
from vivaspark.operators import contracts, graph, relational
from vivaspark.operators import metrics as M
from vivaspark.operators import sequence as S
from vivaspark.sources import readers, writers


def test_metrics_of_a_hand_worked_table(spark):
    """Ten answers: per class 2 of 3, 1 of 4 and 2 of 3 are right; two abstain."""
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (1, 2), (1, None), (2, 2), (2, 2), (2, None)]
    df = spark.createDataFrame(pairs, "y int, p int")
    m = M.classification(df, "y", "p").first()
    assert (m.n, m.classified) == (10, 8) and abs(m.max_share - 3 / 8) < 1e-12 and abs(m.accuracy - 0.5) < 1e-12
    rows = {r.y: r for r in M.confusion(df, "y", "p").collect()}
    assert [(rows[c].pred_0, rows[c].pred_1, rows[c].pred_2, rows[c].abstained) for c in range(3)] == [(2, 1, 0, 0), (1, 1, 1, 1), (0, 0, 2, 1)]
    none = M.classification(df.withColumn("p", F.lit(None).cast("int")), "y", "p").first()
    assert none.max_share == 1.0 and none.accuracy == 0 and none.ordinal_mae == 2


def sweeps_of(spark, yaw, pitch, every):
    """(start, end, direction) of the sweeps of one turn, a frame each `every` ms."""
    frames = [(k * every, float(y), float(p)) for k, (y, p) in enumerate(zip(yaw, pitch))]
    df = spark.createDataFrame([(frames,)], "frames array<struct<ms:double,yaw:double,pitch:double>>")
    found = df.select(U.sweeps(F.col("frames")).alias("s"), U.note_reading(U.sweeps(F.col("frames")), F.lit(4000.0)).alias("c")).first()
    return [(x.start_ms, x.end_ms, x.direction) for x in found.s], found.c


def test_sweeps_follow_steady_movement(spark):
    there, back = [3 * k for k in range(6)], [15 - 4 * k for k in range(1, 6)]
    level = [0] * 11
    # Two steps back of seven are over a quarter, so the way to the right ends at the frame before the second.
    found, sure = sweeps_of(spark, there + back, level, 500.0)
    assert found == [(0.0, 3000.0, "left_to_right"), (3000.0, 5000.0, "right_to_left")]
    assert abs(sure - (0.4 * 3000 / 4000 + 0.35 + 0.25 * 2 / 3)) < 1e-9
    assert sweeps_of(spark, there, [6 * (k % 2) * 2 for k in range(6)], 500.0) == ([], 0.0)  # the head nods too much
    assert sweeps_of(spark, there, level[:6], 100.0) == ([], 0.0)  # too short
    assert sweeps_of(spark, [0.1 * k for k in range(6)], level[:6], 500.0) == ([], 0.0)  # hardly any movement
    assert sweeps_of(spark, [], [], 1.0) == ([], 0.0) and sweeps_of(spark, [3], [0], 1.0) == ([], 0.0)


def test_even_delivery_has_low_variation(spark):
    words = [(1, i, 5.0 + 0.25 * i) for i in range(20)] + [(2, i, i * i * 0.13) for i in range(14)]
    df = spark.createDataFrame(words, "turn int, i int, start double")
    cv = {r.turn: r.cv for r in S.sliding_rate_cv(df, "turn", ["i"], F.col("start")).collect()}
    assert cv[1] < 1e-9 < 0.08 < cv[2]


def test_imputation_ignores_row_order_and_feeds_back(spark):
    rows = [("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0), ("a", 4, None), ("b", 1, None), ("b", 2, 3.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, i int, x double")
        got = {(r.k, r.i): r.imputed for r in S.rolling_impute(df, "k", ["i"], "x").collect()}
        assert got == {("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): 4.0, ("a", 4): 3.0, ("b", 1): 0.0, ("b", 2): 3.0}
        fold = {(r.k, r.turn): round(r.x, 9) for r in S.impute_fold(df, "k", ["i"], ["x"]).collect()}
        assert fold[("a", 4)] == round((2 + 2 + 4) / 3, 9)


def test_weighted_quantile_is_the_lower_one(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "v double, w double")
    r = S.weighted_quantiles(df, "v", "w", [0.25, 0.5, 0.51, 1.0]).first()
    assert (r.q25, r.q50, r.q51, r.q100) == (1.0, 2.0, 3.0, 3.0)


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(50, 51)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[k] for k in range(7, 30)} == {7} and got[51] == 50
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_keeps_components_and_is_deterministic():
    sizes = [(c, 1 + c % 5) for c in range(40)]
    plan = graph.largest_deficit_split(sizes, {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert plan == graph.largest_deficit_split(sizes[::-1], {"train": 0.7, "validation": 0.15, "test": 0.15})
    share = sum(n for c, n in sizes if plan[c] == "train") / sum(n for _, n in sizes)
    assert 0.65 < share < 0.75


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁne  Ⅷ\r\n\r\n x ", "alpha beta gamma")], "a string, t string")
    r = df.select(X.nfkc("a").alias("n"), X.head(F.col("t"), 9).alias("h"), X.tail(F.col("t"), 8).alias("e")).first()
    assert tuple(r) == ("fine VIII\nx", "alpha", "gamma")


def test_cosine_of_equal_and_disjoint_texts(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a b", "c d"), (3, "", "a")], "k int, x string, y string")
    got = {r.k: round(r.similarity, 9) for r in X.pair_cosine(df, ["k"], "x", "y").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


def test_cross_join_free_ranks_and_identity(spark):
    df = spark.createDataFrame([(1, "", "f"), (2, None, None), (3, "h", "f")], "i int, digest string, file string")
    assert [r.x for r in df.select(relational.identity("digest", "file", default="unknown").alias("x")).collect()] == ["f", "unknown", "h"]


def test_protocol_is_sealed_and_split_authenticated(spark, tmp_path):
    rows = spark.createDataFrame([("train", "e1", "c1", 1), ("test", "e2", "c2", 2)], "split string, ep string, comp string, v int")
    p = G.freeze(rows, "split", "ep", "comp", {"accuracy": 0.3}, [], 42)
    G.authenticate(rows, p, "split", "train", "ep", "comp")
    with pytest.raises(G.ContractError):
        G.authenticate(rows.withColumn("v", F.col("v") + 1), p, "split", "train", "ep", "comp")
    with pytest.raises(G.ContractError):
        G.check(p | {"seed": 1})
    with pytest.raises(G.ContractError):
        G.advance(p, "VALIDATED")
    done = G.advance(G.advance(p, "PROVISIONAL"), "VALIDATED")
    marker = str(tmp_path / "once")
    assert writers.verify(G.locked_test(marker, done, lambda: {"accuracy": 1.0}))
    with pytest.raises(FileExistsError):
        G.locked_test(marker, done, lambda: {})
    with pytest.raises(G.ContractError):
        G.refuse("tuning on validation")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.exclusive(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        writers.exclusive(df, str(tmp_path / "x"))
    assert writers.canonical({"b": 1.5, "a": "é"}) == '{"a":"é","b":1.5}'
    assert writers.table_digest(spark, df) == writers.table_digest(spark, df.orderBy(F.desc("k")))
    assert "| 1 | a |" in writers.markdown(df.orderBy("k"), "t")
    writers.csv(df, str(tmp_path / "c.csv"))
    assert readers.frame(spark, str(tmp_path / "c.csv")).count() == 2
    assert readers.find_column(["Student_Answer", "x"], ["answer", "student_answer"], "answers") == "Student_Answer"


def test_pairs_of_a_large_pool_are_whole_and_parted(spark, monkeypatch):
    """all pairs of a pool came from one task, in an order that no file could hold in little space."""
    monkeypatch.setattr(contracts, "BLOCK", 8)
    monkeypatch.setattr(contracts, "RUN", 3)
    a = [(i, 0) for i in range(50)] + [(7, 0)] * 30 + [(100, 1), (101, None), (102, 2), (103, 3)]
    b = [(i * 10, 0, "x") for i in range(40)] + [(1, 1, None), (1, 1, None), (2, None, "y"), (3, 3, "z"), (4, 4, "z")]
    left, right = spark.createDataFrame(a, "s long, pool int"), spark.createDataFrame(b, "c long, pool int, t string")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = contracts.paired_pools(left, right, "pool")
        rows = out.select("*", F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert out.columns == ["pool", "s", "c", "t"]
    assert Counter((r.pool, r.s, r.c, r.t) for r in rows) == Counter((p, s, c, t) for s, p in a for c, q, t in b if p is not None and p == q)
    each = Counter(r.at for r in rows)
    assert max(each.values()) < 0.7 * len(rows)
    assert contracts.paired_pools(left.limit(0), right, "pool").count() == 0
    assert contracts.paired_pools(left.select("pool"), right.select("pool"), "pool").count() == len(rows)


def test_components_join_edges_before_rounds(spark, monkeypatch):
    """each round shuffled and wrote all edges; now only links between the roots of tasks go through rounds."""
    monkeypatch.setattr(graph, "EDGES", 40)
    monkeypatch.setattr(graph, "CHUNK", 25)
    rounds, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(cut(df)) or rounds[-1])
    copies = [(1000 * k + 2 * (i * 7 % 20), 1000 * k + 2 * (i * i % 61) + 1) for k in range(9) for i in range(80)]
    odd = [(90_001, 90_001), (90_003, None), (None, 90_005), (90_007, 90_008), (90_008, 90_007)]
    chain = [(100_000 + i, 100_001 + i) for i in range(150)]
    hub = [(200_000, 200_001 + i) for i in range(150)]
    edges = copies + odd + chain + hub
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    whole = [(a, b) for a, b in edges if a is not None and b is not None]
    for a, b in whole:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(root) and {r.node: r.component for r in rows} == {x: find(x) for x in root}
    assert all(df.count() < len(whole) / 4 for df in rounds[1:])
    words = graph.components(spark.createDataFrame([("b", "é"), ("é", "z"), ("x", "x")], "a string, b string")).collect()
    assert {(r.node, r.component) for r in words} == {("b", "b"), ("é", "b"), ("z", "b"), ("x", "x")}
    mixed = graph.components(spark.createDataFrame([(1, 2**40)], "a int, b long"))
    assert {(r.node, r.component) for r in mixed.collect()} == {(1, 1), (2**40, 1)}
