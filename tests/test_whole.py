"""Queries read their tables whole: brute force over every row."""

from collections import Counter

import duckdb

from vivaspark.functions import text as X
from vivaspark.operators import calibrate, graph, metrics
from vivaspark.plans import registry


def brute_components(spark, sf):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_orderkey").collect():
        a, b = find(r.l_partkey * 2), find(r.l_orderkey * 2 + 1)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_and_splits_of_every_line(spark, sf):
    want = brute_components(spark, sf)
    got = {r.node: r.component for r in registry.QUERIES["connected_components_all"](spark, sf).collect()}
    assert got == want
    split = {}
    rows = registry.QUERIES["split_by_component"](spark, sf).collect()
    for r in rows:
        split.setdefault(r.component, set()).add(r.split)
    assert {r.node: r.component for r in rows} == want and all(len(s) == 1 for s in split.values())


def test_a_copy_of_any_earlier_turn_is_found(spark):
    rows = [(1, 1, "alpha beta gamma"), (1, 3, "delta epsilon zeta"), (1, 5, "alpha beta gamma"), (1, 7, "?"), (2, 1, "delta epsilon zeta")]
    got = X.history_cosine(spark.createDataFrame(rows, "conv_id long, turn long, text string"), "conv_id", "turn", "text")
    assert {(r.conv_id, r.turn): round(r.similarity, 9) for r in got.collect()} == {(1, 3): 0.0, (1, 5): 1.0, (1, 7): 0.0}


def test_report_has_every_scope(spark):
    rows = [(f"s{i:03}" if i else None, k % 3, (k * i) % 3 if k else None) for i in range(70) for k in range(5)]
    df = spark.createDataFrame(rows, "s string, y int, p int")
    got = {r.scope: r for r in calibrate.report(df, "y", "p", "s").collect()}
    assert set(got) == {"None"} | {f"s{i:03}" for i in range(1, 70)}
    for name in ("None", "s001", "s069"):
        own = metrics.classification(df.filter("s IS NULL" if name == "None" else f"s = '{name}'"), "y", "p").first()
        assert got[name].asDict() == own.asDict() | {"scope": name}


def test_flag_sees_every_earlier_turn(spark, tmp_path):
    said = [(1, 1, "alpha beta gamma"), (1, 3, "delta epsilon zeta"), (1, 5, "alpha beta gamma"), (1, 7, "?"), (2, 1, "delta epsilon zeta"), (3, 1, "?"), (3, 3, "!")]
    rows = [(c, n, "assistant", t) for c, n, t in said] + [(1, 2, "user", "delta epsilon zeta")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["history_similarity_flag"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, 1, 1.0), (3, 0, 0.0)}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert set(con.execute(registry.ORACLE_SQL["history_similarity_flag"]).fetchall()) == {(1, 1, 1.0), (3, 0, 0.0)}


def test_every_component_goes_to_the_split_of_its_plan(spark, tmp_path, monkeypatch):
    """components of several sizes, in orders that share parts; what is written between rounds is no more than the nodes."""
    written, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    lines = [(1000 * c + p, 1000 * c + o) for c in range(12) for o in range(c + 1) for p in (o, o + 1)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = brute_components(spark, str(tmp_path))
    plan = graph.largest_deficit_split(list(Counter(want.values()).items()), {"train": 0.7, "validation": 0.15, "test": 0.15})
    rows = registry.QUERIES["split_by_component"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r.node: (r.component, r.split) for r in rows} == {x: (c, plan[c]) for x, c in want.items()}
    assert sum(df.count() for df in written) <= len(want)
    assert len(set(plan)) == 12 and set(plan.values()) == {"train", "validation", "test"}
