"""Identity components, ontology graphs, dictionary and overlap joins, splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vivaspark.functions import text as X
from vivaspark.session import shared_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Edges that a task gets, about, and joins at once, at most.
EDGES, CHUNK = 1 << 20, 1 << 21


def _local(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of each CHUNK of edges, with the smallest that they reach within it; a node may be in several."""
    schema = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).schema

    def roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        """The smallest node that each of n nodes reaches over edges x, y: larger roots hang at smaller ones until none is left to hang."""
        root = np.arange(n)
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            x, y = root[x], root[y]
            x, y = x[x != y], y[x != y]
        return root

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(schema)

        def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ends = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1)]
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            root = roots(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((nodes, nodes[root]), to.types)], schema=to)

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= CHUNK:
                yield joined(held)
                held, n = [], 0
        if n:
            yield joined(held)

    return edges.mapInArrow(walk, schema)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) by smallest reachable node, over an edge list (a, b).

    Edges are dealt by ranges of nodes, as those near each other often meet, and
    each task joins its own. Then not edges are shuffled but nodes, each with a
    local root; where a node has several, these are linked, one to the next, and
    only the links between roots go through rounds.
    """
    kind = edges.select("a").union(edges.select("b")).schema[0].dataType
    own = edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    before = F.lag("root").over(Window.partitionBy("node").orderBy("root"))
    # Sorted, so that a task that is run again joins the same edges.
    near = own.repartitionByRange(own.count() // EDGES + 1, "a", "b").sortWithinPartitions("a", "b")
    met = cut_lineage(_local(near).withColumn("before", before))
    linked = _spread(met.filter("before < root").select(F.col("root").alias("a"), F.col("before").alias("b")), most_rounds)
    nodes = met.filter("before IS NULL").select("node", "root").join(linked.withColumnRenamed("node", "root"), "root", "left")
    return nodes.select("node", F.coalesce("component", "root").alias("component"))


def _spread(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Components by rounds that spread the smallest label over edges and then follow labels' own labels, so distances halve; each round is cut by a checkpoint."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        hop = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = cut_lineage(step.join(hop, "c", "left").select("node", F.least("c", F.coalesce("up", "c")).alias("next"), "component"))
        changed = new.filter("next <> component").limit(1).count()
        labels = new.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def has_cycle(edges: DataFrame, most_rounds: int = 200) -> bool:
    """Whether leaves can't be stripped off until nothing is left. For ontology-sized graphs."""
    left = cut_lineage(edges.select("a", "b").distinct())
    for _ in range(most_rounds):
        n = left.count()
        if not n:
            return False
        left = cut_lineage(left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if left.count() == n:
            return True
    return True


def hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Prerequisites one step away that are not given already, with the first parent."""
    out = edges.join(nodes.select(F.col("node").alias("b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
    return out.join(nodes, "node", "left_anti")


def overlapping(left: DataFrame, right: DataFrame, l_id: str, r_id: str, items: str, least: int) -> DataFrame:
    """Pairs of sets with at least `least` common items, by an equi join on the rarest items of one side, then an exact count.

    A set of n items that shares `least` with another shares one of its
    n - least + 1 rarest. One side is enough for that, so the one with fewer
    items in all is ranked, and the other is only taken apart.
    """
    a, b = (rows.select(i, F.array_distinct(items).alias("_x")).filter(F.size("_x") >= least) for rows, i in ((left, l_id), (right, r_id)))
    sizes = [rows.agg(F.coalesce(F.sum(F.size("_x") - least + 1), F.lit(0))).first()[0] for rows in (a, b)]
    few, few_id, many, many_id = (a, l_id, b, r_id) if sizes[0] < sizes[1] else (b, r_id, a, l_id)
    each = many.select(many_id, F.explode("_x").alias("item"))
    own = few.select(few_id, F.size("_x").alias("_n"), F.explode("_x").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("often"))
    # Items that the other side lacks are the rarest of all, and lead nowhere.
    ranked = own.join(often, "item", "left").withColumn("_r", F.row_number().over(Window.partitionBy(few_id).orderBy(F.col("often").asc_nulls_first(), "item")))
    rare = ranked.filter((F.col("_r") <= F.col("_n") - least + 1) & F.col("often").isNotNull()).select(few_id, "item")
    pairs = each.join(rare, "item").select(l_id, r_id).distinct()
    both = pairs.join(a, l_id).withColumnRenamed("_x", "_y").join(b, r_id)
    return both.select(l_id, r_id, F.size(F.array_intersect("_y", "_x")).cast("long").alias("common")).filter(F.col("common") >= least)


def evidence(docs: DataFrame, key: str, text: str, catalog: dict[str, list[str]], most: int = 5) -> DataFrame:
    """Skills whose aliases stand in a text, with how often. The catalog is a constant of the plan.

    One scan tests all aliases; only matches become rows.
    """
    found = [F.struct(F.lit(skill).alias("skill"), sum((F.regexp_count(text, F.lit(X.alias_pattern(a))) for a in aliases), F.lit(0)).alias("hits")) for skill, aliases in catalog.items()]
    rows = docs.select(key, F.explode(F.array(*found)).alias("f")).select(key, "f.*")
    return rows.filter("hits > 0").withColumn("spans", F.least("hits", F.lit(most)))


def hash_split(groups: DataFrame, group: str, seed: int, train: float, validation: float) -> DataFrame:
    """Groups in the order of a seeded hash; the first share trains, the next validates, at least one each."""
    one = Window.partitionBy(F.lit(1))  # over groups, not rows
    ranked = groups.select(group).distinct().withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), group), 256))
    ranked = ranked.withColumn("i", F.row_number().over(one.orderBy("h", group))).withColumn("n", F.count("*").over(one))
    a = F.greatest(F.round(F.col("n") * train), F.lit(1))
    b = F.greatest(F.round(F.col("n") * validation), F.lit(1))
    return ranked.select(group, F.when(F.col("i") <= a, "train").when(F.col("i") <= a + b, "validation").otherwise("test").alias("split"))


def largest_deficit_split(sizes: list[tuple], ratios: dict[str, float]) -> dict:
    """Components, largest first, each to the split that lacks most; ties to the earlier split, then smaller id.

    A greedy step over the component table, which is small; runs on the driver.
    """
    total = sum(n for _, n in sizes)
    left = {s: r * total for s, r in ratios.items()}
    out = {}
    for c, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(left, key=lambda s: (left[s], -list(left).index(s)))
        out[c] = best
        left[best] -= n
    return out


def largest_remainder(df: DataFrame, share: Column, total: int, tie: str) -> DataFrame:
    """whole parts of shares of a total, the rest by largest remainder, ties by key. For dimension tables."""
    one = Window.partitionBy(F.lit(1))
    out = df.withColumn("_x", share / F.sum(share).over(one) * total).withColumn("_f", F.floor("_x"))
    rank = F.row_number().over(one.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), tie))
    left = F.lit(total) - F.sum("_f").over(one)
    return out.withColumn("_r", rank).withColumn("_left", left).withColumn("allocated", F.col("_f") + (F.col("_r") <= F.col("_left")).cast("long")).drop("_x", "_f", "_r", "_left")


def capacity_shares(df: DataFrame, group: list[str], capacity: str, total: str, tie: str) -> DataFrame:
    """each group's total parted in proportion to capacities, none above its own.

    Whole parts first; what is left goes by one to the largest remainders of those
    that are not full, ties by key. Arithmetic is exact. `fits` is false, and
    nothing allocated, where the total is negative or above all capacities.
    """
    w = Window.partitionBy(*group)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    rows = df.withColumn("_all", F.sum(capacity).over(w).cast("decimal(19,0)")).withColumn("fits", F.col(total).between(0, F.col("_all")))
    rows = rows.withColumn("_product", F.when(F.col("fits"), exact(total) * exact(capacity)).otherwise(F.lit(0).cast("decimal(38,0)")))
    some = F.col("_all") > 0
    rows = rows.withColumn("_whole", F.when(some, F.expr("_product div _all")).otherwise(0)).withColumn("_rest", F.when(some, F.expr("_product % _all")).otherwise(0))
    is_open = F.col("_whole") < F.col(capacity)
    rank = F.row_number().over(w.orderBy(F.desc(is_open), F.desc("_rest"), tie))
    left = F.when(F.col("fits"), F.col(total)).otherwise(0) - F.sum("_whole").over(w)
    rows = rows.withColumn("_rank", rank).withColumn("_left", left)
    return rows.withColumn("allocated", (F.col("_whole") + (is_open & (F.col("_rank") <= F.col("_left"))).cast("long")).cast("long")).drop("_all", "_product", "_whole", "_rest", "_rank", "_left")
