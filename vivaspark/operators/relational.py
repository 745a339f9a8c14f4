"""Joins, top-k and set operators of the live session store and the offline corpus.

Equi joins are left to the planner and adaptive execution; nothing is forced to
broadcast. Ranks always carry a tie key, and top-1 per key is an aggregation
(max_by of a struct) rather than a sorted window, so it combines on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    last = F.max_by(F.struct(*keep), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def left_on(left: DataFrame, right: DataFrame, on: Column, keep_right: Column) -> DataFrame:
    """Left outer join with the right side's condition inside ON, so unmatched left rows stay."""
    return left.join(right, on & keep_right, "left")


def outstanding(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def referenced(df: DataFrame, key: str, *uses: tuple[DataFrame, str]) -> DataFrame:
    """Rows used by any of several tables; an OR of EXISTS as one semi join with their union."""
    used = reduce(DataFrame.union, [u.select(F.col(c).alias(key)) for u, c in uses])
    return df.join(used, key, "left_semi")


def missing_lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys that a required lookup does not have."""
    return rows.select(key).join(dimension.select(key), key, "left_anti").distinct()


def top_bottom(df: DataFrame, by: str, tie: str, n: int, keys: list[str]) -> DataFrame:
    """The first n and last n rows of each key, all where there are no more than 2n.

    Two ranks with a limit each, so a task passes on n rows a key; one rank
    follows from the other and the key's number of rows.
    """
    w = Window.partitionBy(*keys)
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    high = df.select("*", F.row_number().over(w.orderBy(F.desc(by), tie)).alias("rank_high")).filter(F.col("rank_high") <= n)
    low = df.select("*", F.row_number().over(w.orderBy(F.asc(by), F.desc(tie))).alias("rank_low")).filter(F.col("rank_low") <= n)
    high = high.join(total, keys).withColumn("rank_low", F.col("_all") - F.col("rank_high") + 1)
    low = low.join(total, keys).withColumn("rank_high", F.col("_all") - F.col("rank_low") + 1).filter(F.col("rank_high") > n)
    return high.unionByName(low).drop("_all")


#: Share of all rows from which a key is hot: one in so many.
HOT = 1000


def join_by_key(rows: DataFrame, one: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has a row a key and, in `weight`, how many of the rows have that key.

    Keys of a thousandth of all rows or more, at most HOT of them by that bound,
    are broadcast; the others are shuffled, none of them hot. `weight` is dropped.
    """
    hot = F.broadcast(one.filter(F.col(weight) * HOT >= total).drop(weight))
    rest = one.filter(F.col(weight) * HOT < total).drop(weight)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def cyclic_take(items: DataFrame, order: str, n: Column, total: Column, times: int) -> DataFrame:
    """Position -> item, going round the list as often as needed; `items` is a small dimension."""
    numbered = items.select("*", (F.row_number().over(Window.orderBy(order)) - 1).alias("_i"))
    return numbered.crossJoin(items.sparkSession.range(times).withColumnRenamed("id", "seq")).filter(F.pmod(n, total) == F.col("_i"))


def first_by_hash(df: DataFrame, content: Column, order: list) -> DataFrame:
    """Keep the first row of each content hash; `kept` false rows are the exclusion report."""
    digest = F.sha2(content, 256)
    out = df.withColumn("content_hash", digest)
    first = out.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("copies"))
    return out.join(first, "content_hash").withColumn("kept", F.struct(*order) == F.col("_first")).drop("_first")


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row with how many keys each side lacks; equal sets give two zeros."""
    sides = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return sides.agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"))


def conflicts(df: DataFrame, key: list[str], fingerprint: Column) -> DataFrame:
    """Idempotency keys met with more than one request fingerprint."""
    return df.groupBy(*key).agg(F.count_distinct(fingerprint).alias("fingerprints"), F.count("*").alias("requests")).filter("fingerprints > 1")


def is_question(kind: Column, action: Column) -> Column:
    """Neither a stop by kind nor by action; missing values pass."""
    return ~kind.eqNullSafe(F.lit("stop")) & ~action.eqNullSafe(F.lit(7))


def identity(*names: str, default: str) -> Column:
    """The first of these that is neither null nor empty, else a constant."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit(default))


def one_hot(action: Column, n: int) -> Column:
    """P19."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == action).cast("double"))


def close(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    """Tolerance test; the second side sets the scale."""
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def propensity_violations(probs: Column, mask: Column, action: Column, logged: Column) -> Column:
    """Codes of what is wrong with a behaviour distribution, an empty array if nothing is."""
    size = F.size(probs)
    checks = [
        ((size != 8) | (F.size(mask) != 8), "length"),
        (~F.forall(mask, lambda m: m.isin(0.0, 1.0)), "mask_not_binary"),
        (~F.forall(probs, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))), "not_a_probability"),
        (F.exists(F.zip_with(probs, mask, lambda p, m: (m == 0) & (p > 0)), lambda x: x), "mass_on_masked"),
        (~close(F.aggregate(probs, F.lit(0.0), lambda a, p: a + p), F.lit(1.0)), "sum"),
        (~close(F.get(probs, action), logged), "chosen_differs"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda c: c.isNotNull())


def sessionise(df: DataFrame, key: str, order: list[str], done: Column) -> DataFrame:
    """Episode number within a key; a new episode begins after each done row."""
    w = Window.partitionBy(key).orderBy(*order)
    ended = F.coalesce(F.lag(done.cast("int")).over(w), F.lit(0))
    return df.withColumn("_ended", ended).withColumn("episode", F.sum("_ended").over(w)).drop("_ended")


def unordered_pairs(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each unordered pair of rows within a key, once."""
    a = df.select(*[F.col(c).alias(c if c == key else f"{c}_a") for c in df.columns])
    b = df.select(*[F.col(c).alias(c if c == key else f"{c}_b") for c in df.columns])
    return a.join(b, key).filter(F.col(f"{name}_a") < F.col(f"{name}_b"))


def reproduced(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys on one side only, or whose values differ by more than the tolerance."""
    both = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key, "full")
    return both.filter(F.col("va").isNull() | F.col("vb").isNull() | (F.abs(F.col("va") - F.col("vb")) > tolerance))
