"""Audits of corpora and gates: counters, strata, leaks, duplicates, thresholds, grids."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strata(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """The aggregates over all rows and by each stratum on its own, in one scan; `level` tells which."""
    sets = [[F.col(c)] for c in by] + [[]]
    return df.groupingSets(sets, *[F.col(c) for c in by]).agg(*aggregates, F.grouping_id(*by).alias("level"))


def support(df: DataFrame, action: str, reward: str, actions: list[str]) -> DataFrame:
    """Every known action with its count, and whether it is missing, rare or of constant reward."""
    known = df.sparkSession.createDataFrame([(a,) for a in actions], "action string")
    counts = df.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n"), F.stddev_pop(reward).alias("s"))
    total = counts.agg(F.sum("n").alias("total"))
    n = F.coalesce("n", F.lit(0))
    return known.join(counts, "action", "left").crossJoin(total).select("action", n.alias("n"), F.col("n").isNull().alias("missing"), (n < F.greatest(F.lit(20.0), 0.01 * F.col("total"))).alias("low_support"), (F.coalesce("s", F.lit(0.0)) < 0.01).alias("flat_reward"))


def leaks(df: DataFrame, identity: str, split: str, name: str) -> DataFrame:
    """Identities in more than one split, or under more than one name."""
    return df.groupBy(identity).agg(F.count_distinct(split).alias("splits"), F.count_distinct(name).alias("names")).filter("splits > 1 OR names > 1")


def cross_duplicates(df: DataFrame, text: str, component: str) -> DataFrame:
    """Texts met in several components: how many, the rows beyond the first of each, their share."""
    per = df.groupBy(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("n"), F.min(component).alias("a"), F.max(component).alias("b"))
    many = F.col("a") != F.col("b")
    out = per.agg(F.count_if(many).alias("groups"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("excess"), F.sum("n").alias("rows"))
    return out.select("groups", "excess", F.coalesce(F.try_divide("excess", "rows"), F.lit(0.0)).alias("rate"))


def within_episode(df: DataFrame, episode: str, question: str, target: str, provenance: str) -> DataFrame:
    """Repeated questions, distinct targets, and whether provenance is constant."""
    return df.groupBy(episode).agg((F.count(question) - F.count_distinct(question)).alias("repeated"), F.count_distinct(target).alias("targets"), (F.count_distinct(provenance) == 1).alias("constant"))


def gate(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """One row a threshold: metric, value, threshold, passed."""
    checks = [F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("value"), F.lit(float(t)).alias("threshold"), ((F.col(m) >= t) if op == ">=" else (F.col(m) <= t)).alias("passed")) for m, (op, t) in thresholds.items()]
    return metrics.select(F.inline(F.array(*checks)))


def best_of_grid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Accuracy of each pair of thresholds; the best, first on ties. The grid is a constant-size table.

    Scores between two neighbouring thresholds are judged alike, so rows are
    counted by interval and class once, and only the counts meet the grid.
    """
    cuts = sorted({v for r in grid.select("low", F.col("low") + F.col("gap")).collect() for v in r})
    placed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="s", outputCol="_b", handleInvalid="keep").transform(rows.select("y", F.col("s").cast("double").alias("s")))
    counts = placed.groupBy("_b", "y").agg(F.min("s").alias("s"), F.count("*").alias("_n"))
    label = F.when(F.col("s") < F.col("low"), 0).when(F.col("s") < F.col("low") + F.col("gap"), 1).otherwise(2)
    hit = (label == F.col("y")).cast("int")
    share = F.sum(hit * F.col("_n")) / F.sum(F.when(hit.isNotNull(), F.col("_n")))
    scored = counts.crossJoin(F.broadcast(grid)).groupBy("low", "gap").agg(F.round(share, 9).alias("acc"))
    best = scored.agg(F.max_by(F.struct("low", "gap", "acc"), F.struct(F.col("acc"), -F.col("low"), -F.col("gap"))).alias("b"))
    return best.select(F.round("b.low", 6).alias("low"), F.round("b.gap", 6).alias("gap"), F.round("b.acc", 6).alias("accuracy"))
