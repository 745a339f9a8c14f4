"""Sequential Bayesian belief as an array fold in the JVM.

A skill's evidence is independent of other skills', so work spreads over
(episode, skill); the fold runs over one skill's turns, a bounded array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BeliefConfig:
    """Constants of the belief model, validated on creation."""

    centres: tuple[float, ...] = (0.20, 0.50, 0.80)
    scales: tuple[float, ...] = (0.22, 0.22, 0.22)
    prior: tuple[float, ...] = (1 / 3, 1 / 3, 1 / 3)
    discount_power: float = 0.5
    duplicate_multiplier: float = 0.25
    cap: float = 5.0
    temperature: float = 1.0
    floor: float = 1e-4
    least_confidence: float = 0.50
    least_evidence: float = 2.0
    least_coverage: int = 3
    low_bias: float | None = None

    def __post_init__(self):
        n = len(self.prior)
        if not (len(self.centres) == len(self.scales) == n == 3):
            raise ValueError("three classes are needed")
        if any(s <= 0 for s in self.scales) or list(self.centres) != sorted(self.centres):
            raise ValueError("scales are positive and centres ascend")
        if abs(sum(self.prior) - 1) > 1e-6 or min(self.prior) <= 0:
            raise ValueError("the prior is a distribution without zeros")
        if not (0 <= self.floor < 1 / 3 and self.cap > 0 and self.temperature > 0 and 0 <= self.duplicate_multiplier <= 1 and self.discount_power >= 0):
            raise ValueError("a constant is out of its range")
        if not (0 <= self.least_confidence <= 1 and self.least_evidence >= 0 and self.least_coverage >= 0):
            raise ValueError("a threshold is out of its range")


def let(value: Column, f) -> Column:
    """Bind a value once inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """F34."""
    shifted = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x - m)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def floored(p: Column, floor: float) -> Column:
    """no entry below the floor, sum one."""
    return let(F.transform(p, lambda x: F.greatest(x, F.lit(floor))), lambda q: let(total(q), lambda s: F.transform(q, lambda x: x / s)))


def logs(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-12))))


def entropy(p: Column) -> Column:
    """A47."""
    return -total(F.transform(p, lambda x: x * F.log(x + 1e-12)))


def fold(turns: Column, c: BeliefConfig) -> Column:
    """W01 over an array of structs (score, reliability, fingerprint) in order: struct (p, n, ess).

    Scores are valid evidence in [0, 1]. A repeated fingerprint discounts the
    update, and is remembered even where the update has no weight.
    """
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    start = F.struct(doubles(c.prior).alias("p"), F.lit(0).alias("n"), F.lit(0.0).alias("ess"), F.array().cast("array<string>").alias("seen"))
    centres, scales = doubles(c.centres), doubles(c.scales)

    def step(s: Column, t: Column) -> Column:
        known = F.coalesce(F.array_contains(s.seen, t.fingerprint), F.lit(False))
        weight = F.least(t.reliability / F.pow(1.0 + s.ess, F.lit(c.discount_power)) * F.when(known, c.duplicate_multiplier).otherwise(1.0), F.greatest(c.cap - s.ess, F.lit(0.0)))
        seen = F.when(t.fingerprint.isNull() | (t.fingerprint == "") | known, s.seen).otherwise(F.array_append(s.seen, t.fingerprint))

        def moved(w: Column) -> Column:
            fit = F.zip_with(centres, scales, lambda m, d: -0.5 * F.pow((t.score - m) / d, F.lit(2)) - F.log(d))
            posterior = floored(softmax(F.zip_with(logs(s.p), fit, lambda a, b: a + w * b)), c.floor)
            return F.when(w > 0, F.struct(posterior.alias("p"), (s.n + 1).alias("n"), (s.ess + w).alias("ess"), seen.alias("seen"))).otherwise(F.struct(s.p.alias("p"), s.n.alias("n"), s.ess.alias("ess"), seen.alias("seen")))

        return let(weight, moved)

    return F.aggregate(turns, start, step, lambda s: F.struct(s.p.alias("p"), s.n.alias("n"), s.ess.alias("ess")))


def skill_beliefs(df: DataFrame, episode: str, skill: str, order: list[str], c: BeliefConfig = BeliefConfig()) -> DataFrame:
    """(episode, skill, p, n, ess) from rows with score, reliability and fingerprint."""
    turns = F.sort_array(F.collect_list(F.struct(*order, "score", "reliability", "fingerprint")))
    return df.groupBy(episode, skill).agg(turns.alias("turns")).select(episode, skill, fold(F.col("turns"), c).alias("b")).select(episode, skill, "b.*")


def assessment(beliefs: DataFrame, episode: str, c: BeliefConfig = BeliefConfig(), importance: Column | None = None) -> DataFrame:
    """Log-opinion pool over visited skills by evidence, then label, or null where evidence is thin."""
    w = F.greatest(importance if importance is not None else F.lit(1.0), F.lit(0.0)) * F.least(F.col("ess"), F.lit(c.cap))
    parts = [F.sum(w * (F.log(F.greatest(F.get("p", F.lit(k)), F.lit(1e-12))) - F.log(F.lit(c.prior[k])))) for k in range(3)]
    seen = F.col("n") > 0
    pooled = beliefs.filter(seen).groupBy(episode).agg(F.array(*parts).alias("delta"), F.sum(w).alias("weight"), F.sum(F.least("ess", F.lit(c.cap))).alias("evidence"), F.count("*").alias("covered"))
    prior = F.array(*[F.log(F.lit(x)) for x in c.prior])
    logits = F.zip_with(prior, F.col("delta"), lambda a, d: (a + F.coalesce(F.try_divide(d, F.col("weight")), F.lit(0.0))) / c.temperature)
    out = pooled.withColumn("pool", floored(softmax(logits), c.floor))
    if c.low_bias is not None:
        biased = F.transform(logs(F.col("pool")), lambda x, i: x + F.when(i == 0, c.low_bias).otherwise(0.0))
        out = out.withColumn("decision", floored(softmax(biased), c.floor))
    else:
        out = out.withColumn("decision", F.col("pool"))
    confidence = F.array_max("decision")
    label = (F.array_position("decision", confidence) - 1).cast("int")
    raw = (F.array_position("pool", F.array_max("pool")) - 1).cast("int")
    enough = (confidence >= c.least_confidence) & (F.col("evidence") >= c.least_evidence) & (F.col("covered") >= c.least_coverage)
    return out.select(episode, F.when(enough, label).alias("label"), raw.alias("raw_label"), confidence.alias("confidence"), "evidence", "covered", entropy(F.col("pool")).alias("entropy"), "pool")
