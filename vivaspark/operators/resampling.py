"""Bootstraps over episodes, components and scenarios, and the policy reports built on them.

A resample is a multiplicity for each unit (component, episode, scenario), drawn
from the digest of seed, replicate and unit: Poisson with mean one, which drawing
as many units as there are comes to when their number is large. So the draw is
data that any engine repeats, units need no numbers and no join, and replicates
combine before the shuffle: what is shuffled is one row a replicate, whatever the
number of rows. Rows are never copied; multiplicities are weights of sums of
sufficient statistics, or of medians.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivaspark.operators.metrics import CLASSES

#: Poisson(1): the probabilities of 0, of 1 or less, ... in parts of 2^32.
CUMULATED = [int(sum(1 / math.factorial(i) for i in range(k)) / math.e * 2**32) for k in range(1, 12)]
BINS = 10
METRICS = ("accuracy", "macro_f1", "min_recall", "calibration_error", "abstention")


def multiplicity(seed: Column | int, replicate: Column, unit: Column) -> Column:
    """How often a replicate has a unit."""
    digest = F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(seed), replicate, unit.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return reduce(lambda a, b: a + b, [(u >= c).cast("int") for c in CUMULATED])


def resampled(per: DataFrame, unit: str, sums: list[str], replicates: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, b and the sums of each replicate, from a row of sums a unit."""
    rows = per.select(*by, unit, *sums, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    rows = rows.withColumn("_w", multiplicity(seed, F.col("b"), F.col(unit))).filter("_w > 0")
    return rows.groupBy(*by, "b").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in sums])


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def statistics(df: DataFrame, unit: str, truth: str, models: dict[str, tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """A row of sums a unit, enough for every metric of each model (prediction, probabilities), and their names.

    Correctness of the calibration bins is that of the largest probability, lowest
    class on ties, whatever was decided.
    """
    y = F.col(truth)
    aggs = {f"t{c}": F.count_if(y == c) for c in CLASSES}
    for m, (prediction, probs) in models.items():
        p, top = F.col(prediction), F.array_max(probs)
        aggs |= {f"{m}_h{c}": F.count_if((y == c) & (p == c)) for c in CLASSES} | {f"{m}_g{c}": F.count_if(p == c) for c in CLASSES}
        aggs[f"{m}_n"] = F.count(p)
        gap = top - (F.array_position(probs, top) - 1 == y).cast("double")
        at = F.least(F.floor(top * BINS), F.lit(BINS - 1))
        aggs |= {f"{m}_e{i}": F.coalesce(F.sum(F.when(at == i, gap)), F.lit(0.0)) for i in range(BINS)}
    return df.groupBy(unit).agg(*[a.alias(n) for n, a in aggs.items()]), list(aggs)


def metrics_of(model: str) -> list[Column]:
    """METRICS of a model from the sums of statistics()."""
    c = lambda n: F.col(f"{model}_{n}")
    n = F.col("t0") + F.col("t1") + F.col("t2")
    recall = [_div(c(f"h{k}"), F.col(f"t{k}")) for k in CLASSES]
    precision = [_div(c(f"h{k}"), c(f"g{k}")) for k in CLASSES]
    f1 = [_div(2 * p * r, p + r) for p, r in zip(precision, recall)]
    error = reduce(lambda a, b: a + b, [F.abs(c(f"e{i}")) for i in range(BINS)])
    return [_div(c("h0") + c("h1") + c("h2"), n), (f1[0] + f1[1] + f1[2]) / 3, F.least(*recall), _div(error, n), _div(n - c("n"), n)]


def _differences(sums: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return sums.select(*keep, *[(b - a).alias(m) for m, a, b in zip(METRICS, metrics_of("base"), metrics_of("new"))])


def paired_bootstrap(df: DataFrame, component: str, truth: str, base: tuple[str, str], new: tuple[str, str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """A row a metric with the difference of two models, its percentile interval and the range of leaving one component out.

    Components are resampled whole, for both models at once. The sums without a
    component are those of all less its own. Empty replicates don't count.
    """
    per, names = statistics(df, component, truth, {"base": base, "new": new})
    whole = per.agg(*[F.sum(c).alias(c) for c in names])
    point = _differences(whole)
    draws = _differences(resampled(per, component, names, replicates, seed))
    totals = whole.select(*[F.col(c).alias(f"all_{c}") for c in names])  # one row
    without = per.crossJoin(F.broadcast(totals)).select(*[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names]).filter("t0 + t1 + t2 > 0")
    left = _differences(without)
    interval = [x for m in METRICS for x in (F.percentile(m, F.lit(0.025)).alias(f"low_{m}"), F.percentile(m, F.lit(0.975)).alias(f"high_{m}"))]
    extremes = [x for m in METRICS for x in (F.min(m).alias(f"least_{m}"), F.max(m).alias(f"most_{m}"))]
    row = point.crossJoin(draws.agg(F.count("*").alias("replicates"), *interval)).crossJoin(left.agg(*extremes)).crossJoin(per.agg(F.count("*").alias("components")))
    return row.select("components", "replicates", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("difference"), *[F.col(f"{k}_{m}").alias(k) for k in ("low", "high", "least", "most")]) for m in METRICS])))


def weighted_medians(rows: DataFrame, keys: list[str], value: str, weights: str, levels: int = 2, fan: int = 256) -> DataFrame:
    """keys, b and the lower median of value (0 to 1) under each weight of the array `weights`.

    First the bin that holds each median is found, then a bin of that bin; only
    rows there are looked at value by value. Sums of bins are what is shuffled.
    """
    at = lambda n: F.least(F.floor(F.col(value) * fan**n), F.lit(fan**n - 1)).cast("long").alias(f"_at{n}")
    part = rows.select(*keys, value, weights, *[at(n) for n in range(1, levels + 1)])
    found = None
    for n in range(1, levels + 2):
        where = f"_at{n}" if n <= levels else value
        each = lambda d, *more: d.select(*keys, *more, where, F.posexplode(weights).alias("b", "_w")).filter("_w > 0")  # noqa: E731, B023
        if found is None:
            sums = each(part).groupBy(*keys, "b", where).agg(F.sum("_w").alias("_w")).withColumns({"_below": F.lit(0.0), "_half": F.lit(None).cast("double")})
        else:
            last = f"_at{n - 1}"
            near = part.join(F.broadcast(found.select(*keys, last).distinct()), [*keys, last], "left_semi")
            sums = each(near, last).join(F.broadcast(found), [*keys, "b", last]).groupBy(*keys, "b", where).agg(F.sum("_w").alias("_w"), F.first("_below").alias("_below"), F.first("_half").alias("_half"))
        own = Window.partitionBy(*keys, "b")
        cum = sums.withColumns({"_upto": F.col("_below") + F.sum("_w").over(own.orderBy(where)), "_half": F.coalesce("_half", F.sum("_w").over(own) / 2)})
        reach = cum.filter(F.col("_upto") >= F.col("_half") * (1 - 1e-12)).groupBy(*keys, "b").agg(F.min(F.struct(where, (F.col("_upto") - F.col("_w")).alias("_below"), "_half")).alias("_f"))
        found = reach.select(*keys, "b", "_f.*")
    return found.select(*keys, "b", F.col(value).alias("median"))


def fit_stability(df: DataFrame, episode: str, label: str, value: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """Each class's centre over bootstraps of whole episodes: mean, deviation, and how often centres are ordered.

    A row weighs its episode's multiplicity over its number of rows. Centres are
    weighted medians made increasing by class; `ordered_before` is the share of
    replicates where they were so already. Replicates without one of the classes
    don't count.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: multiplicity(seed, b, F.col(episode)))
    per = df.groupBy(episode).agg(F.count("*").alias("_n")).withColumn("_m", draws)
    rows = df.join(per, episode).select(label, value, F.transform("_m", lambda m: m / F.col("_n")).alias("_ws"))
    medians = weighted_medians(rows, [label], value, "_ws")
    one = Window.partitionBy("b").orderBy(label)
    centres = medians.withColumns({"centre": F.max("median").over(one), "_up": F.coalesce(F.col("median") >= F.lag("median").over(one), F.lit(True)), "_k": F.count("*").over(Window.partitionBy("b"))})
    full = centres.filter(F.col("_k") == len(CLASSES))
    ordered = full.groupBy("b").agg(F.min("_up").alias("up")).agg(F.avg(F.col("up").cast("double")).alias("ordered_before"))
    out = full.groupBy(label).agg(F.count("*").alias("replicates"), F.avg("centre").alias("mean"), F.stddev_pop("centre").alias("deviation"), F.lit(1.0).alias("ordered"))
    return out.crossJoin(F.broadcast(ordered))


def unmatched(df: DataFrame, policy: str, scenario: str, reference: str) -> DataFrame:
    """Policies whose scenarios are not the reference's: how many of those they lack, how many they have besides."""
    have = df.select(policy, scenario).distinct()
    ref = have.filter(F.col(policy) == reference).select(scenario, F.lit(True).alias("_ref"))
    others = have.filter(F.col(policy) != reference).join(ref, scenario, "left")
    own = others.groupBy(policy).agg(F.count("_ref").alias("shared"), F.count_if(F.col("_ref").isNull()).alias("extra"))
    size = ref.agg(F.count("*").alias("size"))  # one row
    return own.crossJoin(F.broadcast(size)).select(policy, (F.col("size") - F.col("shared")).alias("missing"), "extra").filter("missing + extra > 0")


def mean_intervals(per: DataFrame, by: tuple[str, ...], unit: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """By, and low_ and high_ of each value: the percentile interval of its mean over units."""
    sums = resampled(per.select(*by, unit, *values, F.lit(1).alias("_n")), unit, [*values, "_n"], replicates, seed, by)
    mean = [F.col(v) / F.col("_n") for v in values]
    ends = [x for v, m in zip(values, mean) for x in (F.percentile(m, F.lit(0.025)).alias(f"low_{v}"), F.percentile(m, F.lit(0.975)).alias(f"high_{v}"))]
    return sums.groupBy(*by).agg(*ends)


def paired_report(df: DataFrame, policy: str, scenario: str, reference: str, values: list[str], replicates: int = 2000, seed: int = 42) -> DataFrame:
    """The reference less each other policy on the same scenarios, a row a value: mean, interval, wins, ties, losses.

    A policy with other scenarios than the reference, or with one twice, is an error.
    """
    if not unmatched(df, policy, scenario, reference).isEmpty() or not df.groupBy(policy, scenario).count().filter("count > 1").isEmpty():
        raise ValueError("paired comparisons need the same scenarios, each once")
    ref = df.filter(F.col(policy) == reference).select(scenario, *[F.col(v).alias(f"_{v}") for v in values])
    diff = df.filter(F.col(policy) != reference).join(ref, scenario).select(policy, scenario, *[(F.col(f"_{v}") - F.col(v)).cast("double").alias(v) for v in values])
    marks = [x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.count_if(F.col(v) > 0).alias(f"wins_{v}"), F.count_if(F.col(v) == 0).alias(f"ties_{v}"), F.count_if(F.col(v) < 0).alias(f"losses_{v}"))]
    both = diff.groupBy(policy).agg(*marks).join(mean_intervals(diff, (policy,), scenario, values, replicates, seed), policy)
    return both.select(policy, F.inline(F.array(*[F.struct(F.lit(v).alias("value"), *[F.col(f"{k}_{v}").alias(k) for k in ("mean", "low", "high", "wins", "ties", "losses")]) for v in values])))


def policy_report(df: DataFrame, policy: str, scenario: str, truth: str, prediction: str, values: list[str], reason: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """A row a policy: accuracy with its interval, class metrics, each value's mean, deviation, extremes and interval, and counts of reasons."""
    y, p = F.col(truth), F.col(prediction)
    rows = df.withColumn("accuracy", F.coalesce((y == p).cast("double"), F.lit(0.0)))
    cells = [x for c in CLASSES for x in (F.count_if((y == c) & (p == c)).alias(f"_h{c}"), F.count_if(y == c).alias(f"_t{c}"), F.count_if(p == c).alias(f"_g{c}"))]
    stats = [x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"std_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"))]
    whole = rows.groupBy(policy).agg(F.count("*").alias("episodes"), F.avg("accuracy").alias("accuracy"), *cells, *stats)
    recall = [_div(F.col(f"_h{c}"), F.col(f"_t{c}")) for c in CLASSES]
    precision = [_div(F.col(f"_h{c}"), F.col(f"_g{c}")) for c in CLASSES]
    f1 = [_div(2 * a * b, a + b) for a, b in zip(precision, recall)]
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / len(CLASSES)
    reasons = rows.groupBy(policy, reason).agg(F.count("*").alias("n")).groupBy(policy).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(reason), F.lit("none")), "n")))).alias("reasons"))
    ends = mean_intervals(rows, (policy,), scenario, ["accuracy", *values], replicates, seed)
    kept = ["episodes", "accuracy", *[f"{k}_{v}" for v in values for k in ("mean", "std", "min", "max")]]
    both = whole.select(policy, *kept, mean(recall).alias("balanced_accuracy"), mean(f1).alias("macro_f1"), *[r.alias(f"recall_{c}") for c, r in zip(CLASSES, recall)])
    return both.join(ends, policy).join(reasons, policy)
