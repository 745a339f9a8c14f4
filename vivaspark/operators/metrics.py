"""Classification, calibration, bootstrap and policy metrics.

Each is a conditional aggregation or a fixed number of them: matrices are counts
by (truth, prediction), so nothing is collected row by row. Guarded divisions
use try_divide, since ANSI mode is on. Log guards and deviations follow the
definitions: population in audits, sample in policy summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row a class with columns pred_0, pred_1, pred_2 and abstained; absent classes have zeros."""
    rows = df.sparkSession.createDataFrame([(c,) for c in CLASSES], f"{truth} int")
    counts = df.groupBy(F.col(truth).cast("int").alias(truth)).agg(*[F.count_if(F.col(prediction) == c).alias(f"pred_{c}") for c in CLASSES], F.count_if(F.col(prediction).isNull()).alias("abstained"))
    return rows.join(counts, truth, "left").na.fill(0)


def classification(df: DataFrame, truth: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Abstention-aware metrics in one pass over the rows, for each value of the columns `by`.

    Accuracy counts abstentions as wrong, the share of the commonest prediction
    is over classified rows (1 if there are none), and an abstention is two
    classes away for the ordinal error.
    """
    y, p = F.col(truth), F.col(prediction)
    n = F.count("*").alias("n")
    cells = [F.count_if((y == a) & (p == b)).alias(f"m{a}{b}") for a in CLASSES for b in CLASSES]
    totals = [F.count_if(y == a).alias(f"t{a}") for a in CLASSES]
    error = F.sum(F.coalesce(F.abs(y - p), F.lit(2))).alias("error")
    m = df.groupBy(*by).agg(n, *cells, *totals, F.count(p).alias("classified"), error)
    hits = F.col("m00") + F.col("m11") + F.col("m22")
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    guessed = [F.col("m0%d" % c) + F.col("m1%d" % c) + F.col("m2%d" % c) for c in CLASSES]
    recall = [div(F.col(f"m{c}{c}"), F.col(f"t{c}")) for c in CLASSES]
    precision = [div(F.col(f"m{c}{c}"), guessed[c]) for c in CLASSES]
    f1 = [div(2 * p_ * r_, p_ + r_) for p_, r_ in zip(precision, recall)]
    share = F.when(F.col("classified") == 0, 1.0).otherwise(div(F.greatest(*guessed), F.col("classified")))
    return m.select(
        *by,
        "n",
        "classified",
        div(F.col("classified"), F.col("n")).alias("coverage"),
        div(hits, F.col("n")).alias("accuracy"),
        div(hits, F.col("classified")).alias("selective_accuracy"),
        ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"),
        ((recall[0] + recall[1] + recall[2]) / 3).alias("balanced_accuracy"),
        F.least(*recall).alias("min_recall"),
        share.alias("max_share"),
        div(F.col("error"), F.col("n")).alias("ordinal_mae"),
    )


def calibration_error(df: DataFrame, truth: Column, probs: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of the largest probability, and the Brier score.

    Correctness is that of the argmax, lowest class on ties, whatever was decided.
    """
    top = F.array_max(probs)
    right = (F.array_position(probs, top) - 1 == truth).cast("double")
    brier = F.aggregate(F.transform(probs, lambda p, i: (p - (i == truth).cast("double")) ** 2), F.lit(0.0), lambda a, x: a + x)
    per = df.select(top.alias("conf"), right.alias("right"), brier.alias("brier"))
    per = per.groupBy(F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("right").alias("right"), F.sum("brier").alias("brier"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("conf") - F.col("right"))) / F.sum("n")).alias("ece"), (F.sum("brier") / F.sum("n")).alias("brier"))


def action_entropy(df: DataFrame, episode: str, action: str, reward: str) -> DataFrame:
    """Mean length, mean return and mean action entropy (1e-8 inside the log) of episodes."""
    parts = df.groupBy(episode, action).agg(F.count("*").alias("k"), F.sum(reward).alias("r"))
    # -sum p log(p + e) needs the episode's total: two levels of one partitioning.
    whole = parts.groupBy(episode).agg(F.sum("k").alias("n"), F.sum("r").alias("r"), F.collect_list("k").alias("ks"))
    entropy = -F.aggregate(F.transform("ks", lambda k: k / F.col("n") * F.log(k / F.col("n") + 1e-8)), F.lit(0.0), lambda a, x: a + x)
    return whole.agg(F.count("*").alias("episodes"), F.avg("n").alias("mean_length"), F.avg("r").alias("mean_return"), F.avg(entropy).alias("mean_entropy"))


def separation(df: DataFrame, label: str, value: str) -> DataFrame:
    """Classes by count, mean and population variance, with the effect size to the next class."""
    per = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    nxt = per.select((F.col("label") - 1).alias("label"), F.col("mean").alias("mean2"), F.col("variance").alias("variance2"))
    pooled = F.sqrt((F.col("variance") + F.col("variance2")) / 2)
    gap = F.col("mean2") - F.col("mean")
    effect = F.when(pooled > 0, F.try_divide(gap, pooled)).when(gap > 0, F.lit(float("inf"))).otherwise(F.when(gap.isNotNull(), 0.0))
    return per.join(nxt, "label", "left").select("label", "n", "mean", "variance", effect.alias("effect"))


def importance_sampling(df: DataFrame, target: Column, behaviour: Column, reward: Column, clip: float = 20.0) -> DataFrame:
    """Clipped self-normalised importance sampling with effective sample size and clip rate."""
    ratio = target / behaviour
    rows = df.select(F.least(ratio, F.lit(clip)).alias("w"), ratio.alias("raw"), reward.alias("r"))
    return rows.agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("w") * F.col("r")), F.sum("w")).alias("value"), F.try_divide(F.pow(F.sum("w"), 2), F.sum(F.col("w") ** 2)).alias("ess"), F.avg((F.col("raw") > clip).cast("double")).alias("clip_rate"), F.max("raw").alias("max_ratio"))


def policy_summary(df: DataFrame, policy: str, value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), extremes."""
    return df.groupBy(policy).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def paired(df: DataFrame, policy: str, scenario: str, reference: str, value: str) -> DataFrame:
    """Each other policy against the reference on the same scenarios: mean difference, wins, ties, losses."""
    ref = df.filter(F.col(policy) == reference).select(scenario, F.col(value).alias("_ref"))
    diff = df.filter(F.col(policy) != reference).join(ref, scenario).withColumn("d", F.col(value) - F.col("_ref"))
    return diff.groupBy(policy).agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_difference"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"))


def bootstrap(df: DataFrame, group: str, hits: Column, resamples: int, seed: int) -> DataFrame:
    """Percentile interval of a rate, resampling whole groups.

    A group's counts are sufficient statistics, so a resample draws groups and
    adds their counts. Draw i of replicate b takes the group numbered
    hash(seed, b, i) mod the number of groups: the draw is data, any engine
    repeats it. The group table is small (components), rows are never resampled.
    """
    from pyspark.sql import Window

    per = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(hits.cast("long")).alias("k"))
    numbered = per.withColumn("i", F.row_number().over(Window.orderBy(group)) - 1).withColumn("g", F.count("*").over(Window.partitionBy(F.lit(1))))
    size = numbered.select("g").limit(1)
    draws = df.sparkSession.range(resamples).withColumnRenamed("id", "b").crossJoin(size).select("b", "g", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("draw"))
    pick = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "b", "draw"), 256), 1, 8), 16, 10).cast("long"), F.col("g"))
    rates = draws.withColumn("i", pick.cast("int")).join(numbered.select("i", "n", "k"), "i").groupBy("b").agg((F.sum("k") / F.sum("n")).alias("rate"))
    whole = per.agg((F.sum("k") / F.sum("n")).alias("rate_all"))
    return rates.agg(F.count("*").alias("resamples"), F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high")).crossJoin(whole)
