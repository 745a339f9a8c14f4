"""Order-dependent operators: baselines, imputation, crossings, windows, weighted quantiles.

Each is a window over (key, order) or an array fold, so a key's rows meet in one
shuffle; operators over one key in one task are those whose keys are episodes,
turns or users, which the model bounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vivaspark.operators.resampling import weighted_medians


def over(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def baseline_deviation(df: DataFrame, key: str, turn: str, value: str, turns: int = 2) -> DataFrame:
    """(x - b) / b against the mean of the first turns; null in them, 0 where the baseline is about zero."""
    base = F.avg(F.when(F.col(turn) < turns, F.col(value))).over(Window.partitionBy(key))
    deviation = F.when(F.col(turn) >= turns, F.when(F.abs("_b") < 1e-6, 0.0).otherwise(F.try_divide(F.col(value) - F.col("_b"), F.col("_b"))))
    return df.withColumn("_b", base).withColumn("deviation", deviation).withColumnRenamed("_b", "baseline")


def rolling_impute(df: DataFrame, key: str, order: list[str], value: str, n: int = 5) -> DataFrame:
    """W05, whole gaps: a missing value becomes the mean of the last n present ones, 0 without any.

    Present rows are numbered, so their last n are a frame of that numbering; gaps
    take the mean standing after the last present row before them.
    """
    w = over([key], order)
    seen = F.count(value).over(w)
    present = df.withColumn("_k", seen)
    # A gap shares its number with the present row before it, so the range reaches n present rows back.
    last = F.avg(value).over(Window.partitionBy(key).orderBy("_k").rangeBetween(-(n - 1), 0))
    out = present.withColumn("_mean", F.when(F.col("_k") > 0, last).otherwise(0.0))
    return out.withColumn("imputed", F.coalesce(F.col(value), F.col("_mean"), F.lit(0.0))).drop("_k", "_mean")


def impute_fold(df: DataFrame, key: str, order: list[str], values: list[str], n: int = 5) -> DataFrame:
    """W05, per-feature gaps: imputed values enter the history, so each row needs the one before.

    Rows are dealt by key and sorted, and a task walks through them in Arrow
    batches with the last n values of each feature in hand: time is linear in a
    key's rows, which are never gathered. Returns key, turn (1, 2, ...) and one
    imputed column a feature.
    """
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    schema = T.StructType([rows.schema["_key"], T.StructField("_turn", T.IntegerType()), *rows.schema.fields[-len(values) :]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn, past = object(), 0, []
        for b in batches:
            turns, out = [], []
            for who, *x in zip(*(b.column(i).to_pylist() for i in (0, *range(b.num_columns - len(values), b.num_columns)))):
                if who != now:
                    now, turn, past = who, 0, [deque(maxlen=n) for _ in values]
                turn += 1
                full = [(sum(h) / len(h) if h else 0.0) if v is None else v for v, h in zip(x, past)]
                for v, h in zip(full, past):
                    h.append(v)
                turns.append(turn)
                out.append(full)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turns, pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*out))], names=schema.names) if out else pa.RecordBatch.from_pylist([], to_arrow_schema(schema))

    walked = rows.repartition("_key").sortWithinPartitions("_key", *[f"_o{i}" for i in range(len(order))]).mapInArrow(walk, schema)
    return walked.select(F.col("_key").alias(key), F.col("_turn").alias("turn"), *[F.col(f"_v{i}").alias(v) for i, v in enumerate(values)])


def crossings(df: DataFrame, key: str, order: list[str], value: str, level: float, at: Column) -> DataFrame:
    """Spans from a fall below the level to the next rise, with start, end and duration (`at` is a number)."""
    w = over([key], order)
    below = F.col(value) < level
    before = F.lag(below).over(w)
    marks = df.withColumn("_at", at).withColumn("_down", below & F.coalesce(~before, F.lit(True))).withColumn("_up", ~below & before)
    start = F.last(F.when(F.col("_down"), F.col("_at")), ignorenulls=True).over(w)
    return marks.withColumn("started", start).filter("_up").select(key, "started", F.col("_at").alias("ended"), (F.col("_at") - F.col("started")).alias("duration"))


def sliding_rate_cv(df: DataFrame, key: str, order: list[str], at: Column, width: int = 4) -> DataFrame:
    """Rates of all windows of `width` rows in a row, then their population variation coefficient."""
    w = over([key], order).rowsBetween(0, width - 1)
    spans = df.withColumn("_at", at).select(key, F.count("*").over(w).alias("n"), (F.last("_at").over(w) - F.first("_at").over(w)).alias("span"))
    rate = F.try_divide(F.lit(float(width)), F.col("span"))
    return spans.filter((F.col("n") == width) & (F.col("span") > 0)).groupBy(key).agg(F.count("*").alias("windows"), F.try_divide(F.stddev_pop(rate), F.avg(rate)).alias("cv"))


def return_to_go(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Sum of this and all later rewards."""
    return df.withColumn("to_go", F.sum(value).over(over([key], order).rowsBetween(0, Window.unboundedFollowing)))


def trailing_context(df: DataFrame, key: str, order: list[str], value: str, n: int = 12, pad: str = "") -> DataFrame:
    """The last n values up to this row, padded on the left, and which places are padding."""
    got = F.collect_list(value).over(over([key], order).rowsBetween(-(n - 1), 0))
    missing = F.lit(n) - F.size("_got")
    return df.withColumn("_got", got).withColumn("context", F.concat(F.array_repeat(F.lit(pad), missing), F.col("_got"))).withColumn("padding", missing).drop("_got")


def run_length(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows since the value last changed, 0 on a change."""
    w = over([key], order)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    island = F.sum("_changed").over(w)
    out = df.withColumn("_changed", changed).withColumn("_island", island)
    return out.withColumn("run", F.row_number().over(over([key, "_island"], order)) - 1).drop("_changed", "_island")


def step_reward(gain: Column, first: Column, visits: Column, anxious: Column, invalid: Column) -> Column:
    """Reward of one question."""
    return 1.5 * gain + 0.5 * first.cast("double") - 0.1 - 0.05 * F.least(visits, F.lit(3)) - 1.0 * anxious.cast("double") - 0.5 * invalid.cast("double")


def terminal_delta(truth: Column, label: Column, weight: float) -> Column:
    """+ weight if right, half of it lost one class away, all of it two away, a quarter on abstention."""
    gap = F.abs(truth - label)
    return F.when(label.isNull(), -0.25 * weight).when(gap == 0, weight).when(gap == 1, -0.5 * weight).otherwise(-weight)


def weighted_quantiles(df: DataFrame, value: str, weight: str, qs: list[float], keys: list[str] = ()) -> DataFrame:
    """Per q, the smallest value whose cumulative weight reaches q of the total.

    Equal values are summed first, so the ordered window runs over distinct
    values of a key. Without keys that window is one task over the distinct
    values of the whole table: round or bin an unbounded measure first.
    """
    per = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    cum = per.withColumn("_c", F.sum("_w").over(w.orderBy(value))).withColumn("_t", F.sum("_w").over(w))
    reach = [F.min(F.when(F.col("_c") >= q * F.col("_t") * (1 - 1e-12), F.col(value))).alias(f"q{round(q * 100)}") for q in qs]
    return cum.groupBy(*keys).agg(*reach)


def balanced_weights(df: DataFrame, episode: str) -> DataFrame:
    """Each row weighs one over its episode's rows."""
    return df.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(episode)))


def emission_fit(df: DataFrame, label: str, value: str, weight: str, floor: float = 0.03, most: float = 0.35, strength: float = 5.0) -> DataFrame:
    """Per class an isotonic weighted median and a shrunken robust scale, with a Laplace prior.

    The scale is 1.4826 times the weighted median deviation, at least `floor`; its
    square moves to that of the deviations of all classes together, with `strength`
    pseudo rows.
    """
    centre = weighted_quantiles(df, value, weight, [0.5], [label])
    rows = df.join(centre.select(label, F.col("q50").alias("_m")), label).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = weighted_quantiles(rows, "_d", weight, [0.5], [label]).select(label, F.greatest(1.4826 * F.col("q50"), F.lit(floor)).alias("raw"))
    mass = df.groupBy(label).agg(F.sum(weight).alias("mass"))
    per = centre.join(mad, label).join(mass, label)
    one = Window.partitionBy(F.lit(1))  # over the classes, a handful
    everyone = weighted_medians(rows.select(F.lit(0).alias("_all"), "_d", F.array(F.col(weight).cast("double")).alias("_ws")), ["_all"], "_d", "_ws")
    pooled = everyone.select(F.greatest(1.4826 * F.col("median"), F.lit(floor)).alias("pooled"))  # one row
    scale = F.sqrt((F.col("mass") * F.col("raw") ** 2 + strength * F.col("pooled") ** 2) / (F.col("mass") + strength))
    out = per.crossJoin(F.broadcast(pooled)).withColumn("centre", F.max("q50").over(one.orderBy(label)))
    prior = (F.col("mass") + 1) / (F.sum("mass").over(one) + F.count("*").over(one))
    return out.select(label, "centre", F.least(F.greatest(scale, F.lit(floor)), F.lit(most)).alias("scale"), prior.alias("prior"))


def turn_mode(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Commonest label of each key, the first seen on ties."""
    per = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("frames"))


def pauses(df: DataFrame, key: str, order: list[str], at: Column, least: float) -> DataFrame:
    """Gaps to the previous row over a limit: how many and how long together."""
    gap = F.col("_at") - F.lag("_at").over(over([key], order))
    gaps = df.withColumn("_at", at).withColumn("_gap", gap)
    return gaps.groupBy(key).agg(F.count_if(F.col("_gap") > least).alias("pauses"), F.coalesce(F.sum(F.when(F.col("_gap") > least, F.col("_gap"))), F.lit(0)).alias("paused"))


def velocity(df: DataFrame, key: str, order: list[str], value: str, fps: float) -> DataFrame:
    """Mean and largest speed and population variance of a frame series."""
    speed = (F.col(value) - F.lag(value).over(over([key], order))) * fps
    return df.withColumn("_v", speed).groupBy(key).agg(F.avg(F.abs("_v")).alias("mean_speed"), F.max(F.abs("_v")).alias("peak_speed"), F.var_pop(value).alias("variance"))
