"""How answers are delivered: speech and silence, syllables, fillers, faces over time, scripting, coaching.

Series are windows over one turn's rows; everything else aggregates before the
shuffle. Words of a turn are an array, as the recogniser gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivaspark.functions import text as X

#: Filler words, the cap of the ratio (and the silence in seconds from which it holds).
FILLERS = ("um", "uh", "erm", "hmm", "ah")
MOST_RATIO, LEAST_SILENCE = 1e6, 1e-4
#: Fixed values, F56: similarity that is suspicious, and very high; shift of complexity; turns and words that are needed; degrees of a turned head.
SIMILAR, VERY_SIMILAR, SHIFT, LEAST_HISTORY, LEAST_WORDS, TURNED = 0.65, 0.80, 1.8, 2, 5, 25.0


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start and end of the stretches that overlapping or touching intervals cover.

    An interval opens a stretch where it starts above the largest end before it,
    so nested ones are seen too. Intervals that are null or end before they start
    are left out.
    """
    rows = df.filter(F.col(end) >= F.col(start)).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.coalesce(F.col("start") > upto, F.lit(True)).cast("int"))
    numbered = opened.withColumn("_stretch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_stretch")


def speech_and_pauses(df: DataFrame, keys: list[str], start: str, end: str, total: str, least_pause: float = 0.25) -> DataFrame:
    """Seconds of speech, its ratio to silence within `total` seconds, pauses over the limit and their sum in ms.

    Speech that two intervals share counts once. The ratio is MOST_RATIO where
    there is hardly any silence, 0 without speech; total is the largest of a key.
    """
    length = df.groupBy(*keys).agg(F.max(total).alias("_total"))
    stretches = merged(df, keys, start, end)
    gap = F.col("start") - F.lag("end").over(Window.partitionBy(*keys).orderBy("start"))
    gaps = stretches.withColumn("_gap", gap)
    long = F.when(F.col("_gap") > least_pause, F.col("_gap"))
    per = gaps.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("speech"), F.count(long).alias("pauses"), (F.coalesce(F.sum(long), F.lit(0.0)) * 1000).alias("paused_ms"))
    both = length.join(per, keys, "left").na.fill(0, ["speech", "pauses", "paused_ms"])
    silence = F.greatest(F.col("_total") - F.col("speech"), F.lit(0.0))
    ratio = F.when(F.col("speech") == 0, 0.0).when(silence < LEAST_SILENCE, MOST_RATIO).otherwise(F.try_divide("speech", silence))
    return both.select(*keys, "speech", ratio.alias("ratio"), "pauses", "paused_ms")


def syllables(word: Column) -> Column:
    """F21, as spoken: vowel groups of the letters a to z, a final e not counted, at least one; 0 without a letter."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    n = F.regexp_count(letters, F.lit("[aeiouy]+"))
    return F.when(letters == "", 0).otherwise(F.greatest(n - F.when(letters.endswith("e") & (n > 1), 1).otherwise(0), F.lit(1)))


def written_syllables(word: Column) -> Column:
    """F21, as written: the same, and one more for an ending of a consonant and le."""
    n = F.regexp_count(word, F.lit("[aeiouy]+"))
    n = n - F.when(word.endswith("e") & (n > 1), 1).otherwise(0) + F.when(word.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.greatest(n, F.lit(1))


def speech_rate(words: Column) -> Column:
    """Syllables a second from the first word's start to the last one's end; 0 without words or time."""
    span = F.get(words, F.size(words) - 1).end - F.get(words, F.lit(0)).start
    total = F.aggregate(words, F.lit(0), lambda a, w: a + syllables(w.word))
    return F.coalesce(F.when(span > 0, F.try_divide(total.cast("double"), span)), F.lit(0.0))


def filler_times(words: Column) -> Column:
    """When each filler was said, in the order of the words."""
    said = F.filter(words, lambda w: F.regexp_replace(F.lower(w.word), "[^a-z]", "").isin(*FILLERS))
    return F.coalesce(F.transform(said, lambda w: w.start.cast("double")), F.array().cast("array<double>"))


def complexity(text: Column) -> Column:
    """mean written syllables of the words of letters a to z, 0 without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + written_syllables(w))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(words)), F.lit(0.0))


def scripting(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, order, similarity to the closest earlier turn, shift of complexity against their mean, and confidence.

    Turns with fewer than LEAST_HISTORY earlier ones, or of fewer than LEAST_WORDS
    words, get 0. The shift is 1 where earlier turns have no words.
    """
    similar = X.history_cosine(df, key, order, text)
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(key, order, (F.size(F.filter(F.split(said, r"\s+"), lambda w: w != ""))).alias("_words"), complexity(F.coalesce(F.col(text), F.lit(""))).alias("_now"), (said != "").alias("_said"))
    rows = rows.withColumns({"_before": F.avg(F.when(F.col("_said"), F.col("_now"))).over(past), "_n": F.count("*").over(past)})
    both = rows.join(similar, [key, order], "left").na.fill(0.0, ["similarity"])
    judged = (F.col("_n") >= LEAST_HISTORY) & (F.col("_words") >= LEAST_WORDS)
    shift = F.when(F.col("_before") > 0.01, F.col("_now") / F.col("_before")).otherwise(1.0)
    s, moved = F.col("similarity"), (F.col("shift") >= SHIFT) | ((F.col("shift") > 0) & (F.col("shift") <= 1 / SHIFT))
    severity = F.least((s - SIMILAR) / (VERY_SIMILAR - SIMILAR + 1e-6), F.lit(1.0))
    sure = F.when((s >= SIMILAR) & moved, 0.55 + 0.35 * severity).when(s >= SIMILAR, 0.30 + 0.25 * severity).when(moved, 0.15).otherwise(0.0)
    out = both.select(key, order, F.when(judged, s).otherwise(0.0).alias("similarity"), F.when(judged, shift).otherwise(0.0).alias("shift"), judged.alias("_judged"))
    return out.select(key, order, "similarity", "shift", F.when(F.col("_judged"), sure).otherwise(0.0).alias("confidence"))


def turned_head(most: Column, frames: Column | None = None) -> Column:
    """confidence of coaching from the largest yaw and, where frames were seen, how many were turned (two at least)."""
    enough = most >= TURNED if frames is None else frames >= 2
    severity = F.least((most - TURNED) / TURNED, F.lit(1.0))
    return F.when(enough, F.least(F.greatest(0.3 + 0.4 * severity, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def coaching(df: DataFrame, keys: list[str], yaw: Column) -> DataFrame:
    """keys, the largest yaw of a turn's frames, how many were turned, and confidence."""
    per = df.groupBy(*keys).agg(F.coalesce(F.max(F.abs(yaw)), F.lit(0.0)).alias("most_yaw"), F.count_if(F.abs(yaw) >= TURNED).alias("turned"))
    return per.withColumn("confidence", turned_head(F.col("most_yaw"), F.col("turned")))


def faces(df: DataFrame, keys: list[str], order: list[str], units: str, n: int = 15, brow: int = 2, pull: int = 7, press: int = 10, fps: float = 30.0) -> DataFrame:
    """Speed, variance and peak of n activations over a turn's frames, and a five-way label with its confidence.

    brow, pull and press are the places of the lowered brow, the pulled lip
    corners and the pressed lips. A turn of one frame is blank, with confidence 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    moves = df.select(*keys, F.col(units).alias("_u"), F.lag(units).over(w).alias("_p"))
    speeds = moves.withColumn("_v", F.zip_with("_u", "_p", lambda a, b: F.abs(a - b) * fps))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    per = speeds.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg(total / n).alias("speed"), F.max(F.array_max("_v")).alias("peak"), *[F.var_pop(F.get("_u", F.lit(i))).alias(f"_x{i}") for i in range(n)])
    variance = sum((F.col(f"_x{i}") for i in range(n)), F.lit(0.0)) / n
    b, p, s, v, m, k = F.col(f"_x{brow}"), F.col(f"_x{pull}"), F.col(f"_x{press}"), F.col("variance"), F.col("speed"), F.col("peak")
    tense, flat = (b > 0.05) | (s > 0.05), (v < 0.001) & (k < 0.5)
    share = lambda x: F.least(x, F.lit(1.0))
    label = F.when(flat, "blank").when(tense & (p > 0.03), "confused").when(tense, "nervous").when((p > 0.04) & (b < 0.01), "confident").when(m > 2, "engaged").otherwise("blank")
    sure = F.when(flat, 0.5 + 0.4 * (1 - share(v / 0.001))).when(tense & (p > 0.03), 0.5 + 0.35 * share((b + p) / 0.12)).when(tense, 0.5 + 0.35 * share((b + s) / 0.15))
    sure = sure.when((p > 0.04) & (b < 0.01), 0.55 + 0.3 * share(p / 0.1)).when(m > 2, 0.5 + 0.3 * share((m - 2) / 8)).otherwise(0.4)
    one = F.col("frames") < 2
    zero = lambda c: F.when(one, 0.0).otherwise(c)
    out = per.withColumn("variance", variance)
    return out.select(*keys, "frames", *[zero(F.col(c)).alias(c) for c in ("speed", "variance", "peak")], F.when(one, "blank").otherwise(label).alias("label"), zero(sure).alias("confidence"))
