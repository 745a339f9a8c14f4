"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and MOST that give each source its target
number of words, take the one closest in relative entropy to "every document
once". Its dual is convex and splits by source: rates are exp(l * size / mean),
cut at MOST, with one multiplier l a source. Newton's method finds the
multipliers; each iteration is one distributed aggregation over the counts of
(source, size), and a bracket keeps steps that overshoot inside.

Rates become copies by their own hash draws: copy k of a document enters at the
level (k - 1 + u) / rate. At level 1 a source takes its target on average; the
exact level at which its words reach the target is found by digits, six
aggregations of 256 counts a source. The one document at that level gives the
words still missing, as a cut copy. Sums are integers, so reruns agree.

Only per-source rows (sums, digit counts, parameters) reach the driver, some
hundred bytes a source: sources are feeds or sites, not documents. Parameters
are broadcast while there are at most MANY sources, and joined over salted keys
beyond that, since one source may hold a third of all rows. Rows themselves stay
where they are.

Defined results: null or blank text has size 0 and takes nothing; null source
is a source of its own, the last; repeated rows get equal results; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vivaspark.llm.common import WORD_RE, cut, table

MOST = 3
WEIGHTS = (5, 2, 1)
MANY = 200_000
SALTS = 64
_BITS = 48


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Target words of each source: shares by cycled weights, at most `most` times its size, the rest shared on."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weigh[s] for s in open_)
        full = [s for s in names if s in open_ and weigh[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: weigh[s] * unit for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            open_.discard(s)
            left -= out[s]
    return out


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _with(rows: DataFrame, params: list[tuple], schema: str) -> DataFrame:
    """rows with each source's parameters."""
    spark = rows.sparkSession
    small = spark.createDataFrame(params, schema)
    if len(params) <= MANY:
        return rows.join(F.broadcast(small), "s")
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "s"]), F.lit(SALTS)).cast("int")).join(small, ["s", "salt"]).drop("salt")


def _rate(size: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-600.0), F.col("l") * size / F.col("mean")))))


def _multipliers(counts: DataFrame, stats: dict[str, tuple[int, int, float]], rounds: int = 60) -> dict[str, float]:
    """Multiplier of each source; stats: source -> (words, documents with words, target)."""
    low, high, at, done = {}, {}, {}, {}
    for s, (words, _, t) in stats.items():
        if t >= MOST * words or t <= 0:
            done[s] = 1e6 if t > 0 else -1e6
        else:
            low[s], high[s], at[s] = -1e6, 1e6, math.log(max(t / words, 1e-9))
    for _ in range(rounds):
        if not at:
            break
        rows = _with(counts, [(s, x, stats[s][0] / stats[s][1]) for s, x in at.items()], "s string, l double, mean double")
        rate = _rate(F.col("size"))
        # Thousandths of words as integers: the sum doesn't depend on its order.
        exact = lambda c: F.sum(F.round(c * 1000).cast("decimal(30,0)"))
        words = F.col("n") * F.col("size")
        slope = F.when(rate < MOST, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)
        for r in rows.groupBy("s").agg(exact(words * rate).alias("f"), exact(slope).alias("g")).collect():
            s, f, g, t = r.s, float(r.f) / 1000, float(r.g) / 1000, stats[r.s][2]
            if abs(f - t) <= 1e-5 * t or high[s] - low[s] < 1e-9:
                done[s] = at.pop(s)
                continue
            low[s], high[s] = (at[s], high[s]) if f < t else (low[s], at[s])
            step = at[s] + (t - f) / g if g > 0 else math.inf
            inside = low[s] < step < high[s]
            wide = [v for v in (low[s], high[s]) if abs(v) < 1e6]
            # Outside the bracket: its middle, or twice as far while one side is still open.
            at[s] = round(step if inside else sum(wide) / 2 if len(wide) == 2 else 2 * wide[0] + math.copysign(1.0, t - f), 9)
    return done | at


def _levels(k: int) -> Column:
    """Level at which copy k + 1 enters, as an integer of _BITS bits that keeps the order."""
    level = F.log2((F.lit(float(k)) + F.col("u")) / F.greatest(_rate(F.col("size")), F.lit(1e-290)))
    return F.floor((F.greatest(F.lit(-1023.0), F.least(F.lit(1023.0), level)) + 1024.0) * float(1 << (_BITS - 11))).cast("long")


def _borders(entries: DataFrame, goal: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Per source: the level where its words reach the goal, the words missing below it, the entries at it."""
    found = {s: (0, left) for s, left in goal.items()}
    ties = {}
    for shift in range(_BITS - 8, -1, -8):
        rows = _with(entries, [(s, p) for s, (p, _) in found.items()], "s string, p long")
        rows = rows.filter(F.shiftright("level", shift + 8) == F.col("p"))
        steps: dict[str, list] = {s: [] for s in found}
        for r in rows.groupBy("s", F.shiftright("level", shift).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect():
            steps[r.s].append((r.digit, r.words, r.n))
        for s, (p, left) in found.items():
            here = None
            for digit, words, n in sorted(steps[s]):
                here = (digit, left, n)
                if left <= words:
                    break
                left -= words
            found[s] = (here[0], here[1]) if here else (p << 8, left)
            ties[s] = here[2] if here else 0
    return {s: (p, left, ties[s]) for s, (p, left) in found.items()}


def _measured(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """The kept columns, and each row's source name s, size and draw u in (0, 1] from its id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    draw = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(1 << 40)) + 1) / float(1 << 40)
    return docs.select(*kept, _named(F.col("source")).alias("s"), size.alias("size"), draw.alias("u"))


PARAMS = "s string, l double, mean double, source_size long, target double, border long, left long, ties long"


def _plan(rows: DataFrame, weights: tuple) -> list[tuple]:
    """The parameters of each source, as PARAMS, from rows of source, s, size and u."""
    sums = rows.groupBy("s").agg(F.min("source").alias("source"), F.sum("size").alias("words"), F.sum((F.col("size") > 0).cast("long")).alias("full")).collect()
    goal = targets({r.source: r.words for r in sums}, weights)
    stats = {r.s: (r.words, r.full, goal[r.source]) for r in sums if r.words}
    counts = cut(rows.filter("size > 0").groupBy("s", "size").agg(F.count("*").alias("n")))
    l = _multipliers(counts, stats)
    tilt = [(s, l[s], words / full) for s, (words, full, _) in stats.items()]
    tilted = _with(rows.filter("size > 0").select("s", "size", "u"), tilt, "s string, l double, mean double")
    entries = cut(tilted.select("s", "size", F.explode(F.array(*[_levels(k) for k in range(MOST)])).alias("level")))
    borders = _borders(entries, {s: round(t) for s, (_, _, t) in stats.items()})
    return [(r.s, l.get(r.s, 0.0), r.words / r.full if r.full else 1.0, r.words, goal[r.source], *borders.get(r.s, (0, 0, 0))) for r in sums]


def _taken(rows: DataFrame, params: list[tuple]) -> DataFrame:
    """rows with their source's parameters, copies (whole ones) and taken (words): a row's own values decide."""
    below = sum(((_levels(k) < F.col("border")).cast("long") for k in range(MOST)), F.lit(0))
    at = sum(((_levels(k) == F.col("border")).cast("long") for k in range(MOST)), F.lit(0))
    share = F.least(F.col("size"), F.floor(F.col("left") / F.greatest(F.col("ties"), F.lit(1))))
    taken = F.when(F.col("size") > 0, below * F.col("size") + at * share).otherwise(0)
    return _with(rows, params, PARAMS).withColumns({"copies": F.when(F.col("size") > 0, below).otherwise(0).cast("long"), "taken": taken.cast("long")})


def mix(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole ones) and taken (words) of every row."""
    rows = cut(_measured(docs, [F.col("doc_id"), F.col("source")]))
    return _taken(rows, _plan(rows, weights)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def take_copies(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """docs with each row as often as the mix takes it whole (a cut copy of half its words or more counts). No row is shuffled."""
    params = _plan(cut(_measured(docs, [F.col("source")])), weights)
    rows = _taken(_measured(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")]), params)
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    return rows.filter((F.col("size") > 0) & (times > 0)).select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_k")).select("_row.*")
