"""Row contracts, projections, planners and small functions of the interview records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivaspark.operators.relational import join_by_key


def violations(checks: list[tuple[Column, str]]) -> Column:
    """Codes of the checks that fail; a check that can't be decided fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in checks]), lambda c: c.isNotNull())


def row_contract(versions: dict[str, str], required: list[str], vectors: dict[str, int]) -> Column:
    """Required fields are there, schema versions match, vectors have their length and finite entries."""
    checks = [(F.col(c).isNotNull(), f"missing_{c}") for c in required]
    checks += [(F.col(c).eqNullSafe(F.lit(v)), f"version_{c}") for c, v in versions.items()]
    checks += [((F.size(c) == n) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), f"vector_{c}") for c, n in vectors.items()]
    return violations(checks)


def generation_provenance(mode: Column, model_attempts: Column, fallback_attempts: Column, template: Column, prompt_hash: Column) -> Column:
    """Made by a model, with a prompt and no template, or by a template, never both."""
    model = (mode == "llm") & (model_attempts >= 1) & (F.coalesce(fallback_attempts, F.lit(0)) == 0) & template.isNull() & prompt_hash.isNotNull()
    fallback = (mode == "deterministic_fallback") & (fallback_attempts >= 1) & template.isNotNull()
    return F.coalesce(model | fallback, F.lit(False))


def grounding_valid(hashes: list[Column], pairing: Column, ratio: Column) -> Column:
    """All digests are SHA-256 and the pairing record is in range."""
    ok = pairing.isin("domain_matched", "overlap", "disjoint") & ratio.between(0, 1)
    for h in hashes:
        ok = ok & h.rlike("^[0-9a-f]{64}$")
    return F.coalesce(ok, F.lit(False))


def policy_state(parts: list[Column]) -> Column:
    """Features cut to [0, 1] as single-precision numbers; missing and non-finite ones are 0."""
    cut = [F.coalesce(F.when(~F.isnan(p), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))), F.lit(0.0)).cast("float") for p in parts]
    return F.array(*cut)


def generation_seed(base: Column, episode: Column, turn: Column, attempt: Column) -> Column:
    """a seed below 2^31 - 1 from its parts, also T12's derived seed of a retry."""
    return F.pmod(base + episode * 1_000_003 + turn * 10_007 + attempt * 100_000_007, F.lit(2_147_483_647))


def retry_seed(seed: Column, attempt: Column) -> Column:
    return seed + attempt * 100_000_007


def pairing_record(resume: Column, job: Column) -> Column:
    """Overlap of two skill sets: count, ratio of the job's skills, class."""
    n = F.size(F.array_intersect(resume, job))
    ratio = n / F.greatest(F.size(F.array_distinct(job)), F.lit(1))
    kind = F.when(ratio >= 0.5, "domain_matched").when(n > 0, "overlap").otherwise("disjoint")
    return F.struct(n.alias("overlap"), ratio.alias("ratio"), kind.alias("pairing_class"))


#: Rows of either side in a block; right rows that a left row meets in a run; pairs a partition, about.
BLOCK, RUN, PAIRS = 1 << 13, 1 << 9, 1 << 26


def _dealt(rows: DataFrame, sizes: DataFrame, pool: str, n: str, total: int, name: str) -> DataFrame:
    """rows as (pool, name): a pool's rows in arrays of at most BLOCK, dealt by hash and then counted off, so that no pool is gathered."""
    rest = [c for c in rows.columns if c != pool]
    parts = sizes.select(pool, n, F.ceil(F.col(n) / BLOCK).alias("_parts"))
    own = join_by_key(rows, parts, [pool], n, total).withColumn("_part", F.pmod(F.xxhash64(pool, *rest), "_parts"))
    place = F.row_number().over(Window.partitionBy(pool, "_part").orderBy(*(rest or [pool])))
    blocks = own.withColumn("_block", F.floor((place - 1) / BLOCK)).groupBy(pool, "_part", "_block")
    return blocks.agg(F.collect_list(F.struct(*rest) if rest else F.struct(F.lit(0))).alias(name)).select(pool, name)


def paired_pools(left: DataFrame, right: DataFrame, pool: str) -> DataFrame:
    """All pairs within a pool, of any size, by an equi join of blocks.

    The pairs are as many as they are, but only blocks are shuffled, and the pairs
    of two blocks are made where they are wanted, one after the other. Each left
    row meets a short run of right rows before the next does, so a columnar file
    holds the runs, which repeat, in little space.
    """
    sizes = left.groupBy(pool).agg(F.count("*").alias("_nl")).join(right.groupBy(pool).agg(F.count("*").alias("_nr")), pool)
    nl, nr, pairs = sizes.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("_nl"), F.col("_nr"), F.col("_nl").cast("double") * F.col("_nr"))]).first()
    blocks = _dealt(left, sizes, pool, "_nl", nl, "_l").join(_dealt(right, sizes, pool, "_nr", nr, "_r"), pool)
    tasks = int(pairs / PAIRS) + int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_r") - 1) / RUN)), lambda i: F.slice("_r", (i * RUN + 1).cast("int"), RUN))
    # Generated code holds all rows of one input row: only a run is left to it, transform() keeps the step before out.
    met = blocks.repartition(tasks).select(pool, "_l", F.explode(runs).alias("_run")).select(pool, "_run", F.explode(F.transform("_l", lambda x: x)).alias("_a"))
    each = met.select(pool, "_a", F.explode("_run").alias("_b"))
    return each.select(pool, *[F.col("_a")[c].alias(c) for c in left.columns if c != pool], *[F.col("_b")[c].alias(c) for c in right.columns if c != pool])


def flattened(df: DataFrame, key: str, reports: str) -> DataFrame:
    """One row a (condition, policy) from a map of policies to values; a condition met twice is marked."""
    out = df.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return out.select(key, F.explode(reports).alias("policy", "value"), (F.col("_n") > 1).alias("duplicate"))


def normalised(dist: Column) -> Column:
    """a map of weights cut at 0 and scaled to sum 1; null if they are all about 0."""
    clipped = F.transform_values(dist, lambda _, v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(F.map_values(clipped), F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 1e-8, F.transform_values(clipped, lambda _, v: v / total))


def expectile(difference: Column, tau: float = 0.8) -> Column:
    """F45."""
    return F.when(difference > 0, tau).otherwise(1 - tau) * difference * difference


def hertz(semitones: Column, base: float = 27.5) -> Column:
    """semitones above the base as a frequency."""
    return base * F.pow(F.lit(2.0), semitones / 12)


def speech(words: Column) -> Column:
    """Word count, span in ms, rate, fillers of an array of (word, start, end); zeros without words."""
    n = F.size(words)
    span = F.get(words, n - 1).end - F.get(words, F.lit(0)).start
    fillers = F.size(F.filter(words, lambda w: F.lower(w.word).isin("um", "uh", "erm", "hmm")))
    return F.when(n > 0, F.struct(n.alias("words"), (F.greatest(span, F.lit(0.0)) * 1000).alias("span_ms"), F.coalesce(F.try_divide(n.cast("double"), span), F.lit(0.0)).alias("rate"), fillers.alias("fillers"))).otherwise(F.struct(F.lit(0).alias("words"), F.lit(0.0).alias("span_ms"), F.lit(0.0).alias("rate"), F.lit(0).alias("fillers")))


def response_latency(words: Column, asked: Column) -> Column:
    """Ms from the question's end to the first word, null without words."""
    return F.greatest(F.get(words, F.lit(0)).start - asked, F.lit(0.0)) * 1000


def parsed_evaluation(text: Column) -> Column:
    """score and reason from a model's JSON, fenced or not; out of range or unreadable is flagged, score 0.5."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "score double, reason string")
    ok = F.coalesce(got.score.between(0, 1), F.lit(False))
    return F.struct(F.when(ok, got.score).otherwise(0.5).alias("score"), got.reason.alias("reason"), ok.alias("valid"))


def still_live(at: Column, now: Column, ttl_seconds: int) -> Column:
    """whether something renewed at a time is within its life at `now`; `now` is given, so runs repeat."""
    return F.unix_micros(now) - F.unix_micros(at) <= ttl_seconds * 1_000_000


def behaviour(action: Column, weights: dict[str, float], legal: list[str]) -> Column:
    """Probability of an action under weights restricted to legal ones."""
    total = sum(weights[a] for a in legal)
    m = F.create_map(*[F.lit(x) for a in legal for x in (a, weights[a] / total)])
    return F.coalesce(F.try_element_at(m, action), F.lit(0.0))


def draw(probabilities: Column, roll: Column) -> Column:
    """The first place whose cumulated probability exceeds the roll; the last one if none does."""
    cum = F.aggregate(probabilities, F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("hit"), F.lit(0).alias("i")), lambda a, p: F.struct((a.s + p).alias("s"), F.when((a.hit < 0) & (roll < a.s + p), a.i).otherwise(a.hit).alias("hit"), (a.i + 1).alias("i")))
    return F.when(cum.hit >= 0, cum.hit).otherwise(F.size(probabilities) - 1)


def interleaved(df: DataFrame, persona: str, order: str) -> DataFrame:
    """Round robin over personas: everyone's first, then everyone's second ... For planner-sized tables."""
    k = F.row_number().over(Window.partitionBy(persona).orderBy(order))
    return df.withColumn("_k", k).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_k", persona)))


def balanced_folds(sizes: list[tuple], n: int = 3) -> dict:
    """Components to folds, largest first, each to the fold with fewest episodes; ties by class balance, then number."""
    load, classes, out = [0] * n, [{} for _ in range(n)], {}
    for c, count, by_class in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = min(range(n), key=lambda f: (load[f], sum(classes[f].get(k, 0) * v for k, v in by_class.items()), f))
        out[c] = best
        load[best] += count
        for k, v in by_class.items():
            classes[best][k] = classes[best].get(k, 0) + v
    return out


def purge(parents: DataFrame, children: list[tuple[DataFrame, str]], key: str, dead: Column) -> tuple[DataFrame, list[DataFrame]]:
    """Tables without the dead parents and their children; rewritten, since files are not updated in place."""
    gone = parents.filter(dead).select(key)
    return parents.join(gone, key, "left_anti"), [c.join(gone.withColumnRenamed(key, k), k, "left_anti") for c, k in children]
