"""Replay, cross-validation, gates and reports around the belief model."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vivaspark.operators import audit, metrics, sequence
from vivaspark.operators import belief as B
from vivaspark.operators.rollout import Episodes


def replay_evidence(valid: Column, score: Column, stop: Column) -> Column:
    """A question whose evaluation is valid for sure and has a score."""
    return ~F.coalesce(stop, F.lit(False)) & valid.eqNullSafe(F.lit(True)) & score.isNotNull()


def owned(owner: Column, me: str, deleted: Column) -> Column:
    """P10: rows of one owner that are not deleted."""
    return owner.eqNullSafe(F.lit(me)) & deleted.isNull()


def replay(df: DataFrame, episode: str, order: str, skill: str, score: str, done: str, c: B.BeliefConfig = B.BeliefConfig()) -> DataFrame:
    """Each turn's certainty before and after, its gain, reward and legality of ending.

    Rows after an episode's first done are dropped before its turns are gathered,
    so what is gathered is an episode; the last row left is done. The episodes of
    an Arrow batch then advance together, a turn at a time.
    """
    first = df.filter(F.col(done)).groupBy(F.col(episode).alias("_e")).agg(F.min(order).alias("_end"))
    own = df.select(episode, order, skill, score, done).join(first, F.col(episode).eqNullSafe(F.col("_e")), "left").filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    turns = F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(skill).alias("skill"), F.col(score).cast("double").alias("score"), F.coalesce(done, F.lit(False)).alias("done"))))
    whole = own.groupBy(F.col(episode).alias("episode")).agg(turns.alias("turns"))
    whole = whole.select("episode", F.col("turns.at").alias("at"), F.col("turns.skill").alias("skill"), F.col("turns.score").alias("score"), F.col("turns.done").alias("done"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            names = sorted({s for row in f["skill"] for s in row}, key=str)
            place = {s: k for k, s in enumerate(names)}
            length = f["at"].map(len).to_numpy()
            e, out = Episodes(len(f), [str(s) for s in names], c), []
            for turn in range(int(length.max())):
                who = np.flatnonzero(length > turn)
                column = lambda name: [f[name].iat[i][turn] for i in who]  # noqa: B023, E731
                k = np.array([place[s] for s in column("skill")])
                x = np.array(column("score"), float)
                before, visits, ess, known = certainty(e)[who], e.n[who, k], e.ess[who, k], np.isfinite(x)
                gain = np.zeros(len(who))
                gain[known] = e.observe(who[known], k[known], x[known], 1.0)
                reward = 1.5 * gain + 0.5 * (visits == 0) - 0.1 - 0.05 * np.minimum(visits, 3)
                may = (turn >= 10) & (e.covered()[who] >= min(5, c.least_coverage + 2))
                end = np.array(column("done"), bool) | (length[who] == turn + 1)
                out.append(pd.DataFrame({"episode": f["episode"].to_numpy()[who], "turn": column("at"), "skill": column("skill"), "entropy_before": before, "entropy_after": certainty(e)[who], "evidence": e.ess[who, k] - ess, "gain": gain, "reward": reward, "may_conclude": may, "done": end}))
            yield pd.concat(out, ignore_index=True)

    kind = df.schema[episode].dataType.simpleString()
    return whole.mapInPandas(run, f"episode {kind}, turn long, skill string, entropy_before double, entropy_after double, evidence double, gain double, reward double, may_conclude boolean, done boolean")


def certainty(e: Episodes) -> np.ndarray:
    """Entropy of each episode's pooled distribution."""
    p = e.pool()
    return -(p * np.log(p + 1e-12)).sum(1)


def shrink_scales(c: B.BeliefConfig, alpha: float) -> B.BeliefConfig:
    """Scales moved towards their pooled value."""
    pooled = math.sqrt(sum(s * s for s in c.scales) / len(c.scales))
    return replace(c, scales=tuple((1 - alpha) * s + alpha * pooled for s in c.scales))


def evaluate(df: DataFrame, episode: str, skill: str, order: list[str], truth: DataFrame, c: B.BeliefConfig) -> DataFrame:
    """Predictions of one configuration: episode, y, p."""
    said = B.assessment(B.skill_beliefs(df, episode, skill, order, c), episode, c)
    return truth.join(said.select(episode, F.col("label").alias("p"), "confidence"), episode, "left")


def rank_candidates(scores: DataFrame) -> DataFrame:
    """Best macro-F1, then smaller ordinal error, then larger coverage, then name."""
    return scores.agg(F.min_by(F.struct(*scores.columns), F.struct(-F.col("macro_f1"), F.col("ordinal_mae"), -F.col("coverage"), F.col("candidate"))).alias("b")).select("b.*")


def search(df: DataFrame, episode: str, skill: str, order: list[str], truth: DataFrame, stages: list[list[B.BeliefConfig]], least_f1: float) -> DataFrame:
    """Stages of candidates in order; the first with an eligible one ends the search. A job a stage.

    Candidates are fixed and scored on all rows: nothing is fitted and no fold is held out.
    """
    best = None
    for k, stage in enumerate(stages):
        rows = None
        for i, c in enumerate(stage):
            m = metrics.classification(evaluate(df, episode, skill, order, truth, c), "y", "p").withColumn("candidate", F.lit(f"{k}-{i}"))
            rows = m if rows is None else rows.union(m)
        best = rank_candidates(rows)
        if (best.first().macro_f1 or 0.0) >= least_f1:
            break
    return best


def cross_validate(df: DataFrame, episode: str, skill: str, order: list[str], score: str, truth: DataFrame, fold: Column, folds: int = 3, base: B.BeliefConfig = B.BeliefConfig()) -> DataFrame:
    """Episode, y, p, confidence and fold: each episode predicted by a model fitted without its fold.

    `truth` has a row an episode, with y; `fold` is an expression over it, so
    episodes stay whole. A fit is three rows, one a class; they reach the driver
    as the next configuration.
    """
    dealt = truth.withColumn("_fold", fold)
    out = None
    for k in range(folds):
        seen = df.join(dealt.filter(F.col("_fold") != k).select(episode, "y"), episode)
        fit = sequence.emission_fit(sequence.balanced_weights(seen, episode), "y", score, "weight").orderBy("y").collect()
        if len(fit) != 3:
            raise ValueError(f"the folds other than {k} lack a class")
        mass = sum(r.prior for r in fit)
        c = replace(base, centres=tuple(r.centre for r in fit), scales=tuple(r.scale for r in fit), prior=tuple(r.prior / mass for r in fit))
        held = dealt.filter(F.col("_fold") == k)
        said = evaluate(df.join(held.select(episode), episode, "left_semi"), episode, skill, order, held.select(episode, "y"), c).withColumn("fold", F.lit(k))
        out = said if out is None else out.unionByName(said)
    return out


def validated(new: DataFrame, base: DataFrame, slack: float = 0.02) -> bool:
    """The new macro-F1 is not below the base by more than the slack."""
    return new.first().macro_f1 >= base.first().macro_f1 - slack


def report(df: DataFrame, truth: str, prediction: str, scope: str) -> DataFrame:
    """One row of metrics a scope value."""
    rows = df.withColumn("_scope", F.coalesce(F.col(scope).cast("string"), F.lit("None")))
    m = metrics.classification(rows, truth, prediction, ("_scope",))
    return m.select(*m.columns[1:], F.col("_scope").alias("scope"))


def split_summary(df: DataFrame, split: str, truth: str, prediction: str) -> DataFrame:
    """Hits and abstentions a split; the test split's stay locked (null)."""
    hits, none = F.count_if(F.col(truth) == F.col(prediction)), F.count_if(F.col(prediction).isNull())
    out = df.groupBy(split).agg(F.count("*").alias("rows"), hits.alias("hits"), none.alias("abstained"))
    locked = F.col(split) == "test"
    return out.withColumns({c: F.when(~locked, F.col(c)) for c in ("hits", "abstained")})


def macro(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the labels met; zero where undefined."""
    pairs = df.groupBy(truth, prediction).agg(F.count("*").alias("n"))
    hit = pairs.groupBy(F.col(truth).alias("c")).agg(F.sum(F.when(F.col(truth) == F.col(prediction), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("t"))
    said = pairs.groupBy(F.col(prediction).alias("c")).agg(F.sum("n").alias("g"))
    per = hit.join(said, "c", "full").na.fill(0)
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = div(F.col("hit"), F.col("g")), div(F.col("hit"), F.col("t"))
    return per.agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(div(2 * p * r, p + r)).alias("f1"))


def raw_evidence(df: DataFrame, episode: str, component: str, split: str, question: str, score: str, least_episodes: int, least_components: int) -> DataFrame:
    """Counters of a corpus and its warnings, in one row."""
    counts = df.agg(F.count("*").alias("rows"), F.count_distinct(episode).alias("episodes"), F.count_distinct(component).alias("components"), F.count_if(F.col(score).isNull()).alias("without_score"), F.count_if(~F.col(score).between(0, 1)).alias("out_of_range"))
    leaky = audit.leaks(df.select(component, split, episode), component, split, component).agg(F.count("*").alias("leaking"))
    repeated = df.groupBy(episode).agg((F.count(question) - F.count_distinct(question)).alias("r")).agg(F.sum("r").alias("repeated_questions"))
    out = counts.crossJoin(leaky).crossJoin(repeated)
    warn = F.filter(F.array(F.when(F.col("episodes") < least_episodes, "few_episodes"), F.when(F.col("components") < least_components, "few_components"), F.when(F.col("leaking") > 0, "leak"), F.when(F.col("out_of_range") > 0, "score_range")), lambda w: w.isNotNull())
    return out.withColumn("warnings", F.array_join(warn, ","))


def feasibility(have: dict[str, int], need: dict[str, int]) -> dict[str, int]:
    """What is short of each need."""
    return {k: max(n - have.get(k, 0), 0) for k, n in need.items()}


def masked_softmax(logits: Column, mask: Column, temperature: float = 1.0) -> Column:
    """probabilities of the legal actions, zero for the others."""
    live = F.zip_with(logits, mask, lambda x, m: F.when(m > 0, x / temperature))
    top = F.array_max(live)
    e = F.transform(live, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
    return B.let(e, lambda xs: B.let(B.total(xs), lambda s: F.transform(xs, lambda x: x / s)))


def checkpoint(beliefs: DataFrame, episode: str, skill: str) -> DataFrame:
    """A JSON document an episode; fingerprints are not part of it."""
    return beliefs.groupBy(episode).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(skill).alias("k"), F.struct("p", "n", "ess").alias("v")))))).alias("state"))


def restored(states: DataFrame, episode: str, skill: str) -> DataFrame:
    """beliefs back from their documents."""
    m = F.from_json("state", "map<string, struct<p: array<double>, n: int, ess: double>>")
    return states.select(episode, F.explode(m).alias(skill, "b")).select(episode, skill, "b.*")
