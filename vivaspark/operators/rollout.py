"""Policy rollouts over scenarios: the episodes of an Arrow batch advance together, a turn at a time.

A policy (X01) is a function of the batch's state, one array entry an episode,
that returns an action each. The usual ones are tables of rules: a guard over
the state, an action; the first rule whose guard holds and whose action is
legal decides, else the first legal action. Evidence (X02) is a deterministic
function of its scenario, so rollouts repeat bit for bit wherever they run.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vivaspark.operators.belief import BeliefConfig

#: The action space, in its order.
ACTIONS = ("increase_difficulty", "decrease_difficulty", "ask_follow_up_same_topic", "switch_topic", "probe_foundation", "ask_behavioral", "ask_situational", "conclude_interview")
HARDER, EASIER, FOLLOW_UP, SWITCH, FOUNDATION, BEHAVIORAL, SITUATIONAL, CONCLUDE = range(8)


@dataclass(frozen=True)
class Condition:
    """How evidence scatters around its class centre."""

    centres: tuple[float, float, float]
    jitter: float
    bias_width: float = 0.0
    shift: float = 0.0
    confidence: float = 1.0


#: The named evidence conditions.
CONDITIONS = {"base": Condition((0.20, 0.50, 0.80), 0.16), "overlap": Condition((0.38, 0.50, 0.62), 0.50, 0.24), "low_confidence": Condition((0.25, 0.50, 0.75), 0.30, 0.16, confidence=0.55 * 0.60), "positive_shift": Condition((0.20, 0.50, 0.80), 0.24, 0.12, 0.10)}
#: Fixed value: what questions that dig into one topic add to a score.
DIG_BONUS = 0.025


def jitter(token: Column) -> Column:
    """a number in [-0.5, 0.5] from the first 64 bits of a token's SHA-256."""
    head = F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % 2001).cast("double") / 2000 - 0.5


def evidence(centre: Column, jitter_width: Column, bias_width: Column, shift: Column, seed: Column, episode: Column, turn: Column, action: Column, skill: Column) -> Column:
    """X02 as a column: the score of an answer under a condition, cut to [0, 1]."""
    own = F.concat_ws("|", seed.cast("string"), episode, turn.cast("string"), action, skill)
    digs = F.when(action.isin(ACTIONS[FOLLOW_UP], ACTIONS[FOUNDATION]), DIG_BONUS).otherwise(0.0)
    x = centre + jitter(own) * jitter_width + jitter(F.concat(F.lit("bias|"), seed.cast("string"))) * bias_width + shift + digs
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _jitters(tokens: list[str]) -> np.ndarray:
    """jitter() of many tokens inside a task."""
    return np.array([int(sha256(t.encode()).hexdigest()[:16], 16) % 2001 for t in tokens]) / 2000 - 0.5


# Guards: (state name, comparison, bound), all of which must hold. An action is a number, or a function of the state.
Guard = tuple[str, Callable, float]
Rule = tuple[list[Guard], "int | Callable[[dict], np.ndarray]"]


def by_rules(rules: list[Rule]) -> Callable[[dict, np.ndarray], np.ndarray]:
    """The policy of a rule table; state arrays and legal (episodes, 8) -> an action each."""

    def choose(state: dict, legal: np.ndarray) -> np.ndarray:
        open_, out = np.ones(len(legal), bool), np.argmax(legal, axis=1)
        for guards, action in rules:
            want = np.broadcast_to(action(state) if callable(action) else action, open_.shape)
            holds = open_ & legal[np.arange(len(legal)), want]
            for name, test, bound in guards:
                holds &= test(state[name], bound)
            out, open_ = np.where(holds, want, out), open_ & ~holds
        return out

    return choose


def random_legal(state: dict, legal: np.ndarray) -> np.ndarray:
    """A legal action drawn by a digest of seed and turn."""
    draw = np.array([int(sha256(f"{s}|{t}".encode()).hexdigest()[:8], 16) for s, t in zip(state["seed"], state["turn"])])
    rank = np.cumsum(legal, axis=1) - 1
    return np.argmax(legal & (rank == (draw % legal.sum(1))[:, None]), axis=1)


#: The script's order of actions, and the thresholds of the rules.
SCRIPT = np.array([FOUNDATION, FOLLOW_UP, HARDER, SWITCH, BEHAVIORAL, SITUATIONAL])
POLICIES: dict[str, Callable[[dict, np.ndarray], np.ndarray]] = {
    "random_valid": random_legal,
    "fixed_script": by_rules([([("turn", operator.ge, 10)], CONCLUDE), *(([], lambda state, k=k: SCRIPT[(state["turn"] + k) % len(SCRIPT)]) for k in range(len(SCRIPT)))]),
    "rule_adaptive": by_rules([([("entropy", operator.lt, 0.45), ("coverage", operator.ge, 0.5)], CONCLUDE), ([("ability", operator.lt, 0.40)], FOUNDATION), ([("ability", operator.gt, 0.75)], HARDER), ([], FOLLOW_UP)]),
    "uncertainty_greedy": by_rules([([("entropy", operator.lt, 0.35)], CONCLUDE), ([("skill_entropy", operator.gt, 0.55)], SWITCH), ([], FOUNDATION)]),
}


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(p + 1e-12)).sum(-1)


def _distribution(logit: np.ndarray, floor: float) -> np.ndarray:
    e = np.exp(logit - logit.max(-1, keepdims=True))
    q = np.maximum(e / e.sum(-1, keepdims=True), floor)
    return q / q.sum(-1, keepdims=True)


class Episodes:
    """Beliefs, coverage and legality of many interviews over the same skills."""

    def __init__(self, n: int, skills: list[str], c: BeliefConfig):
        self.c, self.skills, self.name_rank = c, skills, np.argsort(np.argsort(skills))
        self.p = np.tile(np.array(c.prior, float), (n, len(skills), 1))
        self.n, self.ess, self.at = np.zeros((n, len(skills)), int), np.zeros((n, len(skills))), np.full(n, -1)

    def observe(self, who: np.ndarray, skill: np.ndarray, score: np.ndarray, reliability: float | np.ndarray) -> np.ndarray:
        """Update a skill of each named episode; the gains in certainty."""
        c, p, ess = self.c, self.p[who, skill], self.ess[who, skill]
        w = np.minimum(reliability / (1 + ess) ** c.discount_power, np.maximum(c.cap - ess, 0.0))
        m, d = np.array(c.centres), np.array(c.scales)
        q = _distribution(np.log(np.maximum(p, 1e-12)) + w[:, None] * (-0.5 * ((score[:, None] - m) / d) ** 2 - np.log(d)), c.floor)
        gain, counts = np.maximum(0.0, _entropy(p) - _entropy(q)) * w, w > 0
        who, skill = who[counts], skill[counts]
        self.p[who, skill] = q[counts]
        self.ess[who, skill] += w[counts]
        self.n[who, skill] += 1
        return np.where(counts, gain, 0.0)

    def pool(self) -> np.ndarray:
        """Pooled distribution of each episode; the prior where nothing was seen."""
        w = np.where(self.n > 0, np.minimum(self.ess, self.c.cap), 0.0)
        prior = np.log(np.array(self.c.prior))
        shift = (w[:, :, None] * (np.log(np.maximum(self.p, 1e-12)) - prior)).sum(1) / np.maximum(w.sum(1), 1e-300)[:, None]
        return np.where(w.sum(1)[:, None] > 0, _distribution(prior + shift, self.c.floor), np.array(self.c.prior))

    def covered(self) -> np.ndarray:
        return (self.n > 0).sum(1)

    def legal(self, turn: int) -> np.ndarray:
        out = np.ones((len(self.at), len(ACTIONS)), bool)
        out[:, FOLLOW_UP] = self.at >= 0
        out[:, CONCLUDE] = (turn >= 10) & (self.covered() >= min(max(5, self.c.least_coverage), len(self.skills))) & (self.n.sum(1) >= 5)
        return out

    def state(self, turn: int, seed: np.ndarray) -> dict[str, np.ndarray]:
        pool, rows = self.pool(), np.arange(len(self.at))
        own = np.where(self.at >= 0, _entropy(self.p[rows, self.at]) / np.log(3), 1.0)
        return {"turn": np.full(len(rows), turn), "seed": seed, "entropy": _entropy(pool) / np.log(3), "coverage": self.covered() / len(self.skills), "ability": pool @ np.array([0.0, 0.5, 1.0]), "skill_entropy": own}

    def targets(self, action: np.ndarray) -> np.ndarray:
        """The next skill of each: neighbours in the list stand for advanced and prerequisite skills.

        Among candidates: unseen ones while coverage is open, then the fewest
        questions, the highest entropy, the first name.
        """
        now, k = np.maximum(self.at, 0)[:, None], np.arange(len(self.skills))[None, :]
        step = np.select([action == HARDER, (action == EASIER) | (action == FOUNDATION)], [1, -1], 0)[:, None]
        wanted = np.where((action == SWITCH)[:, None], k != now, (step != 0) & (k == now + step))
        keep = np.where(wanted.any(1, keepdims=True), wanted, k == now)
        unseen = (self.covered() < min(5, len(self.skills)))[:, None] & (self.n == 0)
        for order in (~unseen, self.n, -_entropy(self.p), np.broadcast_to(self.name_rank, keep.shape)):
            keep &= order == np.where(keep, order, np.inf).min(1, keepdims=True)
        return np.argmax(keep, axis=1)


def play(policy: Callable[[dict, np.ndarray], np.ndarray], condition: Condition, label: np.ndarray, seed: np.ndarray, episode: list[str], skills: list[str], c: BeliefConfig, turns: int = 30) -> pd.DataFrame:
    """Rollouts of one policy under one condition: outcomes, turns, skills, rewards and information gains."""
    e, n = Episodes(len(label), skills, c), len(label)
    reward, gained, length, going = np.zeros(n), np.zeros(n), np.zeros(n, int), np.ones(n, bool)
    bias = _jitters([f"bias|{s}" for s in seed]) * condition.bias_width
    centre = np.array(condition.centres)[label]
    for turn in range(turns):
        legal = e.legal(turn)
        action = policy(e.state(turn, seed), legal)
        if not legal[np.arange(n), action][going].all():
            raise ValueError("illegal action")
        going &= action != CONCLUDE
        who = np.flatnonzero(going)
        if not len(who):
            break
        skill = e.targets(action)[who]
        tokens = [f"{seed[i]}|{episode[i]}|{turn}|{ACTIONS[action[i]]}|{skills[s]}" for i, s in zip(who, skill)]
        digs = np.isin(action[who], (FOLLOW_UP, FOUNDATION)) * DIG_BONUS
        score = np.clip(centre[who] + _jitters(tokens) * condition.jitter + bias[who] + condition.shift + digs, 0.0, 1.0)
        before = e.n[who, skill]
        gain = e.observe(who, skill, score, condition.confidence)
        reward[who] += 1.5 * gain + 0.5 * (before == 0) - 0.1 - 0.05 * np.minimum(before, 3)
        gained[who] += gain
        e.at[who] = skill
        length[who] += 1
    pool = e.pool()
    best = pool.argmax(1)
    sure = (pool.max(1) >= c.least_confidence) & (np.minimum(e.ess, c.cap).sum(1) >= c.least_evidence) & (e.covered() >= c.least_coverage)
    reward += np.where(sure, np.array([10.0, -5.0, -10.0])[np.abs(label - best)], -2.5)
    said = pd.array(np.where(sure, best, -1), "Int64")
    said[~sure] = pd.NA
    return pd.DataFrame({"true_label": label, "predicted_label": said, "turns": length, "skills_covered": e.covered(), "reward": reward, "information_gain": gained, "termination_reason": np.where(going, "max_turns", "explicit_conclusion")})


SCHEMA = "policy string, condition string, episode_id string, true_label long, predicted_label long, turns long, skills_covered long, reward double, information_gain double, termination_reason string"


def rollouts(spark: SparkSession, policies: dict[str, Callable[[dict, np.ndarray], np.ndarray]], conditions: dict[str, Condition], per_label: int, skills: list[str], seed: int = 42, c: BeliefConfig = BeliefConfig()) -> DataFrame:
    """Every policy on the same scenarios of every condition; a row each."""
    names = lambda xs, n: F.explode(F.array(*[F.lit(x) for x in xs])).alias(n)
    grid = spark.range(3 * per_label).select("id", names(policies, "policy")).select("id", "policy", names(conditions, "condition"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (policy, condition), own in f.groupby(["policy", "condition"]):
                label, index = np.divmod(own["id"].to_numpy(), per_label)
                episode = [f"episode-{a}-{b}" for a, b in zip(label, index)]
                out = play(policies[policy], conditions[condition], label, seed + label * 10_000 + index, episode, skills, c)
                out.insert(0, "episode_id", episode)
                out.insert(0, "condition", condition)
                out.insert(0, "policy", policy)
                yield out

    return grid.mapInPandas(run, SCHEMA)
