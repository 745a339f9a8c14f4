import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vivaspark.functions import grounding as N
from vivaspark.operators import belief as B
from vivaspark.operators import calibrate as C
from vivaspark.operators import rollout as O


def plain(rows, c):
    """The recurrence in plain Python: rows of (score, reliability, fingerprint)."""
    p, n, ess, seen = list(c.prior), 0, 0.0, set()
    for score, reliability, mark in rows:
        w = reliability / (1 + ess) ** c.discount_power
        if mark:
            w *= c.duplicate_multiplier if mark in seen else 1.0
            seen.add(mark)
        w = min(w, max(c.cap - ess, 0.0))
        if w <= 0:
            continue
        logit = [math.log(max(x, 1e-12)) + w * (-0.5 * ((score - m) / s) ** 2 - math.log(s)) for x, m, s in zip(p, c.centres, c.scales)]
        e = [math.exp(x - max(logit)) for x in logit]
        q = [max(x / sum(e), c.floor) for x in e]
        p, n, ess = [x / sum(q) for x in q], n + 1, ess + w
    return p, n, ess


def test_fold_equals_plain_recurrence(spark):
    rng = random.Random(2)
    c = B.BeliefConfig(scales=(0.1, 0.22, 0.3))
    rows = [(u, s, i, rng.random(), rng.choice([1.0, 0.5, 0.0]), rng.choice([None, "", "a", "b", "c"])) for u in range(4) for s in "xy" for i in range(12)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "u long, s string, i long, score double, reliability double, fingerprint string")
    for r in B.skill_beliefs(df, "u", "s", ["i"], c).collect():
        p, n, ess = plain([x[3:] for x in rows if x[0] == r.u and x[1] == r.s], c)
        assert r.n == n and abs(r.ess - ess) < 1e-12 and all(abs(a - b) < 1e-12 for a, b in zip(r.p, p))


def test_abstains_without_coverage(spark):
    df = spark.createDataFrame([(1, "x", i, 0.9, 1.0, None) for i in range(9)], "u long, s string, i long, score double, reliability double, fingerprint string")
    r = B.assessment(B.skill_beliefs(df, "u", "s", ["i"]), "u").first()
    assert r.label is None and r.raw_label == 2 and r.covered == 1
    biased = B.assessment(B.skill_beliefs(df, "u", "s", ["i"]), "u", B.BeliefConfig(low_bias=50.0, least_coverage=1)).first()
    assert biased.label == 0 and biased.raw_label == 2


@pytest.mark.parametrize("bad", [{"cap": 0}, {"floor": 0.5}, {"scales": (0.1, 0.1, 0.0)}, {"prior": (0.5, 0.5, 0.0)}, {"centres": (0.5, 0.2, 0.8)}, {"temperature": 0}])
def test_config_is_validated(bad):
    with pytest.raises(ValueError):
        B.BeliefConfig(**bad)


def test_rollouts_repeat_and_are_legal(spark):
    a = O.rollouts(spark, O.POLICIES, {"base": O.CONDITIONS["base"]}, 3, [f"s{k}" for k in range(7)])
    rows = a.collect()
    assert len(rows) == 36 and sorted(map(str, rows)) == sorted(map(str, a.repartition(5).collect()))
    assert all(r.turns <= 30 and r.skills_covered <= 7 for r in rows)
    one = spark.createDataFrame([(0.2, 42, "episode-0-0", 3, O.ACTIONS[4], "s1")], "m double, seed long, e string, t int, a string, s string")
    x = one.select(O.evidence(F.col("m"), F.lit(0.16), F.lit(0.1), F.lit(0.0), *map(F.col, ("seed", "e", "t", "a", "s"))).alias("x")).first().x
    assert abs(x - (0.2 + O._jitters([f"42|episode-0-0|3|{O.ACTIONS[4]}|s1"])[0] * 0.16 + O._jitters(["bias|42"])[0] * 0.1 + 0.025)) < 1e-12
    script = [r for r in rows if r.policy == "fixed_script"]
    assert script and all(r.turns >= 10 for r in script if r.termination_reason == "explicit_conclusion")


def test_episodes_equal_the_fold():
    e = O.Episodes(2, ["x", "y"], B.BeliefConfig())
    rows = [(0.2, 1.0, None), (0.7, 0.5, None), (0.4, 1.0, None)] * 4
    for s, r, _ in rows:
        e.observe(np.array([1]), np.array([0]), np.array([s]), r)
    p, n, ess = plain(rows, B.BeliefConfig())
    assert e.n.tolist() == [[0, 0], [n, 0]] and abs(e.ess[1, 0] - ess) < 1e-12 and np.abs(e.p[1, 0] - p).max() < 1e-12
    assert np.abs(e.p[0] - 1 / 3).max() < 1e-12


def test_rules_take_the_first_legal_action():
    legal = np.array([[1, 1, 0, 1, 1, 1, 1, 0], [0, 1, 0, 0, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1, 1, 1]], bool)
    state = {"turn": np.array([0, 10, 13]), "seed": np.array([1, 2, 3]), "entropy": np.array([0.2, 0.2, 0.9]), "coverage": np.array([0.6, 0.4, 0.9]), "ability": np.array([0.9, 0.1, 0.5]), "skill_entropy": np.array([0.3, 0.9, 0.9])}
    assert O.POLICIES["fixed_script"](state, legal).tolist() == [4, 7, 7]
    assert O.POLICIES["rule_adaptive"](state, legal).tolist() == [0, 4, 2]
    assert O.POLICIES["uncertainty_greedy"](state, legal).tolist() == [4, 7, 3]
    assert all(legal[i, a] for i, a in enumerate(O.POLICIES["random_valid"](state, legal)))


def test_replay_equals_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(u, i, rng.choice("xyz"), rng.choice([None, 0.1, 0.6, 0.9]), i == u * 4) for u in range(1, 5) for i in range(14)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "u long, i long, s string, score double, stop boolean")
    got = {(r.episode, r.turn): r for r in C.replay(df, "u", "i", "s", "score", "stop").collect()}
    c, k = B.BeliefConfig(), 0
    for u in range(1, 5):
        seen = {}
        for _, i, s, score, _ in [x for x in rows if x[0] == u and x[1] <= u * 4]:
            r, before = got[u, i], seen.get(s, [])
            seen[s] = [*before, (score, 1.0, None)] if score is not None else before
            assert abs(r.evidence - (plain(seen[s], c)[2] - plain(before, c)[2])) < 1e-9 and r.done == (i == min(u * 4, 13))
            h = lambda x: -sum(q * math.log(q + 1e-12) for q in plain(x, c)[0])
            gain = max(0.0, h(before) - h(seen[s])) * r.evidence
            assert abs(r.gain - gain) < 1e-9 and abs(r.reward - (1.5 * gain + 0.5 * (not before) - 0.1 - 0.05 * min(len([x for x in before if plain([x], c)[1]]), 3))) < 1e-9
            k += 1
    assert k == len(got)


def test_cross_validation_never_sees_its_fold(spark):
    rng = random.Random(3)
    rows = [(u, s, i, min(1.0, max(0.0, rng.gauss((0.2, 0.5, 0.8)[u % 3], 0.1))), 1.0, None) for u in range(18) for s in "xyz" for i in range(3)]
    df = spark.createDataFrame(rows, "u long, s string, i long, score double, reliability double, fingerprint string")
    truth = spark.createDataFrame([(u, u % 3) for u in range(18)], "u long, y int")
    fold = (F.col("u") / 3).cast("int") % 3
    run = lambda t: {r.u: (r.p, r.confidence, r.fold) for r in C.cross_validate(df, "u", "s", ["i"], "score", t, fold).collect()}
    got = run(truth)
    assert len(got) == 18 and sum(p == u % 3 for u, (p, _, _) in got.items()) >= 16
    # Other labels in one fold change what the other folds' models learn, never its own predictions.
    turned = run(truth.withColumn("y", F.when(fold == 1, 2 - F.col("y")).otherwise(F.col("y"))))
    assert {u: x for u, x in got.items() if x[2] == 1} == {u: x for u, x in turned.items() if x[2] == 1} and got != turned


def test_grades_by_hand(spark):
    rows = [(1, "caching of hot keys", "caching of hot keys"), (2, "", "caching"), (3, "uncaching all", "caching keys"), (4, "hot keys", "cold locks")]
    df = spark.createDataFrame(rows, "k int, a string, r string")
    got = {r.k: r for r in N.semantic_grade(df, ["k"], "a", "r", ["caching"]).collect()}
    assert abs(got[1].similarity - 1) < 1e-9 and got[1].coverage == 1 and got[1].grade == "A"
    assert (got[2].composite, got[2].grade) == (0.0, "F") and (got[3].coverage, got[3].grade) == (0.0, "F") and got[4].similarity == 0.0
