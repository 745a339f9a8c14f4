"""Data contracts around calibration: frozen protocols, split authentication, one-attempt evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivaspark.sources import writers as W

#: What may follow what.
NEXT = {"FROZEN": {"PROVISIONAL", "FAILED"}, "PROVISIONAL": {"VALIDATED", "FAILED"}, "VALIDATED": set(), "FAILED": set()}


class ContractError(ValueError):
    """A protocol, split or artifact that is not what it says."""


def freeze(rows: DataFrame, split: str, episode: str, component: str, thresholds: dict, grid: list, seed: int) -> dict:
    """Counts and digests of each split, thresholds, grid and seed, sealed."""
    counts = rows.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(episode).alias("episodes"), F.count_distinct(component).alias("components")).collect()
    body = {
        "state": "FROZEN",
        "revision": 0,
        "splits": {r[split]: {"rows": r["rows"], "episodes": r["episodes"], "components": r["components"], "digest": W.table_digest(rows.sparkSession, rows.filter(F.col(split) == r[split]).select(*sorted(rows.columns)))} for r in counts},
        "thresholds": thresholds,
        "grid": grid,
        "seed": seed,
    }
    return W.sealed(body)


def advance(protocol: dict, state: str, **facts) -> dict:
    """The protocol in its next state, one revision on."""
    check(protocol)
    if state not in NEXT[protocol["state"]]:
        raise ContractError(f"{protocol['state']} can't become {state}")
    return W.sealed(protocol | facts | {"state": state, "revision": protocol["revision"] + 1})


def check(protocol: dict) -> None:
    """Seal and required fields."""
    missing = {"state", "revision", "splits", "thresholds", "grid", "seed"} - protocol.keys()
    if missing:
        raise ContractError(f"missing: {sorted(missing)}")
    if not W.verify(protocol):
        raise ContractError("the protocol was changed after it was sealed")


def authenticate(rows: DataFrame, protocol: dict, split: str, name: str, episode: str, component: str) -> None:
    """A split's rows are those that were frozen."""
    check(protocol)
    want = protocol["splits"].get(name)
    part = rows.filter(F.col(split) == name)
    r = part.agg(F.count("*").alias("rows"), F.count_distinct(episode).alias("episodes"), F.count_distinct(component).alias("components")).first()
    got = r.asDict() | {"digest": W.table_digest(rows.sparkSession, part.select(*sorted(rows.columns)))}
    if got != want:
        raise ContractError(f"split {name} is {got}, not {want}")


def migrate(assignments: dict[str, str], sizes: dict[str, int], source: str, target: str, goal: int, locked: str = "test") -> dict[str, str]:
    """Move whole components from one split to another until it is as near the goal as that gets; the locked one stays."""
    if locked in (source, target):
        raise ContractError(f"{locked} is locked")
    out = dict(assignments)
    have = sum(sizes[c] for c, s in out.items() if s == target)
    for c in sorted((c for c, s in out.items() if s == source), key=lambda c: (W.digest(c), c)):
        if abs(have + sizes[c] - goal) < abs(have - goal):
            out[c], have = target, have + sizes[c]
    return out


def locked_test(marker: str, protocol: dict, evaluate) -> dict:
    """Run an evaluation once; the marker is set before any row of it is read."""
    check(protocol)
    if protocol["state"] != "VALIDATED":
        raise ContractError("only a validated protocol may be tested")
    W.exclusive_json(marker, {"protocol": protocol["self_hash"]})
    return W.sealed({"protocol": protocol["self_hash"], "result": evaluate()})


def refuse(what: str):
    """Operations that stay off."""
    raise ContractError(f"{what} is disabled: it would look at held-out data")
