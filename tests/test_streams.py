"""Keyed streams against plain folds over the same rows, in one batch and in several."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vivaspark.plans import registry
from vivaspark.plans import streams as P
from vivaspark.streaming import keyed as K
from vivaspark.streaming import live as L


def plain_queue(rows, most=3, lease=36_000_000, wait=3_600_000):
    """rows (job, worker, action, epoch, id, at) in order of arrival -> id: (answer, epoch, attempts, status)."""
    jobs, out = {}, {}
    for job, worker, action, epoch, row, at in rows:
        j = jobs.setdefault(job, {"status": "queued", "owner": None, "epoch": 0, "tries": 0, "free": 0})
        if j["status"] in ("done", "failed"):
            answer = "closed"
        elif action == "claim" and at < j["free"]:
            answer = "refused"
        elif action == "claim" and j["tries"] == most:
            j["status"], answer = "failed", "exhausted"
        elif action == "claim":
            j |= {"status": "running", "owner": worker, "epoch": j["epoch"] + 1, "tries": j["tries"] + 1, "free": at + lease}
            answer = "claimed"
        elif j["status"] != "running" or (worker, epoch) != (j["owner"], j["epoch"]):
            answer = "fenced"
        elif action == "beat":
            j["free"], answer = at + lease, "renewed"
        elif action == "done":
            j["status"], answer = "done", "finished"
        elif action == "retry":
            j["status"], j["free"], answer = "queued", at + wait * 2 ** (j["tries"] - 1), "requeued"
        else:
            j["status"], answer = "failed", "unsupported"
        out[row] = (answer, j["epoch"], j["tries"], j["status"])
    return out


def answers(df):
    rows = df.collect()
    got = {r.event_id: (r.answer, r.epoch, r.attempts, r.status) for r in rows}
    assert len(got) == len(rows)
    return got


def test_queue_of_all_events(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    log = [tuple(r) for r in P.queue_log(events).select("job", "worker", "action", "epoch", "event_id", "at_ms").orderBy("at_ms", "event_id").collect()]
    want = plain_queue(log)
    assert answers(registry.QUERIES["stream_queue"](spark, sf)) == want
    assert {"claimed", "refused", "fenced", "renewed", "finished"} <= {v[0] for v in want.values()}


def stream(spark, tmp_path, batches, schema):
    """Each list of rows is a file, and a batch of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        # Files are taken oldest first.
        import time

        time.sleep(1.1)
    return L.read(spark, str(tmp_path / "t"))


LOG = "job long, worker string, action string, epoch long, event_id long, at_ms long"


@pytest.mark.parametrize("apart", [False, True])
def test_rival_claims(spark, tmp_path, apart):
    rows = [(1, "b", "claim", 0, 11, 1000), (1, "a", "claim", 0, 10, 1000), (2, "a", "claim", 0, 20, 1000), (1, "b", "done", 1, 12, 1500), (1, "a", "retry", 1, 13, 2000), (2, "a", "beat", 1, 21, 2000)]
    later = [(1, "b", "claim", 0, 14, 2500), (1, "b", "claim", 0, 15, 3100), (1, "a", "done", 1, 16, 3200), (1, "b", "done", 2, 17, 3300), (1, "a", "claim", 0, 18, 99_000), (2, "b", "claim", 0, 22, 99_000), (2, "a", "done", 1, 23, 99_500), (2, "b", "sing", 2, 24, 99_600), (3, "a", "beat", 1, 30, 5)]
    log = stream(spark, tmp_path, [rows, later] if apart else [rows + later], LOG)
    got = answers(K.drained(K.queue(log, "job", "worker", "action", "epoch", "event_id", "at_ms")))
    assert got == plain_queue([*sorted(rows, key=lambda r: (r[5], r[4])), *sorted(later, key=lambda r: (r[5], r[4]))], lease=45_000, wait=1_000)
    assert [got[k][0] for k in (10, 11, 12, 13, 14, 15, 16, 17, 18, 22, 23, 24, 30)] == ["claimed", "refused", "fenced", "requeued", "refused", "claimed", "fenced", "finished", "closed", "claimed", "fenced", "unsupported", "fenced"]


def test_attempts_run_out(spark, tmp_path):
    rows = [(1, "a", "claim", 0, i, i * 100_000) for i in range(1, 6)]
    got = answers(K.drained(K.queue(stream(spark, tmp_path, [rows[:2], rows[2:]], LOG), "job", "worker", "action", "epoch", "event_id", "at_ms")))
    assert [got[i] for i in range(1, 6)] == [("claimed", 1, 1, "running"), ("claimed", 2, 2, "running"), ("claimed", 3, 3, "running"), ("exhausted", 3, 3, "failed"), ("closed", 3, 3, "failed")]


def test_conflicts_over_two_batches(spark, tmp_path):
    log = stream(spark, tmp_path, [[(1, "x", 1, 10), (1, "x", 2, 20), (2, "y", 3, 10)], [(1, "z", 4, 30), (2, "y", 5, 30), (3, "q", 6, 30)]], "k long, fingerprint string, id long, at_ms long")
    sinks = K.split(K.submissions(log, ["k"], "fingerprint", "id", "at_ms"), "outcome", {"kept": ["accepted"], "aside": ["repeated", "conflict"]})
    assert sorted(map(tuple, sinks["kept"].collect())) == [(1, 1, 1, "accepted"), (2, 3, 3, "accepted"), (3, 6, 6, "accepted")]
    assert sorted(map(tuple, sinks["aside"].collect())) == [(1, 2, 1, "repeated"), (1, 4, 1, "conflict"), (2, 5, 3, "repeated")]


def test_idle_state_goes(spark, tmp_path):
    day = 86_400_000
    log = stream(spark, tmp_path, [[(1, 1, day, 4.0), (1, 2, day + 1, 6.0)], [(2, 3, 400 * day, 1.0)], [(2, 4, 401 * day, 1.0)], [(1, 5, 402 * day, 9.0)]], "k long, id long, at_ms long, v double")
    got = {r.id: r.v_deviation for r in K.drained(K.baselines(log, "k", "id", "at_ms", ["v"], turns=1)).collect()}
    assert got == {1: None, 2: 0.5, 3: None, 4: 0.0, 5: None}
    assert pd.isna(got[5])
