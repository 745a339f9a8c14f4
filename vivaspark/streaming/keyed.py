"""Keyed state with typed values and timers: baselines, submissions, a job queue.

Each is a processor of transformWithState: its state is a typed value a key, kept
by RocksDB on the executors, and an event-time timer takes it away once its key
has been idle. Rows of one batch are taken in the order of their time and id;
across batches order is that of arrival. Results are rows a sink may split: see
split().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vivaspark.session import shared_folder

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Keyed(StatefulProcessor):
    """A fold over a key's rows. `state` is its value's type, whose last field is the time of the key's last row in ms."""

    state = ""
    idle_ms = 90 * 86_400_000
    order = ["at_ms"]
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.state)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        """The state after a row, and what to send out."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *state, last = self.value.get() if self.value.exists() else (*self.start(), 0)
        out = []
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples(index=False):
            state, sent = self.step(tuple(state), row)
            last = max(last, int(row.at_ms))
            out += [(*key, *s) for s in sent]
        self.value.update((*state, last))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def _run(stream: DataFrame, keys: list[str], processor: Keyed, schema: str, at_ms: str, lateness: str) -> DataFrame:
    processor.columns = [f.split()[0] for f in schema.split(", ")]
    timed = stream.withColumn("_at", F.timestamp_millis(F.col(at_ms))).withWatermark("_at", lateness).withColumnRenamed(at_ms, "at_ms")
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


class Baseline(Keyed):
    """Sums of a key's first turns, then deviations from their mean."""

    def __init__(self, values: list[str], turns: int):
        self.values, self.turns, self.order = values, turns, ["at_ms", "row_id"]
        self.state = "n long, " + ", ".join(f"s{i} double" for i in range(len(values))) + ", last long"

    def start(self) -> tuple:
        return (0, *[0.0] * len(self.values))

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        n, *sums = state
        now = [float(getattr(row, v) or 0.0) for v in self.values]
        if n < self.turns:
            return (n + 1, *[s + x for s, x in zip(sums, now)]), [(row.row_id, *[None] * len(now))]
        base = [s / self.turns for s in sums]
        return state, [(row.row_id, *[0.0 if abs(b) < 1e-6 else (x - b) / b for x, b in zip(now, base)])]


def baselines(stream: DataFrame, key: str, row_id: str, at_ms: str, values: list[str], turns: int = 2, lateness: str = "31 days") -> DataFrame:
    """A row a turn with each value's deviation from the mean of the key's first turns, null for those turns."""
    rows = stream.select(key, F.col(row_id).alias("row_id"), at_ms, *values)
    schema = f"{key} long, row_id long, " + ", ".join(f"{v}_deviation double" for v in values)
    return _run(rows, [key], Baseline(values, turns), schema, at_ms, lateness).withColumnRenamed("row_id", row_id)


class Submission(Keyed):
    """What a key was first used for."""

    state, order = "fingerprint string, row_id long, last long", ["at_ms", "row_id"]

    def start(self) -> tuple:
        return (None, -1)

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        fingerprint, first = state
        if fingerprint is None:
            return (row.fingerprint, int(row.row_id)), [(row.row_id, row.row_id, "accepted")]
        return state, [(row.row_id, first, "repeated" if row.fingerprint == fingerprint else "conflict")]


def submissions(stream: DataFrame, keys: list[str], fingerprint: str, row_id: str, at_ms: str, lateness: str = "31 days") -> DataFrame:
    """Each submission as accepted, repeated (the same again) or conflict (its key was used for something else), with the row that was accepted."""
    rows = stream.select(*keys, F.col(fingerprint).alias("fingerprint"), F.col(row_id).alias("row_id"), at_ms)
    schema = ", ".join([*(f"{k} long" for k in keys), "row_id long", "first_id long", "outcome string"])
    return _run(rows, keys, Submission(), schema, at_ms, lateness).withColumnRenamed("row_id", row_id)


class Job(Keyed):
    """A job's place in the queue, as a fold over the log of what was asked of it."""

    state, order = "status string, owner string, epoch long, attempts long, free_at long, last long", ["at_ms", "row_id"]

    def __init__(self, most_attempts: int, lease_ms: int, wait_ms: int):
        self.most, self.lease, self.wait = most_attempts, lease_ms, wait_ms

    def start(self) -> tuple:
        return ("queued", None, 0, 0, 0)

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        status, owner, epoch, attempts, free_at = state
        at, who = int(row.at_ms), row.worker
        mine = status == "running" and owner == who and int(row.epoch) == epoch
        if status in ("done", "failed"):
            answer = "closed"
        elif row.action == "claim":
            if at < free_at:
                answer = "refused"
            elif attempts >= self.most:
                status, owner, answer = "failed", None, "exhausted"
            else:
                status, owner, epoch, attempts, free_at, answer = "running", who, epoch + 1, attempts + 1, at + self.lease, "claimed"
        elif not mine:
            answer = "fenced"
        elif row.action == "beat":
            free_at, answer = at + self.lease, "renewed"
        elif row.action == "done":
            status, owner, answer = "done", None, "finished"
        elif row.action == "retry":
            status, owner, free_at, answer = "queued", None, at + self.wait * 2 ** (attempts - 1), "requeued"
        else:
            status, owner, answer = "failed", None, "unsupported"
        return (status, owner, epoch, attempts, free_at), [(row.row_id, who, answer, epoch, attempts, status)]


def queue(stream: DataFrame, job: str, worker: str, action: str, epoch: str, row_id: str, at_ms: str, most_attempts: int = 3, lease_ms: int = 45_000, wait_ms: int = 1_000, lateness: str = "31 days") -> DataFrame:
    """The log of a durable queue, answered. Of rival claims on a job the earliest wins, whether they come in one batch or in several.

    A claim is refused while a lease runs or a retry waits, and starts the next
    epoch otherwise. Beats, ends and retries of an epoch that is over are fenced.
    A retry waits twice as long each time; after most_attempts the job has failed.
    Actions: claim, beat, done, retry; any other fails the job.
    """
    rows = stream.select(job, F.col(worker).alias("worker"), F.col(action).alias("action"), F.col(epoch).alias("epoch"), F.col(row_id).alias("row_id"), at_ms)
    schema = f"{job} long, row_id long, worker string, answer string, epoch long, attempts long, status string"
    return _run(rows, [job], Job(most_attempts, lease_ms, wait_ms), schema, at_ms, lateness).withColumnRenamed("row_id", row_id)


def split(df: DataFrame, by: str, sinks: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Run a stream over all that is there into several sinks: each gets the rows whose `by` is among its values, from the same batches.

    A batch that is run again replaces what it had written, so each sink has each
    row once.
    """
    spark = df.sparkSession
    at, before = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(_PROVIDER[0])
    spark.conf.set(*_PROVIDER)

    def write(batch: DataFrame, i: int) -> None:
        batch.persist()
        for name, values in sinks.items():
            batch.filter(F.col(by).isin(values)).write.mode("overwrite").parquet(f"{at}/{name}/batch={i}")
        batch.unpersist()

    try:
        df.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER[0], before)
    return {name: spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{at}/{name}") for name in sinks}


def drained(df: DataFrame) -> DataFrame:
    """Run a stream of this module over all that is there, into one sink."""
    return split(df.withColumn("_all", F.lit("all")), "_all", {"rows": ["all"]})["rows"].drop("_all")
