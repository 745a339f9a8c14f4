"""Keyed state over live streams, with batch twins.

Every query here also has a batch form in `operators`; with availableNow a
stream over the same files ends with the same rows. State is bounded: by the
watermark where Spark keeps it, and by an event-time timeout where a key's own
state is kept, which drops a key that has been idle for so long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vivaspark.operators.belief import BeliefConfig
from vivaspark.operators.rollout import Episodes
from vivaspark.session import shared_folder


def read(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A table as a stream of its files; the schema is that of the table, never inferred from the stream."""
    schema = spark.read.parquet(path).schema
    # A pattern is listed, so the table may be one file as well as a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into the session's shared folder, and read the sink back.

    Appended batches go to Parquet with exactly-once commits. Updated or complete
    results keep each batch apart by its id: the last row of a key counts.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/rows").start()
    else:
        q = writer.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/batch_id={i}")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema if mode == "append" else df.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{at}/rows")


def deduplicated(stream: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, lateness: str, length: str, slide: str | None, key: str, value: str) -> DataFrame:
    """Tumbling or sliding counts and sums in event time; rows later than the watermark are left out."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, lateness).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, at: str, lateness: str, gap: str, key: str) -> DataFrame:
    """Turns delimited by a gap, as session windows."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, lateness).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def beliefs(stream: DataFrame, key: str, skill: str, score: str, order: str, lateness: str = "1 hour", idle_ms: int = 90 * 86_400_000, c: BeliefConfig = BeliefConfig()) -> DataFrame:
    """A key's beliefs by skill, kept in state and sent out after each of its batches.

    Rows of one batch are taken in the order of the timestamp `order`; across
    batches order is that of arrival. A key's state goes idle_ms after its last
    event. Output: key, skill, p0, p1, p2, n, ess, of skills the batch moved.
    """
    out = f"{key} long, {skill} string, p0 double, p1 double, p2 double, n long, ess double"
    state = "skills array<string>, p array<array<double>>, n array<long>, ess array<double>, last long"

    def update(k, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        old = held.get if held.exists else ([], [], [], [], 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        names = [*old[0], *sorted(set(rows[skill]) - set(old[0]))]
        e, known = Episodes(1, names, c), len(old[0])
        if known:
            e.p[0, :known], e.n[0, :known], e.ess[0, :known] = np.array([list(x) for x in old[1]]), old[2], old[3]
        place = rows[skill].map({s: i for i, s in enumerate(names)}).to_numpy()
        values, turn = rows[score].to_numpy(float), rows.groupby(skill).cumcount().to_numpy()
        # Skills don't touch each other: the j-th rows of all of them go together.
        for j in range(int(turn.max()) + 1):
            own = turn == j
            e.observe(np.zeros(int(own.sum()), int), place[own], values[own], 1.0)
        last = max(old[4], int(rows[order].max().timestamp() * 1000))
        held.update((names, e.p[0].tolist(), e.n[0].tolist(), e.ess[0].tolist(), last))
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + idle_ms)
        moved = sorted(set(place))
        yield pd.DataFrame([(k[0], names[i], *e.p[0, i], e.n[0, i], e.ess[0, i]) for i in moved], columns=[key, skill, "p0", "p1", "p2", "n", "ess"])

    return stream.withWatermark(order, lateness).groupBy(key).applyInPandasWithState(update, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def leases(stream: DataFrame, session: str, owner: str, at_ms: str, ttl_ms: int = 45_000, lateness: str = "1 hour") -> DataFrame:
    """One writer a session. A heartbeat renews its owner's lease, another owner takes it over only
    once it has run out, with the next epoch; rows older than what was seen are stale. A session's state goes once
    its lease has run out for all rows that can still come.

    Output: a row a heartbeat with its decision (renewed, taken, refused, stale) and the epoch in force.
    """
    out = f"{session} long, {owner} string, {at_ms} long, decision string, epoch long"

    def update(k, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        holder, until, epoch, seen = held.get if held.exists else ("", -1, 0, -1)
        rows = []
        for who, at in pd.concat(list(frames)).sort_values([at_ms, owner])[[owner, at_ms]].itertuples(index=False):
            if at < seen:
                rows.append((k[0], who, at, "stale", epoch))
                continue
            seen = at
            if who == holder and at <= until:
                decision, until = "renewed", at + ttl_ms
            elif at > until:
                decision, holder, until, epoch = "taken", who, at + ttl_ms, epoch + 1
            else:
                decision = "refused"
            rows.append((k[0], who, at, decision, epoch))
        held.update((holder, int(until), int(epoch), int(seen)))
        held.setTimeoutTimestamp(max(int(until), held.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame(rows, columns=[session, owner, at_ms, "decision", "epoch"])

    timed = stream.withColumn("_at", F.timestamp_millis(F.col(at_ms))).withWatermark("_at", lateness)
    return timed.groupBy(session).applyInPandasWithState(update, out, "holder string, until long, epoch long, seen long", "append", GroupStateTimeout.EventTimeTimeout)
