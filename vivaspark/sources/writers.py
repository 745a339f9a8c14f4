"""Sinks: exclusive and versioned writes, appends, upserts, small reports."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exclusive(df: DataFrame, path: str) -> None:
    """Fails if anything is there."""
    df.write.mode("errorifexists").parquet(path)


def splits(df: DataFrame, path: str, split: str = "dataset_split") -> None:
    """A folder a split, so that a reader of one never opens another."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def ledger(df: DataFrame, path: str) -> None:
    """Append JSON lines."""
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; the newer table wins equal versions."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "_new" and c not in keys]
    last = F.max_by(F.struct(*names), F.struct(version, "_new")).alias("_r")
    return both.groupBy(*keys).agg(last).select(*keys, "_r.*").select(*old.columns, *[c for c in new.columns if c not in old.columns])


def csv(df: DataFrame, path: str) -> None:
    """One file with a header; for summaries."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as text."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    if len(rows) == most:
        lines[2:2] = [f"The first {most} rows.", ""]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]) + "\n"


def canonical(value) -> str:
    """JSON with sorted keys, compact, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def sealed(value: dict, field: str = "self_hash") -> dict:
    """the document with a digest of itself without that field."""
    body = {k: v for k, v in value.items() if k != field}
    return body | {field: digest(body)}


def verify(value: dict, field: str = "self_hash") -> bool:
    return value.get(field) == digest({k: v for k, v in value.items() if k != field})


def atomic_json(path: str, value) -> None:
    """A driver-side document, whole or not at all."""
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False))
    os.replace(f.name, path)


def exclusive_json(path: str, value) -> None:
    """A marker that can be set once."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "x", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, ensure_ascii=False))


def backup(path: str) -> str | None:
    """A copy of a driver-side file under its content's digest."""
    if not os.path.exists(path):
        return None
    data = Path(path).read_bytes()
    to = f"{path}.{hashlib.sha256(data).hexdigest()[:12]}.bak"
    if not os.path.exists(to):
        Path(to).write_bytes(data)
    return to


def table_digest(spark: SparkSession, df: DataFrame) -> str:
    """Content digest of a table whatever its row order: rows hashed, hashes added up and mixed."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)") % 1_000_000_007).alias("s")).first()
    return digest([r.n, r.x, int(r.s or 0), df.dtypes])
