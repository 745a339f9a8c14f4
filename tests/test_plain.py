"""Core queries without SQL against plain versions over their whole tables."""

import hashlib
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vivaspark.plans import registry


def test_nfkc_normalisation(spark, sf):
    def plain(text):
        lines = (" ".join(x.split()) for x in unicodedata.normalize("NFKC", text).splitlines())
        return hashlib.sha256("\n".join(x for x in lines if x).encode()).hexdigest()

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in registry.QUERIES["nfkc_normalisation"](spark, sf).collect()} == {(r.doc_id, plain(r.text)) for r in docs}


def test_leases_of_all_events(spark, sf):
    """A writer holds a session for an hour; others take it over after that, with the next epoch."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at")).collect()
    held, want = {}, Counter()
    for r in sorted(events, key=lambda r: (r["at"], r.event_type)):
        owner, until, epoch = held.get(r.user_id, (None, -1, 0))
        if owner == r.event_type and r["at"] <= until:
            said, until = "renewed", r["at"] + 3_600_000
        elif r["at"] > until:
            said, owner, until, epoch = "taken", r.event_type, r["at"] + 3_600_000, epoch + 1
        else:
            said = "refused"
        held[r.user_id] = (owner, until, epoch)
        want[r.user_id, r.event_type, r["at"], said, epoch] += 1
    rows = registry.QUERIES["stream_leases"](spark, sf).collect()
    assert Counter((r.user_id, r.writer, r.at_ms, r.decision, r.epoch) for r in rows) == want
    assert {k[3] for k in want} == {"renewed", "taken", "refused"}


def test_folds_keep_sources_whole_and_even(spark, sf):
    """Largest first, each to the fold with fewest documents, then fewest of its own languages."""
    sizes = defaultdict(Counter)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", "lang").collect():
        sizes[r.source][r.lang] += 1
    folds = [Counter() for _ in range(3)]
    want = {}
    for source, by in sorted(sizes.items(), key=lambda x: (-x[1].total(), x[0])):
        k = min(range(3), key=lambda f: (folds[f].total(), sum(folds[f][lang] * n for lang, n in by.items()), f))
        folds[k] += by
        want[source] = k
    assert {r.source: r.fold for r in registry.QUERIES["grouped_folds"](spark, sf).collect()} == want
