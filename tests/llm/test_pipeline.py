"""Each stage of the pipeline against a plain version over its own input, on the smallest tables."""

import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from vivaspark.llm import mixing, simhash, toxicity, wordtok  # noqa: E402


def plain_lines(rows):
    """Lines of each document without those of recurring templates: each line's templates, and the documents of each."""
    docs = {}

    def templates(line):
        words = re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(" ").split(" ")
        words = ["<*>" if re.search(r"[0-9@]|://", w) else w for w in words]
        n, out = len(words), []
        cuts = [0, n // 4, n // 2, 3 * n // 4, n]
        for free in range(4 if n >= 8 else 1):
            left = words if not free else words[: cuts[free]] + words[cuts[free + 1] :]
            fixed = sum(w != "<*>" for w in left)
            if n >= 3 and (fixed == n or n - fixed <= fixed and (free or fixed >= 3)):
                out.append((n, free, tuple(left), 2 if (n >= 8 if not free else fixed >= 16) else 5))
        return out

    for r in rows:
        for line in (r["text"] or "").split("\n"):
            for t in templates(line):
                docs.setdefault(t, set()).add(r["doc_id"])
    first = {t: min(ids) for t, ids in docs.items() if len(ids) >= t[3]}
    stays = lambda d, line: all(first.get(t, d) == d for t in templates(line))
    return {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if stays(r["doc_id"], x)) for r in rows}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicates", "mixing", "encoding"]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encoding":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = [r.asDict() for r in out.collect()]
        outs.append(rows)
        docs = spark.createDataFrame(rows, out.schema)
    start = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    clean, lines, single, mixed, coded = outs

    reader = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).reader()
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in start if reader.score(r["text"]) < toxicity.THRESHOLD}
    assert {r["doc_id"]: r["text"] for r in lines} == plain_lines(clean)

    prints = {r["doc_id"]: simhash.fingerprint(r["text"], 5) for r in lines}
    root = {f: f for f in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        least[find(f)] = min(d, least.get(find(f), d))
    assert {r["doc_id"] for r in single} == set(least.values())

    times = Counter(r["doc_id"] for r in mixed)
    size = {r["doc_id"]: len(r["text"].split()) for r in single}
    assert max(times.values()) <= 3 and set(times) <= set(size)
    by, got, source = Counter(), Counter(), {r["doc_id"]: r["source"] for r in single}
    for d, n in size.items():
        by[source[d]] += n
        got[source[d]] += n * times[d]
    want = mixing.targets(dict(by))
    assert all(abs(got[s] - want[s]) <= max(n for d, n in size.items() if source[d] == s) for s in by)

    assert Counter(r["doc_id"] for r in coded) == times
    text = {r["doc_id"]: r["text"] for r in single}
    for r in coded:
        assert [int(x) for x in r["ids"].split()] == wordtok.load().encode(text[r["doc_id"]], add_special_tokens=False).ids


def test_defined_cases(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows, shared ids and further columns, through every stage."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, long, None, None, None), (3, long, None, None, None), (4, "a few plain words", "en", "b", 17), (4, "another text of this id", "en", "b", 23), (None, "words without an id", None, "b", 3), (None, None, None, None, None), (5, "A FEW plain words", "en", "b", 17)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, _key string")
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        got.append([r.asDict() for r in docs.collect()])
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(got[-1], docs.schema)
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), sf).count() == 0
    clean, lines, single, mixed, coded = got
    assert len(clean) == len(lines) == len(rows)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in single) == sorted([(1, ""), (3, long), (4, "a few plain words"), (4, "another text of this id"), (0, "words without an id")])
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in single if r["text"]}
    assert sorted((r["doc_id"] or 0) for r in coded) == sorted((r["doc_id"] or 0) for r in mixed)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert len(rows) > 50 and all(r.n_tokens == len(r.ids.split()) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
