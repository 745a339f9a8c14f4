import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from vivaspark.llm import byte_bpe

ROWS = [None, "", " ", " \n\t ", "it's  the 's ''s  　x", "naïve 😀😀 日本語、text", "x" * 3000, "a\u0085 b c \x1c d", "don't <|endoftext|> 12345", ". \x1c; \x1dfoo \x1c. ", "it's  the 's ''s  　x"]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(), special_tokens={})


def test_equals_tiktoken_and_back(spark, plain):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(ROWS)] + [(None, "the end", None)], "doc_id long, text string, ids string")
    got = byte_bpe.encode(docs, keep=["doc_id", "text", "ids"]).collect()
    assert len(got) == len(ROWS) + 1
    for r in got:
        assert r.ids == plain.encode_ordinary(r.text or ""), r
    for r in byte_bpe.decode(byte_bpe.encode(docs)).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"ids": "_in"}).withColumn("_c0", docs.doc_id).withColumn("a.b", docs.text)
    assert {tuple(r.ids) for r in byte_bpe.encode(clash).collect()} == {tuple(r.ids) for r in got}


def test_offsets_cover_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(ROWS)), "doc_id long, text string")
    pieces = {r: t for t, r in byte_bpe.ranks_of().items()}
    for r in byte_bpe.encode(docs, offsets=True).collect():
        text, at = r.text or "", 0
        for i, start, end in zip(r.ids, r.starts, r.ends):
            assert pieces[i] in text[start:end].encode()
            assert start <= at <= end
            at = end
        assert at == len(text)


def test_split_characters(spark, plain):
    ids = plain.encode_ordinary("😀日本")
    rows = [(i, ids[:i]) for i in range(len(ids) + 1)] + [(-1, None), (-2, [ids[0], None, 10**6, -5])]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    for r in byte_bpe.decode(df, as_text=True).collect():
        want = plain.decode(ids[: r.k]) if r.k >= 0 else "" if r.k == -1 else plain.decode(ids[:1])
        assert r.decoded == want


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(plain, seed):
    """Runs, periods and odd characters, as whole texts and in short slices."""
    rng = random.Random(seed)
    tokens = [t.decode("utf-8", "ignore") for t in byte_bpe.ranks_of()]
    coder = byte_bpe._coder(byte_bpe.DEFAULT_RANKS)
    texts = []
    for _ in range(3000):
        unit = "".join(rng.choices("ab =-_hn.*#é ~\n\t0'sl 　日😀", k=rng.randint(1, 4)))
        texts.append(rng.choice(tokens) + unit * rng.randint(1, 30) + "".join(rng.choices(tokens, k=rng.randint(0, 6))))
    rows, stops = coder.encode(texts, 1)
    for i, t in enumerate(texts):
        assert rows[stops[i] : stops[i + 1], 0].tolist() == plain.encode_ordinary(t), t
        parts = list(byte_bpe.slices(t, 5))
        assert "".join(parts) == t and sum(map(plain.encode_ordinary, parts), []) == plain.encode_ordinary(t), t


def test_long_text(spark, plain):
    long = " ".join(f"word{i % 977}, and {i % 13}" for i in range(200_000)) + "日本語。" * 100_000
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, keep=["doc_id"]).collect()}
    assert got[1].ids_text == " ".join(map(str, plain.encode_ordinary(long))) and bytes(got[1].decoded) == long.encode()


def test_query(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = byte_bpe.op12_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = plain.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
