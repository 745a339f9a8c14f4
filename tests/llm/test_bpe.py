import hashlib

from vivaspark.llm import bpe, wordtok

ROWS = [None, "", " \n ", "the the  the", "Naïve don't <|endoftext|>x", "rare1 the rare2", "x" * 2000 + " the", "  the nbsp y", "the the  the"]


def expect(text):
    tok = wordtok.load()
    return tok.encode(text or "", add_special_tokens=False).ids


def check(spark, most_words):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(ROWS)] + [(0, None, "c"), (3, ROWS[3], "c"), (None, "the end", "c")], "doc_id long, text string, ids string")
    got = bpe.encode(docs, keep=["doc_id", "text", "ids"], most_words=most_words).collect()
    assert len(got) == len(ROWS) + 3
    for r in got:
        assert r.ids == expect(r.text), r
    back = bpe.decode(bpe.encode(docs, most_words=most_words)).collect()
    for r in back:
        assert r.decoded == wordtok.load().decode(expect(r.text), skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), most_words=most_words).count() == 0


def test_all_words_hot(spark):
    check(spark, 400_000)


def test_no_word_hot(spark):
    check(spark, 0)


def test_bounds_of_the_hot_table(spark):
    """A few hot words, a very long text of many blocks, a word without blanks of that size, and no rare word at all."""
    long = " ".join(f"w{i % 977} and{i % 13}" for i in range(300_000))
    texts = ["and and the", long, "y" * 40_000, "the and", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most_words in (2, 400_000):
        got = {r.doc_id: r for r in bpe.round_trip(docs, most_words=most_words).collect()}
        for i, t in enumerate(texts):
            assert got[i].ids_text == " ".join(map(str, expect(t))) and got[i].n_tokens == len(expect(t))
            assert got[i].decoded == wordtok.load().decode(expect(t), skip_special_tokens=False)
    only = spark.createDataFrame([(i, "the and " * 50) for i in range(40)], "doc_id long, text string")
    hot, rare = bpe.hot_table(only, wordtok.DEFAULT_TOKENIZER, 10, 1000)
    assert hot.column("word").to_pylist() == ["and", "the"] and rare == 0
    hot, rare = bpe.hot_table(only, wordtok.DEFAULT_TOKENIZER, 0, 1000)
    assert hot.num_rows == 0 and rare == 4000


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op2_bpe_round_trip(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = expect(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(wordtok.load().decode(ids, skip_special_tokens=False).encode()).hexdigest()
