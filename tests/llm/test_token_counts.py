import random
import time

import numpy as np
from pyspark.sql import functions as F

from vivaspark.llm import token_counts as tc
from vivaspark.llm import wordtok

TEXTS = [None, "", "  \n", "Hello WÖRLD don't we'll '!s 12,345", "a<|endoftext|>b", "étude İstanbul ΣΑΣ naïve", "日本語テキスト" * 5, "x" * 700, "!!!???" * 40, "</w>a</w> <|startoftext", "tab\tline\r\nfeed\x0bvt nbsp\x1fus"]


def test_every_prefix_equals_the_library():
    counter, tok, rng = tc.PrefixCounter(), wordtok.load(), random.Random(5)
    fuzz = ["".join(rng.choice("abeinotrsTHE'ré0$%, .\n") for _ in range(60)) for _ in range(60)]
    for text in [*TEXTS, *fuzz]:
        t = text or ""
        want = [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert counter.prefix_counts(text).tolist() == want, text


def test_recomposed_words_equal_the_library():
    """Decomposed letters, stray marks, Hangul in parts, singletons, specials and other blanks, in every prefix."""
    counter, tok, rng = tc.PrefixCounter(), wordtok.load(), random.Random(8)
    parts = ["e\u0301", "\u0301", "\u0323", "a\u0323\u0302", "\u1112\u1161\u11ab", "\u212b", "\u0915\u093c", "\u09c7\u09be", "'s", "'", "x", "Q", "!", "9", "\u00a0", "\x1f", "<|endoftext|>", "<|endof", "\u6f22", "\ud55c", "\u0130", "\u1e9b\u0323", "\U0001f600", "\u0378"]
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(250)] + [("e\u0301" * 90) + "a\u0323\u0302", "\u1112\u1161\u11ab" * 60, "!\u0323\u0301" * 70]
    for text in words:
        want = [len(tok.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, text


def test_long_words_take_time_in_proportion():
    counter, tok = tc.PrefixCounter(), wordtok.load()
    for text in ("\u6f22\u5b57" * 25_000 + "e\u0301", "e\u0301" * 25_000, "ab<|endoftext|>" * 4000):
        began = time.process_time()
        got = counter.prefix_counts(text)
        assert time.process_time() - began < 10
        assert got[-1] == len(tok.encode(text, add_special_tokens=False).ids)


def test_budget_is_the_longest_prefix():
    counts = np.array([0, 1, 2, 3, 2, 3, 4])
    assert tc.longest_within(counts, 2) == 4


def test_query_counts_as_the_library(spark, sf):
    tok = wordtok.load()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = tc.op4_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_tokens == len(tok.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 2048) and r.n_bytes == len(docs[r.doc_id].encode())


def test_defined_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] * 2 + [(None, "the", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tc.count_tokens(docs, budget=3, with_prefixes=True)
    assert got.count() == len(rows)
    assert got.filter("doc_id is null and n_tokens = 1").count() == 1
    assert got.filter(F.col("doc_id") == 0).first().n_tokens == 0
    assert tc.count_tokens(docs.limit(0), 3).count() == 0


def test_totals_and_fits_are_those_of_the_table():
    """Odd words, at budgets on both sides of their totals, with memories so small that words leave them."""
    counter, rng = tc.PrefixCounter(max_totals=3), random.Random(4)
    parts = ["é", "́", "ab", "The", "'s", "'", "9", "!", " ", "\x1f", "\t", "\r\n", "  ", "<|endoftext|>", "<|endof", "漢", "İ", "naïve", "tion"]
    texts = [*TEXTS, *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400))]
    for text in texts:
        counts = counter.prefix_counts(text)
        for budget in (0, 1, 3, 9, 2048):
            assert counter.within(text, budget) == (counts[-1], tc.longest_within(counts, budget)), (text, budget)


def test_totals_need_no_table(monkeypatch):
    def table(self, text):
        raise AssertionError("a text's whole table was made for its total")

    monkeypatch.setattr(tc.PrefixCounter, "prefix_counts", table)
    assert tc.PrefixCounter().within("some plain words of a text", 3)[0] == len(wordtok.load().encode("some plain words of a text", add_special_tokens=False).ids)
