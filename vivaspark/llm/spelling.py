"""Spelling variants: words at distance one, by a symmetric-delete join, each with its commonest form.

1. Runs of letters become words and are counted. One occurrence in MISSPELT
   loses a letter, by a digest of document and word, so that a corpus has
   known misspellings.
2. Every word emits itself and its distinct single deletions. Two words at
   distance one share exactly one of these: the shorter word itself, or what is
   left without the letter that differs. An equi join on them gives candidates,
   and only those at distance exactly one stay.
3. A word's form is its commonest near word, if that is common enough. Counts
   double from word to form, so paths are short, and roots are found by joining
   the table of roots with itself until none changes.

As many words share a key as there are letters and places to insert one, so no
key is hot, whatever the corpus; nothing is broadcast or collected. Keys and
words above LONG letters travel as digests, keys by a hash that gives all
deletions of a word in one pass, so a run of a million letters costs a million
short rows. Their texts are joined back for the exact check, which is linear for them.

Defined results: null, empty and letterless texts have no words; null ids count
as the empty text; repeated rows count as often as they are there; ties go to
the smallest word by code points; other columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vivaspark.llm.common import cut, table

#: What words are made of, and the share of occurrences that lose a letter.
RUN, MISSPELT = "[A-Za-z\\u00C0-\\u00FF]+", 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters up to which words and keys travel as they are, and rows of keys in a batch.
LONG, BATCH = 64, 1 << 16
#: An odd number and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def occurrences(docs: DataFrame) -> DataFrame:
    """word: a row for each run of letters, lower-cased from A to Z, misspelt where the digest says so."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("r"))
    ascii_only = F.octet_length("r") == F.char_length("r")
    low = runs.select("d", F.when(ascii_only, F.lower("r")).otherwise(F.translate("r", UPPER, LOWER)).alias("r"))
    hashed = low.select("r", F.crc32(F.concat_ws(":", "d", "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("r")).cast("int")
    misspelt = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.char_length("r")))
    return hashed.select(F.when(F.col("h") % MISSPELT == 0, misspelt).otherwise(F.col("r")).alias("word"))


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """word and n of words of at least so many letters and occurrences."""
    return occurrences(docs).filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _hashed(size: int, value: int) -> str:
    return f"\x00{size}:{value:x}"


def _ref(word: str) -> str:
    """What a word travels as."""
    return word if len(word) <= LONG else "\x00" + hashlib.sha256(word.encode()).hexdigest()


def keys_of(word: str) -> list[str]:
    """A word and its distinct single deletions; those above LONG letters by a hash.

    Deleting any of a run of equal letters gives the same, so each run counts once.
    """
    n = len(word)
    starts = [i for i in range(n) if i == 0 or word[i] != word[i - 1]]
    short = [word[:i] + word[i + 1 :] for i in starts] if n - 1 <= LONG else []
    if n <= LONG:
        return [word, *short]
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
    upto = np.cumsum(code * powers)
    own = _hashed(n, int(upto[-1]))
    if short:
        return [own, *short]
    at = np.array(starts)
    without = upto[at] - (code * powers)[at] + (upto[-1] - upto[at]) * np.uint64(_INVERSE)
    return [own, *(_hashed(n - 1, v) for v in without.tolist())]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n -> key, ref, size, n."""
    names = ["key", "ref", "size", "n"]
    for b in batches:
        keys, rows = [], []
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = keys_of(word)
            rows += [(_ref(word), len(word), n)] * len(own)
            keys += own
            if len(keys) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, zip(*rows))], names=names).cast(_KEYS)
                keys, rows = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, zip(*rows))], names=names).cast(_KEYS)


_KEYS = pa.schema([("key", pa.string()), ("ref", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a; in time proportional to their length."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    low, high = 0, len(a)  # where they first differ, by halves of the rest
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([one_apart(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist())], pa.bool_()))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: words at distance exactly one, each pair once.

    words has distinct words; it is read three times.
    """
    keys = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_keys, "key string, ref string, size int, n long")
    a = keys.select("key", F.col("ref").alias("a"), F.col("size").alias("size_a"), F.col("n").alias("n_a"))
    b = keys.select("key", F.col("ref").alias("b"), F.col("size").alias("size_b"), F.col("n").alias("n_b"))
    ordered = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, "key").filter(ordered).drop("key")
    short = pairs.filter(F.col("size_b") <= LONG).select("a", "n_a", "b", "n_b")
    texts = words.filter(F.char_length("word") > LONG).select(F.concat(F.lit("\x00"), F.sha2("word", 256)).alias("ref"), "word")
    long = pairs.filter(F.col("size_b") > LONG).distinct()
    long = long.join(texts.select(F.col("ref").alias("b"), F.col("word").alias("text_b")), "b").join(texts.select(F.col("ref").alias("a"), F.col("word").alias("text_a")), "a", "left")
    long = long.select(F.coalesce("text_a", "a").alias("a"), "n_a", F.col("text_b").alias("b"), "n_b")
    return short.filter(F.levenshtein("a", "b", 1) == 1).union(long.mapInArrow(_close, long.schema)).distinct()


def forms(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, n, n_near, form_n for each row of words (word, n): its commonest near word, if that is `times` as common."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = words.join(near, "word", "left")
    enough = -F.col("best.m") >= times * F.col("n")
    return found.select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame, most_rounds: int = 40) -> DataFrame:
    """word and root of the rows that have a form: where following forms ends. Each round doubles the steps."""
    at = cut(found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs."""
    found = cut(forms(cut(vocabulary(docs, shortest, least)), times))
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters and three occurrences or more, with near words, forms and roots."""
    return variants(table(spark, sf_dir, "documents"))
