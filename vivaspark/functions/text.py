"""Text normalisation, detection and similarity as column expressions.

NFKC has no built-in; everything else stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The shapes of an e-mail address and of a telephone number.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
MARKER = "\n[...]\n"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def content_hash(text: Column) -> Column:
    """digest of the text in lower case with runs of blanks as one."""
    return F.sha2(F.lower(collapse(text)), 256)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """compatibility composition, one space between words, no blank lines."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        lines = [" ".join(x.split()) for x in unicodedata.normalize("NFKC", t).splitlines()]
        return "\n".join(x for x in lines if x)

    return text.map(one)


def head(text: Column, n: int) -> Column:
    """at most n characters from the front, cut at the last blank if there is one."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) <= n, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)^(.*)[ \n]", 1), F.lit("")), cut))


def tail(text: Column, n: int) -> Column:
    """at most n characters from the end, begun after the first blank if there is one."""
    cut = F.right(text, F.lit(n))
    return F.when(F.length(text) <= n, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)^[^ \n]*[ \n](.*)$", 1), F.lit("")), cut))


def prompt(text: Column, most: int = 8000, front: int = 6000) -> Column:
    """long texts keep their front and as much of their end as fits, a marker in between."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head(text, front), F.lit(MARKER), tail(text, most - front - len(MARKER))))


def strip_instructions(text: Column, pattern: str) -> Column:
    """lines that begin like an instruction go; an end marker follows."""
    return F.concat(F.regexp_replace(text, rf"(?im)^[ \t]*(?:{pattern})[^\n]*\n?", ""), F.lit("\n[END]"))


def domain_hits(text: Column, domains: dict[str, list[str]]) -> dict[str, Column]:
    """how many of each domain's keywords the text contains."""
    low = F.lower(text)
    return {d: sum((low.contains(k).cast("int") for k in words), F.lit(0)) for d, words in domains.items()}


def detect_domain(text: Column, domains: dict[str, list[str]], least: int = 3) -> Column:
    """the domain with most hits, `least` of them or more; the first named wins ties."""
    hits = domain_hits(text, domains)
    best = F.greatest(*hits.values())
    out = F.lit(None).cast("string")
    for d in reversed(list(hits)):
        out = F.when(hits[d] == best, d).otherwise(out)
    return F.when(best >= least, out)


def alias_pattern(alias: str) -> str:
    """an alias as a whole word, its blanks of any width, letter case ignored."""
    return r"(?i)(?<![a-z0-9])" + r"\s+".join(map(_quoted, alias.split())) + r"(?![a-z0-9])"


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def tokens(text: Column) -> Column:
    """F19."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def syllables(word: Column) -> Column:
    """vowel groups, a silent final e not counted, at least one."""
    n = F.regexp_count(word, F.lit("[aeiouy]+"))
    return F.greatest(n - F.when(word.rlike("[^aeiouy]e$") & (n > 1), 1).otherwise(0), F.lit(1))


def lexical_complexity(text: Column) -> Column:
    """mean syllables a word, 0 without words."""
    words = tokens(text)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + syllables(w))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(words)), F.lit(0.0))


def content_words(text: Column, stop: list[str]) -> Column:
    """Words of two letters, digits or underscores at least, in any script, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def ngram_counts(df: DataFrame, key: list[str], text: str, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """unigram and bigram counts of each row: (key..., term, n). A row's terms are counted within its own row."""
    words = df.select(*key, words(F.col(text)).alias("w"))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    return words.select(*key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))


def pair_cosine(df: DataFrame, key: list[str], a: str, b: str, ratio: float = 2.0, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """cosine of the two texts of each row under two-document tf-idf.

    idf is ln(n / df) + 1: a term of one text only weighs ln(ratio) + 1, one of
    both texts 1. With ratio 1.5 that is the smooth form, ln((1 + n) / (1 + df)) + 1.
    """
    left = ngram_counts(df, key, a, words).withColumnRenamed("n", "x")
    right = ngram_counts(df, key, b, words).withColumnRenamed("n", "y")
    both = left.join(right, [*key, "term"], "full").na.fill(0, ["x", "y"])
    idf = F.when((F.col("x") > 0) & (F.col("y") > 0), 1.0).otherwise(F.log(F.lit(ratio)) + 1)
    x, y = F.col("x") * idf, F.col("y") * idf
    sums = both.groupBy(*key).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    sim = F.coalesce(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0))
    return df.select(*key).join(sums.select(*key, sim.alias("similarity")), key, "left").na.fill(0.0, ["similarity"])


def history_cosine(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """pair_cosine's highest value over all earlier rows of the key, for every row that has any.

    Pairs meet through their shared terms; the weight of the others follows from
    the rows' own sums, so rows without a shared term never meet.
    """
    terms = ngram_counts(df, [key, order], text)
    total = terms.groupBy(key, order).agg(F.sum(F.col("n") * F.col("n")).alias("sum"))
    terms = terms.join(total, [key, order])
    now = terms.select(key, order, "term", F.col("n").alias("x"), F.col("sum").alias("xs"))
    then = terms.select(key, F.col(order).alias("before"), "term", F.col("n").alias("y"), F.col("sum").alias("ys"))
    met = now.join(then, [key, "term"]).filter(F.col("before") < F.col(order)).groupBy(key, order, "before")
    x, y = F.col("x"), F.col("y")
    sums = met.agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.first("xs").alias("xs"), F.first("ys").alias("ys"))
    rare = (F.log(F.lit(2.0)) + 1) ** 2
    norm = lambda own, shared: shared + rare * (own - shared)
    sim = F.col("xy") / F.sqrt(norm(F.col("xs"), F.col("xx")) * norm(F.col("ys"), F.col("yy")))
    most = sums.groupBy(key, order).agg(F.max(sim).alias("similarity"))
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    later = df.select(key, order).distinct().join(first, key).filter(F.col(order) > F.col("_first")).drop("_first")
    return later.join(most, [key, order], "left").na.fill(0.0, ["similarity"])


def safe_filename(name: Column) -> Column:
    """F23."""
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), 1, 120)


def register(spark) -> None:
    """SQL names for what is useful in queries."""
    spark.udf.register("nfkc_text", nfkc)
