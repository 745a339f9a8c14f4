"""Document evidence and question checks as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vivaspark.functions import text as X

#: Words that carry no support.
STOP = "a an and are as at be by can do for from how in is it of on or that the this to was what when which with would you your".split()


def spans(text: Column, pattern: str) -> Column:
    """(start, end, text) of every match of a plain-text pattern; offsets by walking the split text.

    Built-ins give all matches but not where they stand; the pieces between
    them do, as lengths that add up.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern)
    start = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, p: a + F.length(p))
    return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("text")))


def spans_hold(text: Column, found: Column) -> Column:
    """every span's text stands at its place."""
    return F.forall(found, lambda s: F.substring(text, s.start + 1, s.end - s.start) == s.text)


def priority(text: Column, start: Column, end: Column, before: int = 160, after: int = 80) -> Column:
    """1 required, 2 preferred, 3 neither, by the words around a span; required wins."""
    around = F.lower(F.substring(text, F.greatest(start - before, F.lit(0)) + 1, (end - start) + before + after))
    return F.when(around.rlike("required|must have|mandatory|essential"), 1).when(around.rlike("preferred|nice to have|bonus|plus"), 2).otherwise(3)


def role_title(text: Column, domain: Column) -> Column:
    """the first of the first twelve lines that reads like a title, else one made from the domain."""
    lines = F.slice(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), 1, 12)
    titles = F.filter(lines, lambda x: x.rlike(r"(?i)\b(engineer|developer|analyst|manager|scientist|designer)\b") & (F.length(x) <= 80))
    return F.coalesce(F.get(titles, F.lit(0)), F.concat(F.initcap(F.coalesce(domain, F.lit("general"))), F.lit(" role")))


def packet(skill: Column, found: Column) -> Column:
    """A skill with its first three spans in order."""
    return F.struct(skill.alias("skill"), F.slice(F.array_sort(found), 1, 3).alias("evidence"))


def fallback_question(templates: list[str], seed: Column, skill: Column, history: Column) -> Column:
    """templates in an order rotated by a digest, the first not yet asked, null when all were."""
    n = len(templates)
    shift = F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    texts = F.array(*[F.replace(F.lit(t), F.lit("{skill}"), skill) for t in templates])
    turned = F.concat(F.slice(texts, shift + 1, F.lit(n)), F.slice(texts, F.lit(1), shift))
    return F.get(F.filter(turned, lambda q: ~F.array_contains(history, q)), F.lit(0))


#: The least composite score of each letter.
GRADES = {"A": 0.75, "B": 0.55, "C": 0.35, "D": 0.15}


def keyword_coverage(answer: Column, keywords: list[str]) -> Column:
    """Share of the keywords that stand in an answer as whole words; 1 without any."""
    if not keywords:
        return F.lit(1.0)
    low = F.lower(answer)
    return sum((low.rlike(rf"(?U)\b{re.escape(k.lower())}\b").cast("int") for k in keywords), F.lit(0)) / float(len(keywords))


def letter(score: Column) -> Column:
    """The letter of a composite score."""
    out = None
    for name, least in GRADES.items():
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("F")


def semantic_grade(df: DataFrame, key: list[str], answer: str, reference: str, keywords: list[str], stop: list[str] = STOP) -> DataFrame:
    """key, similarity, coverage, composite (0.7 and 0.3 of them) and grade of each answer against its reference.

    Similarity is the cosine of unigrams and bigrams under smooth idf, without
    stop words. Where either text is blank, all is zero and the grade F.
    """
    alike = X.pair_cosine(df, key, reference, answer, 1.5, lambda c: X.content_words(c, stop))
    said = ~(F.coalesce(F.trim(answer), F.lit("")) == "") & ~(F.coalesce(F.trim(reference), F.lit("")) == "")
    rows = df.select(*key, said.alias("_said"), keyword_coverage(F.col(answer), keywords).alias("_c")).join(alike, key)
    score = {c: F.when(F.col("_said"), F.col(f)).otherwise(0.0) for c, f in (("similarity", "similarity"), ("coverage", "_c"))}
    rows = rows.withColumns(score).withColumn("composite", 0.7 * F.col("similarity") + 0.3 * F.col("coverage"))
    return rows.select(*key, "similarity", "coverage", "composite", letter(F.col("composite")).alias("grade"))
