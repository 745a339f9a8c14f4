"""Rules for generated questions and for experience, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vivaspark.functions.text import alias_pattern

#: Words that support nothing, and how a request may begin.
STOP = (
    "and application approach behaviour behavior context creation data design development execution for from handling implementation into "
    "model monitoring operations performance planning process runtime selection system technical testing that the this through use using validation with work"
).split()
REQUESTS = ("analyze", "compare", "define", "describe", "design", "diagnose", "discuss", "evaluate", "explain", "identify", "outline", "show", "walk me through")
#: Opening and closing quotation marks, and aliases that name no skill by themselves.
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))
GENERIC = ("architecture", "validation activities", "testing and validation", "test and validation", "component selection", "design improvements")
#: Reasons against a question.
NO_QUESTION, MANY_CLAUSES = "question must be a non-empty interrogative", "question contains more than two assessment clauses"
TOO_LONG, REPEATED = "question exceeds 500 characters", "question duplicates accepted history"
UNSUPPORTED, OFF_PROFILE = "question has no lexical support from the target or JD evidence", "question introduces off-profile competencies: "
MOST_CHARS = 500


def stripped(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"(?U)\s+", " ")


def experience_tier(text: Column) -> Column:
    """Senior from 7 years named, Mid-Level from 2, else Fresher."""
    named = F.regexp_extract_all(F.lower(text), F.lit(r"\b(\d{1,2})\+?\s+years?\b"), 1)
    years = F.coalesce(F.array_max(F.transform(named, lambda x: x.cast("int"))), F.lit(0))
    return F.when(years >= 7, "Senior").when(years >= 2, "Mid-Level").otherwise("Fresher")


def _unquoted(text: Column) -> Column:
    """Without the first pair of marks that stands around it."""
    inner = stripped(F.substring(text, F.lit(2), F.length(text) - 2))
    around = [(F.length(text) >= 2) & F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b)) for a, b in QUOTES]
    return F.when(reduce(lambda a, b: a | b, around), inner).otherwise(text)


def unwrap_question(text: Column) -> Column:
    """a question without code fence, marks and label, its blanks single; the text itself is left as it is."""
    out = stripped(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?isU)\A```(?:text|markdown)?\s*+(.*?)\s*```\z", "$1")
    out = F.regexp_replace(_unquoted(stripped(out)), r"(?iU)\A(?:interview\s+)?question\s*:\s*", "")
    return single_spaced(_unquoted(stripped(out)))


def token_form(token: Column) -> Column:
    """a token in lower case without an ending of the plural."""
    v = F.regexp_replace(F.lower(token), r"\.+\z", "")
    n = F.length(v)
    return (
        F.when((n > 4) & v.endswith("ies"), F.concat(F.substring(v, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & v.rlike("(?:ches|shes|sses|xes|zes)$"), F.substring(v, F.lit(1), n - 2))
        .when((n > 3) & v.endswith("s") & ~v.endswith("ss"), F.substring(v, F.lit(1), n - 1))
        .otherwise(v)
    )


def support_tokens(texts: Column) -> Column:
    """distinct token forms of an array of texts that are no stop words, of three letters or technical (a digit, one of + # ., or C)."""
    raw = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"([A-Za-z0-9]+(?:[+#.][A-Za-z0-9+#.]*)*)"), 1)))
    forms = F.transform(raw, lambda t: F.struct(token_form(t).alias("form"), (t.rlike("[0-9+#.]") | (t == "C")).alias("technical")))
    kept = F.filter(forms, lambda x: ~x.form.isin(STOP) & ((F.length(x.form) >= 3) | x.technical))
    return F.array_distinct(F.transform(kept, lambda x: x.form))


def interrogative_reasons(question: Column) -> Column:
    """why a text is no question; one or two question marks are enough, or a request at its beginning."""
    marks = F.regexp_count(question, F.lit(r"\?"))
    request = F.lower(stripped(question)).rlike(r"^(?:(?:given|consider|assuming|suppose)\b.{0,300},\s*)?(?:please\s+)?(?:" + "|".join(REQUESTS) + r")\b")
    reason = F.when(F.coalesce(question, F.lit("")) == "", NO_QUESTION).when(marks > 2, MANY_CLAUSES).when((marks == 0) & ~request, NO_QUESTION)
    return F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason))


def mentioned(question: Column, aliases: Column | list[str]) -> Column:
    """Whether a text names one of some aliases as whole words."""
    return reduce(lambda a, b: a | b, [question.rlike(alias_pattern(a)) for a in aliases if a], F.lit(False))


def question_reasons(question: Column, skill: str, catalog: dict[str, tuple[str, list[str]]], allowed: list[str], support: Column, history: Column) -> Column:
    """F16: reasons against a question on a skill of the catalog (domain and aliases by name); none if it is grounded.

    support holds the texts it may rest on beside the skill's own names. Skills
    outside the profile may be named with the target if they share its domain.
    """
    q = single_spaced(F.coalesce(question, F.lit("")))
    domain, names = catalog[skill]
    tokens = support_tokens(F.concat(F.array(*map(F.lit, [skill, *names])), support))
    named = mentioned(q, [skill, *names])
    overlap = F.size(F.array_intersect(tokens, support_tokens(F.array(q))))
    known = F.transform(history, lambda h: single_spaced(F.lower(h)))
    others = []
    for other, (its, aliases) in sorted(catalog.items()):
        if other not in allowed:
            met = mentioned(q, [a for a in [other, *aliases] if a.lower() not in GENERIC])
            others.append(F.when(met & (~named if its == domain else F.lit(True)), F.lit(other)))
    off = F.array_compact(F.array(*others)) if others else F.array().cast("array<string>")
    more = [F.when(F.length(q) > MOST_CHARS, TOO_LONG), F.when(F.array_contains(known, F.lower(q)), REPEATED), F.when(~named & (overlap < 2), UNSUPPORTED), F.when(F.size(off) > 0, F.concat(F.lit(OFF_PROFILE), F.array_join(off, ", ")))]
    return F.concat(interrogative_reasons(q), F.array_compact(F.array(*more)))
