"""Line dedup by a tree of log templates, in DataFrame functions only.

Every line is parsed to a fixed depth: its token count, its leading tokens (the
first quarter of them), then the other quarters. Tokens with a digit, an at
sign or :// are fields from the start, put as <*>; letter case and runs of
blanks do not count. A line with LONG_LINE tokens or more hangs at four leaves
below its leading tokens: at the one of its exact form, and at three where one
of the later quarters is a field too. So lines that differ in a word, or in a
run of words within a quarter, meet in one template, whatever the words are,
without comparing pairs.

A template that recurs in several documents keeps its lines in the document
with the smallest doc_id and loses them in all others. It recurs when it stands
in at least 2 documents if it is sure, in SHORT_DOCS if not. An exact template
is sure from LONG_LINE tokens on, one with a free quarter from twice as many
fixed tokens on. Lines under LEAST_TOKENS tokens, and templates with fewer than
3 fixed tokens or more fields than fixed tokens, stay.

Leaves are 96-bit digests with positions. They are grouped with partial
aggregation, so a line of millions of documents costs a row a task. Lines find
their recurring templates by digest: templates with a thousandth of all lines
or more, a few thousand at most, are broadcast, so no key left to the shuffle
is hot. Texts cross one shuffle, by their row key, to meet their dropped places.

Defined results: null text stays null with no lines; an empty text has one
empty line; equal rows (doc_id and text) are one document and get equal
results; rows without doc_id count as one document that comes after all
others; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vivaspark.llm.common import cut, join_by_key, table

LONG_LINE = 8
SHORT_DOCS = 5
LEAST_TOKENS = 3
#: Stands for the missing doc_id: the last of all.
NO_ID = (1 << 63) - 1

_BLANKS = "\t\x0b\f\r"
_FIELDS = (*"0123456789@", "://")
#: A token with a field's mark, from its first character on.
_FIELD_TOKEN = r"(?<![^ ])[^ ]*(?:[0-9@]|://)[^ ]*"


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later filters and projections read, but do not compute again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _spaced(text: Column) -> Column:
    """Lower case, every run of blanks within a line one space."""
    low = F.lower(text)
    other = reduce(or_, [text.contains(c) for c in _BLANKS])
    plain = F.when(other, F.translate(low, _BLANKS, " " * len(_BLANKS))).otherwise(low)
    return F.when(other | text.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def _parsed(docs: DataFrame) -> DataFrame:
    """Rows of _id, _key and text -> _id, _key, place, line (fields masked) and tokens; lines of too few tokens are left out."""
    lines = docs.select("_id", "_key", _spaced(F.col("text")).alias("text")).select("_id", "_key", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    lines, plain = _once(lines, "plain", F.trim("raw")), F.col("plain")
    # Twelve searches for a string cost a quarter of one for a pattern.
    fields = reduce(or_, [plain.contains(c) for c in _FIELDS])
    masked = F.when(fields, F.regexp_replace(plain, _FIELD_TOKEN, "<*>")).otherwise(plain)
    out = _once(lines.select("_id", "_key", "place", "plain"), "line", masked).select("_id", "_key", "place", "line", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("tokens"))
    return out.filter(F.col("tokens") >= LEAST_TOKENS)


def _marks(x: Column) -> Column:
    """How often the mark of a field stands in x."""
    return F.when(x.contains("<*>"), ((F.length(x) - F.length(F.replace(x, F.lit("<*>"), F.lit("")))) / 3).cast("int")).otherwise(0)


def _leaves(parsed: DataFrame) -> DataFrame:
    """_id, _key, place and `leaves`: an array of (h1, h2, few) or null, few where SHORT_DOCS documents are asked for."""
    n = F.col("tokens")
    quarter = [(k * n / 4).cast("int") for k in range(4)]
    words = lambda k: F.call_function("substring_index", "line", F.lit(" "), k)
    # The beginnings that end, and the ends that begin, where a quarter does.
    parts = {"p0": F.col("line"), "p1": words(quarter[1]), "p2": words(quarter[2]), "p3": words(quarter[3]), "s2": words(quarter[2] - n), "s3": words(quarter[3] - n)}
    own = _once(parsed, "p", F.struct(*[v.alias(k) for k, v in parts.items()]))
    own = _once(own.select("_id", "_key", "place", "tokens", "p.*"), "m", F.struct(*[_marks(F.col(k)).alias(k) for k in parts]))

    def leaf(free: int, names: list[str], held: Column) -> Column:
        """The leaf where a quarter is free (0: none), of the parts that are left, `held` tokens."""
        marks = sum((F.col(f"m.{p}") for p in names), F.lit(0))
        left, fields = held - marks, n - held + marks
        good = (fields == 0) | ((left >= 3) & (fields <= left)) if not free else (n >= LONG_LINE) & (fields <= left)
        few = n < LONG_LINE if not free else left < 2 * LONG_LINE
        return F.when(good, F.struct(F.xxhash64(F.lit(free), n, *names).alias("h1"), F.hash(F.lit(free), n, *names).alias("h2"), few.alias("few")))

    all_ = [leaf(0, ["p0"], n), leaf(1, ["p1", "s2"], n - quarter[2] + quarter[1]), leaf(2, ["p2", "s3"], n - quarter[3] + quarter[2]), leaf(3, ["p3"], quarter[3])]
    return own.select("_id", "_key", "place", F.array(*all_).alias("leaves"))


def dropped_places(docs: DataFrame, key: list[Column]) -> DataFrame:
    """_id, _key, and the array `_drop` of line numbers that go, for documents that lose any."""
    lines = cut(_leaves(_parsed(docs.select(*key, "text"))))
    leaves = lines.select("_id", "_key", "place", F.inline("leaves")).filter("few IS NOT NULL")
    # Two documents are enough for the sure templates; the documents of the others are counted.
    sure = leaves.filter("NOT few").groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("*").alias("n")).filter("first < last")
    per_doc = leaves.filter("few").groupBy("h1", "h2", "_id").agg(F.count("*").alias("n"))
    other = per_doc.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= SHORT_DOCS)
    recurring = cut(sure.select("h1", "h2", "first", "n").union(other.select("h1", "h2", "first", "n")))
    lost = join_by_key(leaves.drop("few"), recurring, ["h1", "h2"], "n", lines.count()).filter("_id <> first").select("_id", "_key", "place")
    return lost.groupBy("_id", "_key").agg(F.collect_set("place").alias("_drop"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` less its recurring lines, and n_lines and n_dropped."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_key")]
    lost = dropped_places(docs.select("doc_id", "text"), key)
    # The caller's columns go by numbers meanwhile, so none can meet one of ours.
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)], *key, F.col("text").alias("_text"))
    out = rows.join(lost.select("_id", "_key", F.array_sort("_drop").alias("_drop")), ["_id", "_key"], "left")
    n = F.coalesce(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    dropped = F.coalesce(F.size("_drop"), F.lit(0))
    # What is left are the runs of lines before, between and after those that go, each taken once.
    lines = F.when(F.col("_drop").isNotNull(), F.split("_text", "\n"))
    out = _once(out.select(*[c for c in out.columns if c not in ("_id", "_key")], n.cast("long").alias("_n"), dropped.cast("long").alias("_nd")), "_lines", lines)
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get("_drop", k - 1) + 1)
    runs = F.transform(F.sequence(F.lit(0), F.size("_drop")), lambda k: F.slice("_lines", begin(k) + 1, F.coalesce(F.get("_drop", k), F.size("_lines")) - begin(k)))
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return out.select(*[kept.alias("text") if c == "text" else F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], F.col("_n").alias("n_lines"), F.col("_nd").alias("n_dropped"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs)


ORACLE_SQL = rf"""
WITH lines AS (
  SELECT coalesce(doc_id, {NO_ID}) AS id, text, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), plain AS (
  SELECT *, string_split(trim(regexp_replace(lower(line), '[ \t\x0B\f\r]+', ' ', 'g')), ' ') AS words FROM lines
), masked AS (
  SELECT id, text, place, list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '<*>' ELSE t END) AS w, len(words) AS n FROM plain WHERE len(words) >= {LEAST_TOKENS}
), leaves AS (
  SELECT id, text, place, n, free, CASE free WHEN 0 THEN w WHEN 1 THEN w[:n // 4] || ['<*>'] || w[n // 2 + 1:] WHEN 2 THEN w[:n // 2] || ['<*>'] || w[3 * n // 4 + 1:] ELSE w[:3 * n // 4] || ['<*>'] END AS template
  FROM masked, (SELECT unnest([0, 1, 2, 3]) AS free) WHERE free = 0 OR n >= {LONG_LINE}
), counted AS (
  SELECT *, len(template) - len(string_split(array_to_string(template, ' '), '<*>')) + 1 AS fixed FROM leaves
), good AS (
  SELECT * FROM counted WHERE CASE WHEN free = 0 THEN fixed = n OR (fixed >= 3 AND n - fixed <= fixed) ELSE n - fixed <= fixed END
), recurring AS (
  SELECT n, free, template, min(id) AS first FROM good GROUP BY ALL
  HAVING count(DISTINCT id) >= CASE WHEN any_value(CASE WHEN free = 0 THEN n ELSE fixed // 2 END) >= {LONG_LINE} THEN 2 ELSE {SHORT_DOCS} END
), lost AS (
  SELECT DISTINCT l.id, l.text, l.place FROM good l JOIN recurring r ON l.n = r.n AND l.free = r.free AND l.template = r.template WHERE l.id <> r.first
), kept AS (
  SELECT a.id, a.text, string_agg(a.line, chr(10) ORDER BY a.place) FILTER (WHERE l.place IS NULL) AS left_over, count(l.place) AS n_dropped
  FROM (SELECT DISTINCT id, text, place, line FROM lines) a LEFT JOIN lost l ON a.id = l.id AND a.text = l.text AND a.place = l.place GROUP BY a.id, a.text
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.left_over, '') END AS text,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN kept k ON coalesce(d.doc_id, {NO_ID}) = k.id AND d.text = k.text
"""
