"""Queries over texts, graphs and splits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vivaspark.functions import grounding as N
from vivaspark.functions import questions as Q
from vivaspark.functions import text as X
from vivaspark.operators import graph as G
from vivaspark.operators import selection as Z
from vivaspark.plans.base import query
from vivaspark.plans.metrics import six


@query(rf"SELECT doc_id, regexp_matches(text, '{X.EMAIL}') AS has_email, regexp_matches(text, '{X.PHONE}') AS has_phone FROM documents")
def pii_scan(t):
    return t.documents.select("doc_id", F.col("text").rlike(X.EMAIL).alias("has_email"), F.col("text").rlike(X.PHONE).alias("has_phone"))


@query(r"""
WITH d AS (SELECT doc_id, text, regexp_extract(substr(text, 1, 6000), '(?s)^(.*)[ \n]', 1) AS a, regexp_extract(right(text, 1993), '(?s)^[^ \n]*[ \n](.*)$', 1) AS b FROM documents)
SELECT doc_id, sha256(CASE WHEN length(text) <= 8000 THEN text ELSE coalesce(nullif(a, ''), substr(text, 1, 6000)) || E'\n[...]\n' || coalesce(nullif(b, ''), right(text, 1993)) END) AS prompt_hash, length(text) > 8000 AS truncated FROM d
""")
def prompt_truncation(t):
    return t.documents.select("doc_id", F.sha2(X.prompt(F.col("text")), 256).alias("prompt_hash"), (F.length("text") > 8000).alias("truncated"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '(?im)^[ \t]*(?:licensed under|this work is|all rights)[^\n]*\n?', '', 'g') || E'\n[END]') AS clean_hash FROM documents")
def injection_strip(t):
    return t.documents.select("doc_id", F.sha2(X.strip_instructions(F.col("text"), "licensed under|this work is|all rights"), 256).alias("clean_hash"))


_TOK = "regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"


@query(f"""
WITH w AS (SELECT conv_id, turn, unnest({_TOK}) AS w FROM conversations), s AS (SELECT conv_id, turn, len(regexp_extract_all(w, '[aeiouy]+')) AS n, regexp_matches(w, '[^aeiouy]e$') AS e FROM w),
m AS (SELECT conv_id, turn, avg(greatest(n - CASE WHEN e AND n > 1 THEN 1 ELSE 0 END, 1)) AS c FROM s GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(c, 0), 6) AS complexity FROM conversations LEFT JOIN m USING (conv_id, turn)
""")
def lexical_complexity(t):
    return t.conversations.select("conv_id", "turn", F.round(X.lexical_complexity(F.col("text")), 6).alias("complexity"))


def _said(t):
    return t.conversations.filter("role = 'assistant'").select("conv_id", "turn", "text")


def _turn_pairs(t):
    said = t.conversations.filter("role = 'assistant'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.select("conv_id", "turn", "text", before.alias("before")).filter("before IS NOT NULL")


_PAIRS = f"""
WITH p AS (SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'assistant') WHERE before IS NOT NULL),
k AS (SELECT conv_id, turn, 0 AS side, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w FROM p UNION ALL SELECT conv_id, turn, 1, regexp_extract_all(lower(before), '([a-z0-9]+)', 1) FROM p),
g AS (SELECT conv_id, turn, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM k),
c AS (SELECT conv_id, turn, term, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM g GROUP BY ALL),
i AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(2.0::DOUBLE) + 1 END AS f FROM c),
s AS (SELECT conv_id, turn, sum(x * f * y * f) / sqrt(sum(x * f * x * f) * sum(y * f * y * f)) AS sim FROM i GROUP BY ALL)
"""


@query(_PAIRS + "SELECT conv_id, turn, round(coalesce(CASE WHEN isnan(sim) THEN 0 ELSE sim END, 0), 6) AS similarity FROM p LEFT JOIN s USING (conv_id, turn)")
def tfidf_pair_cosine(t):
    return six(X.pair_cosine(_turn_pairs(t), ["conv_id", "turn"], "text", "before"), "similarity")


_HISTORY = """
WITH s AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM s) GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, b.turn AS before FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn < a.turn),
k AS (SELECT p.conv_id, p.turn, p.before, c.term, c.n AS x, 0 AS y FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn UNION ALL SELECT p.conv_id, p.turn, p.before, c.term, 0, c.n FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.before),
m AS (SELECT conv_id, turn, before, term, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM k GROUP BY ALL), i AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(2.0::DOUBLE) + 1 END AS f FROM m),
v AS (SELECT conv_id, turn, before, sum(x * f * y * f) AS xy, sum(x * f * x * f) * sum(y * f * y * f) AS z FROM i GROUP BY ALL)
"""


@query(_HISTORY + """, h AS (SELECT conv_id, turn, max(CASE WHEN z > 0 THEN xy / sqrt(z) ELSE 0 END) AS sim FROM p LEFT JOIN v USING (conv_id, turn, before) GROUP BY conv_id, turn)
SELECT conv_id, count(*) FILTER (sim >= 0.65) AS flagged, round(max(sim), 6) AS closest FROM h GROUP BY conv_id
""")
def history_similarity_flag(t):
    """turns of each conversation too like any earlier one of it."""
    sims = X.history_cosine(_said(t), "conv_id", "turn", "text")
    return sims.groupBy("conv_id").agg(F.count_if(F.col("similarity") >= 0.65).alias("flagged"), F.round(F.max("similarity"), 6).alias("closest"))


@query(_HISTORY + """SELECT conv_id, turn, round(max(CASE WHEN z > 0 THEN xy / sqrt(z) ELSE 0 END), 6) AS similarity, max(CASE WHEN z > 0 THEN xy / sqrt(z) ELSE 0 END) >= 0.65 AS flagged FROM p LEFT JOIN v USING (conv_id, turn, before) GROUP BY conv_id, turn
""")
def history_similarity_all(t):
    """Each turn's highest similarity to any earlier turn of its conversation."""
    sims = X.history_cosine(_said(t), "conv_id", "turn", "text")
    return six(sims.withColumn("flagged", F.col("similarity") >= 0.65), "similarity")


@query("""
WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS w FROM benchmark), c AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(string_agg(text, ' ')), '([a-z0-9]+)', 1)) AS w FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, item_id, count(*) AS common FROM (SELECT conv_id, unnest(w) AS x FROM c) JOIN (SELECT item_id, unnest(w) AS x FROM b) USING (x) GROUP BY ALL)
SELECT * FROM p WHERE common >= 12
""")
def set_overlap_pairs(t):
    words = lambda c: F.array_distinct(X.tokens(c)).alias("w")
    convs = t.conversations.groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).select("conv_id", words(F.col("text")))
    return G.overlapping(convs, t.benchmark.select("item_id", words(F.col("text"))), "conv_id", "item_id", "w", 12)


_STOP = ", ".join(f"'{w}'" for w in N.STOP)


@query(f"""
WITH p AS (SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'assistant') WHERE before IS NOT NULL),
k AS (SELECT conv_id, turn, 0 AS side, text AS x FROM p UNION ALL SELECT conv_id, turn, 1, before FROM p),
w AS (SELECT conv_id, turn, side, list_filter(regexp_extract_all(lower(x), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1), lambda v: v NOT IN ({_STOP})) AS w FROM k),
g AS (SELECT conv_id, turn, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT conv_id, turn, term, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM g GROUP BY ALL),
i AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS f FROM c),
v AS (SELECT conv_id, turn, sum(x * f * y * f) AS xy, sum(x * f * x * f) * sum(y * f * y * f) AS z FROM i GROUP BY ALL),
s AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' OR trim(before) = '' THEN 0 WHEN z > 0 THEN xy / sqrt(z) ELSE 0 END AS sim, CASE WHEN trim(text) = '' OR trim(before) = '' THEN 0 ELSE (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])the($|[^\\p{{L}}\\p{{N}}_])')::INT + regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])le($|[^\\p{{L}}\\p{{N}}_])')::INT) / 2.0 END AS cov FROM p LEFT JOIN v USING (conv_id, turn))
SELECT conv_id, turn, round(sim, 6) AS similarity, cov::DOUBLE AS coverage, CASE WHEN 0.7 * sim + 0.3 * cov >= 0.75 THEN 'A' WHEN 0.7 * sim + 0.3 * cov >= 0.55 THEN 'B' WHEN 0.7 * sim + 0.3 * cov >= 0.35 THEN 'C' WHEN 0.7 * sim + 0.3 * cov >= 0.15 THEN 'D' ELSE 'F' END AS grade FROM s
""")
def semantic_grade(t):
    """each assistant turn graded against the one before it."""
    out = N.semantic_grade(_turn_pairs(t), ["conv_id", "turn"], "text", "before", ["the", "le"])
    return six(out.drop("composite"), "similarity")


_CATALOG = {"License": ["licensed under", "license"], "The": ["the the"], "Negation": ["not", "nicht"], "Contact": ["mail", "phone"]}


@query("""
WITH c AS (SELECT doc_id, len(regexp_extract_all(t, '[^a-z0-9]licensed[ \\n]+under[^a-z0-9]')) + len(regexp_extract_all(t, '[^a-z0-9]license[^a-z0-9]')) AS a, len(regexp_extract_all(t, '[^a-z0-9]not[^a-z0-9]')) + len(regexp_extract_all(t, '[^a-z0-9]nicht[^a-z0-9]')) AS n
  FROM (SELECT doc_id, ' ' || replace(replace(replace(lower(text), ' ', '  '), E'\\n', E'\\n\\n'), 'licensed  under', 'licensed under') || ' ' AS t FROM documents))
SELECT doc_id, 'License' AS skill, a AS hits FROM c WHERE a > 0 UNION ALL SELECT doc_id, 'Negation', n FROM c WHERE n > 0
""")
def dictionary_evidence(t):
    out = G.evidence(t.documents, "doc_id", "text", {k: _CATALOG[k] for k in ("License", "Negation")})
    return out.select("doc_id", "skill", F.col("hits").cast("long").alias("hits"))


@query("""
SELECT doc_id, CASE WHEN a >= 3 AND a >= b THEN 'latin' WHEN b >= 3 THEN 'german' END AS domain FROM (SELECT doc_id,
  (contains(t, 'tion'))::INT + (contains(t, 'ment'))::INT + (contains(t, 'que'))::INT + (contains(t, 'ció'))::INT AS a, (contains(t, 'sch'))::INT + (contains(t, 'ung'))::INT + (contains(t, 'keit'))::INT + (contains(t, 'ü'))::INT AS b FROM (SELECT doc_id, lower(text) AS t FROM documents))
""")
def domain_detection(t):
    return t.documents.select("doc_id", X.detect_domain(F.col("text"), {"latin": ["tion", "ment", "que", "ció"], "german": ["sch", "ung", "keit", "ü"]}).alias("domain"))


_EDGES = "SELECT s_suppkey * 2 AS a, s_nationkey * 2 + 1 AS b FROM supplier UNION SELECT n_regionkey * 2 + 1001 AS a, n_nationkey * 2 + 1 AS b FROM nation WHERE n_name < 'J'"


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM b UNION SELECT r.node, b.b FROM r JOIN b ON r.reach = b.a)
SELECT node, min(reach) AS component FROM r GROUP BY node
""")
def connected_components(t):
    """Suppliers meet in their nations, nations with a name before J in their regions."""
    own = t.supplier.select((F.col("s_suppkey") * 2).cast("long").alias("a"), (F.col("s_nationkey") * 2 + 1).cast("long").alias("b"))
    regions = t.nation.filter("n_name < 'J'").select((F.col("n_regionkey") * 2 + 1001).cast("long").alias("a"), (F.col("n_nationkey") * 2 + 1).cast("long").alias("b"))
    return G.components(own.union(regions)).select("node", "component")


def _all_part_orders(t):
    return t.lineitem.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_orderkey") * 2 + 1).alias("b"))


@query()
def connected_components_all(t):
    """J14 over every line of every order; recursion is too slow for SQL here, tested by brute force."""
    return G.components(_all_part_orders(t)).select("node", "component")


@query()
def split_by_component(t):
    """Whole components to splits by remaining deficit; the component table is small."""
    found = G.components(_all_part_orders(t))
    sizes = [(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()]
    plan = G.largest_deficit_split(sizes, {"train": 0.7, "validation": 0.15, "test": 0.15})
    splits = t.spark.createDataFrame(list(plan.items()), "component long, split string")
    return found.join(splits, "component").select("node", "component", "split")


@query("""
WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source), source) AS i, count(*) OVER () AS n FROM g)
SELECT source, CASE WHEN i <= greatest(round(n * 0.7), 1) THEN 'train' WHEN i <= greatest(round(n * 0.7), 1) + greatest(round(n * 0.15), 1) THEN 'validation' ELSE 'test' END AS split FROM r
""")
def hash_group_split(t):
    return G.hash_split(t.documents, "source", 42, 0.7, 0.15)


@query("""
WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT c_nationkey, n / sum(n) OVER () * 1000 AS x FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, c_nationkey) AS r, 1000 - sum(floor(x)) OVER () AS l FROM x)
SELECT c_nationkey, CAST(floor(x) + (r <= l)::INT AS BIGINT) AS allocated FROM r
""")
def largest_remainder(t):
    return G.largest_remainder(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), F.col("n"), 1000, "c_nationkey").select("c_nationkey", "allocated")


@query("SELECT n_nationkey, n_name, min(s_suppkey) AS parent FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY ALL")
def prerequisite_hop(t):
    edges = t.supplier.select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") + 1000).alias("b"))
    given = t.supplier.select((F.col("s_suppkey") + 1000).alias("node")).union(t.nation.filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").cast("long")))
    found = G.hop(edges, given)
    return found.join(t.nation, F.col("node") == F.col("n_nationkey")).select("n_nationkey", "n_name", (F.col("parent") - 1000).alias("parent"))


@query("SELECT FALSE AS plain_graph, TRUE AS with_back_edge")
def cycle_check(t):
    edges = t.nation.select(F.col("n_regionkey").cast("long").alias("a"), (F.col("n_nationkey") + 100).cast("long").alias("b"))
    back = t.spark.createDataFrame([(100, 0)], "a long, b long")
    return t.spark.createDataFrame([(G.has_cycle(edges), G.has_cycle(edges.union(back)))], "plain_graph boolean, with_back_edge boolean")


@query()
def nfkc_normalisation(t):
    """no SQL; tested against the library."""
    return t.documents.select("doc_id", F.sha2(X.nfkc("text"), 256).alias("text_hash"))


@query(rf"""
SELECT conv_id, turn, len(regexp_extract_all(text, '\?')) > 2 AS many_clauses, text = '' OR (len(regexp_extract_all(text, '\?')) = 0 AND NOT regexp_matches(lower(trim(text)), '^(?:(?:given|consider|assuming|suppose)\b.{{0,300}},\s*)?(?:please\s+)?(?:{"|".join(Q.REQUESTS)})\b')) AS no_question,
  CASE WHEN y >= 7 THEN 'Senior' WHEN y >= 2 THEN 'Mid-Level' ELSE 'Fresher' END AS tier FROM (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(lower(text), '\b(\d{{1,2}})\+?\s+years?\b', 1), lambda x: x::INT)), 0) AS y FROM conversations)
""")
def interrogative_check(t):
    """F15, F12."""
    why = Q.interrogative_reasons(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.array_contains(why, Q.MANY_CLAUSES).alias("many_clauses"), F.array_contains(why, Q.NO_QUESTION).alias("no_question"), Q.experience_tier(F.col("text")).alias("tier"))


@query()
def classifier_selection(t):
    """§2.12: a text classifier of labels.quality, chosen on held-out groups of seven documents; predictions of the test groups."""
    rows = t.documents.join(t.labels, "doc_id").withColumn("group", F.floor(F.col("doc_id") / 7))
    predicted, _ = Z.select(rows, "doc_id", "group", "text", "quality")
    return predicted.select("model", "strength", "doc_id", "group", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
