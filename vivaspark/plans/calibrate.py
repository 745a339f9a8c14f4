"""Queries over replay, calibration, grounding and reports."""

from pyspark.sql import functions as F

from vivaspark.functions import grounding as N
from vivaspark.functions import rules as U
from vivaspark.operators import belief as B
from vivaspark.operators import calibrate as C
from vivaspark.plans.base import query
from vivaspark.plans.belief import _FOLD, _turns
from vivaspark.plans.metrics import _PRED, _predictions, six


@query()
def replay_episodes(t):
    """W02 on events: a user's rows are an episode, 'error' ends it; scores go missing now and then."""
    rows = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("skill"), F.when(F.col("event_id") % 11 != 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("score"), (F.col("event_type") == "error").alias("stop"))
    return six(C.replay(rows, "user_id", "at", "skill", "score", "stop"), "entropy_before", "entropy_after", "evidence", "gain", "reward")


@query(f"SELECT split, count(*) AS rows, CASE WHEN split <> 'test' THEN count(*) FILTER (y = p) END AS hits, CASE WHEN split <> 'test' THEN count(*) FILTER (p IS NULL) END AS abstained FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM ({_PRED})) GROUP BY split")
def split_report(t):
    k = F.col("doc_id") % 3
    rows = _predictions(t).withColumn("split", F.when(k == 0, "train").when(k == 1, "validation").otherwise("test"))
    return C.split_summary(rows, "split", "y", "p")


@query(f"""
WITH r AS (SELECT y, coalesce(p, 3) AS p FROM ({_PRED})), c AS (SELECT unnest(range(4)) AS c), m AS (SELECT c, (SELECT count(*) FROM r WHERE y = c AND p = c)::DOUBLE AS h, (SELECT count(*) FROM r WHERE y = c) AS t, (SELECT count(*) FROM r WHERE p = c) AS g FROM c),
s AS (SELECT h, t, coalesce(h / nullif(g, 0), 0) AS pr, coalesce(h / nullif(t, 0), 0) AS re FROM m WHERE t + g > 0)
SELECT round(sum(h) / sum(t), 6) AS accuracy, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS f1 FROM s
""")
def macro_metrics(t):
    out = C.macro(_predictions(t).withColumn("p", F.coalesce("p", F.lit(3))), "y", "p")
    return six(out, *out.columns)


@query("""
WITH d AS (SELECT doc_id, source, doc_id % 3 AS split, n_chars / 8000 AS score, text FROM documents), k AS (SELECT source FROM d GROUP BY source HAVING count(DISTINCT split) > 1),
q AS (SELECT source, count(text) - count(DISTINCT text) AS r FROM d GROUP BY source)
SELECT count(*) AS rows, count(DISTINCT source) AS episodes, count(DISTINCT source) AS components, count(*) FILTER (score IS NULL) AS without_score, count(*) FILTER (NOT score BETWEEN 0 AND 1) AS out_of_range, (SELECT count(*) FROM k) AS leaking, (SELECT CAST(sum(r) AS BIGINT) FROM q) AS repeated_questions, 'few_episodes,leak,score_range' AS warnings FROM d
""")
def raw_evidence_audit(t):
    rows = t.documents.select(F.col("source").alias("ep"), F.col("source").alias("comp"), (F.col("doc_id") % 3).alias("split"), F.sha2("text", 256).alias("q"), (F.col("n_chars") / 8000).alias("score"))
    return C.raw_evidence(rows, "ep", "comp", "split", "q", "score", 100, 10)


@query("SELECT vec_id, round(a / (a + b + c), 6) AS p0, 0.0::DOUBLE AS p3 FROM (SELECT vec_id, exp(embedding[1]::DOUBLE * 2) AS a, exp(embedding[2]::DOUBLE * 2) AS b, exp(embedding[3]::DOUBLE * 2) AS c FROM embeddings)")
def masked_policy(t):
    """Softmax at temperature one half over the first four entries, the fourth illegal."""
    x = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    p = C.masked_softmax(x, F.array(*[F.lit(v) for v in (1, 1, 1, 0)]), 0.5)
    return t.embeddings.select("vec_id", p.alias("p")).select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.get("p", F.lit(3)).alias("p3"))


@query()
def calibration_search(t):
    """Staged candidates scored on users' terminal beliefs; the best of the last stage run."""
    truth = t.events.select("user_id").distinct().withColumn("y", (F.col("user_id") % 3).cast("int"))
    base = B.BeliefConfig()
    stages = [[base, C.shrink_scales(B.BeliefConfig(scales=(0.1, 0.2, 0.3)), 0.5)], [B.BeliefConfig(low_bias=x) for x in (0.5, 1.0)]]
    return C.search(_turns(t), "user_id", "event_type", ["ts", "event_id"], truth, stages, 0.3)


@query()
def cross_validated(t):
    """Three folds of whole users, each predicted by a fit on the other two."""
    truth = t.events.select("user_id").distinct().withColumn("y", (F.col("user_id") % 3).cast("int"))
    out = C.cross_validate(_turns(t), "user_id", "event_type", ["ts", "event_id"], "score", truth, (F.col("user_id") / 3).cast("int") % 3)
    return six(out, "confidence")


@query(_FOLD + "SELECT user_id, event_type, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, n, round(ess, 6) AS ess FROM z")
def checkpoint_restore(t):
    """The beliefs of all events survive their JSON form."""
    held = B.skill_beliefs(_turns(t), "user_id", "event_type", ["ts", "event_id"])
    out = C.restored(C.checkpoint(held, "user_id", "event_type"), "user_id", "event_type")
    return out.select("user_id", "event_type", *[F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)], F.col("n").cast("long").alias("n"), F.round("ess", 6).alias("ess"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS ess FROM events GROUP BY ALL")
def checkpoint_restore_all(t):
    """Beliefs of all events survive their JSON form."""
    e = t.events.groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("n"), F.sum("value").alias("ess"))
    rows = e.select("user_id", "event_type", F.array(F.lit(0.2), F.lit(0.8)).alias("p"), "n", "ess")
    return C.restored(C.checkpoint(rows, "user_id", "event_type"), "user_id", "event_type").select("user_id", "event_type", F.col("n").cast("long").alias("n"), F.round("ess", 4).alias("ess"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, 'tion')) AS n, instr(text, 'tion') - 1 AS first, TRUE AS holds FROM documents WHERE contains(text, 'tion')")
def evidence_spans(t):
    """All places of a pattern; each span's text stands where it says."""
    rows = t.documents.filter(F.col("text").contains("tion")).select("doc_id", "text", N.spans(F.col("text"), "tion").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).start.cast("long").alias("first"), N.spans_hold(F.col("text"), F.slice("s", 1, 5)).alias("holds"))


@query("SELECT doc_id, lang IN ('en', 'de') AS kept FROM documents WHERE lang IN ('en', 'de') INTERSECT SELECT doc_id, TRUE FROM labels")
def labelled_in_languages(t):
    """An IN list, intersected with the labelled ones."""
    return t.documents.filter(F.col("lang").isin("en", "de")).select("doc_id", F.lit(True).alias("kept")).intersect(t.labels.select("doc_id", F.lit(True)))


@query("SELECT CAST(coalesce(max(turn), 0) AS BIGINT) AS last_turn, count(*) AS turns FROM conversations")
def next_question_index(t):
    """A48 over all conversations."""
    return t.conversations.agg(F.coalesce(F.max("turn"), F.lit(0)).cast("long").alias("last_turn"), F.count("*").alias("turns"))


@query("SELECT conv_id, CAST(coalesce(max(turn), 0) AS BIGINT) AS last_turn, count(*) AS turns FROM conversations GROUP BY conv_id")
def next_question_index_all(t):
    """A48 of every conversation."""
    return t.conversations.groupBy("conv_id").agg(F.coalesce(F.max("turn"), F.lit(0)).cast("long").alias("last_turn"), F.count("*").alias("turns"))


@query("SELECT c_nationkey, c_mktsegment AS domain FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def mode_alphabetical(t):
    """Commonest, then alphabetical."""
    per = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return per.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), F.col("c_mktsegment"))).alias("domain"))


@query("""
SELECT conv_id, turn, 'Describe skill ' || conv_id || '.' AS question FROM conversations WHERE turn = 0 AND ('0x' || substr(sha256(conv_id::VARCHAR), 1, 8))::BIGINT % 3 = 0
UNION ALL SELECT conv_id, turn, 'How did you use skill ' || conv_id || '?' FROM conversations WHERE turn = 0 AND ('0x' || substr(sha256(conv_id::VARCHAR), 1, 8))::BIGINT % 3 = 1
UNION ALL SELECT conv_id, turn, 'Describe skill ' || conv_id || '.' FROM conversations WHERE turn = 0 AND ('0x' || substr(sha256(conv_id::VARCHAR), 1, 8))::BIGINT % 3 = 2
""")
def fallback_questions(t):
    """the third template was asked already."""
    skill = F.concat(F.lit("skill "), F.col("conv_id").cast("string"))
    q = N.fallback_question(["Describe {skill}.", "How did you use {skill}?", "Why {skill}?"], F.col("conv_id").cast("string"), skill, F.array(F.concat(F.lit("Why "), skill, F.lit("?"))))
    return t.conversations.filter("turn = 0").select("conv_id", "turn", q.alias("question"))


_GRADED = "SELECT event_id, user_id, event_type, value, event_id % 5 <> 0 AS answered, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS valid, CASE WHEN event_id % 7 <> 0 THEN value / 100 END AS score, CASE WHEN event_id % 11 = 0 THEN ts END AS deleted FROM events"


@query(f"SELECT event_id FROM ({_GRADED}) WHERE answered AND valid AND score IS NOT NULL")
def replay_evidence(t):
    """What a replay may read."""
    e = F.col("event_id")
    valid = F.when(e % 3 != 0, e % 3 == 1)
    return t.events.filter(C.replay_evidence(valid, F.when(e % 7 != 0, F.col("value") / 100), e % 5 == 0)).select("event_id")


@query(f"SELECT event_id FROM ({_GRADED}) WHERE event_type = 'click' AND deleted IS NULL")
def owned_rows(t):
    """P10: an owner's rows that are not deleted."""
    return t.events.filter(C.owned(F.col("event_type"), "click", F.when(F.col("event_id") % 11 == 0, F.col("ts")))).select("event_id")


@query(f"""
WITH r AS (SELECT *, coalesce(lang, 'None') AS scope FROM ({_PRED}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)), g AS (SELECT scope, count(*) AS n, count(p) AS classified, sum(coalesce(abs(y - p), 2)) / count(*) AS ordinal_mae FROM r GROUP BY scope),
m AS (SELECT scope, c, count(*) FILTER (y = c AND p = c)::DOUBLE AS hit, count(*) FILTER (y = c) AS t, count(*) FILTER (p = c) AS g FROM r, range(3) q(c) GROUP BY ALL), s AS (SELECT scope, c, hit, g, coalesce(hit / nullif(t, 0), 0) AS rec, coalesce(hit / nullif(g, 0), 0) AS prec FROM m)
SELECT scope, any_value(n) AS n, any_value(classified) AS classified, round(sum(hit) / any_value(n), 6) AS accuracy, round(avg(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0)), 6) AS macro_f1, round(avg(rec), 6) AS balanced_accuracy, round(any_value(ordinal_mae), 6) AS ordinal_mae FROM s JOIN g USING (scope) GROUP BY scope
""")
def scope_report(t):
    """Metrics of every scope, languages here."""
    rows = _predictions(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    out = C.report(rows, "y", "p", "lang")
    return six(out.select("scope", "n", "classified", "accuracy", "macro_f1", "balanced_accuracy", "ordinal_mae"), "accuracy", "macro_f1", "balanced_accuracy", "ordinal_mae")


@query("SELECT l_returnflag AS kind, greatest(2000 - count(*), 0) AS short FROM lineitem GROUP BY l_returnflag")
def feasibility(t):
    """What each kind lacks of a need."""
    have = {r.l_returnflag: r["count"] for r in t.lineitem.groupBy("l_returnflag").count().collect()}
    return t.spark.createDataFrame(sorted(C.feasibility(have, dict.fromkeys(have, 2000)).items()), "kind string, short long")


@query("SELECT event_id, round(value / (value + 25), 6) AS saturated, round(CASE WHEN abs(event_id % 4 * 10) < 1e-6 THEN 0 ELSE (value - event_id % 4 * 10) / nullif(event_id % 4 * 10, 0) END::DOUBLE, 6) AS deviation FROM events")
def compression(t):
    """F31, F37."""
    base = (F.col("event_id") % 4 * 10).cast("double")
    return t.events.select("event_id", F.round(U.saturate(F.col("value"), 25.0), 6).alias("saturated"), F.round(U.deviation(F.col("value"), base), 6).alias("deviation"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:12], lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '(?i)\b(engineer|developer|analyst|manager|scientist|designer)\b') AND length(x) <= 80) AS t, lang FROM documents)
SELECT doc_id, coalesce(t[1], upper(coalesce(lang, 'general')[1]) || lower(coalesce(lang, 'general')[2:]) || ' role') AS title FROM l
""")
def role_titles(t):
    """a title line, else one from the domain."""
    return t.documents.select("doc_id", N.role_title(F.col("text"), F.col("lang")).alias("title"))


@query(r"""
WITH s AS (SELECT doc_id, text, instr(text, 'tion') - 1 AS a FROM documents WHERE contains(text, 'tion')), w AS (SELECT doc_id, lower(substr(text, greatest(a - 160, 0) + 1, 4 + 240)) AS x FROM s)
SELECT doc_id, CASE WHEN regexp_matches(x, 'required|must have|mandatory|essential') THEN 1 WHEN regexp_matches(x, 'preferred|nice to have|bonus|plus') THEN 2 ELSE 3 END AS priority FROM w
""")
def evidence_priority(t):
    """priority of a text's first span, by the words around it."""
    rows = t.documents.filter(F.col("text").contains("tion")).select("doc_id", "text", F.get(N.spans(F.col("text"), "tion"), F.lit(0)).alias("s"))
    return rows.select("doc_id", N.priority(F.col("text"), F.col("s.start"), F.col("s.end")).alias("priority"))


@query("SELECT vec_id, CASE WHEN s >= 0.75 THEN 'A' WHEN s >= 0.55 THEN 'B' WHEN s >= 0.35 THEN 'C' WHEN s >= 0.15 THEN 'D' ELSE 'F' END AS grade FROM (SELECT vec_id, 0.7::DOUBLE * (vec_id % 11) / 10 + 0.3::DOUBLE * ((vec_id % 2 = 0)::INT + (vec_id % 3 = 0)::INT) / 2 AS s FROM embeddings)")
def letter_grade(t):
    """the letter of a given similarity and the keywords that an answer names as whole words."""
    answer = F.concat(F.when(F.col("vec_id") % 2 == 0, "Caching ").otherwise("uncaching "), F.when(F.col("vec_id") % 3 == 0, "sharding.").otherwise("resharding"))
    score = F.lit(0.7) * (F.col("vec_id") % 11) / 10 + F.lit(0.3) * N.keyword_coverage(answer, ["caching", "sharding"])
    return t.embeddings.select("vec_id", N.letter(score).alias("grade"))
