"""Queries over sources, sinks and contracts."""

import uuid

from pyspark.sql import functions as F

from vivaspark.functions import audio as A
from vivaspark.functions import text as X
from vivaspark.plans.base import query
from vivaspark.session import shared_folder
from vivaspark.sources import pdf as P
from vivaspark.sources import readers as S
from vivaspark.sources import writers as W
from vivaspark.sources.cache import FeatureCache


@query("""
WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 THEN 'bad id!' ELSE 'doc-' || doc_id END AS id, sha256(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))) AS h, length(text) AS n FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS ids, count(*) OVER (PARTITION BY h) AS hs FROM r)
SELECT code, count(*) AS n FROM (SELECT unnest([CASE WHEN id = 'bad id!' THEN 'unsafe_id' END, CASE WHEN n < 100 THEN 'short_text' END, CASE WHEN ids > 1 THEN 'duplicate_id' END, CASE WHEN hs > 1 THEN 'duplicate_hash' END]) AS code FROM c) WHERE code IS NOT NULL GROUP BY code
""")
def resume_validation(t):
    d = t.documents
    rows = d.select(F.when(F.col("doc_id") % 17 == 0, "bad id!").otherwise(F.concat(F.lit("doc-"), "doc_id")).alias("ID"), F.col("text").alias("Resume_str"), X.prompt(F.col("text")).alias("Resume_prompt"), F.col("source").alias("Category"), X.content_hash(F.col("text")).alias("Resume_text_hash"), (F.length("text") > 8000).cast("string").alias("Prompt_truncated"))
    codes = S.checked_resumes(rows).select(F.explode("violations").alias("code")).filter(F.col("code").isin("unsafe_id", "short_text", "duplicate_id", "duplicate_hash", "wrong_hash", "wrong_flag"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT page_id, lpad(page_id::VARCHAR, 9, '0') AS path, sha256(lower(trim(regexp_replace(html, '[ \\t\\r\\n]+', ' ', 'g')))) AS h, CASE WHEN page_id % 13 = 0 THEN 'name' WHEN length(html) < 1500 THEN 'short' END AS why FROM pages),
d AS (SELECT coalesce(why, CASE WHEN row_number() OVER (PARTITION BY h, why IS NULL ORDER BY path) > 1 THEN 'duplicate' END, 'kept') AS reason FROM r)
SELECT reason, count(*) AS n FROM d GROUP BY reason
""")
def job_description_scan(t):
    rows = t.pages.select(F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("draft"), F.lpad(F.col("page_id").cast("string"), 9, "0"))).otherwise(F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("path"), "html")
    return S.job_descriptions(rows, "path", "html", least=1500).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, count(DISTINCT sha256(text)) AS distinct_texts, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories FROM documents")
def source_manifest(t):
    return S.source_manifest(t.documents, "text", "lang")


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type, value FROM events")
def json_round_trip(t):
    """Rows appended as JSON lines and read back with their schema."""
    path = _folder(t, "json")
    rows = t.events.select("event_id", "event_type", "value")
    W.ledger(rows, path)
    return t.spark.read.schema(rows.schema).option("mode", "FAILFAST").json(path)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS revision FROM customer")
def session_upsert(t):
    old = t.customer.select("c_custkey", "c_acctbal", F.lit(1).alias("revision"))
    new = old.filter("c_custkey % 10 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("revision"))
    stale = old.filter("c_custkey % 7 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal"), F.lit(0).alias("revision"))
    return W.upsert(old, new.union(stale), ["c_custkey"], "revision")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second FROM part WHERE len(string_split(p_name, ' ')) = 2")
def name_attributes(t):
    """Attributes parsed from names, malformed ones left out."""
    parts = S.file_name_parts(F.col("p_name"), ["first", "second"], " ")
    return t.part.select("p_partkey", parts.alias("x")).filter("x IS NOT NULL").select("p_partkey", "x.*")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) <= 10")
def stratified_sample(t):
    """Ten rows of each source by a seeded hash."""
    return S.stratified(t.documents, "source", "doc_id", 10, 42).select("source", "doc_id")


@query("SELECT 'doc-' || doc_id AS id, source AS category, length(replace(text, chr(13), '')) AS chars FROM documents WHERE source IN ('src0', 'src1') AND text <> '' AND NOT contains(text, chr(13))")
def csv_scan(t):
    """Texts with line ends and quotes written as CSV, scanned with their checks, two categories kept."""
    d = t.documents.filter(F.col("text") != "").filter(~F.col("text").contains("\r"))
    path = _folder(t, "resumes") + ".csv"
    cells = {"ID": F.concat(F.lit("doc-"), "doc_id"), "Resume_str": F.col("text"), "Resume_prompt": X.prompt(F.col("text")), "Category": F.col("source"), "Resume_text_hash": X.content_hash(F.col("text")), "Prompt_truncated": (F.length("text") > 8000).cast("string")}
    d.select(*[v.alias(k) for k, v in cells.items()]).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    out = S.in_categories(S.resumes(t.spark, path), ["src0", "src1"])
    return out.select(F.col("ID").alias("id"), F.col("Category").alias("category"), F.length("Resume_str").alias("chars"))


@query("SELECT o_orderpriority AS dataset_split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def split_folder(t):
    """A folder a split; the reader of one opens no other."""
    path = _folder(t, "splits")
    W.splits(t.orders.withColumn("dataset_split", F.col("o_orderpriority")), path)
    own = t.spark.read.parquet(f"{path}/dataset_split=1-URGENT").withColumn("dataset_split", F.lit("1-URGENT"))
    return own.groupBy("dataset_split").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT * FROM (VALUES ('AFRICA', TRUE), ('ASIA', TRUE), ('ATLANTIS', FALSE)) AS v(region, present)")
def asset_inventory(t):
    """Files below a folder against a table of what is required."""
    path = _folder(t, "assets")
    t.region.write.partitionBy("r_name").parquet(path)
    needed = t.spark.createDataFrame([(r, "report") for r in ("AFRICA", "ASIA", "ATLANTIS")], "asset string, needed_for string")
    found = S.inventory(S.files(t.spark, path, "*.parquet"), needed, F.regexp_extract("path", "r_name=([^/]+)/", 1))
    return found.select(F.col("asset").alias("region"), F.col("exists").alias("present"))


@query("SELECT r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def role_graph_scan(t):
    """A graph written as JSON documents, one a region, read back as edges between its nodes."""
    path = _folder(t, "graph")
    pairs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.array("r_name", "n_name")).alias("edges"), F.concat(F.array(F.first("r_name")), F.collect_list("n_name")).alias("nodes"))
    pairs.select("nodes", "edges").write.json(path)
    raw = t.spark.read.schema("nodes array<string>, edges array<array<string>>").json(path)
    known = raw.select(F.explode("nodes").alias("b")).distinct()
    return raw.select(F.explode("edges").alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")).join(known, "b", "left_semi")


@query("""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'not_pdf' WHEN page_id % 5 = 1 THEN 'encrypted' WHEN page_id % 60 > 50 THEN 'too_many_pages' END AS reason FROM pages
""")
def document_guards(t):
    """Bodies that stand for documents of page_id % 60 pages."""
    k = F.col("page_id") % 5
    body = F.concat(F.when(k == 0, "PK").otherwise("%PDF-1.7\n"), F.when(k == 1, "/Encrypt 1 0 R\n").otherwise(""), F.repeat(F.lit("<< /Type /Page /Parent 2 0 R >>\n"), (F.col("page_id") % 60).cast("int")), F.lit("<< /Type /Pages /Count 1 >>"))
    return t.pages.select("page_id", S.document_guard(F.encode(body, "ISO-8859-1"), F.col("html")).alias("reason"))


@query("""
WITH r AS (SELECT doc_id, octet_length(encode(text)) AS n, [8000, 16000, 44100][doc_id % 3 + 1] AS rate, doc_id % 2 + 1 AS channels, doc_id % 7 AS k FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 'undecodable' WHEN k = 1 THEN 'empty' WHEN k > 2 AND n / (rate * channels * 2.0) > 300 THEN 'too_long' ELSE 'accepted' END AS outcome,
  CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 0 WHEN k = 2 THEN n ELSE n + 44 + CASE WHEN k > 4 THEN 14 ELSE 0 END END AS bytes, CASE WHEN k > 2 THEN 'wav' END AS kind, CASE WHEN k > 2 THEN rate END AS rate, CASE WHEN k > 2 THEN round(n / (rate * channels * 2.0)::DOUBLE, 9) END AS seconds FROM r
""")
def audio_sources(t):
    """Texts as the samples of recordings, some with a chunk before their data, some no recordings."""
    d = F.col("doc_id")
    data = F.encode("text", "utf-8")
    rate = F.when(d % 3 == 0, 8000).when(d % 3 == 1, 16000).otherwise(44100)
    channels, k = d % 2 + 1, d % 7

    def little(x, n):
        h = F.lpad(F.hex(x.cast("long")), 16, "0")
        return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(n)]))

    tag = lambda s: F.encode(F.lit(s), "utf-8")
    form = [tag("fmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), little(rate * channels * 2, 4), little(channels * 2, 2), little(F.lit(16), 2)]
    # A chunk of five bytes is padded to six.
    note = F.when(k > 4, F.concat(tag("LIST"), little(F.lit(5), 4), tag("notes "))).otherwise(F.unhex(F.lit("")))
    wav = F.concat(tag("RIFF"), little(F.octet_length(data) + 36, 4), tag("WAVE"), *form, note, tag("data"), little(F.octet_length(data), 4), data)
    text = F.when(k == 0, "not base64!").when(k == 1, "data:audio/wav;base64,").when(k == 2, F.base64(data)).when(k == 3, F.concat(F.lit("data:audio/wav;base64,"), F.base64(wav))).otherwise(F.base64(wav))
    rows = A.recordings(t.documents.select("doc_id", F.regexp_replace(text, "[\\r\\n]", "").alias("recording")), "recording", ["doc_id"])
    return rows.withColumn("seconds", F.round("seconds", 9))


@query("""
WITH f AS (SELECT doc_id, text, len(string_split(text, ' ')) AS words, len(text) AS chars FROM documents)
SELECT doc_id, words, chars, (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 1) AS first_run, (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 1)) AS second_run, 0 AS third_run FROM f
""")
def feature_cache(t):
    """Filled by half of the documents, then by all, then by all again, which computes nothing."""
    cache = FeatureCache(t.spark, f"{shared_folder(t.spark)}/cache-{uuid.uuid4().hex}", "v1", {"words": "long", "chars": "long"})
    count = lambda df: df.select("digest", F.size(F.split("content", " ")).alias("words"), F.length("content").alias("chars"))
    runs = [cache.fill(d, F.col("text"), count) for d in (t.documents.filter("doc_id % 2 = 1"), t.documents, t.documents)]
    out = cache.of(t.documents.select("doc_id", "text"), F.col("text"), count)
    return out.select("doc_id", "words", "chars", *[F.lit(n).cast("long").alias(f"{k}_run") for k, n in zip(("first", "second", "third"), runs)])


@query(r"""
WITH r AS (SELECT doc_id, regexp_replace(text, '[\x00-\x20\x7F-\xA0\x{2000}-\x{200F}\x{2028}-\x{202F}\x{3000}]+', '', 'g') AS t, doc_id % 11 AS k, doc_id % 60 AS n FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 'not_pdf' WHEN k = 1 THEN 'encrypted' WHEN n > 50 THEN 'too_many_pages' WHEN n = 0 THEN 'no_pages' WHEN t = '' THEN 'no_text' END AS reason,
  CASE WHEN k > 1 AND n BETWEEN 1 AND 50 AND t <> '' THEN n END AS pages, CASE WHEN k > 1 AND n BETWEEN 1 AND 50 AND t <> '' THEN md5(t) END AS digest FROM r
""")
def document_text(t):
    """Every text written as a PDF of up to 59 pages, the first with the text, and read back; blanks don't count."""
    k, n = F.col("doc_id") % 11, (F.col("doc_id") % 60).cast("int")
    obj = lambda i, body: F.concat(F.lit(f"{i} 0 obj\n"), body, F.lit("\nendobj\n"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*")))
    shown = F.concat(F.lit("BT /F1 9 Tf 20 800 Td\n"), F.array_join(lines, "\n"), F.lit("\nET"))
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    kids = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat((i + 9).cast("string"), F.lit(" 0 R"))), " ")
    page = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat((i + 9).cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R"), F.when(i == 1, " /Contents 3 0 R").otherwise(""), F.lit(" >>\nendobj\n")))
    body = F.concat(
        F.when(k == 0, "PK").otherwise("%PDF-1.7\n"),
        obj(1, F.lit("<< /Type /Catalog /Pages 2 0 R >>")),
        obj(2, F.concat(F.lit("<< /Type /Pages /Resources << /Font << /F1 4 0 R >> >> /Kids ["), F.when(n > 0, kids).otherwise(""), F.lit("] >>"))),
        obj(3, F.concat(F.lit("<< /Length "), F.length(shown).cast("string"), F.lit(" >>\nstream\n"), shown, F.lit("\nendstream"))),
        obj(4, F.lit("<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>")),
        obj(5, F.lit(f"<< /Length {len(cmap)} >>\nstream\n{cmap}\nendstream")),
        F.when(n > 0, F.array_join(page, "")).otherwise(""),
        F.when(k == 1, "trailer << /Root 1 0 R /Encrypt 9 0 R >>").otherwise("trailer << /Root 1 0 R >>"),
    )
    found = P.texts(t.documents.select("doc_id", F.encode(body, "ISO-8859-1").alias("pdf")), "pdf", ["doc_id"])
    bare = F.regexp_replace("text", "[\\x00-\\x20\\x7F-\\xA0\\u2000-\\u200F\\u2028-\\u202F\\u3000]+", "")
    return found.select("doc_id", "reason", F.col("pages").cast("long").alias("pages"), F.md5(bare).alias("digest"))
