"""Sources with fixed schemas and row-level checks. Bad rows become violations, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.functions import text as X

RESUME = T.StructType([T.StructField(c, T.StringType()) for c in ("ID", "Resume_str", "Resume_prompt", "Category", "Resume_text_hash", "Prompt_truncated")])


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array (or lines) of rows of a known schema; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def with_order(df: DataFrame, *order: str) -> DataFrame:
    """D3: `turn_ord` within each episode from explicit order columns; file order is no order on a cluster."""
    return df.withColumn("turn_ord", F.row_number().over(Window.partitionBy("episode_id").orderBy(*order)) - 1)


def frame(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON or CSV by suffix."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def find_column(columns: list[str], candidates: list[str], what: str) -> str:
    """The first candidate that a column matches whatever its case."""
    known = {c.lower(): c for c in reversed(columns)}
    for c in candidates:
        if c.lower() in known:
            return known[c.lower()]
    raise ValueError(f"no column for {what} among {columns}")


def resumes(spark: SparkSession, path: str) -> DataFrame:
    """The CSV with newlines made uniform and an array `violations` of what is wrong with each row."""
    raw = spark.read.schema(RESUME).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return checked_resumes(raw)


def checked_resumes(raw: DataFrame) -> DataFrame:
    text = F.regexp_replace("Resume_str", "\r\n?", "\n")
    rows = raw.withColumn("Resume_str", text).withColumn("Resume_prompt", F.regexp_replace("Resume_prompt", "\r\n?", "\n"))
    per = lambda c: F.count("*").over(Window.partitionBy(c))
    digest = X.content_hash(F.col("Resume_str"))
    checks: list[tuple[Column, str]] = [
        (F.col("ID").isNull() | ~F.col("ID").rlike("^[A-Za-z0-9_-]{1,64}$"), "unsafe_id"),
        (F.col("Resume_str").isNull() | (F.length("Resume_str") < 100), "short_text"),
        (F.col("Resume_str").contains("�"), "replacement_character"),
        (F.col("Resume_str").rlike(X.EMAIL), "email"),
        (F.col("Resume_str").rlike(X.PHONE), "phone"),
        (F.col("Category").isNull() | (F.trim("Category") == ""), "no_category"),
        (~F.col("Resume_text_hash").eqNullSafe(digest), "wrong_hash"),
        (~F.col("Resume_prompt").eqNullSafe(X.prompt(F.col("Resume_str"))), "wrong_prompt"),
        (F.length("Resume_prompt") > 8000, "long_prompt"),
        (~F.col("Prompt_truncated").eqNullSafe((F.length("Resume_str") > 8000).cast("string")), "wrong_flag"),
        (F.col("_ids") > 1, "duplicate_id"),
        (F.col("_hashes") > 1, "duplicate_hash"),
    ]
    rows = rows.withColumn("_ids", per("ID")).withColumn("_hashes", per("Resume_text_hash"))
    why = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks]), lambda c: c.isNotNull())
    return rows.withColumn("violations", why).drop("_ids", "_hashes")


def in_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    """Rows of these categories; none at all is an error."""
    out = df.filter(F.col("Category").isin(categories))
    if out.isEmpty():
        raise ValueError(f"no rows of {categories}")
    return out


def job_descriptions(docs: DataFrame, path: str, text: str, deny: str = r"(?i)(^|/)(~\$|\.|draft)", least: int = 100) -> DataFrame:
    """All rows with `reason` null for those that stay: allowed name, long enough, first of their content."""
    digest = X.content_hash(F.col(text))
    why = F.when(F.col(path).rlike(deny), "name").when(F.coalesce(F.length(text), F.lit(0)) < least, "short")
    rows = docs.withColumn("content_hash", digest).withColumn("reason", why)
    first = F.row_number().over(Window.partitionBy("content_hash", F.col("reason").isNull()).orderBy(path))
    return rows.withColumn("reason", F.coalesce("reason", F.when(first > 1, "duplicate")))


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Path, size and digest of matching files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("file_hash"))


def inventory(found: DataFrame, required: DataFrame, asset: Column) -> DataFrame:
    """Each required row (asset, needed_for) with the files of that asset and their bytes; none is `exists` false. `asset` reads a file's asset from its path."""
    per = found.groupBy(asset.alias("asset")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return required.join(per, "asset", "left").na.fill(0, ["files", "bytes"]).withColumn("exists", F.col("files") > 0)


#: The largest document, in bytes, pages and characters of text.
MOST_BYTES, MOST_PAGES, MOST_CHARS = 10 << 20, 50, 200_000


def document_guard(content: Column, text: Column) -> Column:
    """Why a PDF document is refused, or null: not one, encrypted, too large, too many pages or too much text.

    Pages are counted by their page objects; `text` is what a reader made of it.
    """
    body = F.decode(content, "ISO-8859-1")
    checks = [(~body.startswith("%PDF-"), "not_pdf"), (F.octet_length(content) > MOST_BYTES, "too_large"), (body.contains("/Encrypt"), "encrypted"), (F.regexp_count(body, F.lit(r"/Type\s*/Page[^s]")) > MOST_PAGES, "too_many_pages"), (F.length(text) > MOST_CHARS, "too_much_text")]
    return F.coalesce(*[F.when(bad, F.lit(code)) for bad, code in checks])


def role_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (a, b) of ontology files."""
    raw = spark.read.schema("nodes array<string>, edges array<array<string>>").option("multiLine", True).json(path)
    return raw.select(F.explode("nodes").alias("node")), raw.select(F.explode("edges").alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))


def file_name_parts(name: Column, names: list[str], sep: str = "-") -> Column:
    """A struct of the parts of a file name, null unless it has them all."""
    parts = F.split(F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1), sep)
    return F.when(F.size(parts) == len(names), F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def stratified(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """N rows of each class in the order of a seeded hash."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key))
    return df.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")


def source_manifest(df: DataFrame, text: str, category: str) -> DataFrame:
    """Counts, distinct contents and categories."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(F.sha2(text, 256)).alias("distinct_texts"), F.array_join(F.sort_array(F.collect_set(category)), ",").alias("categories"))


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; filters and columns go down to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
