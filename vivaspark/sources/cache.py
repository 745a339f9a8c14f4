"""Features that are computed once: a cache keyed by content digest and code version."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class FeatureCache:
    """A folder of features by digest, one for each version of the code.

    Digests that the folder lacks are found by an anti join; only their contents,
    each once, are computed and appended, as a batch of files of its own. Two
    writers may add a digest twice; readers take one row of it. A row with null
    content has null features.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str, features: dict[str, str]):
        self.spark, self.path, self.features = spark, f"{folder}/version={version}", features
        self.schema = ", ".join(["digest string", *(f"{n} {t}" for n, t in features.items())])

    def rows(self) -> DataFrame:
        """What is cached: digest and features, a digest once."""
        if not _there(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        kept = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        first = F.min(F.struct(*self.features)).alias("_f")
        return kept.groupBy("digest").agg(first).select("digest", "_f.*")

    def missing(self, df: DataFrame, content: Column) -> DataFrame:
        """digest and content of what is not cached, each once."""
        own = df.select(F.sha2(content.cast("string"), 256).alias("digest"), content.alias("content")).filter("content IS NOT NULL")
        new = own.join(self.rows().select("digest"), "digest", "left_anti")
        return new.groupBy("digest").agg(F.first("content").alias("content"))

    def fill(self, df: DataFrame, content: Column, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Compute what is missing; compute() gets digest and content and returns digest and the features. How many that were."""
        made = compute(self.missing(df, content)).select("digest", *[F.col(n).cast(t).alias(n) for n, t in self.features.items()])
        batch = f"{self.path}/batch-{uuid.uuid4().hex}"
        made.write.parquet(batch)
        return self.spark.read.schema(self.schema).parquet(batch).count()

    def of(self, df: DataFrame, content: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """df with the features of its contents, after filling what is missing."""
        self.fill(df, content, compute)
        return df.withColumn("digest", F.sha2(content.cast("string"), 256)).join(self.rows(), "digest", "left").drop("digest")
