"""Text classifiers chosen on held-out groups: term weights, logistic regression and linear support vectors.

Everything is fitted by pyspark.ml over partitions of the rows; what reaches the
driver are models of a fixed number of hashed terms and one row of metrics a
candidate. Groups are never parted between training, validation and test.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vivaspark.operators.graph import hash_split

#: Strengths that are tried; regularisation is one over strength and rows.
STRENGTHS = (0.1, 1.0, 10.0)
#: Hashed terms, the documents that a term needs, and steps of a fit.
TERMS, LEAST_DOCS, STEPS = 1 << 14, 2, 8


def macro_metrics(df: DataFrame, truth: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro precision, recall and F1 over the classes of truth, a class without guesses having precision 0."""
    both = df.groupBy(*by, truth, prediction).agg(F.count("*").alias("n"))
    hit = F.when(F.col(truth) == F.col(prediction), F.col("n")).otherwise(0)
    real = both.groupBy(*by, F.col(truth).alias("_c")).agg(F.sum("n").alias("t"), F.sum(hit).alias("h"))
    said = both.groupBy(*by, F.col(prediction).alias("_c")).agg(F.sum("n").alias("g"))
    per = real.join(said, [*by, "_c"], "left").na.fill(0, ["g"])
    recall, precision = F.col("h") / F.col("t"), F.coalesce(F.try_divide("h", "g"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    return per.groupBy(*by).agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(precision).alias("macro_precision"), F.avg(recall).alias("macro_recall"), F.avg(f1).alias("macro_f1"))


def terms(column: str = "text") -> Pipeline:
    """Words and pairs of words of a text column, hashed, weighted by rarity and scaled to length one, in `features`."""
    words = SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce({column}, '')), '([\\\\p{{L}}\\\\p{{N}}_]{{2,}})', 1) AS _w FROM __THIS__")
    pairs = NGram(n=2, inputCol="_w", outputCol="_p")
    both = SQLTransformer(statement="SELECT *, concat(_w, _p) AS _t FROM __THIS__")
    return Pipeline(stages=[words, pairs, both, HashingTF(numFeatures=TERMS, inputCol="_t", outputCol="_tf"), IDF(minDocFreq=LEAST_DOCS, inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")])


def select(df: DataFrame, key: str, group: str, text: str, label: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Predictions of the test rows by the best model of each family, and a row of validation metrics a candidate.

    Labels are numbers from 0; rows with null label, text or group are left out.
    Weights balance the classes. In a family the best by macro F1, accuracy and
    weaker strength wins on validation groups; test groups are only predicted.
    """
    rows = df.select(key, group, F.col(text).alias("text"), F.col(label).cast("double").alias("label")).dropna(subset=[group, "text", "label"])
    rows = hash_split(rows, group, seed, 0.7, 0.15).select(group, "split").join(rows, group)
    train = rows.filter("split = 'train'")
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}  # a row a class
    if len(counts) < 2 or rows.select("split").distinct().count() < 3:
        raise ValueError("training needs two classes, and each part a group")
    n = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col("label") == c, n / (len(counts) * k)) for c, k in counts.items()])
    made = terms().fit(train)
    keep = [key, group, "split", "label", "features"]
    ready = made.transform(rows).select(*keep).withColumn("weight", weight).persist()
    try:
        fitted, found = {}, []
        for strength in STRENGTHS:
            loss = {"regParam": 1 / (strength * n), "maxIter": STEPS, "tol": 1e-3, "weightCol": "weight"}
            svm = LinearSVC(**loss)
            families = {"logistic_regression": LogisticRegression(**loss), "linear_svm": svm if max(counts) <= 1 else OneVsRest(classifier=svm, weightCol="weight")}
            for family, model in families.items():
                m = fitted[family, strength] = model.fit(ready.filter("split = 'train'"))
                metrics = macro_metrics(m.transform(ready.filter("split = 'validation'")), "label", "prediction").first()
                found.append((family, strength, metrics.macro_f1, metrics.accuracy))
        best = {f: max((x for x in found if x[0] == f), key=lambda x: (x[2], x[3], -x[1])) for f in {x[0] for x in found}}
        test = ready.filter("split = 'test'").drop("weight")
        out = None
        for family, (_, strength, _, _) in sorted(best.items()):
            own = fitted[family, strength].transform(test).select(F.lit(family).alias("model"), F.lit(strength).alias("strength"), key, group, "label", "prediction")
            out = own if out is None else out.unionByName(own)
        report = df.sparkSession.createDataFrame(found, "model string, strength double, macro_f1 double, accuracy double")
        return out, report
    finally:
        ready.unpersist()
