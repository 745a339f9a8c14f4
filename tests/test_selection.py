"""Classifier selection on held-out groups."""

import pytest
from pyspark.sql import functions as F

from vivaspark.operators import selection as S


def test_macro_metrics(spark):
    rows = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] * 1 + [(2, 0)] * 4
    r = S.macro_metrics(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()
    precision, recall = [6 / 11, 3 / 5, 0], [6 / 8, 3 / 4, 0]
    f1 = [2 * a * b / (a + b) if a + b else 0 for a, b in zip(precision, recall)]
    assert [round(x, 12) for x in (r.accuracy, r.macro_precision, r.macro_recall, r.macro_f1)] == [round(x, 12) for x in (9 / 16, sum(precision) / 3, sum(recall) / 3, sum(f1) / 3)]


def test_chosen_models_beat_the_majority(spark, monkeypatch):
    monkeypatch.setattr(S, "STRENGTHS", (0.1, 1.0))
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = d.join(lab, "doc_id").withColumn("group", F.floor(F.col("doc_id") / 7)).coalesce(2)
    predicted, report = S.select(rows, "doc_id", "group", "text", "quality")
    assert {(r.model, r.strength) for r in report.collect()} == {(m, c) for m in ("linear_svm", "logistic_regression") for c in (0.1, 1.0)}
    got = predicted.collect()
    truth = [r.label for r in got if r.model == "linear_svm"]
    majority = max(truth.count(0.0), truth.count(1.0)) / len(truth)
    for m in ("linear_svm", "logistic_regression"):
        own = [r for r in got if r.model == m]
        assert len(own) == len(truth) == len({r.doc_id for r in own})
        assert sum(r.label == r.prediction for r in own) / len(own) > majority
    # The winner of a family is the best of its candidates.
    for m, c in {(r.model, r.strength) for r in got}:
        own = {r.strength: (r.macro_f1, r.accuracy, -r.strength) for r in report.collect() if r.model == m}
        assert own[c] == max(own.values())


def test_one_class_is_an_error(spark):
    rows = spark.createDataFrame([(i, i, "a b", 0) for i in range(9)] + [(99, None, "a", 1)], "k int, g int, t string, y int")
    with pytest.raises(ValueError):
        S.select(rows, "k", "g", "t", "y")
