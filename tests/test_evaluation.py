"""Metrics against published values and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import evaluation as ev
from saltmarsh.operators import mlprep as ml
from saltmarsh.operators.pairing import LABELS


def test_confusion_golden(spark):
    matrix = [[39, 4, 19], [3, 0, 0], [24, 3, 12]]
    rows = [(t, g) for i, t in enumerate(LABELS) for j, g in enumerate(LABELS) for _ in range(matrix[i][j])]
    df = spark.createDataFrame(rows, "t string, g string")
    r = ev.aggregate_metrics(df, [], "t", "g").first()
    assert r["accuracy"] == pytest.approx(51 / 104)
    assert r["macro_f1"] == pytest.approx(0.31741, abs=1e-5)
    assert r["balanced_accuracy"] == pytest.approx(0.31224, abs=1e-5)
    cells = {(x["true_label"], x["predicted_label"]): x["row_count"] for x in ev.confusion(df, [], "t", "g", F.lit(1.0)).collect()}
    assert [[cells[(t, g)] for g in LABELS] for t in LABELS] == matrix


def brute(points):
    comparable = inverted = tied = 0
    for i in range(len(points)):
        for j in range(i):
            dt, dp = points[i][0] - points[j][0], points[i][1] - points[j][1]
            if dt:
                comparable += 1
                tied += dp == 0
                inverted += dt * dp < 0
    return comparable, inverted, tied


@pytest.mark.parametrize("path", ["window", "sliced"])
def test_inversions_brute_force(spark, path, request):
    if path == "sliced":
        request.getfixturevalue("sliced")
    rng = random.Random(11)
    data = [("hot" if i < 150 else f"g{i % 5}", rng.randrange(25) / 4, rng.randrange(30) / 8) for i in range(220)]
    data += [("flat", 1.0, 2.0), ("flat", 1.0, 2.0), ("one", 1.0, 3.0)]
    df = spark.createDataFrame(data, "g string, t double, p double")
    got = {r["g"]: (r["comparable_pairs"], r["inverted_pairs"], r["tied_pairs"]) for r in ev.inversions(df, ["g"], "t", "p").collect()}
    want = {g: brute([(t, p) for x, t, p in data if x == g]) for g in {x for x, _, _ in data}}
    assert got == want


def test_spearman_and_kendall(spark):
    import pandas as pd

    rng = random.Random(4)
    pdf = pd.DataFrame({"t": [rng.randrange(12) for _ in range(60)], "p": [rng.randrange(9) for _ in range(60)]}).astype(float)
    df = spark.createDataFrame(pdf).withColumn("g", F.lit("a"))
    r = ev.external_eval(df, ["g"], "t", "p").first()
    ranks = pdf.rank()
    assert r["spearman"] == pytest.approx(ranks["t"].corr(ranks["p"]))
    n = len(pdf)
    c, d, tied = brute(list(pdf.itertuples(index=False, name=None)))
    ties_p = sum(k * (k - 1) / 2 for k in pdf["p"].value_counts())
    assert r["kendall"] == pytest.approx((c - 2 * d - tied) / ((c * (n * (n - 1) / 2 - ties_p)) ** 0.5))


def test_symmetric_scores(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2, 0.1, 0.2, 0.7)], "a double, b double, c double, d double, e double, f double").toDF(
        *[f"forward_probability_{v}" for v in LABELS], *[f"reverse_probability_{v}" for v in LABELS])
    r = ml.symmetric(df).first()
    assert [r[f"probability_{v}"] for v in LABELS] == pytest.approx([0.6, 0.25, 0.15])
    assert r["predicted_label"] == "decrease"


def test_imputation_uses_training_medians(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (float("inf"), None)], "a double, b double")
    other = spark.createDataFrame([(float("nan"),), (9.0,)], "a double")
    rows = ml.impute(other, ["a", "b"], ml.medians(train, ["a", "b"])).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(2.0, 0.0), (9.0, 0.0)]


def test_regression_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 3.0, 2.0), ("b", 1.0, 4.0)], "g string, t double, p double")
    r = {x["g"]: x for x in ev.regression_metrics(df, ["g"], "t", "p").collect()}
    assert (r["a"]["mae"], r["a"]["rmse"], r["a"]["r2"]) == (0.75, pytest.approx(0.625**0.5), pytest.approx(1 - 0.625))
    assert r["b"]["r2"] is None
