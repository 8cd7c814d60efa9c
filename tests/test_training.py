"""Stratified folds, boosted classes, augmented search and saved preprocessing."""

import random
from statistics import median

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from saltmarsh.operators import mlprep as ml
from saltmarsh.operators import models as md
from saltmarsh.operators import pairing as pr
from saltmarsh.operators import splits as sp
from saltmarsh.session import scratch_path

LABELS = list(pr.LABELS)


def labelled(spark, groups=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        # A few labels are common, one is rare; sizes reach from one row to some hundreds.
        size = rng.choice([1, 1, 2, 3, 5, 8, 40]) if g else 300
        for _ in range(size):
            rows.append((f"g{g}" if g != 7 else None, rng.choices(LABELS, [6, 1, 3])[0]))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, label string")


def test_folds_are_stratified(spark):
    df = labelled(spark)
    folds = sp.stratified_group_kfold(df, "g", "label", LABELS, 5)
    rows = folds.collect()
    assert len(rows) == 400 and len({r.g for r in rows}) == 400
    assert {r.g: r.fold for r in folds.collect()} == {r.g: r.fold for r in rows}
    shares = sp.fold_shares(folds, LABELS).collect()
    biggest = max(r.group_rows for r in rows) / df.count()
    for r in shares:
        for name in ("share_group_rows", *[f"share_{v}" for v in LABELS]):
            # The one group of 300 rows is the only thing that cannot be evened out.
            assert abs(r[name] - 0.2) < biggest + 0.02
    even = sp.fold_shares(sp.stratified_group_kfold(df.filter("g IS NULL OR g != 'g0'"), "g", "label", LABELS, 5), LABELS).collect()
    assert all(abs(r[f"share_{v}"] - 0.2) < 0.01 for r in even for v in LABELS)
    joined = sp.with_folds(df, folds, "g")
    assert joined.count() == df.count()
    assert joined.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n != 1").count() == 0


def test_fold_without_a_class_fails(spark):
    df = spark.createDataFrame([(f"g{i}", LABELS[0 if i < 9 else 1]) for i in range(10)], "g string, label string")
    with pytest.raises(PySparkException, match="row of class unchanged"):
        sp.stratified_group_kfold(df, "g", "label", LABELS[:2], 3).collect()
    assert sp.stratified_group_kfold(df, "g", "label", LABELS[:2], 3, check=False).count() == 10
    assert sp.stratified_group_kfold(df.filter("false"), "g", "label", LABELS, 3).count() == 0


def pair_features(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        values = {name: rng.uniform(-1, 1) for name in pr.MODEL_FEATURES}
        delta = values[pr.SIGNED_FEATURES[0]]
        label = "increase" if delta > 0.3 else "decrease" if delta < -0.3 else "unchanged"
        rows.append((f"p{i}", f"doi{i % 24}", label, pr.LABEL_CLASS[label], 0.5 + i % 3, *values.values()))
    schema = "pair_id string, doi string, trend_label string, trend_class int, pair_weight_group_equal double, " + ", ".join(
        f"`{n}` double" for n in pr.MODEL_FEATURES
    )
    return spark.createDataFrame(rows, schema)


def test_boosted_classes_have_probabilities(spark):
    pairs = pair_features(spark)
    boosted = md.BoostedClasses("label_index", "training_weight", maxIter=4, maxDepth=2)
    model = md.SwapAugmented(Pipeline(stages=[*ml.feature_stages(pr.MODEL_FEATURES), boosted])).fit(pairs)
    rows = model.transform(pairs).collect()
    assert len(rows) == 240
    for r in rows:
        assert sum(r[f"probability_{v}"] for v in LABELS) == pytest.approx(1.0)
        # Read from b to a, a pair's increase is its decrease.
        assert r.probability_increase == pytest.approx((r.forward_probability_increase + r.reverse_probability_decrease) / 2)
    assert sum(r.trend_label == r.predicted_label for r in rows) > 200
    inner = model.model.stages[-1]
    scored = inner.transform(model.model.stages[0].transform(pairs)).select("prediction", "probability", "rawPrediction").first()
    assert scored.prediction == max(range(3), key=lambda i: scored.probability[i]) == max(range(3), key=lambda i: scored.rawPrediction[i])


def test_search_augments_the_fit_side_only(spark, monkeypatch):
    pairs = pair_features(spark)
    folds = sp.stratified_group_kfold(pairs, "doi", "trend_label", LABELS, 2)
    rows = sp.with_folds(pairs, folds, "doi").persist()
    seen = []
    augment = pr.augment
    monkeypatch.setattr(pr, "augment", lambda df: seen.append(df.count()) or augment(df))
    fitted = md.tune_classifier(rows, "logistic", {"regParam": [0.01, 1000.0]}, "fold", parallelism=1)
    table = md.fold_trials(fitted, rows, "fold").collect()
    assert sorted((r.trial, r.fold) for r in table) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    held = {r.fold: r.validation_rows for r in table}
    assert held[0] + held[1] == 240 and all(r.fit_rows == 240 - r.validation_rows for r in table)
    # Two points on each fold's fit side, then the best one on all rows; never a held-out fold.
    assert sorted(seen) == sorted([held[0], held[1]] * 2 + [240])
    assert fitted.bestModel.model.stages[-1].getRegParam() == 0.01
    scores = {p: [r.weighted_macro_f1 for r in sorted(table, key=lambda r: r.fold) if r.trial == p] for p in (0, 1)}
    assert [sum(scores[p]) / 2 for p in (0, 1)] == pytest.approx(fitted.avgMetrics)


def measured(spark, n=200):
    rng = random.Random(5)
    rows = [(f"m{i}", rng.uniform(-1, 1) if i % 9 else None, float("inf") if i % 11 == 0 else rng.uniform(0, 5), f"fam{i % 4}" if i % 5 else None) for i in range(n)]
    return spark.createDataFrame([(*r, (r[1] or 0.0) * 2 + 1, 1.0) for r in rows], "id string, a double, b double, family string, y double, w double")


def test_saved_preprocessing_scores_alike(spark):
    df = measured(spark)
    tree = ml.regressors("y", "w")["decision_tree"]
    fitted = md.saved_pipeline(["a", "b", "absent"], "family", tree).fit(df.withColumn("absent", F.lit(None).cast("double")))
    path = scratch_path(spark, "model")
    md.save(fitted, path)
    loaded = md.load(path)
    fresh = df.withColumn("family", F.when(F.col("id") == "m1", "never seen").otherwise(F.col("family")))
    one = {r.id: r.pred_log10 for r in ml.score(fitted, fresh, ["id"]).collect()}
    two = {r.id: r.pred_log10 for r in ml.score(loaded, fresh, ["id"]).collect()}
    assert one == two and len(one) == 200
    filled = loaded.stages[0].transform(df).filter("id = 'm0'").first()
    values = sorted(r.a for r in df.collect() if r.a is not None)
    assert filled.a == pytest.approx(median(values)) and filled.absent == 0.0
    levels = loaded.stages[1]
    assert levels.getOrDefault(levels.levels) == ["fam0", "fam1", "fam2", "fam3"]
    assert levels.transform(fresh).filter("id = 'm1'").first()["_level"] == "unknown"
