"""Pairs with written vectors: the same models and scores as from the model columns, one class in memory at a time."""

import threading

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from saltmarsh.operators import mlprep as ml
from saltmarsh.operators import models as md
from saltmarsh.operators import pairing as pr
from saltmarsh.plans import flows
from saltmarsh.plans import queries_scoring as qs
from saltmarsh.session import durable
from test_training import pair_features

PROBABILITIES = [f"{d}probability_{v}" for d in ("", "forward_", "reverse_aligned_") for v in pr.LABELS]


def with_gaps(spark):
    """Pairs with a missing and an infinite number, and one pair without features."""
    name, other = pr.MODEL_FEATURES[0], pr.MODEL_FEATURES[30]
    rows = pair_features(spark, 90).withColumns({
        name: F.when(F.col("pair_id") != "p3", F.col(name)), other: F.when(F.col("pair_id") == "p4", float("inf")).otherwise(F.col(other)),
        pr.REJECT: F.when(F.col("pair_id") == "p5", "X: unreadable formula").otherwise(""),
    })
    gone = F.col(pr.REJECT) != ""
    return durable(rows.withColumns({n: F.when(~gone, F.col(n)) for n in pr.MODEL_FEATURES}))


@pytest.mark.parametrize("name", ["random_forest", "logistic"])
def test_vectors_serve_fit_and_score_alike(spark, name):
    table = with_gaps(spark)
    medians = durable(ml.medians(pr.usable_pairs(table), pr.MODEL_FEATURES))
    # Trees sample by place, so both tables lie in one file and order.
    wide, vectors = (durable(rows.coalesce(1).sortWithinPartitions("pair_id")) for rows in (
        ml.impute(pr.usable_pairs(table), pr.MODEL_FEATURES, medians), flows.filled_pairs(table, medians)
    ))
    assert not set(pr.MODEL_FEATURES) & set(vectors.columns)
    assert [r.pair_id for r in vectors.filter("features IS NULL OR features_back IS NULL").collect()] == ["p5"]
    found = []
    for rows in (wide, vectors):
        model = flows.train_trend_model(rows, name)
        scored = ml.score_pairs(model, pr.usable_pairs(rows)).select("pair_id", "predicted_label", *PROBABILITIES)
        found.append({r.pair_id: r for r in scored.collect()})
    one, two = found
    assert one.keys() == two.keys() and len(one) == 89
    for key, row in one.items():
        assert list(row[2:]) == pytest.approx(list(two[key][2:]))
        assert row.predicted_label == two[key].predicted_label
    # A model from columns scores vectors, and reading a pair backwards swaps its vectors.
    back = pr.reverse_pairs(vectors).filter("pair_id = 'p1'").first()
    there = vectors.filter("pair_id = 'p1'").first()
    assert (back.features, back.features_back) == (there.features_back, there.features)


def test_boosted_classes_hold_one_class_at_a_time(spark, monkeypatch):
    rows = pr.augment(pair_features(spark, 60)).withColumn("label_index", ml.label_index(F.col("trend_label")))
    table = durable(ml.feature_stages(pr.MODEL_FEATURES)[0].transform(rows).select("features", "label_index", "training_weight"))
    fit, gate, most = GBTClassifier.fit, threading.Lock(), []

    def alone(self, *args, **kwargs):
        free = gate.acquire(blocking=False)
        most.append((free, spark.sparkContext._jsc.getPersistentRDDs().size()))
        try:
            return fit(self, *args, **kwargs)
        finally:
            if free:
                gate.release()

    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(GBTClassifier, "fit", alone)
    model = md.BoostedClasses("label_index", "training_weight", maxIter=2, maxDepth=2).fit(table)
    assert len(model.models) == 3
    assert most == [(True, held)] * 3


def test_comparison_builds_its_pairs_once(monkeypatch):
    built = []
    monkeypatch.setattr(qs, "pairs", lambda t: built.append("pairs") or "pairs")
    monkeypatch.setattr(qs, "pair_sides", lambda t, found=None: ("medians", "train", found or qs.pairs(t)))
    monkeypatch.setattr(qs, "grouped_files", lambda t: {"pairs": "grouped"})
    monkeypatch.setattr(qs, "durable", lambda rows: rows)
    for name in ("trend_features", "filled_pairs", "train_trend_model"):
        monkeypatch.setattr(flows, name, lambda *given: given)
    monkeypatch.setattr(flows, "experimental_comparison", lambda table, train, models: train)
    assert qs.comparison(None) == "pairs" and built == ["pairs"]
