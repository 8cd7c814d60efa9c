"""Null labels, groups, datasets and models keep their rows."""

import pytest

from saltmarsh.operators import evaluation as ev
from saltmarsh.operators import ordering, quality, splits


def test_strata_and_groups_without_a_name(spark):
    rows = [(f"i{k}", None if k % 2 else "x", None if k < 4 else f"g{k % 7}") for k in range(60)]
    df = spark.createDataFrame(rows, "id string, label string, g string")
    side = splits.split_stratified(df, "id", "label", 0.2).collect()
    assert len(side) == 60
    assert {(label, sum(r.split == "test" for r in side if r.label == label)) for label in (None, "x")} == {(None, 6), ("x", 6)}
    groups = splits.split_groups_to_target(df, "g", "label", ["x"], 0.3)
    assert groups.count() == 8
    assert splits.assignments(df, groups, "g").count() == 60
    manifest = splits.split_manifest(splits.assignments(df, groups, "g"), "g", "label", ["x"]).collect()
    assert sum(r.rows for r in manifest) == 60


def test_rank_of_null_strata(spark):
    df = spark.createDataFrame([("a", "01", None), ("b", "02", None), ("c", "03", "s"), ("d", "04", "s")], "id string, h string, g string")
    found = ordering.hash_rank(df, ["g"], "h", "n", tie="id").collect()
    assert {r.id: r.n for r in found} == {"a": 1, "b": 2, "c": 1, "d": 2}


def test_quantiles_and_residuals_of_null_datasets(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("d", 5.0)], "dataset string, r double")
    found = {r.dataset: r.m for r in ordering.exact_quantiles(df, ["dataset"], "r", {"m": 0.5}).collect()}
    assert found == {None: 2.0, "d": 5.0}
    residuals = {r.dataset: (r.n, r.median_residual) for r in quality.residual_summary(df, "dataset", "r").collect()}
    assert residuals == {None: (2, 2.0), "d": (1, 5.0)}
    split = {r.dataset: r.median_value for r in quality.describe_split(df, "dataset", "r").collect()}
    assert split == {None: 2.0, "d": 5.0}


def test_metrics_of_null_models(spark):
    rows = [(None, "increase", "decrease"), (None, "increase", "increase"), ("m", "unchanged", "unchanged")]
    df = spark.createDataFrame(rows, "model string, t string, g string")
    found = {r.model: (r.pairs, r.accuracy, r.severe_reversal_count) for r in ev.aggregate_metrics(df, ["model"], "t", "g").collect()}
    assert found == {None: (2, 0.5, 1), "m": (1, 1.0, 0)}
    assert ev.aggregate_metrics(df, [], "t", "g").first().pairs == 3


@pytest.mark.parametrize("base", [0.0, 1e9, -3e12])
def test_correlations_of_null_series_and_large_values(spark, base):
    rows = [(s, k, base + k * k, base + 2 * k) for s in (None, "s") for k in range(6)] + [("flat", k, base + 0.5, base + k) for k in range(4)]
    df = spark.createDataFrame(rows, "s string, k int, t double, p double")
    found = {r.s: r for r in ev.series_summary(df, ["s"], [df.k], "t", "p").collect()}
    assert set(found) == {None, "s", "flat"}
    for s in (None, "s"):
        assert found[s].pearson == pytest.approx(0.9598, abs=1e-3) and found[s].spearman == pytest.approx(1.0)
        assert found[s].inversion_rate == 0.0 and found[s].adjacent_comparable == 5
    assert found["flat"].pearson is None and found["flat"].spearman is None
    external = {r.s: r.status for r in ev.external_eval(df, ["s"], "t", "p").collect()}
    assert external == {None: "ok", "s": "ok", "flat": "ok"}
