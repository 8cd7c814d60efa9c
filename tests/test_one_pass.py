"""Pair steps that go over their rows once: vectors, windows, held-out scores, the training side."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from saltmarsh.functions import text as tx
from saltmarsh.operators import mlprep as ml
from saltmarsh.operators import models as md
from saltmarsh.operators import pairing as pr
from saltmarsh.plans import flows
from saltmarsh.plans import queries_scoring as qs
from saltmarsh.session import durable
from test_pair_vectors import with_gaps
from test_training import pair_features


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filled_pairs_read_their_table_once(spark):
    table = with_gaps(spark)
    medians = ml.medians(pr.usable_pairs(table), pr.MODEL_FEATURES).first().asDict()
    row = spark.createDataFrame([tuple(medians.values())], ", ".join(f"`{n}` double" for n in medians))
    filled = flows.filled_pairs(table, row)
    assert plan_of(filled).count("FileScan parquet") == 1
    found = {r.pair_id: r for r in filled.collect()}
    assert len(found) == 90 and found["p5"].features is None and found["p5"].features_back is None
    for r in pr.usable_pairs(table).collect():
        for vector, back in ((found[r.pair_id].features, False), (found[r.pair_id].features_back, True)):
            for i, name in enumerate(pr.MODEL_FEATURES):
                source = {"a_": "b_", "b_": "a_"}.get(name[:2], name[:2]) + name[2:] if back else name
                value = r[source] if r[source] is not None and abs(r[source]) != float("inf") else medians[f"_m_{source}"]
                assert vector[i] == (-value if back and name.startswith("delta_") else value)


def test_a_gap_without_medians_fails(spark):
    rows = pair_features(spark, 4)
    name = pr.MODEL_FEATURES[20]
    for gap in (None, float("nan")):
        with pytest.raises(PySparkException, match="has no number"):
            ml.pair_vectors(rows.withColumn(name, F.lit(gap).cast("double")), pr.MODEL_FEATURES).collect()


def test_held_out_pairs_are_scored_once(spark, monkeypatch):
    pairs = durable(pair_features(spark, 60).withColumn("fold", F.substring("pair_id", 2, 9).cast("int") % 2))
    scored, score = [], ml.score_pairs
    monkeypatch.setattr(ml, "score_pairs", lambda model, df: scored.append(df.count()) or score(model, df))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    fitted = md.tune_classifier(pairs, "logistic", {"regParam": [0.1, 0.01]}, "fold")
    assert len(md.fold_trials(fitted, pairs, "fold").collect()) == 4
    assert scored == [30] * 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


@pytest.mark.parametrize("fold", ["1", "pmod(substring(pair_id, 2, 9), 2) * 2", "if(pair_id = 'p3', null, pmod(substring(pair_id, 2, 9), 2))"])
def test_folds_must_be_whole(spark, fold):
    with pytest.raises(ValueError, match="folds must be"):
        md.tune_classifier(pair_features(spark, 12).withColumn("fold", F.expr(fold).cast("int")), "logistic", {"regParam": [0.1]}, "fold")


def test_pairs_of_a_value_are_sorted_once(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(f"10.1/{i % 3}", "m", 25, "f", "bulk", f"r{i}", i % 5, "1", 1.0, i % 5, i % 2) for i in range(30)],
        "doi string, method string, temperature_c int, family string, kind string, id string, _formula long, conductivity_text string, value double, _rank long, _set long",
    )
    plans = []
    monkeypatch.setattr(pr, "durable", lambda df: plans.append(plan_of(df)) or durable(df))
    assert pr._pairs_by_first(rows, pr.GROUP_COLUMNS).count() > 0
    assert plans[0].count("Sort [") == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_reports_build_the_training_side_only(spark):
    formulas = ["Li6PS5Cl", "Li3YCl6", "Li7La3Zr2O12"]
    rows = [
        (f"p{i}", f"g{i // 3}", f"10.1/{i // 3}", "oxides", formulas[i % 3], formulas[(i + 1) % 3], 1e-3, (1e-3, 2e-3, 1e-4)[i % 3])
        for i in range(60)
    ]
    found = durable(spark.createDataFrame(rows, "pair_id string, group_id string, doi string, family string, formula_a string, formula_b string, value_a double, value_b double"))
    sides = {r.pair_id: r.split for r in flows.split_pairs(pr.label_pairs(found), 0.2).collect()}
    assert set(sides.values()) == {"train", "validation"}
    _, train, held = qs.pair_sides(None, found)
    assert held.count() == 0
    assert {r.pair_id for r in train.collect()} == {p for p, side in sides.items() if side == "train"}
    assert train.filter("features IS NULL OR pair_weight_group_equal != 1 / 3D").count() == 0


def test_texts_are_trimmed_without_patterns(spark):
    rows = [(t,) for t in (" \t\n\x0b\f\r a b \r\n", "", None, " ", "__A  b--", "https://doi.org/10.1021/S1.,.")]
    texts = spark.createDataFrame(rows, "s string").select("s", tx.strip(F.col("s")).alias("t"), tx.normalize_label(F.col("s")).alias("label"))
    assert "regexp_replace(s" not in plan_of(texts.select("t"))
    for r in texts.collect():
        assert r.t == (r.s if r.s is None else r.s.strip(" \t\n\x0b\f\r"))
    assert {r.s: r.label for r in texts.collect()}["__A  b--"] == "a_b"
    tokens = texts.select(tx.doi_tokens(F.col("s")).alias("t")).collect()
    assert tokens[-1].t == ["10.1021/s1"]
