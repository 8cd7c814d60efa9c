"""Steps that read their rows several times read them from a written table."""

from pyspark.sql import functions as F

from saltmarsh.operators import entity
from saltmarsh.operators import mlprep as ml
from saltmarsh.operators import models as md
from saltmarsh.operators import pairing as pr
from saltmarsh.plans import flows
from test_training import pair_features


def counted(spark, rows):
    """``rows`` with a counter of the times that each of them is computed."""
    times = spark.sparkContext.accumulator(0)

    def count(value):
        times.add(1)
        return value

    column = rows.columns[-1]
    return rows.withColumn(column, F.udf(count, "string").asNondeterministic()(column)), times


def lines(spark):
    texts = ["group1", "r1\tLi2O\t1 x 10-4", "r2\tLi2S + 5wt%ZrCl4\t3 x 10-4", "r3\tLi2S\tbad", "r4\tLi3N\t2 x 10-4"]
    return spark.createDataFrame([(1, i, i, text) for i, text in enumerate(texts)], "file long, ts long, line_id long, text string")


def summary(spark):
    rows = [("r1", "Li2O", 1e-4, "m1", "oxides"), ("r2", "Li2S + 5wt%ZrCl4", 3e-4, "m2", "sulfides"), ("r4", "Li3N", 2e-4, "m4", "sulfides")]
    return spark.createDataFrame(rows, "row_id string, row_formula string, row_value double, method string, family string")


def test_summary_of_grouped_files_is_read_once(spark):
    facts, times = counted(spark, summary(spark))
    found = flows.reconciled_pairs(lines(spark), facts, ["file"], ["ts", "line_id"], F.lit("general"), 7.5e-5)
    rows = found["pairs"].orderBy("pair_id").collect()
    assert [(r.row_id_a, r.row_id_b, r.formula_a, r.formula_b, r.family, r.trend_label) for r in rows] == [
        ("r1", "r2", "Li2O", "Li2S", "mixed", "increase"), ("r2", "r4", "Li2S", "Li3N", "sulfides", "decrease"),
    ]
    assert [r.additive_omitted for r in rows] == [True, True]
    assert {r.status for r in found["reconciliation"].collect()} == {"same"}
    assert times.value == 3


def test_segment_rows_are_read_once(spark):
    rows, times = counted(spark, spark.createDataFrame(
        [(1, i, i, 1, "g", f"r{i}", "Li2O", float(i), "oxides") for i in range(5)],
        "file long, ts long, line_id long, segment_no long, segment_label string, row_id string, row_formula string, row_value double, family string",
    ))
    assert flows.segment_trend_pairs(rows, ["file"], ["ts", "line_id"]).count() == 4
    assert times.value == 5


def test_component_members_are_found_once(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("a", f"x{i}", "v1", i, "LiCl", 1.0 + i, 0.0, ["t"]) for i in range(4)] + [("b", "y", "v1", 9, "LiBr", 1.0, 0.0, ["u"])],
        "component string, id string, source string, source_row long, formula_key string, value double, log10_value double, doi_tokens array<string>",
    ).withColumn("temperature_c", F.lit(25.0))
    kept, _ = entity.pick_representative(rows)
    found = []
    members = entity.component_members
    monkeypatch.setattr(entity, "component_members", lambda df: found.append(counted(spark, members(df))) or found[0][0])
    out = entity.component_lists(rows, kept, 3).orderBy("list_no").collect()
    assert [(r.component, r.list_no, r.ids, r.token_count) for r in out] == [("a", 0, "x0|x1|x2", 1), ("a", 1, "x3", 1)]
    assert found[0][1].value == 4


def test_search_caches_only_what_it_reads(spark, monkeypatch):
    pairs = pair_features(spark, 60).withColumns({"fold": F.substring("pair_id", 2, 9).cast("int") % 2, "formula_a": F.lit("x" * 50)})
    seen = []
    augment = pr.augment
    monkeypatch.setattr(pr, "augment", lambda df: seen.append(set(df.columns)) or augment(df))
    md.tune_classifier(pairs, "logistic", {"regParam": [0.1]}, "fold")
    assert seen and all(c == {*pr.MODEL_FEATURES, "trend_label", "pair_weight_group_equal", "fold"} for c in seen)


def test_medians_are_counted_by_place(spark, monkeypatch):
    rows = spark.createDataFrame([(1.0, None), (2.0, float("nan")), (float("inf"), None), (4.0, None)], "a double, b double")
    parts = []
    quantiles = ml.exact_quantiles
    monkeypatch.setattr(ml, "exact_quantiles", lambda df, *rest: parts.append(df.schema["feature"].dataType.typeName()) or quantiles(df, *rest))
    assert ml.medians(rows, ["a", "b"]).first().asDict() == {"_m_a": 2.0, "_m_b": 0.0}
    assert parts == ["integer"]
