"""Null groups, tiny values, repeated title lines and repeated lookup keys."""

import pytest
from pyspark.errors import PySparkException

from saltmarsh.functions import text as tx
from saltmarsh.operators import entity, evaluation, pairing, windows
from saltmarsh.sources import readers


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    assert {r.id: r.weight for r in windows.group_weight(df, "g").collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
    pairs = pairing.pairs_all(df, ["g"], ["id"], ["id"], rows_per_block=1).collect()
    assert [(r.g, r.id_a, r.id_b) for r in pairs] == [(None, 1, 2)]


def test_pairs_of_groups_without_temperature(spark):
    rows = [(f"m{k}", formula, "10.1/x", "imp", None, "garnet", "bulk 1", "1e-4", 1e-4 * (k + 1)) for k, formula in enumerate(("Li2O", "Li3N", "Li2S"))]
    df = spark.createDataFrame(
        rows, "id string, formula string, doi string, method string, temperature_c double, family string, note string, conductivity_text string, value double"
    )
    found = pairing.build_pairs(pairing.pairing_input(df)).collect()
    assert len(found) == 3 and all(r.temperature_c is None for r in found)


def test_metrics_of_tiny_values(spark):
    rows = [("a", 1e-9 * k, 2e-9 * k) for k in range(1, 9)] + [("flat", 0.1, 0.2)] * 3
    df = spark.createDataFrame(rows, "g string, t double, p double")
    found = {r.g: r.r2 for r in evaluation.regression_metrics(df, ["g"], "t", "p").collect()}
    assert found["a"] is not None and found["flat"] is None
    corr = df.groupBy("g").agg(evaluation.weighted_corr(df.t, df.p, df.t * 0 + 1).alias("r")).collect()
    assert {r.g: None if r.r is None else round(r.r, 9) for r in corr} == {"a": 1.0, "flat": None}


def test_title_lines_go_by_place(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Title\nid\tx\n1\tp\nTitle\nid\tx\n")
    (tmp_path / "b.tsv").write_text("Title\nid\tx\n2\tq\n")
    rows = readers.read_titled_tsv(spark, str(tmp_path), "id").collect()
    assert sorted((r.id, r.x) for r in rows) == [("1", "p"), ("2", "q"), ("Title", ""), ("id", "x")]


def test_lookup_has_one_value_for_a_key(spark):
    df = spark.createDataFrame([(1, 10, "A"), (2, 20, "B"), (3, 30, "C")], "id long, pos long, formula string")
    dim = spark.createDataFrame(
        [(1, None, "old", 1, "A"), (1, None, "new", 2, "A"), (None, 20, "p", 3, None), (None, 20, "q", 4, None)],
        "id long, pos long, fam string, line long, formula string",
    )
    found = entity.lookup(df, dim, "id", "pos", "fam", "line", "formula").collect()
    assert {r.id: r.fam for r in found} == {1: "new", 2: "q", 3: "unknown"}
    with pytest.raises(PySparkException, match="contents differ"):
        entity.lookup(df.replace("A", "X"), dim, "id", "pos", "fam", "line", "formula").collect()


def test_spaced_bulk(spark):
    df = spark.createDataFrame([("σb​",), ("x sb​​ulk y",), ("total",)], "note string")
    assert [r.k for r in df.select(tx.measure_kind(df.note).alias("k")).collect()] == ["unknown", "bulk", "tot"]


def test_generated_ids_follow_file_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Li2O\nLi3N\n")
    (tmp_path / "b.txt").write_text("".join(f"Li{k}S\n" for k in range(2, 52)))
    rows = readers.read_flexible(spark, str(tmp_path)).collect()
    found = {r.id: r.formula for r in rows}
    assert len(found) == 52 and [found[f"pred_{k:04d}"] for k in (1, 2, 3, 52)] == ["Li2O", "Li3N", "Li2S", "Li51S"]
