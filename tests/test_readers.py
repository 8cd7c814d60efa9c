"""Quoted cells, lazy results and strict and lenient numbers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from saltmarsh.functions import text as tx
from saltmarsh.operators import entity, quality
from saltmarsh.plans.flows import Bundle
from saltmarsh.sources import readers


def test_quoted_cells_hold_line_breaks_and_separators(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('ID,"name, full",note\n1,"a ""b""","first\nsecond, third"\n2,,\n3,x,"last"\n')
    rows = readers.read_raw(spark, str(path))
    assert rows.columns == ["ID", "name, full", "note"]
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("1", 'a "b"', "first\nsecond, third"), ("2", "", ""), ("3", "x", "last"),
    ]
    named = readers.read_raw(spark, str(path), columns=["ID", "name, full", "note"])
    assert sorted(tuple(r) for r in named.collect()) == sorted(tuple(r) for r in rows.collect())


def test_numbers_strict_and_lenient(spark):
    df = spark.createDataFrame([("≈1e-4",), ("~ 2",), ("3",)], "t string")
    assert [r.v for r in df.select(tx.parse_approximate(F.col("t")).alias("v")).collect()] == [1e-4, 2.0, 3.0]
    bad = spark.createDataFrame([("n/a",), ("<1",), (None,), ("≈≈1",)], "t string")
    assert [r.v for r in bad.select(tx.try_approximate(F.col("t")).alias("v")).collect()] == [None] * 4
    with pytest.raises(PySparkException):
        bad.select(tx.parse_approximate(F.col("t"))).collect()


def test_results_are_built_when_asked_for(spark):
    built = []
    bundle = Bundle({"a": spark.range(1), "b": lambda: built.append(1) or spark.range(2)})
    assert list(bundle) == ["a", "b"] and not built
    assert bundle["b"].count() == 2 and bundle["b"].count() == 2 and built == [1]


def test_audits_have_one_row_a_group(spark):
    rows = [(f"m{k}", "Li2S" if k < 3000 else f"X{k}", float(k + 1), "1e-4", "10.1/a", "v1") for k in range(3005)]
    df = spark.createDataFrame(rows, "id string, formula_key string, value double, conductivity_text string, doi_text string, source string")
    df = df.withColumns({"formula_error": F.lit(""), "log10_value": F.log10("value")})
    audit = quality.dup_audit(df).collect()
    assert [(r.formula_key, r.row_count) for r in audit] == [("Li2S", 3000)]
    members = quality.dup_members(df).collect()
    assert len(members) == 3000 and {r.formula_key for r in members} == {"Li2S"}
    grouped = df.withColumn("component", F.col("formula_key"))
    assert entity.component_members(grouped).count() == 3000
