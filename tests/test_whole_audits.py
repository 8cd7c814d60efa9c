"""Audits hand back the members of every group, in lists of bounded length."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import entity, quality
from saltmarsh.plans import catalog

catalog.load()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty line items of three parts."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(
        [(k, "STANDARD", k % 8) for k in (1, 2, 4)], "p_partkey bigint, p_type string, p_size int"
    ).write.parquet(f"{folder}/part.parquet")
    spark.range(40).select(
        (F.col("id") * 3 + 1).alias("l_orderkey"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("id") % 3 + 1).cast("int")).cast("bigint").alias("l_partkey"),
        (F.col("id") % 3 + 1).alias("l_suppkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), F.lit(25.0).alias("l_quantity"),
        (F.col("id") * 10.0).alias("l_extendedprice"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name, key", [("a01_dup", "formula_key"), ("a02_component", "component"), ("a03_formula", "formula_key")])
def test_audit_names_every_member(spark, tables, name, key):
    told = catalog.QUERIES[f"{name}_audit"](spark, tables).collect()
    listed = sorted((r[key], i) for r in told for i in r["ids"].split("|"))
    members = catalog.QUERIES[f"{name}_members"](spark, tables).collect()
    assert listed == sorted((r[key], r["id"]) for r in members) and len(listed) > 10
    assert "list_no" in catalog.ORACLES[f"{name}_audit"]


def test_long_groups_go_on_in_the_next_list(spark):
    rows = [(f"m{k:04d}", "Li2S", float(k + 1), "1e-4", "10.1/a", "v1") for k in range(25)]
    df = spark.createDataFrame(rows, "id string, formula_key string, value double, conductivity_text string, doi_text string, source string")
    df = df.withColumns({"formula_error": F.lit(""), "log10_value": F.log10("value")})
    grouped = df.withColumns({"component": F.col("formula_key"), "doi_tokens": F.array("doi_text")})
    for found in (quality.dup_lists(df, 10), entity.component_lists(grouped, grouped.limit(1), 10)):
        lists = [r["ids"].split("|") for r in found.orderBy("list_no").collect()]
        assert [len(ids) for ids in lists] == [10, 10, 5] and sum(lists, []) == [r[0] for r in rows]
