"""Pairs and rows that cannot be used come back with their reason."""

from pyspark.sql import functions as F

from saltmarsh.operators import pairing as pr
from saltmarsh.plans import flows


def test_every_pair_comes_back(spark):
    pairs = spark.createDataFrame(
        [(1, "Li6PS5Cl", "Li3YCl6", "argyrodites"), (2, "Li6PS5Cl", "???", "oxides"), (3, "???", None, "oxides"), (4, "???", "???", "oxides")],
        "id long, formula_a string, formula_b string, family string",
    )
    table = pr.formula_descriptors(pr.pair_formulas(pairs))
    assert {r.formula: r.reject_reason for r in pr.rejected_formulas(pairs).collect()} == {"???": "unreadable formula", None: "unreadable formula"}
    rows = {r.id: r for r in pr.pair_features(pr.enrich_pairs(pairs, table)).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1].reject_reason == "" and rows[1].delta_chi_all is not None
    assert rows[2].reject_reason == "???: unreadable formula"
    assert rows[2].a_chi_all == rows[1].a_chi_all and rows[2].b_chi_all is None and rows[2].delta_chi_all is None
    assert rows[2].composition_L1_distance is None
    assert rows[3].reject_reason == "???: unreadable formula; missing formula: no descriptors"
    assert rows[4].reject_reason == "???: unreadable formula"
    assert pr.inference_pairs(pairs.drop("id")).count() == 4
    assert pr.usable_pairs(pr.inference_pairs(pairs.drop("id"))).count() == 1


def typed(spark):
    rows = [("a", "Li6PS5Cl", 1e-3, "10.1/x"), ("b", "???", 1e-3, "10.1/x"), ("c", "Li3YCl6", None, "10.1/x"), ("d", "Li3YCl6", 1e-3, "")]
    df = spark.createDataFrame(rows, "id string, formula string, value double, doi string")
    from saltmarsh.operators import quality as ql

    return ql.with_formula(df).withColumns({
        "doi_tokens": F.filter(F.array("doi"), lambda d: d != ""), "ref": F.lit("tables/v1"), "note": F.lit(""), "checked": F.lit(""),
        "row_order": F.lit(1), "family_norm": F.lit("oxides"), "log10_value": F.log10("value"), "conductivity_text": F.lit("1e-3"),
    })


def test_every_row_is_paired_or_has_a_reason(spark):
    usable, rejected = flows.trend_rows(typed(spark))
    reasons = {r.id: r.removed_reason.split(":")[0] for r in rejected.collect()}
    assert [r.id for r in usable.collect()] == ["a"]
    assert reasons == {"b": "unparseable formula", "c": "missing or non-positive value", "d": "no DOI"}


def test_model_cleaning_accounts_for_unreadable_rows(spark):
    out = flows.model_clean(typed(spark))
    removed = {r.id: r.removed_reason.split(":")[0] for r in out["removed"].collect()}
    assert removed == {"b": "unparseable formula", "c": "invalid or non-positive conductivity"}
    assert sorted(r.id for r in out["kept"].collect()) == ["a", "d"]
