"""Queries for formula descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import composition as cp
from saltmarsh.operators import quality as ql
from saltmarsh.plans import flows
from saltmarsh.plans.catalog import query

c = F.col


def pick(*names: str) -> str:
    return f"SELECT formula, {', '.join(names)} FROM desc_all"


@query("c01_organic_flag", "SELECT formula, organic FROM organic")
def c01(t):
    return t.parsed.filter("composition IS NOT NULL").select("formula", cp.organic_flag(c("composition")).alias("organic"))


@query("c02_candidates", "SELECT formula, element, neutral, CASE WHEN neutral THEN 0 ELSE len(states) END::BIGINT AS state_count, CASE WHEN NOT neutral THEN states[1] END AS first_state FROM cand_states", "first_state")
def c02(t):
    return cp.candidates(t.parsed).select(
        "formula", "element", "neutral", F.size("states").cast("bigint").alias("state_count"), F.get("states", 0).alias("first_state")
    )


@query("c03_assign_oxidation", "SELECT formula, element, charge FROM ox", "charge")
def c03(t):
    return cp.assign_oxidation(t.parsed).select("formula", F.explode("assigned").alias("x")).select("formula", "x.element", "x.charge")


@query("c04_charge_balance", "SELECT formula, residual_charge, z_by_element AS oxidation_guess FROM oxbest JOIN oxjson USING (formula)", "residual_charge")
def c04(t):
    return cp.charge_balance(t.parsed)


@query("c05_ionic_radius", "SELECT formula, element, charge, radius FROM ef", "charge radius")
def c05(t):
    return cp.element_facts(t.parsed).select("formula", "element", "charge", "radius")


@query("c06_element_role", "SELECT formula, element, role FROM ef")
def c06(t):
    return cp.element_facts(t.parsed).select("formula", "element", "role")


MEANS = [f"{s}_{n}" for s in ("chi", "r", "rho") for n in ("all", "anion", "cation", "host")] + ["phi_cation", "phi_host"]


@query("c07_weighted_means", pick(*MEANS), " ".join(MEANS))
def c07(t):
    aggregates = cp.base_aggregates()
    return cp.element_facts(t.parsed).groupBy("formula").agg(*[aggregates[n].alias(n) for n in MEANS])


@query("c08_value_range", pick("chi_range"), "chi_range")
def c08(t):
    return cp.element_facts(t.parsed).groupBy("formula").agg(cp.value_range(c("chi")).alias("chi_range"))


@query("c09_radius_disorder", pick("delta_anion"), "delta_anion")
def c09(t):
    return cp.element_facts(t.parsed).groupBy("formula").agg(cp.radius_disorder().alias("delta_anion"))


FRACTIONS = ["n_halide", "n_host", "n_anion", "n_li", "tau_cationic"]


@query("c10_role_fractions", pick(*FRACTIONS), " ".join(FRACTIONS))
def c10(t):
    aggregates = cp.base_aggregates()
    return cp.element_facts(t.parsed).groupBy("formula").agg(*[aggregates[n].alias(n) for n in FRACTIONS])


@query("c11_base_descriptors", pick("z_by_element", *cp.BASE_NAMES), " ".join(cp.BASE_NAMES))
def c11(t):
    return cp.base_descriptors(t.parsed)


PROPERTIES = ["v_d", "v_s", "v_bond", "v_vs", "v_melt", "v_mass", "v_ionic"]


@query("c12_element_properties", f"SELECT formula, element, {', '.join(PROPERTIES)} FROM ef", " ".join(PROPERTIES))
def c12(t):
    return cp.element_facts(t.parsed).select(
        "formula", "element", c("p_d_electrons").alias("v_d"), c("p_s_electrons").alias("v_s"), c("p_bond_radius").alias("v_bond"),
        c("p_s_volume").alias("v_vs"), c("p_melting").alias("v_melt"), c("p_mass").alias("v_mass"), c("p_ionic_radius").alias("v_ionic"),
    )


@query("c13_element_groups", """SELECT formula, element, TRUE AS in_all, element <> 'Li' AS in_l, role IN ('Li','host_cation') AS in_c, role = 'host_cation' AS in_c_l,
    role IN ('anion','halide') AS in_a FROM ef""")
def c13(t):
    return cp.element_facts(t.parsed).select(
        "formula", "element", *[cp.group_predicate(g).alias(f"in_{g}") for g in ("all", "l", "c", "c_l", "a")]
    )


STATISTICS = [n for n in cp.SMALL_NAMES if n != "entropy_c_l"]


@query("c14_weighted_statistics", pick(*STATISTICS), " ".join(STATISTICS))
def c14(t):
    aggregates = cp.small_aggregates()
    return cp.element_facts(t.parsed).groupBy("formula").agg(*[aggregates[n].alias(n) for n in STATISTICS])


@query("c15_mixing_entropy", """SELECT formula, max(entropy_c_l) AS entropy_c_l, max(entropy_all) AS entropy_all FROM desc_all JOIN (
    SELECT formula, -sum(share * ln(share)) AS entropy_all FROM (SELECT formula, amount / sum(amount) OVER (PARTITION BY formula) AS share FROM comp) GROUP BY formula) USING (formula) GROUP BY formula""",
    "entropy_c_l entropy_all")
def c15(t):
    return cp.element_facts(t.parsed).groupBy("formula").agg(
        cp.mixing_entropy("c_l").alias("entropy_c_l"), cp.mixing_entropy("all").alias("entropy_all")
    )


@query("c16_small_descriptors", pick(*cp.SMALL_NAMES), " ".join(cp.SMALL_NAMES))
def c16(t):
    return cp.small_descriptors(t.parsed)


@query("c17_interactions", pick(*cp.INTERACTION_NAMES), " ".join(cp.INTERACTION_NAMES))
def c17(t):
    return cp.base_descriptors(t.parsed).withColumns(cp.interactions()).select("formula", *cp.INTERACTION_NAMES)


@query("c18_reuse", "SELECT formula, chi_all, n_li, length(formula) % 2 = 0 AS reused FROM desc_all", "chi_all n_li")
def c18(t):
    table = t.descriptors.select("formula", "chi_all", "n_li")
    stored = table.filter(F.length("formula") % 2 == 0)
    stale = stored.withColumn("chi_all", F.lit(-1.0)).withColumn("version", F.lit(1))
    prior = stale.unionByName(stored.withColumn("version", F.lit(2)))
    known = t.parsed.filter("composition IS NOT NULL")
    return cp.reuse(known, prior, "formula", c("version"), ["chi_all", "n_li"],
                    lambda keys: cp.descriptors(cp.compositions(keys)))


@query("c19_quarantine", """SELECT id, 'kept' AS outcome FROM mf WHERE doi NOT IN (SELECT doi FROM mf WHERE formula_error LIKE 'invalid%')
    UNION ALL SELECT id, 'feature_error: ' || formula_error FROM mf WHERE formula_error LIKE 'invalid%'""")
def c19(t):
    error = F.when(c("formula_error").startswith("invalid"), c("formula_error")).otherwise("")
    kept, removed = cp.quarantine(t.mf, "doi", error)
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(removed.select("id", c(ql.REASON).alias("outcome")))


CHOSEN = ["chi_all", "r_all", "rho_cation", "phi_host", "n_li", "tau_cationic", "log_rho_ratio", "entropy_c_l", "mp_variance_c_l"]


@query("c20_feature_table", f"""SELECT id, family_norm, log10_value, 'kept' AS outcome, {', '.join(CHOSEN)} FROM mf JOIN desc_all USING (formula)
        WHERE coalesce(NOT (value < 1e-6::DOUBLE OR (qualifier = 'upper_bound' AND value <= 1e-6::DOUBLE)), TRUE)
    UNION ALL SELECT id, NULL, NULL, CASE WHEN low THEN 'filtered_out: conductivity < 1e-06' ELSE 'feature_error: ' || formula_error END, {', '.join('NULL' for _ in CHOSEN)} FROM (
        SELECT *, coalesce(value < 1e-6::DOUBLE OR (qualifier = 'upper_bound' AND value <= 1e-6::DOUBLE), FALSE) AS low FROM mf) WHERE low OR formula_error <> ''""",
    " ".join(["log10_value", *CHOSEN]))
def c20(t):
    out = flows.feature_table(t.m)
    kept = out["kept"].select("id", "family_norm", "log10_value", F.lit("kept").alias("outcome"), *CHOSEN)
    removed = out["removed"].select("id", c(ql.REASON).alias("outcome"))
    return kept.unionByName(removed, allowMissingColumns=True)


@query("c21_infer_features", "SELECT feature, n AS numeric_values FROM (UNPIVOT (SELECT "
       + ", ".join(f"count({n}) AS {n}" for n in cp.FEATURE_NAMES if n not in cp.REDUNDANT)
       + " FROM mf JOIN desc_all USING (formula)) ON COLUMNS(*) INTO NAME feature VALUE n) WHERE n > 0")
def c21(t):
    table = t.mf.join(t.descriptors, "formula").withColumn("tag", F.lit("text"))
    columns = [n for n in table.columns if n not in flows.METADATA_COLUMNS and n not in cp.REDUNDANT]
    return cp.feature_counts(table, columns).filter("numeric_values > 0")


TREND_SQL = ", ".join(
    [f"CASE WHEN {s} > 0 THEN log10({s}) END AS {n}" for n, s in cp.TREND_LOGS.items()]
    + [f"{s} AS {'n_li_share' if n == 'n_Li' else n}" for n, s in cp.TREND_SOURCES.items()]
)
NEEDED = [n for n in cp.TREND_NAMES if n not in cp.TREND_OPTIONAL]


@query("c22_trend_descriptor", f"""SELECT *, coalesce({', '.join(f"CASE WHEN {'n_li_share' if n == 'n_Li' else n} IS NULL THEN '{n} undefined' END" for n in NEEDED)}, '') AS reject_reason
    FROM (SELECT formula, {TREND_SQL} FROM desc_all)""", " ".join("n_li_share" if n == "n_Li" else n for n in cp.TREND_NAMES))
def c22(t):
    return cp.trend_descriptor(t.descriptors).withColumnRenamed("n_Li", "n_li_share")


@query("c23_per_distinct", "SELECT id, formula, n_li, chi_range FROM m LEFT JOIN desc_all USING (formula)", "n_li chi_range")
def c23(t):
    def compute(values):
        return cp.descriptors(cp.compositions(values)).select("formula", "n_li", "chi_range")

    return cp.per_distinct(t.m.select("id", "formula"), "formula", compute)

