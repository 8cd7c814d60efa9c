"""Numeric descriptors of chemical formulas.

Work is done once per distinct formula: parse, assign charges in place with
array functions, explode to one row per element, join the fixed element
tables, and aggregate back to one row per formula.  The rows of a formula are
as many as its elements, so no group can grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import elements as el
from saltmarsh.functions import formula as fm
from saltmarsh.functions import physics as ph
from saltmarsh.session import durable

ROLE_LI, ROLE_PROTON, ROLE_HALIDE, ROLE_ANION, ROLE_HOST = "Li", "proton", "halide", "anion", "host_cation"

# Published names of the base descriptors, with our short names.
BASE_NAMES = {
    "chi_all": "χₐₗₗ",
    "chi_anion": "χ⁻",
    "chi_cation": "χ⁺(incl Li⁺)",
    "chi_host": "χ⁺(excl Li⁺)",
    "chi_cation_gap": "χ⁺(incl Li⁺) - χ⁻",
    "chi_host_gap": "χ⁺(excl Li⁺) - χ⁻",
    "chi_range": "χₘₐₓ - χₘᵢₙ",
    "r_all": "rₐₗₗ (pm)",
    "r_anion": "r⁻ (pm)",
    "r_cation": "r⁺(incl Li⁺) (pm)",
    "r_host": "r⁺(excl Li⁺) (pm)",
    "r_host_gap": "r⁺(excl Li⁺) - r⁻",
    "r_cation_gap": "r⁺(incl Li⁺) - r⁻",
    "r_host_ratio": "r⁺(excl Li⁺) / r⁻",
    "r_cation_ratio": "r⁺(incl Li⁺) / r⁻",
    "rho_all": "ρₐₗₗ (C m⁻³)",
    "rho_anion": "ρ⁻ (C m⁻³)",
    "rho_cation": "ρ⁺(incl Li⁺) (C m⁻³)",
    "rho_host": "ρ⁺(excl Li⁺) (C m⁻³)",
    "rho_cation_ratio": "ρ⁺(incl Li⁺) / ρ⁻",
    "rho_cation_gap": "ρ⁺(incl Li⁺) - ρ⁻",
    "phi_cation": "Φ⁺(incl Li⁺) (|Z| pm⁻¹)",
    "phi_host": "Φ⁺(excl Li⁺) (|Z| pm⁻¹)",
    "n_halide": "nₕₐₗᵢdₑ",
    "n_host": "nₕₒₛₜ cₐₜᵢₒₙ",
    "n_anion": "nₐₙᵢₒₙ",
    "n_li": "n_Li",
    "delta_anion": "delta_anion",
    "tau_cationic": "tau_cationic",
}
INTERACTION_NAMES = {
    "r_ratio_x_chi_diff": "r_ratio_x_chi_diff",
    "log_rho_ratio": "log_rho_ratio",
    "n_li_x_r_anion": "n_Li × r⁻ (pm)",
    "chi_range_x_r_avg": "chi_range_x_r_avg",
    "field_x_r_diff": "field_x_r_diff",
}
SMALL_NAMES = {
    "ir_mean_square_all": "ir_mean_square_all",
    "d_mean_c": "d_mean_c",
    "r_mean_l": "r_mean_l",
    "s_mean_square_c": "s_mean_square_c",
    "entropy_c_l": "entropy_c_l",
    "vs_variance_c_l": "Vs_variance_c_l",
    "mp_variance_c_l": "mp_variance_c_l",
    "atwt_geometric_mean_all": "atwt_geometric_mean_all",
}
FEATURE_NAMES = BASE_NAMES | INTERACTION_NAMES | SMALL_NAMES
# Features a model leaves out because another one carries the same information.
REDUNDANT = ("chi_cation", "n_anion", "n_halide", "r_host_ratio", "rho_all", "rho_cation_gap")
CHARGES_JSON = "z_by_element"


def per_distinct(df: DataFrame, key: str, compute) -> DataFrame:
    """Run ``compute`` on the distinct values of ``key`` and join the result back.

    The result is written before the join.  Without that, a filter on a computed
    column would be pushed through the distinct and run the computation on
    every row; and the file size tells the planner whether to broadcast.
    """
    values = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return df.join(durable(compute(values)), key, "left")


def compositions(formulas: DataFrame, key: str = "formula") -> DataFrame:
    """Distinct formulas with their parsed composition; unreadable ones are null.

    Written once, so later filters read the composition instead of parsing.
    """
    return durable(parse_column(formulas.select(key).distinct(), key))


def parse_column(df: DataFrame, key: str = "formula") -> DataFrame:
    return df.withColumn("composition", fm.parse_formula(F.col(key)))


def organic_flag(composition: Column) -> Column:
    return F.coalesce(fm.is_organic(composition), F.lit(False))


def candidates(parsed: DataFrame, key: str = "formula") -> DataFrame:
    """One row per formula and element with the states to try and a neutral flag."""
    spark = parsed.sparkSession
    items = parsed.filter(F.col("composition").isNotNull()).select(
        key,
        fm.is_organic(F.col("composition")).alias("organic"),
        F.posexplode("composition").alias("pos", "item"),
    )
    items = items.select(key, "organic", "pos", "item.element", "item.amount")
    joined = items.join(F.broadcast(el.candidate_dim(spark)), "element", "left")
    neutral = F.col("organic") & F.col("element").isin(*el.NEUTRAL_ORGANIC)
    return joined.select(
        key,
        "pos",
        "element",
        "amount",
        neutral.alias("neutral"),
        F.when(neutral, F.array().cast("array<double>"))
        .otherwise(F.coalesce("states", F.array(F.lit(0.0))))
        .alias("states"),
    )


def _undominated(states: Column) -> Column:
    """Of partial choices with the same charge the one with the smallest sum of |state|, then the first."""
    in_order = F.array_sort(states)
    # The one-element array gives the sorted array a name, so it is sorted once.
    kept = F.transform(F.array(in_order), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (x["key"] != F.get(s, i - 1)["key"])
    ))
    return F.element_at(kept, 1)


def assign_oxidation(parsed: DataFrame, key: str = "formula") -> DataFrame:
    """Charges that best balance each formula.

    The score is |total charge| + 0.001 * sum of |state| over elements with a choice, and the
    first combination wins a tie. Elements are folded one by one over a frontier: what later
    elements add is the same for two choices of equal charge, so only the better one stays.
    The frontier grows with the number of different charges, not with the number of combinations.
    """
    rows = candidates(parsed, key)
    grouped = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "element", "amount", "neutral", "states"))).alias("items")
    )
    charged = F.filter("items", lambda x: ~x["neutral"])
    fixed = F.filter(charged, lambda x: F.size(x["states"]) == 1)
    open_ = F.filter(charged, lambda x: F.size(x["states"]) > 1)
    fixed_charge = F.aggregate(
        fixed, F.lit(0.0), lambda t, x: t + x["amount"] * F.element_at(x["states"], 1)
    )

    def state(charge: Column, size: Column, picked: Column) -> Column:
        return F.struct(F.round(charge, 9).alias("key"), size.alias("size"), picked.alias("picked"), charge.alias("charge"))

    start = F.array(state(fixed_charge, F.lit(0.0), F.array().cast("array<int>")))

    def widen(frontier: Column, item: Column) -> Column:
        return _undominated(F.flatten(F.transform(
            frontier,
            lambda c: F.transform(item["states"], lambda z, i: state(
                c["charge"] + item["amount"] * z, c["size"] + F.abs(z), F.concat(c["picked"], F.array(i))
            )),
        )))

    frontier = F.aggregate(open_, start, widen)
    # Numbers of the picked states compare like the combinations in their order.
    best = F.array_min(F.transform(frontier, lambda c: F.struct(
        F.round(F.abs(c["charge"]) + 0.001 * c["size"], 9).alias("score"), c["picked"].alias("picked"), c["charge"].alias("charge"),
    )))
    picked = grouped.withColumn("open_names", F.transform(open_, lambda x: x["element"])).withColumn("best", best)
    charge = lambda x: F.when(x["neutral"], F.lit(None).cast("double")).otherwise(
        F.when(F.size(x["states"]) == 1, F.element_at(x["states"], 1)).otherwise(F.get(
            x["states"], F.get(F.col("best.picked"), F.array_position(F.col("open_names"), x["element"]).cast("int") - 1)
        ))
    )
    return picked.select(
        key,
        F.transform(
            "items",
            lambda x: F.struct(
                x["element"].alias("element"), x["amount"].alias("amount"), charge(x).alias("charge")
            ),
        ).alias("assigned"),
        F.col("best.charge").alias("residual_charge"),
    )


def charges_json(assigned: Column) -> Column:
    """JSON list of the assigned charges, neutral elements left out."""
    known = F.filter(assigned, lambda x: x["charge"].isNotNull())
    return F.to_json(
        F.transform(
            known, lambda x: F.struct(x["element"].alias("element"), x["charge"].alias("value"))
        )
    )


def charge_balance(parsed: DataFrame, key: str = "formula") -> DataFrame:
    assigned = assign_oxidation(parsed, key)
    return assigned.select(
        key, "residual_charge", charges_json(F.col("assigned")).alias("oxidation_guess")
    )


def element_role(element: Column, charge: Column) -> Column:
    """Class of an element inside one formula."""
    return (
        F.when(element == "Li", ROLE_LI)
        .when((element == "H") & (charge > 0), ROLE_PROTON)
        .when((charge < 0) & element.isin(*el.HALIDES), ROLE_HALIDE)
        .when(charge < 0, ROLE_ANION)
        .when(charge > 0, ROLE_HOST)
        .when(element.isin(*el.HALIDES), ROLE_HALIDE)
        .when(element.isin(*el.ANION_FORMERS), ROLE_ANION)
        .otherwise(ROLE_HOST)
    )


def element_facts(parsed: DataFrame, key: str = "formula") -> DataFrame:
    """One row per formula and element: amount, charge, role and all properties."""
    spark = parsed.sparkSession
    assigned = assign_oxidation(parsed, key)
    rows = assigned.select(
        key, "assigned", F.posexplode("assigned").alias("pos", "item")
    ).select(
        key,
        "pos",
        charges_json(F.col("assigned")).alias(CHARGES_JSON),
        "item.element",
        "item.amount",
        "item.charge",
    )
    whole = F.when((F.col("charge") != 0) & (F.col("charge") == F.round("charge")), F.col("charge"))
    rows = rows.withColumn("_z", whole.cast("int")).withColumn(
        "role", element_role(F.col("element"), F.col("charge"))
    )
    radii = el.radius_dim(spark)
    radii = radii.select(F.col("element"), F.col("charge").alias("_z"), "radius_pm")
    properties = el.element_dim(spark).drop("states", "number").withColumn(
        "_common", F.col("common_charge").cast("int")
    )
    common = radii.select("element", F.col("_z").alias("_common"), F.col("radius_pm").alias("common_radius"))
    properties = properties.join(F.broadcast(common), ["element", "_common"], "left").drop("_common")
    facts = rows.join(F.broadcast(radii), ["element", "_z"], "left").join(
        F.broadcast(properties), "element", "left"
    )
    charge, radius = F.col("charge"), F.col("radius_pm")
    zero = F.lit(0.0)
    return facts.select(
        key,
        CHARGES_JSON,
        "pos",
        "element",
        "amount",
        "charge",
        "role",
        "chi",
        radius.alias("radius"),
        ph.charge_density(charge, radius).alias("rho"),
        ph.ionic_potential(charge, radius).alias("phi"),
        # The statistics below use 0 where a property is unknown.
        F.coalesce(radius, "common_radius", zero).alias("p_ionic_radius"),
        F.coalesce("d_electrons", zero).alias("p_d_electrons"),
        F.coalesce("s_electrons", zero).alias("p_s_electrons"),
        F.coalesce("bond_radius", zero).alias("p_bond_radius"),
        F.coalesce("s_volume", zero).alias("p_s_volume"),
        F.coalesce("melting_k", zero).alias("p_melting"),
        F.coalesce("mass", zero).alias("p_mass"),
    )


# --- group predicates and aggregate builders -------------------------------


def group_predicate(name: str) -> Column:
    """Element groups: all, l (not Li), c (cations), c_l (host cations), a (anions)."""
    role = F.col("role")
    return {
        "all": F.lit(True),
        "l": F.col("element") != "Li",
        "c": role.isin(ROLE_LI, ROLE_HOST),
        "c_l": role == ROLE_HOST,
        "a": role.isin(ROLE_ANION, ROLE_HALIDE),
    }[name]


def weighted_mean(value: Column, predicate: Column) -> Column:
    """Amount-weighted mean over a class; unknown values leave both sums."""
    known = predicate & value.isNotNull()
    weight = F.sum(F.when(known, F.col("amount")))
    return F.when(weight != 0, F.sum(F.when(known, F.col("amount") * value)) / weight)


def value_range(value: Column) -> Column:
    return F.when(F.count(value) >= 2, F.max(value) - F.min(value))


def _share_sum(predicate: Column) -> Column:
    return F.sum(F.when(predicate, F.col("amount")).otherwise(0.0))


def radius_disorder() -> Column:
    """Relative spread of the anion radii."""
    anion = group_predicate("a")
    amount, radius = F.col("amount"), F.col("radius")
    count = F.sum(F.when(anion, 1).otherwise(0))
    missing = F.sum(F.when(anion & radius.isNull(), 1).otherwise(0))
    weight = F.sum(F.when(anion, amount))
    mean = F.sum(F.when(anion, amount * radius)) / weight
    square = F.sum(F.when(anion, amount * radius * radius)) / weight
    spread = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    return (
        F.when(count == 0, F.lit(None).cast("double"))
        .when(count == 1, F.lit(0.0))
        .when((missing > 0) | (mean <= 0), F.lit(None).cast("double"))
        .otherwise(spread / mean)
    )


def weighted_statistic(value: Column, statistic: str, group: str) -> Column:
    """Amount-weighted statistic over an element group; 0 for an empty group."""
    inside = group_predicate(group)
    amount = F.col("amount")
    weight = F.sum(F.when(inside, amount))
    mean = F.sum(F.when(inside, amount * value)) / weight
    square = F.sum(F.when(inside, amount * value * value)) / weight
    if statistic == "mean":
        result = mean
    elif statistic == "mean_square":
        result = square
    elif statistic == "variance":
        result = F.greatest(square - mean * mean, F.lit(0.0))
    elif statistic == "geometric_mean":
        logs = F.sum(F.when(inside & (value > 0), amount * F.ln(F.when(value > 0, value)))) / weight
        flat = F.max(F.when(inside & (value <= 0), 1).otherwise(0)) == 1
        result = F.when(flat, F.lit(0.0)).otherwise(F.exp(logs))
    else:
        raise ValueError(f"unknown statistic {statistic}")
    return F.coalesce(result, F.lit(0.0))


def mixing_entropy(group: str) -> Column:
    """Natural-log mixing entropy: ln(W) - sum(a ln a) / W over the group."""
    inside = group_predicate(group)
    amount = F.col("amount")
    weight = F.sum(F.when(inside, amount))
    logs = F.sum(F.when(inside, amount * F.ln(amount)))
    count = F.sum(F.when(inside, 1).otherwise(0))
    return F.when(count <= 1, F.lit(0.0)).otherwise(F.ln(weight) - logs / weight)


def base_aggregates() -> dict[str, Column]:
    """Base descriptors that are plain aggregates of the element rows."""
    all_, anion, cation, host = (group_predicate(g) for g in ("all", "a", "c", "c_l"))
    role = F.col("role")
    out: dict[str, Column] = {}
    for short, column in (("chi", "chi"), ("r", "radius"), ("rho", "rho")):
        for suffix, predicate in (("all", all_), ("anion", anion), ("cation", cation), ("host", host)):
            out[f"{short}_{suffix}"] = weighted_mean(F.col(column), predicate)
    out["phi_cation"] = weighted_mean(F.col("phi"), cation)
    out["phi_host"] = weighted_mean(F.col("phi"), host)
    out["chi_range"] = value_range(F.col("chi"))
    total = F.sum("amount")
    out["n_halide"] = _share_sum(role == ROLE_HALIDE) / total
    out["n_host"] = _share_sum(host) / total
    out["n_anion"] = _share_sum(role == ROLE_ANION) / total
    out["n_li"] = _share_sum(role == ROLE_LI) / total
    out["delta_anion"] = radius_disorder()
    positive = _share_sum(role.isin(ROLE_LI, ROLE_HOST, ROLE_PROTON))
    out["tau_cationic"] = F.when(positive != 0, _share_sum(anion) / positive)
    return out


def small_aggregates() -> dict[str, Column]:
    """The eight selected group statistics."""
    prop = lambda name: F.col(f"p_{name}")
    return {
        "ir_mean_square_all": weighted_statistic(prop("ionic_radius"), "mean_square", "all"),
        "d_mean_c": weighted_statistic(prop("d_electrons"), "mean", "c"),
        "r_mean_l": weighted_statistic(prop("bond_radius"), "mean", "l"),
        "s_mean_square_c": weighted_statistic(prop("s_electrons"), "mean_square", "c"),
        "entropy_c_l": mixing_entropy("c_l"),
        "vs_variance_c_l": weighted_statistic(prop("s_volume"), "variance", "c_l"),
        "mp_variance_c_l": weighted_statistic(prop("melting"), "variance", "c_l"),
        "atwt_geometric_mean_all": weighted_statistic(prop("mass"), "geometric_mean", "all"),
    }


def base_derived() -> dict[str, Column]:
    """Base descriptors that are differences and ratios of others."""
    c = F.col
    return {
        "chi_cation_gap": ph.safe_diff(c("chi_cation"), c("chi_anion")),
        "chi_host_gap": ph.safe_diff(c("chi_host"), c("chi_anion")),
        "r_host_gap": ph.safe_diff(c("r_host"), c("r_anion")),
        "r_cation_gap": ph.safe_diff(c("r_cation"), c("r_anion")),
        "r_host_ratio": ph.safe_ratio(c("r_host"), c("r_anion")),
        "r_cation_ratio": ph.safe_ratio(c("r_cation"), c("r_anion")),
        "rho_cation_ratio": ph.safe_ratio(c("rho_cation"), c("rho_anion")),
        "rho_cation_gap": ph.safe_diff(c("rho_cation"), c("rho_anion")),
    }


def interactions() -> dict[str, Column]:
    """Five products of base descriptors."""
    c = F.col
    return {
        "r_ratio_x_chi_diff": c("r_cation_ratio") * c("chi_cation_gap"),
        "log_rho_ratio": F.when(
            c("rho_cation_ratio").isNotNull(), F.log10(F.greatest(c("rho_cation_ratio"), F.lit(1e-3)))
        ),
        "n_li_x_r_anion": c("n_li") * c("r_anion"),
        "chi_range_x_r_avg": c("chi_range") * c("r_all"),
        "field_x_r_diff": c("phi_cation") * c("r_cation_gap"),
    }


def _aggregate(parsed: DataFrame, key: str, aggregates: dict[str, Column]) -> DataFrame:
    facts = element_facts(parsed, key)
    named = [column.alias(name) for name, column in aggregates.items()]
    return facts.groupBy(key).agg(F.first(CHARGES_JSON).alias(CHARGES_JSON), *named)


def base_descriptors(parsed: DataFrame, key: str = "formula") -> DataFrame:
    table = _aggregate(parsed, key, base_aggregates()).withColumns(base_derived())
    return table.select(key, CHARGES_JSON, *BASE_NAMES)


def small_descriptors(parsed: DataFrame, key: str = "formula") -> DataFrame:
    return _aggregate(parsed, key, small_aggregates()).drop(CHARGES_JSON)


def descriptors(parsed: DataFrame, key: str = "formula") -> DataFrame:
    """All 42 numeric descriptors in one aggregation pass."""
    table = _aggregate(parsed, key, base_aggregates() | small_aggregates())
    table = table.withColumns(base_derived()).withColumns(interactions())
    return table.select(key, CHARGES_JSON, *FEATURE_NAMES)


def published_names(df: DataFrame) -> DataFrame:
    """Rename descriptor columns to their published names."""
    return df.withColumnsRenamed({k: v for k, v in FEATURE_NAMES.items() if k in df.columns})


def reuse(keys: DataFrame, prior: DataFrame, key: str, order: Column, required: Sequence[str], compute) -> DataFrame:
    """Take descriptors of known keys from ``prior`` and compute the rest.

    The latest prior row of a key wins.  A prior table without the required
    columns is ignored.
    """
    wanted = keys.select(key).distinct()
    if not set(required) <= set(prior.columns):
        return compute(wanted).select(key, *required, F.lit(False).alias("reused"))
    latest = prior.groupBy(key).agg(F.max_by(F.struct(*required), order).alias("_latest"))
    hits = wanted.join(latest, key).select(key, "_latest.*", F.lit(True).alias("reused"))
    fresh = compute(wanted.join(prior.select(key).distinct(), key, "left_anti"))
    return hits.unionByName(fresh.select(key, *required, F.lit(False).alias("reused")))


def quarantine(df: DataFrame, id_col: str, error: Column, prefix: str = "feature_error: ") -> tuple[DataFrame, DataFrame]:
    """Split off rows that failed; every row sharing a failed id leaves the kept side."""
    removed = df.filter(error != "").withColumn("removed_reason", F.concat(F.lit(prefix), error))
    kept = df.join(removed.select(id_col).distinct(), id_col, "left_anti")
    return kept, removed


def infer_features(df: DataFrame, metadata: Sequence[str], redundant: Sequence[str] = REDUNDANT) -> list[str]:
    """Columns with at least one number that are neither metadata nor redundant.

    One aggregate over the table; its single row of counts comes to the driver.
    """
    candidates_ = [c for c in df.columns if c not in metadata and c not in redundant]
    counts = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in candidates_]).first()
    return [c for c in candidates_ if counts[c] > 0]


def feature_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its count of numeric values."""
    counts = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in columns])
    stacked = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {stacked}) AS (feature, numeric_values)")


# Names of the pair descriptors and the short names they come from.
TREND_SOURCES = {
    "entropy_c_l": "entropy_c_l",
    "field_x_r_diff": "field_x_r_diff",
    "n_Li": "n_li",
    "log_rho_ratio": "log_rho_ratio",
    "r_all_pm": "r_all",
    "n_host_cation": "n_host",
    "ir_mean_square_all": "ir_mean_square_all",
    "atwt_geometric_mean_all": "atwt_geometric_mean_all",
    "chi_all": "chi_all",
    "chi_minus": "chi_anion",
    "r_minus_pm": "r_anion",
    "chi_plus_excl_minus_chi_minus": "chi_host_gap",
    "phi_plus_excl_li": "phi_host",
    "r_plus_incl_minus_r_minus": "r_cation_gap",
    "chi_plus_incl_minus_chi_minus": "chi_cation_gap",
    "chi_range_x_r_avg": "chi_range_x_r_avg",
    "r_plus_incl_li_pm": "r_cation",
    "rho_plus_excl_li_c_m3": "rho_host",
    "r_plus_excl_minus_r_minus": "r_host_gap",
    "n_li_x_r_minus_pm": "n_li_x_r_anion",
}
TREND_LOGS = {"log10_rho_plus_incl_li": "rho_cation", "log10_phi_plus_incl_li": "phi_cation"}
TREND_OPTIONAL = (
    "chi_plus_excl_minus_chi_minus",
    "phi_plus_excl_li",
    "rho_plus_excl_li_c_m3",
    "r_plus_excl_minus_r_minus",
)
TREND_NAMES = (*TREND_LOGS, *TREND_SOURCES)


def trend_descriptor(table: DataFrame, key: str = "formula") -> DataFrame:
    """The 22 descriptors a pair needs, and why a formula cannot have them."""
    columns = {n: F.log10(F.when(F.col(s) > 0, F.col(s))) for n, s in TREND_LOGS.items()}
    columns |= {n: F.col(s) for n, s in TREND_SOURCES.items()}
    out = table.select(key, *[c.alias(n) for n, c in columns.items()])
    needed = [n for n in TREND_NAMES if n not in TREND_OPTIONAL]
    reasons = [F.when(F.col(n).isNull() | F.isnan(n), F.lit(f"{n} undefined")) for n in needed]
    return out.withColumn("reject_reason", F.coalesce(*reasons, F.lit("")))
