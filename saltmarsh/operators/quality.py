"""Row rejection with reasons, invariants, reconciliation and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import formula as fm
from saltmarsh.functions import physics as ph
from saltmarsh.functions import text as tx
from saltmarsh.operators import composition as cp
from saltmarsh.operators.ordering import exact_quantiles, join_groups, member_lists, spread_join
from saltmarsh.session import durable, small_table

REASON = "removed_reason"


def parse_measurements(df: DataFrame) -> DataFrame:
    """Read the text columns of a measurement table into typed ones."""
    text = F.col("conductivity_text")
    return df.withColumns({
        "value": tx.measure_value(text),
        "qualifier": tx.measure_qualifier(text),
        "family_norm": tx.normalize_label(F.col("family")),
        "doi_tokens": tx.doi_tokens(F.col("doi_text")),
    }).withColumns({
        "log10_value": ph.safe_log10(F.col("value")),
        "doi": F.array_join("doi_tokens", "|"),
    })


def with_formula(df: DataFrame, formula: str = "formula") -> DataFrame:
    """Attach composition, key, full text and error, computed per distinct formula."""

    def compute(values: DataFrame) -> DataFrame:
        parsed = cp.parse_column(values, formula)
        composition = F.col("composition")
        return parsed.withColumns({
            "formula_key": fm.formula_key(composition),
            "formula_full": fm.full_formula(composition),
            "formula_error": fm.formula_error(F.col(formula), composition),
        })

    return cp.per_distinct(df, formula, compute)


# --- filters ---------------------------------------------------------------


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with one."""
    tagged = df.withColumn(REASON, reason)
    kept = tagged.filter(F.col(REASON).isNull()).drop(REASON)
    return kept, tagged.filter(F.col(REASON).isNotNull())


def first_reason(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """Reason of the first rule that holds, null when none does."""
    texts = [
        F.when(condition, reason if isinstance(reason, Column) else F.lit(reason))
        for condition, reason in rules
    ]
    return F.coalesce(*texts)


def reject_first(df: DataFrame, rules: Sequence[tuple[Column, Column | str]]) -> tuple[DataFrame, DataFrame]:
    return split_by_reason(df, first_reason(rules))


def drop_organic(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    organic = cp.organic_flag(F.col("composition"))
    return split_by_reason(df, F.when(organic, "organic-like formula"))


def drop_charge_abnormal(
    df: DataFrame, limit: float, listed_ids: Sequence[str], id_col: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Remove ids whose formula does not balance or that are listed."""
    balance = cp.charge_balance(cp.compositions(df)).select("formula", "residual_charge")
    rows = df.join(durable(balance), "formula", "left")
    reasons = F.concat_ws(
        "; ",
        F.when(F.abs("residual_charge") > limit, F.lit(f"abs(residual_charge) > {limit:g}")),
        F.when(F.col(id_col).isin(*listed_ids), F.lit("manual abnormal charge screening")),
    )
    flagged = rows.select(id_col, F.nullif(reasons, F.lit("")).alias(REASON)).filter(F.col(REASON).isNotNull())
    # A flagged id removes all rows that share it.
    bad = flagged.groupBy(id_col).agg(F.min(REASON).alias(REASON))
    kept = rows.join(bad.select(id_col), id_col, "left_anti")
    return kept, rows.join(bad, id_col)


def threshold_policy(df: DataFrame, minimum: float | None) -> tuple[DataFrame, DataFrame]:
    """Drop low values; keep unparsed rows with a null logarithm and weight 1."""
    value = F.col("value")
    low = F.lit(False)
    if minimum is not None:
        low = F.coalesce(
            (value < minimum) | ((F.col("qualifier") == "upper_bound") & (value <= minimum)), F.lit(False)
        )
    rows = df.withColumns({
        "value_used": value,
        "log10_value": ph.safe_log10(value),
        "sample_weight": F.lit(1.0),
    })
    reason = F.when(low, F.lit(f"filtered_out: conductivity < {minimum:g}" if minimum is not None else ""))
    return split_by_reason(rows, reason)


def active_only(df: DataFrame, column: str = "status") -> DataFrame:
    if column not in df.columns:
        return df
    return df.filter(F.lower(tx.strip(F.col(column))) == "active")


def apply_overrides(df: DataFrame, key: str, target: str, overrides: Mapping[str, str]) -> DataFrame:
    """Replace ``target`` where ``key`` is listed in a small fixed table."""
    if not overrides:
        return df
    table = small_table(df.sparkSession, list(overrides.items()), f"{key} string, _override string")
    joined = df.join(F.broadcast(table), key, "left")
    return joined.withColumn(target, F.coalesce("_override", target)).drop("_override").select(*df.columns)


def drop_both_low(pairs: DataFrame, features: DataFrame, limit: float, a: str, b: str, key: str) -> DataFrame:
    """Feature rows of pairs with at least one endpoint at or above ``limit``."""
    keep = pairs.filter(~((F.col(a) < limit) & (F.col(b) < limit))).select(key)
    return features.join(keep, key, "left_semi")


# --- accounting ------------------------------------------------------------


def accounting(kept: DataFrame, removed: DataFrame, source: str = "source") -> DataFrame:
    """Rows in, kept, and removed by reason, per source."""
    both = kept.select(source, F.lit("kept").alias("outcome")).unionByName(
        removed.select(source, F.col(REASON).alias("outcome"))
    )
    return both.groupBy(source, "outcome").agg(F.count("*").alias("row_count"))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Count of rows breaking each rule; one aggregate for all rules."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    stacked = ", ".join(f"'{n}', `{n}`" for n in rules)
    return counts.selectExpr(f"stack({len(rules)}, {stacked}) AS (rule, violation_count)")


def pair_table_rules(model_columns: Sequence[str], optional: Sequence[str]) -> dict[str, Column]:
    """Row rules of a pair feature table."""
    def any_of(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, columns, F.lit(False))

    infinite = any_of([F.abs(F.col(c)) == F.lit(float("inf")) for c in model_columns])
    missing = any_of([F.col(c).isNull() | F.isnan(c) for c in model_columns if c not in optional])
    magnitudes = [c for c in model_columns if c.startswith("abs_delta_") and c[4:] in model_columns]
    gap = any_of([F.abs(F.col(c) - F.abs(F.col(c[4:]))) > 1e-8 for c in magnitudes])
    return {
        "infinite feature": infinite,
        "missing feature": missing,
        "magnitude differs from signed change": gap,
        "distance outside [0, 2]": ~F.col("composition_L1_distance").between(0.0, 2.0 + 1e-9),
    }


def check_invariants(
    df: DataFrame, rules: Mapping[str, Column], unique: str, group: str, weight: str
) -> DataFrame:
    """All violation counts of a table: row rules, duplicate ids, group weights."""
    duplicates = df.groupBy(unique).count().agg(F.count_if(F.col("count") > 1).alias("violation_count"))
    weights = df.groupBy(group).agg(F.sum(weight).alias("w")).agg(
        F.count_if(F.abs(F.col("w") - 1) > 1e-8).alias("violation_count")
    )
    return (
        violations(df, rules)
        .unionByName(duplicates.select(F.lit("duplicate id").alias("rule"), "violation_count"))
        .unionByName(weights.select(F.lit("group weight not 1").alias("rule"), "violation_count"))
    )


def require_none(found: DataFrame) -> DataFrame:
    """Fail when any rule is violated."""
    broken = found.filter("violation_count > 0").limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violation_count']}" for r in broken))
    return found


def reconcile(
    a: DataFrame, b: DataFrame, key: str, text: str, number: str, rtol: float = 1e-10, atol: float = 1e-12
) -> DataFrame:
    """Classify every key of two tables: missing, extra, text, number or same."""
    left = a.select(key, F.col(text).alias("text_a"), F.col(number).alias("number_a"), F.lit(True).alias("in_a"))
    right = b.select(key, F.col(text).alias("text_b"), F.col(number).alias("number_b"), F.lit(True).alias("in_b"))
    joined = left.join(right, key, "full_outer")
    close = F.abs(F.col("number_a") - F.col("number_b")) <= atol + rtol * F.abs("number_b")
    return joined.withColumn(
        "status",
        F.when(F.col("in_b").isNull(), "missing")
        .when(F.col("in_a").isNull(), "extra")
        .when(~F.col("text_a").eqNullSafe(F.col("text_b")), "text mismatch")
        .when(~F.coalesce(close, F.col("number_a").isNull() & F.col("number_b").isNull()), "number mismatch")
        .otherwise("same"),
    ).select(key, "status")


# --- audits ----------------------------------------------------------------

def valid_measurements(df: DataFrame) -> DataFrame:
    return df.filter((F.col("formula_error") == "") & (F.col("value") > 0))


def dup_audit(df: DataFrame) -> DataFrame:
    """Formulas measured more than once, one row each: how often, and the spread.

    Their members are rows of ``dup_members``, so no row grows with the data.
    """
    return _repeated(valid_measurements(df)).orderBy(F.desc("log10_span"), F.desc("row_count"), "formula_key")


def _repeated(valid: DataFrame) -> DataFrame:
    return valid.groupBy("formula_key").agg(
        F.count("*").alias("row_count"),
        F.min("log10_value").alias("log10_min"),
        F.max("log10_value").alias("log10_max"),
    ).filter("row_count > 1").withColumn("log10_span", F.col("log10_max") - F.col("log10_min"))


def dup_members(df: DataFrame) -> DataFrame:
    """The measurements of the formulas in ``dup_audit``, one row each."""
    valid = valid_measurements(df).select("formula_key", "id", "conductivity_text", "doi_text")
    return spread_join(valid, _repeated(valid_measurements(df)).select("formula_key"), "formula_key")


MEMBERS_PER_LIST = 1000


def dup_lists(df: DataFrame, rows_per_list: int = MEMBERS_PER_LIST) -> DataFrame:
    """``dup_audit`` with the ordered members, in lists of at most ``rows_per_list`` (``list_no`` 0, 1, ...)."""
    members = dup_members(df)
    lists = member_lists(
        members, ["formula_key"], [F.col(n) for n in ("id", "conductivity_text", "doi_text")],
        {"ids": F.col("id"), "conductivities": F.col("conductivity_text"), "dois": F.col("doi_text")}, rows_per_list,
    )
    return _repeated(valid_measurements(df)).join(lists, "formula_key").orderBy(
        F.desc("log10_span"), F.desc("row_count"), "formula_key", "list_no"
    )


def family_share(df: DataFrame, label: str = "family_norm") -> DataFrame:
    """Row count and fraction of the whole per label."""
    counts = df.groupBy(label).agg(F.count("*").alias("row_count"))
    total = counts.agg(F.sum("row_count").alias("_total"))
    joined = counts.join(F.broadcast(total), F.lit(True))  # one row of totals
    return joined.select(label, "row_count", (F.col("row_count") / F.col("_total")).alias("fraction"))


def label_sets(df: DataFrame, key: Column, name: str, label: str = "family_norm") -> DataFrame:
    """Distinct known labels per key, sorted; the labels are a small vocabulary."""
    pairs = df.filter(F.col(label) != tx.UNKNOWN).select(key.alias(name), label).distinct()
    return pairs.groupBy(name).agg(F.array_sort(F.collect_list(label)).alias("labels"))


def crosstab(df: DataFrame, group: str, label: str, levels: Sequence[str]) -> DataFrame:
    """Counts of each label level per group, 0 when absent."""
    return df.groupBy(group).pivot(label, list(levels)).count().fillna(0)


def describe_split(df: DataFrame, split: str, value: str) -> DataFrame:
    """Rows, min, median, max and mean of a target per split."""
    stats = df.groupBy(split).agg(
        F.count("*").alias("row_count"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )
    return join_groups(stats, exact_quantiles(df, [split], value, {"median_value": 0.5}), [split], "left")


def melt(df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Stack numeric columns into (name, value) rows."""
    stacked = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {stacked}) AS ({name}, {value})")


def iqr_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, fences and outliers per column, all columns in one pass."""
    long = melt(df, columns)
    quartiles = exact_quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    quartiles = quartiles.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lower_fence": F.col("q1") - 1.5 * F.col("iqr"),
        "upper_fence": F.col("q3") + 1.5 * F.col("iqr"),
    })
    # One row per audited column: bounded by the column list.
    fenced = long.join(F.broadcast(quartiles), "feature", "left")
    value = F.col("value")
    outside = (value < F.col("lower_fence")) | (value > F.col("upper_fence"))
    names = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    out = fenced.groupBy("feature", *names).agg(
        F.count(value).alias("value_count"),
        F.count_if(value.isNull()).alias("missing_count"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count_if(F.coalesce(outside, F.lit(False))).alias("outlier_count"),
    )
    total = F.col("value_count") + F.col("missing_count")
    return out.withColumns({
        "missing_ratio": F.col("missing_count") / total,
        "outlier_ratio": ph.safe_ratio(F.col("outlier_count"), F.col("value_count")),
    })


def residual_summary(df: DataFrame, dataset: str, residual: str) -> DataFrame:
    """Location, spread and tails of residuals per dataset."""
    r = F.col(residual)
    stats = df.groupBy(dataset).agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean_residual"),
        F.stddev(r).alias("std_residual"),
        F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg((r < 0).cast("double")).alias("negative_fraction"),
        F.avg((F.abs(r) <= 1).cast("double")).alias("within_1_fraction"),
    )
    points = {"q05": 0.05, "q25": 0.25, "median_residual": 0.5, "q75": 0.75, "q95": 0.95}
    return join_groups(stats, exact_quantiles(df, [dataset], residual, points), [dataset], "left")
