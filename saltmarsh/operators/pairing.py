"""Ordered comparison pairs and their features."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions import formula as fm
from saltmarsh.functions import physics as ph
from saltmarsh.functions import text as tx
from saltmarsh.operators import composition as cp
from saltmarsh.operators.ordering import group_row_limit, groups_fit, join_groups, row_rank, running_sum
from saltmarsh.operators.windows import group_weight, pairs_adjacent
from saltmarsh.session import durable

# Endpoint descriptors kept for both sides.
ENDPOINTS = (
    "r_all_pm", "chi_plus_excl_minus_chi_minus", "chi_all", "phi_plus_excl_li", "field_x_r_diff",
    "r_plus_incl_minus_r_minus", "chi_plus_incl_minus_chi_minus", "chi_range_x_r_avg",
    "r_plus_incl_li_pm", "rho_plus_excl_li_c_m3", "r_plus_excl_minus_r_minus", "n_li_x_r_minus_pm",
)
# Descriptors used as signed change, as pair mean, as absolute change.
CHANGES = (
    "entropy_c_l", "log10_rho_plus_incl_li", "field_x_r_diff", "n_Li", "log_rho_ratio", "r_all_pm",
    "ir_mean_square_all", "atwt_geometric_mean_all", "chi_all",
    *[e for e in ENDPOINTS if e not in ("r_all_pm", "chi_all", "field_x_r_diff")],
)
MEANS = (
    "entropy_c_l", "log10_rho_plus_incl_li", "log10_phi_plus_incl_li", "field_x_r_diff", "n_Li",
    "r_all_pm", "atwt_geometric_mean_all",
)
MAGNITUDES = ("entropy_c_l", "log10_rho_plus_incl_li", "log10_phi_plus_incl_li", "field_x_r_diff")
DISTANCE = "composition_L1_distance"
# Atomic shares of a formula, from which the distance of two is taken.
SHARES = "shares"
# A pair's model columns as one vector, read from a to b and from b to a.
VECTORS = ("features", "features_back")
# Why a pair has no features; empty when it has.
REJECT = "reject_reason"

SIGNED_FEATURES = tuple(f"delta_{n}" for n in CHANGES)
MODEL_FEATURES = (
    *SIGNED_FEATURES,
    *[f"mean_{n}" for n in MEANS],
    *[f"abs_delta_{n}" for n in MAGNITUDES],
    DISTANCE,
    *[f"a_{n}" for n in ENDPOINTS],
    *[f"b_{n}" for n in ENDPOINTS],
)
# These may be missing: they need a host cation.
OPTIONAL_FEATURES = tuple(
    f"{side}_{n}" for n in cp.TREND_OPTIONAL for side in ("delta", "a", "b")
)
LABELS = ("decrease", "unchanged", "increase")
LABEL_CLASS = {"decrease": -1, "unchanged": 0, "increase": 1}
THRESHOLD = 1e-4

ROWS_PER_BLOCK = 1000


def pairs_all(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK,
    size: str | None = None,
) -> DataFrame:
    """Every unordered pair of a group once, the smaller row (by ``order``) first.

    A group is cut into blocks by a hash of its order key and the join runs per
    pair of blocks, so a hot group becomes many equal tasks of bounded size
    instead of one.  The pairs are the result; nothing beyond them is produced.
    ``size`` names a column with the rows of the group, if the caller has it.
    """
    if size:
        blocked = df.withColumn("_blocks", F.ceil(F.col(size) / F.lit(rows_per_block)))
    else:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows_per_block)).alias("_blocks"))
        blocked = join_groups(df, sizes, keys)
    rows = blocked.withColumn(
        "_block", F.pmod(F.xxhash64(*order), F.col("_blocks"))
    ).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    rows = rows.withColumns({"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")})
    join_keys = [*keys, "_lo", "_hi"]
    carried = dict.fromkeys([*cols, *order])

    def side(name: str) -> DataFrame:
        return rows.select(*join_keys, F.col("_block").alias(f"_block_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in carried])

    def place(name: str) -> Column:
        return F.struct(*[F.col(f"{c}_{name}").alias(c) for c in order])

    same = F.col("_lo") == F.col("_hi")
    joined = join_groups(side("a"), side("b"), join_keys).filter(
        (place("a") < place("b")) & (same | (F.col("_block_a") != F.col("_block_b")))
    )
    return joined.select(*keys, *[f"{c}_{s}" for c in cols for s in ("a", "b")])


GROUP_COLUMNS = ("doi", "method", "temperature_c", "family", "kind")


def pairing_input(df: DataFrame) -> DataFrame:
    """Add element set and composition vector per distinct formula, and the kind."""

    def compute(values: DataFrame) -> DataFrame:
        parsed = cp.parse_column(values)
        composition = F.col("composition")
        return parsed.select(
            "formula",
            fm.element_set(composition).alias("element_set"),
            fm.composition_vector(composition).alias("vector"),
        )

    return cp.per_distinct(df, "formula", compute).withColumn("kind", tx.measure_kind(F.col("note")))


PAYLOAD = ("id", "_formula", "conductivity_text", "value", "_rank")


def _codes(df: DataFrame) -> DataFrame:
    """Numbers for the formula texts of pairing rows; those of vectors stand in the vectors' order."""
    texts = ["formula", "vector", "element_set"]
    # Written before they are numbered, since an order over a whole table reads its rows twice.
    distinct = durable(df.select(*texts).distinct())
    found = durable(row_rank(distinct, [], [F.col(n) for n in ("vector", "formula", "element_set")], "_code"))
    coded = found
    for text, code in zip(texts, ("_formula", "_rank", "_set")):
        coded = join_groups(coded, found.groupBy(text).agg(F.min("_code").alias(code)), [text])
    known = {code: F.when(F.col(text).isNotNull(), F.col(code)) for text, code in (("formula", "_formula"), ("element_set", "_set"))}
    return durable(coded.withColumns(known).drop("_code"))


def build_pairs(df: DataFrame, group: Sequence[str] = GROUP_COLUMNS) -> DataFrame:
    """Comparison pairs inside measurement groups.

    Groups of one element set are paired along their composition, groups of
    several element sets in all combinations.  Expects ``pairing_input``
    columns plus ``value``.

    Formulas, vectors and element sets are moved and compared as numbers (``_codes``).
    If all rows of one value of the first group column fit a task, they are shuffled once and
    groups and pairs are numbered inside it, behind the numbers of the values before.
    """
    group = list(group)
    codes = _codes(df)
    rows = join_groups(df, codes, ["formula", "vector", "element_set"]).select(*group, *PAYLOAD, "_set")
    if len(group) > 1 and groups_fit(df, group[:1], None):
        numbered = _pairs_by_first(rows, group)
    else:
        numbered = _pairs_by_group(durable(rows), group)
    names = durable(codes.filter("_formula IS NOT NULL").select("_formula", "formula").distinct())
    for s in "ab":
        numbered = numbered.join(names.withColumnsRenamed({n: f"{n}_{s}" for n in names.columns}), f"_formula_{s}")
    return numbered.select(
        F.format_string("trgrp_%04d", "group_no").alias("group_id"),
        F.format_string("trpair_%06d", "pair_no").alias("pair_id"),
        "id_a", "id_b", "formula_a", "formula_b", "conductivity_text_a", "conductivity_text_b",
        "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"),
        *group,
    )


def _pairs_by_first(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Numbered pairs, when the rows of each value of the first group column fit one task."""
    first, *rest = group
    value, whole = Window.partitionBy(first), Window.partitionBy(*group)
    # One after the other, the finest order first: the rest then stands on its sort.
    rows = df.withColumn("_head", F.row_number().over(value.orderBy(*rest, "_rank", "id")) == 1)
    rows = rows.withColumn("_group", F.dense_rank().over(value.orderBy(*rest)).cast("bigint"))
    rows = rows.withColumn("_groups", F.max("_group").over(value))
    rows = rows.withColumn("_b", F.lead(F.struct(*PAYLOAD)).over(whole.orderBy("_rank", "id")))
    rows = rows.withColumns({
        "_rows": F.count("*").over(whole), "_one_set": F.min("_set").over(whole) == F.max("_set").over(whole),
    })
    follows = F.col("_one_set") & (F.col("_formula") != F.col("_b._formula"))
    wanted = rows.withColumn("_b", F.when(follows, F.col("_b"))).drop("_set")
    # Rows that can be in a pair, and one row that counts the groups of each value.
    wanted = durable(wanted.filter(F.col("_head") | F.col("_b").isNotNull() | ~F.col("_one_set")))
    cols = list(PAYLOAD)
    adjacent = wanted.filter(F.col("_b").isNotNull()).select(
        *group, "_group", *[F.col(c).alias(f"{c}_a") for c in cols], *[F.col(f"_b.{c}").alias(f"{c}_b") for c in cols]
    )
    mixed = wanted.filter("NOT _one_set").withColumn("_facts", F.struct(*rest))
    combined = pairs_all(mixed, [first, "_group"], ["_rank", "id"], [*cols, "_facts"], size="_rows").select(
        first, "_facts_a.*", "_group", *[f"{c}_{s}" for c in cols for s in "ab"]
    )
    pairs = durable(adjacent.unionByName(combined).filter("_formula_a != _formula_b"))
    counts = durable(join_groups(
        wanted.filter("_head").select(first, "_groups"), pairs.groupBy(first).agg(F.count("*").alias("_pairs")), [first], "left"
    ).withColumn("_pairs", F.coalesce("_pairs", F.lit(0))))
    before = running_sum(counts, [], [F.col(first)], F.col("_groups"), "_groups_upto")
    before = durable(running_sum(before, [], [F.col(first)], F.col("_pairs"), "_pairs_upto").select(
        first, (F.col("_groups_upto") - F.col("_groups")).alias("_groups_before"),
        (F.col("_pairs_upto") - F.col("_pairs")).alias("_pairs_before"),
    ))
    order = [F.col(c) for c in ("_group", "_rank_a", "id_a", "_rank_b", "id_b")]
    most = counts.agg(F.max("_pairs")).first()[0] or 0
    if most < group_row_limit(df):
        # The offsets of a value go before its pairs, so both are in one shuffle.
        marked = pairs.unionByName(before.withColumn("_group", F.lit(0).cast("bigint")), allowMissingColumns=True)
        ranked = marked.withColumns({
            "_no": F.row_number().over(value.orderBy(*order)) - 1,
            **{n: F.max(n).over(value) for n in ("_groups_before", "_pairs_before")},
        }).filter("_group > 0")
    else:
        ranked = join_groups(row_rank(pairs, [first], order, "_no", most), before, [first])
    return ranked.withColumns({
        "group_no": F.col("_group") + F.col("_groups_before"), "pair_no": F.col("_no") + F.col("_pairs_before"),
    })


def _pairs_by_group(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Numbered pairs of groups of any size."""
    groups = df.groupBy(*group).agg(
        (F.min("_set") == F.max("_set")).alias("_one_set"), F.count("*").alias("_rows")
    )
    # Groups of one row are numbered too.
    numbered = durable(row_rank(groups, [], [F.col(c) for c in group], "group_no").filter("_rows > 1"))
    # The rows feed both pairings.
    cols = list(PAYLOAD)
    rows = durable(join_groups(df, numbered, group).select("group_no", "_one_set", "_rows", *cols))
    adjacent = pairs_adjacent(rows.filter("_one_set").select("group_no", *cols), ["group_no"], [F.col("_rank"), F.col("id")], cols)
    combined = pairs_all(rows.filter("NOT _one_set"), ["group_no"], ["_rank", "id"], cols, size="_rows")
    pairs = durable(adjacent.unionByName(combined).filter("_formula_a != _formula_b"))
    order = [F.col(c) for c in ("group_no", "_rank_a", "id_a", "_rank_b", "id_b")]
    return row_rank(pairs, [], order, "pair_no").join(numbered.select("group_no", *group), "group_no")


def segment_pairs(df: DataFrame, part: Sequence[str], order: Sequence[Column], cols: Sequence[str], family: str) -> DataFrame:
    """Neighbouring rows inside each segment; ``mixed`` when families differ."""
    pairs = pairs_adjacent(df, part, order, [*cols, family])
    a, b = F.col(f"{family}_a"), F.col(f"{family}_b")
    return pairs.withColumn(family, F.when(a == b, a).otherwise("mixed"))


def enrich_pairs(pairs: DataFrame, table: DataFrame, key: str = "formula") -> DataFrame:
    """Descriptors of both endpoints as structs ``da`` and ``db``, and why a pair lacks one.

    Every pair stays.  A side without usable descriptors is null, and
    ``reject_reason`` names its formula; it is empty for the other pairs.
    """
    columns = [c for c in table.columns if c not in (key, REJECT)]
    reason = F.col(REJECT) if REJECT in table.columns else F.lit("")
    packed = table.select(key, F.when(reason == "", F.struct(*columns)).alias("_d"), reason.alias("_why"))
    out = pairs
    for s in ("a", "b"):
        side = packed.select(F.col(key).alias(f"{key}_{s}"), F.col("_d").alias(f"d{s}"), F.col("_why").alias(f"_why_{s}"))
        out = out.join(side, f"{key}_{s}", "left")

    def told(s: str) -> Column:
        why = F.coalesce(F.col(f"_why_{s}"), F.lit("no descriptors"))
        return F.when(why != "", F.concat(F.coalesce(F.col(f"{key}_{s}"), F.lit("missing formula")), F.lit(": "), why))

    reasons = F.array_distinct(F.array_compact(F.array(told("a"), told("b"))))
    return out.withColumn(REJECT, F.array_join(reasons, "; ")).drop("_why_a", "_why_b")


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that have features; tables without a reason column have only such pairs."""
    return pairs.filter(F.col(REJECT) == "") if REJECT in pairs.columns else pairs


def rejected_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col(REJECT) != "") if REJECT in pairs.columns else pairs.limit(0)


def pair_features(enriched: DataFrame) -> DataFrame:
    """The 54 model columns of pairs carrying ``da`` and ``db``; null where they need a missing side."""
    a, b = (lambda n: F.col(f"da.{n}")), (lambda n: F.col(f"db.{n}"))
    columns: dict[str, Column] = {}
    for n in CHANGES:
        columns[f"delta_{n}"] = b(n) - a(n)
    for n in MEANS:
        columns[f"mean_{n}"] = (a(n) + b(n)) / 2.0
    for n in MAGNITUDES:
        columns[f"abs_delta_{n}"] = F.abs(b(n) - a(n))
    columns[DISTANCE] = fm.share_distance(a(SHARES), b(SHARES))
    for n in ENDPOINTS:
        columns[f"a_{n}"] = a(n)
        columns[f"b_{n}"] = b(n)
    rest = [c for c in enriched.columns if c not in ("da", "db")]
    return enriched.select(*rest, *[columns[n].alias(n) for n in MODEL_FEATURES])


def formula_descriptors(formulas: DataFrame, key: str = "formula") -> DataFrame:
    """Pair descriptors, composition and ``reject_reason`` (empty: usable), one row per distinct formula."""
    parsed = cp.compositions(formulas, key)
    table = cp.trend_descriptor(cp.descriptors(parsed, key), key)
    # One row per distinct formula, joined to both sides of every pair.
    found = parsed.join(table, key, "left").withColumn(REJECT, F.coalesce(REJECT, F.lit("unreadable formula")))
    return durable(found.withColumn(SHARES, F.when(F.col(REJECT) == "", fm.fractions(F.col("composition")))))


def rejected_formulas(pairs: DataFrame) -> DataFrame:
    """Formulas whose pairs cannot have features, with the reason."""
    return formula_descriptors(pair_formulas(pairs)).filter(F.col(REJECT) != "").select("formula", REJECT)


def pair_formulas(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("formula_a").alias("formula")).union(pairs.select("formula_b")).distinct()


def label_columns(delta: Column, threshold: float = THRESHOLD) -> dict[str, Column]:
    label = ph.trend_label(delta, threshold)
    classes = F.create_map(*[F.lit(v) for pair in LABEL_CLASS.items() for v in pair])
    return {"trend_label": label, "trend_class": classes[label]}


def label_pairs(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs with their change and its label; no row is moved."""
    delta = F.col("value_b") - F.col("value_a")
    return pairs.withColumns({
        "absolute_change": F.abs(delta),
        "absolute_threshold": F.lit(float(threshold)),
        "log10_ratio_b_over_a": F.log10(F.col("value_b") / F.col("value_a")),
    } | label_columns(delta, threshold))


def pair_table(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Compact pair table: labels, group-equal weight and the model columns."""
    weighted = group_weight(label_pairs(pairs, threshold), "group_id", "pair_weight_group_equal")
    return pair_features(enrich_pairs(weighted, formula_descriptors(pair_formulas(pairs))))


# Contract order of the columns kept beside the model columns.
TRACE_COLUMNS = (
    "pair_id", "group_id", "group_label", "group_size", "id_a", "id_b", "source_row_a", "source_row_b",
    "formula_a", "formula_b", "doi", "temperature", "temperature_C", "temperature_basis",
    "temperature_raw", "preparation_method", "family", "family_normalized", "amorphous_status_a",
    "amorphous_status_b", "crystal_phase_a", "crystal_phase_b", "phase_quality_status_a",
    "phase_quality_status_b", "conductivity_measurement_type", "conductivity_measurement_type_a",
    "conductivity_measurement_type_b", "measurement_quality_a", "measurement_quality_b",
    "measurement_quality_flags_a", "measurement_quality_flags_b", "source_curation_status_a",
    "source_curation_status_b", "source_curation_flags_a", "source_curation_flags_b", "year_a",
    "year_b", "label_quality", "pair_weight_group_equal", REJECT,
)
LABEL_COLUMNS = ("trend_label", "trend_class", "电导率变化趋势", "direction_label", "direction_class")
AUDIT_COLUMNS = (
    "conductivity_a_S_cm-1", "conductivity_b_S_cm-1", "conductivity_qualifier_a",
    "conductivity_qualifier_b", "conductivity_source_a", "conductivity_source_b",
    "conductivity_parse_status_a", "conductivity_parse_status_b", "conductivity_unit_a",
    "conductivity_unit_b", "conductivity_value_text_a", "conductivity_value_text_b",
    "delta_conductivity_S_cm-1", "absolute_change_conductivity_S_cm-1",
    "conductivity_ratio_b_over_a", "conductivity_fold_change", "absolute_change_met",
    "fold_change_met", "change_trigger", "absolute_change_threshold_S_cm-1", "fold_change_threshold",
    "temperature_consistency_status_a", "temperature_consistency_status_b",
)


def pair_table_full(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pair table that keeps every known trace, label and audit column in order."""
    rows = pairs
    low, high = "conductivity_a_S_cm-1", "conductivity_b_S_cm-1"
    if low in rows.columns and high in rows.columns:
        delta = F.col(f"`{high}`").cast("double") - F.col(f"`{low}`").cast("double")
        rows = rows.withColumns(label_columns(delta, threshold))
    if "family" in rows.columns:
        rows = rows.withColumn("family_normalized", tx.normalize_label(F.col("family")))
    rows = group_weight(rows, "group_id", "pair_weight_group_equal")
    featured = pair_features(enrich_pairs(rows, formula_descriptors(pair_formulas(pairs))))
    ordered = [c for c in (*TRACE_COLUMNS, *LABEL_COLUMNS, *AUDIT_COLUMNS) if c in featured.columns]
    return featured.select(*[F.col(f"`{c}`") for c in (*ordered, *MODEL_FEATURES)])


def inference_pairs(df: DataFrame) -> DataFrame:
    """Model columns for (formula_a, formula_b, family) rows, order kept."""
    rows = df.withColumns({
        "formula_a": tx.strip(F.col("formula_a")),
        "formula_b": tx.strip(F.col("formula_b")),
        "family": tx.strip(F.col("family")),
        "family_normalized": tx.normalize_label(F.col("family")),
        "assumed_same_preparation": F.lit(True),
    })
    return pair_features(enrich_pairs(rows, formula_descriptors(pair_formulas(rows))))


def flip_label(label: Column) -> Column:
    return F.when(label == "decrease", "increase").when(label == "increase", "decrease").otherwise(label)


def reverse_expressions(columns: Sequence[str]) -> dict[str, Column]:
    """New value of each column that changes when a pair is read from b to a."""
    swapped = {f"delta_{n}": -F.col(f"delta_{n}") for n in CHANGES}
    for n in ENDPOINTS:
        swapped[f"a_{n}"], swapped[f"b_{n}"] = F.col(f"b_{n}"), F.col(f"a_{n}")
    swapped |= {new: F.col(old) for new, old in zip(VECTORS, reversed(VECTORS))}
    swapped["trend_label"] = flip_label(F.col("trend_label"))
    swapped["trend_class"] = -F.col("trend_class")
    return {c: e for c, e in swapped.items() if c in columns}


def reverse_places(columns: Sequence[str]) -> tuple[list[int], list[float]]:
    """For each model column, the place in ``columns`` that holds its value when a pair is read from b to a, and its sign."""
    place = {name: i for i, name in enumerate(columns)}
    other = {f"{s}_{n}": f"{o}_{n}" for n in ENDPOINTS for s, o in ("ab", "ba")}
    return [place[other.get(c, c)] for c in columns], [-1.0 if c in SIGNED_FEATURES else 1.0 for c in columns]


def reverse_pairs(df: DataFrame) -> DataFrame:
    """The same pairs read from b to a."""
    swapped = reverse_expressions(df.columns)
    # One select, so every expression reads the row as it was.
    return df.select(*[swapped.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def augment(df: DataFrame, weight: str = "pair_weight_group_equal") -> DataFrame:
    """Both reading directions, each at half weight."""
    def tagged(rows: DataFrame, direction: str) -> DataFrame:
        return rows.withColumns({
            "training_weight": F.col(weight) * 0.5, "augmentation_direction": F.lit(direction)
        })

    return tagged(df, "forward").unionByName(tagged(reverse_pairs(df), "reverse"))
