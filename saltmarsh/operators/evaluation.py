"""Regression, ranking and classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import physics as ph
from saltmarsh.operators.ordering import join_groups, largest_group, row_rank, running_sum
from saltmarsh.operators.pairing import LABELS
from saltmarsh.operators.windows import adjacent_agreement
from saltmarsh.session import durable, small_table

# --- regression -----------------------------------------------------------------------


def regression_metrics(df: DataFrame, part: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Count, MAE, RMSE and R2 per group; R2 is null for one row or a flat truth."""
    error = F.col(truth) - F.col(guess)
    usable = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    out = usable.groupBy(*part).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error * error).alias("_mse"),
        F.var_pop(truth).alias("_var"),
        F.avg(F.col(truth) * F.col(truth)).alias("_size"),
    )
    # A deviation within rounding noise of the values' size counts as flat.
    return out.withColumn(
        "r2", F.when((F.col("n") > 1) & (F.col("_var") > 1e-24 * F.col("_size")), 1.0 - F.col("_mse") / F.col("_var"))
    ).drop("_mse", "_var", "_size")


# --- ranking ----------------------------------------------------------------------------


def points(df: DataFrame, part: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Distinct (truth, guess) points per group with their weight.

    Equal points are merged before anything is compared, and written once for
    the steps that read them.
    """
    usable = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    return durable(
        usable.groupBy(*part, F.col(truth).alias("t"), F.col(guess).alias("p")).agg(F.count("*").alias("w"))
    )


def most_values(pts: DataFrame, part: Sequence[str]) -> int:
    """No group has more distinct truths or guesses than points."""
    return largest_group(pts, part)


def average_ranks(
    df: DataFrame, part: Sequence[str], value: str, weight: str, name: str, largest: int | None = None
) -> DataFrame:
    """Distinct values per group with their average rank."""
    counts = df.groupBy(*part, value).agg(F.sum(weight).alias("_n"))
    ranked = running_sum(counts, part, [F.col(value)], F.col("_n"), "_upto", largest)
    return ranked.select(*part, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Pearson correlation of weighted points; null if one side is flat but for rounding noise."""
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov = F.sum(w * x * y) / n - mx * my
    sx, sy = F.sum(w * x * x) / n, F.sum(w * y * y) / n
    vx, vy = sx - mx * mx, sy - my * my
    return F.when((vx > 1e-14 * sx) & (vy > 1e-14 * sy), cov / F.sqrt(vx) / F.sqrt(vy))


def group_corr(pts: DataFrame, part: Sequence[str], x: str, y: str, w: str, name: str) -> DataFrame:
    """Correlation per group of values of any size; null if one side has one value only.

    Values are centered first, so large ones with small differences keep them.
    """
    facts = pts.groupBy(*part).agg(
        *[(F.sum(F.col(w) * F.col(c)) / F.sum(w)).alias(f"_mean_{c}") for c in (x, y)],
        ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("_varies"),
    )
    rows = join_groups(pts, facts, part).withColumns({f"_c_{c}": F.col(c) - F.col(f"_mean_{c}") for c in (x, y)})
    corr = weighted_corr(F.col(f"_c_{x}"), F.col(f"_c_{y}"), F.col(w))
    return rows.groupBy(*part).agg(F.when(F.bool_and("_varies"), corr).alias(name))


def spearman(pts: DataFrame, part: Sequence[str]) -> DataFrame:
    part, largest = list(part), most_values(pts, part)
    ranks_t = average_ranks(pts, part, "t", "w", "rt", largest)
    ranks_p = average_ranks(pts, part, "p", "w", "rp", largest)
    joined = join_groups(join_groups(pts, ranks_t, [*part, "t"]), ranks_p, [*part, "p"])
    return group_corr(joined, part, "rt", "rp", "w", "spearman")


def discordant(pts: DataFrame, part: Sequence[str]) -> DataFrame:
    """Pairs whose truth rises while the guess falls, without forming pairs.

    Guesses get dense ranks.  Two ranks first differ in one bit below a common
    prefix; per (group, bit, prefix) the points are walked in truth order and
    every point with a 0 bit counts the earlier points with a 1 bit.  The cost
    is one running sum over at most n * log2(n) rows.
    """
    part = list(part)
    largest = most_values(pts, part)
    distinct_p = pts.select(*part, "p").distinct()
    ranked = row_rank(distinct_p, part, [F.col("p")], "_rank", largest).withColumn("_rank", F.col("_rank") - 1)
    widths = ranked.groupBy(*part).agg(F.max("_rank").alias("_top"))
    rows = join_groups(join_groups(pts, ranked, [*part, "p"]), widths, part)
    bits = F.when(F.col("_top") > 0, F.floor(F.log2(F.col("_top").cast("double")))).otherwise(0)
    rows = rows.withColumn("_bit", F.explode(F.sequence(F.lit(0).cast("bigint"), bits.cast("bigint"))))
    rows = rows.withColumns({
        "_one": F.expr("shiftright(_rank, CAST(_bit AS INT)) & 1L") * F.col("w"),
        "_prefix": F.expr("shiftright(_rank, CAST(_bit AS INT) + 1)"),
    })
    cells = rows.groupBy(*part, "_bit", "_prefix", "t").agg(
        F.sum("_one").alias("ones"), F.sum(F.col("w") - F.col("_one")).alias("zeros")
    )
    walked = running_sum(cells, [*part, "_bit", "_prefix"], [F.col("t")], F.col("ones"), "_upto", largest)
    before = F.col("_upto") - F.col("ones")
    return walked.groupBy(*part).agg(F.sum(before * F.col("zeros")).alias("inverted"))


def _pairs_within(n: Column) -> Column:
    return n * (n - 1) / 2


def inversions(df: DataFrame, part: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Comparable, inverted and tied pairs per group, with the inversion rate."""
    return inversions_of(points(df, part, truth, guess), part)


def inversions_of(pts: DataFrame, part: Sequence[str]) -> DataFrame:
    part = list(part)
    totals = pts.groupBy(*part).agg(
        F.sum("w").alias("n"), F.sum(_pairs_within(F.col("w"))).alias("_same_both")
    )

    def same(column: str, name: str) -> DataFrame:
        counts = pts.groupBy(*part, column).agg(F.sum("w").alias("_c"))
        return counts.groupBy(*part).agg(F.sum(_pairs_within(F.col("_c"))).alias(name))

    joined = totals
    for facts in (same("t", "_same_t"), same("p", "_same_p"), discordant(pts, part)):
        joined = join_groups(joined, facts, part)
    all_pairs = _pairs_within(F.col("n"))
    comparable = all_pairs - F.col("_same_t")
    tied = F.col("_same_p") - F.col("_same_both")
    concordant = comparable - F.col("inverted") - tied
    norm = F.sqrt(comparable.cast("double") * (all_pairs - F.col("_same_p")).cast("double"))
    return joined.select(
        *part, "n",
        comparable.cast("bigint").alias("comparable_pairs"),
        F.col("inverted").cast("bigint").alias("inverted_pairs"),
        tied.cast("bigint").alias("tied_pairs"),
        ph.safe_ratio(F.col("inverted"), comparable).alias("inversion_rate"),
        F.when(norm > 0, (concordant - F.col("inverted")) / norm).alias("kendall"),
    )


def external_eval(df: DataFrame, part: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Full evaluation per group; groups without a reference are ``not_available``."""
    part = list(part)
    totals = df.groupBy(*part).agg(F.count("*").alias("rows_total"))
    regression = regression_metrics(df, part, truth, guess).withColumnRenamed("n", "rows_evaluated")
    pts = points(df, part, truth, guess)
    ranks = spearman(pts, part)
    pairs = inversions_of(pts, part).drop("n")
    out = totals
    for facts in (regression, ranks, pairs):
        out = join_groups(out, facts, part, "left")
    evaluated = F.coalesce("rows_evaluated", F.lit(0).cast("bigint"))
    return out.withColumn("rows_evaluated", evaluated).withColumn(
        "status", F.when(evaluated > 0, "ok").otherwise("not_available")
    )


def adjacent_accuracy(df: DataFrame, part: Sequence[str], order: Sequence[Column], truth: str, guess: str) -> DataFrame:
    """Neighbouring-trend accuracy over all series."""
    series = adjacent_agreement(df, part, order, truth, guess)
    return series.agg(
        F.sum("comparable").alias("comparable"), F.sum("correct").alias("correct")
    ).withColumns({
        "mismatches": F.col("comparable") - F.col("correct"),
        "accuracy": ph.safe_ratio(F.col("correct"), F.col("comparable")),
        "status": F.when(F.col("comparable") > 0, "ok").otherwise("not_available"),
    })


def series_summary(df: DataFrame, part: Sequence[str], order: Sequence[Column], truth: str, guess: str) -> DataFrame:
    """Per series: size, correlations, inversion rate, neighbouring mismatches."""
    part = list(part)
    pts = points(df, part, truth, guess)
    pearson = group_corr(pts, part, "t", "p", "w", "pearson")
    pairs = inversions_of(pts, part).select(*part, "n", "inversion_rate")
    adjacent = adjacent_agreement(df, part, order, truth, guess).select(
        *part, (F.col("comparable") - F.col("correct")).alias("adjacent_mismatch"),
        F.col("comparable").alias("adjacent_comparable"),
    )
    out = pairs
    for facts in (pearson, spearman(pts, part), adjacent):
        out = join_groups(out, facts, part, "left")
    return out


# --- classification ---------------------------------------------------------------------


def class_sums(
    df: DataFrame, part: Sequence[str], truth: str, guess: str, weight: Column, *more: Column
) -> DataFrame:
    """One row per group with the sums all class metrics derive from, and ``more`` aggregates."""
    sums = []
    for i, label in enumerate(LABELS):
        is_true, is_guess = F.col(truth) == label, F.col(guess) == label
        sums += [
            F.sum(F.when(is_true & is_guess, weight).otherwise(0)).alias(f"tp_{i}"),
            F.sum(F.when(is_true, weight).otherwise(0)).alias(f"true_{i}"),
            F.sum(F.when(is_guess, weight).otherwise(0)).alias(f"pred_{i}"),
        ]
    return df.groupBy(*part).agg(F.sum(weight).alias("total"), *sums, *more)


def _zero_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _class_metric(i: int) -> tuple[Column, Column, Column]:
    tp, support, guessed = F.col(f"tp_{i}"), F.col(f"true_{i}"), F.col(f"pred_{i}")
    return _zero_ratio(tp, guessed), _zero_ratio(tp, support), _zero_ratio(2 * tp, support + guessed)


def macro_f1() -> Column:
    """Mean F1 over all labels, from ``class_sums`` columns."""
    return reduce(lambda a, b: a + b, [_class_metric(i)[2] for i in range(len(LABELS))]) / len(LABELS)


def accuracy() -> Column:
    hits = reduce(lambda a, b: a + b, [F.col(f"tp_{i}") for i in range(len(LABELS))])
    return _zero_ratio(hits, F.col("total"))


def balanced_accuracy() -> Column:
    """Mean recall over the classes that occur in the truth."""
    recalls = [F.when(F.col(f"true_{i}") > 0, F.col(f"tp_{i}") / F.col(f"true_{i}")) for i in range(len(LABELS))]
    present = reduce(lambda a, b: a + b, [F.when(F.col(f"true_{i}") > 0, 1).otherwise(0) for i in range(len(LABELS))])
    total = reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(0.0)) for r in recalls])
    return F.when(present > 0, total / present)


def aggregate_metrics(df: DataFrame, part: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Rows, accuracy, macro-F1, balanced accuracy and reversal shares per group."""
    severe = ((F.col(truth) == "decrease") & (F.col(guess) == "increase")) | (
        (F.col(truth) == "increase") & (F.col(guess) == "decrease")
    )
    changed = F.col(truth) != "unchanged"
    part = list(part)
    sums = class_sums(
        df, part, truth, guess, F.lit(1).cast("bigint"),
        F.count_if(severe).alias("severe_reversal_count"),
        F.count_if(changed).alias("changed_pairs"),
        F.count_if(changed & (F.col(truth) == F.col(guess))).alias("_changed_hits"),
    )
    return sums.select(
        *part,
        F.col("total").alias("pairs"),
        accuracy().alias("accuracy"),
        macro_f1().alias("macro_f1"),
        balanced_accuracy().alias("balanced_accuracy"),
        ph.safe_ratio(F.col("_changed_hits"), F.col("changed_pairs")).alias("changed_pair_accuracy"),
        "severe_reversal_count",
        (F.col("severe_reversal_count") / F.col("total")).alias("severe_reversal_rate"),
        ph.safe_ratio(F.col("severe_reversal_count"), F.col("changed_pairs")).alias("severe_reversal_rate_among_changed"),
    )


def class_metrics(df: DataFrame, part: Sequence[str], truth: str, guess: str, weight: Column) -> DataFrame:
    """Precision, recall, F1 and support per group and label."""
    sums = class_sums(df, part, truth, guess, weight)
    packed = F.array(*[
        F.struct(
            F.lit(label).alias("label"),
            *[m.alias(n) for m, n in zip(_class_metric(i), ("precision", "recall", "f1"))],
            F.col(f"true_{i}").cast("double").alias("support"),
            F.col(f"pred_{i}").cast("double").alias("predicted"),
        )
        for i, label in enumerate(LABELS)
    ])
    return sums.select(*part, F.explode(packed).alias("_m")).select(*part, "_m.*")


def confusion(df: DataFrame, part: Sequence[str], truth: str, guess: str, weight: Column) -> DataFrame:
    """Dense label-by-label counts and weights in long form."""
    cells, packed = [], []
    for t in LABELS:
        for g in LABELS:
            hit = (F.col(truth) == t) & (F.col(guess) == g)
            cells += [
                F.count_if(hit).alias(f"n_{t}_{g}"),
                F.sum(F.when(hit, weight).otherwise(0.0)).alias(f"w_{t}_{g}"),
            ]
            packed.append(F.struct(
                F.lit(t).alias("true_label"), F.lit(g).alias("predicted_label"),
                F.col(f"n_{t}_{g}").alias("row_count"), F.col(f"w_{t}_{g}").alias("weight"),
            ))
    wide = df.groupBy(*part).agg(*cells)
    return wide.select(*part, F.explode(F.array(*packed)).alias("_c")).select(*part, "_c.*")


def group_macro_f1(df: DataFrame, group: str, truth: str, guess: str, weight: Column) -> DataFrame:
    """Macro-F1 inside each group, averaged over groups."""
    sums = class_sums(df, [group], truth, guess, weight)
    return sums.agg(F.count("*").alias("groups"), F.avg(macro_f1()).alias("group_macro_f1"))


def probability_of(truth: str, prefix: str = "probability_") -> Column:
    choice = None
    for label in LABELS:
        hit, p = F.col(truth) == label, F.col(f"{prefix}{label}")
        choice = F.when(hit, p) if choice is None else choice.when(hit, p)
    return choice


def log_loss(df: DataFrame, part: Sequence[str], truth: str, weight: Column, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Weighted mean of -ln(probability of the true class)."""
    p = F.least(F.greatest(probability_of(truth), F.lit(eps)), F.lit(1.0 - eps))
    return df.groupBy(*part).agg((-F.sum(weight * F.ln(p)) / F.sum(weight)).alias("log_loss"))


def label_position(label: str) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in LABELS]), F.col(label))


def ordinal_metrics(df: DataFrame, part: Sequence[str], truth: str, guess: str, weight: Column) -> DataFrame:
    """Weighted mean label distance and reversal shares."""
    gap = F.abs(label_position(truth) - label_position(guess))
    severe = gap == 2
    changed = F.col(truth) != "unchanged"
    return df.groupBy(*part).agg(
        (F.sum(weight * gap) / F.sum(weight)).alias("ordinal_mae"),
        (F.sum(F.when(severe, weight).otherwise(0.0)) / F.sum(weight)).alias("severe_reversal_rate"),
        F.count_if(severe).alias("severe_reversal_count"),
        ph.safe_ratio(F.count_if(severe), F.count_if(changed)).alias("severe_share_of_changed"),
    )


def with_scopes(df: DataFrame, scopes: Mapping[str, Column], *labels: Column) -> DataFrame:
    """Repeat each row once per scope it belongs to (a fixed, short list)."""
    named = [F.when(c, F.lit(n)) for n, c in scopes.items()]
    return df.withColumn("scope", F.explode(F.array_compact(F.array(*named, *labels))))


def scoped_metrics(df: DataFrame, scopes: Mapping[str, Column], truth: str, guess: str, *labels: Column) -> DataFrame:
    return aggregate_metrics(with_scopes(df, scopes, *labels), ["scope"], truth, guess)


def wide_predictions(frames: Mapping[str, DataFrame], key: str, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Outputs of several models side by side on the same key."""
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [f.select(key, *keep, *columns, F.lit(name).alias("model")) for name, f in frames.items()],
    )
    return stacked.groupBy(key, *keep).pivot("model", list(frames)).agg(
        *[F.first(c).alias(c) for c in columns]
    )


def overlap_audit(pairs: DataFrame, train: DataFrame, a: str, b: str) -> DataFrame:
    """Was each endpoint, or the unordered pair, seen in training?"""
    formulas = train.select(F.col(a).alias("_f")).union(train.select(F.col(b))).distinct()
    seen = formulas.withColumn("_seen", F.lit(True))
    known_pairs = train.select(F.least(a, b).alias("_p1"), F.greatest(a, b).alias("_p2")).distinct().withColumn(
        "_pair_seen", F.lit(True)
    )
    no = F.lit(False)
    rows = pairs.join(seen.select(F.col("_f").alias(a), F.col("_seen").alias("_sa")), a, "left")
    rows = rows.join(seen.select(F.col("_f").alias(b), F.col("_seen").alias("_sb")), b, "left")
    rows = rows.withColumns({"_p1": F.least(a, b), "_p2": F.greatest(a, b)}).join(
        known_pairs, ["_p1", "_p2"], "left"
    )
    return rows.withColumns({
        "a_seen": F.coalesce("_sa", no), "b_seen": F.coalesce("_sb", no),
        "either_seen": F.coalesce("_sa", no) | F.coalesce("_sb", no),
        "pair_seen": F.coalesce("_pair_seen", no),
    }).drop("_sa", "_sb", "_p1", "_p2", "_pair_seen")


def compare_models(metrics: DataFrame, ordered: Sequence[str], comparison: str) -> DataFrame:
    """Metric rows of the named models, numbered in the given order."""
    spark = metrics.sparkSession
    order = small_table(spark, [(m, i) for i, m in enumerate(ordered)], "model string, model_order bigint")
    chosen = metrics.join(F.broadcast(order), "model")
    return chosen.withColumn("comparison_set", F.lit(comparison))


def cv_summary(folds: DataFrame, part: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of fold metrics."""
    return folds.groupBy(*part).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics]
    )


def combined_eval(frames: Mapping[str, DataFrame], part: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Metrics over several tagged datasets together."""
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [f.withColumn("dataset", F.lit(name)) for name, f in frames.items()],
    )
    return aggregate_metrics(tagged, part, truth, guess)
