"""Repeatable splits driven by stable hashes instead of row positions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions import physics as ph
from saltmarsh.functions import text as tx
from saltmarsh.operators.ordering import attach_row, hash_rank, join_groups, row_rank
from saltmarsh.operators.windows import leakage
from saltmarsh.session import durable

TRAIN, TEST = "train", "test"


def _side(is_test: Column, test: str = TEST) -> Column:
    return F.when(is_test, test).otherwise(TRAIN)


def split_random(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose id hash falls below ``fraction`` form the test side."""
    return df.withColumn("split", _side(tx.hash_fraction(F.col(id_col), f"random{seed}") < fraction))


def split_by_id(df: DataFrame, id_col: str, train_ids: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Listed rows only, each on its listed side."""
    train = df.join(train_ids.select(id_col).distinct(), id_col, "left_semi")
    test = df.join(test_ids.select(id_col).distinct(), id_col, "left_semi")
    return train.withColumn("split", F.lit(TRAIN)).unionByName(test.withColumn("split", F.lit(TEST)))


def split_stratified(df: DataFrame, id_col: str, label: str, fraction: float, seed: int = 42) -> DataFrame:
    """The same share of every label goes to the test side; rows without a label are a stratum too.

    Rows without an id have one key and come first in their stratum's order.
    """
    keyed = df.withColumn("_key", F.coalesce(tx.stable_key(F.col(id_col), f"stratified{seed}"), F.lit("000")))
    quota = df.groupBy(label).agg(F.round(F.count("*") * fraction).cast("bigint").alias("_quota"))
    ranked = hash_rank(keyed, [label], "_key", "_rank", tie=id_col)
    return join_groups(ranked, quota, [label]).withColumn(
        "split", _side(F.col("_rank") <= F.col("_quota"))
    ).drop("_key", "_rank", "_quota")


def split_group(df: DataFrame, group: str, fraction: float, seed: int = 42) -> DataFrame:
    """A group is never divided: its hash places all its rows."""
    return df.withColumn("split", _side(tx.hash_fraction(F.col(group), f"group{seed}") < fraction))


def split_subset(df: DataFrame, label: str, contains: str, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """Keep rows whose label contains a text, then split at random."""
    subset = df.filter(F.lower(F.col(label)).contains(contains.lower()))
    return split_random(subset, id_col, fraction, seed)


def label_quota(counts: DataFrame, label: str, count: str, target_rows: Column) -> DataFrame:
    """Whole-number targets per label by largest remainder, ties by label.

    ``counts`` has one row per label, so its windows are as small as the
    vocabulary.
    """
    total = counts.agg(F.sum(count).alias("_total"))
    rows = attach_row(counts, total)
    exact = F.col(count) * target_rows / F.col("_total")
    rows = rows.withColumns({"_floor": F.floor(exact), "_rest": exact - F.floor(exact)})
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.desc("_rest"), F.col(label))
    remaining = target_rows - F.sum("_floor").over(every)
    return rows.withColumn("_rank", F.row_number().over(order)).withColumn(
        "target", (F.col("_floor") + F.when(F.col("_rank") <= remaining, 1).otherwise(0)).cast("bigint")
    ).select(label, count, "target")


def group_label_counts(df: DataFrame, group: str, label: str, levels: Sequence[str]) -> DataFrame:
    """Rows per group, in total and per label."""
    return df.groupBy(group).agg(
        F.count("*").alias("pair_rows"),
        *[F.count_if(F.col(label) == level).alias(f"{level}_rows") for level in levels],
    )


def _running_by_hash(groups: DataFrame, key: str, columns: Sequence[str], prefix: int = 3) -> DataFrame:
    """Running sums of several columns in the order of a hex key.

    The leading characters of the key cut the groups into equal buckets: bucket
    totals give the offsets and each bucket is accumulated alone.
    """
    rows = groups.withColumn("_bucket", F.substring(key, 1, prefix))
    totals = rows.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns]
    )
    local = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, "_bucket")
    return joined.withColumns(
        {f"cum_{c}": F.sum(c).over(local) + F.col(f"_o_{c}") for c in columns}
    ).drop("_bucket", *[f"_o_{c}" for c in columns])


def split_groups_to_target(
    df: DataFrame, group: str, label: str, levels: Sequence[str], fraction: float, salt: str = "groups"
) -> DataFrame:
    """Whole groups to the validation side, close to a row target.

    Groups are walked in hash order.  Of all cuts that leave a group and every
    label on both sides, the one nearest to the target row count is taken, then
    the one nearest to the label targets.
    """
    columns = ["pair_rows", *[f"{level}_rows" for level in levels]]
    groups = group_label_counts(df, group, label, levels).withColumn(
        "selection_key", F.coalesce(tx.stable_key(F.col(group), salt), F.lit("000"))
    )
    totals = groups.agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    rows = attach_row(_running_by_hash(groups, "selection_key", columns), totals)
    target = F.bround(F.col("all_pair_rows") * fraction)
    # A label that never occurs cannot be on both sides.
    valid = reduce(lambda a, b: a & b, [
        (F.col(f"all_{c}") == 0) | ((F.col(f"cum_{c}") > 0) & (F.col(f"cum_{c}") < F.col(f"all_{c}")))
        for c in columns
    ])
    label_gap = reduce(lambda a, b: a + b, [
        F.abs(F.col(f"cum_{c}") - F.col(f"all_{c}") * fraction) for c in columns[1:]
    ])
    best = rows.filter(valid).agg(
        F.min_by("selection_key", F.struct(
            F.abs(F.col("cum_pair_rows") - target), F.round(label_gap, 6), F.col("selection_key")
        )).alias("_cut")
    )
    side = F.when(F.col("selection_key") <= F.col("_cut"), "validation").otherwise(TRAIN)
    return attach_row(groups, best).withColumn("split", side).drop("_cut").select(
        group, "split", *columns, "selection_key"
    )


def kfold(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """Fold number from the id hash."""
    return df.withColumn("fold", F.floor(tx.hash_fraction(F.col(id_col), f"fold{seed}") * k).cast("bigint"))


def group_kfold(df: DataFrame, group: str, k: int, salt: str = "kfold") -> DataFrame:
    """Group -> fold: groups by size are dealt back and forth over the folds."""
    sizes = df.groupBy(group).agg(F.count("*").alias("group_rows")).withColumn(
        "_key", F.coalesce(tx.stable_key(F.col(group), salt), F.lit(""))
    )
    ranked = row_rank(sizes, [], [F.desc("group_rows"), F.col("_key"), F.col(group)], "_rank")
    place = F.pmod(F.col("_rank") - 1, F.lit(2 * k))
    fold = F.when(place < k, place).otherwise(2 * k - 1 - place)
    return ranked.select(group, "group_rows", fold.cast("bigint").alias("fold"))


def size_class(count: Column) -> Column:
    """Small counts as they are, larger ones by their number of binary digits: some 60 classes for any count."""
    return F.when(count < 16, count).otherwise(11 + F.length(F.bin(count)))


def _deal_rest(rest: pd.DataFrame, base: pd.DataFrame, columns: Sequence[str], levels: Sequence[str], k: int, check: bool) -> pd.DataFrame:
    """Folds of the groups in ``rest``, largest first, each to the fold that then deviates least."""
    held = [[0.0] * len(columns) for _ in range(k)]
    for row in base.itertuples(index=False):
        held[int(row.fold)] = [float(getattr(row, c)) for c in columns]
    rest = rest.sort_values(["group_rows", "_key"], ascending=[False, True])
    counts = rest[list(columns)].to_numpy(dtype=float)
    totals = [sum(h[i] for h in held) + counts[:, i].sum() for i in range(len(columns))]
    scale = [t * t for t in totals]
    folds = []
    for own in counts.tolist():
        # Squares of each count's share of its total grow by 2 * held * own / total^2, plus the same for every fold.
        def growth(fold: int) -> float:
            sum_ = 0.0
            for h, n, s in zip(held[fold], own, scale):
                sum_ += h * n / s if s > 0 else 0.0
            return sum_

        fold = min(range(k), key=lambda f: (growth(f), f))
        held[fold] = [h + n for h, n in zip(held[fold], own)]
        folds.append(fold)
    if check:
        for fold in range(k):
            for level, n, total in zip(levels, held[fold][1:], totals[1:]):
                if n == 0 or n == total:
                    raise ValueError(f"fold {fold} has {'no' if n == 0 else 'every'} row of class {level}")
    return pd.DataFrame({"_key": rest["_key"].to_numpy(), "_fold": folds})


def stratified_group_kfold(
    df: DataFrame, group: str, label: str, levels: Sequence[str], k: int, salt: str = "strata", check: bool = True
) -> DataFrame:
    """Group -> fold with even row and label counts; a group is never divided.

    Groups with like counts of every label (``size_class``) are a bucket. Of a bucket, a
    multiple of ``k`` groups is dealt back and forth over the folds in order of size; the
    first ones, fewer than ``k``, are left and go largest first, each to the fold whose
    shares of rows and labels it disturbs least. So one task sees fewer than ``k`` groups
    for each of a bounded number of buckets, however many groups there are. After that no
    fold's count of a label differs from its fair part by more than the label's largest
    groups put in last, and by what groups of one bucket differ.

    With ``check``, a fold that holds none or all rows of a class fails the job. Each group
    has one row here, so no group can be on both sides. Null is a group.
    """
    names = [f"n_{level}" for level in levels]
    columns = ["group_rows", *names]
    groups = durable(df.groupBy(group).agg(
        F.count("*").alias("group_rows"), *[F.count_if(F.col(label) == v).alias(n) for v, n in zip(levels, names)]
    ).withColumns({
        "_key": F.coalesce(tx.stable_key(F.col(group).cast("string"), salt), F.lit("")),
        "_bucket": F.concat_ws(",", *[size_class(F.col(n)) for n in columns]),
    }))
    sizes = groups.groupBy("_bucket").agg((F.count("*") % k).alias("_rest"))
    placed = row_rank(groups, ["_bucket"], [F.desc("group_rows"), F.col("_key")], "_place").join(sizes, "_bucket")
    turn = F.pmod(F.col("_place") - F.col("_rest") - 1, F.lit(2 * k))
    dealt = durable(placed.withColumn("fold", F.when(
        F.col("_place") > F.col("_rest"), F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    ).cast("bigint")).drop("_place", "_rest", "_bucket"))
    base = dealt.filter("fold IS NOT NULL").groupBy("fold").agg(*[F.sum(c).alias(c) for c in columns])
    rest = dealt.filter("fold IS NULL").select("_key", *columns)
    one = F.lit(0).alias("_all")
    found = rest.groupBy(one).cogroup(base.groupBy(one)).applyInPandas(
        lambda a, b: _deal_rest(a, b, columns, list(levels), k, check), "_key string, _fold bigint"
    )
    return dealt.join(found, "_key", "left").select(group, *columns, F.coalesce("fold", "_fold").alias("fold"))


def with_folds(df: DataFrame, folds: DataFrame, group: str, name: str = "fold") -> DataFrame:
    """Rows with the fold of their group."""
    return join_groups(df, folds.select(group, F.col("fold").cast("int").alias(name)), [group])


def fold_shares(folds: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Per fold: groups, rows, and its share of the rows of each label."""
    names = ["group_rows", *[f"n_{v}" for v in levels]]
    sums = folds.groupBy("fold").agg(F.count("*").alias("groups"), *[F.sum(n).alias(n) for n in names])
    totals = folds.agg(*[F.sum(n).alias(f"_all_{n}") for n in names])
    return attach_row(sums, totals).select(
        "fold", "groups", "group_rows",
        *[ph.safe_ratio(F.col(n), F.col(f"_all_{n}")).alias(f"share_{n.removeprefix('n_')}") for n in names],
    )


def fold_checks(df: DataFrame, fold: str, label: str, levels: Sequence[str]) -> DataFrame:
    """Per fold: rows and missing classes on the held-out and on the fit side."""
    counts = df.groupBy(fold).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(label) == v).alias(f"n_{v}") for v in levels]
    )
    totals = df.agg(*[F.count_if(F.col(label) == v).alias(f"t_{v}") for v in levels])
    rows = attach_row(counts, totals)
    missing_valid = reduce(lambda a, b: a + b, [F.when(F.col(f"n_{v}") == 0, 1).otherwise(0) for v in levels])
    missing_fit = reduce(lambda a, b: a + b, [
        F.when(F.col(f"t_{v}") == F.col(f"n_{v}"), 1).otherwise(0) for v in levels
    ])
    return rows.select(
        fold, "rows", missing_valid.cast("bigint").alias("missing_valid_classes"),
        missing_fit.cast("bigint").alias("missing_fit_classes"),
    )


def side_leakage(df: DataFrame, split: str, key: str, left: str = TRAIN, right: str = TEST) -> DataFrame:
    return leakage(df.filter(F.col(split) == left), df.filter(F.col(split) == right), key)


def assignments(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Rows with the split of their group; rows without a group are one group."""
    return join_groups(df, groups.select(group, "split"), [group])


def split_manifest(df: DataFrame, group: str, label: str, levels: Sequence[str]) -> DataFrame:
    """Rows, groups and label counts per side, with fractions."""
    stats = df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_distinct(group).alias("groups"),
        *[F.count_if(F.col(label) == v).alias(f"{v}_rows") for v in levels],
    )
    total = stats.agg(F.sum("rows").alias("_total"))
    return attach_row(stats, total).withColumn("row_fraction", F.col("rows") / F.col("_total")).drop("_total")
