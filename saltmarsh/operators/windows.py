"""Ordered rows, sorting, top-n and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as tx
from saltmarsh.operators.ordering import (
    attach_row, keep_first, largest_group, last_known, next_row, row_rank, running_extreme,
    running_extremes, running_sum,
)

__all__ = ["keep_first"]


def pairs_adjacent(df: DataFrame, part: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Each row with its successor in the group as ``<col>_a`` / ``<col>_b``."""
    rows = next_row(df, part, order, cols, "_b").filter(F.col("_b").isNotNull())
    rest = [c for c in df.columns if c not in cols]
    return rows.select(
        *rest,
        *[F.col(c).alias(f"{c}_a") for c in cols],
        *[F.col(f"_b.{c}").alias(f"{c}_b") for c in cols],
    )


def adjacent_agreement(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], truth: str, guess: str
) -> DataFrame:
    """Per series: neighbouring changes that can be compared, and that agree."""
    usable = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    pairs = pairs_adjacent(usable, part, order, [truth, guess])
    change_t = F.col(f"{truth}_b") - F.col(f"{truth}_a")
    change_g = F.col(f"{guess}_b") - F.col(f"{guess}_a")
    comparable = (change_t != 0) & (change_g != 0)
    agree = comparable & (F.signum(change_t) == F.signum(change_g))
    return pairs.groupBy(*part).agg(
        F.count_if(comparable).alias("comparable"), F.count_if(agree).alias("correct")
    )


def segment(df: DataFrame, part: Sequence[str], order: Sequence[Column], is_header: Column, label: Column) -> DataFrame:
    """Number the segments opened by header rows and carry the label forward."""
    flagged = df.withColumn("_header", F.when(is_header, 1).otherwise(0)).withColumn(
        "_label", F.when(is_header, label)
    )
    largest = largest_group(df, part)
    numbered = running_sum(flagged, part, order, F.col("_header"), "segment_no", largest)
    carried = last_known(numbered, part, order, F.col("_label"), "segment_label", largest)
    return carried.withColumn("is_header_row", F.col("_header") == 1).drop("_header", "_label")


def occurrence(df: DataFrame, part: Sequence[str], label: str, order: Sequence[Column], name: str = "occurrence") -> DataFrame:
    """How many times a label has appeared so far."""
    return row_rank(df, [*part, label], order, name)


def group_weight(df: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """1 / rows of the group on every row: combine, then join back. Null is a group."""
    counts = df.groupBy(F.col(group).alias("_group")).agg((F.lit(1.0) / F.count("*")).alias(name))
    return df.join(counts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def running_best(df: DataFrame, part: Sequence[str], order: Sequence[Column], value: str, best: str) -> DataFrame:
    return running_extreme(df, part, order, F.col(value), "best_value", best=best)


def running_bests(df: DataFrame, part: Sequence[str], order: Sequence[Column], value: str, names: Mapping[str, str]) -> DataFrame:
    """As ``running_best`` for several results, each named with ``min`` or ``max``."""
    return running_extremes(df, part, order, {name: (F.col(value), best) for name, best in names.items()})


def surrogate(df: DataFrame, order: Sequence[Column], fmt: str, name: str, part: Sequence[str] = ()) -> DataFrame:
    """Formatted running numbers in a total order."""
    ranked = row_rank(df, list(part), order, "_number")
    return ranked.withColumn(name, F.format_string(fmt, F.col("_number"))).drop("_number")


def order_by(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order)


def topn_share(df: DataFrame, value: str, n: int, *tie: Column) -> DataFrame:
    """The ``n`` largest rows with their share of the total over all rows."""
    total = df.agg(F.sum(value).alias("_total"))
    top = df.orderBy(F.desc(value), *tie).limit(n)
    return attach_row(top, total).withColumn(
        "share", F.coalesce(F.col(value) / F.nullif(F.col("_total"), F.lit(0.0)), F.lit(0.0))
    ).drop("_total")


def best_by(df: DataFrame, part: Sequence[str], pick: str, score: Column, tie: Column, *, smallest: bool) -> DataFrame:
    """Name of the best candidate per group."""
    order = F.struct(score if smallest else -score, tie)
    return df.groupBy(*part).agg(F.min_by(pick, order).alias(f"best_{pick}"))


def union_aligned(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Union by name, then exactly ``columns`` in that order."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    missing = [F.lit(None).cast("string").alias(c) for c in columns if c not in merged.columns]
    return merged.select("*", *missing).select(*columns)


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    only_a = left.join(right, key, "left_anti").withColumn("side", F.lit("missing"))
    only_b = right.join(left, key, "left_anti").withColumn("side", F.lit("extra"))
    return only_a.unionByName(only_b)


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; empty for a clean split."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def require_no_leakage(a: DataFrame, b: DataFrame, key: str) -> None:
    shared = leakage(a, b, key).limit(10).collect()
    if shared:
        raise ValueError(f"{key} on both sides: {[r[0] for r in shared]}")


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).distinct()


def unseen_values(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Values without a known level, and how many rows carry each."""
    return (
        df.groupBy(column).agg(F.count("*").alias("row_count"))
        .join(levels.select(column).distinct(), column, "left_anti")
    )


def require_known(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    found = unseen_values(df, column, levels).limit(10).collect()
    if found:
        raise ValueError(f"unsupported {column}: {sorted(r[0] for r in found)}")
    return df


def read_segments(lines: DataFrame, part: Sequence[str], order: Sequence[Column], text: str = "text") -> DataFrame:
    """Rows of a segmented text: a lone cell opens a segment, rows inherit it.

    Rows are ``formula TAB measure`` or ``id TAB formula TAB measure``; rows
    before the first header and rows without a number are left out.
    """
    cells = F.split(F.col(text), "\t")
    header = (F.size(cells) == 1) & (tx.strip(F.get(cells, 0)) != "")
    numbered = segment(lines, part, order, header, tx.strip(F.get(cells, 0)))
    three = F.size(cells) >= 3
    rows = numbered.filter(~F.col("is_header_row") & (F.col("segment_no") > 0)).select(
        *lines.columns,
        "segment_no",
        "segment_label",
        F.when(three, tx.strip(F.get(cells, 0))).otherwise("").alias("row_id"),
        tx.strip(F.when(three, F.get(cells, 1)).otherwise(F.get(cells, 0))).alias("row_formula"),
        tx.strip(F.when(three, F.get(cells, 2)).otherwise(F.get(cells, 1))).alias("row_measure"),
    )
    rows = rows.withColumn("row_value", tx.parse_scientific(F.col("row_measure")))
    return rows.filter((F.col("row_formula") != "") & F.col("row_value").isNotNull())
