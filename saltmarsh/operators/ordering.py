"""Ordered computation inside groups, safe for groups of any size.

A plain window puts a whole group into one task.  An order over the whole table
never does: its rows are range-partitioned into slices, each slice is windowed on
its own, and one row per slice carries the running state across slices.  For
groups the largest one is measured first; groups that fit use the plain window,
larger ones are sliced by (group, order).  All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.session import durable

MAX_GROUP_CONF = "spark.saltmarsh.window.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 1_000_000
_SLICE = "_slice"


def group_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_GROUP_CONF, str(DEFAULT_MAX_GROUP_ROWS)))


def largest_group(df: DataFrame, part: Sequence[str]) -> int:
    """Row count of the largest group: one map-side combined aggregate."""
    row = df.groupBy(*part).count().agg(F.max("count")).first()
    return row[0] or 0


def groups_fit(df: DataFrame, part: Sequence[str], largest: int | None) -> bool:
    """Does every group fit one task?  ``largest`` is a proven bound when the
    caller has one; else the groups are counted.  A whole table never counts as fitting."""
    if not part:
        return False
    size = largest_group(df, part) if largest is None else largest
    return size <= group_row_limit(df)


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(name) for name in names]


def _window(part: Sequence[str], order: Sequence[Column]):
    if part:
        return Window.partitionBy(*part).orderBy(*order)
    # Reached only for the one row that each slice has.
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def _slices(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(part), *order]
    return durable(
        df.repartitionByRange(max(count, 2), *keys).withColumn(_SLICE, F.spark_partition_id())
    )


def _join_slices(rows: DataFrame, slices: DataFrame, part: Sequence[str]) -> DataFrame:
    """Attach per-slice facts; ``slices`` has one row per group and slice."""
    keys = [*part, _SLICE]
    renamed = slices.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[c for c in slices.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    )
    return rows.join(renamed, condition, "left").drop(*[f"_s_{k}" for k in keys])


def running_sum(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], value: Column, name: str,
    largest: int | None = None,
) -> DataFrame:
    """Inclusive running total of ``value`` inside each group."""
    if groups_fit(df, part, largest):
        frame = _window(part, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(frame))
    rows = _slices(df.withColumn("_v", value), part, order)
    totals = rows.groupBy(*part, _SLICE).agg(F.sum("_v").alias("_slice_sum"))
    before = _window(part, [F.col(_SLICE)]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_slice_sum").over(before), F.lit(0)))
    local = _window([*part, _SLICE], order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _join_slices(rows, offsets.drop("_slice_sum"), part)
        .withColumn(name, F.sum("_v").over(local) + F.col("_offset"))
        .drop("_v", "_offset", _SLICE)
    )


def row_rank(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], name: str, largest: int | None = None
) -> DataFrame:
    """Row number inside each group; ``order`` must be a total order."""
    return running_sum(df, part, order, F.lit(1).cast("bigint"), name, largest)


def next_row(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], cols: Sequence[str], name: str,
    largest: int | None = None,
) -> DataFrame:
    """Struct of ``cols`` taken from the following row of the group, or null."""
    payload = F.struct(*cols)
    if groups_fit(df, part, largest):
        return df.withColumn(name, F.lead(payload).over(_window(part, order)))
    rows = _slices(df, part, order)
    local = _window([*part, _SLICE], order)
    rows = rows.withColumn("_local", F.lead(payload).over(local)).withColumn(
        "_rn", F.row_number().over(local)
    )
    firsts = rows.filter("_rn = 1").select(*part, _SLICE, payload.alias("_first"))
    following = firsts.withColumn(
        "_next_first", F.lead("_first").over(_window(part, [F.col(_SLICE)]))
    ).drop("_first")
    return (
        _join_slices(rows, following, part)
        .withColumn(name, F.coalesce("_local", "_next_first"))
        .drop("_local", "_rn", "_next_first", _SLICE)
    )


def last_known(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], value: Column, name: str,
    largest: int | None = None,
) -> DataFrame:
    """Carry the latest non-null ``value`` forward inside each group."""
    if groups_fit(df, part, largest):
        frame = _window(part, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
    rows = _slices(df.withColumn("_v", value), part, order)
    local = _window([*part, _SLICE], order)
    frame = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_carried", F.last("_v", ignorenulls=True).over(frame)).withColumn(
        "_rn", F.row_number().over(local)
    )
    ends = rows.groupBy(*part, _SLICE).agg(F.max_by("_carried", "_rn").alias("_end"))
    before = _window(part, [F.col(_SLICE)]).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return (
        _join_slices(rows, carry, part)
        .withColumn(name, F.coalesce("_carried", "_before"))
        .drop("_v", "_carried", "_rn", "_before", _SLICE)
    )


def running_extreme(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], value: Column, name: str, *, best: str,
    largest: int | None = None,
) -> DataFrame:
    """Best value so far (``best`` is ``min`` or ``max``)."""
    return running_extremes(df, part, order, {name: (value, best)}, largest)


def running_extremes(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], wanted: Mapping[str, tuple[Column, str]],
    largest: int | None = None,
) -> DataFrame:
    """Several best values so far, each a column and ``min`` or ``max``, in one pass over the rows."""
    pick, merge = {"min": F.min, "max": F.max}, {"min": F.least, "max": F.greatest}
    if groups_fit(df, part, largest):
        frame = _window(part, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: pick[best](value).over(frame) for n, (value, best) in wanted.items()})
    rows = _slices(df.withColumns({f"_v_{n}": value for n, (value, _) in wanted.items()}), part, order)
    totals = rows.groupBy(*part, _SLICE).agg(*[pick[best](f"_v_{n}").alias(f"_best_{n}") for n, (_, best) in wanted.items()])
    before = _window(part, [F.col(_SLICE)]).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({f"_before_{n}": pick[best](f"_best_{n}").over(before) for n, (_, best) in wanted.items()})
    local = _window([*part, _SLICE], order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_slices(rows, carry.drop(*[f"_best_{n}" for n in wanted]), part)
    return joined.withColumns({
        n: merge[best](pick[best](f"_v_{n}").over(local), F.col(f"_before_{n}")) for n, (_, best) in wanted.items()
    }).drop(_SLICE, *[f"_{kind}_{n}" for n in wanted for kind in ("v", "before")])


def hash_rank(
    df: DataFrame, part: Sequence[str], digest: str, name: str, *, tie: str, prefix: int = 3
) -> DataFrame:
    """Row number inside each group in the order of a hex digest.

    Digests are uniform, so their first ``prefix`` characters cut every group
    into equal buckets and no sampling is needed: counts per bucket give the
    offsets and each bucket is numbered alone.
    """
    rows = df.withColumn("_bucket", F.substring(digest, 1, prefix))
    counts = rows.groupBy(*part, "_bucket").agg(F.count("*").alias("_n"))
    before = _window(part, [F.col("_bucket")]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = _window([*part, "_bucket"], [F.col(digest), F.col(tie)])
    return (
        join_groups(rows, offsets, [*part, "_bucket"])
        .withColumn(name, F.row_number().over(local) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys, in which null equals null; the keys come from ``left``.

    Without keys ``right`` is the one row of an ungrouped aggregate.
    """
    if not keys:
        return attach_row(left, right)
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return left.join(named, reduce(lambda a, b: a & b, same), how).drop(*[f"_r_{c}" for c in keys])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an ungrouped aggregate, which is one row by construction."""
    return df.join(F.broadcast(one_row), F.lit(True))


# A hot key's rows meet its one row of facts in so many places at most.
SALTS = 64


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))


_USED = "bit_or(shiftleft(1L, _salt))"


def _per_salt(facts: DataFrame) -> DataFrame:
    """Each row of facts once for every salt in its ``_used``."""
    return facts.withColumn("_salt", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("_used"), i) == 1
    ))).drop("_used")


def spread_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join with ``facts``, one row for each ``key``, when a key may hold most rows.

    Rows take a salt from all their columns; a fact is repeated for the salts that its
    rows use, so a rare key costs one copy and a hot key is split over many tasks.
    Null keys find nothing.
    """
    salted = _salted(rows)
    used = salted.groupBy(key).agg(F.expr(_USED).alias("_used"))
    return salted.join(_per_salt(facts.join(used, key)), [key, "_salt"]).drop("_salt")


def hand_back(rows: DataFrame, key: str, *facts: Column) -> DataFrame:
    """Rows with aggregates over their ``key`` beside them, split like ``spread_join``."""
    salted = _salted(rows)
    groups = salted.groupBy(key).agg(*facts, F.expr(_USED).alias("_used"))
    return salted.join(_per_salt(groups), [key, "_salt"]).drop("_salt")


def keep_first(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group by ascending ``order``.

    An aggregate with a map-side combine, so a hot group is reduced before the
    shuffle.  Negate a number to order it downwards.
    """
    rest = [c for c in df.columns if c not in part]
    best = df.groupBy(*part).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*part, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def exact_quantiles(
    df: DataFrame, part: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Linear-interpolated exact quantiles per group, without holding a group.

    Equal values are counted first, the counts are accumulated in value order,
    and each wanted rank is read from the interval it falls into.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("_n"))
    # Read three times below, and much smaller than the rows.
    counts = durable(counts)
    ranked = running_sum(counts, part, [F.col(value)], F.col("_n"), "_upto")
    totals = counts.groupBy(*part).agg(F.sum("_n").alias("_total"))
    joined = join_groups(ranked, totals, list(part))
    start = F.col("_upto") - F.col("_n")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < F.col("_upto")), F.col(value)))

    aggregates = []
    for name, q in points.items():
        target = F.lit(float(q)) * (F.col("_total") - 1)
        aggregates += [
            at(F.floor(target)).alias(f"_lo_{name}"),
            at(F.ceil(target)).alias(f"_hi_{name}"),
            F.max(target - F.floor(target)).alias(f"_w_{name}"),
        ]
    picked = joined.groupBy(*part).agg(*aggregates)
    return picked.select(
        *part,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in points
        ],
    )


def member_lists(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], fields: dict[str, Column], rows_per_list: int
) -> DataFrame:
    """Pipe-joined member texts per group, in lists of bounded length.

    A group longer than ``rows_per_list`` continues in list 1, 2, ...; nothing
    is dropped and no row grows with the data.
    """
    named = df.select(*key, *[c.alias(f"_f_{n}") for n, c in fields.items()],
                      *[c.alias(f"_o_{i}") for i, c in enumerate(order)])
    order_cols = [F.col(f"_o_{i}") for i in range(len(order))]
    ranked = row_rank(named, key, order_cols, "_rn").withColumn(
        "list_no", F.floor((F.col("_rn") - 1) / F.lit(rows_per_list)).cast("bigint")
    )
    gathered = ranked.groupBy(*key, "list_no").agg(
        F.array_sort(
            F.collect_list(F.struct("_rn", *[F.col(f"_f_{n}") for n in fields]))
        ).alias("_members")
    )
    return gathered.select(
        *key,
        "list_no",
        *[F.array_join(F.col("_members").getField(f"_f_{n}"), "|").alias(n) for n in fields],
    )
