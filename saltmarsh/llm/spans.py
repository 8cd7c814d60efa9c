"""Places of patterns in whole texts, by column expressions only.

A pattern's matches and the gaps between them are cut from a text in the scan; where a
match stands follows from the running sum of their lengths, one window over the matches
of a text. Texts themselves are never moved. Positions count code points.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.session import durable

#: Code points of the text before and after a match that are kept with it.
REACH = 64


def hits(docs: DataFrame, kinds: Mapping[str, tuple[str, str]], extra: tuple[str, ...] = ()) -> DataFrame:
    """``row_id``, ``doc_id``, ``extra`` columns and ``found``: per kind the matches with the gaps before them.

    ``kinds``: name -> (a cheap pattern without which there is no match, the pattern).
    Written once; a row's number comes from that table.
    """
    text = F.col("text")

    def of(kind: str, likely: str, pattern: str) -> Column:
        gaps = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        # Gaps stand around the matches: one more than there are matches.
        both = F.zip_with(
            F.arrays_zip(values.alias("value"), F.slice(gaps, 2, F.size(gaps)).alias("next")), F.slice(gaps, 1, F.size(gaps) - 1),
            lambda v, gap: F.struct(
                F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), v["value"].alias("value"),
                F.right(gap, F.lit(REACH)).alias("left"), F.left(v["next"], F.lit(REACH)).alias("right"),
            ),
        )
        return F.when(text.rlike(likely), both)

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[
        F.col(c).alias(f"x_{c}") for c in extra
    ])
    columns = [of(k, *p).alias(f"f_{k}") for k, p in kinds.items()]
    return durable(rows.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", *[f"x_{c}" for c in extra], *columns
    ))


def placed(found: DataFrame, kinds: Mapping[str, tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each match: ``row_id``, ``keep`` columns, ``kind``, ``value``, ``left``, ``right``, ``start``, ``end``."""
    rows = None
    for kind in kinds:
        one = found.where(F.size(f"f_{kind}") > 0).select("row_id", *keep, F.posexplode(f"f_{kind}").alias("at", "m"))
        rows = one if rows is None else rows.unionByName(one)
    before = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("row_id", *keep, "at", "m.*").withColumn("length", F.length("value").cast("long"))
    return rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before)).withColumn(
        "start", F.col("end") - F.col("length")
    ).drop("at", "gap", "length")


def listed(only: str | None, order: list[str]) -> Column:
    """Aggregate: ``kind:start:end`` of a text's matches (those flagged ``only``), by start, then kind as listed."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    span = F.struct("start", place.alias("place"), "end", "kind")
    spans = F.array_sort(F.collect_list(F.when(F.col(only), span) if only else span))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mark_overlaps(rows: DataFrame, base: str) -> DataFrame:
    """``rows`` with ``overlaps``: whether a match shares code points with another one that is ``base``."""
    order = Window.partitionBy("row_id").orderBy("start", "end")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    reach = F.max(F.when(F.col(base), F.col("end"))).over(behind)
    next_start = F.min(F.when(F.col(base), F.col("start"))).over(ahead)
    return rows.withColumn("overlaps", (F.coalesce(reach, F.lit(0)) > F.col("start")) | F.coalesce(next_start < F.col("end"), F.lit(False)))


def report(found: DataFrame, rows: DataFrame, kinds: list[str], added: list[str], more: list[Column] = ()) -> DataFrame:
    """A row for each text: ``doc_id``, counts and digest of the base spans, and all spans.

    ``rows``: ``row_id``, ``kind``, ``start``, ``end``, ``base``. ``more``: aliased aggregates.
    """
    base = F.col("base")
    facts = rows.groupBy("row_id").agg(
        *[F.count(F.when(base & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in kinds],
        F.sha2(listed("base", kinds), 256).alias("base_sha256"), listed(None, [*kinds, *added]).alias("spans"), *more,
    ).withColumnRenamed("row_id", "_row")
    none = {c: F.lit(0).cast("long") for c in facts.columns if c not in ("_row", "base_sha256", "spans")}
    none |= {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return found.select("row_id", "doc_id").join(facts, F.col("row_id") == F.col("_row"), "left").select(
        "doc_id", *[F.coalesce(c, none[c]).alias(c) for c in facts.columns if c != "_row"]
    )
