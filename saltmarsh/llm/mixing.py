r"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``most`` times its own
words; what lies above is shared again by weight. The whole part of the target divided by
the source's words is the number of copies that all of its documents get for certain. For
the words that are left, documents have unequal inclusion odds

    p / (1 - p) = c * size ** power * tilt

(``tilt``: a column, 1 unless one is named), with c such that the expected words are those
left. Long documents are taken more often than short ones, so few are needed to fill the
rest. Each document gets the rank

    Q = (U / (1 - U)) / (p / (1 - p))

with U a hash of its id. The documents with the smallest Q are taken, as many as stay
within the source's target, and then the one document that fills best what is still open.
c is the same for a whole source and moves no document within it, so the order needs only
``size ** power * tilt``.

Defined cases: null text has no words; null is a source of its own, ordered last; a
source without words has target 0; documents without words are taken 0 words; documents
of one id share U and are ordered by size; equal rows are interchangeable; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import WORD, running, setup
from saltmarsh.operators.ordering import attach_row, row_rank, running_sum
from saltmarsh.session import durable


@dataclass(frozen=True)
class Settings:
    """``power``: how inclusion odds grow with a document's words. ``slice_rows``: about so
    many documents of a source are ordered in one task."""

    power: float = 0.5
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    most: int = 3
    seed: str = "mix"
    slice_rows: int = 1_000


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def odds(id_col: Column, seed: str) -> Column:
    u = uniform(id_col, seed)
    return u / (1 - u)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and different for null and any text."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def preference(size: Column, tilt: Column, settings: Settings) -> Column:
    """A document's inclusion odds, up to the factor of its source."""
    grown = F.sqrt(size.cast("double")) if settings.power == 0.5 else F.pow(size.cast("double"), F.lit(settings.power))
    return F.when(size > 0, grown * tilt).otherwise(1.0)


def tilted(tilt: str | None) -> Column:
    return F.coalesce(F.col(tilt), F.lit(1)).cast("double") if tilt else F.lit(1.0)


def targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """``sizes`` (one row for each ``source``, with ``source_size``) with the ``target`` of each.

    Sources are numbered, and their caps added up, in slices of a range partitioning: a
    corpus may have a source for each site. All sums are of whole numbers, so they do not
    depend on the slices.
    """
    weights = F.array(*map(F.lit, settings.weights))
    placed = (
        row_rank(sizes, [], [F.col("source").asc_nulls_last()], "place")
        .withColumn("weight", F.element_at(weights, ((F.col("place") - 1) % len(settings.weights) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * settings.most).cast("double"))
        .withColumn("fills", F.col("cap") / F.col("weight"))
    )
    order = [F.col("fills"), F.col("place")]
    both = running_sum(running_sum(placed, [], order, F.col("cap"), "cap_upto"), [], order, F.col("weight"), "weight_upto")
    both = durable(both)
    totals = both.agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    level = (F.col("caps") / settings.most - (F.col("cap_upto") - F.col("cap"))) / (
        F.col("weights") - (F.col("weight_upto") - F.col("weight"))
    )
    levels = attach_row(both, totals).withColumn("level", level)
    # In order of the level at which a source is full, the first that stays open sets the level.
    first = levels.agg(F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "place", "level"))).alias("open"))
    return attach_row(both, first).select(
        *sizes.columns, F.coalesce(F.least("cap", F.col("open.level") * F.col("weight")), "cap").alias("target")
    )


def ranked(docs: DataFrame, settings: Settings, tilt: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the order of their source, and a row of facts for each source.

    Facts: ``_key``, ``bar`` (the last place within the target) and ``extra`` (the place
    of the document that fills the rest; null if none).
    """
    setup(docs.sparkSession)
    rows = durable(docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), words(F.col("text")).alias("size"),
        tilted(tilt).alias("tilt"),
    ).withColumn("preference", preference(F.col("size"), F.col("tilt"), settings)).drop("tilt"))
    named = targets(
        rows.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count("*").alias("n_rows"), F.avg("preference").alias("usual")
        ), settings
    ).withColumnRenamed("source", "_source")
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(settings.most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    # Written, so that the planner knows its size: a row for each source.
    known = durable(
        named.withColumn("whole", F.floor(share).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("slices", F.ceil(F.col("n_rows") / settings.slice_rows))
    )
    placed = (
        rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("q", odds(F.col("doc_id"), settings.seed) / F.col("preference"))
        # About as many documents in each slice: the order with the usual odds is uniform.
        .withColumn("even", F.col("q") * F.col("usual"))
        .withColumn("slice", F.floor(F.col("even") / (1 + F.col("even")) * F.col("slices")))
        .withColumn("key", source_key(F.col("source")))
    )
    ordered = durable(running(placed, "key", "slice", ["q", "doc_id", "size"], "size", "before").select(
        "doc_id", "source", "size", "source_size", "target", "whole", "need", "key", "before",
        F.struct("q", "doc_id", "size").alias("place"),
        (F.col("before") + F.col("size") <= F.col("need")).alias("chosen"),
    ))
    bars = durable(
        ordered.groupBy("key").agg(
            F.first("need").alias("need"), F.first("whole").alias("whole"),
            F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("got"),
            F.max(F.when(F.col("chosen"), F.col("place"))).alias("bar"),
        ).select(F.col("key").alias("_key"), F.col("whole").alias("_whole"), (F.col("need") - F.col("got")).alias("gap"), "bar")
    )
    # What the ranked documents leave open goes to the one whose size is nearest to it.
    extra = (
        ordered.where("size > 0 AND NOT chosen").join(bars, F.col("key") == F.col("_key")).where("abs(size - gap) < gap")
        .groupBy(F.col("_key").alias("_key2"))
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "before", "place")).alias("best"))
    )
    facts = durable(bars.join(extra, F.col("_key") == F.col("_key2"), "left").select(
        "_key", "_whole", "bar", F.col("best.before").alias("extra_before"), F.col("best.place").alias("extra")
    ))
    return ordered, facts


def mix(docs: DataFrame, settings: Settings = Settings(), tilt: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` for every row."""
    ordered, facts = ranked(docs, settings, tilt)
    picked = ordered.join(facts.select("_key", "extra_before"), F.col("key") == F.col("_key"), "left")
    taken = F.col("chosen") | F.coalesce(F.col("before") == F.col("extra_before"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + taken.cast("long")).otherwise(F.lit(0).cast("long"))
    return picked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def repeat(docs: DataFrame, settings: Settings = Settings(), tilt: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them.

    A row's place is compared with its source's last place, so texts are not moved. Equal
    rows are all taken if one of them is.
    """
    _, facts = ranked(docs, settings, tilt)
    found = docs.select(
        F.struct("*").alias("row"), source_key(F.col("source")).alias("key"), F.col("doc_id").alias("doc_id"),
        tilted(tilt).alias("tilt"), words(F.col("text")).alias("size"),
    ).select("row", "key", F.struct(
        (odds(F.col("doc_id"), settings.seed) / preference(F.col("size"), F.col("tilt"), settings)).alias("q"), "doc_id", "size"
    ).alias("place")).join(facts, F.col("key") == F.col("_key"))
    taken = F.coalesce(F.col("place") <= F.col("bar"), F.lit(False)) | F.coalesce(F.col("place") == F.col("extra"), F.lit(False))
    copies = F.when(F.col("place.size") > 0, F.col("_whole") + taken.cast("long")).otherwise(F.lit(0).cast("long"))
    return found.select("row", copies.alias("copies")).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    ).select("row.*")
