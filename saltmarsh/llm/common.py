"""Helpers shared by the corpus operators.

Nothing here collects rows: group facts are aggregated with a map-side combine and
handed back over salted keys, running sums are built from bucket totals, and
components are found by joins on distinct edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.session import configure, durable

# The white space of the texts, as a class for Java's and RE2's patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# A key's rows are spread over this many salts when its facts are handed back.
SALTS = 32

# Rows and bytes in one Arrow batch: texts can be long, workers are small.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def setup(spark: SparkSession) -> SparkSession:
    """Settings of the corpus operators, on top of the library's."""
    configure(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under names of its own; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hand_back(rows: DataFrame, keys: Sequence[str], facts: Sequence[Column], spread: Sequence[str]) -> DataFrame:
    """``rows`` with group ``facts`` (aliased aggregates over ``keys``) beside every row.

    A key can hold a third of all rows, so the join back runs on (key, salt): each
    row takes a salt from its ``spread`` columns, the aggregate notes which salts a
    key uses, and its one row is repeated for those salts only, never more often than
    the key has rows. Keys must not be null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    used = F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_used")
    groups = salted.groupBy(*keys).agg(*facts, used)
    one_per_salt = groups.withColumn(
        "_salt",
        F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(SALTS - 1)),
            lambda s: F.getbit(F.col("_used"), s) == 1,
        )),
    ).drop("_used")
    return salted.join(one_per_salt, [*keys, "_salt"]).drop("_salt")


def running(
    rows: DataFrame, group: str, bucket: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the same ``group`` that stand before a row.

    Rows stand in order of (``bucket``, ``order``); ``bucket`` is an integer that
    splits a group into many small slices. One window runs inside a slice, one over
    the slice totals of a group, so no task sees a whole group of rows.
    """
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long"))
        .drop("_total")
    )
    sliced = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    return (
        sliced.join(offsets, [group, bucket])
        .withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for the nodes of undirected ``edges`` (a, b).

    Each round points every node at the smallest label among itself and its
    neighbours, then at that label's own label; it ends when no label changes, after
    about the logarithm of the longest chain. Labels are written each round. A hub's
    label reaches its neighbours over salted keys, its own minimum is a combined aggregate.
    """
    both = durable(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct()
    )
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        # The label of each edge's far end; a far end that is a hub is spread by its neighbour.
        far = both.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        used = far.groupBy("b").agg(F.collect_set("_salt").alias("_salts"))
        sent = (
            labels.join(used, labels["node"] == used["b"])
            .select(F.col("node").alias("b"), "root", F.explode("_salts").alias("_salt"))
        )
        heard = far.join(sent, ["b", "_salt"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "root", F.least("root", "heard").alias("near"))
        # Jump: the label of the label. Equal labels are combined before the lookup.
        nearer = durable(nearer)
        jumps = (
            nearer.select(F.col("near").alias("at")).distinct()
            .join(nearer.select(F.col("node").alias("at"), F.col("near").alias("next")), "at")
        )
        moved = hand_over(nearer, jumps, "near", "at")
        moved = durable(moved.select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        labels = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return labels


def hand_over(rows: DataFrame, facts: DataFrame, key: str, fact_key: str) -> DataFrame:
    """Inner join of ``rows`` on ``key`` with ``facts`` (one row for each ``fact_key``), hot keys salted.

    A fact is repeated only for the salts its rows use.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    used = salted.groupBy(F.col(key).alias(fact_key)).agg(F.collect_set("_salt").alias("_salts"))
    spread = facts.join(used, fact_key).withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(
        spread.withColumnRenamed("_salt", "_salt2"),
        (salted[key] == spread[fact_key]) & (F.col("_salt") == F.col("_salt2")),
    ).drop("_salt", "_salt2")
