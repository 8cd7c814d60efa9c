"""Quality by importance resampling: hashed n-gram models of target and raw text.

Both models are shares of hashed word and word-pair counts: the target's from texts
labelled good (outside the held-out third), the raw one's from the whole corpus. A text's
``log_ratio``, the logarithm of the models' ratio, is the sum over its n-grams. Its
``log_weight``, by which it is sampled, is that ratio tempered to the power
sqrt(``reference`` / number of its n-grams): the models' errors add up over a text, and long
texts would otherwise be judged by them. ``reference=None`` samples by the ratio itself.
With a Gumbel number added to the log weight, the ``k`` largest are a sample without
replacement in proportion to the weights.

Defined cases: null and empty texts have no n-gram and weight 0; a null id is never a
training row, and such rows share their random number; several labels of one id count as
their minimum, null labels are no labels; without good texts every weight is 0; equal
rows are drawn each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import id_and_text, running, setup
from saltmarsh.llm.mixing import uniform
from saltmarsh.llm.shingles import SIGNS, mixed, pieces, slices, word_hashes
from saltmarsh.session import durable

HELD_OUT = "coalesce(crc32(encode(CAST(doc_id AS string), 'UTF-8')) % 3 = 1, false)"


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled good texts of the target model; the raw model counts all texts.

    ``share``: of all rows that are drawn; by default the share of good ones among the labels used.
    """

    train_rows: int = 20_000
    bits: int = 16
    smoothing: float = 1.0
    reference: int | None = 256
    share: float | None = None
    seed: str = "quality"


def grams(texts: list[str], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: number of the first, owner and bucket of every word and word pair."""
    for begin, end in slices(texts):
        coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts[begin:end]]
        if len(coded) == 1:
            words = np.concatenate([np.empty(0, np.uint64), *[word_hashes(p, SIGNS)[0] for p in pieces(coded[0])]])
            owner = np.zeros(len(words), dtype=np.int64)
        else:
            words, starts = word_hashes(b"\n".join(coded), SIGNS)
            owner = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), starts, side="right")
        near = owner[1:] == owner[:-1]
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[near]
        bucket = np.concatenate([words, pairs]) >> np.uint64(64 - bits)
        yield begin, np.concatenate([owner, owner[1:][near]]), bucket.astype(np.int64)


def counts(texts: DataFrame, bits: int) -> np.ndarray:
    """How often each bucket occurs in all texts (at most 2**bits rows reach the driver)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, _, bucket in grams(batch["text"].tolist(), bits):
                total += np.bincount(bucket, minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    found = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=float)
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Log ratio of every bucket, and the share of good texts among the labels used."""
    setup(docs.sparkSession)
    known = durable(
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL AND NOT " + HELD_OUT)
        .groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") > 0).alias("good"))
    )
    rated = known.agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good")).first()
    texts = id_and_text(docs)
    part = min(1.0, settings.train_rows / max(1, rated["good"]))
    chosen = known.where("good").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= int(part * (1 << 30))).select("_id")
    # Bounded by train_rows: one number a row.
    good = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    target, raw = counts(good, settings.bits), counts(texts, settings.bits)
    if not target.any():
        return np.zeros(1 << settings.bits), 1.0
    # The raw shares smooth the target's, so a bucket seen in neither has ratio 1.
    shares = (raw + settings.smoothing) / (raw + settings.smoothing).sum()
    weight = settings.smoothing * len(raw)
    goal = (target + weight * shares) / (target.sum() + weight)
    return np.log(goal) - np.log(shares), rated["good"] / rated["n"]


def weigh(docs: DataFrame, ratio: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_grams``, ``log_ratio`` and ``log_weight`` of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 2**bits numbers
    bits, reference = settings.bits, settings.reference

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weight, n = np.zeros(len(batch)), np.zeros(len(batch), dtype=np.int64)
            for begin, owner, bucket in grams(batch["text"].tolist(), bits):
                own = np.bincount(owner, shared.value[bucket])
                weight[begin:begin + len(own)] += own
                n[begin:begin + len(own)] += np.bincount(owner)
            power = np.sqrt(reference / np.maximum(n, 1)) if reference else 1.0
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_grams": n, "log_ratio": weight, "log_weight": weight * power})

    texts = id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(score, f"doc_id {kind}, n_grams long, log_ratio double, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_grams``, ``log_ratio``, ``log_weight``, ``gumbel_key`` and ``kept`` (among the ``k`` largest keys)."""
    spark = setup(docs.sparkSession)
    ratio, good = fit(docs, labels, settings)
    gumbel = -F.log(-F.log(uniform(F.col("doc_id"), settings.seed)))
    keyed = weigh(docs, ratio, settings).withColumn("gumbel_key", F.col("log_weight") + gumbel)
    # Slices of the order come from a range partitioning, written once.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(
        keyed.repartitionByRange(parts, F.desc("gumbel_key"), F.col("doc_id"))
        .withColumn("slice", F.spark_partition_id()).withColumn("all", F.lit(0)).withColumn("one", F.lit(1))
    )
    k = round((good if settings.share is None else settings.share) * rows.count())
    ranked = running(rows.withColumn("down", -F.col("gumbel_key")), "all", "slice", ["down", "doc_id", "n_grams"], "one", "before")
    return ranked.select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "n_grams", "log_ratio", "log_weight", "gumbel_key", (F.col("before") < k).alias("kept")
    )
