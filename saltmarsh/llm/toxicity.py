"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its lower-case character n-grams (4 to 6), hashed into a table of
fixed size. From labelled texts come counts per n-gram and class; the logarithm of the
ratio of the two smoothed class shares scales each n-gram, and a logistic regression
(``pyspark.ml``) is fitted on the scaled features. The score is its probability.

Defined cases: a null or empty text has no n-gram and gets the intercept's probability;
a null id is never a training row and is not held out; repeated documents are scored
each; several labels of one id count as their maximum, null labels are no labels; without
labels of both classes every score is the smoothed share of toxic labels; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import id_and_text, setup
from saltmarsh.session import durable


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows that are fitted; nothing else is sampled."""

    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    train_rows: int = 20_000
    smoothing: float = 1.0
    min_documents: int = 3
    min_z: float = 3.0
    penalty: float = 3e-4
    iterations: int = 60
    cut: float = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of every hash value: log-count ratio times fitted weight
    intercept: float
    sizes: tuple[int, ...]
    bits: int


#: Code points handled at a time, so that a very long text needs little memory.
SLICE = 1 << 20


def gram_ids(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash values of all n-grams of one run of code points."""
    found = []
    for size in sizes:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, dtype=np.uint32)
        for k in range(size):
            value = value * np.uint32(0x01000193) + codes[k:k + n]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x9E3779B1)
        found.append(value >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def distinct_grams(text: str, sizes: tuple[int, ...], bits: int, seen: np.ndarray) -> np.ndarray:
    """The distinct hash values of a whole text. ``seen``: scratch of 2**bits integers."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) <= SLICE:
        ids = gram_ids(codes, sizes, bits)
        order = np.arange(len(ids), dtype=seen.dtype)
        seen[ids] = order  # the last place of each value stays
        return ids[seen[ids] == order]
    there = np.zeros(1 << bits, dtype=bool)
    for start in range(0, len(codes), SLICE):
        there[gram_ids(codes[start:start + SLICE + max(sizes) - 1], sizes, bits)] = True
    return np.flatnonzero(there).astype(np.uint32)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Distinct n-grams and label of at most about ``train_rows`` labelled texts outside the held-out third.

    The rows with the smallest hashes of their ids are taken, so no order is needed.
    """
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND NOT " + HELD_OUT)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    known = durable(known)
    share = min(1.0, settings.train_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounded by train_rows: two numbers a row.
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    sizes, bits = settings.sizes, settings.bits

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            yield pd.DataFrame({
                "toxic": batch["toxic"].astype("int32"),
                "grams": [distinct_grams(t, sizes, bits, seen).astype(np.int32) for t in batch["text"]],
            })

    return durable(texts.select("toxic", "text").mapInPandas(extract, "toxic int, grams array<int>"))


HELD_OUT = "coalesce(crc32(encode(CAST(doc_id AS string), 'UTF-8')) % 3 = 1, false)"


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on the labelled rows outside the held-out third."""
    setup(docs.sparkSession)
    rows = training_rows(docs, labels, settings)
    width = 1 << settings.bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, width), dtype=np.int64)
        for batch in batches:
            for y, grams in zip(batch["toxic"], batch["grams"], strict=True):
                totals[int(y > 0), grams] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pd.DataFrame({"gram": at, "clean": totals[0, at], "toxic": totals[1, at]})

    # At most one row for each hash value.
    counts = durable(
        rows.mapInPandas(count, "gram long, clean long, toxic long")
        .groupBy("gram").agg((F.sum("clean") + settings.smoothing).alias("q"), (F.sum("toxic") + settings.smoothing).alias("p"))
        .where(F.col("p") + F.col("q") >= settings.min_documents + 2 * settings.smoothing)
    )
    classes = {r["y"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_all = classes.get(True, 0), sum(classes.values())
    weights = np.zeros(width)
    prior = float(np.log((n_toxic + 1) / (n_all - n_toxic + 1)))
    if not 0 < n_toxic < n_all:
        return Model(weights, prior, settings.sizes, settings.bits)
    total = counts.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    if not total["p"]:
        return Model(weights, prior, settings.sizes, settings.bits)
    ratio = F.log(F.col("p") / total["p"]) - F.log(F.col("q") / total["q"])
    # Ratios that chance explains carry no signal; the others are few.
    strong = (
        counts.withColumn("ratio", ratio).where(F.abs("ratio") >= settings.min_z * F.sqrt(1 / F.col("p") + 1 / F.col("q")))
        .select("gram", "ratio").toPandas().sort_values("gram")
    )
    if strong.empty:
        return Model(weights, prior, settings.sizes, settings.bits)
    grams, ratio = strong["gram"].to_numpy(), strong["ratio"].to_numpy()
    present = CountVectorizerModel.from_vocabulary(
        [str(g) for g in grams], inputCol="words", outputCol="present"
    ).setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="present", outputCol="features")
    data = rows.select(
        F.transform("grams", lambda g: g.cast("string")).alias("words"), (F.col("toxic") > 0).cast("double").alias("label")
    )
    fitted = LogisticRegression(
        maxIter=settings.iterations, regParam=settings.penalty, standardization=False
    ).fit(scaled.transform(present.transform(data)).select("features", "label"))
    weights[grams] = ratio * fitted.coefficients.toArray()
    return Model(weights, float(fitted.intercept), settings.sizes, settings.bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for every whole text; one pass, no shuffle."""
    spark = setup(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # of 2**bits numbers, whatever the corpus

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        seen = np.zeros(1 << m.bits, dtype=np.int32)
        for batch in batches:
            margin = np.array([
                m.intercept + m.weights[distinct_grams(t, m.sizes, m.bits, seen)].sum() for t in batch["text"]
            ], dtype=float)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(margin, -500, 500)))})

    texts = id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(rate, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``."""
    return score(docs, fit(docs, labels, settings)).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= settings.cut).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the cut."""
    model = fit(docs, labels, settings)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        m = shared.value
        seen = np.zeros(1 << m.bits, dtype=np.int32)
        return pd.Series([
            m.intercept + m.weights[distinct_grams(t, m.sizes, m.bits, seen)].sum() for t in texts
        ], dtype="float64")

    return docs.where(margin(F.coalesce("text", F.lit(""))) < float(np.log(settings.cut / (1 - settings.cut))))
