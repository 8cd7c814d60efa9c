"""Nearest neighbours by inner product, on several shifted Hilbert curves.

Vectors are lifted onto a sphere (an extra coordinate makes all as long as the longest),
so that the largest inner product is the nearest point. Each curve projects them onto a
few random directions, shifts the grid, and orders them by their place on a Hilbert
curve. Spark range-partitions every curve; its order is cut into blocks of equal numbers
of vectors. A query searches the blocks around its own place on every curve, keeps the
best of each, and the merged candidates are ranked by the exact measure.

How many blocks are searched is measured, not guessed: a bounded sample of queries is
compared with all vectors, and the window is the smallest in which ``share`` of their
true neighbours stand on at least one curve. Vectors without structure need wide windows.

Equal vectors are one point, with their smallest ids; so a vector that many rows have is
searched once. Defined cases: vectors that are null, zero, of another length than most,
or hold null or non-finite components take no part, nor do rows without id; a query is
never its own neighbour, and rows of its id count as itself; of several vectors of one
query id the first in order is searched; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import hand_over, setup
from saltmarsh.llm.curves import hilbert
from saltmarsh.llm.near import by_group
from saltmarsh.session import durable


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` vectors set the grids, ``probes`` queries the window; all vectors are indexed."""

    neighbours: int = 20
    curves: int = 8
    dims: int = 8
    bits: int = 7
    block_rows: int = 2048
    fit_rows: int = 5000
    probes: int = 200
    share: float = 0.96
    seed: int = 11


@dataclass(frozen=True)
class Grid:
    """Directions, and per curve the lower corner and width of its grid."""

    centre: np.ndarray
    directions: np.ndarray  # curves x (D + 1) x dims
    corner: np.ndarray
    width: np.ndarray
    longest: float
    bits: int

    def keys(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Place of every vector on every curve (n x curves)."""
        length = np.sqrt((vectors ** 2).sum(axis=1))
        if queries:
            lifted = np.column_stack([vectors * (self.longest / length)[:, None], np.zeros(len(vectors))])
        else:
            lifted = np.column_stack([vectors, np.sqrt(np.maximum(self.longest ** 2 - length ** 2, 0.0))])
        top = (1 << self.bits) - 1
        out = []
        for r, lo, w in zip(self.directions, self.corner, self.width, strict=True):
            cells = np.clip(((lifted - self.centre) @ r - lo) / w * (top + 1), 0, top)
            out.append(hilbert(cells.astype(np.int64), self.bits))
        return np.column_stack(out)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def points(rows: DataFrame, settings: Settings) -> DataFrame:
    """Distinct vectors: ``node``, ``vec``, ``ids`` (the smallest), ``first_id``, ``asks`` (a query has it)."""
    n = rows.count()
    salts = 1 + n // 50_000
    most = settings.neighbours + 1
    partial = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(
        F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids"), F.max("asks").alias("asks")
    )
    whole = partial.groupBy("vec").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"), F.max("asks").alias("asks")
    )
    return durable(whole.select(
        F.monotonically_increasing_id().alias("node"), "vec", "ids", F.get("ids", F.lit(0)).alias("first_id"), "asks"
    ))


def fit(nodes: DataFrame, n: int, settings: Settings) -> Grid:
    """Grids from about ``fit_rows`` vectors, those with the smallest hashes."""
    share = min(1.0, settings.fit_rows / max(n, 1))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vec").toPandas()
    longest = nodes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    vectors = matrix(sample["vec"])
    extra = np.sqrt(np.maximum(longest - (vectors ** 2).sum(axis=1), 0.0))
    lifted = np.column_stack([vectors, extra])
    rng = np.random.default_rng(settings.seed)
    width = lifted.shape[1]
    dims = min(settings.dims, width)
    directions = np.stack([np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(settings.curves)])
    centre = lifted.mean(axis=0)
    places = (lifted - centre) @ directions
    low, high = np.quantile(places, 0.005, axis=1), np.quantile(places, 0.995, axis=1)
    span = np.maximum(high - low, 1e-12) * 1.3
    # Every curve's grid is shifted by its own part of the margin.
    return Grid(centre, directions, low - rng.uniform(0.0, 0.2, low.shape) * span, span, float(np.sqrt(longest)), settings.bits)


def index(nodes: DataFrame, grid: Grid, n: int, settings: Settings) -> DataFrame:
    """``curve``, ``ordinal`` (block), ``asks`` (0: indexed vector, 1: query), ``node``, ``first_id``, ``vec``."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(grid)  # a few thousand numbers
    kind = nodes.schema["vec"].dataType.simpleString()
    id_kind = nodes.schema["first_id"].dataType.simpleString()
    layout = f"curve int, key long, asks int, node long, first_id {id_kind}, vec {kind}"
    block = settings.block_rows

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for batch in batches:
            if batch.empty:
                continue
            for asks in (0, 1):
                part = batch if not asks else batch[batch["asks"]]
                if part.empty:
                    continue
                keys = g.keys(matrix(part["vec"]), bool(asks))
                for curve in range(keys.shape[1]):
                    yield pd.DataFrame({
                        "curve": curve, "key": keys[:, curve], "asks": asks, "node": part["node"].to_numpy(),
                        "first_id": part["first_id"].to_numpy(), "vec": part["vec"].to_numpy(),
                    })

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, curve, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            local = np.zeros(len(batch), dtype=np.int64)
            curves, asks = batch["curve"].to_numpy(), batch["asks"].to_numpy()
            for c in np.unique(curves):
                own = curves == c
                before = np.cumsum(asks[own] == 0) - (asks[own] == 0) + (seen if c == curve else 0)
                local[own] = before // block
                curve, seen = c, int(before[-1]) + int(asks[own][-1] == 0)
            yield batch.drop(columns="key").assign(task=task, local=local)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), settings.curves * n // (8 * block))
    ranged = nodes.mapInPandas(place, layout).repartitionByRange(parts, "curve", "key", "node")
    rows = durable(
        ranged.sortWithinPartitions("curve", "key", "asks", "node")
        .mapInPandas(number, layout.replace("key long, ", "") + ", task int, local long")
    )
    # One row for each block.
    blocks = durable(
        rows.select("curve", "task", "local").distinct().withColumn(
            "ordinal", F.row_number().over(Window.partitionBy("curve").orderBy("task", "local"))
        )
    )
    return rows.join(blocks, ["curve", "task", "local"]).drop("task", "local")


def window(nodes: DataFrame, placed: DataFrame, settings: Settings) -> int:
    """Blocks to each side in which ``share`` of the sampled queries' true neighbours stand on some curve."""
    most = settings.neighbours
    asking = nodes.where("asks")
    share = min(1.0, settings.probes / max(asking.count(), 1))
    probes = asking.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("node", "vec").toPandas()
    if probes.empty:
        return 0
    shared = nodes.sparkSession.sparkContext.broadcast((probes["node"].to_numpy(), matrix(probes["vec"])))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, vectors = shared.value
        score, node = np.full((len(own), most), -np.inf), np.full((len(own), most), -1, dtype=np.int64)
        for batch in batches:
            if batch.empty:
                continue
            got = vectors @ matrix(batch["vec"]).T
            got[own[:, None] == batch["node"].to_numpy()[None, :]] = -np.inf
            score = np.hstack([score, got])
            node = np.hstack([node, np.broadcast_to(batch["node"].to_numpy(), got.shape)])
            top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            score, node = np.take_along_axis(score, top, 1), np.take_along_axis(node, top, 1)
        there = np.isfinite(score)
        yield pd.DataFrame({"probe": np.repeat(own, most)[there.ravel()], "node": node[there], "score": score[there]})

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "node")
    true = nodes.select("node", "vec").mapInPandas(best, "probe long, node long, score double").withColumn(
        "place", F.row_number().over(order)
    ).where(F.col("place") <= most)
    # A few thousand pairs: probes times neighbours.
    at = placed.where("asks = 0").join(F.broadcast(true), "node").select("probe", "node", "curve", "ordinal")
    from_ = placed.where("asks = 1").select(F.col("node").alias("probe"), "curve", F.col("ordinal").alias("own"))
    off = at.join(from_, ["probe", "curve"]).groupBy("probe", "node").agg(F.min(F.abs(F.col("ordinal") - F.col("own"))).alias("off"))
    reach = off.agg(F.percentile_approx("off", F.lit(settings.share), F.lit(100_000))).first()[0]
    return int(reach or 0)


def search(placed: DataFrame, reach: int, n_queries: int, settings: Settings) -> DataFrame:
    """``query`` and ``node`` with ``score``: the best that a query finds.

    Its own block of every curve is searched first; the other blocks then give only what
    is not below the worst that it already has, so most of them give nothing.
    """
    most = settings.neighbours + 1
    near = durable(visit(placed, placed.where("asks = 1").withColumn("bar", F.lit(None).cast("double")), n_queries, settings))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    bars = (
        near.groupBy("query", "node").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(order))
        .where(F.col("at") == most).select("query", F.col("score").alias("bar"))
    )
    limits = placed.groupBy("curve").agg(F.max("ordinal").alias("last"))
    around = F.sequence(F.greatest(F.lit(1), F.col("ordinal") - reach), F.least("last", F.col("ordinal") + reach))
    visits = (
        placed.where("asks = 1").join(F.broadcast(limits), "curve")  # a row for each curve
        .join(bars, F.col("node") == F.col("query"), "left").drop("query")
        .withColumn("ordinal", F.explode(F.filter(around, lambda o: o != F.col("ordinal")))).drop("last")
    )
    return near.unionByName(visit(placed, visits, n_queries, settings))


def visit(placed: DataFrame, visits: DataFrame, n_queries: int, settings: Settings) -> DataFrame:
    """The best of each visited block, not below the query's ``bar``."""
    most = settings.neighbours + 1
    portions = 1 + n_queries // 2000
    visits = visits.withColumn("portion", F.pmod(F.xxhash64("node"), F.lit(portions)).cast("int"))
    rows = placed.where("asks = 0").withColumns({"portion": F.lit(-1), "bar": F.lit(None).cast("double")}).unionByName(visits)
    id_kind = placed.schema["first_id"].dataType.simpleString()

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for part in by_group(batches, ["curve", "ordinal", "asks", "portion"]):
            at = (part["curve"][0], part["ordinal"][0])
            if part["asks"][0] == 0:
                key, have = at, matrix(part["vec"])
                node, first = part["node"].to_numpy(), part["first_id"].to_numpy()
                continue
            if at != key:
                continue
            ask = matrix(part["vec"])
            got = ask @ have.T
            keep = min(most, len(node))
            least = np.partition(got, -keep, axis=1)[:, -keep]
            found = []
            least = np.fmax(least, part["bar"].to_numpy(dtype=float))
            for i, query in enumerate(part["node"]):
                near = np.flatnonzero(got[i] >= least[i] - 1e-9 * max(1.0, abs(least[i])))
                if not len(near):
                    continue
                score = (have[near] * ask[i]).sum(axis=1)
                best = np.lexsort([first[near], -score])[:keep]
                found.append(pd.DataFrame({"query": query, "node": node[near[best]], "first_id": first[near[best]], "score": score[best]}))
            if found:
                yield pd.concat(found, ignore_index=True)

    order = ["curve", "ordinal", "asks", "portion"]
    return rows.repartition("curve", "ordinal").sortWithinPartitions(*order).mapInPandas(
        rank, f"query long, node long, first_id {id_kind}, score double"
    )


def nearest(
    table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the neighbours of every row for which ``is_query`` holds."""
    spark = setup(table.sparkSession)
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("vec"))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    id_kind = rows.schema["id"].dataType.simpleString()
    if not lengths:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    rows = durable(rows.where(F.size("vec") == lengths[0]["d"]))
    nodes = points(rows, settings)
    n = nodes.count()
    grid = fit(nodes, n, settings)
    placed = durable(index(nodes, grid, n, settings))
    asking = nodes.where("asks").count()
    reach = window(nodes, placed, settings)
    found = search(placed, reach, asking, settings).groupBy("query", "node").agg(
        F.first("first_id").alias("first_id"), F.max("score").alias("score")
    )
    most = settings.neighbours + 1
    by_point = Window.partitionBy("query").orderBy(F.desc("score"), "first_id")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(by_point)).where(F.col("place") <= most).join(nodes.select("node", "ids"), "node")
    listed = (
        best.select("query", "score", F.explode("ids").alias("id"))
        .withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= most)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
    )
    asked = rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    own = hand_over(asked, nodes.select(F.col("vec").alias("_vec"), "node"), "vec", "_vec").select("id", "node")
    answers = hand_over(own, listed, "node", "query")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, settings.neighbours)
    return answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )
