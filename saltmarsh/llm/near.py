"""Near-duplicate classes by ProbMinHash, banding and verification.

Every distinct text is a weighted set of word shingles. Each shingle sends a Poisson
process of points, with its weight as rate, to the registers of a signature; a register
keeps its earliest point, and a process ends as soon as its next point comes after the
latest register. Registers of two texts agree with their probability Jaccard similarity

    J_P(x, y) = sum over d of 1 / sum over e of max(x_e / x_d, y_e / y_d).

Texts that share a band of registers are grouped around the text that meets most others
(the pivot), in blocks of bounded size. Inside a block all texts are compared, by
signature and then exactly; only the links that join classes leave the task, so a group
gives fewer rows than it has texts. Texts of a large group that are not in its pivot's
class then visit the group's other blocks, so no pair that shares a band is left out.
Classes are the components of the links.

Defined cases: null text counts as empty; equal texts are one class, empty ones too;
texts of fewer than five words are one shingle; a text without words links to no other
text. The smallest id of a class names it, and that row stays; null ids come last. Of
repeated rows one stays. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import components, hand_back, hand_over, id_and_text, setup
from saltmarsh.llm.shingles import mixed, slices, weighted
from saltmarsh.session import durable


@dataclass(frozen=True)
class Settings:
    """24 bands of 5 miss a pair at 0.8 once in 14,000. ``slack``: four standard errors of a signature."""

    least: float = 0.8
    bands: int = 24
    rows: int = 5
    slack: float = 0.15
    block_texts: int = 1000
    block_chars: int = 8 << 20


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (n x m shingle hashes; 0 where a text has no shingle)."""
    earliest = np.full(n * m, np.inf)
    kept = np.zeros(n * m, dtype=np.uint64)
    time, turn = np.zeros(len(shingle)), 0
    state = mixed(shingle + np.uint64(0x9E3779B97F4A7C15))
    while len(shingle):
        turn += 1
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        # The upper 44 bits give the gap, the lower 20 the register.
        time = time - np.log(((state >> np.uint64(20)).astype(float) + 0.5) * 2.0 ** -44) / weight
        slot = owner * m + ((state & np.uint64(0xFFFFF)) % np.uint64(m)).astype(np.int64)
        better = time < earliest[slot]
        np.minimum.at(earliest, slot[better], time[better])
        won = better & (time == earliest[slot])
        kept[slot[won]] = shingle[won]
        # Early end: later points of a process can only come later still.
        on = time < earliest.reshape(n, m).max(axis=1)[owner]
        owner, shingle, weight, time, state = owner[on], shingle[on], weight[on], time[on], state[on]
    return kept.reshape(n, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two sorted weighted sets (hashes, weights)."""
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    n = int(same.sum())
    if not n:
        return 0.0
    if wx.max() == 1.0 and wy.max() == 1.0:
        return n / (len(x) + len(y) - n)
    alone = np.ones(len(y), dtype=bool)
    alone[at[same]] = False
    both = np.concatenate([
        np.column_stack([wx[same], wy[at[same]]]),
        np.column_stack([wx[~same], np.zeros(len(x) - n)]),
        np.column_stack([np.zeros(int(alone.sum())), wy[alone]]),
    ])
    # Few different pairs of weights occur.
    kinds, times = np.unique(both, axis=0, return_counts=True)
    total = 0.0
    for (p, q), k in zip(kinds, times, strict=True):
        if p and q:
            total += k / (times * np.maximum(kinds[:, 0] / p, kinds[:, 1] / q)).sum()
    return float(total)


class Sets:
    """Signatures and weighted sets of some texts."""

    def __init__(self, texts: list[str], m: int):
        self.signatures = np.zeros((len(texts), m), dtype=np.uint64)
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []
        for begin, end in slices(texts):
            owner, shingle, weight = weighted(texts[begin:end])
            self.signatures[begin:end] = signatures(owner, shingle, weight, end - begin, m)
            cut = np.searchsorted(owner, np.arange(end - begin + 1))
            self.sets += [(shingle[s:e].copy(), weight[s:e].copy()) for s, e in zip(cut[:-1], cut[1:], strict=True)]

    def alike(self, signature: np.ndarray, begin: int = 0) -> np.ndarray:
        """Estimated similarity of one text with all from ``begin`` on."""
        return (self.signatures[begin:] == signature).mean(axis=1)


class Classes:
    """Union-find over the few labels of one block."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def sketch(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``node`` (digest of the text), ``n_chars`` and ``keys`` (one for each band) of every row."""
    m, bands = settings.bands * settings.rows, settings.bands
    spread = np.random.default_rng(7).integers(1, 1 << 63, (1, bands, settings.rows), dtype=np.uint64) | np.uint64(1)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            found: list = []
            for begin, end in slices(texts):
                owner, shingle, weight = weighted(texts[begin:end])
                kept = signatures(owner, shingle, weight, end - begin, m).reshape(-1, bands, settings.rows)
                key = mixed((mixed(kept + np.uint64(1)) * spread).sum(axis=2, dtype=np.uint64)).view(np.int64)
                some = np.bincount(owner, minlength=end - begin) > 0
                found += [k if s else None for k, s in zip(key, some, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": batch["node"], "n_chars": batch["n_chars"], "keys": found})

    texts = id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", digest(F.col("text")).alias("node"), F.length("text").cast("long").alias("n_chars"), "text").mapInPandas(
        keys, f"doc_id {kind}, node binary, n_chars long, keys array<long>"
    )


def groups(nodes: DataFrame) -> DataFrame:
    """``pivot`` and ``node``: texts that share a band with others, around the one that meets most of them."""
    rows = nodes.where("keys IS NOT NULL").select("node", "n_chars", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = durable(rows.join(sizes, "key"))
    liked = met.groupBy("node").agg(F.sum("n").alias("liked"))
    pivots = met.join(liked, "node").groupBy("key").agg(F.max(F.struct("liked", "node")).alias("best")).select(
        "key", F.col("best.node").alias("pivot")
    )
    return met.join(pivots, "key").groupBy("pivot", "node").agg(F.first("n_chars").alias("n_chars"))


def blocks(grouped: DataFrame, settings: Settings) -> DataFrame:
    """``pivot``, ``node``, ``n_blocks``, ``block``; the pivot stands in every block of its group."""
    sizes = grouped.groupBy("pivot").agg(
        F.greatest(
            F.ceil(F.count("*") / settings.block_texts), F.ceil(F.sum("n_chars") / settings.block_chars)
        ).cast("int").alias("n_blocks")
    )
    own = F.array(F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    return grouped.join(sizes, "pivot").select(
        "pivot", "node", "n_blocks", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(own)).alias("block")
    )


def by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of a sorted partition, joined across batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        mark = list(zip(*[batch[k] for k in keys], strict=True))
        cut = [0] + [i for i in range(1, len(mark)) if mark[i] != mark[i - 1]] + [len(mark)]
        for begin, end in zip(cut[:-1], cut[1:], strict=True):
            if held and mark[begin] != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[begin:end])
            last = mark[begin]
    if held:
        yield pd.concat(held, ignore_index=True)


def links_inside(rows: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that join the classes inside each block."""
    m, least, slack = settings.bands * settings.rows, settings.least, settings.slack

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in by_group(batches, ["pivot", "block"]):
            node = block["node"].tolist()
            have, same, found = Sets(block["text"].tolist(), m), Classes(), []
            order = sorted(range(len(node)), key=lambda i: node[i] != block["pivot"][i])
            have.signatures = have.signatures[order]
            for place, i in enumerate(order[:-1]):
                likely = have.alike(have.signatures[place], place + 1) >= least - slack
                for k in np.flatnonzero(likely):
                    j = order[place + 1 + k]
                    if same.find(i) != same.find(j) and similarity(have.sets[i], have.sets[j]) >= least:
                        same.join(i, j)
                        found.append((node[i], node[j]))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    dealt = rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block")
    return dealt.select("pivot", "block", "node", "text").mapInPandas(compare, "a binary, b binary")


def links_across(rows: DataFrame, settings: Settings) -> DataFrame:
    """Links between texts of different blocks: visitors are compared with the texts of a block.

    ``rows``: ``pivot``, ``block``, ``visits`` (0 for the block's own texts), ``from_block``,
    ``settled`` (in the pivot's class), ``root``, ``node``, ``text``.
    """
    m, least, slack = settings.bands * settings.rows, settings.least, settings.slack

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_group(batches, ["pivot", "block", "visits", "portion"]):
            if part["visits"][0] == 0:
                own, key = part, (part["pivot"][0], part["block"][0])
                have, same = Sets(part["text"].tolist(), m), Classes()
                continue
            if (part["pivot"][0], part["block"][0]) != key:
                continue
            guests, found = Sets(part["text"].tolist(), m), []
            for g in range(len(part)):
                for j in np.flatnonzero(have.alike(guests.signatures[g]) >= least - slack):
                    # Two visitors of each other's blocks are compared once.
                    if not own["settled"][j] and part["from_block"][g] > own["block"][j]:
                        continue
                    a, b = part["root"][g], own["root"][j]
                    if same.find(a) != same.find(b) and similarity(guests.sets[g], have.sets[j]) >= least:
                        same.join(a, b)
                        found.append((part["node"][g], own["node"][j]))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    order = ["pivot", "block", "visits", "portion"]
    dealt = rows.repartition("pivot", "block").sortWithinPartitions(*order)
    return dealt.mapInPandas(compare, "a binary, b binary")


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the ``wanted`` nodes; a text's first row is read, not its copies."""
    source = nodes.join(wanted, "node").select("node", "doc_id")
    rows = id_and_text(docs).withColumn("node", digest(F.col("text")))
    return (
        rows.join(source.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id")),
                  (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .groupBy("node").agg(F.first("text").alias("text"))
    )


def class_table(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``node``, ``repeats``) and, for every node, ``keep_id``, ``keep_node`` and ``class_size``."""
    setup(docs.sparkSession)
    rows = durable(sketch(docs, settings))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    nodes = durable(
        rows.groupBy("node").agg(
            first.alias("first"), F.count("*").alias("n"), F.first("n_chars").alias("n_chars"), F.first("keys").alias("keys")
        ).select("node", F.col("first.doc_id").alias("doc_id"), "n", "n_chars", "keys")
    )
    placed = durable(blocks(groups(nodes), settings))
    texts = durable(texts_of(docs, nodes.select("node", "doc_id"), placed.select("node").distinct()))
    links = durable(links_inside(placed.join(texts, "node"), settings))
    labels = components(links)
    # Groups of several blocks: texts outside the pivot's class visit the other blocks.
    large = placed.where("n_blocks > 1")
    rooted = large.join(labels, "node", "left").select(large["*"], F.coalesce("root", large["node"]).alias("root"))
    centre = rooted.where("node = pivot").select(F.col("pivot").alias("_pivot"), F.col("root").alias("_root")).distinct()
    known = durable(
        rooted.join(centre, F.col("pivot") == F.col("_pivot"))
        .select("pivot", "node", "n_blocks", "block", "root", (F.col("root") == F.col("_root")).alias("settled"))
    )
    own = known.select("pivot", "block", F.lit(0).alias("visits"), F.lit(0).alias("portion"), F.col("block").alias("from_block"), "settled", "root", "node")
    guests = known.where("NOT settled").select(
        "pivot", F.explode(F.filter(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: b != F.col("block"))).alias("to"),
        F.lit(1).alias("visits"), F.pmod(F.xxhash64("node", F.lit(3)), F.col("n_blocks")).cast("int").alias("portion"),
        F.col("block").alias("from_block"), "settled", "root", "node",
    ).withColumnRenamed("to", "block")
    more = links_across(own.unionByName(guests).join(texts, "node"), settings)
    links = durable(links.unionByName(more))
    labels = components(links)
    rooted = nodes.join(labels, "node", "left").select(
        "node", "doc_id", "n", F.coalesce("root", "node").alias("root")
    )
    facts = hand_back(
        rooted, ["root"],
        [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"), F.sum("n").alias("class_size")],
        ["node"],
    ).select("node", F.col("best.doc_id").alias("keep_id"), F.col("best.node").alias("keep_node"), "class_size")
    return rows.groupBy("doc_id", "node").agg(F.count("*").alias("repeats")), facts


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id of the class), ``class_size`` and ``kept`` for every row."""
    rows, facts = class_table(docs, settings)
    stays = (F.col("node") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    joined = hand_over(rows, facts.withColumnRenamed("node", "_node"), "node", "_node")
    return joined.select(
        "doc_id", F.col("keep_id").alias("class_id"), "class_size", stays.alias("stays"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("turn"),
    ).select("doc_id", "class_id", "class_size", (F.col("stays") & (F.col("turn") == 1)).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each class."""
    rows, facts = class_table(docs, settings)
    keepers = facts.where("node = keep_node").select(F.col("node").alias("_node"), F.col("keep_id").alias("_id"))
    repeated = rows.where("repeats > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.lit(True).alias("_again"))
    keepers = keepers.join(repeated, keepers["_id"].eqNullSafe(repeated["_id"]) & (keepers["_node"] == repeated["_node"]), "left").select(
        keepers["_node"], keepers["_id"], F.coalesce("_again", F.lit(False)).alias("_again")
    )
    found = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), digest(F.coalesce("text", F.lit(""))).alias("node")
    ).join(keepers, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = found.where("NOT _again").select("row.*")
    again = found.where("_again").groupBy("doc_id", "node").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(again)
