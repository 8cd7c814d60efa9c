"""Packing documents into windows of tokens by non-negative least squares.

A document is its token ids (added tokens of the vocabulary are matched) and an end mark.
Documents longer than the window are cut into whole windows and a rest. The histogram of piece lengths has a fixed number of
bins, so it is planned on the driver whatever the corpus: every combination of up to
three bins that fills a window is a column, non-negative least squares finds how often
to repeat each, the counts are rounded within what is there, and what remains is packed
greedily, longest piece first, by patterns that are repeated as often as they can be.
Spark ranks the pieces of each bin and looks up the window of each rank.

Defined cases: null and empty texts are one end mark; documents of one id are told apart
by their tokens; equal rows take the places in any order; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import id_and_text, running, setup
from saltmarsh.llm.tokens import words
from saltmarsh.session import durable


@dataclass(frozen=True)
class Settings:
    """Lengths below ``fine`` have a bin each, longer ones share bins of ``step``."""

    window: int = 2048
    end_id: int = 1
    fine: int = 256
    step: int = 8
    rounds: int = 1500
    slice_rows: int = 1_000


def bins(settings: Settings) -> np.ndarray:
    """Largest length of each bin, ascending; the last is the window."""
    fine = min(settings.fine, settings.window)
    tops = [*range(1, fine), *range(fine, settings.window + 1, settings.step)]
    return np.array(sorted({*tops, settings.window}))


def combinations(tops: np.ndarray, window: int, slack: int) -> np.ndarray:
    """Rows of up to three bin numbers (-1: none) whose tops fill the window within ``slack``."""
    found = [(len(tops) - 1, -1, -1)]
    for a in range(len(tops) - 1):
        left = window - tops[a]
        for b in range(a + 1):
            rest = left - tops[b]
            if rest < 0:
                break
            if rest <= slack:
                found.append((a, b, -1))
            c = int(np.searchsorted(tops, rest, side="right")) - 1
            if 0 <= c <= b and rest - tops[c] <= slack:
                found.append((a, b, c))
    return np.array(found)


def solve(columns: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients.

    ``columns``: bin numbers of each combination; the matrix is never built.
    """
    n, size = len(columns), len(counts)
    valid = columns >= 0
    at = np.where(valid, columns, size)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(at.ravel(), np.repeat(x, columns.shape[1]), size + 1)[:size]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(r, 0.0)[at].sum(axis=1)

    scale = max(counts.max(), 1)
    goal = counts / scale
    # The largest eigenvalue of the normal matrix, by power iteration.
    v = np.ones(n)
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate = 1.0 / (np.linalg.norm(back(forward(v))) * 1.05)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - rate * back(forward(y) - goal), 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(counts: np.ndarray, settings: Settings) -> list[tuple[list[int], int]]:
    """Patterns (bin numbers, longest first) and how many windows repeat each."""
    tops, left = bins(settings), counts.astype(np.int64).copy()
    patterns: list[tuple[list[int], int]] = [([len(tops) - 1], int(left[-1]))] if left[-1] else []
    left[-1] = 0
    if left.any():
        columns = combinations(tops, settings.window, settings.step - 1)
        columns = columns[(np.append(left, 1)[columns] > 0).all(axis=1)]
        if len(columns):
            times = solve(columns, left.astype(float), settings.rounds)
            for k in np.argsort(-times, kind="stable"):
                if times[k] < 0.5:
                    break
                used, many = np.unique(columns[k][columns[k] >= 0], return_counts=True)
                n = int(min(round(float(times[k])), (left[used] // many).min()))
                if n > 0:
                    left[used] -= n * many
                    patterns.append((sorted(columns[k][columns[k] >= 0].tolist(), reverse=True), n))
    # Residuals: each pattern empties at least one bin, so there are few.
    while left.any():
        room, pattern, free = settings.window, [], left.copy()
        while True:
            fits = np.flatnonzero((free > 0) & (tops <= room))
            if not len(fits):
                break
            b = int(fits[-1])
            many = int(min(free[b], room // tops[b]))
            pattern += [b] * many
            free[b] -= many
            room -= many * int(tops[b])
        used, many = np.unique(pattern, return_counts=True)
        n = int((left[used] // many).min())
        left[used] -= n * many
        patterns.append((pattern, n))
    return patterns


def pieces(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` of every piece."""
    window, end = settings.window, np.array([settings.end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = words(tokenizer)
        for batch in batches:
            rows = []
            for place, text in enumerate(batch["text"]):
                ids = vocabulary.tokens(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start:4 * (start + window)]
                    rows.append((place, start, len(part) // 4, zlib.crc32(part), total))
            out = pd.DataFrame(rows, columns=["place", "start", "length", "ids_crc32", "doc_tokens"])
            out.insert(0, "doc_id", batch["doc_id"].take(out.pop("place")).to_numpy())
            yield out

    texts = id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: which window holds them, and where."""
    spark = setup(docs.sparkSession)
    tops = bins(settings)
    number = F.when(F.col("length") < settings.fine, F.col("length") - 1).otherwise(
        settings.fine - 1 + F.ceil((F.col("length") - settings.fine) / settings.step)
    ).cast("int")
    found = durable(pieces(docs, tokenizer, settings).withColumn("bin", number))
    counts = np.zeros(len(tops), dtype=np.int64)
    for row in found.groupBy("bin").agg(F.count("*").alias("n")).collect():  # a row for each bin
        counts[row["bin"]] = row["n"]
    patterns = plan(counts, settings)
    # Of each bin: the ranks at which a pattern's slot begins, the first window and the slot.
    begins: list[list[int]] = [[] for _ in tops]
    firsts: list[list[int]] = [[] for _ in tops]
    slots: list[list[int]] = [[] for _ in tops]
    used, window = np.zeros(len(tops), dtype=np.int64), 0
    for pattern, times in patterns:
        for slot, b in enumerate(pattern):
            begins[b].append(int(used[b]))
            firsts[b].append(window)
            slots[b].append(slot)
            used[b] += times
        window += times
    shared = spark.sparkContext.broadcast([
        (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(c, dtype=np.int64))
        for a, b, c in zip(begins, firsts, slots, strict=True)
    ])  # as many numbers as the patterns have slots, whatever the corpus
    # Slices of each bin by a hash, so that a bin of many pieces is ranked in many tasks.
    parts = [max(1, int(-(-n // settings.slice_rows))) for n in counts]
    sliced = found.withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(F.array(*map(F.lit, parts)), F.col("bin") + 1))
    ).withColumn("one", F.lit(1))
    ranked = running(sliced, "bin", "slice", ["doc_id", "start", "ids_crc32", "doc_tokens"], "one", "rank").drop("slice", "one")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = shared.value
        for batch in batches:
            sequence = np.zeros(len(batch), dtype=np.int64)
            slot = np.zeros(len(batch), dtype=np.int64)
            bin_of, rank = batch["bin"].to_numpy(), batch["rank"].to_numpy()
            for b in np.unique(bin_of):
                own = bin_of == b
                begin, first, number = where[b]
                at = np.searchsorted(begin, rank[own], side="right") - 1
                sequence[own] = first[at] + rank[own] - begin[at]
                slot[own] = number[at]
            yield batch.drop(columns=["bin", "rank"]).assign(sequence_id=sequence, slot=slot)

    kind = found.schema["doc_id"].dataType.simpleString()
    placed = ranked.select(*[c for c in found.columns if c != "bin"], "bin", "rank").mapInPandas(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    )
    # A window holds at most as many pieces as tokens.
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def fill(docs: DataFrame, packed: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """``sequence_id``, ``ids`` (padded with zeros to the window) and ``length`` from the packed pieces.

    Texts are read and tokenized again, so the plan never moves them. Ids must be unique.
    """
    setup(docs.sparkSession)
    window, end = settings.window, settings.end_id
    kind = "sequence_id long, offset long, ids array<int>"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = words(tokenizer)
        for batch in batches:
            rows = []
            for text, plan_ in zip(batch["text"], batch["plan"], strict=True):
                ids = np.append(np.frombuffer(vocabulary.tokens(text), dtype="<u4"), end).astype(np.int32)
                rows += [(p["sequence_id"], p["offset"], ids[p["start"]:p["start"] + p["length"]]) for p in plan_]
            yield pd.DataFrame(rows, columns=["sequence_id", "offset", "ids"])

    plans = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("plan"))
    cut_ids = id_and_text(docs).join(plans, "doc_id").select("text", "plan").mapInPandas(cut, kind)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    return cut_ids.groupBy("sequence_id").agg(joined.alias("ids")).select(
        "sequence_id", F.size("ids").alias("length"),
        F.concat("ids", F.array_repeat(F.lit(0), window - F.size("ids"))).alias("ids"),
    )
