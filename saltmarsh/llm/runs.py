"""Periodic runs of words, by descending-LCP Kruskal over the suffixes of a text.

A run is a stretch of words with smallest period q that no neighbouring word extends and
that is at least ``min_words`` and ``min_exponent`` periods long. In each text:

1. Suffixes are put into classes by their first words, prefix doubling on word numbers;
   suffixes that stand alone drop out and the others go on until they stand alone too.
2. Neighbouring suffixes with their longest common prefix (LCP) are edges. Edges are taken
   in descending order of LCP, as Kruskal's algorithm does, and unite suffix classes by
   union-find; each class keeps its positions in order, and the smaller one is put into
   the larger one.
3. Two positions that become neighbours in a class at LCP l and stand d <= l apart start
   with d + l words of period d: the seed of a run. It is the run if the word before it
   does not go on with the period; to the right the LCP ends where the period does. A
   smaller period would have put a position between them before, so d is the smallest.

A run of length L and period q gives l = L - q, so edges below
``ceil(min_words * (min_exponent - 1) / min_exponent)`` cannot seed one, and texts in which
no window of that many words repeats (by a rolling hash, which never misses one) have no
run. Spark deals the texts; a task holds one Arrow batch of them, and a text is one row.

Words are the stretches without the characters of ``[\\x20\\x09-\\x0D]``.

Defined cases: null text counts as empty and has no run; a null id is allowed (its text is
not rewritten); rows of one id are separate; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import id_and_text, setup

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"

# Positions in one piece of an ordered set: inserting moves at most so many.
PIECE = 1024


def shortest_prefix(min_words: int, min_exponent: int) -> int:
    """Every run has two neighbouring positions whose suffixes share at least so many words."""
    return -(-min_words * (min_exponent - 1) // min_exponent)


class Positions:
    """Ordered positions in pieces."""

    __slots__ = ("pieces", "lasts", "size")

    def __init__(self, first: int):
        self.pieces, self.lasts, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def insert(self, x: int) -> tuple[int, int]:
        """Put ``x`` in and return its neighbours, -1 where there is none."""
        pieces, lasts = self.pieces, self.lasts
        at = min(bisect_left(lasts, x), len(lasts) - 1)
        piece = pieces[at]
        k = bisect_left(piece, x)
        before = piece[k - 1] if k else (lasts[at - 1] if at else -1)
        after = piece[k] if k < len(piece) else -1  # past a piece's end only in the last one
        insort(piece, x)
        lasts[at] = piece[-1]
        self.size += 1
        if len(piece) > 2 * PIECE:
            pieces[at:at + 1] = [piece[:PIECE], piece[PIECE:]]
            lasts[at:at + 1] = [piece[PIECE - 1], piece[-1]]
        return before, after


def suffix_edges(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes (a, b) that share ``least`` words or more, and their LCP."""
    n = len(codes)
    place = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while 2 * width <= least:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:n - width] = place[width:] + 1
        place = np.unique(place * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        width *= 2
    counts = np.bincount(place)
    rank = (np.cumsum(counts) - counts)[place]
    held = np.flatnonzero(counts[place] > 1)
    family = place[held]
    open_ = held
    while len(open_):
        far = open_ + width
        ahead = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        order = np.lexsort((ahead, rank[open_]))
        open_, ahead = open_[order], ahead[order]
        old = rank[open_]
        new_group = np.r_[True, old[1:] != old[:-1]]
        new_part = new_group | np.r_[True, ahead[1:] != ahead[:-1]]
        index = np.arange(len(open_))
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        part_start = np.maximum.accumulate(np.where(new_part, index, 0))
        rank[open_] = old + part_start - group_start
        alone = new_part & np.r_[new_part[1:], True]
        open_ = open_[~alone]
        width *= 2
    order = np.argsort(rank[held], kind="stable")
    sorted_, families = held[order], family[order]
    same = families[1:] == families[:-1]
    before = np.full(n, -1, dtype=np.int64)
    before[sorted_[1:][same]] = sorted_[:-1][same]
    a, b, lcp = [], [], []
    words, shared, last = codes.tolist(), 0, -1
    for i in np.flatnonzero(before >= 0).tolist():
        # The next suffix shares one word less with its own neighbour.
        shared = max(shared - 1, 0) if i == last + 1 else 0
        j = int(before[i])
        end = n - max(i, j)
        while shared < end and words[i + shared] == words[j + shared]:
            shared += 1
        last = i
        if shared >= least:
            a.append(j)
            b.append(i)
            lcp.append(shared)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(lcp, dtype=np.int64)


def runs_of(codes: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in one text, by start, then period."""
    least = shortest_prefix(min_words, min_exponent)
    if len(codes) < min_words:
        return []
    a, b, lcp = suffix_edges(codes, least)
    order = np.argsort(-lcp, kind="stable")
    words = codes.tolist()
    root: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    found = []

    def find(x: int) -> int:
        if x not in root:
            root[x] = x
            sets[x] = Positions(x)
            return x
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, shared in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist()):
        one, two = find(i), find(j)
        if sets[one].size < sets[two].size:
            one, two = two, one
        large, small = sets[one], sets.pop(two)
        root[two] = one
        own = -1  # the last position that came from the smaller set
        open_after = -1  # the larger set's position after it
        pairs = []
        for x in small:
            if open_after >= 0 and open_after < x:
                pairs.append((own, open_after))
            before, after = large.insert(x)
            if before >= 0 and before != own:
                pairs.append((before, x))
            own, open_after = x, after
        if open_after >= 0:
            pairs.append((own, open_after))
        for x, y in pairs:
            period = y - x
            if (
                shared >= (min_exponent - 1) * period and shared + period >= min_words
                and (x == 0 or words[x - 1] != words[y - 1])
            ):
                found.append((x, shared + period, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def repeats_somewhere(codes: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the texts in which some window of words may stand twice.

    ``text`` is the text of each word. Equal windows have equal hashes, so none is missed.
    """
    n = len(codes)
    if n <= window:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        single = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        single ^= single >> np.uint64(29)
        base = np.uint64(0xBF58476D1CE4E5B9)
        total = np.zeros(n - window + 1, dtype=np.uint64)
        for k in range(window):
            total = total * base + single[k:n - window + 1 + k]
        inside = np.flatnonzero(text[:n - window + 1] == text[window - 1:])
        own = text[inside]
        key = total[inside] ^ ((own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    return np.unique(own[1:][(key[1:] == key[:-1]) & (own[1:] == own[:-1])])


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that stand in a run after its first period, joined by one space."""
    if runs:
        step = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()
        words = [words[k] for k in kept]
    return b" ".join(words).decode()


def find(
    docs: DataFrame, min_words: int = 24, min_exponent: int = 3,
    rewrite: Callable[[int, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text of every row.

    ``rewrite(doc_id, n)`` may name the word that stands at each of the n places, before
    runs are looked for; None leaves the text as it is.
    """
    setup(docs.sparkSession)
    window = shortest_prefix(min_words, min_exponent)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = text.encode().split()
                places = rewrite(int(doc_id), len(words)) if rewrite and doc_id is not None else None
                texts.append(words if places is None else [words[k] for k in places.tolist()])
            sizes = np.array([len(words) for words in texts], dtype=np.int64)
            flat = np.empty(int(sizes.sum()), dtype=object)
            flat[:] = [word for words in texts for word in words]
            codes = pd.factorize(flat)[0].astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k in repeats_somewhere(codes, np.repeat(np.arange(len(texts)), sizes), window).tolist():
                runs[k] = runs_of(codes[starts[k]:starts[k] + sizes[k]], min_words, min_exponent)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_words": sizes,
                "runs": [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs],
                "collapsed": [collapse(words, own) for words, own in zip(texts, runs)],
            })

    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType
    # Ids go to Python as text: a column of numbers and nulls would become one of doubles.
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        work, f"doc_id string, n_words long, runs {RUN_TYPE}, collapsed string"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The original word at each place of a text that is made periodic from some word on.

    With h the CRC-32 of the id in decimal and g = h // 10: every tenth text repeats, from
    word g % n on, a stretch that fits at least 3 + g % 8 times.
    """
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % period
    return places


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run with the greatest exponent, and two digests.

    Of equal exponents the run that starts first is taken, then the shorter period.
    """
    def cross(a, b):
        return a["length"] * b["period"], b["length"] * a["period"]

    def rank(a, b):
        left, right = cross(a, b)
        return (
            F.when(left > right, -1).when(left < right, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.get(F.array_sort("runs", rank), F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
