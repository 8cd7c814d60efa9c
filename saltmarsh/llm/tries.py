"""Prefix trie of conversations, in balanced parentheses per shard.

Every turn is named by a digest of its role and text, so a conversation is a short path of
names. Equal paths are counted first; the distinct paths are range-partitioned in order and
each partition, a shard, is encoded by itself:

* Depth-first order writes ``(`` where a node opens and ``)`` where it closes. Minima of the
  excess (open minus closed) over blocks, and over pairs of blocks up to one, give findclose,
  and with it the subtree of a node.
* The rank of ``()`` pairs between a node's parentheses counts its leaves. Sums over nodes in
  opening order, taken at both ends of a subtree, give members and savings.
* A path that leaves a shard on the left or right shares its first nodes with the next shard:
  the spine. A spine node belongs to the leftmost shard it stands in, which alone counts its
  own words and it as a child; all other figures add up, so spines merge by one aggregate.

A shard takes about ``shard_turns`` turns of distinct paths, whatever the input; copies of a
path are counted in pieces of at most 4,096 neighbouring ids before their list is hashed. The
list of one node is one SHA-256, which is sequential: a task streams its pieces.

Defined cases: rows without conv_id belong to no conversation and are not read; null role or
text counts as empty; turns stand in order of ``turn``, null first, equal turns in order of
their digest; repeated rows are repeated turns; an empty table has no nodes, not even a root;
further columns are not read. The names of one conversation must fit into a row.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from saltmarsh.llm.common import WORD, hand_over, setup
from saltmarsh.session import durable

NAME = 32  # characters of a turn's name
PIECE = 4096
BLOCK = 64
FIGURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODE_TYPE = (
    "key string, parent_key string, conv_id long, parent_conv_id long, depth long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)


class Parentheses:
    """Balanced parentheses with block minima of the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[:len(bits)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        self.minima = [self.blocks.min(axis=1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            if len(low) % 2:
                low = self.minima[-1] = np.append(low, np.iinfo(np.int32).max)
            self.minima.append(np.minimum(low[::2], low[1::2]))

    def _first_in_block(self, block: np.ndarray, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First place in the block from ``start`` on where the excess falls to ``goal``, else -1."""
        out = np.full(len(block), -1, dtype=np.int64)
        columns = np.arange(BLOCK)
        for k in range(0, len(block), 8192):
            part = slice(k, k + 8192)
            hit = (self.blocks[block[part]] <= goal[part, None]) & (columns >= start[part, None])
            first = hit.argmax(axis=1)
            out[part] = np.where(hit[np.arange(len(first)), first], block[part] * BLOCK + first, -1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        goal = self.excess[opens] - 1
        block = opens // BLOCK
        out = self._first_in_block(block, opens % BLOCK + 1, goal)
        open_ = np.flatnonzero(out < 0)
        node, goal = block[open_], goal[open_]
        found = np.full(len(open_), -1)
        for level, low in enumerate(self.minima[:-1]):
            # Climb until the right neighbour of the way up holds the goal.
            right = np.minimum(node + 1, len(low) - 1)
            hit = (found < 0) & (node % 2 == 0) & (low[right] <= goal)
            node = np.where(hit, right, np.where(found < 0, node // 2, node))
            found = np.where(hit, level, found)
        for level in range(len(self.minima) - 1, 0, -1):
            down = np.flatnonzero(found >= level)
            left = node[down] * 2
            node[down] = left + (self.minima[level - 1][left] > goal[down])
        out[open_] = self._first_in_block(node, np.zeros(len(node), dtype=np.int64), goal)
        return out


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of ``values[low:high]`` for each range, by ranges of doubling length."""
    out = np.empty(len(low), dtype=values.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    table, k = values, 0
    while True:
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        k += 1
        if 1 << k > len(values):
            return out
        table = np.minimum(table[:-(1 << (k - 1))], table[1 << (k - 1):])


def common_prefixes(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many names each path shares with the one before it (0 for the first)."""
    starts = np.cumsum(sizes) - sizes
    shared = np.zeros(len(sizes), dtype=np.int64)
    both = np.minimum(sizes[1:], sizes[:-1])
    own = np.flatnonzero(both > 0)
    if len(own):
        m = both[own]
        begin = np.cumsum(m) - m
        offset = np.arange(int(m.sum())) - np.repeat(begin, m)
        same = names[np.repeat(starts[own + 1], m) + offset] == names[np.repeat(starts[own], m) + offset]
        shared[own + 1] = np.minimum.reduceat(np.where(same, np.repeat(m, m), offset), begin)
    return shared


def prefix_keys(path: str, depth: int) -> list[str]:
    """A key for each prefix of the path, from no turn to ``depth`` turns."""
    state = hashlib.sha256()
    keys = [state.hexdigest()]
    for d in range(depth):
        state.update(path[d * NAME:(d + 1) * NAME].encode())
        keys.append(state.hexdigest())
    return keys


def shard_nodes(shard: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard: paths in order, with their members and the prefixes its neighbours share."""
    shard = shard.sort_values("path")
    paths = shard["path"].tolist()
    left, right = int(shard["left_shared"].iloc[0]), int(shard["right_shared"].iloc[0])
    sizes = np.array([len(p) // NAME for p in paths], dtype=np.int64)
    names = np.frombuffer("".join(paths).encode(), dtype=f"S{NAME}")
    counted = ",".join(w for w in shard["words"] if w)
    words = np.array(counted.split(",") if counted else [], dtype=np.int64)
    shared = common_prefixes(names, sizes)

    # Nodes in opening order: each path opens those that the path before it does not have.
    fresh = sizes - shared
    fresh[0] += 1  # the root
    n = int(fresh.sum())
    first = np.cumsum(fresh) - fresh
    last = first + fresh - 1  # where a path ends
    path_of = np.repeat(np.arange(len(paths)), fresh)
    depth = np.arange(n) - np.repeat(first, fresh) + np.repeat(np.where(np.arange(len(paths)) == 0, 0, shared + 1), fresh)
    starts = np.cumsum(sizes) - sizes
    own_words = np.zeros(n, dtype=np.int64)
    deep = np.flatnonzero(depth > 0)
    own_words[deep] = words[starts[path_of[deep]] + depth[deep] - 1]

    closes = np.append(np.r_[0, sizes[:-1] - shared[1:]], sizes[-1] + 1)
    counts = np.empty(2 * len(paths) + 1, dtype=np.int64)
    counts[0::2], counts[1::2] = closes, fresh
    code = Parentheses(np.repeat(np.arange(len(counts)) % 2 == 1, counts))
    opens = np.flatnonzero(code.bits)
    ends = code.findclose(opens)
    after = np.arange(n) + (ends - opens + 1) // 2  # the first node behind the subtree

    pairs = np.zeros(len(code.bits) + 1, dtype=np.int64)
    leaf = code.bits[:-1] & ~code.bits[1:]
    if right == sizes[-1]:
        leaf[opens[last[-1]]] = False  # goes on in the next shard
    pairs[1:len(leaf) + 1] = np.cumsum(leaf)
    pairs[len(leaf) + 1:] = pairs[len(leaf)]
    n_leaves = pairs[ends] - pairs[opens]

    behind = np.searchsorted(last, after)
    members = np.append(0, np.cumsum(shard["n"].to_numpy(np.int64)))
    n_convs = members[behind] - members[path_of]
    conv_id = range_minima(shard["least"].to_numpy(np.int64), path_of, behind)
    owned = np.ones(n, dtype=bool)
    owned[:left + 1] = False
    saving = np.append(0, np.cumsum((n_convs - owned) * own_words))
    saved = saving[after] - saving[np.arange(n)]

    # The parent of a path's first new node: the last node before it one level up.
    parent = np.arange(n) - 1
    order = np.lexsort((np.arange(n), depth))
    levels = depth[order] * n + order
    turn = first[1:]
    parent[turn] = levels[np.searchsorted(levels, (depth[turn] - 1) * n + turn) - 1] % n
    n_children = np.bincount(parent[1:][owned[1:]], minlength=n)

    key = np.full(n, None, dtype=object)
    key[:left + 1] = prefix_keys(paths[0], left)[:left + 1] if left >= 0 else []
    if right >= 0:
        at_end = opens[last[-1]]
        spine = np.flatnonzero((opens <= at_end) & (ends > at_end))[:right + 1]
        key[spine] = prefix_keys(paths[-1], right)
    parent_conv = conv_id[parent].astype(object)
    parent_conv[0] = None
    parent_key = key[parent]
    parent_key[0] = None
    ends_here = np.full(n, None, dtype=object)
    ends_here[last] = shard["ends"].to_numpy()
    return pd.DataFrame({
        "key": key, "parent_key": parent_key, "conv_id": conv_id,
        "parent_conv_id": pd.array(parent_conv, dtype="Int64"), "depth": depth,
        "n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "saved_tokens": saved, "ends": ends_here,
    })


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``names`` and ``words`` of its turns in order, one row per conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, NAME).alias("name"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.col("t.name").alias("names"), F.col("t.words").alias("words")
    )


def with_shared_heads(found: DataFrame, leader: Column, shared: Column, most: int) -> DataFrame:
    """Each conversation with its first ``shared`` turns (``most`` or fewer) taken from conversation ``leader``."""
    found = durable(found)
    heads = found.select(
        F.col("conv_id").alias("leader"), F.slice("names", 1, most).alias("head_names"), F.slice("words", 1, most).alias("head_words")
    )

    def rebuilt(own: str, head: str) -> Column:
        return F.concat(
            F.slice(F.coalesce(F.col(head), F.array().cast(found.schema[own].dataType)), F.lit(1), F.col("shared")),
            F.slice(F.col(own), F.col("shared") + 1, F.greatest(F.size(own), F.lit(1))),
        ).alias(own)

    return (
        found.withColumn("leader", leader).withColumn("shared", shared.cast("int")).join(heads, "leader", "left")
        .select("conv_id", rebuilt("names", "head_names"), rebuilt("words", "head_words"))
    )


def distinct_paths(found: DataFrame) -> DataFrame:
    """``path``, ``words``, number of members ``n``, ``least`` member and ``ends``, the digest of the member list."""
    rows = found.select(
        "conv_id", F.array_join("names", "").alias("path"), F.array_join(F.col("words").cast("array<string>"), ",").alias("words")
    ).withColumn("seq", F.sha2("path", 256))
    pieces = (
        rows.groupBy("seq", F.floor(F.col("conv_id") / F.lit(PIECE)).alias("piece"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.any_value("path").alias("path"), F.any_value("words").alias("words"))
        .select(
            "seq", "piece", "path", "words", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"),
            F.array_join(F.col("ids").cast("array<string>"), ",").alias("list"),
        )
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def close() -> tuple:
            return (*current[1:3], current[3], current[4], state.hexdigest())

        for batch in batches:
            done = []
            for seq, path, words, n, least, members in batch[["seq", "path", "words", "n", "least", "list"]].itertuples(index=False):
                if current and current[0] == seq:
                    current[3] += n
                    state.update(b",")
                else:
                    if current:
                        done.append(close())
                    current, state = [seq, path, words, n, least], hashlib.sha256()
                state.update(members.encode())
            yield pd.DataFrame(done, columns=["path", "words", "n", "least", "ends"])
        if current:
            yield pd.DataFrame([close()], columns=["path", "words", "n", "least", "ends"])

    return (
        pieces.repartition("seq").sortWithinPartitions("seq", "piece")
        .mapInPandas(work, "path string, words string, n long, least long, ends string")
    )


@F.pandas_udf(LongType())
def shared_names(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many names two paths share; -1 where there is no other path."""
    return pd.Series([
        -1 if x is None or y is None else len(os.path.commonprefix([x, y])) // NAME for x, y in zip(a, b)
    ], dtype="int64")


def nodes(found: DataFrame, shard_turns: int = 500_000) -> DataFrame:
    """One row per trie node of conversations (``conv_id``, ``names``, ``words``)."""
    spark = found.sparkSession
    distinct = durable(distinct_paths(found))
    turns = distinct.agg(F.sum(F.length("path") / NAME + 1)).first()[0] or 0
    shards = max(1, -(-int(turns) // shard_turns))
    ordered = durable(distinct.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()))
    in_order = Window.orderBy("shard")  # one row per shard
    edges = (
        ordered.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
        .withColumns({"before": F.lag("last").over(in_order), "behind": F.lead("first").over(in_order)})
        .select(
            "shard", shared_names("before", "first").alias("left_shared"), shared_names("last", "behind").alias("right_shared"),
        )
    )
    local = durable(ordered.join(edges, "shard").groupBy("shard").applyInPandas(shard_nodes, NODE_TYPE))
    spine = durable(
        local.where("key IS NOT NULL").groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
            F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in FIGURES), F.max("ends").alias("ends"),
        ).select(*local.columns)
    )
    whole = local.where("key IS NULL").unionByName(spine)
    above = spine.select(F.col("key").alias("above"), F.col("conv_id").alias("above_conv"))
    under = hand_over(whole.where("parent_key IS NOT NULL"), above, "parent_key", "above").withColumn("parent_conv_id", F.col("above_conv"))
    columns = [
        "conv_id", "depth", "parent_conv_id", *FIGURES, F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    ]
    return whole.where("parent_key IS NULL").select(*columns).unionByName(under.select(*columns))


def trie(
    conversations: DataFrame, leader: Column | None = None, shared: Column | None = None, most_shared: int = 0,
    shard_turns: int = 500_000,
) -> DataFrame:
    """The prefix trie of a table of turns (conv_id, turn, role, text), one row per node.

    With ``leader`` and ``shared``, columns over ``conv_id``, each conversation first takes
    its first ``shared`` turns from conversation ``leader``.
    """
    setup(conversations.sparkSession)
    found = paths(conversations)
    if leader is not None:
        found = with_shared_heads(found, leader, shared, most_shared)
    return nodes(found, shard_turns)
