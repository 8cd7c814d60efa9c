"""The conversation trie against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import tries


def name(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, name(role or "", text or ""), role or "", text or ""))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, who in members.items():
        words = len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(who) - 1) * words
    return sorted((
        min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children.get(path, 0), leaves[path], saved[path],
        hashlib.sha256(",".join(map(str, sorted(c for c in who if len(built[c]) == len(path)))).encode()).hexdigest(),
    ) for path, who in members.items()) if members else []


def rows_of(found):
    return sorted((
        r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256
    ) for r in found.collect())


def trie(df, **more):
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return tries.trie(df, F.col("conv_id") - F.col("conv_id") % 20, shared, most_shared=3, **more)


SCHEMA = "conv_id long, turn long, role string, text string"


def talks(seed, n, texts):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            rows.append((c * 3, t, "user" if t % 2 else None, rng.choice(texts) if rng.random() < 0.9 else f"only {c} {t}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [500_000, 40, 1])
def test_trie(spark, shard_turns):
    rows = talks(1, 300, ["a b", "a  b c\t", "", "żółć 😀 x"])
    rows += [(c, t, "user", f"shared {t}") for c in range(10_001, 10_040, 2) for t in range(30)]
    rows += [(20_000, t, "user", f"shared {t}") for t in range(12)] + [(20_003, None, "user", "x"), (20_003, 5, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(trie(df, shard_turns=shard_turns)) == brute(rows)
    assert rows_of(tries.trie(df, shard_turns=shard_turns)) == brute(rows, rebuild=False)


def test_trie_awkward(spark):
    long_ = "word " * 100_000
    rows = [
        (1, None, None, None), (1, None, None, None), (1, 2, "user", long_), (1, 2, "user", "tie"), (1, 2, "user", "tie"),
        (2, 1, "", ""), (2, 2, "user", long_), (None, 1, "user", "x"), (None, None, None, None), (-7, 1, "user", "x"),
        (40, 1, "user", ""), (41, 1, "ab", "c"), (42, 1, "a", "bc"), (9_000_000_000, 1, "user", "x"), (5, 1, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "p", 1, "k") for r in rows], SCHEMA + ", path string, n int, key string")
    assert rows_of(tries.trie(df)) == brute(rows, rebuild=False)
    whole = [r for r in rows if r[0] != -7]
    assert rows_of(trie(df.where("conv_id <> -7 OR conv_id IS NULL"))) == brute(whole)
    assert tries.trie(df.where("false")).count() == 0 and trie(df.where("conv_id IS NULL")).count() == 0


def test_many_copies_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(1, 20_000, 2)]
    found = tries.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    want = hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert {(r.depth, r.n_convs) for r in found} == {(0, 10_000), (1, 10_000)}
    assert [r.ends_sha256 for r in found if r.depth == 1] == [want]


def test_findclose():
    rng = np.random.default_rng(5)
    for n in (1, 5, 60, 700, 4000):
        bits, open_ = [], 0
        for left in range(2 * n, 0, -1):
            up = open_ < left and (open_ == 0 or rng.random() < (0.9 if n == 700 else 0.5))
            bits.append(up)
            open_ += 1 if up else -1
        code = tries.Parentheses(np.array(bits))
        stack, want = [], {}
        for k, up in enumerate(bits):
            if up:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.flatnonzero(code.bits)
        assert code.findclose(opens).tolist() == [want[k] for k in opens.tolist()]
        assert code.excess[-1] == 0
