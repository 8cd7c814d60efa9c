"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from saltmarsh.llm import runs


def brute(words, least=24, exponent=3):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q):
                own = words[i:i + length]
                smallest = next(p for p in range(1, q + 1) if all(own[k] == own[k + p] for k in range(length - p)))
                if smallest == q:
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-(r[1] / r[2]), r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def some_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(1, 160))]
    if kind == 1:
        base = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        return [rng.choice("abx") for _ in range(9)] + base * rng.randrange(1, 20) + base[: rng.randrange(len(base) + 1)]
    if kind == 2:
        inner = [rng.choice("ab")] * rng.randrange(1, 30) + ["c"]
        return (inner * rng.randrange(1, 6) + ["d"]) * rng.randrange(1, 5)
    if kind == 3:
        fib, prev = ["a", "b"], ["a"]
        while len(fib) < 120:
            fib, prev = fib + prev, fib
        return fib * rng.randrange(1, 3)
    return ["a"] * rng.randrange(1, 90)


@pytest.mark.parametrize("least,exponent", [(24, 3), (4, 2), (9, 4)])
def test_runs_of_random_words(least, exponent, monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 4)
    rng = random.Random(least)
    for _ in range(250):
        words = some_words(rng)
        codes = np.array([ord(w) for w in words])
        want = brute(words, least, exponent)
        assert runs.runs_of(codes, least, exponent) == want
        if want:
            window = runs.shortest_prefix(least, exponent)
            text = np.repeat([0, 1], [1, len(codes)])
            assert runs.repeats_somewhere(np.r_[codes[:1], codes], text, window).tolist() == [1]


def rows_of(found):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted([tuple(r[n] for n in names) for r in found.collect()], key=str)


def test_runs_of_documents(spark, prose):
    rng = random.Random(3)
    rows = [(i, " ".join(some_words(rng)) if i % 2 else prose(i, rng.randrange(0, 160))) for i in range(300)]
    rows += [(7, rows[7][1]), (-31, "a\x1cb " * 40), (1, "  x" * 60), (None, "a b " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([brute_row(i, t) for i, t in rows], key=str)
    assert rows_of(runs.digest(runs.find(docs, rewrite=runs.planted))) == want
    assert any(r[1] > 1 for r in want)


def test_runs_awkward(awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 50_000]
    found = rows_of(runs.digest(runs.find(awkward, rewrite=runs.planted)))
    assert len(found) == len(rows)
    want = [brute_row(i, t) for i, t in short]
    assert all(w in found for w in want)
    assert runs.find(no_docs, rewrite=runs.planted).count() == 0


def test_very_long_run():
    # One class takes every position: pieces keep each insertion short.
    codes = np.r_[np.arange(5), np.full(60_000, 9), np.arange(5)]
    assert runs.runs_of(codes, 24, 3) == [(5, 60_000, 1)]
