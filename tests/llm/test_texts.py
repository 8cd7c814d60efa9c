"""Exact and near duplicates and repeated windows, against brute force."""

import hashlib
import re

import pytest

from saltmarsh.llm import exact, near, repeats
from saltmarsh.llm.near import Classes, Sets, similarity


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_classes(awkward, bits):
    rows = awkward.select("doc_id", "text").collect()
    found = exact.classes(awkward, hash_bits=bits, shortest=8, longest=64).collect()
    assert len(found) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(plain(r.text), []).append(r)
    for text, own in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        best = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        got = [f for f in found if f.text_sha256 == sha]
        assert len(got) == len(own) and {f.group_size for f in got} == {len(own)}
        assert {f.keep_id for f in got} == {best.doc_id}
        assert sum(f.kept for f in got) == 1


def test_exact_keeps_all_columns(awkward, no_docs):
    kept = exact.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({plain(r.text) for r in awkward.collect()})
    assert exact.keep_one(no_docs).count() == 0 and exact.classes(no_docs).count() == 0


def brute_classes(texts, least=0.8):
    have, same = Sets(texts, 120), Classes()
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or similarity(have.sets[i], have.sets[j]) >= least:
                same.join(i, j)
    return [same.find(i) for i in range(len(texts))]


def near_texts(prose):
    texts = []
    for family in range(12):
        base = prose(100 + family, 150 + 20 * family).split()
        for k in range(12):
            words = list(base)
            for j in range(k):
                words[(37 * j + 11 * k + family) % len(words)] = f"edit{family}x{k}x{j}"
            texts.append(" ".join(words))
    return texts + [prose(900 + k, 60) for k in range(30)] + texts[:5] + ["one two", "one two", ""]


@pytest.mark.parametrize("block", [1000, 4])
def test_near_classes(spark, prose, block):
    texts = near_texts(prose)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts)
    got = {r.doc_id: r for r in near.classes(docs, near.Settings(block_texts=block)).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    assert sum(r.kept for r in got.values()) == len(set(want))


def test_probability_jaccard():
    import numpy as np

    x = (np.array([1, 2, 3], dtype=np.uint64), np.array([1.0, 2.0, 1.0]))
    y = (np.array([2, 3, 4], dtype=np.uint64), np.array([1.0, 3.0, 1.0]))
    a, b = dict(zip(x[0].tolist(), x[1].tolist())), dict(zip(y[0].tolist(), y[1].tolist()))
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a | b) for d in a.keys() & b.keys())
    assert similarity(x, y) == pytest.approx(want)


def test_near_awkward(awkward, no_docs):
    rows = near.classes(awkward).collect()
    assert len(rows) == awkward.count()
    by_class = {}
    for r in rows:
        by_class.setdefault((r.class_id, r.class_size), []).append(r)
    assert all(r.class_id == 1 for r in rows if r.doc_id in (1, 2, 3, 15))
    kept = near.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in rows)
    assert near.classes(no_docs).count() == 0 and near.keep_one(no_docs).count() == 0


def brute_repeats(rows, window=50):
    last = (1 << 63) - 1
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        i = last if i is None else i
        for k in range(len(b) - window + 1):
            w = b[k:k + window]
            least[w] = min(least.get(w, last), i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), last if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if least[b[k:k + window]] < own:
                gone[k:k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        sha = hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()
        out.append((i, len(b), sum(gone), spans, sha))
    return sorted(out, key=str)


def repeat_rows(prose):
    passage, line = prose(7, 60), "license line that stands in very many of the documents, word for word"
    rows = []
    for k in range(60):
        rows.append((k, f"{prose(200 + k, 30)} {passage if k % 3 == 0 else ''} {prose(300 + k, 20)} {line}"))
    return rows + [(60, rows[3][1]), (61, rows[3][1][:-1]), (2, prose(202, 25)), (None, passage), (None, passage + "x"), (63, "a" * 300), (64, "a" * 120)]


@pytest.mark.parametrize("settings", [
    repeats.Settings(), repeats.Settings(heavy=3, group_runs=3, bucket_bytes=2000, flush=500), repeats.Settings(heavy=10**9, group_runs=2),
])
def test_repeats(spark, prose, settings):
    rows = repeat_rows(prose)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.dedup(docs, settings)
    found = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()], key=str)
    assert found == brute_repeats(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got.collect())


def test_repeats_awkward(awkward, no_docs, monkeypatch):
    from saltmarsh.llm import anchors

    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = repeats.dedup(awkward).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], key=str) == brute_repeats(rows)
    assert repeats.dedup(no_docs).count() == 0
    # A text longer than a part is cut into overlapping parts.
    monkeypatch.setattr(anchors, "SLICE_BYTES", 100)
    data = bytes(range(32, 127)) * 10
    parts = list(anchors.parts([data, b"y" * 60, b"z" * 60], 50))
    seen = {first[0] + k for number, first, part in parts if number == [0] for k in range(len(part) - 49)}
    assert seen == set(range(len(data) - 49))
