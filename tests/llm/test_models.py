"""Toxicity, quality and neighbours: held-out accuracy, exact selection and recall."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import neighbours, quality, toxicity
from saltmarsh.llm.curves import hilbert

DOCS = "/root/testdata/sf0.01"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def area(good, bad):
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_toxicity_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{DOCS}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    known = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if held_out(r.doc_id)]
    assert area([s for s, t in known if t], [s for s, t in known if not t]) > 0.9
    kept = toxicity.keep_clean(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.score < 0.7} and kept.columns == docs.columns


def test_toxicity_awkward(spark, awkward, no_docs, labels):
    assert toxicity.classify(awkward, labels).count() == awkward.count()
    assert toxicity.keep_clean(awkward, labels).columns == awkward.columns
    assert toxicity.classify(no_docs, labels).count() == 0
    none = toxicity.classify(awkward, labels.where("false")).collect()
    assert len({r.score for r in none}) == 1


def test_quality_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{DOCS}/{t}.parquet") for t in ("documents", "labels"))
    settings = quality.Settings(share=0.3)
    rows = quality.resample(docs, labels, settings).collect()
    by_id = {r.doc_id: r for r in rows}
    known = [(by_id[r.doc_id].log_weight, r.quality) for r in labels.collect() if held_out(r.doc_id)]
    assert area([s for s, q in known if q], [s for s, q in known if not q]) > 0.9
    # Exactly the k largest keys, and the keys are weight plus a Gumbel number.
    best = sorted(rows, key=lambda r: -r.gumbel_key)[:300]
    assert {r.doc_id for r in best} == {r.doc_id for r in rows if r.kept}
    assert np.mean([r.gumbel_key - r.log_weight for r in rows]) == pytest.approx(0.5772, abs=0.15)


def test_quality_awkward(spark, awkward, no_docs, labels):
    rows = quality.resample(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r.log_weight) for r in rows)
    assert all(r.log_weight == 0 for r in rows if r.n_grams == 0)
    assert quality.resample(no_docs, labels).count() == 0
    assert {r.log_weight for r in quality.resample(awkward, labels.where("false")).collect()} == {0.0}


RATED = [
    ("you awful stupid thing go away", 1), ("stupid awful words here", 1), ("go away you awful thing", 1), ("what a stupid idea", 1),
    ("the garden is green and quiet", 0), ("a quiet walk in the garden", 0), ("green tea and a good book", 0), ("the idea of the book is good", 0),
    ("words in the book", 0), ("go for a walk here", 0),
]


def rated(spark, column):
    """Texts under ids that are training rows."""
    ids = [i for i in range(100) if not held_out(i)][:len(RATED)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, RATED)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, RATED)], f"doc_id long, {column} int")
    return docs, labels


def test_toxicity_counts_and_ratios_by_brute_force(spark):
    """The weights are ratio times coefficient, at the minimum of the penalized loss over brute-force features."""
    docs, labels = rated(spark, "toxic")
    settings = toxicity.Settings(sizes=(3, 4), bits=16, min_documents=2, min_z=0.0, iterations=500, penalty=0.05)
    model = toxicity.fit(docs, labels, settings)
    grams = []
    for text, _ in RATED:
        ids = set()
        for n in settings.sizes:
            for k in range(len(text) - n + 1):
                codes = np.array([ord(ch) for ch in text[k:k + n]], dtype=np.uint32)
                ids.add(int(toxicity.gram_ids(codes, (n,), settings.bits)[0]))
        grams.append(ids)
    y = np.array([t for _, t in RATED], dtype=float)
    seen = {g: [sum(g in ids for ids, t in zip(grams, y) if t == k) for k in (0, 1)] for g in set().union(*grams)}
    kept = {g: n for g, n in seen.items() if sum(n) >= 2}
    p = {g: n[1] + settings.smoothing for g, n in kept.items()}
    q = {g: n[0] + settings.smoothing for g, n in kept.items()}
    ratio = {g: math.log(p[g] / sum(p.values())) - math.log(q[g] / sum(q.values())) for g in kept}
    order = sorted(g for g in kept if ratio[g] != 0)
    assert set(np.flatnonzero(model.weights).tolist()) <= set(order) and len(order) > 20
    x = np.array([[ratio[g] if g in ids else 0.0 for g in order] for ids in grams])
    beta = model.weights[order] / np.array([ratio[g] for g in order])
    margin = model.intercept + x @ beta
    error = 1 / (1 + np.exp(-margin)) - y
    assert np.abs(x.T @ error / len(y) + settings.penalty * beta).max() < 2e-3 and abs(error.mean()) < 2e-3
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert sorted(found.values()) == pytest.approx(sorted(1 / (1 + np.exp(-margin))))


def test_quality_counts_and_ratios_by_brute_force(spark):
    docs, labels = rated(spark, "quality")
    settings = quality.Settings(bits=14)
    found, share = quality.fit(docs, labels, settings)

    def buckets(text):
        words = text.split()
        one = [int(next(quality.grams([w], settings.bits))[2][0]) for w in words]
        return one + [int(next(quality.grams([f"{a} {b}"], settings.bits))[2][2]) for a, b in zip(words, words[1:])]

    width = 1 << settings.bits
    raw, target = np.zeros(width), np.zeros(width)
    for text, good in RATED:
        for bucket in buckets(text):
            raw[bucket] += 1
            target[bucket] += good
    base = (raw + 1) / (raw + 1).sum()
    want = np.log((target + width * base) / (target.sum() + width)) - np.log(base)
    assert share == 0.4 and np.allclose(found, want)
    rows = {r.doc_id: r for r in quality.weigh(docs, found, settings).collect()}
    for doc_id, text in docs.collect():
        sum_, n = sum(want[b] for b in buckets(text)), len(buckets(text))
        assert rows[doc_id].n_grams == n and rows[doc_id].log_ratio == pytest.approx(sum_)
        assert rows[doc_id].log_weight == pytest.approx(sum_ * math.sqrt(256 / n))
    plain = quality.weigh(docs, found, quality.Settings(bits=14, reference=None)).collect()
    assert all(r.log_weight == r.log_ratio for r in plain)


def test_hilbert_neighbours_differ_by_one():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(hilbert(cells, 3))]
    assert len(set(hilbert(cells, 3))) == 512 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)[:k]
            out[q] = [i for _, i in scored], [-s for s, _ in scored]
    return out


def found_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r)
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16)) * 2
    vectors = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16)) * 0.5) * rng.uniform(0.5, 1.5, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_of(neighbours.nearest(table, F.col("vec_id") % 20 == 0, settings=neighbours.Settings(block_rows=64, curves=6)))
    want = brute(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q][0])) / 20 for q in want]) >= 0.9
    for q, near in got.items():
        assert [r.rank for r in near] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(np.dot(vectors[q], vectors[r.vec_id]))) for r in near)
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)


def test_neighbours_awkward(spark):
    same = [1.0, 0.0, 2.0]
    rows = [(i, same) for i in range(0, 100)] + [(i, [float(i % 7), 1.0, -1.0]) for i in range(100, 140)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [float("nan"), 1.0, 1.0]), (260, [float("inf"), 1.0, 1.0]), (280, [None, 1.0, 1.0]),
           (300, []), (320, [1.0]), (None, same), (0, same)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, node string, rank int")
    got = found_of(neighbours.nearest(table, F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert {q: [r.vec_id for r in near] for q, near in got.items()} == {q: ids for q, (ids, _) in want.items()}
    few = neighbours.nearest(table.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table.where("vec_id IN (200, 220)"), F.col("vec_id") % 20 == 0).count() == 0
