"""Mixing, packing, the pipeline and the optional import."""

import re
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from saltmarsh.llm import mixing, packing, queries
from saltmarsh.llm.tokens import words

BPE = public_tokenizers.path("byte_bpe_50k.json")


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Water-filling by turns: sources above three times their size are full, the rest share again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(full.values()), [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3 * sizes[s] for s in above}


def test_mixing(spark, prose):
    rows = [(k, prose(k, 20 + 7 * (k % 13)), f"s{min(k % 11, 6)}" if k % 10 else None) for k in range(400)] + [(400, prose(5, 3), "tiny"), (401, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, mixing.Settings(slice_rows=10)).collect()
    again = mixing.mix(docs.repartition(5), mixing.Settings(slice_rows=10)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(dict(sizes))
    taken = defaultdict(int)
    for r in found:
        assert r.size == size(rows[r.doc_id][1]) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    kept = mixing.repeat(docs, mixing.Settings(slice_rows=10))
    copies = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.copies for r in found if r.copies} and kept.columns == docs.columns


def test_inclusion_odds_differ_inside_a_source(spark):
    """Taken shares by size are those of p / (1 - p) = c * sqrt(size), with c from the words that are left."""
    lengths = (4, 16, 64, 256)
    rows = [(k, " ".join(["w"] * lengths[k % 4]), "b" if k < 8000 else "a") for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [r for r in mixing.mix(docs, mixing.Settings(weights=(1.0, 2.0))).collect() if r.source == "b"]
    whole = int(found[0].target // found[0].source_size)
    need = found[0].target - whole * found[0].source_size
    low, high = 0.0, 1e6
    while high - low > 1e-9 * high:
        c = (low + high) / 2
        p = {n: c * n**0.5 / (1 + c * n**0.5) for n in lengths}
        low, high = (c, high) if sum(2000 * n * p[n] for n in lengths) < need else (low, c)
    shares = {n: np.mean([r.copies - whole for r in found if r.size == n]) for n in lengths}
    assert 0.05 < p[4] < 0.9 and p[256] > p[4] + 0.2
    assert all(abs(shares[n] - p[n]) < 0.05 for n in lengths), (shares, p)
    tilted = mixing.mix(docs.withColumn("likes", docs.doc_id % 2 * 20.0 + 0.1), mixing.Settings(weights=(1.0, 2.0)), "likes").collect()
    odd = [np.mean([r.copies for r in tilted if r.source == "b" and r.doc_id % 2 == k]) for k in (0, 1)]
    assert odd[1] > odd[0] + 0.3


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04d}": (k * 7919) % 400 + (10_000 if k % 97 == 0 else 0) for k in range(1500)} | {None: 77}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = targets(sizes)
    found = {r.source: r.target for r in mixing.targets(frame, mixing.Settings()).collect()}
    assert found.keys() == want.keys() and all(found[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9) for s in want)


def test_mixing_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    for name in ("op4_exact_dedup", "op7_mixing"):
        frame = queries.QUERIES[name](spark, folder)
        got = sorted(map(str, (tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())))
        con.execute(queries.ORACLES[name])
        names = [d[0] for d in con.description]
        assert got == sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in con.fetchall())


def test_mixing_awkward(awkward, no_docs):
    found = mixing.mix(awkward).collect()
    assert len(found) == awkward.count() and all(r.taken == 0 for r in found if r.size == 0)
    assert mixing.repeat(awkward).columns == awkward.columns
    assert mixing.repeat(awkward).count() >= 1
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat(no_docs).count() == 0


TRICKY = [
    "", " ", "   leading and  double   spaces\n\n\ttabs\r\n", "it's we'll I'M don''t", "naïve Žluťoučký 😀👍🏽 日本語 １２３ ½²", "a\x1cb\x1f c\x85d e f",
    "x" * 30_000, " " * 20_000 + "y", "<|endoftext|> plain", "price: $12.50!!! (50%)\n- item_1", "̀combining é",
]


def test_ids_are_those_of_the_tokenizer():
    exact = Tokenizer.from_file(BPE)
    exact.encode_special_tokens = True
    fast = words(BPE)
    for text in TRICKY:
        assert np.frombuffer(fast.encode(text), dtype="<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text[:40]


def test_added_tokens_count_inside_text(spark):
    texts = [*TRICKY, "a<|endoftext|> plain", "<|endoftext|>" * 3, "x<|endoftext|", "a\x1c<|endoftext|>b", "w" * 12_000 + "<|endoftext|> z"]
    exact = Tokenizer.from_file(BPE)
    assert exact.encode("a<|endoftext|> plain", add_special_tokens=False).ids == [64, 50256, 8631]
    for text in texts:
        assert np.frombuffer(words(BPE).tokens(text), dtype="<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = packing.pack(docs, BPE)
    check_packing(packed.collect(), ids_of(docs.collect()))
    filled = {r.sequence_id: r.ids for r in packing.fill(docs, packed, BPE).collect()}
    wanted = {k: ids[0] for k, ids in ids_of(docs.collect()).items()}
    for r in packed.collect():
        assert filled[r.sequence_id][r.offset:r.offset + r.length] == wanted[r.doc_id][r.start:r.start + r.length]


def test_solver_finds_an_exact_packing():
    settings = packing.Settings()
    tops = packing.bins(settings)
    counts = np.zeros(len(tops), dtype=np.int64)
    for length, n in ((1024, 200), (512, 100), (1536, 100), (2048, 7)):
        counts[np.searchsorted(tops, length)] = n
    patterns = packing.plan(counts, settings)
    used = np.zeros(len(tops), dtype=np.int64)
    for pattern, n in patterns:
        np.add.at(used, pattern, n)
        assert tops[pattern].sum() <= 2048
    assert (used == counts).all() and sum(n for _, n in patterns) == 207


def check_packing(rows, texts, window=2048):
    """``rows``: pieces; ``texts``: multiset of (doc_id, ids)."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id, all_ids in texts.items():
        want = []
        for ids in all_ids:
            for start in range(0, len(ids), window):
                part = np.array(ids[start:start + window], dtype="<u4")
                want.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc_id]) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))


def ids_of(rows):
    exact = Tokenizer.from_file(BPE)
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(exact.encode(r.text or "", add_special_tokens=False).ids + [1])
    return out


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = packing.pack(docs, BPE, packing.Settings(slice_rows=7))
    rows = packed.collect()
    texts = ids_of(docs.collect())
    check_packing(rows, texts)
    tokens = sum(r.length for r in rows)
    assert tokens / (2048 * len({r.sequence_id for r in rows})) > 0.95
    # Filled windows hold the same ids.
    filled = {r.sequence_id: r for r in packing.fill(docs, packed, BPE).collect()}
    for r in rows:
        part = filled[r.sequence_id].ids[r.offset:r.offset + r.length]
        assert part == texts[r.doc_id][0][r.start:r.start + r.length]
    assert all(len(f.ids) == 2048 and not any(f.ids[f.length:]) for f in filled.values())


def test_packing_awkward(awkward, no_docs):
    check_packing(packing.pack(awkward, BPE).collect(), ids_of(awkward.select("doc_id", "text").collect()))
    assert packing.pack(no_docs, BPE).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from saltmarsh.llm import exact, near, toxicity
    from saltmarsh.session import durable

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    want = {
        "toxicity": lambda d: {r.doc_id for r in toxicity.classify(d, labels).where("predicted = 0").collect()},
        "exact_dedup": lambda d: {r.doc_id for r in exact.classes(d).where("kept").collect()},
        "near_dedup": lambda d: {r.doc_id for r in near.classes(d).where("kept").collect()},
        "mixing": lambda d: {r.doc_id for r in mixing.mix(d).where("copies > 0").collect()},
    }
    assert [name for name, _ in pipeline.STAGES] == [*want, "packing"]
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        kept = durable(stage(spark, docs, folder))
        assert kept.columns == columns
        assert {r.doc_id for r in kept.collect()} == want[name](docs)
        docs = kept
    check_packing(pipeline.run(spark, folder).collect(), ids_of(docs.collect()))


def test_pipeline_awkward(spark, awkward, labels, no_docs, tmp_path):
    import corpus_pipeline as pipeline

    for name, docs in (("awkward", awkward), ("none", no_docs)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "awkward")


def test_entry_without_the_folder(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "saltmarsh"):
        target = tmp_path / name
        if (root / name).is_file():
            target.write_text((root / name).read_text())
        else:
            for file in (root / name).rglob("*.py"):
                if "llm" not in file.parts:
                    out = tmp_path / file.relative_to(root)
                    out.parent.mkdir(parents=True, exist_ok=True)
                    out.write_text(file.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)
