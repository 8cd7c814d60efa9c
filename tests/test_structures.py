"""Interval sweep, charge frontier, components of hubs, running ids and file digests."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions.elements import candidate_states
from saltmarsh.operators import composition as cp
from saltmarsh.operators import entity, ordering, windows
from saltmarsh.sources import readers


def test_blocks_by_sweep(spark):
    rows = spark.createDataFrame([(k, f"r{k}") for k in [*range(1, 200), 150, 10**12, None]], "pos long, name string")
    blocks = spark.createDataFrame(
        [(1, 10, "a"), (11, 11, "b"), (20, 149, "c"), (151, 10**12, "d")], "start_row long, end_row long, label string"
    )
    found = entity.label_by_blocks(rows, blocks, "pos", "start_row", "end_row", ["label"]).collect()
    want = Counter()
    for r in rows.collect():
        for s, e, label in ((1, 10, "a"), (11, 11, "b"), (20, 149, "c"), (151, 10**12, "d")):
            if r.pos is not None and s <= r.pos <= e:
                want[(r.pos, r.name, label)] += 1
    assert Counter((r.pos, r.name, r.label) for r in found) == want
    bad = {r.rule: r.violation_count for r in entity.block_violations(rows, blocks, "pos", "start_row", "end_row").collect()}
    # Positions 12 to 19, both rows at 150 and the one without a position are in no block.
    assert bad == {"out of bounds": 0, "overlapping": 0, "uncovered rows": 11}
    over = blocks.unionByName(spark.createDataFrame([(5, 25, "e"), (0, 3, "f")], blocks.schema))
    bad = {r.rule: r.violation_count for r in entity.block_violations(rows, over, "pos", "start_row", "end_row").collect()}
    assert bad["out of bounds"] == 1 and bad["overlapping"] == 3


def test_one_block_over_all_rows(spark):
    rows = spark.range(1, 300_001).withColumnRenamed("id", "pos")
    block = spark.createDataFrame([(1, 300_000, "all")], "start_row long, end_row long, label string")
    found = entity.label_by_blocks(rows, block, "pos", "start_row", "end_row", ["label"])
    assert found.groupBy("label").count().collect()[0]["count"] == 300_000


def best_charges(items, states):
    """Smallest score over all combinations, by charge; the first combination wins."""
    reached = {0.0: (0.0, ())}
    for element, amount in items:
        following = {}
        for charge, (size, picked) in reached.items():
            for i, z in enumerate(states[element]):
                if len(states[element]) > 1:
                    state = (round(size + abs(z), 9), (*picked, i))
                else:
                    state = (size, picked)
                at = round(charge + amount * z, 9)
                if at not in following or state < following[at]:
                    following[at] = state
        reached = following
    return min((round(abs(charge) + 0.001 * size, 9), picked) for charge, (size, picked) in reached.items())


def test_many_open_elements(spark):
    states = candidate_states()
    open_ = sorted((e for e, z in states.items() if len(z) > 1), key=lambda e: (-len(states[e]), e))[:14]
    rng = random.Random(2)
    formulas = []
    for n in (2, 5, 12, 14):
        for _ in range(3):
            formulas.append("Li" + "".join(f"{e}{rng.randrange(1, 5)}" for e in rng.sample(open_, n)) + "O7")
    formulas += ["Li" + "".join(f"{e}{rng.randrange(1, 40) / 10}" for e in open_[:6]) + "O7"]
    found = cp.assign_oxidation(cp.compositions(spark.createDataFrame([(f,) for f in formulas], "formula string"))).collect()
    assert len(found) == len(formulas)
    for row in found:
        items = [(x["element"], x["amount"]) for x in row["assigned"]]
        charges = [x["charge"] for x in row["assigned"]]
        score, picked = best_charges(items, states)
        choice = iter(picked)
        want = [states[e][next(choice)] if len(states[e]) > 1 else states[e][0] for e, _ in items]
        assert charges == want, row["formula"]
        assert row["residual_charge"] == pytest.approx(sum(a * z for (_, a), z in zip(items, want)), abs=1e-9)


def components_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(600):04d}", f"n{rng.randrange(600):04d}") for _ in range(330)]
    edges += [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(300)] + [("x", "x")]
    found = entity.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    want = components_of([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    none = spark.createDataFrame([], "a string, b string")
    assert entity.connected_components(none, "a", "b").count() == 0


def test_hub_of_a_million_edges_is_split(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(1_000_000).select(F.lit("hub").alias("u"), F.format_string("n%07d", "id").alias("v"))
        facts = spark.createDataFrame([("hub", "a"), ("n1", "b")], "u string, m string")
        joined = ordering.spread_join(edges, facts, "u")
        parts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 1_000_000 and max(parts) < 300_000 and len(parts) == 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    linked = edges.unionByName(spark.createDataFrame([("n0000007", "z")], "u string, v string"))
    found = entity.connected_components(linked, "u", "v")
    assert found.count() == 1_000_002
    assert [tuple(r) for r in found.select("component").distinct().collect()] == [("hub",)]


def test_running_ids_have_one_plan(spark):
    def plan(n):
        df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("id"))
        out = windows.surrogate(df, [F.col("id")], "row_%05d", "name")
        assert [r.name for r in out.orderBy("id").limit(3).collect()] == ["row_00001", "row_00002", "row_00003"]
        assert out.filter(F.col("name") != F.format_string("row_%05d", F.col("id") + 1)).isEmpty()
        text = out._jdf.queryExecution().optimizedPlan().toString()
        return [line.strip(" +-:*0123456789()").split(" ")[0].split("#")[0] for line in text.splitlines()]

    assert plan(100) == plan(50_000)


def test_digest_of_large_files(spark, tmp_path):
    block = bytes(range(256)) * 4096
    want = {}
    for name, blocks in (("big.bin", 100), ("small.txt", 1)):
        state = hashlib.sha256()
        with open(tmp_path / name, "wb") as out:
            for k in range(blocks):
                out.write(block[k:])
                state.update(block[k:])
        want[name] = state.hexdigest()
    assert (tmp_path / "big.bin").stat().st_size > 100 * 1000 * 1000
    found = readers.file_fingerprint(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in found} == want


def test_ordered_list(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "z"), (2, "a")], "n int, s string")
    assert [tuple(r) for r in windows.order_by(rows, F.desc("n"), F.col("s")).collect()] == [(2, "a"), (2, "b"), (1, "z")]
