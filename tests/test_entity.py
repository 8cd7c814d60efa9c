"""Components, pairs and skewed inputs against brute force."""

import random

from pyspark.sql import functions as F

from saltmarsh.operators import entity as en
from saltmarsh.operators import pairing as pr
from saltmarsh.operators import splits as sp


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for formula, tokens in rows:
        keys = [f"{formula}|{t}" for t in tokens]
        for k in keys:
            a, b = find(keys[0]), find(k)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return find


def test_components_with_long_chain_and_hot_key(spark):
    rng = random.Random(3)
    rows = [("A", [f"t{i:03d}", f"t{i + 1:03d}"]) for i in range(120)]
    rows += [("B", ["hot"]) for _ in range(500)]
    rows += [("C", sorted(rng.sample([f"x{i}" for i in range(60)], rng.choice([1, 2, 3])))) for _ in range(80)]
    find = union_find(rows)
    data = [(i, f, t) for i, (f, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, formula_key string, doi_tokens array<string>")
    got = {r["id"]: r["component"] for r in en.components(df).collect()}
    assert got == {i: find(f"{f}|{t[0]}") for i, f, t in data}


def test_pairs_all_in_blocks(spark):
    rng = random.Random(5)
    data = [(i, "hot" if i < 90 else f"g{i % 9}", rng.randrange(20)) for i in range(150)]
    df = spark.createDataFrame(data, "id int, g string, v int")
    want = sorted((g1, min((v1, a), (v2, b))[1], max((v1, a), (v2, b))[1])
                  for a, g1, v1 in data for b, g2, v2 in data if a < b and g1 == g2)
    for size in (1000, 7):
        out = pr.pairs_all(df, ["g"], ["v", "id"], ["id"], rows_per_block=size).collect()
        assert sorted((r["g"], r["id_a"], r["id_b"]) for r in out) == want


def test_group_pairing_strategy(spark):
    rows = [("a", "Li3YCl6", 1.0), ("b", "Li2.5Y1.1Cl6", 2.0), ("c", "Li2Y1.3Cl6", 3.0)]
    df = spark.createDataFrame(
        [(i, f, str(v), v, "d", "m", 25, "halides", "note bulk") for i, f, v in rows],
        "id string, formula string, conductivity_text string, value double, doi string, method string, temperature_c int, family string, note string",
    )
    adjacent = pr.build_pairs(pr.pairing_input(df)).collect()
    assert len(adjacent) == 2
    mixed = df.unionByName(df.filter("id = 'a'").withColumns({"id": F.lit("z"), "formula": F.lit("Li3InCl6")}))
    assert len(pr.build_pairs(pr.pairing_input(mixed)).collect()) == 6


def test_label_quota_uses_largest_remainders(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "label string, n bigint")
    got = {r["label"]: r["target"] for r in sp.label_quota(counts, "label", "n", F.lit(4)).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_groups_never_divided_and_labels_on_both_sides(spark):
    rng = random.Random(2)
    data = [(i, f"d{rng.randrange(40)}", rng.choice(pr.LABELS)) for i in range(600)]
    df = spark.createDataFrame(data, "id int, doi string, label string")
    groups = sp.split_groups_to_target(df, "doi", "label", pr.LABELS, 0.2)
    rows = sp.assignments(df, groups, "doi")
    assert sp.side_leakage(rows, "split", "doi", "train", "validation").count() == 0
    by_side = {r["split"]: r for r in sp.split_manifest(rows, "doi", "label", pr.LABELS).collect()}
    assert abs(by_side["validation"]["rows"] - 120) <= 20
    assert all(by_side[s][f"{v}_rows"] > 0 for s in by_side for v in pr.LABELS)
