"""Pairs and their numbers are the same by value of the first group column, in slices and by brute force."""

import random

from saltmarsh.operators import pairing as pr


def made(spark):
    rng = random.Random(4)
    formulas = ["Li3YCl6", "Li2.5Y1.1Cl6", "Li2Y1.3Cl6", "Li3InCl6", "Li6PS5Cl", "Li12P2S10Cl2", "Li2S"]
    rows = [
        (f"m{k:03d}", rng.choice(formulas), f"{k % 9 + 1}e-4", (k % 9 + 1) * 1e-4, rng.choice([None, "10.1/a", "10.1/b", "10.1/c"]),
         rng.choice(["x", "y"]), rng.choice([None, 25]), rng.choice(["halides", "oxides"]), rng.choice(["bulk", "total"]))
        for k in range(160)
    ]
    return spark.createDataFrame(
        rows, "id string, formula string, conductivity_text string, value double, doi string, method string, temperature_c int, family string, note string"
    )


def expected(rows):
    """(group_id, pair_id, id_a, id_b) by plain loops."""
    groups = {}
    low = lambda v: (v is not None, v)
    for r in rows:
        groups.setdefault(tuple(low(r[c]) for c in pr.GROUP_COLUMNS), []).append(r)
    found = []
    for no, key in enumerate(sorted(groups), 1):
        members = sorted(groups[key], key=lambda r: (r.vector, r.id))
        one = len({r.element_set for r in members}) == 1
        for i, a in enumerate(members):
            found += [(f"trgrp_{no:04d}", a.id, b.id) for b in (members[i + 1:i + 2] if one else members[i + 1:]) if a.formula != b.formula]
    return [(g, f"trpair_{n:06d}", a, b) for n, (g, a, b) in enumerate(found, 1)]


def test_pairs_of_both_ways(spark, request):
    rows = pr.pairing_input(made(spark))
    want = expected(rows.collect())
    assert len(want) > 30
    for way in ("by first", "sliced"):
        if way == "sliced":
            request.getfixturevalue("sliced")
        got = pr.build_pairs(rows).collect()
        assert sorted((r.group_id, r.pair_id, r.id_a, r.id_b) for r in got) == sorted(want)


def test_pairs_are_numbered_in_one_shuffle(spark):
    plan = pr.build_pairs(pr.pairing_input(made(spark)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(doi" in plan
