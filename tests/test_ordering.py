"""Sliced and windowed paths give the same rows, also for one hot group."""

import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import ordering as o
from saltmarsh.operators import windows as wn


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        data.append((i, group, rng.randrange(200), rng.choice([None, None, "x", "y", "z"])))
    return spark.createDataFrame(data, "id bigint, g string, v bigint, label string")


def collect(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def order():
    return [F.col("v"), F.col("id")]


CASES = {
    "running_sum": lambda df: o.running_sum(df, ["g"], order(), F.col("v"), "out"),
    "row_rank": lambda df: o.row_rank(df, ["g"], [F.desc("v"), F.col("id")], "out"),
    "global_rank": lambda df: o.row_rank(df, [], order(), "out"),
    "next_row": lambda df: o.next_row(df, ["g"], order(), ["id", "v"], "out"),
    "last_known": lambda df: o.last_known(df, ["g"], order(), F.col("label"), "out"),
    "running_min": lambda df: o.running_extreme(df, ["g"], order(), F.col("id"), "out", best="min"),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_sliced_equals_window(spark, rows, case, request):
    plain = collect(CASES[case](rows), "id", "out")
    request.getfixturevalue("sliced")
    assert collect(CASES[case](rows), "id", "out") == plain
    assert len(plain) == 3000


def test_hash_rank_matches_window(spark, rows):
    keyed = rows.withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = {r["id"]: r["rank"] for r in o.hash_rank(keyed, ["g"], "h", "rank", tie="id").collect()}
    by_group = {}
    for r in keyed.collect():
        by_group.setdefault(r["g"], []).append((r["h"], r["id"]))
    want = {i: n for members in by_group.values() for n, (_, i) in enumerate(sorted(members), 1)}
    assert got == want


def test_exact_quantiles(spark, rows, request):
    import numpy as np

    points = {"q1": 0.25, "q2": 0.5, "q9": 0.93}
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r["g"], []).append(r["v"])
    for path in ("window", "sliced"):
        if path == "sliced":
            request.getfixturevalue("sliced")
        for r in o.exact_quantiles(rows, ["g"], "v", points).collect():
            want = np.quantile(by_group[r["g"]], list(points.values()))
            assert [r[n] for n in points] == pytest.approx(list(want))


def test_member_lists_are_bounded_and_whole(spark, rows):
    lists = o.member_lists(rows, ["g"], [F.col("id")], {"ids": F.col("id").cast("string")}, 100).collect()
    assert max(len(r["ids"].split("|")) for r in lists) == 100
    hot = [r["ids"] for r in sorted(lists, key=lambda r: r["list_no"]) if r["g"] == "hot"]
    ids = [int(i) for text in hot for i in text.split("|")]
    assert ids == sorted(r["id"] for r in rows.collect() if r["g"] == "hot")


def test_keep_first(spark, rows):
    best = {r["g"]: r["id"] for r in o.keep_first(rows, ["g"], [-F.col("v"), F.col("id")]).collect()}
    want = {}
    for r in rows.collect():
        key = (-r["v"], r["id"])
        want[r["g"]] = min(want.get(r["g"], key), key)
    assert best == {g: k[1] for g, k in want.items()}


def test_segments(spark, request):
    lines = ["lost\t1", "group1", "a\t1.5 x 10-3", "e1\tb\t2", "group1", "c\tbad", "d\t0.5 # note"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "f int, n int, text string")
    want = [("a", 1.5e-3, 1), ("b", 2.0, 1), ("d", 0.5, 2)]
    for path in ("window", "sliced"):
        if path == "sliced":
            request.getfixturevalue("sliced")
        out = wn.read_segments(df, ["f"], [F.col("n")]).orderBy("n").collect()
        assert [(r["row_formula"], r["row_value"], r["segment_no"]) for r in out] == want
