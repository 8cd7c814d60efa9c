"""Steps that move fewer rows and columns give the rows they gave."""

import random

from pyspark.sql import functions as F

from saltmarsh.operators import entity, ordering


def test_both_extremes_in_one_pass(spark, request):
    rng = random.Random(9)
    rows = [(k, rng.choice("abc"), rng.choice([None, *range(50)])) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    wanted = {"low": (F.col("v"), "min"), "high": (F.col("v"), "max")}
    for way in ("window", "sliced"):
        if way == "sliced":
            request.getfixturevalue("sliced")
        got = {r.id: (r.low, r.high) for r in ordering.running_extremes(df, ["g"], [F.col("id")], wanted).collect()}
        for k, g, _ in rows:
            seen = [v for i, h, v in rows if h == g and i <= k and v is not None]
            assert got[k] == ((min(seen), max(seen)) if seen else (None, None))


def test_losers_are_found_without_whole_rows(spark):
    rows = [("k1", f"m{i}", "v1", 25.0, 1e-4, i, "x" * 50) for i in range(4)]
    df = spark.createDataFrame(rows, "component string, id string, source string, temperature_c double, value double, source_row int, note string")
    kept, lost = entity.pick_representative(df)
    assert [r.id for r in kept.collect()] == ["m0"]
    assert sorted(r.id for r in lost.collect()) == ["m1", "m2", "m3"]
    plan = lost.select("id", "removed_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "note" not in plan.split("LogicalRDD")[0]
