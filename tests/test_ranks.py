import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.ranks import numbered, quantiles, rolling, running_totals
from tidemark.operators.scoring import weighted_medoid, weighted_quantiles

LEVELS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy,whole", [(10_000, 40_000), (100, 400), (200, 800)])
def test_quantiles_are_exact_whatever_is_sorted(spark, accuracy, whole):
    rng = random.Random(7)
    # a hot group with a value that half its rows share, a group of ties only, a small one, one with a null key
    data = [("hot", rng.choice([3.0, rng.gauss(0, 5)]), 0) for _ in range(6000)] + [("ties", 2.5, 0)] * 900 + [("few", float(x), 0) for x in (5, 1, 3)] + [(None, rng.random(), 0) for _ in range(1500)] + [("none", None, 0)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, v double, n int")
    got = {r["g"]: (r["n"], list(r["q"])) for r in quantiles(df.repartition(5), ["g"], "v", LEVELS, accuracy=accuracy, whole=whole).collect()}
    for g in ("hot", "ties", "few", None):
        x = np.array([v for k, v, _ in data if k == g])
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, LEVELS), atol=1e-12), g
    assert "none" not in got


def test_quantiles_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert [(r["n"], list(r["q"])) for r in quantiles(df, [], "v", [0.5, 0.25]).collect()] == [(11, [5.0, 2.5])]
    assert quantiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v", [0.5]).collect() == []
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    low, high = quantiles(nan, [], "v", [0.0, 1.0]).first()["q"]
    assert low == 1.0 and high != high


def test_running_totals_like_brute_force(spark):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.randrange(60), rng.randrange(5)) for _ in range(800)] + [("a", None, 1), ("b", 3, None)]
    got = {(r["g"], r["v"]): (r["w"], r["w_before"], r["w_all"]) for r in running_totals(spark.createDataFrame(data, "g string, v int, x int"), ["g"], "v", {"w": F.col("x")}, cells=7).collect()}
    for g in ("a", "b", None):
        here = [(v, x or 0) for k, v, x in data if k == g and v is not None]
        for v in {v for v, _ in here}:
            assert got[g, v] == (sum(x for u, x in here if u == v), sum(x for u, x in here if u < v), sum(x for _, x in here))


def test_rows_are_numbered_and_rolled_over_ranges(spark):
    rng = random.Random(9)
    data = [("hot", k // 3, k, rng.random()) for k in range(900)] + [(None, 0, k, rng.random()) for k in range(5)] + [("one", 1, 1, None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, day int, id int, x double").repartition(4)
    got = {(r["g"], r["id"]): r["no"] for r in numbered(df, ["g"], ["day", "id"], "no").collect()}
    assert got == {(g, k): (0 if g == "one" else k) for g, _, k, _ in data}
    for size in (7, 100, 100_000):
        seen = {(r["g"], r["id"]): (r["m"], r["c"]) for r in rolling(df, ["g"], ["day", "id"], 5, {"m": F.avg("x"), "c": F.count(F.lit(1))}, slice_rows=size).collect()}
        assert len(seen) == len(data)
        by = {k: x for g, _, k, x in data if g == "hot"}
        for k in range(900):
            frame = [by[i] for i in range(max(0, k - 4), k + 1)]
            assert seen["hot", k][1] == len(frame) and abs(seen["hot", k][0] - np.mean(frame)) < 1e-12
        assert seen["one", 1] == (None, 1)
    with pytest.raises(ValueError):
        rolling(df, ["g"], ["id"], 50, {}, slice_rows=10)
    assert numbered(df.limit(0), ["g"], ["day"], "no").collect() == []


def test_weighted_quantile_and_medoid_like_brute_force(spark):
    rng = random.Random(10)
    data = [("a", k, round(rng.gauss(0, 3), 1), rng.random()) for k in range(120)] + [("b", 5, 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, id int, v double, w double")
    a = [(v, w, k) for g, k, v, w in data if g == "a"]
    costs = {k: round(sum(w * abs(v - u) for u, w, _ in a), 4) for v, _, k in a}
    assert rows(weighted_medoid(df, ["g"], "id", "v", "w").select("g", "id", "centrality")) == [("a", min(costs, key=lambda k: (costs[k], k)), min(costs.values())), ("b", 5, 0.0)]
    xs = sorted({v for v, _, _ in a})
    total, seen, mid = sum(w for _, w, _ in a), 0.0, []
    for x in xs:
        here = sum(w for v, w, _ in a if v == x)
        mid.append((seen + here / 2) / total)
        seen += here
    q = {r["g"]: r for r in weighted_quantiles(df, ["g"], "v", "w", [0.0, 0.3, 0.5, 1.0]).collect()}
    assert [q["a"][c] for c in ("q00", "q30", "q50", "q100")] == pytest.approx([xs[0], np.interp(0.3, mid, xs), np.interp(0.5, mid, xs), xs[-1]]) and q["b"]["q30"] == 1.0
