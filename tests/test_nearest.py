import random

from conftest import rows

from tidemark.operators.nearest import nearest_in_time

L = "k string, t long, l string, bucket int, side int"
R = "k string, t long, r long, bucket int"


def run(spark, left, right, tolerance=90, bucket=200):
    df = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), key="k", time="t", left_id="l", right_id="r", tolerance_us=tolerance, bucket_us=bucket)
    return sorted(tuple(x) for x in df.select("l", "r").collect())


def test_like_brute_force_across_bucket_edges(spark):
    rng = random.Random(3)
    left = [(rng.choice("AAB"), rng.randrange(20_000), f"l{n}", 0, 0) for n in range(500)]
    right = [(rng.choice("AAB"), rng.randrange(20_000), n, 0) for n in range(300)]
    expected = []
    for k, t, i, *_ in left:
        near = [(abs(t - rt), rt, rid) for rk, rt, rid, _ in right if rk == k and abs(t - rt) <= 90]
        if near:
            expected.append((i, min(near)[2]))
    assert run(spark, left, right) == sorted(expected)
    assert run(spark, left, right, bucket=90) == sorted(expected)


def test_ties_nulls_repeats_and_tolerance(spark):
    left = [("A", 100, "tie", 0, 0), ("A", 100, "tie", 0, 0), ("A", 290, "far", 0, 0), ("A", 291, "too far", 0, 0), (None, 100, "null", 0, 0), ("A", None, "null", 0, 0), ("C", 100, "other", 0, 0)]
    right = [("A", 50, 1, 0), ("A", 150, 2, 0), ("A", 150, 2, 0), ("A", 50, 7, 0), ("A", 200, 3, 0), (None, 100, 4, 0), ("A", None, 5, 0), ("B", 100, 6, 0)]
    assert run(spark, left, right) == [("far", 3), ("tie", 1)]


def test_empty(spark):
    assert run(spark, [], [("A", 1, 1, 0)]) == [] and run(spark, [("A", 1, "x", 0, 0)], []) == []


def test_dense_buckets_are_cut_down_to_the_tolerance(spark):
    rng = random.Random(11)
    left = [("hot", rng.randrange(-40_000, 40_000), n) for n in range(700)] + [("cold", 5, 9_000)]
    right = [("hot", rng.randrange(-40_000, 40_000), n) for n in range(300)] + [("cold", 6, 9_001), ("hot", -10_000, 9_002), ("hot", 10_000, 9_003)]
    a, b = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, id long")
    run = lambda **how: rows(nearest_in_time(a.withColumnRenamed("id", "l"), b.withColumnRenamed("id", "r"), key="k", time="t", left_id="l", right_id="r", tolerance_us=90, **how))
    want = []
    for k, t, n in left:
        near = sorted((abs(u - t), u, m) for j, u, m in right if j == k and abs(u - t) <= 90)
        if near:
            want.append((n, near[0][2], near[0][1] - t))
    got = run(bucket_us=10_000, bucket_rows=10**9)
    assert sorted(got) == sorted(want) and len(want) > 200
    for size in (1, 30, 400):
        assert run(bucket_us=10_000, bucket_rows=size) == got
