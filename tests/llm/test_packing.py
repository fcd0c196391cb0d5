import random
from collections import defaultdict
from itertools import combinations

from tidemark.llm.packing import bucket_batches, fill_plan, optimal_buckets, pack


def check(placed, sizes, capacity):
    """Every item is there whole, nothing overlaps, nothing sticks out; returns the number of containers."""
    by, parts = defaultdict(list), defaultdict(int)
    for r in placed:
        assert r["length"] <= capacity
        parts[r["id"]] += r["length"]
        if r["length"]:
            by[r["container"]].append((r["place"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[-1][0] + spans[-1][1] <= capacity
    assert dict(parts) == {k: max(n, 0) for k, n in sizes}
    whole = [n for _, n in sizes if 0 < n <= capacity]
    assert sum(1 for r in placed if 0 < r["length"] < capacity) <= len(whole) + sum(n > capacity for _, n in sizes)
    return len(by)


def frame(spark, sizes):
    return spark.createDataFrame([(k, n, 0, 0) for k, n in sizes], "id long, n long, part int, rank int")


def test_next_to_no_space_is_left(spark):
    rng = random.Random(1)
    sizes = [(k, int(rng.lognormvariate(5, 1))) for k in range(4000)]
    placed = pack(frame(spark, sizes), id="id", size="n").collect()
    total = sum(n for _, n in sizes)
    assert check(placed, sizes, 2048) <= -(-total // 2048) + 1


def test_long_empty_null_repeated_and_hot_lengths(spark):
    sizes = [(1, 5000), (2, 2048), (3, 2049), (4, 0), (5, -3)] + [(k, 700) for k in range(10, 3010)]
    placed = pack(frame(spark, sizes), id="id", size="n").collect()
    check(placed, sizes, 2048)
    assert sorted(r["length"] for r in placed if r["id"] == 1) == [904, 2048, 2048]
    df = frame(spark, [(7, 100), (7, 100), (None, 100), (8, None)])
    again = pack(df, id="id", size="n").collect()
    assert sorted((str(r["id"]), r["place"]) for r in again) in ([("7", 0), ("7", 100), ("None", 200)], [("7", 0), ("7", 200), ("None", 100)], [("7", 100), ("7", 200), ("None", 0)])
    assert pack(df.limit(0), id="id", size="n").collect() == []


def test_plan_uses_every_item_once():
    rng = random.Random(2)
    for _ in range(30):
        histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 101), 20)}
        plan = fill_plan(histogram, 100)
        used = defaultdict(list)
        for n, a, b, *_ in plan:
            used[n].append((a, b))
        for n, spans in used.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == histogram[n] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert set(used) == set(histogram)


def test_bucket_bounds_are_optimal():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 61), 8)}
        lengths = sorted(histogram)

        def cost(bounds):
            low, total = 0, 0.0
            for b in bounds:
                total += sum(histogram[n] for n in lengths if low < n <= b) / (60 // b)
                low = b
            return total

        best = min(cost([*c, lengths[-1]]) for k in range(3) for c in combinations(lengths[:-1], k))
        assert abs(cost(optimal_buckets(histogram, 60, 3)) - best) < 1e-9
    assert optimal_buckets({}, 60, 3) == []


def test_padded_batches_fit(spark):
    rng = random.Random(4)
    sizes = [(k, rng.randrange(0, 300)) for k in range(2000)] + [(9999, 700)]
    placed = bucket_batches(frame(spark, sizes), id="id", size="n", capacity=256, most=8).collect()
    assert all(r["length"] <= r["bound"] and r["place"] % r["bound"] == 0 and r["place"] + r["bound"] <= 256 for r in placed)
    assert len({(r["container"], r["place"]) for r in placed}) == len(placed)
