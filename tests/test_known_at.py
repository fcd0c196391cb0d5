import random

from conftest import rows

from tidemark.operators.known_at import NEVER, WIDEST, dense_entities, known_at

V = "entity string, lo long, hi long, rank_1 long, rank_2 long, version long, number int"
E = "entity string, tick long, id string, version int"


def brute(events, versions):
    out = set()
    for e, t, i, _ in events:
        live = [v for v in versions if e is not None and t is not None and v[0] == e and v[1] is not None and v[1] <= t and (v[2] is None or t < v[2])]
        if live:
            out.add((i, max(live, key=lambda v: (v[3], v[4], v[5]))[5]))
    return sorted(out)


def run(spark, events, versions, width):
    df = known_at(spark.createDataFrame(events, E), spark.createDataFrame(versions, V), width=width)
    return sorted({(r["id"], r["version"]) for r in df.collect()})


def test_like_brute_force_with_holes_and_overlaps(spark):
    rng = random.Random(5)
    versions = []
    for n in range(400):
        lo = rng.randrange(-300, 3000)
        versions.append((rng.choice("AABC"), lo, rng.choice([None, lo + rng.randrange(0, 700), lo + rng.randrange(1, 30), NEVER]), rng.randrange(12), lo, n, 0))
    events = [(rng.choice("AABCD"), rng.randrange(-400, 3500), f"e{k}", 0) for k in range(600)]
    expected = brute(events, [(*v[:2], None if v[2] == NEVER else v[2], *v[3:]) for v in versions if v[2] is None or v[2] > v[1]])
    assert len(expected) > 300
    for width in (16, 512):
        assert run(spark, events, versions, width) == expected


def test_edges_nulls_ties_and_repeats(spark):
    versions = [("A", 10, 20, 1, 10, 1, 0), ("A", 10, 20, 1, 10, 1, 0), ("A", 20, None, 1, 20, 2, 0), ("A", 10, 20, 1, 10, 3, 0), ("A", 15, 15, 9, 15, 4, 0), (None, 0, None, 9, 0, 5, 0), ("B", None, None, 9, 0, 6, 0)]
    events = [("A", 9, "early", 0), ("A", 10, "begin", 0), ("A", 19, "end", 0), ("A", 20, "next", 0), ("A", None, "null", 0), (None, 15, "none", 0), ("B", 15, "b", 0), ("A", 15, "inside", 0)]
    assert run(spark, events, versions, 8) == [("begin", 3), ("end", 3), ("inside", 3), ("next", 2)]


def test_wide_attributes_and_clashing_names(spark):
    wide = spark.createDataFrame([(1, "x", "clash"), (1, "x", "clash")], "version long, attribute string, id string")
    df = known_at(spark.createDataFrame([("A", 12, "e", 0)] * 2, E), spark.createDataFrame([("A", 10, None, 1, 1, 1, 0)], V), wide=wide)
    assert [(r["id"], r["attribute"], r["id_attribute"]) for r in df.collect()] == [("e", "x", "clash")] * 2


def test_empty(spark):
    assert run(spark, [], [("A", 1, None, 1, 1, 1, 0)], 8) == []
    assert run(spark, [("A", 1, "e", 0)], [], 8) == []


def test_only_dense_entities_get_narrow_shards(spark):
    versions = spark.createDataFrame([("A", n % 100, None, 1, 1, n, 0) for n in range(1000)] + [("B", 5, None, 1, 1, 1, 0)], V)
    assert rows(dense_entities(versions, 100_000)) == [] and rows(dense_entities(versions.limit(0), 100)) == []
    assert rows(dense_entities(versions, 100)) == [("A", WIDEST - 4)] and rows(dense_entities(versions, 1)) == [("A", 0)]
    df = known_at(spark.createDataFrame([("A", 50, "e", 0), ("B", 600, "f", 0)], E), spark.createDataFrame([("A", n % 100, None, 1, n % 100, n, 0) for n in range(1000)] + [("B", 5, None, 1, 1, 1, 0)], V), shard_rows=100)
    assert sorted((r["id"], r["version"]) for r in df.collect()) == [("e", 950), ("f", 1)]


def test_hot_events_are_dealt_out(spark):
    rng = random.Random(6)
    versions = [("A", rng.randrange(0, 400), rng.choice([None, 450]), rng.randrange(9), n, n, 0) for n in range(60)] + [("B", 3, None, 1, 1, 99, 0)]
    # all events of one entity within a few ticks, some repeated; others alone
    events = [("A", rng.randrange(200, 210), f"e{k % 2000}", 0) for k in range(3000)] + [("A", 900, "after", 0), ("A", -5, "before", 0), ("B", 10, "b", 0)]
    got = known_at(spark.createDataFrame(events, E), spark.createDataFrame(versions, V), slice_rows=100)
    assert got.count() == sum(1 for e in events if e[2] != "before")
    assert sorted({(r["id"], r["version"]) for r in got.collect()}) == brute(events, versions)
