import random

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.history import bitmap_history, connected

S = "e string, no long, a double, b string, k string, t long, word int, runs int"


def run(spark, data):
    df = bitmap_history(spark.createDataFrame(data, S), entity=["e"], snapshot="no", attributes=F.struct("a", "b"), key="k", start="t")
    return sorted(((r["e"], r["version_key"], r["valid_from"], r["valid_to"], r["versions"]) for r in df.collect()), key=str)


def brute(data):
    out = []
    for e in {r[0] for r in data}:
        best = {}
        for r in data:
            if r[0] == e and r[1] is not None and r[5] is not None:
                best[r[1]] = max(best.get(r[1], r), r, key=lambda x: (x[5], x[4]))
        versions = []
        for no in sorted(best):
            r = best[no]
            if not versions or versions[-1][0] != r[2:4]:
                versions.append((r[2:4], r[4], r[5]))
        for i, (_, k, t) in enumerate(versions):
            out.append((e, k, t, versions[i + 1][2] if i + 1 < len(versions) else None, len(versions)))
    return sorted(out, key=str)


def test_a_value_that_moves_to_another_null_column_is_a_new_version(spark):
    data = [("A", n, a, b, f"A{n}", n * 10, 0, 0) for n, (a, b) in enumerate([(None, "2.5"), (None, "2.5"), (None, None), (2.5, None)])]
    assert run(spark, data) == brute(data) and len(brute(data)) == 3
    moved = [("A", n, a, b, f"A{n}", n * 10) for n, (a, b) in enumerate([(None, 2.5), (2.5, None), (2.5, None)])]
    df = bitmap_history(spark.createDataFrame(moved, "e string, no long, a double, b double, k string, t long"), entity=["e"], snapshot="no", attributes=F.struct("a", "b"), key="k", start="t")
    assert [r["version_key"] for r in df.orderBy("valid_from").collect()] == ["A0", "A1"]


def test_like_brute_force_over_many_words_and_gaps(spark):
    rng = random.Random(9)
    data = []
    for e in "ABCD":
        for n in rng.sample(range(-200, 2000), 300 if e != "D" else 3):
            data.append((e, n, rng.choice([1.0, 2.0, None]), "x", f"{e}{n}", n * 10, 0, 0))
    assert run(spark, data) == brute(data)


def test_long_unchanged_stretch_is_one_version(spark):
    data = [("A", n, 1.0, None, f"k{n}", n, 0, 0) for n in range(0, 500, 3)] + [("A", 501, 2.0, None, "end", 501, 0, 0)]
    assert run(spark, data) == [("A", "end", 501, None, 2), ("A", "k0", 0, 501, 2)]


def test_every_bit_of_a_word(spark):
    data = [("A", n, float(n % 2), "x", f"k{n}", n, 0, 0) for n in range(130)]
    assert run(spark, data) == brute(data)


def test_nulls_ties_repeats_and_empty(spark):
    data = [("A", 1, 1.0, "x", "a", 1, 0, 0), ("A", 1, 1.0, "x", "a", 1, 0, 0), ("A", None, 2.0, "x", "n", 2, 0, 0), ("A", 2, None, None, "b", 2, 0, 0), ("A", 3, None, None, "c", 3, 0, 0), ("A", 4, 5.0, "x", "t1", 4, 0, 0), ("A", 4, 6.0, "x", "t2", 4, 0, 0)]
    assert run(spark, data) == [("A", "a", 1, 2, 3), ("A", "b", 2, 4, 3), ("A", "t2", 4, None, 3)]
    assert run(spark, []) == []


def test_components_like_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(110)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("x", "x"), (None, "y"), ("c000", "c001")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert rows(connected(spark.createDataFrame([], "a string, b string"))) == []
