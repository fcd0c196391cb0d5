import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalars import day_number, instant_us, utc_text
from tidemark.operators import ledger as L
from tidemark.operators import pit, scoring
from tidemark.operators.asof import asof_join
from tidemark.operators.series import correction_episodes, greedy_gap, rsi, runs


def test_asof_like_brute_force_over_shards(spark):
    rng = random.Random(2)
    left = [(rng.choice("AB"), rng.randrange(1000), n) for n in range(200)] + [(None, 5, 900), ("A", None, 901), ("Z", 5, 902)]
    right = [(rng.choice("AB"), rng.randrange(1000), n) for n in range(60)] + [(None, 5, 99), ("A", None, 98)]
    dl, dr = spark.createDataFrame(left, "k string, t long, l long"), spark.createDataFrame(right, "k string, u long, v long")
    for strict, forward in ((False, False), (True, False), (False, True), (True, True)):
        want = []
        for k, t, i in left:
            ok = [(u, v) for rk, u, v in right if k and rk == k and t is not None and u is not None and ((u > t if strict else u >= t) if forward else (u < t if strict else u <= t))]
            best = (min(ok, key=lambda x: (x[0], -x[1])) if forward else max(ok)) if ok else None
            want.append((i, best and best[1]))
        for shard, most in ((7, 1_000_000), (10_000, 1_000_000), (10_000, 9), (300, 20)):
            got = asof_join(dl, dr, by=["k"], left_time="t", right_time="u", values=["v"], strict=strict, forward=forward, shard=shard, shard_rows=most)
            assert sorted(tuple(r) for r in got.select("l", "v").collect()) == sorted(want), (strict, forward, shard, most)
    assert asof_join(dl.limit(0), dr, by=["k"], left_time="t", right_time="u", values=["v"]).count() == 0
    assert asof_join(dl, dr.limit(0), by=["k"], left_time="t", right_time="u", values=["v"]).where("v IS NULL").count() == len(left)


def test_point_in_time_vintages(spark):
    at = lambda s: datetime.fromisoformat(s)
    facts = spark.createDataFrame([("g", date(2025, 3, 31), at("2025-04-30T08:30:00"), at("2025-05-29T08:30:00"), 100.0), ("g", date(2025, 3, 31), at("2025-05-29T08:30:00"), at("2025-06-26T08:30:00"), 101.0), ("g", date(2025, 3, 31), at("2025-06-26T08:30:00"), None, 102.0)], "s string, observation_date date, vintage_start timestamp, vintage_end timestamp, v double")
    seen = lambda t: [r["v"] for r in pit.as_of(facts, F.lit(at(t)), keys=["s", "observation_date"]).collect()]
    assert seen("2025-05-15T00:00:00") == [100.0] and seen("2025-06-01T00:00:00") == [101.0] and seen("2025-07-01T00:00:00") == [102.0]
    assert seen("2025-04-30T08:29:59") == [] and seen("2025-05-29T08:30:00") == [101.0]
    with pytest.raises(ValueError, match="later"):
        pit.assert_no_leakage(facts, F.lit(at("2025-05-01T00:00:00")))
    opened = facts.withColumn("vintage_end", F.lit(None).cast("timestamp"))
    assert rows(pit.close_intervals(opened, ["s", "observation_date"]).select("v", "vintage_end")) == rows(facts.select("v", "vintage_end"))


def test_append_unique_and_revise(spark):
    led = spark.createDataFrame([(1, "a"), (2, None)], "id int, b string")
    came = spark.createDataFrame([(1, "a"), (2, ""), (3, "c"), (3, "c"), (4, "x"), (4, "y")], "id int, b string")
    new, conflicts = L.append_unique(led, came, "id", ["b"])
    assert rows(new) == [(3, "c")] and rows(conflicts) == [(2,), (4,)]
    tip = spark.createDataFrame([("k", 1.0, 3, "r3"), ("n", None, 0, "r0")], "k string, v double, revision_seq int, rid string")
    got = L.revise(tip, spark.createDataFrame([("k", 1.0), ("k2", 5.0), ("n", 2.0)], "k string, v double"), ["k"], ["v"], id="rid")
    assert rows(got) == [("k2", 5.0, 0, None), ("n", 2.0, 1, "r0")]


def test_quarantine_overlay_upsert_changes(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, p double")
    good, bad = L.quarantine(df, {"range": F.col("p").between(0, 1), "known": F.col("p").isNotNull()})
    assert rows(good) == [(1, 0.5)] and rows(bad.select("id", "reasons")) == [(2, ["range"]), (3, ["range", "known"])]
    fixes = spark.createDataFrame([(1, "p", "0.7", 1, "approved"), (1, "p", "0.9", 2, "open"), (2, "p", "0.1", 1, "approved"), (2, "p", "0.2", 2, "approved")], "id int, field string, new_value string, approved_at int, status string")
    assert rows(L.overlay_corrections(df, fixes, "id", ["p"])) == [(1, 0.7), (2, 0.2), (3, None)]
    assert rows(L.upsert(df, spark.createDataFrame([(3, 9.0), (4, 4.0)], "id int, p double"), ["id"])) == [(1, 0.5), (2, 1.5), (3, 9.0), (4, 4.0)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "n int, h string"), spark.createDataFrame([(1, "x"), (2, "q"), (4, "w")], "n int, h string")
    assert rows(L.line_changes(a, b, "n", "h")) == [(2, "changed"), (3, "removed"), (4, "added")]


def test_row_hash_tells_null_from_empty_and_ignores_order(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("x=1", "a")], "p string, q string")
    h = [r[0] for r in df.select(L.row_hash("p", "q")).collect()]
    assert len(set(h)) == 3 and h == [r[0] for r in df.select(L.row_hash("q", "p")).collect()]


def test_rsi_seed_and_flat_losses(spark):
    rng = random.Random(1)
    v = [100 + rng.gauss(0, 1) for _ in range(40)]
    df = spark.createDataFrame([("a", n, x) for n, x in enumerate(v)] + [("up", n, float(n)) for n in range(20)] + [("short", 0, 1.0)], "k string, t int, c double")
    got = {(r["k"], r["t"]): r["rsi"] for r in rsi(df, ["k"], "t", "c").collect()}
    moves = [b - a for a, b in zip(v, v[1:], strict=False)]
    g, lo = sum(max(m, 0) for m in moves[:14]) / 14, sum(max(-m, 0) for m in moves[:14]) / 14
    for n in range(14, 39):
        g, lo = (g * 13 + max(moves[n], 0)) / 14, (lo * 13 + max(-moves[n], 0)) / 14
        assert got["a", n + 1] == pytest.approx(100 - 100 / (1 + g / lo))
    assert got["a", 14] is None and got["up", 15] == 100.0 and got["short", 0] is None and len(got) == 61


def test_episodes_like_the_state_machine(spark):
    rng = random.Random(7)
    data, want = [], []
    for k in "abcde":
        x, peak, low, peak_at, low_at = 100.0, None, None, None, None
        for n in range(150):
            x = round(x * (1 + rng.gauss(0, 0.04)), 1)
            data.append((k, n, x))
            if peak is None or x > peak:
                if low is not None and low / peak - 1 <= -0.05:
                    want.append((k, peak_at, low_at, n))
                peak, peak_at, low, low_at = x, n, None, None
            elif low is None or x < low:
                low, low_at = x, n
        if low is not None and low / peak - 1 <= -0.05:
            want.append((k, peak_at, low_at, None))
    got = correction_episodes(spark.createDataFrame(data, "k string, t int, c double"), ["k"], "t", "c").select("k", "peak", "trough", "recovered")
    assert sorted(tuple(r) for r in got.collect() if True) == sorted(want, key=lambda x: x[:2]) or {tuple(r) for r in got.collect()} == set(want)


def test_greedy_gap(spark):
    start = date(2020, 1, 1)
    rng = random.Random(3)
    c = [(k, start + timedelta(rng.randrange(2000)), round(rng.random(), 6)) for k in "ab" for _ in range(150)]
    want = set()
    for k in "ab":
        picked = []
        for d, t in sorted((d, t) for kk, t, d in c if kk == k):
            if len(picked) < 5 and all(abs((t - p).days) >= 90 for p in picked):
                picked.append(t)
                want.add((k, len(picked), t))
    got = greedy_gap(spark.createDataFrame(c, "k string, t date, d double"), ["k"], "t", "d", 5, 90)
    assert {(r["k"], r["rank"], r["t"]) for r in got.collect()} == want


def test_runs_and_tail(spark):
    df = spark.createDataFrame([("a", n, x) for n, x in enumerate("xxyyyx")] + [("b", 0, None), ("b", 1, None)], "k string, t int, s string")
    assert sorted((tuple(r) for r in runs(df, ["k"], "t", "s").select("k", "begin", "end", "length").collect())) == [("a", 0, 1, 2), ("a", 2, 4, 3), ("a", 5, 5, 1), ("b", 0, 1, 2)]
    r = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, True), ("c", 1, False)], "k string, d int, ok boolean")
    assert rows(L.healthy_tail(r, "k", "d", "ok")) == [("a", 2), ("b", 1), ("c", 0)]


def test_scores(spark):
    df = spark.createDataFrame([(0, -1.0, 0.0), (0, 1.0, 0.0)], "k int, x double, y double")
    assert scoring.crps(df, ["k"], "x", "y").first()["crps"] == pytest.approx(0.5)
    lo, hi = scoring.wilson(F.col("s"), F.col("n"))
    w = [tuple(r) for r in spark.createDataFrame([(8, 10), (0, 0)], "s int, n int").select(lo, hi).collect()]
    assert w[0] == (pytest.approx(0.5408, abs=1e-3), pytest.approx(0.9314, abs=1e-3)) and w[1][0] is None or w[1] == (0.0, 1.0)
    q = scoring.weighted_quantiles(spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0)], "k string, v double, w double"), ["k"], "v", "w", [0.05, 0.5, 0.95]).first()
    assert (q["q05"], q["q50"], q["q95"]) == (1.0, pytest.approx(2 + (0.5 - 0.375) / 0.375), 3.0)
    phi = [r[0] for r in spark.createDataFrame([(0.0,), (1.96,), (-1.96,)], "x double").select(scoring.normal_cdf(F.col("x"))).collect()]
    assert phi == [pytest.approx(0.5, abs=1e-7), pytest.approx(0.9750021, abs=1e-6), pytest.approx(0.0249979, abs=1e-6)]


def test_times_and_calendar(spark):
    df = spark.createDataFrame([("2025-06-02 17:10:48+09:00",), ("2025-06-02T08:10:48Z",), ("2025-06-02T04:10:48.5-04:00",), ("?",), (None,), ("1969-12-31T23:59:59Z",)], "t string")
    got = [r[0] for r in df.select(utc_text(instant_us(F.col("t")))).collect()]
    assert got == ["2025-06-02 08:10:48"] * 3 + [None, None, "1969-12-31 23:59:59"]
    d = spark.createDataFrame([("2010-12-31",), ("20101231",), (" 2010-12-31T00:00:00",), ("x",), (None,)], "t string")
    assert [r[0] for r in d.select(day_number(F.col("t"))).collect()] == [14974, 14974, 14974, None, None]
    y = F.lit(2024)
    one = spark.range(1).select(cal.easter(y), cal.nth_weekday(y, F.lit(11), 3, 4), cal.nth_weekday(y, F.lit(5), 0, -1), cal.observed(F.lit("2021-07-04").cast("date")), cal.observed(F.lit("2022-01-01").cast("date"))).first()
    assert [str(x) for x in one] == ["2024-03-31", "2024-11-28", "2024-05-27", "2021-07-05", "2021-12-31"]


def test_average_ranks_over_ranges(spark):
    rng = random.Random(8)
    v = [float(rng.randrange(300)) for _ in range(1000)] + [None]
    want = {x: sum(y < x for y in v[:-1]) + (sum(y == x for y in v[:-1]) + 1) / 2 for x in set(v[:-1])}
    got = scoring.average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v", "r", cells=17)
    assert {r["v"]: r["r"] for r in got.collect()} == want and got.count() == 1000
    assert scoring.average_ranks(spark.createDataFrame([], "v double"), "v", "r").count() == 0


def test_linear_recursions_over_stretches_like_the_plain_loop(spark):
    from tidemark.operators.series import decayed, ewma_variance

    rng = random.Random(12)
    data = [("a", t, rng.choice([0.0, rng.gauss(0, 1), None]) if t % 700 > 300 else 0.0) for t in range(2500)] + [("b", 1, 2.0), (None, 1, 3.0), (None, 2, 1.0)]
    df = spark.createDataFrame(data, "k string, t int, x double")
    for decay in (0.5, 0.94):
        got = {(r["k"], r["t"]): r["y"] for r in decayed(df, ["k"], "t", F.col("x"), decay, "y").collect()}
        y = 0.0
        for _, t, x in data[:2500]:
            y = decay * y + (x or 0.0)
            assert abs(got["a", t] - y) < 1e-9 * max(1.0, abs(y))
        assert got["b", 1] == 2.0 and abs(got[None, 2] - (1 + 3 * decay)) < 1e-12
    v = {(r["k"], r["t"]): r["variance"] for r in ewma_variance(df, ["k"], "t", "x", 0.5).collect()}
    level = None
    for _, t, x in data[:2500]:
        level = None if x is None else x * x if level is None else 0.5 * level + 0.5 * x * x
        assert (v["a", t] is None) == (level is None) and (level is None or abs(v["a", t] - level) < 1e-9)
