from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_US
from tidemark.operators.late_events import fates, kslack_replay, periods, provisional

H = 3_600_000_000


def replay(spark, data, **how):
    df = spark.createDataFrame(data, "id string, c string, e long, a long, v double, slice int, day string")
    return kslack_replay(df, id="id", category="c", event_us="e", arrival_us="a", value="v", slack_us=2 * DAY_US, **how)


DATA = [
    ("x1", "A", 5 * H, 6 * H, 10.0, 0, ""), ("x1", "A", 5 * H, 50 * H, 10.0, 0, ""),  # delivered twice
    ("x2", "A", 3 * H, DAY_US - 1, 20.0, 0, ""), ("x3", "A", 9 * H, DAY_US, 30.0, 0, ""),  # last moment on time, first late
    ("x4", "A", 1 * H, 3 * DAY_US - 1, 40.0, 0, ""), ("x5", "A", 2 * H, 3 * DAY_US, 50.0, 0, ""),  # last correction, too late
    ("x6", "A", 4 * H, -5 * H, None, 0, ""), ("y1", None, 5 * H, 6 * H, 1.0, 0, ""), ("z", "A", None, 1, 1.0, 0, ""), (None, "A", 1, 1, 1.0, 0, ""), ("w", "A", 1, None, 1.0, 0, ""),
]


def test_fates_at_the_edges(spark):
    got = {r["id"]: r["fate"] for r in fates(replay(spark, DATA), "id").collect()}
    assert got == {"x1": "on_time", "x2": "on_time", "x3": "corrects", "x4": "corrects", "x5": "too_late", "x6": "on_time", "y1": "on_time"}


def test_only_late_fates(spark):
    late = replay(spark, DATA, all_fates=False)
    assert {r["id"] for r in fates(late, "id").collect()} == {"x3", "x4", "x5"} and rows(periods(late)) == rows(periods(replay(spark, DATA)))


def test_final_totals_are_released_in_event_order(spark):
    got = {r["category"]: r for r in periods(replay(spark, DATA)).collect()}
    a = got["A"]
    assert (a["day"], a["n"], a["n_value"], a["mean"]) == (0, 5, 4, 25.0)
    assert (a["first_value"], a["last_value"]) == (40.0, 30.0)  # by event time, though 40 came last
    assert got[None]["n"] == 1


def test_slices_of_a_hot_period_give_the_same(spark):
    data = [(f"i{k}", "A", k * 60_000_000, (k * 7919 % 5000) * 60_000_000, float(k % 11), 0, "") for k in range(1400)]
    whole, cut = replay(spark, data), replay(spark, data, slice_rows=100)
    assert rows(periods(whole)) == rows(periods(cut))
    assert rows(fates(whole, "id")) == rows(fates(cut, "id"))
    assert rows(provisional(whole).select("category", "day", "at_us", "n", F.round("mean", 9))) == rows(provisional(cut).select("category", "day", "at_us", "n", F.round("mean", 9)))


def test_provisional_values_grow_until_closed(spark):
    got = [(r["at_us"] // DAY_US, r["n"], r["n_value"]) for r in provisional(replay(spark, DATA)).where("category = 'A'").orderBy("at_us").collect()]
    assert got == [(1, 3, 2), (2, 4, 3), (3, 5, 4)]


def test_empty(spark):
    r = replay(spark, [])
    assert rows(r) == [] and rows(periods(r)) == [] and rows(provisional(r)) == []
