from datetime import date, timedelta

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.regrid import period_number, period_start, regrid

S = "entity string, frequency string, period long, rank long, value double, shard int"


def test_periods_and_their_starts(spark):
    days = [(date(1969, 12, 20) + timedelta(n)) for n in range(0, 900)]
    df = spark.createDataFrame([(d, f) for d in days for f in "DWMQ"], "d date, f string")
    got = df.select("d", "f", period_start(period_number(F.unix_date("d"), F.col("f")), F.col("f")).alias("p")).collect()
    for d, f, p in got:
        if f == "D":
            want = d - timedelta(max(d.weekday() - 4, 0))
        elif f == "W":
            want = d - timedelta(d.weekday())
        else:
            want = d.replace(day=1, month=d.month if f == "M" else (d.month - 1) // 3 * 3 + 1)
        assert p == want, (d, f)
    assert spark.range(1).select(period_number(F.lit(1), F.lit("X"))).first()[0] is None


def test_fills_from_first_to_last_over_empty_shards(spark):
    data = [("a", "M", -3, 1, 1.0, 0), ("a", "M", 0, 1, 2.0, 0), ("a", "M", 0, 2, 3.0, 0), ("a", "M", 300, 1, 4.0, 0), ("b", "M", 5, 1, 9.0, 0)]
    for size in (4, 64):
        got = {(r["entity"], r["period"]): (r["value"], r["missing"], r["carried_from"]) for r in regrid(spark.createDataFrame(data, S), shard_periods=size).drop("period_start").collect()}
        assert len(got) == 305
        assert got["a", -3] == (1.0, False, -3) and got["a", -1] == (1.0, True, -3)
        assert got["a", 0] == (3.0, False, 0) and got["a", 299] == (3.0, True, 0) and got["a", 300] == (4.0, False, 300)
        assert got["b", 5] == (9.0, False, 5)


def test_nulls_repeats_and_empty(spark):
    data = [("a", "M", 1, 1, None, 0), ("a", "M", 2, 1, 1.0, 0), ("a", "M", 2, 1, 1.0, 0), ("a", "M", None, 1, 1.0, 0), (None, "M", 2, 1, 1.0, 0), ("a", "M", 3, None, 2.0, 0), ("c", "M", 1, 1, None, 0)]
    assert rows(regrid(spark.createDataFrame(data, S)).select("entity", "period", "value", "missing")) == [("a", 2, 1.0, False), ("a", 3, 2.0, False)]
    assert rows(regrid(spark.createDataFrame([], S))) == []
