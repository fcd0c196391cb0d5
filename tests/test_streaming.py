from datetime import datetime, timedelta

from conftest import rows

from tidemark.functions.scalars import DAY_US
from tidemark.streaming import ledgers as S

T0 = datetime(2024, 1, 1)


def folder(spark, tmp_path, batches, schema):
    """A folder that a stream reads batch by batch."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def drain(stream, tmp_path, mode="append", name="out"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_unique_ids(spark, tmp_path):
    s = folder(spark, tmp_path, [[("a", T0), ("b", T0)], [("a", T0 + timedelta(days=1)), ("c", T0)]], "id string, t timestamp")
    assert [r[0] for r in rows(drain(S.unique(s, "id", "t"), tmp_path, name="u").select("id"))] == ["a", "b", "c"]


def slack(spark, tmp_path, batches, name, **how):
    s = folder(spark, tmp_path, batches, "id string, c string, e timestamp, a timestamp, v double")
    return drain(S.slack_aggregates(s, id="id", category="c", event_time="e", arrival="a", value="v", slack_us=2 * DAY_US, **how), tmp_path, name=name)


def day(d, h=0):
    return T0 + timedelta(days=d, hours=h)


def test_slack_gives_provisional_then_final(spark, tmp_path):
    batches = [
        [("x1", "A", day(0, 9), day(0, 10), 10.0), ("x2", "A", day(0, 3), day(0, 11), 20.0)],
        [("x3", "A", day(0, 1), day(1, 5), 30.0), ("x1", "A", day(0, 9), day(1, 6), 10.0)],
        [("late", "A", day(0, 2), day(4), 99.0), ("y", "B", day(3, 1), day(4), None)],
        [("z", "B", day(9), day(9), 1.0)],
        [("z2", "B", day(20), day(20), 1.0)],
    ]
    out = slack(spark, tmp_path, batches, "slack", disorder="0 seconds")
    a = [tuple(r) for r in out.where("category = 'A'").select("stage", "n", "n_value", "total", "first_value", "last_value").collect()]
    assert [x for x in a if x[0] != "fate"] == [("provisional", 2, 2, 30.0, None, None), ("provisional", 1, 1, 30.0, None, None), ("final", 3, 3, 60.0, 30.0, 10.0)]
    assert rows(S.slack_fates(out)) == [("late", "too_late"), ("x3", "corrects"), ("y", "corrects")]
    assert [tuple(r) for r in S.slack_periods(out).where("category = 'B'").orderBy("day").select("n", "n_value", "mean").collect()] == [(1, 0, None), (1, 1, 1.0)]


def test_slack_drops_nothing_when_arrivals_are_swapped(spark, tmp_path):
    batches = [
        [("x1", "A", day(0, 9), day(1, 9), 10.0), ("n", None, day(0, 5), day(0, 6), 1.0)],
        # arrived before x1, reached the stream after it; and an earlier delivery of x1 itself
        [("x2", "A", day(0, 3), day(0, 11), 20.0), ("x1", "A", day(0, 9), day(0, 10), 10.0), (None, "A", day(0), day(0), 1.0), ("q", "A", None, day(0), 1.0)],
        [("z", "B", day(9), day(9), 1.0)],
        # behind the watermark by days, when the period closes and after it; a redelivery is no news
        [("just", "A", day(0, 4), day(0, 12), 6.0), ("x2", "A", day(0, 3), day(5), 20.0), ("late", "A", day(0, 4), day(5), 5.0)],
        [("slow", "A", day(0, 4), day(0, 12), 5.0), ("z2", "B", day(20), day(20), 1.0)],
    ]
    for slices in (1, 3):
        path = tmp_path / str(slices)
        path.mkdir()
        out = slack(spark, path, batches, f"swapped{slices}", disorder="1 day", slices=slices)
        got = [tuple(r) for r in S.slack_periods(out).where("category = 'A' OR category IS NULL").orderBy("category").select("category", "n", "mean", "first_value", "last_value").collect()]
        assert got == [(None, 1, 1.0, 1.0, 1.0), ("A", 2, 15.0, 20.0, 10.0)]
        assert rows(S.slack_fates(out)) == [("just", "refused"), ("late", "too_late"), ("slow", "refused")]


def test_weeks_begin_on_monday(spark, tmp_path):
    s = folder(spark, tmp_path, [[("a", T0, 1.0), ("a", T0 + timedelta(days=6, hours=23), 2.0)], [("a", T0 + timedelta(days=7), 3.0)], [("a", T0 + timedelta(days=60), 4.0)]], "k string, t timestamp, v double")
    got = rows(drain(S.weekly(s, ["k"], "t", "v"), tmp_path, name="weeks"))
    assert got[:2] == [("a", T0, 2, 2.0), ("a", T0 + timedelta(days=7), 1, 3.0)]


def test_visible_at_the_next_session(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 21, 0),), (datetime(2024, 1, 2, 21, 0, 1),), (datetime(2024, 7, 2, 20, 0),)], "t timestamp")
    assert [str(r["session"]) for r in S.visible_from(df, "t").collect()] == ["2024-01-02", "2024-01-03", "2024-07-02"]


def test_revisions_are_appended_and_replays_are_not(spark, tmp_path):
    write = S.append_revisions(str(tmp_path / "ledger"), ["k"], ["v"])
    batch = lambda data: spark.createDataFrame(data, "k string, v double")
    for n, data in enumerate([[("a", 1.0), ("b", 1.0)], [("a", 1.0), ("b", 2.0)], [("a", 1.0), ("b", 2.0)], [("b", None)]]):
        write(batch(data), n)
    got = rows(spark.read.parquet(str(tmp_path / "ledger")).select("k", "revision_seq", "v"))
    assert got == [("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 2.0), ("b", 2, None)]


def test_monitor_counts_alarms_in_a_row(spark, tmp_path):
    s = folder(spark, tmp_path, [[("m", 1, 0.5), ("m", 2, 9.0)], [("m", 3, 9.0), ("m", 4, 0.0)]], "k string, n long, r double")
    got = [(r["order_no"], r["alarms"]) for r in drain(S.monitor(s, "k", "n", "r", weight=0.5), tmp_path, name="mon").orderBy("order_no").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_matured_forecasts_once(spark):
    obs = spark.createDataFrame([("a", 5), ("b", 5)], "k string, t int")
    waiting = spark.createDataFrame([("a", 4), ("a", 9), ("b", 5), ("c", 1)], "k string, target int")
    done = spark.createDataFrame([("b",)], "k string")
    assert rows(S.matured(obs, waiting, done, ["k"], "target", "t").select("k", "target")) == [("a", 4)]
