"""The ledgers' streams run to their end over a table of the driver: file source, state, file sink, read back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_US, instant, instant_us
from tidemark.plans.landing import scratch
from tidemark.plans.tables import table
from tidemark.plans.views import query
from tidemark.sources import store
from tidemark.streaming import ledgers as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files; times as instants."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def _state_stores(spark: SparkSession, source: str, store_bytes: int = 4 << 20) -> Iterator[None]:
    """As many state stores as the input's size asks for, up to the session's shuffle partitions: a stream keeps the number it begins with."""
    fs, at = store._fs(spark, source)
    found = fs.globStatus(at(source)) or []
    size = sum(fs.getContentSummary(f.getPath()).getLength() for f in found)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), max(4, -(-size // store_bytes)))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _drained(stream: DataFrame, source: str) -> DataFrame:
    """All that the stream gives for what is there now; ``source`` is what it reads."""
    spark, root = stream.sparkSession, scratch(stream.sparkSession)
    with _state_stores(spark, source):
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT event_id, user_id, event_type FROM events")
def sm01_unique_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every event comes twice and goes out once."""
    e = _events(spark, d)
    return _drained(S.unique(e.unionByName(_events(spark, d)), "event_id", "ts", "60 days").select("event_id", "user_id", "event_type"), f"{d}/events.parquet*")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def sm02_overlapping_refetch(spark: SparkSession, d: str) -> DataFrame:
    """A refetch that overlaps the first one adds nothing but what is new."""
    e = _events(spark, d)
    early, late = e.where("ts < '2024-01-20'"), e.where("ts >= '2024-01-10'")
    got = _drained(S.unique(early.unionByName(late), "event_id", "ts", "60 days").select("event_id", "event_type", "value"), f"{d}/events.parquet*")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, 0 AS revision_seq FROM events GROUP BY ALL")
def sm03_revision_stream(spark: SparkSession, d: str) -> DataFrame:
    """The newest value of each key is appended as a revision; a replay of the batch appends nothing."""
    root = scratch(spark)
    write = S.append_revisions(f"{root}/ledger", ["user_id", "event_type"], ["value"])

    def twice(batch: DataFrame, number: int) -> None:
        newest = batch.select("user_id", "event_type", "ts", "event_id", "value")
        write(newest, number)
        write(newest, number)

    _events(spark, d).writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/ledger").select("user_id", "event_type", "value", "revision_seq")


@query("SELECT event_id, (ny + INTERVAL 1 DAY * (ny - date_trunc('day', ny) > INTERVAL 16 HOUR)::int)::date AS session FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS ny FROM events)")
def sm04_visible_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _drained(S.visible_from(_events(spark, d), "ts").select("event_id", "session"), f"{d}/events.parquet*")


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'signup' AND e.ts >= TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'error' AND p.value > 60)")
def sm06_matured_stream(spark: SparkSession, d: str) -> DataFrame:
    """Signups as observations of users whose forecast is due on 15 January, but for those resolved before."""
    users = table(spark, d, "events").select("user_id").distinct().withColumn("target", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    done = table(spark, d, "events").where("event_type = 'error' AND value > 60").select("user_id").distinct()
    return _drained(S.matured(_events(spark, d).where("event_type = 'signup'"), users, done, ["user_id"], "target", "ts").select("event_id", "user_id"), f"{d}/events.parquet*")


@query("SELECT event_type AS key, round(list_reduce(list(value / 20 ORDER BY event_id), lambda a, x: 0.15 * x + 0.85 * a), 6) AS ratio FROM events GROUP BY 1")
def sm08_monitor_stream(spark: SparkSession, d: str) -> DataFrame:
    """The monitored ratio of each kind of event after the last one."""
    got = _drained(S.monitor(_events(spark, d).withColumn("ratio", F.col("value") / 20), "event_type", "event_id", "ratio"), f"{d}/events.parquet*")
    return got.groupBy("key").agg(F.round(F.max_by("ratio", "order_no"), 6).alias("ratio"))


_CLOSED = """
    WITH got AS (SELECT receipt_id, min(retrieved_at::timestamptz) AS received FROM raw_time_series_receipt GROUP BY 1),
    told AS (SELECT event_id, event_type, scheduled_at::timestamptz AS s, coalesce(received, retrieved_at::timestamptz) AS a, actual FROM event_fact LEFT JOIN got USING (receipt_id)),
    once AS (SELECT event_id, any_value(event_type) AS event_type, any_value(s) AS s, min(a) AS a, any_value(actual) AS actual FROM told GROUP BY 1),
    placed AS (SELECT *, timezone('UTC', s)::date AS day, (timezone('UTC', s)::date + INTERVAL 1 DAY) AT TIME ZONE 'UTC' AS ends, (SELECT max(a) - INTERVAL 12 DAY FROM told) AS mark FROM once)
"""


def _deliveries(spark: SparkSession, d: str, root: str, parts: int = 5) -> DataFrame:
    """The deliveries as a stream of files in which arrivals are out of order by up to twelve days, the file's bounds by row counts."""
    told = table(spark, d, "event_fact").select("event_id", "event_type", instant(F.col("scheduled_at")).alias("scheduled"), instant_us(F.col("retrieved_at")).alias("told_us"), "actual", "receipt_id")
    receipts = table(spark, d, "raw_time_series_receipt").groupBy("receipt_id").agg(F.min(instant_us(F.col("retrieved_at"))).alias("received_us"))
    arrival = F.coalesce("received_us", "told_us")
    rows = told.join(receipts, "receipt_id", "left").select("event_id", "event_type", "scheduled", F.timestamp_micros(arrival).alias("arrival"), "actual", (arrival + F.pmod(F.xxhash64("event_id", "told_us"), F.lit(12 * DAY_US))).alias("came"))
    cuts = rows.approxQuantile("came", [k / parts for k in range(1, parts)], 0.01)
    for k in range(parts):
        inside = (F.col("came") >= cuts[k - 1] if k else F.lit(True)) & (F.col("came") < cuts[k] if k < parts - 1 else F.lit(True))
        rows.where(inside).drop("came").write.parquet(f"{root}/in/{k:03d}")
    return spark.readStream.schema(rows.drop("came").schema).option("maxFilesPerTrigger", 1 + spark.read.parquet(f"{root}/in/000").inputFiles().__len__()).option("recursiveFileLookup", True).parquet(f"{root}/in")


def _slack(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark)
    return _drained(S.slack_aggregates(_deliveries(spark, d, root), id="event_id", category="event_type", event_time="scheduled", arrival="arrival", value="actual", slack_us=10 * DAY_US, disorder="12 days", slices=4), f"{root}/in")


@query(_CLOSED.strip() + " SELECT event_type, strftime(day, '%Y-%m-%d') AS day, count(*) AS n, count(actual) AS n_actual, round(avg(actual), 9) AS mean_actual FROM placed WHERE a < ends + INTERVAL 240 HOUR AND mark >= ends + INTERVAL 240 HOUR GROUP BY ALL")
def sm09_slack_periods(spark: SparkSession, d: str) -> DataFrame:
    """Days of releases as the stream closed them, deliveries out of order; days not yet closed have no final row."""
    got = S.slack_periods(_slack(spark, d))
    return got.select(F.col("category").alias("event_type"), F.date_from_unix_date("day").cast("string").alias("day"), "n", F.col("n_value").alias("n_actual"), F.round("mean", 9).alias("mean_actual"))


@query(_CLOSED.strip() + " SELECT event_id, CASE WHEN a < ends + INTERVAL 240 HOUR THEN 'corrects' ELSE 'too_late' END AS fate FROM placed WHERE a >= ends AND (a >= ends + INTERVAL 240 HOUR OR mark >= ends + INTERVAL 240 HOUR)")
def sm10_slack_fates(spark: SparkSession, d: str) -> DataFrame:
    """What the stream said of late deliveries; of days not yet closed only what was too late."""
    return S.slack_fates(_slack(spark, d)).select(F.col("id").alias("event_id"), "fate")
