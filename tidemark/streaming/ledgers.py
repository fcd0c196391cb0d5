"""The ledgers as streams: late data, revisions, buckets and monitors, with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import DAY_US
from tidemark.operators.late_events import CORRECTS, TOO_LATE, OrderedTotals, SlackBuffer
from tidemark.operators.ledger import revise
from tidemark.operators.pit import latest


def read_folder(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique(stream: DataFrame, id: str, time: str, overlap: str = "7 days") -> DataFrame:  # noqa: A002
    """Redelivered rows once; an id may come again within ``overlap`` of its time, as refetches do."""
    return stream.withWatermark(time, overlap).dropDuplicatesWithinWatermark([id])


def weekly(stream: DataFrame, keys: list[str], time: str, value: str, lateness: str = "10 days") -> DataFrame:
    """Count and last value per key and week (from Monday); a week is final once the watermark has passed it."""
    # windows count from a Thursday (1970-01-01), Mondays are four days on
    week = F.window(time, "7 days", "7 days", "4 days")
    out = stream.withWatermark(time, lateness).groupBy(*keys, week.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(time, value))[value].alias("last"))
    return out.select(*keys, F.col("w.start").alias("week"), "n", "last")


def visible_from(stream: DataFrame, time: str, hour: int = 16, zone: str = "America/New_York") -> DataFrame:
    """Each event with the session day at whose cut-off it is first visible: the same day's up to the cut-off, else the next."""
    wall = F.from_utc_timestamp(time, zone)
    day = F.to_date(wall)
    return stream.withColumn("session", F.when(F.unix_micros(wall) - F.unix_date(day).cast("long") * DAY_US <= hour * 3_600_000_000, day).otherwise(F.date_add(day, 1)))


SLACK_STATE = "ids array<string>, events array<long>, arrivals array<long>, amounts array<double>, published array<double>"
SLACK_OUT = "stage string, category string, day int, slice int, id string, fate string, n long, n_value long, total double, first_us long, first_value double, last_us long, last_value double"
REFUSED = "refused"


def slack_aggregates(stream: DataFrame, *, id: str, category: str, event_time: str, arrival: str, value: str, slack_us: int, disorder: str = "1 day", slices: int = 1) -> DataFrame:  # noqa: A002
    """K-slack over a stream of deliveries, which may come in any order up to ``disorder`` of their arrival times.

    A buffer per category, UTC day of event time and slice (by a hash of the id: with
    ``slices`` above 1 no period, however hot, is one task's) is keyed state. An id counts once,
    by its earliest arrival. While the buffer fills, what it gained is handed out as
    ``provisional``. A period closes when the watermark (the latest arrival less ``disorder``)
    passes its end plus the slack: its events are released sorted by event time into the
    ``final`` row, and each id that arrived after the day's end gets a ``fate`` row. Nothing
    is dropped: a delivery of a closed period gets a fate row at once, ``too_late`` if it
    arrived after the slack, else ``refused`` (it reached the stream later than ``disorder`` allows).
    :func:`slack_periods` puts the finals of slices together, :func:`slack_fates` the fates.

    Defined cases: rows whose id, event time or arrival is null are left out; a null category
    is one like any other; a null value counts in ``n`` only; a redelivery is no news, but one
    of an id of a closed period is told as if it were new, as its buffer is gone.
    """
    names = [c.split()[0] for c in SLACK_OUT.split(", ")]
    day = F.expr(f"cast(floor(unix_micros({event_time}) / {DAY_US}) AS int)")
    told = stream.where(f"`{id}` IS NOT NULL AND `{event_time}` IS NOT NULL AND `{arrival}` IS NOT NULL").select(
        F.col(id).cast("string").alias("id"), F.col(category).cast("string").alias("category"), F.unix_micros(event_time).alias("event_us"), F.col(arrival).cast("timestamp").alias("arrival"), F.col(value).cast("double").alias("value"), day.alias("day"),
    )
    # the engine drops rows behind the watermark; so a copy of each row, without content, carries the clock, and the row itself has none
    part = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    clock = F.struct(F.col("arrival").alias("clock"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("day"), part.alias("slice"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("event_us"), F.lit(None).cast("long").alias("arrival_us"), F.lit(None).cast("double").alias("value"))
    data = F.struct(F.lit(None).cast("timestamp").alias("clock"), "category", "day", part.alias("slice"), "id", "event_us", F.unix_micros("arrival").alias("arrival_us"), "value")
    both = told.select(F.explode(F.array(clock, data)).alias("r")).select("r.*").withWatermark("clock", disorder)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, day_, slice_ = key
        rows: list[dict] = []
        if day_ is None or day_ != day_:
            for _ in batches:
                pass
            return
        base = {"category": None if name is None or name != name else name, "day": int(day_), "slice": int(slice_)}
        end_us, closes_us = (int(day_) + 1) * DAY_US, (int(day_) + 1) * DAY_US + slack_us
        held: dict[str, tuple[int, int, float | None]] = {}
        published = (0.0, 0.0, 0.0)
        if state.exists:
            ids, events, arrivals, amounts, last = state.get
            published = tuple(last)
            held = {i: (int(a), int(e), None if v is None or v != v else float(v)) for i, e, a, v in zip(ids, events, arrivals, amounts, strict=True)}
        closed = state.hasTimedOut or state.getCurrentWatermarkMs() >= closes_us // 1000
        if not state.hasTimedOut:
            for batch in batches:
                for i, e, a, v in zip(batch["id"], batch["event_us"], batch["arrival_us"], batch["value"], strict=True):
                    one = (int(a), int(e), None if v != v or v is None else float(v))
                    if one[0] >= closes_us or closed:
                        if i not in held:
                            rows.append({**base, "stage": "fate", "id": i, "fate": TOO_LATE if one[0] >= closes_us else REFUSED})
                    elif i not in held or one[:2] < held[i][:2]:
                        held[i] = one
        if closed and held:
            buffer, totals = SlackBuffer(end_us, slack_us), OrderedTotals()
            for i, (a, e, v) in held.items():
                if buffer.offer(e, a, i, v) == CORRECTS:
                    rows.append({**base, "stage": "fate", "id": i, "fate": CORRECTS})
            for e, _, v in buffer.release():
                totals.add(e, v)
            (first_us, first), (last_us, last) = totals.first or (None, None), totals.last or (None, None)
            rows.append({**base, "stage": "final", "n": totals.n, "n_value": totals.n_value, "total": totals.total, "first_us": first_us, "first_value": first, "last_us": last_us, "last_value": last})
            if state.exists:
                state.remove()
        elif held:
            values = [v for _, _, v in held.values() if v is not None]
            now = (float(len(held)), float(len(values)), float(sum(values)))
            if now != published:
                rows.append({**base, "stage": "provisional", "n": int(now[0] - published[0]), "n_value": int(now[1] - published[1]), "total": now[2] - published[2]})
            state.update((list(held), [e for _, e, _ in held.values()], [a for a, _, _ in held.values()], [v for _, _, v in held.values()], list(now)))
            state.setTimeoutTimestamp(closes_us // 1000)
        if rows:
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in ("day", "slice", "n", "n_value", "first_us", "last_us")})

    return both.groupBy("category", "day", "slice").applyInPandasWithState(step, SLACK_OUT, SLACK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def slack_periods(out: DataFrame) -> DataFrame:
    """Final totals of each category and day: the parts of its slices put together in event-time order."""
    first = F.min(F.when(F.col("first_us").isNotNull(), F.struct("first_us", "first_value")))
    last = F.max(F.when(F.col("last_us").isNotNull(), F.struct("last_us", "last_value")))
    return (
        out.where("stage = 'final'").groupBy("category", "day").agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.sum("total").alias("total"), first.alias("f"), last.alias("l"))
        .select("category", "day", "n", "n_value", (F.col("total") / F.when(F.col("n_value") > 0, F.col("n_value"))).alias("mean"), F.col("f.first_value").alias("first_value"), F.col("l.last_value").alias("last_value"))
    )


def slack_fates(out: DataFrame) -> DataFrame:
    """(id, fate) of what came late; an id told more than once by the best of its fates."""
    order = F.when(F.col("fate") == CORRECTS, 0).when(F.col("fate") == TOO_LATE, 1).otherwise(2)
    return out.where("stage = 'fate'").groupBy("id").agg(F.min_by("fate", order).alias("fate"))


def append_revisions(root: str, keys: list[str], semantic: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: what changed in meaning is appended with the next revision number, nothing is updated.

    A batch that is replayed finds its rows there and adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            tip = latest(spark.read.parquet(root).select(*keys, "revision_seq", "revision_id", *semantic), keys, "revision_seq")
        else:
            kinds = {f.name: f.dataType.simpleString() for f in batch.schema}
            tip = spark.createDataFrame([], ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", revision_seq int, revision_id string, " + ", ".join(f"`{c}` {kinds[c]}" for c in semantic))
        fresh = revise(tip, newest, keys, semantic, id="revision_id").withColumn("revision_seq", F.col("revision_seq").cast("int"))
        fresh.withColumn("revision_id", F.sha2(F.to_json(F.struct(*keys, "revision_seq", *semantic)), 256)).write.mode("append").parquet(root)

    return write


def matured(stream: DataFrame, forecasts: DataFrame, resolved: DataFrame, keys: list[str], target: str, time: str) -> DataFrame:
    """Observations joined with the forecasts that wait for them: due by ``time`` and not resolved before."""
    waiting = forecasts.join(resolved.select(*keys), keys, "left_anti")
    return stream.join(waiting, keys).where(F.col(target) <= F.col(time))


MONITOR_OUT = "key string, order_no long, ratio double, alarms int"


def monitor(stream: DataFrame, key: str, order: str, ratio: str, weight: float = 0.15, limit: float = 1.0) -> DataFrame:
    """An exponentially weighted ratio per key and how many times in a row it has been above the limit."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, alarms, has = state.get if state.exists else (0.0, 0, False)
        out = []
        for batch in batches:
            for at, x in batch.sort_values(order)[[order, ratio]].itertuples(index=False):
                level, has = (weight * x + (1 - weight) * level if has else x), True
                alarms = alarms + 1 if level > limit else 0
                out.append((k[0], int(at), float(level), int(alarms)))
        state.update((float(level), int(alarms), has))
        yield pd.DataFrame(out, columns=["key", "order_no", "ratio", "alarms"])

    return stream.groupBy(key).applyInPandasWithState(step, MONITOR_OUT, "level double, alarms int, has boolean", "append", GroupStateTimeout.NoTimeout)
