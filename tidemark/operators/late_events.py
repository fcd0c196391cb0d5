"""Per-period aggregates by event time, corrected while late records still arrive."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_US

ON_TIME, CORRECTS, TOO_LATE = "on_time", "corrects", "too_late"
KINDS = {"fate": 0, "provisional": 1, "final": 2}
OUT = "kind int, id string, category string, day int, fate string, at_us long, n long, n_value long, total double, first_us long, first_value double, last_us long, last_value double"


class SlackBuffer:
    """The reordering buffer of one category and period.

    Arrivals come in arrival order. Until ``end_us`` they are on time, until
    ``end_us + slack_us`` they correct, after that they are refused. What was accepted
    waits in a heap by event time; :meth:`release` hands it out sorted.
    """

    def __init__(self, end_us: int, slack_us: int) -> None:
        self.end_us, self.closes_us = end_us, end_us + slack_us
        self.heap: list[tuple[int, str, float | None]] = []
        self.n_value, self.total = 0, 0.0

    def offer(self, event_us: int, arrival_us: int, id_: str, value: float | None) -> str:
        if arrival_us >= self.closes_us:
            return TOO_LATE
        heapq.heappush(self.heap, (event_us, id_, value))
        if value is not None:
            self.n_value += 1
            self.total += value
        return ON_TIME if arrival_us < self.end_us else CORRECTS

    def provisional(self) -> tuple[int, int, float]:
        """Count, count of values and their sum over what the buffer holds now."""
        return len(self.heap), self.n_value, self.total

    def release(self) -> Iterator[tuple[int, str, float | None]]:
        while self.heap:
            yield heapq.heappop(self.heap)


class OrderedTotals:
    """The final aggregation: takes events in event-time order only."""

    def __init__(self) -> None:
        self.n = self.n_value = 0
        self.total = 0.0
        self.first: tuple[int, float] | None = None
        self.last: tuple[int, float] | None = None

    def add(self, event_us: int, value: float | None) -> None:
        self.n += 1
        if value is not None:
            self.n_value += 1
            self.total += value
            self.first = self.first or (event_us, value)
            self.last = (event_us, value)


def _replay(slack_us: int, publish_us: int, all_fates: bool):
    """Over batches sorted by (category, day, slice, arrival): fates, provisional values, final parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.split(", ")]
        types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUT.split(", ")]
        rows: list[tuple] = []
        state: tuple | None = None
        buffer: SlackBuffer | None = None
        due = 0

        def publish(until: int | None) -> None:
            """What the buffer gained, at each publishing moment up to ``until`` at which it gained."""
            nonlocal due
            while due <= buffer.closes_us and (until is None or until >= due):
                now = buffer.provisional()
                if now[0] != publish.last[0]:
                    rows.append((KINDS["provisional"], None, state[0], state[1], None, due, *(a - b for a, b in zip(now, publish.last, strict=True)), None, None, None, None))
                    publish.last = now
                due += publish_us
                if until is None:
                    break

        def close() -> None:
            if buffer is None:
                return
            publish(None)
            totals = OrderedTotals()
            for event_us, _, value in buffer.release():
                totals.add(event_us, value)
            if totals.n:
                rows.append((KINDS["final"], None, state[0], state[1], None, buffer.closes_us, totals.n, totals.n_value, totals.total, *(totals.first or (None, None)), *(totals.last or (None, None))))

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows.clear()

        for batch in batches:
            for category, day, part, arrival, event_us, id_, value in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if state != (category, day, part):
                    close()
                    state, buffer = (category, day, part), SlackBuffer((day + 1) * DAY_US, slack_us)
                    due, publish.last = buffer.end_us, (0, 0, 0.0)
                publish(arrival)
                fate = buffer.offer(event_us, arrival, id_, value)
                if all_fates or fate != ON_TIME:
                    rows.append((KINDS["fate"], id_, category, day, fate, arrival, None, None, None, None, None, None, None))
            yield from flush()
        close()
        yield from flush()

    return run


def kslack_replay(events: DataFrame, *, id: str, category: str, event_us: str, arrival_us: str, value: str, slack_us: int, publish_us: int = DAY_US, slice_rows: int = 200_000, all_fates: bool = True) -> DataFrame:  # noqa: A002
    """Replay deliveries in arrival order through one slack buffer per category and UTC day of event time.

    Each id arrives once, at its earliest delivery. The buffer of a period takes arrivals
    until ``slack_us`` after the period's end, publishes provisional values at the
    period's end and every ``publish_us`` after it while they change, and then releases
    the events sorted by event time into the final, order-sensitive totals.

    A period with more than ``slice_rows`` ids is split by a hash of the id into as many
    slices as needed, each with its own buffer; :func:`periods` puts the parts together.
    So a buffer holds about ``slice_rows`` events at most, whatever a period's share.

    Result (see ``OUT``): ``kind`` 0 one row per id with its fate (without ``all_fates`` only ids that came late); 1 what a buffer gained by
    a publishing moment; 2 final parts. Defined cases: rows whose id, event time or arrival is null belong to no
    period and are left out; a null category is one like any other; a null value counts in
    ``n`` only; of repeated ids the earliest delivery counts (of equal ones the least by
    event time, category and value); no rows give no rows.
    """
    narrow = events.select(F.col(id).cast("string").alias("id"), F.col(category).alias("category"), F.col(event_us).alias("event_us"), F.col(arrival_us).alias("arrival_us"), F.col(value).cast("double").alias("value"))
    once = (
        narrow.where("id IS NOT NULL AND event_us IS NOT NULL AND arrival_us IS NOT NULL")
        .groupBy("id").agg(F.min(F.struct("arrival_us", "event_us", "category", "value")).alias("r"))
        .select("id", "r.*").withColumn("day", F.expr(f"cast(floor(event_us / {DAY_US}) AS int)"))
    )
    hot = once.groupBy("category", "day").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > slice_rows).select(F.col("category").alias("hot_category"), F.col("day").alias("hot_day"), F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices"))
    placed = once.join(hot, F.col("category").eqNullSafe(F.col("hot_category")) & (F.col("day") == F.col("hot_day")), "left").withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).otherwise(0))
    ordered = placed.select("category", "day", "slice", "arrival_us", "event_us", "id", "value").repartition("category", "day", "slice").sortWithinPartitions("category", "day", "slice", "arrival_us", "event_us", "id")
    return ordered.mapInArrow(_replay(slack_us, publish_us, all_fates), OUT)


def fates(replayed: DataFrame, id_name: str) -> DataFrame:
    """Every id with the fate of its arrival."""
    return replayed.where(f"kind = {KINDS['fate']}").select(F.col("id").alias(id_name), F.col("category"), F.col("day"), F.col("at_us").alias("arrival_us"), "fate")


def periods(replayed: DataFrame) -> DataFrame:
    """Final totals of each category and day: the parts of its slices put together in event-time order."""
    first = F.min(F.when(F.col("first_us").isNotNull(), F.struct("first_us", "first_value")))
    last = F.max(F.when(F.col("last_us").isNotNull(), F.struct("last_us", "last_value")))
    return (
        replayed.where(f"kind = {KINDS['final']}").groupBy("category", "day")
        .agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.sum("total").alias("total"), first.alias("f"), last.alias("l"))
        .select("category", "day", "n", "n_value", (F.col("total") / F.when(F.col("n_value") > 0, F.col("n_value"))).alias("mean"), F.col("f.first_value").alias("first_value"), F.col("l.last_value").alias("last_value"))
    )


def provisional(replayed: DataFrame) -> DataFrame:
    """The values published while a period was open: count, count of values and mean so far at each moment that brought news."""
    gained = replayed.where(f"kind = {KINDS['provisional']}").groupBy("category", "day", "at_us").agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.sum("total").alias("total"))
    so_far = Window.partitionBy("category", "day").orderBy("at_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = gained.select("category", "day", "at_us", *(F.sum(c).over(so_far).alias(c) for c in ("n", "n_value", "total")))
    return both.withColumn("mean", F.col("total") / F.when(F.col("n_value") > 0, F.col("n_value")))
