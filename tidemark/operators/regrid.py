"""Irregular readings onto a regular grid of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_number(day: Column, frequency: Column) -> Column:
    """Running number of the period of a day (days since 1970): D business day, W ISO week, M month, Q quarter.

    A Saturday or Sunday belongs to the Friday before. Null for other frequencies.
    """
    week = F.floor((day + 3) / 7)
    date = F.date_from_unix_date(day.cast("int"))
    return (
        F.when(frequency == "D", week * 5 + F.least(F.pmod(day + 3, F.lit(7)), F.lit(4)))
        .when(frequency == "W", week)
        .when(frequency == "M", F.year(date) * 12 + F.month(date) - 1)
        .when(frequency == "Q", F.year(date) * 4 + F.quarter(date) - 1)
    ).cast("long")


def period_start(number: Column, frequency: Column) -> Column:
    """First day of a numbered period, as a date."""
    on = lambda days: F.date_from_unix_date(days.cast("int"))
    month = lambda n: F.make_date(F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"), F.lit(1))
    return (
        F.when(frequency == "D", on(F.floor(number / 5) * 7 + F.pmod(number, F.lit(5)) - 3))
        .when(frequency == "W", on(number * 7 - 3))
        .when(frequency == "M", month(number))
        .when(frequency == "Q", month(number * 3))
    )


def regrid(readings: DataFrame, *, shard_periods: int = 64) -> DataFrame:
    """One row per period from an entity's first to its last reading, filled with the last known reading.

    ``readings``: entity, frequency, period (see :func:`period_number`), rank (orderable;
    of a period's readings the greatest by rank, then value, is its reading), value.
    An entity's time is cut into shards of ``shard_periods``. Each shard is summed up by
    its first and last reading; a prefix scan over an entity's summaries gives each shard,
    empty ones between too, the reading to begin with; then every shard is filled by
    itself. Readings are reduced to one per period before they are gathered, so a shard
    holds at most ``shard_periods`` of them, and only summaries are ordered per entity.

    Result: entity, frequency, period, period_start, value, missing (true: no reading in
    the period, the value is carried), carried_from (the period that the value is from).
    Defined cases: rows with a null entity, period or value are no readings; entities
    without a reading have no rows; entities are told apart by frequency as well.
    """
    e = ["entity", "frequency"]
    best = readings.where("entity IS NOT NULL AND period IS NOT NULL AND value IS NOT NULL").groupBy(*e, "period").agg(F.max(F.struct("rank", "value")).alias("r")).select(*e, "period", F.col("r.value").alias("value"))
    shards = (
        best.withColumn("shard", F.floor(F.col("period") / shard_periods)).groupBy(*e, "shard")
        .agg(F.min("period").alias("first"), F.max(F.struct("period", "value")).alias("last"), F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("known"))
    )
    order = Window.partitionBy(*e).orderBy("shard")
    # prefix scan: what the shard before ended with, and how far the entity's own shards go
    scanned = shards.withColumn("carry", F.lag("last").over(order)).withColumn("following", F.lead("shard").over(order))
    own = scanned.select(*e, "shard", "known", "carry", F.when(F.col("carry").isNull(), F.col("first")).otherwise(F.col("shard") * shard_periods).alias("lo"), F.when(F.col("following").isNull(), F.col("last.period")).otherwise((F.col("shard") + 1) * shard_periods - 1).alias("hi"))
    between = scanned.where("following > shard + 1").select(*e, F.explode(F.expr("sequence(shard + 1, following - 1)")).alias("shard"), F.expr("CAST(map() AS map<bigint, double>)").alias("known"), F.col("last").alias("carry"))
    empty = between.select(*e, "shard", "known", "carry", (F.col("shard") * shard_periods).alias("lo"), ((F.col("shard") + 1) * shard_periods - 1).alias("hi"))
    filled = own.unionByName(empty).select(
        *e,
        F.expr("""inline(aggregate(sequence(lo, hi),
            named_struct('at', carry, 'out', cast(array() AS array<struct<period: bigint, value: double, missing: boolean, carried_from: bigint>>)),
            (s, p) -> CASE WHEN map_contains_key(known, p)
                THEN named_struct('at', named_struct('period', p, 'value', known[p]), 'out', array_append(s.out, named_struct('period', p, 'value', known[p], 'missing', false, 'carried_from', p)))
                ELSE named_struct('at', s.at, 'out', array_append(s.out, named_struct('period', p, 'value', s.at.value, 'missing', true, 'carried_from', s.at.period))) END,
            s -> s.out))"""),
    )
    return filled.select(*e, "period", period_start(F.col("period"), F.col("frequency")).alias("period_start"), "value", "missing", "carried_from")
