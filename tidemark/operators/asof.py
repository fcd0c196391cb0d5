"""As-of joins: the last (or next) right row at a left row's time, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import DAY_US


def ticks(df: DataFrame, name: str) -> Column:
    """A time column as a whole number: microseconds for timestamps and dates, itself for numbers."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long") * DAY_US
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("long")


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, forward: bool = False, shard: int = 30 * DAY_US, shard_rows: int = 1_000_000) -> DataFrame:
    """Every left row with ``values`` of the last right row at or before its time.

    ``strict`` asks for a time before, ``forward`` for the first at or after instead.
    Both sides are put together and the right values carried along in time order. A key's
    time is cut into shards; each shard's last right row, one small row per shard, is
    passed on by a prefix scan, so a key with any share of the rows spreads over its shards; a
    shard with more than ``shard_rows`` rows is cut into as many equal parts as that takes.

    Defined cases: left rows without a match, or with a null key or time, keep null
    values; right rows with a null key or time match nothing; of right rows at the same
    time the greatest by values counts; repeated left rows stay.
    """
    sign = -1 if forward else 1
    names = [f"b{i}" for i in range(len(by))]
    keys = lambda df: [F.col(b).alias(n) for b, n in zip(by, names, strict=True)]
    l = left.select(*keys(left), (sign * ticks(left, left_time)).alias("t"), F.lit(0 if strict else 1).alias("o"), F.struct(*(F.col(c) for c in left.columns)).alias("row"))  # noqa: E741
    usable = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, right_time)))
    r = usable.select(*keys(usable), (sign * ticks(usable, right_time)).alias("t"), F.lit(1 if strict else 0).alias("o"), F.struct(*(F.col(c) for c in values)).alias("v"))
    both = l.withColumn("v", F.lit(None).cast(r.schema["v"].dataType)).unionByName(r.withColumn("row", F.lit(None).cast(l.schema["row"].dataType))).withColumn("whole", F.floor(F.col("t") / shard))
    dense = both.groupBy(*names, "whole").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select(*(F.col(n).alias(f"d{n}") for n in names), F.col("whole").alias("dw"), F.ceil(F.col("n") / shard_rows).alias("cuts"))
    crowded = F.col("whole") == F.col("dw")
    for n in names:
        crowded = crowded & (F.col(n) == F.col(f"d{n}"))
    part = F.coalesce(F.floor((F.col("t") - F.col("whole") * shard) * F.col("cuts") / shard), F.lit(0))
    both = both.join(dense, crowded, "left").withColumn("s", F.struct("whole", part.alias("part"))).select(*names, "t", "o", "row", "v", "s")
    ends = both.groupBy(*names, "s").agg(F.max(F.when(F.col("v").isNotNull(), F.struct("t", "v"))).alias("last"))
    earlier = Window.partitionBy(*names).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*(F.col(n).alias(f"c{n}") for n in names), F.col("s").alias("cs"), F.last("last", ignorenulls=True).over(earlier)["v"].alias("carried"))
    w = Window.partitionBy(*names, "s").orderBy("t", "o", "v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.last("v", ignorenulls=True).over(w)).where("row IS NOT NULL")
    same = F.col("s") == F.col("cs")
    for n in names:
        same = same & (F.col(n) == F.col(f"c{n}"))
    joined = seen.join(carry, same, "left")
    return joined.select("row.*", *(F.coalesce("seen", "carried")[c].alias(c) for c in values))
