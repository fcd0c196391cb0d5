"""Pairing records of two tables by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def nearest_in_time(left: DataFrame, right: DataFrame, *, key: str, time: str, left_id: str, right_id: str, tolerance_us: int, bucket_us: int = 3_600_000_000, bucket_rows: int = 200_000) -> DataFrame:
    """For each left row the right row of the same key nearest in time, if within the tolerance.

    ``time`` is in microseconds on both sides. Both tables are put together and sorted per
    key and time; the last right row before and the next one after are carried onto each
    left row and the nearer is taken, of two equally near the earlier.
    A key may hold any share of the rows: the sort runs per key and time bucket, and a
    right row within the tolerance of a bucket's edge is also copied into the bucket
    beyond, so no bucket needs another. ``bucket_us`` must be at least the tolerance. Buckets
    with more than ``bucket_rows`` rows are cut as many times finer, down to the tolerance.

    Result: ``left_id``, ``right_id``, ``gap_us`` (right minus left).
    Defined cases: rows with a null key, time or id pair with nothing. Rows of a side that
    repeat an id at the same time count once. Of right rows at the same time the lowest id
    is taken. Either side may be empty. Further columns are ignored.
    """
    if bucket_us < tolerance_us:
        raise ValueError("bucket_us must be at least tolerance_us")
    at = lambda t: F.floor(t / bucket_us)
    usable = "k IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL"
    l = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), F.col(left_id).alias("id")).where(usable).withColumnRenamed("id", "l")  # noqa: E741
    r = right.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(0).alias("side"), F.col(right_id).alias("id")).where(usable).withColumnRenamed("id", "r")
    # narrow rows, counted and placed: checkpointed, so that their times are read once
    rows = cut_lineage(l.unionByName(r, allowMissingColumns=True))
    dense = rows.groupBy("k", at(F.col("t")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    dense = dense.select("k", "bucket", F.least(F.ceil(F.col("n") / bucket_rows), F.lit(max(1, bucket_us // max(1, tolerance_us)))).alias("cuts"))
    around = F.array_distinct(F.array(at(F.col("t")), at(F.col("t") - tolerance_us), at(F.col("t") + tolerance_us)))
    spread = rows.withColumn("bucket", F.explode(F.when(F.col("side") == 1, F.array(at(F.col("t")))).otherwise(around))).join(dense, ["k", "bucket"], "left")
    fine = lambda t: F.floor((F.least(F.greatest(t - F.col("bucket") * bucket_us, F.lit(0)), F.lit(bucket_us - 1))) * F.col("cuts") / bucket_us)
    cells = F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("side") == 1, F.array(fine(F.col("t")))).otherwise(F.sequence(fine(F.col("t") - tolerance_us), fine(F.col("t") + tolerance_us)))
    both = spread.withColumn("cell", F.explode(cells))
    own = F.when(F.col("side") == 0, F.struct("t", F.col("r").alias("id")))
    forth = Window.partitionBy("k", "bucket", "cell").orderBy("t", "side", F.col("r").desc(), "l")
    back = Window.partitionBy("k", "bucket", "cell").orderBy(F.col("t").desc(), F.col("side").desc(), F.col("r").desc(), "l")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (
        both.withColumn("before", F.last(own, ignorenulls=True).over(so_far(forth)))
        .withColumn("again", F.coalesce((F.lag("l").over(forth) == F.col("l")) & (F.lag("t").over(forth) == F.col("t")), F.lit(False)))
        .withColumn("after", F.last(own, ignorenulls=True).over(so_far(back)))
        .where("side = 1 AND NOT again")
    )
    gap_b, gap_a = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    first = gap_b.isNotNull() & (gap_a.isNull() | (gap_b <= gap_a))
    pick = F.when(first, F.col("before")).otherwise(F.col("after"))
    return (
        carried.select(F.col("l").alias(left_id), pick["id"].alias(right_id), (pick["t"] - F.col("t")).alias("gap_us"))
        .where(F.abs("gap_us") <= tolerance_us)
    )
