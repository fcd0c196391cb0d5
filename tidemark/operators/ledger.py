"""Append-only ledgers: unique appends, revisions, corrections, changes and quarantine. Nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    """SHA-256 of a canonical text of the columns: names in order, nulls told from empty text."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def append_unique(ledger: DataFrame, incoming: DataFrame, id: str, body: list[str]) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """(rows to append, conflicts): known ids with the same body are skipped, with another body a conflict."""
    known = ledger.select(id, row_hash(*body).alias("_known"))
    hashed = incoming.withColumn("_hash", row_hash(*body))
    fresh = hashed.join(known, id, "left_anti").groupBy(id).agg(F.min(F.struct("_hash", *(c for c in incoming.columns if c != id))).alias("r"), F.count_distinct("_hash").alias("_bodies"))
    new = fresh.where("_bodies = 1").select(id, "r.*").select(*incoming.columns)
    conflicts = hashed.join(known, id).where("_hash != _known").select(id).unionByName(fresh.where("_bodies > 1").select(id)).distinct()
    return new, conflicts


def revise(latest: DataFrame, incoming: DataFrame, keys: list[str], semantic: list[str], *, id: str) -> DataFrame:  # noqa: A002
    """The revisions to append: unchanged meaning is skipped, changed gets seq + 1 and supersedes the latest id."""
    old = latest.select(*keys, F.col(id).alias("_id"), F.col("revision_seq").alias("_seq"), F.struct(*semantic).alias("_was"))
    both = incoming.join(old, keys, "left")
    changed = F.col("_id").isNull() | ~F.struct(*semantic).eqNullSafe(F.col("_was"))
    return both.where(changed).select(*incoming.columns, F.coalesce(F.col("_seq") + 1, F.lit(0)).alias("revision_seq"), F.col("_id").alias("supersedes"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows replace or join the old ones, by key; of repeated new rows the greatest."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_p", *rest)).alias("r")).select(*keys, "r.*").select(*old.columns)


def line_changes(before: DataFrame, now: DataFrame, line: str, hash: str) -> DataFrame:  # noqa: A002
    """Lines of a ledger that vanished, changed or came: (line, change)."""
    b, n = before.select(F.col(line), F.col(hash).alias("_b")), now.select(F.col(line), F.col(hash).alias("_n"))
    change = F.when(F.col("_n").isNull(), "removed").when(F.col("_b").isNull(), "added").when(F.col("_b") != F.col("_n"), "changed")
    return b.join(n, line, "full").select(line, change.alias("change")).where("change IS NOT NULL")


def overlay_corrections(rows: DataFrame, corrections: DataFrame, id: str, fields: list[str]) -> DataFrame:  # noqa: A002
    """Rows read through their latest approved corrections: one pivot and one join for all fields.

    ``corrections``: id, field, new_value (text), approved_at, status.
    """
    approved = corrections.where("status = 'approved'").groupBy(id).agg(*(F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, F.col("approved_at"))).alias(f"_{f}") for f in fields))
    joined = rows.join(approved, id, "left")
    return joined.select(*((F.coalesce(F.col(f"_{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c)) for c in rows.columns))


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reasons``): a rule that isn't true, null included, is a reason."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    judged = rows.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def healthy_tail(receipts: DataFrame, key: str, day: str, healthy: str) -> DataFrame:
    """How many of a key's last receipts in a row are healthy."""
    last_bad = receipts.groupBy(key).agg(F.max(F.when(~F.col(healthy), F.col(day))).alias("_bad"))
    return receipts.join(last_bad, key).groupBy(key).agg(F.sum(F.when(F.col("_bad").isNull() | (F.col(day) > F.col("_bad")), 1).otherwise(0)).alias("tail"))


def calendar_gaps(days: DataFrame, key: str, day: str) -> DataFrame:
    """Weekdays between a key's first and last day on which it has no row."""
    span = days.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    every = span.select(key, F.explode(F.sequence("a", "b")).alias(day)).where(F.weekday(day) < 5)
    return every.join(days.select(key, day).distinct(), [key, day], "left_anti")


def first_of(*pairs: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def running_latch(df: DataFrame, keys: list[str], order: str, on: Column, off: Column) -> Column:
    """A state that is set by ``on``, cleared by ``off`` and kept between."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(w), F.lit(False))
