"""Point-in-time reads of bitemporal facts: nothing later than T is ever seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def knowable(t: Column, *, available: str = "vintage_start", start: str = "vintage_start", end: str = "vintage_end", observed: str | None = None, market_date: Column | None = None) -> Column:
    """Was the fact known and current at ``t``? The end of a vintage is exclusive."""
    ok = (F.col(available) <= t) & (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))
    if market_date is not None:
        ok = ok & (F.col(observed) <= market_date)
    return ok


def as_of(facts: DataFrame, t: Column, *, keys: list[str], market_date: Column | None = None, observed: str = "observation_date") -> DataFrame:
    """The facts current at ``t``, one per key: the latest vintage."""
    known = facts.where(knowable(t, observed=observed, market_date=market_date))
    return latest(known, keys, "vintage_start")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``; combined before the shuffle, so hot keys are no burden."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)


def leaks(facts: DataFrame, t: Column, available: str = "vintage_start") -> DataFrame:
    """Rows known only after ``t``; must be empty."""
    return facts.where(F.col(available) > t)


def assert_no_leakage(facts: DataFrame, t: Column, available: str = "vintage_start") -> None:
    if leaks(facts, t, available).limit(1).count():
        raise ValueError("facts later than the cut-off")


def close_intervals(facts: DataFrame, keys: list[str], start: str = "vintage_start", end: str = "vintage_end") -> DataFrame:
    """Open vintages end where the next one of their key starts."""
    w = Window.partitionBy(*keys).orderBy(start)
    return facts.withColumn(end, F.coalesce(F.col(end), F.lead(start).over(w)))


def chain_errors(rows: DataFrame, keys: list[str], *, id: str, seq: str, supersedes: str) -> DataFrame:  # noqa: A002
    """Revisions that break their chain: a step of seq other than 1, or a wrong predecessor."""
    w = Window.partitionBy(*keys).orderBy(seq, id)
    known = rows.withColumn("prior_seq", F.lag(seq).over(w)).withColumn("prior_id", F.lag(id).over(w))
    gap = F.col(seq) != F.coalesce(F.col("prior_seq") + 1, F.lit(0))
    wrong = ~F.col(supersedes).eqNullSafe(F.col("prior_id"))
    return known.where(gap | wrong).withColumn("reason", F.when(gap, "seq").otherwise("supersedes"))


def revisions_at_cutoffs(facts: DataFrame, *, keys: list[str], cutoff_of: Column, next_cutoff: Column, last_cutoff: Column) -> DataFrame:
    """Each revision at every cutoff number at which it is the current one of its period.

    Cutoffs are a regular grid, so the numbers come from arithmetic instead of a range join:
    ``cutoff_of`` is the first cutoff number at or after the revision's start,
    ``next_cutoff`` that of its end (exclusive), ``last_cutoff`` where open ones stop.
    """
    upto = F.coalesce(next_cutoff - 1, last_cutoff)
    return facts.where(cutoff_of <= upto).withColumn("cutoff", F.explode(F.sequence(cutoff_of, upto)))
