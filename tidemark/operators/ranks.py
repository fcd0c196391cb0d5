"""Order statistics of groups of any size: quantiles, running totals and row numbers that no task finds alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _same(keys: Sequence[str], others: Sequence[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, others, strict=True)]


def _beside(rows: DataFrame, groups: DataFrame, on: list[Column]) -> DataFrame:
    """The rows with what is known of their group; without keys that is one row for all."""
    return rows.join(groups, on) if on else rows.crossJoin(F.broadcast(groups))


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, levels: Sequence[float], *, accuracy: int = 10_000, whole: int = 40_000) -> DataFrame:
    """Exact quantiles per group, linear between neighbours: (keys..., n, q), ``q`` in the order of ``levels``.

    A mergeable sketch brackets each level's place; all values outside the brackets are only
    counted, so of a group of any size the sort sees a few ten-thousandths (groups with up
    to ``whole`` values are sorted as they are). The sketch chooses what is sorted, never the result.
    Defined cases: nulls have no rank, NaN ranks last; a group without values gives no row;
    null keys are a group; ties and repeated rows count each.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    v = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v IS NOT NULL")
    eps = 2 / accuracy
    sketch = lambda sign: F.percentile_approx("_v", [min(1.0, max(0.0, p + sign * eps)) for p in levels], accuracy)
    group = [f"_g{i}" for i in range(len(keys))]
    cuts = v.groupBy(*(F.col(n).alias(g) for n, g in zip(names, group, strict=True))).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch(-1).alias("_lo"), sketch(1).alias("_hi"))
    ends = lambda c, end, ps: F.transform(c, lambda x, i: F.when((F.col("_n") <= whole) | F.element_at(F.array(*(F.lit(b) for b in ps)), i + 1), F.col(end)).otherwise(x))
    cuts = cuts.withColumn("_lo", ends("_lo", "_least", [p <= eps for p in levels])).withColumn("_hi", ends("_hi", "_most", [p >= 1 - eps for p in levels]))
    placed = _beside(v, cuts, _same(names, group))
    inside = F.exists(F.arrays_zip(F.col("_lo").alias("lo"), F.col("_hi").alias("hi")), lambda b: F.col("_v").between(b["lo"], b["hi"]))
    # a value outside goes by the bracket below it
    below = F.coalesce(F.array_max(F.filter("_hi", lambda x: x < F.col("_v"))), F.lit(float("-inf")))
    counted = placed.groupBy(*names, F.when(inside, F.col("_v")).otherwise(below).alias("_x"), (~inside).alias("_out")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*names).orderBy("_x", "_out").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_last", F.sum("_c").over(upto)).withColumn("_first", F.col("_last") - F.col("_c"))
    at = lambda k: F.max(F.when((F.col("_first") <= k) & (k < F.col("_last")) & ~F.col("_out"), F.col("_x")))

    def quantile(p: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(h)
        return F.struct(at(low).alias("a"), at(F.least(low + 1, F.col("_n") - 1)).alias("b"), F.max(h - low).alias("f"))

    found = ranked.groupBy(*names).agg(F.max("_n").alias("n"), *(quantile(p).alias(f"_q{i}") for i, p in enumerate(levels)))
    q = F.array(*(F.when(F.col(f"_q{i}.f") == 0, F.col(f"_q{i}.a")).otherwise(F.col(f"_q{i}.a") + F.col(f"_q{i}.f") * (F.col(f"_q{i}.b") - F.col(f"_q{i}.a"))) for i in range(len(levels))))
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "n", q.alias("q"))


def running_totals(df: DataFrame, keys: Sequence[str], value: str, amounts: Mapping[str, Column], *, cells: int = 200) -> DataFrame:
    """Per group and distinct value the sum of each amount, that of all lesser values, and that of all.

    Result: (keys..., value, and for each amount ``a`` the columns a, a_before, a_all). Values are
    combined first, cut into ``cells`` ranges at approximate quantiles, added up inside their
    range and moved on by the totals of the ranges before; the cuts only balance the work.
    Defined cases: null values are left out; null keys are a group; a null amount adds nothing.
    """
    group = [f"_g{i}" for i in range(len(keys))]
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*(F.coalesce(F.sum(a), F.lit(0)).alias(n) for n, a in amounts.items()))
    cuts = per.groupBy(*(F.col(k).alias(g) for k, g in zip(keys, group, strict=True))).agg(F.array_distinct(F.percentile_approx(value, [i / cells for i in range(1, cells)], 10_000)).alias("_cuts"))
    placed = _beside(per, cuts, _same(keys, group)).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts", *group)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    sums = placed.groupBy(*keys, "_cell").agg(*(F.sum(n).alias(f"_s_{n}") for n in amounts))
    offsets = sums.select(*(F.col(k).alias(g) for k, g in zip(keys, group, strict=True)), F.col("_cell").alias("_at"), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in amounts), *(F.sum(f"_s_{n}").over(every).alias(f"{n}_all") for n in amounts))
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *(F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_i_{n}") for n in amounts))
    both = local.join(offsets, [*_same(keys, group), F.col("_cell") == F.col("_at")])
    return both.select(*keys, value, *amounts, *((F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(f"{n}_before") for n in amounts), *(f"{n}_all" for n in amounts))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The rows with their number in their group, from 0, by ``order``; a group of any size is spread over ranges.

    Rows are sorted into ranges of (keys, order) and checkpointed, as the ranges must not
    be drawn twice; a range's rows are numbered from the counts of the ranges before it.
    Rows that tie in ``order`` are numbered in any order. Null keys are a group, nulls come first.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    group = [f"_g{i}" for i in range(len(keys))]
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*(F.col(k).alias(g) for k, g in zip(keys, group, strict=True)), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(offsets, [*_same(keys, group), F.col("_part") == F.col("_p")]).select(*df.columns, (F.col("_offset") + F.col("_at") - F.col("_first")).alias(name))


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, values: Mapping[str, Column], *, slice_rows: int = 100_000) -> DataFrame:
    """Aggregates over the last ``rows`` rows of a group, partial at its start, whatever its size.

    Rows are numbered (:func:`numbered`) and cut into slices of ``slice_rows``; each slice also
    holds copies of the rows before it that its first frames reach back to.
    """
    if rows > slice_rows:
        raise ValueError("a frame must fit into a slice")
    n = numbered(df, keys, order, "_no")
    own, inside = F.expr(f"_no div {slice_rows}"), F.pmod("_no", F.lit(slice_rows))
    spread = n.withColumn("_own", own).withColumn("_slice", F.explode(F.array_compact(F.array(own, F.when(inside > slice_rows - rows, own + 1)))))
    frame = Window.partitionBy(*keys, "_slice").orderBy("_no").rowsBetween(1 - rows, 0)
    return spread.select(*df.columns, "_own", "_slice", *(c.over(frame).alias(name) for name, c in values.items())).where("_own = _slice").drop("_own", "_slice")
