"""Indicators over ordered series. Frames are full or null; every window is partitioned by series."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class Series:
    """Column makers for one ordered series per key."""

    def __init__(self, keys: list[str], order: str) -> None:
        self.keys, self.order = keys, order

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c: Column, k: int = 1) -> Column:
        return F.lag(c, k).over(self.w)

    def change(self, c: Column, k: int = 1) -> Column:
        return c / self.lag(c, k) - 1

    def log_change(self, c: Column, k: int = 1) -> Column:
        """Null where a value isn't positive."""
        y = F.when(c > 0, F.log(c))
        return y - self.lag(y, k)

    def rolling(self, f: Callable[[Column], Column], c: Column, n: int, full: bool = True) -> Column:
        """An aggregate over the last ``n`` rows; null until there are ``n`` values, unless ``full`` is off."""
        frame = self.w.rowsBetween(-(n - 1), 0)
        value = f(c).over(frame)
        return F.when(F.count(c).over(frame) == n, value) if full else value

    def drawdown(self, c: Column) -> Column:
        return c / F.max(c).over(self.so_far) - 1

    def known(self, c: Column) -> Column:
        """The last value that isn't null."""
        return F.last(c, ignorenulls=True).over(self.so_far)

    def number(self) -> Column:
        return F.row_number().over(self.w)


def decayed(df: DataFrame, keys: list[str], order: str, amount: Column, decay: float, out: str, *, stretch: int | None = None) -> DataFrame:
    """The rows with y = decay * y before + amount (null: none) along each key's order, y beginning at 0.

    A linear recursion has a closed form: within a stretch of rows y is decay^j times the running
    sum of amount / decay^j, and a stretch passes its last y on to the next. Stretches are so long
    that decay over one is 1e-100, so what lies before the one before is beyond a double's
    digits (give ``stretch`` only as a multiple of that, or a decay that vanishes over it).
    Running sums only: no array is kept, a key's rows may spill.
    """
    m = stretch or max(1, int(230 / -math.log(decay)))
    w = Window.partitionBy(*keys).orderBy(order)
    no = df.withColumn("_no", F.row_number().over(w) - 1).withColumn("_s", F.expr(f"_no div {m}")).withColumn("_j", F.pmod("_no", F.lit(m)))
    inside = Window.partitionBy(*keys, "_s").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda e: F.pow(F.lit(float(decay)), e)
    local = no.withColumn("_y", power(F.col("_j")) * F.sum(F.coalesce(amount, F.lit(0.0)) * power(-F.col("_j"))).over(inside))
    ends = local.where(F.col("_j") == m - 1).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.col("_s") + 1).alias("_next"), F.col("_y").alias("_end"))
    on = F.col("_s") == F.col("_next")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(ends, on, "left").select(*df.columns, (F.col("_y") + power(F.col("_j") + 1) * F.coalesce("_end", F.lit(0.0))).alias(out))


def rsi(df: DataFrame, keys: list[str], order: str, close: str, n: int = 14) -> DataFrame:
    """Wilder's RSI: seeded by the mean of the first ``n`` changes, first value one row later, 100 without falls.

    A change from or to a missing close is none.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce(F.col("_c") - F.lag("_c").over(w), F.lit(0.0))
    rows = df.select(*keys, order, F.col(close).alias("_c")).withColumn("_at", F.row_number().over(w) - 1).withColumn("_d", change)
    first = F.col("_at").between(1, n)
    for name, part in (("_g", F.greatest(F.col("_d"), F.lit(0.0))), ("_l", F.greatest(-F.col("_d"), F.lit(0.0)))):
        seed = F.sum(F.when(first, part / n)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(f"{name}in", F.when(F.col("_at") == n, seed).when(F.col("_at") > n, part / n))
        rows = decayed(rows, keys, order, F.col(f"{name}in"), (n - 1) / n, name)
    value = F.when(F.col("_at") > n, F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l"))))
    return rows.select(*keys, order, value.alias("rsi"))


def ewma_variance(df: DataFrame, keys: list[str], order: str, returns: str, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted variance: the first square, then decay * v + (1 - decay) * r^2; a missing return has none and begins anew."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, F.col(returns).alias("_r"))
    rows = rows.withColumn("_gap", F.sum(F.col("_r").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_null", F.col("_r").isNull())
    square = F.col("_r") * F.col("_r")
    opening = F.lag("_null", 1, True).over(w)
    got = decayed(rows.withColumn("_in", F.when(opening, square).otherwise((1 - decay) * square)), [*keys, "_gap"], order, F.col("_in"), decay, "_v")
    return got.select(*keys, order, F.when(~F.col("_null"), F.col("_v")).alias("variance"))


def correction_episodes(month_ends: DataFrame, keys: list[str], order: str, close: str, threshold: float = -0.05) -> DataFrame:
    """Falls from a running peak of at least ``threshold``: peak, trough and recovery.

    A block begins at each strict running maximum; its trough is the first minimum after
    it; the next block's begin is the recovery, null if there is none yet.
    """
    s = Series(keys, order)
    before = F.max(close).over(s.w.rowsBetween(Window.unboundedPreceding, -1))
    blocks = month_ends.withColumn("_new", (before.isNull() | (F.col(close) > before)).cast("int")).withColumn("_block", F.sum("_new").over(s.so_far))
    per = blocks.groupBy(*keys, "_block").agg(F.min(F.struct(order, close)).alias("p"), F.min(F.struct(F.col(close), F.col(order))).alias("t"))
    linked = per.withColumn("recovered", F.lead(F.col(f"p.{order}")).over(Window.partitionBy(*keys).orderBy("_block")))
    depth = F.col(f"t.{close}") / F.col(f"p.{close}") - 1
    return linked.where(depth <= threshold).select(*keys, F.col(f"p.{order}").alias("peak"), F.col(f"t.{order}").alias("trough"), depth.alias("depth"), "recovered")


def greedy_gap(candidates: DataFrame, keys: list[str], day: str, distance: str, k: int, gap_days: int) -> DataFrame:
    """The ``k`` nearest candidates per key, each at least ``gap_days`` from those taken before.

    The walk over the candidates by distance runs inside the engine, over one array per
    key: for candidates of at most one per day (the best of each day is taken first).
    """
    daily = candidates.groupBy(*keys, day).agg(F.min(distance).alias(distance))
    candidates = daily.where(F.col(distance).isNotNull() & F.col(day).isNotNull())
    ordered = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(distance).alias("d"), F.col(day).alias("t")))).alias("xs"))
    step = f"CASE WHEN size(s) >= {k} OR exists(s, y -> abs(datediff(y.t, x.t)) < {gap_days}) THEN s ELSE array_append(s, x) END"
    kind = candidates.select(F.struct(F.col(distance).alias("d"), F.col(day).alias("t")).alias("x")).schema["x"].dataType.simpleString()
    picked = F.expr(f"aggregate(xs, cast(array() as array<{kind}>), (s, x) -> {step})")
    return ordered.select(*keys, F.posexplode(picked).alias("rank", "p")).select(*keys, (F.col("rank") + 1).alias("rank"), F.col("p.t").alias(day), F.col("p.d").alias(distance))


def runs(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Stretches of one label: (keys, label, begin, end, length)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    numbered = df.withColumn("_run", F.sum(F.when(first, 0).otherwise(changed)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run", label).agg(F.min(order).alias("begin"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")
