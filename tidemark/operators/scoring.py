"""Scores of probabilistic forecasts, as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import running_totals


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_score(p: Column, y: Column, eps: float = 1e-12) -> Column:
    """Mean negative log likelihood; probabilities are kept off 0 and 1 by ``eps``."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def pinball(level: Column, prediction: Column, actual: Column) -> Column:
    e = actual - prediction
    return F.greatest(level * e, (level - 1) * e)


def murphy(scored: DataFrame, bins: int = 10, p: str = "p", y: str = "outcome", digits: int = 8) -> DataFrame:
    """Reliability, resolution and uncertainty over equal bins of the probability."""
    per = scored.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.sum(y).alias("s"))
    every = Window.partitionBy(F.lit(1))  # a row per bin
    both = per.withColumn("base", F.sum("s").over(every) / F.sum("n").over(every))
    o, base = F.col("s") / F.col("n"), F.col("base")
    r = lambda c: F.round(c, digits)
    return both.agg(
        r(F.sum(F.col("n") * (F.col("p") - o) * (F.col("p") - o)) / F.sum("n")).alias("reliability"),
        r(F.sum(F.col("n") * (o - base) * (o - base)) / F.sum("n")).alias("resolution"),
        r(F.max(base) * (1 - F.max(base))).alias("uncertainty"),
    )


def average_ranks(df: DataFrame, column: str, name: str, cells: int = 200) -> DataFrame:
    """The rows with the average rank of ``column`` in ``name``, nulls left out; no task sees all values.

    Values are counted, cut into ``cells`` ranges at approximate quantiles (so many
    numbers come to the driver), ranked inside their range and moved on by the counts of
    the ranges before. The cuts only balance the work; the ranks are exact.
    """
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    cuts = per.agg(F.percentile_approx(column, [i / cells for i in range(1, cells)], 10_000)).first()[0] or []
    cell = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(column))) if cuts else F.lit(0)
    placed = per.withColumn("_cell", cell)
    before = F.sum("_m").over(Window.partitionBy(F.lit(1)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    offsets = placed.groupBy("_cell").agg(F.sum("_n").alias("_m")).select("_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_cell").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = placed.withColumn("_inside", inside).join(offsets, "_cell").select(column, (F.col("_before") + F.col("_inside") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, column)


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties: (rho, n); pairs with a null are left out."""
    whole = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    both = average_ranks(average_ranks(whole, x, "_a"), y, "_b")
    return both.agg(F.round(F.corr("_a", "_b"), 6).alias("rho"), F.count(F.lit(1)).alias("n"))


def crps(samples: DataFrame, keys: list[str], sample: str, actual: str) -> DataFrame:
    """Empirical CRPS per key in O(n log n): mean |x - y| less the mean pairwise distance from running totals; a key may have any number of samples.

    Samples or keys that are null are left out.
    """
    known = samples.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, sample)))
    t = running_totals(known, keys, sample, {"_c": F.lit(1)})
    # of c equal samples with b before them the ranks add up to c * (2 b + c - n) in the sum of (2 k - n - 1)
    ranks = F.col("_c") * (2 * F.col("_c_before") + F.col("_c") - F.col("_c_all"))
    spread = t.groupBy(*keys).agg((F.sum(ranks * F.col(sample)) / (F.max("_c_all") * F.max("_c_all"))).alias("_s"))
    near = known.groupBy(*keys).agg(F.avg(F.abs(F.col(sample) - F.col(actual))).alias("_d"), F.count(F.lit(1)).alias("n"))
    return near.join(spread, keys).select(*keys, (F.col("_d") - F.col("_s")).alias("crps"), "n")


def wilson(successes: Column, total: Column, z: float = 1.6448536269514722) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds; null without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def diebold_mariano(losses: DataFrame, keys: list[str], order: str, difference: str, lags: int) -> DataFrame:
    """Mean loss difference per key over its HAC standard error (Bartlett weights)."""
    mean = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(order)
    c = losses.withColumn("_m", F.avg(difference).over(mean)).withColumn("_d", F.col(difference) - F.col("_m"))
    for k in range(1, lags + 1):
        c = c.withColumn(f"_l{k}", F.col("_d") * F.lag("_d", k).over(w))
    n = F.count(F.lit(1))
    variance = F.sum(F.col("_d") * F.col("_d")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) / n
    return c.groupBy(*keys).agg(n.alias("n"), F.max("_m").alias("mean"), (F.max("_m") / F.sqrt(F.when(variance > 0, variance) / n)).alias("dm"))


def weighted_quantiles(values: DataFrame, keys: list[str], value: str, weight: str, levels: list[float]) -> DataFrame:
    """Quantiles at the midpoints of the cumulative weight, interpolated linearly, ends kept; groups may have any size."""
    at = running_totals(values, keys, value, {"_w": F.col(weight)}).withColumn("_c", (F.col("_w_before") + F.col("_w") / 2) / F.col("_w_all"))

    def quantile(q: float) -> Column:
        low, high = F.col("_c") <= q, F.col("_c") > q
        c0, c1, x0, x1 = F.max(F.when(low, F.col("_c"))), F.min(F.when(high, F.col("_c"))), F.max(F.when(low, F.col(value))), F.min(F.when(high, F.col(value)))
        return F.when(c0.isNull(), F.min(value)).when(c1.isNull(), F.max(value)).otherwise(x0 + (q - c0) / (c1 - c0) * (x1 - x0))

    return at.groupBy(*keys).agg(*(quantile(q).alias(f"q{round(q * 100):02d}") for q in levels))


def weighted_medoid(values: DataFrame, keys: list[str], id: str, value: str, weight: str) -> DataFrame:  # noqa: A002
    """(keys, id, centrality) of the row whose weighted distance to all others is least, from prefix sums instead of pairs; of ties the least id."""
    t = running_totals(values, keys, value, {"_w": F.col(weight), "_s": F.col(weight) * F.col(value)})
    x = F.col(value)
    after_w, after_s = F.col("_w_all") - F.col("_w_before") - F.col("_w"), F.col("_s_all") - F.col("_s_before") - F.col("_s")
    central = t.select(*keys, value, (x * F.col("_w_before") - F.col("_s_before") + after_s - x * after_w).alias("centrality"))
    least = central.groupBy(*keys).agg(F.min(F.round("centrality", 4)).alias("centrality"))
    # values as central as the best, up to rounding, then the least id among their rows
    best = central.withColumn("centrality", F.round("centrality", 4)).join(least, [*keys, "centrality"]).select(*keys, value, "centrality")
    return values.join(best, [*keys, value]).groupBy(*keys, "centrality").agg(F.min(id).alias(id))


def monotone(df: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Quantiles that cross are lifted to the greatest of the lower levels."""
    return df.withColumn(value, F.max(value).over(Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, within 7.5e-8 (no erf in the engine)."""
    # Coefficients of the published rational approximation.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    poly = sum((F.lit(c) * F.pow(t, F.lit(i + 1)) for i, c in enumerate(b)), F.lit(0.0))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def log_weights(l: Column, keys: list[str]) -> Column:  # noqa: E741
    """Weights that sum to one from logarithmic ones, safe for any size."""
    w = Window.partitionBy(*keys)
    top = F.max(l).over(w)
    return F.exp(l - top) / F.sum(F.exp(l - top)).over(w)


def gaussian_crps(mean: Column, sd: Column, actual: Column) -> Column:
    """CRPS of a normal forecast in closed form; spreads under 1e-8 count as that."""
    s = F.greatest(sd, F.lit(1e-8))
    z = (actual - mean) / s
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * density - 1 / math.sqrt(math.pi))


def call_density(calls: DataFrame, keys: list[str], strike: str, price: str, *, rate: float, years: float) -> DataFrame:
    """(keys, strike, density): discounted second differences of call prices at the inner strikes, negative parts cut, mass one.

    Strikes may be unevenly spaced; a group with fewer than three has no row, one without mass null densities.
    """
    w = Window.partitionBy(*keys).orderBy(strike)
    near = lambda f, c: f(c).over(w)
    left, right = F.col(strike) - near(F.lag, strike), near(F.lead, strike) - F.col(strike)
    bend = 2 * ((near(F.lead, price) - F.col(price)) / right - (F.col(price) - near(F.lag, price)) / left) / (left + right)
    raw = calls.select(*keys, strike, F.greatest(bend * math.exp(rate * years), F.lit(0.0)).alias("_f"), ((left + right) / 2).alias("_w"), (left.isNotNull() & right.isNotNull()).alias("_in")).where("_in")
    mass = F.sum(F.col("_f") * F.col("_w")).over(Window.partitionBy(*keys))
    return raw.select(*keys, strike, (F.col("_f") / F.nullif(mass, F.lit(0.0))).alias("density"))
