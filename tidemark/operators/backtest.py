"""Walk-forward selection, refits and scores of autoregressions: all origins at once from running Gram sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scoring import gaussian_crps

ALPHAS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


def _square(packed: pd.Series, size: int) -> np.ndarray:
    """Rows of packed upper triangles -> symmetric matrices."""
    flat = np.stack(packed.to_numpy()).astype(float) if len(packed) else np.empty((0, size * (size + 1) // 2))
    out = np.empty((len(flat), size, size))
    for k, (i, j) in enumerate((i, j) for i in range(size) for j in range(i, size)):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


def _coefficients(g: np.ndarray, lag: int, alpha: float) -> np.ndarray:
    """Ridge coefficients on ``lag`` lags and a constant, which isn't penalised, for each Gram matrix of (y, lags..., 1)."""
    at = [*range(1, lag + 1), g.shape[1] - 1]
    penalty = alpha * np.eye(lag + 1)
    penalty[-1, -1] = 0.0
    return np.linalg.solve(g[:, at][:, :, at] + penalty, g[:, at, 0][..., None])[..., 0]


def _candidates(lags: Sequence[int], alphas: Sequence[float]) -> list[tuple[int, float]]:
    return sorted((lag, alpha) for lag in lags for alpha in alphas)


def _prepared(df: DataFrame, key: str, order: str, value: str, lags: Sequence[int]) -> tuple[DataFrame, Column]:
    """Rows with ``z`` (value, its lags, 1), their number ``no`` and ``gram``, the packed sums of z z' over the rows up to each; and the key's window."""
    w = Window.partitionBy(key).orderBy(order)
    most = max(lags)
    z = F.array(F.col("y"), *(F.lag("y", k).over(w) for k in range(1, most + 1)), F.lit(1.0))
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias(key), F.col(order).alias(order), F.col(value).cast("double").alias("y")).withColumn("no", F.row_number().over(w) - 1).withColumn("z", z)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    full = F.col("no") >= most
    sums = [F.sum(F.when(full, F.col("z")[i] * F.col("z")[j])).over(upto) for i in range(most + 2) for j in range(i, most + 2)]
    return rows.withColumn("gram", F.when(full, F.array(*sums))), w


def _scored(df: DataFrame, key: str, order: str, value: str, lags: Sequence[int], alphas: Sequence[float], purge: int, spacing: int, most: int, least: int) -> tuple[DataFrame, Window]:
    """The prepared rows with ``errors``: of the inner origins among them, each candidate's squared error, fitted ``purge`` rows before."""
    size = max(lags) + 2
    chosen = _candidates(lags, alphas)

    @F.pandas_udf("array<double>")
    def errors(gram: pd.Series, z: pd.Series) -> pd.Series:
        g, x = _square(gram, size), np.stack(z.to_numpy()).astype(float) if len(z) else np.empty((0, size))
        out = np.empty((len(g), len(chosen)))
        for c, (lag, alpha) in enumerate(chosen):
            seen = x[:, [*range(1, lag + 1), size - 1]]
            out[:, c] = (x[:, 0] - (seen * _coefficients(g, lag, alpha)).sum(1)) ** 2
        return pd.Series(list(out))

    rows, w = _prepared(df, key, order, value, lags)
    before = rows.withColumn("fit", F.lag("gram", purge + 1).over(w))
    inner = (F.col("no") >= least) & (F.pmod(F.col("no") - least, F.lit(spacing)) == 0) & F.col("fit").isNotNull()
    # the function sees inner origins only: they are told apart, scored and put back by their number
    marks = before.where(inner).select(F.col(key).alias("_k"), F.col("no").alias("_no"), errors("fit", "z").alias("errors"))
    return before.drop("fit").join(marks, F.col(key).eqNullSafe(F.col("_k")) & (F.col("no") == F.col("_no")), "left").drop("_k", "_no"), w


def select_lags(df: DataFrame, key: str, order: str, value: str, *, lags: Sequence[int] = (1, 2, 5), alphas: Sequence[float] = ALPHAS, purge: int = 63, embargo: int = 5, most: int = 52, least: int = 252) -> DataFrame:
    """Lag and penalty of each key's autoregression by purged rolling origins: (key, lag, alpha, origins, mse, best).

    Origins lie at least ``embargo`` rows (21 at least) apart from row ``least`` on, the last
    ``most`` count. A candidate is fitted on the rows that end ``purge`` before an origin and predicts
    it. Ties go to fewer lags, then to the smaller penalty. For series of at most a value a day.
    """
    spacing = max(embargo, 21)
    rows, _ = _scored(df, key, order, value, lags, alphas, purge, spacing, most, least)
    late = Window.partitionBy(key).orderBy(F.col("no").desc())
    seen = rows.where("errors IS NOT NULL").withColumn("_r", F.row_number().over(late)).where(F.col("_r") <= most)
    names = F.array(*(F.struct(F.lit(lag).alias("lag"), F.lit(float(alpha)).alias("alpha")) for lag, alpha in _candidates(lags, alphas)))
    per = seen.select(key, F.posexplode(F.arrays_zip(names.alias("c"), F.col("errors").alias("e"))).alias("at", "x")).groupBy(key, "at", "x.c").agg(F.count(F.lit(1)).alias("origins"), F.avg("x.e").alias("mse"))
    best = Window.partitionBy(key).orderBy("mse", "at")
    return per.withColumn("best", F.row_number().over(best) == 1).select(key, "c.lag", "c.alpha", "origins", "mse", "best")


def walk_forward(df: DataFrame, key: str, order: str, value: str, origin: Column, *, lags: Sequence[int] = (1, 2, 5), alphas: Sequence[float] = ALPHAS, horizons: Sequence[int] = (1, 5, 21, 63), purge: int = 63, embargo: int = 5, most: int = 52, least: int = 252) -> DataFrame:
    """Scores of an autoregression that is selected and fitted anew at every origin, from what came before it only.

    ``origin``: a condition on the rows (of ``df``, with the row number ``no``) that makes one an
    origin. The candidates' purged errors at inner origins before it choose lag and penalty
    (as :func:`select_lags`), all rows before it are fitted. The sum of the next h values is
    forecast as normal, with the spread that the residuals give the sum. All fits come from
    running sums, so origins are neither looped over nor refitted from their rows.

    Result: key, order, horizon, lag, alpha, mean, sd, actual, and CRPS of the model and of a
    random walk (``crps_walk``), its drift (``crps_drift``), a normal walk (``crps_normal``) and a
    first-order autoregression without constant (``crps_ar1``). Origins without an inner one before
    or a whole horizon after have no row. For series of at most a value a day.
    """
    spacing = max(embargo, 21)
    chosen = _candidates(lags, alphas)
    size = max(lags) + 2
    rows, w = _scored(df, key, order, value, lags, alphas, purge, spacing, most, least)
    back = w.rowsBetween(-most * spacing, -1)
    means = F.array(*(F.avg(F.col("errors")[c]).over(back) for c in range(len(chosen))))
    ahead = lambda h: F.when(F.count(F.lit(1)).over(w.rowsBetween(0, h - 1)) == h, F.sum("y").over(w.rowsBetween(0, h - 1)))
    told = rows.withColumn("means", means).withColumn("fit", F.lag("gram", 1).over(w)).withColumn("ends", F.array(*(ahead(h) for h in horizons)))
    told = told.where(origin & F.col("fit").isNotNull() & F.col("means")[0].isNotNull()).withColumn("pick", F.expr("array_position(means, array_min(means)) - 1").cast("int"))

    @F.pandas_udf("array<struct<mean:double,sd:double,mu:double,sigma:double,phi_mean:double,phi_sd:double>>")
    def forecast(gram: pd.Series, z: pd.Series, pick: pd.Series) -> pd.Series:
        g, x, out = _square(gram, size), np.stack(z.to_numpy()).astype(float) if len(z) else np.empty((0, size)), []
        for one, seen, c in zip(g, x, pick, strict=True):
            lag, alpha = chosen[int(c)]
            b = _coefficients(one[None], lag, alpha)[0]
            at = [*range(1, lag + 1), size - 1]
            n = one[-1, -1]
            rss = one[0, 0] - 2 * b @ one[at, 0] + b @ one[np.ix_(at, at)] @ b
            sums = _sums(b[:-1], b[-1], seen[1 : lag + 1], max(rss, 0.0) / n, horizons)
            mu = one[0, -1] / n
            spread = np.sqrt(max(one[0, 0] - n * mu * mu, 0.0) / max(n - 1, 1))
            phi = one[0, 1] / one[1, 1] if one[1, 1] > 1e-16 else 0.0
            walk = _sums(np.array([phi]), 0.0, seen[1:2], max(one[0, 0] - 2 * phi * one[0, 1] + phi * phi * one[1, 1], 0.0) / n, horizons)
            out.append([{"mean": m, "sd": s, "mu": mu * h, "sigma": spread * h**0.5, "phi_mean": pm, "phi_sd": ps} for h, (m, s), (pm, ps) in zip(horizons, sums, walk, strict=True)])
        return pd.Series(out)

    flat = told.select(key, order, "pick", "ends", forecast("fit", "z", "pick").alias("f")).select(key, order, "pick", F.posexplode(F.arrays_zip("f", "ends")).alias("i", "x")).where("x.ends IS NOT NULL")
    name = F.element_at(F.array(*(F.struct(F.lit(lag).alias("lag"), F.lit(float(alpha)).alias("alpha")) for lag, alpha in chosen)), F.col("pick") + 1)
    f, a = F.col("x.f"), F.col("x.ends")
    return flat.select(
        key, order, F.element_at(F.array(*(F.lit(h) for h in horizons)), F.col("i") + 1).alias("horizon"), name["lag"].alias("lag"), name["alpha"].alias("alpha"), f["mean"].alias("mean"), f["sd"].alias("sd"), a.alias("actual"),
        gaussian_crps(f["mean"], f["sd"], a).alias("crps"), F.abs(a).alias("crps_walk"), F.abs(a - f["mu"]).alias("crps_drift"), gaussian_crps(f["mu"], f["sigma"], a).alias("crps_normal"), gaussian_crps(f["phi_mean"], f["phi_sd"], a).alias("crps_ar1"),
    )


def _sums(b: np.ndarray, const: float, last: np.ndarray, variance: float, horizons: Sequence[int]) -> list[tuple[float, float]]:
    """Mean and standard deviation of the sums of the next values of an autoregression, ``last`` its newest values first."""
    state, effects, total = list(last), [1.0], 0.0
    out, carried, spread = {}, 0.0, 0.0
    for h in range(1, max(horizons) + 1):
        value = const + float(np.dot(b, state))
        state = [value, *state[:-1]]
        total += value
        if h > 1:
            effects.append(sum(b[k] * effects[h - 2 - k] for k in range(min(len(b), h - 1))))
        # the shock k steps before the end has moved the sum by the effects up to k
        carried += effects[-1]
        spread += carried * carried
        out[h] = (total, float(np.sqrt(variance * spread)))
    return [out[h] for h in horizons]
