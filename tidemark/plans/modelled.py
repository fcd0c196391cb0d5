"""Fits, simulations and kernels over the adapter views. Random or iterative: checked by invariants, not by SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.scalars import instant_us
from tidemark.operators import backtest as B
from tidemark.operators import models as M
from tidemark.operators.series import Series
from tidemark.plans import views as V
from tidemark.plans.tables import table
from tidemark.plans.views import close, query

S = Series(["series"], "date")
MS = Series(["series"], "month")
r6 = lambda c: F.round(c, 6)


def _returns(spark: SparkSession, d: str) -> DataFrame:
    """(series, date, r): daily log returns."""
    return V.prices(spark, d).select("series", "date", S.log_change(close()).alias("r")).where("r IS NOT NULL")


def _months(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("series", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))


def _lagged(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series_id"], "date")
    return V.macro(spark, d).select("series_id", F.year("date").alias("fold"), F.col("value").alias("y"), *(s.lag(F.col("value"), k).alias(f"l{k}") for k in (1, 2, 5))).dropna()


@query(V.three_factor_ridge("SELECT value AS y, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 5) OVER w AS x3 FROM v_macro WINDOW w AS (PARTITION BY series_id ORDER BY date)", ("l1", "l2", "l5"), 1.0))
def fm03_ridge(spark: SparkSession, d: str) -> DataFrame:
    fit = M.ridge(_lagged(spark, d), ["l1", "l2", "l5"], "y", 1.0)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in fit.items()], "term string, coefficient double")


@query()
def fm04_purged_selection(spark: SparkSession, d: str) -> DataFrame:
    """Lag and penalty of each series' daily returns by purged rolling origins."""
    r = V.prices(spark, d).select("series", "date", S.log_change(close()).alias("r"))
    return B.select_lags(r, "series", "date", "r").select("series", "lag", "alpha", "origins", F.round("mse", 8).alias("mse"), "best")


@query()
def fm06_block_bootstrap_paths(spark: SparkSession, d: str) -> DataFrame:
    p = M.paths_each(_returns(spark, d), "series", "date", "r", M.block_draw(21), paths=2000, horizon=21, seed="fm06")
    return p.groupBy("series", "step").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r")).alias("mean"), r6(F.stddev_samp("r")).alias("sd"))


@query()
def fm07_correlated_paths(spark: SparkSession, d: str) -> DataFrame:
    """A vector autoregression of two series, fitted by Gram matrices and simulated with its residuals."""
    w = V.macro(spark, d).groupBy("date").agg(*(F.max(F.when(F.col("series_id") == i, F.col("value"))).alias(i) for i in ("AF", "RF"))).dropna().withColumn("one", F.lit(1))
    s = Series(["one"], "date")
    x = w.withColumn("a", s.lag(F.col("AF"))).withColumn("b", s.lag(F.col("RF"))).dropna()
    fits = [M.ridge(x, ["a", "b"], y, 1.0) for y in ("AF", "RF")]
    rows = np.array([[r["AF"], r["RF"], r["a"], r["b"]] for r in x.orderBy("date").collect()])
    a, c = np.array([[f["a"], f["b"]] for f in fits]), np.array([f["const"] for f in fits])
    paths = M.autoregressive_paths(spark, a, c, rows[-1, :2], rows[:, :2] - rows[:, 2:] @ a.T - c, paths=1000, horizon=12, seed="fm07")
    return paths.groupBy("step", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.expr("percentile(x, 0.5)")).alias("q50"))


@query()
def fm08_gbm_touch(spark: SparkSession, d: str) -> DataFrame:
    """Normal paths per series: share that touches -10 %, at the steps and between them by the bridge correction."""
    r = _returns(spark, d)
    sd = r.groupBy("series").agg((F.stddev_samp("r") / 10).alias("sd"))
    w = Window.partitionBy("series", "path_id").orderBy("step")
    p = M.paths_each(r, "series", "date", "r", lambda g, h: g.normal(0.0, h.std(ddof=1) / 10, 63), paths=1000, horizon=63, seed="fm08").join(sd, "series")
    p = p.withColumn("x", F.sum("r").over(w)).withColumn("x0", F.coalesce(F.lag("x").over(w), F.lit(0.0)))
    barrier = float(np.log(0.9))
    below = (F.col("x") <= barrier) | (F.col("x0") <= barrier)
    between = F.when(below, 1.0).otherwise(F.exp(-2 * (F.col("x") - barrier) * (F.col("x0") - barrier) / (F.col("sd") * F.col("sd"))))
    per = p.groupBy("series", "path_id").agg(F.max((F.col("x") <= barrier).cast("int")).alias("hit"), (1 - F.exp(F.sum(F.log(F.greatest(1 - between, F.lit(1e-300)))))).alias("p"))
    return per.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("hit")).alias("touched"), r6(F.avg("p")).alias("with_bridge"))


@query()
def fm10_one_factor(spark: SparkSession, d: str) -> DataFrame:
    """Filtered common factor of the macro series and each series' loading."""
    w = V.macro(spark, d).groupBy("date").pivot("series_id", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.max("value")).orderBy("date").toPandas()
    f, load = K.one_factor(w.drop(columns="date").to_numpy())
    return spark.createDataFrame([(c, round(float(x), 6), round(float(f[-1]), 6)) for c, x in zip(w.columns[1:], load, strict=True)], "series_id string, loading double, latest double")


@query()
def fm10_factor_by_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The common factor as each year's end knew it: a fit per cut-off over the months known then, its sign by two reference series and its scale by the first three years."""
    import pandas as pd

    ids = ["AF", "AO", "NF", "NO", "RF", "RO"]
    w = V.macro(spark, d).groupBy("date").pivot("series_id", ids).agg(F.max("value"))
    ends = F.array(*(F.lit(f"{y}-12-31").cast("date") for y in range(1998, 2002)))
    known = w.withColumn("cutoff", F.explode(F.filter(ends, lambda c: c >= F.col("date"))))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        f, load = K.one_factor(part[ids].to_numpy(float))
        states, load, sign = K.aligned(f, load, [0, 4], slice(0, 36))
        return pd.DataFrame({"cutoff": part["cutoff"].iloc[0], "months": len(part), "sign": sign, "latest": states[-1], "series_id": ids, "loading": load})

    got = known.groupBy("cutoff").applyInPandas(fit, "cutoff date, months long, sign int, latest double, series_id string, loading double")
    return got.select("cutoff", "months", "series_id", r6(F.col("loading")).alias("loading"), r6(F.col("latest")).alias("latest"))


@query()
def fm12_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of 21-day sums by random walk, drift, autoregression, normal draws, history and blocks, per series."""
    r = V.prices(spark, d).select("series", "date", S.log_change(close()).alias("r"))
    return M.baseline_samples(r, "series", "date", "r", horizon=21, count=2000, seed="fm12").select("series", "baseline", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


_R = "(SELECT series, date, ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price)"


@query(f"SELECT series, count(*) AS n, round(21 * avg(r), 6) AS drift, round(stddev_samp(r) * sqrt(21), 6) AS spread, round(sum(r * p) / sum(p * p), 6) AS phi FROM (SELECT series, r, lag(r) OVER (PARTITION BY series ORDER BY date) AS p FROM {_R} WHERE r IS NOT NULL) GROUP BY series")
def fm12_baseline_parameters(spark: SparkSession, d: str) -> DataFrame:
    """What the baselines that draw nothing at random are made of."""
    r = V.prices(spark, d).select("series", "date", S.log_change(close()).alias("r")).where("r IS NOT NULL").withColumn("p", F.lag("r").over(S.w))
    return r.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(21 * F.avg("r")).alias("drift"), r6(F.stddev_samp("r") * 21**0.5).alias("spread"), r6(F.sum(F.col("r") * F.col("p")) / F.sum(F.col("p") * F.col("p"))).alias("phi"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """(series, date, trend, vol, dd, y): what is known at a close, and the sum of the next 21 returns."""
    p = V.prices(spark, d).withColumn("r", S.log_change(close()))
    return p.select("series", "date", S.change(close(), 20).alias("trend"), S.rolling(F.stddev_samp, F.col("r"), 20).alias("vol"), S.drawdown(close()).alias("dd"), (F.log(F.lead("close", 21).over(S.w)) - F.log(close())).alias("y"))


_FEATURES = f"""(SELECT series, date, close / lag(close, 20) OVER w - 1 AS trend, CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f END AS vol, close / max(close) OVER w - 1 AS dd, ln(lead(close, 21) OVER w) - ln(close) AS y
    FROM (SELECT p.*, r FROM v_price p JOIN {_R} q USING (series, date)) WINDOW w AS (PARTITION BY series ORDER BY date), f AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING))"""
_ROBUST = f"""WITH x AS {_FEATURES}, q AS (SELECT series, quantile_cont(trend, 0.5) AS mt, quantile_cont(vol, 0.5) AS mv, quantile_cont(dd, 0.5) AS md, quantile_cont(trend, 0.75) - quantile_cont(trend, 0.25) AS st, quantile_cont(vol, 0.75) - quantile_cont(vol, 0.25) AS sv, quantile_cont(dd, 0.75) - quantile_cont(dd, 0.25) AS sd FROM x GROUP BY 1),
    z AS (SELECT x.*, coalesce((trend - mt) / CASE WHEN st > 1e-12 THEN st ELSE 1 END, 0) AS zt, coalesce((vol - mv) / CASE WHEN sv > 1e-12 THEN sv ELSE 1 END, 0) AS zv, coalesce((dd - md) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 0) AS zd FROM x JOIN q USING (series))"""


@query(_ROBUST + """, l AS (SELECT series, date, -((zt - 1) ** 2 + (zv + 0.5) ** 2 + zd ** 2) / 6 AS a, -(zt ** 2 + zv ** 2 + zd ** 2) / 6 AS b, -((zt + 1) ** 2 + (zv - 1.5) ** 2 + (zd + 1) ** 2) / 6 AS c FROM z),
    e AS (SELECT series, date, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM l), p AS (SELECT series, date, greatest(a / (a + b + c), 0.01) AS a, greatest(b / (a + b + c), 0.01) AS b, greatest(c / (a + b + c), 0.01) AS c FROM e)
    SELECT series, date, round(a / (a + b + c), 6) AS rising, round(b / (a + b + c), 6) AS calm, round(c / (a + b + c), 6) AS stressed FROM p""")
def fm13_soft_regimes(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d).drop("y")
    p = M.soft_regimes(x, "series", ["trend", "vol", "dd"], {"rising": [1.0, -0.5, 0.0], "calm": [0.0, 0.0, 0.0], "stressed": [-1.0, 1.5, -1.0]})
    return p.select("series", "date", *(r6(F.col(c)).alias(c) for c in ("rising", "calm", "stressed")))


@query(_ROBUST + """, h AS (SELECT series, arg_max(zt, date) AS ht, arg_max(zv, date) AS hv, arg_max(zd, date) AS hd FROM z GROUP BY 1),
    n AS (SELECT series, y FROM (SELECT z.series, y, row_number() OVER (PARTITION BY z.series ORDER BY round(((zt - ht) ** 2 + (zv - hv) ** 2 + (zd - hd) ** 2) / 3, 12), date) AS k FROM z JOIN h ON h.series = z.series WHERE y IS NOT NULL) WHERE k <= 50),
    a AS (SELECT series, quantile_cont(y, 0.5) AS m, stddev_samp(y) AS s FROM x WHERE y IS NOT NULL GROUP BY 1), c AS (SELECT series, count(*) AS n, quantile_cont(y, 0.5) - m AS delta, greatest(-s / 2, least(s / 2, quantile_cont(y, 0.5) - m)) AS shift, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.5) AS mid, quantile_cont(y, 0.9) AS hi FROM n JOIN a USING (series) GROUP BY series, m, s)
    SELECT series, n, round(shift, 6) AS shift, round(lo + shift - delta, 6) AS lo, round(mid + shift - delta, 6) AS mid, round(hi + shift - delta, 6) AS hi FROM c""")
def fm13_analog_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """What followed the fifty days most like the last one of each series."""
    q = M.analog_quantiles(_features(spark, d), "series", "date", ["trend", "vol", "dd"], "y", [0.1, 0.5, 0.9])
    return q.select("series", "n", r6(F.col("shift")).alias("shift"), *(r6(F.col("q")[i]).alias(c) for i, c in enumerate(("lo", "mid", "hi"))))


@query()
def fm13_horizon_scale(spark: SparkSession, d: str) -> DataFrame:
    """How much wider than the usual spread the next 21 days are expected to be."""
    x = _features(spark, d).dropna().withColumn("anchor", F.col("vol") * 21**0.5)
    return M.horizon_scale(x, "series", ["trend", "vol", "dd"], "y", "anchor").groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ratio")).alias("mean"), r6(F.min("ratio")).alias("low"), r6(F.max("ratio")).alias("high"))


@query(V.three_factor_ridge("SELECT p.series, r AS x1, CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f END AS x2, close / max(close) OVER w - 1 AS x3, ln(lead(close, 21) OVER w) - ln(close) AS y FROM v_price p JOIN (SELECT series, date, ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price) q USING (series, date) WINDOW w AS (PARTITION BY p.series ORDER BY date), f AS (PARTITION BY p.series ORDER BY date ROWS 19 PRECEDING)", ("r", "vol", "dd"), 1.0, "series"))
def fm13_direct_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Ridge of the sum of the next 21 returns on return, volatility and drawdown today, per series."""
    p = V.prices(spark, d).withColumn("r", S.log_change(close()))
    x = p.select("series", "r", S.rolling(F.stddev_samp, F.col("r"), 20).alias("vol"), S.drawdown(close()).alias("dd"), (F.log(F.lead("close", 21).over(S.w)) - F.log(close())).alias("y")).dropna()
    out = [(k, t, round(float(b), 6)) for k, (xx, xy, _, _) in M.gram(x, ["r", "vol", "dd"], "y", "series").items() for t, b in zip(("r", "vol", "dd", "const"), M.solve(xx, xy, 1.0), strict=True)]
    return spark.createDataFrame(out, "series string, term string, coefficient double")


@query()
def fm15_copula_and_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Per series: joint ends at two horizons with their marginals kept, then paths through the later one, steps like the history's."""
    count = 500
    drawn: dict[bytes, np.ndarray] = {}

    def joint(h: np.ndarray) -> np.ndarray:
        """The same draws for all paths of a series, kept for the last one."""
        key = h.tobytes()
        if key not in drawn:
            drawn.clear()
            ends = np.column_stack([np.convolve(h, np.ones(n), "valid")[: len(h) - 62] for n in (21, 63)])
            drawn[key] = K.gaussian_copula(ends, np.array([[1.0, 0.6], [0.6, 1.0]]), count, K.seeded("fm15", len(h)))
        return drawn[key]

    def draw(g: np.random.Generator, h: np.ndarray) -> np.ndarray:
        # the path's end is one of its series' joint draws; its last number tells which gap is left
        end = joint(h)[int(g.integers(count)), 1]
        level = K.bridge(end, h[K.stationary_indices(g, len(h), 63, 10.0)])
        return np.append(np.diff(level, prepend=0.0), end)

    p = M.paths_each(_returns(spark, d), "series", "date", "r", draw, paths=200, horizon=64, seed="fm15")
    per = p.groupBy("series", "path_id").agg(F.sum(F.when(F.col("step") < 63, F.col("r"))).alias("x"), F.max(F.when(F.col("step") == 63, F.col("r"))).alias("want"))
    return per.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(F.col("x") - F.col("want")))).alias("worst_gap"), r6(F.avg("want")).alias("mean_end"))


_FACTS = """WITH f AS (SELECT event_id, any_value(event_type) AS event_type, any_value(scheduled_at::timestamptz) AS s, any_value(revision_seq) AS seq, any_value(consensus) AS consensus, any_value(model_nowcast) AS nowcast, any_value(outcome_return_5d) AS y FROM event_fact GROUP BY event_id),
    t AS (SELECT event_type, s, arg_max(row(nowcast - consensus, y), (seq, event_id)) AS r FROM f WHERE event_type IS NOT NULL AND s IS NOT NULL GROUP BY ALL)"""


@query(_FACTS + """, h AS (SELECT event_type, r[1] AS x, r[2] AS y FROM t WHERE r[1] IS NOT NULL AND r[2] IS NOT NULL),
    b AS (SELECT event_type, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_samp(y) AS sy, (sum(x * y) - count(*) * avg(x) * avg(y)) / (sum(x * x) - count(*) * avg(x) * avg(x) + 10) AS beta FROM h GROUP BY 1 HAVING count(*) >= 5)
    SELECT event_type, n, round(beta, 7) AS beta, round(greatest(-sy / 2, least(sy / 2, my + beta * (1 - mx))), 7) AS target FROM b""")
def fm16_event_response(spark: SparkSession, d: str) -> DataFrame:
    """Ridge of the five-day outcome on the surprise over the past releases of each kind; the answer to a surprise of one, kept within half a spread."""
    return _responses(spark, d).select("event_type", "n", F.round("beta", 7).alias("beta"), F.round("target", 7).alias("target"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, n, beta, target): sums per kind in the engine; of a release the latest revision counts."""
    f = table(spark, d, "event_fact").select("event_id", "event_type", instant_us(F.col("scheduled_at")).alias("s"), "revision_seq", (F.col("model_nowcast") - F.col("consensus")).alias("x"), F.col("outcome_return_5d").alias("y")).where("event_type IS NOT NULL AND s IS NOT NULL")
    last = f.groupBy("event_type", "s").agg(F.max(F.struct("revision_seq", "event_id", "x", "y")).alias("r")).select("event_type", "r.x", "r.y").where("x IS NOT NULL AND y IS NOT NULL")
    n, x, y = F.count(F.lit(1)), F.col("x"), F.col("y")
    b = last.groupBy("event_type").agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_samp(y).alias("sy"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx")).where("n >= 5")
    beta = (F.col("xy") - F.col("n") * F.col("mx") * F.col("my")) / (F.col("xx") - F.col("n") * F.col("mx") * F.col("mx") + 10)
    answer = F.col("my") + F.col("beta") * (1 - F.col("mx"))
    return b.withColumn("beta", beta).withColumn("target", F.greatest(-F.col("sy") / 2, F.least(F.col("sy") / 2, answer)))


@query("""WITH e AS (SELECT path_id, max(CASE WHEN step = 4 THEN ln(level / 100) END) AS x, arg_max(level, step) AS fin FROM v_paths GROUP BY 1), s AS (SELECT greatest(stddev_samp(x), 1e-8) AS h FROM e), u AS (SELECT path_id, fin, exp(-0.5 * ((x - 0.02) / h) ** 2) AS u FROM e, s),
    w AS (SELECT path_id, fin, u / sum(u) OVER () AS w FROM u), c AS (SELECT *, sum(w) OVER (ORDER BY path_id) / sum(w) OVER () AS c, (sum(w) OVER (ORDER BY path_id) - w) / sum(w) OVER () AS b, count(*) OVER () AS n FROM w), k AS (SELECT *, ceil(n * round(c, 12) - 0.5) - ceil(n * round(b, 12) - 0.5) AS k FROM c)
    SELECT count(*) AS n, round(avg(fin), 6) AS mean, round(sum(w * fin), 6) AS weighted, round(sum(k * fin) / sum(k), 6) AS resampled, round(1 / sum(w * w), 4) AS effective, sum(k)::bigint AS copies FROM k""")
def fm16_event_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Paths reweighted around an event's expected five-day return and resampled systematically."""
    ends = V.paths(spark, d).groupBy("path_id").agg(F.max(F.when(F.col("step") == 4, F.log(F.col("level") / 100))).alias("x"), F.max_by("level", "step").alias("fin"))
    k = M.resampled(M.kernel_weights(ends, "x", 0.02), "path_id", "weight")
    w, fin = F.col("weight"), F.col("fin")
    return k.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(fin)).alias("mean"), r6(F.sum(w * fin)).alias("weighted"), r6(F.sum(F.col("copies") * fin) / F.sum("copies")).alias("resampled"), F.round(1 / F.sum(w * w), 4).alias("effective"), F.sum("copies").alias("copies"))


@query()
def fm17_garch(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).select("series", "date", S.log_change(close()).alias("r"))
    names = ["omega", "alpha", "beta"]
    return M.fit_each(p, "series", "date", "r", lambda _, v: dict(zip(names, K.garch11(v), strict=True)), names).select("series", *(r6(F.col(c)).alias(c) for c in names))


@query()
def fm17_regime_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    draw = M.regime_draw(lambda h: (np.abs(h) > np.median(np.abs(h))).astype(int), [0] * 10 + [1] * 11)
    p = M.paths_each(_returns(spark, d), "series", "date", "r", draw, paths=1000, horizon=21, seed="fm17")
    return p.groupBy("series", (F.col("step") >= 10).cast("int").alias("regime")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs("r"))).alias("mean_abs"))


@query()
def fm18_entropy_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Paths weighted such that two views hold: the mean end, and how many end above 100."""
    ends = V.paths(spark, d).groupBy("path_id").agg(F.max_by("level", "step").alias("fin")).withColumn("up", (F.col("fin") > 100).cast("double"))
    w = M.entropy_pooled(ends, ["fin", "up"], [101.0, 0.55], keep=["path_id", "fin", "up"])
    return w.agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight")).alias("mass"), F.round(F.sum(F.col("weight") * F.col("fin")), 4).alias("mean"), F.round(F.sum(F.col("weight") * F.col("up")), 4).alias("up"), (F.min("weight") > 0).alias("positive"))


@query()
def fm26_bootstrap_beta(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the beta of two series' monthly changes: blocks drawn jointly, one task per replicate."""
    s = Series(["series_id"], "date")
    m = V.macro(spark, d).where("series_id IN ('AF', 'RF')").select("series_id", "date", s.log_change(F.col("value")).alias("r")).groupBy("date").agg(F.max(F.when(F.col("series_id") == "AF", F.col("r"))).alias("x"), F.max(F.when(F.col("series_id") == "RF", F.col("r"))).alias("y")).dropna().orderBy("date")
    xy = np.array([[r["x"], r["y"]] for r in m.collect()])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "at long, x double, y double")
    n = len(xy)
    drawn = M.block_paths(spark, np.arange(n, dtype=float), paths=500, horizon=n, mean_block=6, seed="fm26").select("path_id", F.col("r").cast("long").alias("at"))
    beta = drawn.join(rows, "at").groupBy("path_id").agg((F.covar_pop("x", "y") / F.var_pop("x")).alias("b"))
    return beta.agg(F.count(F.lit(1)).alias("n"), r6(F.expr("percentile(b, 0.05)")).alias("lo"), r6(F.expr("percentile(b, 0.5)")).alias("mid"), r6(F.expr("percentile(b, 0.95)")).alias("hi"))


@query()
def ev10_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).select("series", "date", S.log_change(close()).alias("r"))
    return M.bootstrap_mean(p, "series", "date", "r", replicates=300, seed="ev10").select("series", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "lo", "hi")))


@query("""WITH p AS (SELECT series, date, ln(close) - lag(ln(close), 21) OVER w AS past, ln(lead(close, 21) OVER w) - ln(close) AS y, date = max(date) OVER (PARTITION BY series, date_trunc('week', date)) AS last FROM v_price WINDOW w AS (PARTITION BY series ORDER BY date)),
    h AS (SELECT *, list_sort(list_filter(list(past) OVER (PARTITION BY series ORDER BY date), lambda x: x IS NOT NULL)) AS h FROM p), q AS (SELECT series, y, h[floor(len(h) * 0.1)::int + 1] AS lo, h[floor(len(h) * 0.5)::int + 1] AS mid, h[floor(len(h) * 0.9)::int + 1] AS hi FROM h WHERE last AND len(h) >= 100 AND y IS NOT NULL)
    SELECT series, count(*) AS origins, round(avg((greatest(0.1 * (y - lo), -0.9 * (y - lo)) + greatest(0.5 * (y - mid), -0.5 * (y - mid)) + greatest(0.9 * (y - hi), -0.1 * (y - hi))) / 3), 6) AS loss, round(avg((y BETWEEN lo AND hi)::int), 6) AS coverage FROM q GROUP BY series""")
def ev07_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Weekly origins, each forecast by the quantiles of all 21-day changes that ended by it, scored by pinball loss.

    Origins run in parallel: the history that an origin may use comes from a window that ends at it.
    """
    p = V.prices(spark, d).withColumn("past", F.log(close()) - S.lag(F.log(close()), 21)).withColumn("y", F.log(F.lead("close", 21).over(S.w)) - F.log(close()))
    known = S.w.rowsBetween(Window.unboundedPreceding, 0)
    o = p.withColumn("last", F.max("date").over(Window.partitionBy("series", F.trunc("date", "week")))).withColumn("hist", F.collect_list("past").over(known)).where("date = last AND size(hist) >= 100 AND y IS NOT NULL")
    at = lambda q: F.expr(f"element_at(array_sort(hist), cast(floor(size(hist) * {q}) AS int) + 1)")
    from tidemark.operators.scoring import pinball

    loss = sum((pinball(F.lit(q), at(q), F.col("y")) for q in (0.1, 0.5, 0.9)), F.lit(0.0)) / 3
    return o.groupBy("series").agg(F.count(F.lit(1)).alias("origins"), r6(F.avg(loss)).alias("loss"), r6(F.avg(F.col("y").between(at(0.1), at(0.9)).cast("int"))).alias("coverage"))


@query()
def al05_open_end_warping(spark: SparkSession, d: str) -> DataFrame:
    """Each series' month-ends of the first three years against all of one series'."""
    m = _months(spark, d)
    ref = [float(np.log(r["close"])) for r in m.where("series = '1-URGENT'").orderBy("month").collect()]
    return M.warp_each(m.where("month < '1998-01-01' AND series != '1-URGENT'"), "series", "month", "close", ref).select("series", r6(F.col("distance")).alias("distance"), "last", "steps")


@query()
def al06_standardised_warping(spark: SparkSession, d: str) -> DataFrame:
    m = _months(spark, d)
    ref = np.array([r["close"] for r in m.where("series = '1-URGENT'").orderBy("month").collect()])
    z = lambda v: (np.log(v) - np.log(v).mean()) / (np.log(v).std() or 1.0)
    return M.fit_each(m, "series", "month", "close", lambda _, v: {"distance": float(K.dtw(z(v), z(ref))[-1, -1] / (len(v) + len(ref)))}, ["distance"]).select("series", r6(F.col("distance")).alias("distance"))


@query()
def al09_critical_times(spark: SparkSession, d: str) -> DataFrame:
    m = _months(spark, d)
    names = ["critical", "exponent", "frequency", "rmse"]
    return M.fit_each(m, "series", "month", "close", lambda k, v: K.lppl(np.log(v), K.seeded("al09", k), rounds=20), names).select("series", *(r6(F.col(c)).alias(c) for c in names))


@query()
def al09_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Critical times fitted at each of the last months, and how long the estimate has been stable."""
    names = ["fits", "median", "last", "stable"]
    return M.fit_each(_months(spark, d), "series", "month", "close", lambda k, v: K.critical_walk(np.log(v), max(24, len(v) - 5), lambda end: K.seeded("al09", k, end), rounds=10), names).select("series", *(r6(F.col(c)).alias(c) for c in names))


@query()
def al19_clusters(spark: SparkSession, d: str) -> DataFrame:
    f = _months(spark, d).select("series", "month", MS.change(close(), 1).alias("f0"), MS.change(close(), 3).alias("f1"), MS.drawdown(close()).alias("f2")).dropna()
    return M.cluster_each(f, "series", "month", ["f0", "f1", "f2"], 4)


@query()
def so25_phase_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of each series through calm, falling and rising stretches in a fixed order, with what each is made of."""
    order = [0] * 10 + [1] * 20 + [2] * 20

    def phases(h: np.ndarray) -> np.ndarray:
        ten = np.convolve(h, np.ones(10) / 10, "same")
        lo, hi = np.quantile(ten, [0.3, 0.7])
        return np.where(ten <= lo, 1, np.where(ten >= hi, 2, 0))

    p = M.paths_each(_returns(spark, d), "series", "date", "r", M.regime_draw(phases, order), paths=500, horizon=len(order), seed="so25")
    return p.groupBy("series", F.element_at(F.array(*(F.lit(x) for x in order)), F.col("step") + 1).alias("phase")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r")).alias("mean"), F.count_distinct("r").alias("distinct_returns"))


@query("""WITH m AS (SELECT path_id % 2 AS branch, step, avg(r) AS m FROM v_paths GROUP BY ALL), x AS (SELECT p.path_id % 2 AS branch, p.step, r, CASE WHEN p.step BETWEEN 20 AND 29 THEN m + 2 * (r - m) + CASE WHEN p.path_id % 2 = 1 THEN 0.001 ELSE -0.001 END ELSE r END AS s FROM v_paths p JOIN m ON m.branch = p.path_id % 2 AND m.step = p.step)
    SELECT branch::int AS branch, (step BETWEEN 20 AND 29)::int AS inside, round(stddev_pop(s) / stddev_pop(r), 6) AS spread, round(avg(s) - avg(r), 6) AS shift FROM x GROUP BY ALL""")
def so06_local_shock(spark: SparkSession, d: str) -> DataFrame:
    """From step 20 for 10 steps: returns recentred, their spread doubled and shifted, per branch; the means are a row per branch and step."""
    p = V.paths(spark, d).withColumn("branch", F.pmod("path_id", F.lit(2)).cast("int"))
    inside = F.col("step").between(20, 29)
    mean = F.col("m")
    shocked = F.when(inside, mean + 2 * (F.col("r") - mean) + F.when(F.col("branch") == 1, 0.001).otherwise(-0.001)).otherwise(F.col("r"))
    both = p.join(p.groupBy("branch", "step").agg(F.avg("r").alias("m")), ["branch", "step"])
    return both.withColumn("s", shocked).groupBy("branch", inside.cast("int").alias("inside")).agg(r6(F.stddev_pop("s") / F.stddev_pop("r")).alias("spread"), r6(F.avg("s") - F.avg("r")).alias("shift"))


@query()
def ev07_refitted(spark: SparkSession, d: str) -> DataFrame:
    """Weekly origins at which lag and penalty are selected and the autoregression fitted anew, scored against the baselines by horizon."""
    r = V.prices(spark, d).select("series", "date", S.log_change(close()).alias("r"))
    last = F.col("date") == F.max("date").over(Window.partitionBy("series", F.trunc("date", "week")))
    # the last session of each week, told from the whole series
    weekly = r.withColumn("last", last).where("last").select(F.col("series").alias("_s"), F.col("date").alias("_d"))
    scores = B.walk_forward(r, "series", "date", "r", F.col("no") >= 320)
    s = scores.join(weekly, (F.col("series") == F.col("_s")) & (F.col("date") == F.col("_d")), "left_semi")
    inside = F.abs(F.col("actual") - F.col("mean")) <= 1.2815515655446004 * F.col("sd")
    return s.groupBy("series", "horizon").agg(F.count(F.lit(1)).alias("origins"), *(r6(F.avg(c)).alias(c) for c in ("crps", "crps_walk", "crps_drift", "crps_normal", "crps_ar1")), r6(F.avg(inside.cast("int"))).alias("coverage"))
