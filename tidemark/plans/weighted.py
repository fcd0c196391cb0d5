"""Weighted paths, scores of whole distributions and densities over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.operators.ranks import numbered, running_totals
from tidemark.operators.series import Series
from tidemark.plans import views as V
from tidemark.plans.views import query

r6 = lambda c: F.round(c, 6)

# a path's logarithmic weight: calm paths count for more
_WEIGHED = """
    WITH l AS (SELECT path_id, engine, -40 * avg(r * r) AS l FROM v_path0 GROUP BY ALL),
    u AS (SELECT path_id, engine, exp(l - max(l) OVER (PARTITION BY engine)) AS u FROM l),
    w AS (SELECT path_id, engine, u / sum(u) OVER (PARTITION BY engine) AS w FROM u)
"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """(path_id, engine, w): normalised per engine from logarithmic weights; an engine's greatest weight and total are two numbers, joined."""
    l = V.paths(spark, d).groupBy("path_id", "engine").agg((-40 * F.avg(F.col("r") * F.col("r"))).alias("l"))  # noqa: E741
    top = l.groupBy("engine").agg(F.max("l").alias("m"))
    u = l.join(top, "engine").withColumn("u", F.exp(F.col("l") - F.col("m")))
    return u.join(u.groupBy("engine").agg(F.sum("u").alias("t")), "engine").select("path_id", "engine", (F.col("u") / F.col("t")).alias("w"))


@query(_WEIGHED.strip() + """ SELECT engine, n, round(ess, 6) AS ess, round(ess / n, 6) AS ess_share, round(top, 8) AS max_weight, round(top_1pct, 8) AS top_1pct, round(kl, 8) AS kl, (ess >= 0.2 * n AND top <= 0.05 AND top_1pct <= 0.1)::int AS passes FROM (SELECT engine, count(*) AS n, 1 / sum(w * w) AS ess, max(w) AS top, sum(w * ln(w * n)) AS kl, sum(CASE WHEN k <= ceil(n * 0.01) THEN w ELSE 0 END) AS top_1pct
    FROM (SELECT *, count(*) OVER (PARTITION BY engine) AS n, row_number() OVER (PARTITION BY engine ORDER BY w DESC, path_id) AS k FROM w) GROUP BY engine)""")
def fm19_weight_gates(spark: SparkSession, d: str) -> DataFrame:
    """Effective sample size, divergence from equal weights, greatest weight and the share of the top hundredth, with their gates."""
    w = _weights(spark, d)
    t = running_totals(w, ["engine"], "w", {"c": F.lit(1)})
    # of the weights that tie at the edge of the top hundredth only as many as belong to it
    top = F.ceil(F.col("c_all") * 0.01)
    inside = F.least(F.col("c"), F.greatest(F.lit(0), F.col("c") + F.col("c_before") - (F.col("c_all") - top)))
    x, n = F.col("w"), F.max("c_all")
    g = t.groupBy("engine").agg(n.alias("n"), (1 / F.sum(F.col("c") * x * x)).alias("ess"), F.max("w").alias("top"), F.sum(F.col("c") * x * F.log(x * F.col("c_all"))).alias("kl"), F.sum(inside * x).alias("top_1pct"))
    ok = (F.col("ess") >= 0.2 * F.col("n")) & (F.col("top") <= 0.05) & (F.col("top_1pct") <= 0.1)
    return g.select("engine", "n", r6(F.col("ess")).alias("ess"), r6(F.col("ess") / F.col("n")).alias("ess_share"), F.round("top", 8).alias("max_weight"), F.round("top_1pct", 8).alias("top_1pct"), F.round("kl", 8).alias("kl"), ok.cast("int").alias("passes"))


_TOUCH = _WEIGHED.strip() + """, f AS (SELECT path_id, engine, min(step) AS step FROM v_paths WHERE level < 95 GROUP BY ALL),
    p AS (SELECT engine, step, sum(w) AS pdf FROM f JOIN w USING (path_id, engine) GROUP BY ALL),
    c AS (SELECT *, sum(pdf) OVER (PARTITION BY engine ORDER BY step) AS cdf, sum(pdf) OVER (PARTITION BY engine) AS touched FROM p)"""


def _touch(spark: SparkSession, d: str) -> DataFrame:
    """(engine, step, pdf, cdf, touched) of the first step under the barrier, by weight: one row per engine and step is ordered."""
    first = V.paths(spark, d).where("level < 95").groupBy("path_id", "engine").agg(F.min("step").alias("step"))
    p = first.join(_weights(spark, d), ["path_id", "engine"]).groupBy("engine", "step").agg(F.sum("w").alias("pdf"))
    w = Window.partitionBy("engine").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("cdf", F.sum("pdf").over(w)).withColumn("touched", F.sum("pdf").over(Window.partitionBy("engine")))


@query(_TOUCH + " SELECT engine, step, round(pdf, 8) AS pdf, round(cdf, 8) AS cdf, round(1 - touched, 8) AS never FROM c")
def fm21_weighted_touch(spark: SparkSession, d: str) -> DataFrame:
    return _touch(spark, d).select("engine", "step", F.round("pdf", 8).alias("pdf"), F.round("cdf", 8).alias("cdf"), F.round(1 - F.col("touched"), 8).alias("never"))


@query(_TOUCH + " SELECT engine, min(step) FILTER (cdf / touched >= 0.25 - 1e-12) AS p25, min(step) FILTER (cdf / touched >= 0.5 - 1e-12) AS p50, min(step) FILTER (cdf / touched >= 0.75 - 1e-12) AS p75 FROM c GROUP BY engine")
def fm21_touch_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """When the barrier is touched, given that it is."""
    at = lambda p: F.min(F.when(F.col("cdf") / F.col("touched") >= p - 1e-12, F.col("step")))
    return _touch(spark, d).groupBy("engine").agg(*(at(p).alias(f"p{round(p * 100)}") for p in (0.25, 0.5, 0.75)))


@query(_WEIGHED.strip() + """, x AS (SELECT p.engine, p.step, p.path_id, level, w FROM v_paths p JOIN w ON p.path_id = w.path_id),
    s AS (SELECT engine, step, stddev_samp(level) AS s FROM x GROUP BY ALL), c AS (SELECT a.engine, a.path_id, sum(b.w * abs(a.level - b.level) / s) AS c FROM x a JOIN x b ON a.engine = b.engine AND a.step = b.step JOIN s ON s.engine = a.engine AND s.step = a.step GROUP BY ALL)
    SELECT engine, round(min(c), 5) AS centrality, arg_min(path_id, (round(c, 5), path_id)) AS path_id FROM c GROUP BY engine""")
def fm22_weighted_medoid(spark: SparkSession, d: str) -> DataFrame:
    """The path with the least weighted distance to all others, summed over all steps in each step's spread: prefix sums per step, no pairs."""
    x = V.paths(spark, d).join(_weights(spark, d), ["path_id", "engine"])
    t = running_totals(x, ["engine", "step"], "level", {"a": F.col("w"), "b": F.col("w") * F.col("level")})
    v = F.col("level")
    far = v * F.col("a_before") - F.col("b_before") + (F.col("b_all") - F.col("b_before") - F.col("b")) - v * (F.col("a_all") - F.col("a_before") - F.col("a"))
    spread = x.groupBy("engine", "step").agg(F.stddev_samp("level").alias("s"))
    c = t.join(spread, ["engine", "step"]).select("engine", "step", "level", (far / F.col("s")).alias("c"))
    per = x.join(c, ["engine", "step", "level"]).groupBy("engine", "path_id").agg(F.round(F.sum("c"), 5).alias("c"))
    return per.groupBy("engine").agg(F.min(F.struct("c", "path_id")).alias("m")).select("engine", F.col("m.c").alias("centrality"), "m.path_id")


@query("WITH p AS (SELECT vec_id AS path_id, label AS engine FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY path_id) - 1 AS k, count(*) OVER (PARTITION BY engine) AS n FROM p), pairs AS (SELECT a.engine, a.path_id AS i, b.path_id AS j FROM k a JOIN k b ON a.engine = b.engine AND b.k = (a.k + a.n // 2) % a.n), near AS (SELECT engine, path_id, sqrt(sum((level - 100) * (level - 100))) AS x FROM v_paths GROUP BY ALL), far AS (SELECT q.engine, q.i, sqrt(sum((a.level - b.level) * (a.level - b.level))) AS x FROM pairs q JOIN v_paths a ON a.path_id = q.i JOIN v_paths b ON b.path_id = q.j AND b.step = a.step GROUP BY ALL) SELECT engine, round(a - 0.5 * b, 5) AS energy FROM (SELECT engine, avg(x) AS a FROM near GROUP BY 1) JOIN (SELECT engine, avg(x) AS b FROM far GROUP BY 1) USING (engine)")
def ev04_energy_score(spark: SparkSession, d: str) -> DataFrame:
    """Energy score of whole paths against a level one: the mean distance between paths from each path's partner half the engine away."""
    p = V.paths(spark, d)
    vectors = p.groupBy("engine", "path_id").agg(F.array_sort(F.collect_list(F.struct("step", "level")))["level"].alias("x"))
    norm = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    k = numbered(vectors, ["engine"], ["path_id"], "k")
    n = vectors.groupBy("engine").agg(F.count(F.lit(1)).alias("n"))
    mine = k.join(n, "engine").withColumn("partner", F.pmod(F.col("k") + F.expr("n div 2"), F.col("n")))
    both = mine.join(k.select("engine", F.col("k").alias("partner"), F.col("x").alias("y")), ["engine", "partner"])
    level = F.transform("x", lambda _: F.lit(100.0))
    return both.groupBy("engine").agg(F.round(F.avg(norm(F.col("x"), level)) - 0.5 * F.avg(norm(F.col("x"), F.col("y"))), 5).alias("energy"))


@query("""SELECT engine, step, round(s * (z * (2 * phi - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())), 5) AS crps FROM (SELECT *, CASE WHEN z >= 0 THEN 1 - u ELSE u END AS phi FROM (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * t * t + 1.781477937 * t * t * t - 1.821255978 * power(t, 4) + 1.330274429 * power(t, 5)) AS u
    FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM (SELECT *, (100 - m) / s AS z FROM (SELECT engine, step, avg(level) AS m, greatest(stddev_samp(level), 1e-8) AS s FROM v_paths GROUP BY ALL)))))""")
def ev04_gaussian_crps(spark: SparkSession, d: str) -> DataFrame:
    g = V.paths(spark, d).groupBy("engine", "step").agg(F.avg("level").alias("m"), F.stddev_samp("level").alias("s"))
    return g.select("engine", "step", F.round(scoring.gaussian_crps(F.col("m"), F.col("s"), F.lit(100.0)), 5).alias("crps"))


@query("SELECT bin, count(*) AS n, round(avg(p), 6) AS forecast, round(avg(up), 6) AS realised FROM (SELECT least(floor(p * 10), 9)::bigint AS bin, p, up FROM (SELECT engine, step, avg((level > 100)::int) AS p FROM v_paths GROUP BY ALL) JOIN (SELECT row_number() OVER (ORDER BY date) - 1 AS step, (value >= first_value(value) OVER (ORDER BY date))::int AS up FROM v_macro WHERE series_id = 'AF') USING (step)) GROUP BY bin")
def ev12_direction_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Forecast probability of a rise against how often it came, by tenths; the last is closed on the right."""
    s = Series(["series_id"], "date")
    a = V.macro(spark, d).where("series_id = 'AF'").select((s.number() - 1).alias("step"), (F.col("value") >= F.first("value").over(s.w)).cast("int").alias("up"))
    p = V.paths(spark, d).groupBy("engine", "step").agg(F.avg((F.col("level") > 100).cast("int")).alias("p"))
    return p.join(a, "step").groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("forecast"), r6(F.avg("up")).alias("realised"))


@query("""WITH e AS (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL), c AS (SELECT engine, k::double AS k, avg(greatest(fin - k, 0)) AS c FROM e, (SELECT unnest(range(50, 155, 5)) AS k) GROUP BY ALL),
    b AS (SELECT engine, k, greatest(0, exp(0.02 * 0.5) * (lead(c) OVER w - 2 * c + lag(c) OVER w) / 25) AS f, lag(c) OVER w IS NOT NULL AND lead(c) OVER w IS NOT NULL AS ok FROM c WINDOW w AS (PARTITION BY engine ORDER BY k)) SELECT engine, k AS strike, round(f / nullif(sum(f * 5) OVER (PARTITION BY engine), 0), 8) AS density FROM b WHERE ok""")
def fm17_call_density(spark: SparkSession, d: str) -> DataFrame:
    """The density that call prices imply: second differences over the strikes, negative parts cut, mass one."""
    ends = V.paths(spark, d).groupBy("path_id", "engine").agg(F.max_by("level", "step").alias("fin"))
    strikes = F.array(*(F.lit(float(k)) for k in range(50, 155, 5)))
    calls = ends.select("engine", "fin", F.explode(strikes).alias("strike")).groupBy("engine", "strike").agg(F.avg(F.greatest(F.col("fin") - F.col("strike"), F.lit(0.0))).alias("call"))
    return scoring.call_density(calls, ["engine"], "strike", "call", rate=0.02, years=0.5).select("engine", "strike", F.round("density", 8).alias("density"))
