"""Further relational operators of the inventory over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import pit, scoring
from tidemark.operators.asof import asof_join
from tidemark.operators.ledger import first_of, row_hash
from tidemark.operators.ranks import quantiles
from tidemark.operators.series import Series, correction_episodes, runs
from tidemark.plans import views as V
from tidemark.plans.tables import table
from tidemark.plans.views import close, query

S = Series(["series"], "date")
r6 = lambda c: F.round(c, 6)
ntz = lambda t: F.lit(t).cast("timestamp_ntz")
_MONTHS = "(SELECT series, date_trunc('month', date)::date AS month, arg_max(close, date) AS close FROM v_price GROUP BY ALL)"


def _months(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("series", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))


# ---- filters --------------------------------------------------------------------------------


@query("SELECT o_orderkey, rule FROM orders JOIN (VALUES ('1-URGENT', 'gte', 400000.0), ('2-HIGH', 'lt', 20000.0), ('3-MEDIUM', 'gt', 480000.0), ('4-NOT SPECIFIED', 'lte', 15000.0)) r(p, rule, bound) ON o_orderpriority = p WHERE CASE rule WHEN 'gte' THEN o_totalprice >= bound WHEN 'gt' THEN o_totalprice > bound WHEN 'lt' THEN o_totalprice < bound ELSE o_totalprice <= bound END")
def pf09_rule_table(spark: SparkSession, d: str) -> DataFrame:
    rules = {"1-URGENT": ("gte", 400000.0), "2-HIGH": ("lt", 20000.0), "3-MEDIUM": ("gt", 480000.0), "4-NOT SPECIFIED": ("lte", 15000.0)}
    holds = {"gte": lambda x, b: x >= b, "gt": lambda x, b: x > b, "lt": lambda x, b: x < b, "lte": lambda x, b: x <= b}
    x, p = F.col("o_totalprice"), F.col("o_orderpriority")
    rule = first_of(*((p == k, F.when(holds[op](x, b), op)) for k, (op, b) in rules.items()))
    return table(spark, d, "orders").select("o_orderkey", rule.alias("rule")).where("rule IS NOT NULL")


@query("SELECT series_id, date, CASE WHEN g > 0.05 THEN 'expansion' WHEN g < -0.05 THEN 'contraction' WHEN g IS NOT NULL THEN 'neutral' END AS zone FROM (SELECT series_id, date, value / lag(value, 4) OVER (PARTITION BY series_id ORDER BY date) - 1 AS g FROM v_macro)")
def pf11_zones(spark: SparkSession, d: str) -> DataFrame:
    g = Series(["series_id"], "date").change(F.col("value"), 4)
    return V.macro(spark, d).select("series_id", "date", F.when(g > 0.05, "expansion").when(g < -0.05, "contraction").when(g.isNotNull(), "neutral").alias("zone"))


@query("SELECT series, date, CASE WHEN date BETWEEN DATE '1998-07-01' AND DATE '1998-10-31' THEN 'stress' WHEN close > m THEN 'bull' WHEN close < m THEN 'bear' ELSE 'range' END AS regime FROM (SELECT *, avg(close) OVER (PARTITION BY series ORDER BY date ROWS 19 PRECEDING) AS m FROM v_price)")
def pf12_regimes(spark: SparkSession, d: str) -> DataFrame:
    m = S.rolling(F.avg, close(), 20, full=False)
    in_stress = F.col("date").between("1998-07-01", "1998-10-31")
    return V.prices(spark, d).select("series", "date", F.when(in_stress, "stress").when(close() > m, "bull").when(close() < m, "bear").otherwise("range").alias("regime"))


@query("SELECT count(*) AS n, sum((close > 0 AND isfinite(close))::int)::bigint AS positive FROM v_price")
def pf13_positive_guard(spark: SparkSession, d: str) -> DataFrame:
    """``raise_error`` where a close isn't positive and finite; counts what passed."""
    ok = (close() > 0) & ~F.isnan("close") & (close() < float("inf"))
    guarded = V.prices(spark, d).withColumn("close", F.when(ok, close()).otherwise(F.raise_error(F.lit("close not positive")).cast("double")))
    return guarded.agg(F.count(F.lit(1)).alias("n"), F.sum((close() > 0).cast("int")).alias("positive"))


# ---- joins ----------------------------------------------------------------------------------


@query("SELECT a.forecast_id, b.probability AS reference FROM v_forecasts a LEFT JOIN LATERAL (SELECT probability FROM v_forecasts b WHERE b.question_id = a.question_id AND b.ts < a.ts ORDER BY b.ts DESC, b.probability DESC LIMIT 1) b ON true")
def jn15_reference_before(spark: SparkSession, d: str) -> DataFrame:
    """The latest earlier round of the same question: never one of the same moment."""
    f = V.forecasts(spark, d)
    runs_ = f.select("question_id", F.col("ts").alias("run_ts"), F.col("probability").alias("reference"))
    return asof_join(f.select("forecast_id", "question_id", "ts"), runs_, by=["question_id"], left_time="ts", right_time="run_ts", values=["reference"], strict=True).select("forecast_id", "reference")


@query("SELECT lag::int AS lag, alpha, origin::int AS origin, origin + lag * 2 AS first_row FROM (SELECT unnest([1, 2, 5]) AS lag), (SELECT unnest([0.01, 0.1, 1.0]::double[]) AS alpha), (SELECT unnest(range(40, 80, 10)) AS origin)")
def jn20_candidate_grid(spark: SparkSession, d: str) -> DataFrame:
    """Candidates x origins: parameter lists, not data, so the product is a few dozen rows."""
    one = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in (1, 2, 5)))).alias("lag"))
    return one.select("lag", F.explode(F.array(*(F.lit(x) for x in (0.01, 0.1, 1.0)))).alias("alpha")).select("lag", "alpha", F.explode(F.sequence(F.lit(40), F.lit(70), F.lit(10))).alias("origin")).withColumn("first_row", (F.col("origin") + F.col("lag") * 2).cast("long"))


# ---- aggregations ----------------------------------------------------------------------------


@query("SELECT event_type AS space, CASE WHEN value > 20 THEN 'big' ELSE 'small' END AS unit, count(*) AS n FROM events GROUP BY ALL")
def ag11_count_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("space"), F.when(F.col("value") > 20, "big").otherwise("small").alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS outcome, count(*) AS n, round(count(*) / max(t), 6) AS share FROM orders, (SELECT count(*) AS t FROM orders WHERE o_totalprice > 50000) WHERE o_totalprice > 50000 GROUP BY 1")
def ag12_base_rates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").where("o_totalprice > 50000").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


@query("SELECT count(*) AS n, round(avg((s / 100 - outcome) * (s / 100 - outcome)), 6) AS shadow, round(avg(brier), 6) AS official FROM (SELECT *, least(99, probability + 3) AS s FROM v_res)")
def ag20_shadow_brier(spark: SparkSession, d: str) -> DataFrame:
    s = F.least(F.lit(99), F.col("probability") + 3) / 100
    return V.resolutions(spark, d).agg(F.count(F.lit(1)).alias("n"), r6(scoring.brier(s, F.col("outcome"))).alias("shadow"), r6(F.avg("brier")).alias("official"))


@query(V.three_factor_ridge("SELECT max(value) FILTER (series_id = 'AO') AS x1, max(value) FILTER (series_id = 'NF') AS x2, max(value) FILTER (series_id = 'RF') AS x3, max(value) FILTER (series_id = 'AF') AS y FROM v_macro GROUP BY date", ("AO", "NF", "RF"), 0))
def ag25_multifactor_ols(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of one series on three others and a constant, by the Gram matrix of one aggregation."""
    from tidemark.operators.models import ridge

    ids = ["AF", "AO", "NF", "RF"]
    w = V.macro(spark, d).groupBy("date").agg(*(F.max(F.when(F.col("series_id") == i, F.col("value"))).alias(i) for i in ids)).dropna()
    fit = ridge(w, ids[1:], "AF", 0.0)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in fit.items()], "term string, coefficient double")


@query("SELECT bucket, n, CASE WHEN n >= 500 THEN rate END AS rate FROM (SELECT CASE WHEN round <= 2 THEN 'early' WHEN round <= 8 THEN 'middle' ELSE 'late' END AS bucket, count(*) AS n, round(avg(((probability >= 50) = (outcome = 1))::int), 6) AS rate FROM v_res JOIN (SELECT forecast_id AS f, round FROM v_forecasts) ON f = forecast_id GROUP BY 1)")
def ag30_bucket_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = V.resolutions(spark, d).join(V.forecasts(spark, d).select("forecast_id", "round"), "forecast_id")
    hit = ((F.col("probability") >= 50) == (F.col("outcome") == 1)).cast("int")
    g = r.groupBy(F.when(F.col("round") <= 2, "early").when(F.col("round") <= 8, "middle").otherwise("late").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(hit)).alias("rate"))
    return g.select("bucket", "n", F.when(F.col("n") >= 500, F.col("rate")).alias("rate"))


# ---- top-k --------------------------------------------------------------------------------------


@query("SELECT date, value FROM v_macro WHERE series_id = 'AF' ORDER BY date DESC LIMIT 1")
def tk02_latest_row(spark: SparkSession, d: str) -> DataFrame:
    return V.macro(spark, d).where("series_id = 'AF'").orderBy(F.col("date").desc()).limit(1).select("date", "value")


@query("WITH near AS (SELECT m.series, m.month, round(abs(m.close - l.here), 6) AS distance FROM " + _MONTHS + " m JOIN (SELECT series, arg_max(close, month) AS here, max(month) AS origin FROM " + _MONTHS + " GROUP BY 1) l ON l.series = m.series WHERE month < origin), c AS (SELECT series, list((distance, month) ORDER BY distance, month) AS xs FROM near GROUP BY 1), g AS (SELECT series, xs, 1 AS pos, []::STRUCT(distance DOUBLE, month DATE)[] AS got FROM c UNION ALL SELECT series, xs, pos + 1, CASE WHEN len(got) < 5 AND len(list_filter(got, lambda y: abs(y.month - xs[pos][2]) < 90)) = 0 THEN list_append(got, {'distance': xs[pos][1], 'month': xs[pos][2]}) ELSE got END FROM g WHERE pos <= len(xs)) SELECT series, unnest(range(1, len(got) + 1))::int AS rank, unnest(list_transform(got, lambda y: y.month)) AS month, unnest(list_transform(got, lambda y: y.distance)) AS distance FROM g WHERE pos = len(xs) + 1")
def tk05_greedy_gap(spark: SparkSession, d: str) -> DataFrame:
    """The five months per series nearest to its last one, at least 90 days apart."""
    from tidemark.operators.series import greedy_gap

    m = _months(spark, d)
    last = m.groupBy("series").agg(F.max_by("close", "month").alias("here"), F.max("month").alias("origin"))
    near = m.join(last, "series").where("month < origin").withColumn("distance", F.round(F.abs(close() - F.col("here")), 6))
    return greedy_gap(near, ["series"], "month", "distance", 5, 90)


@query("SELECT engine, level_at, path_id FROM (SELECT engine, q.level_at, p.path_id, row_number() OVER (PARTITION BY engine, level_at ORDER BY abs(fin - CASE level_at WHEN 10 THEN q10 WHEN 50 THEN q50 ELSE q90 END), path_id) AS k FROM (SELECT path_id, engine, round(arg_max(level, step), 6) AS fin FROM v_paths GROUP BY ALL) p JOIN (SELECT engine AS e, quantile_cont(fin, 0.1) q10, quantile_cont(fin, 0.5) q50, quantile_cont(fin, 0.9) q90 FROM (SELECT path_id, engine, round(arg_max(level, step), 6) AS fin FROM v_paths GROUP BY ALL) GROUP BY 1) ON engine = e, (SELECT unnest([10, 50, 90])::int AS level_at) q) WHERE k = 1")
def tk07_representatives(spark: SparkSession, d: str) -> DataFrame:
    ends = V.paths(spark, d).groupBy("path_id", "engine").agg(r6(F.max_by("level", "step")).alias("fin"))
    q = quantiles(ends, ["engine"], "fin", [0.1, 0.5, 0.9]).select("engine", F.posexplode("q").alias("i", "at"))
    near = ends.join(q, "engine").groupBy("engine", "i").agg(F.min(F.struct(F.abs(F.col("fin") - F.col("at")).alias("gap"), "path_id")).alias("m"))
    return near.select("engine", F.element_at(F.array(F.lit(10), F.lit(50), F.lit(90)), F.col("i") + 1).alias("level_at"), "m.path_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_totalprice > 300000 THEN 1 ELSE 2 END AS rank FROM orders ORDER BY rank, o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def tk08_priority_order(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_totalprice") > 300000, 1).otherwise(2)
    return table(spark, d, "orders").withColumn("rank", rank).orderBy("rank", "o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "rank")


# ---- ledgers --------------------------------------------------------------------------------


@query("SELECT question_id, round, CASE WHEN ts < pts THEN 'time' WHEN round <> coalesce(pr + 1, 1) THEN 'seq' END AS reason FROM (SELECT question_id, round, ts, lag(ts) OVER w AS pts, lag(round) OVER w AS pr FROM v_forecasts WHERE probability <> 50 WINDOW w AS (PARTITION BY question_id ORDER BY round)) WHERE ts < pts OR round <> coalesce(pr + 1, 1)")
def mu07_chain_validation(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["question_id"], "round")
    f = V.forecasts(spark, d).where("probability != 50").select("question_id", "round", "ts", s.lag(F.col("ts")).alias("pts"), s.lag(F.col("round")).alias("pr"))
    reason = F.when(F.col("ts") < F.col("pts"), "time").when(F.col("round") != F.coalesce(F.col("pr") + 1, F.lit(1)), "seq")
    return f.select("question_id", "round", reason.alias("reason")).where("reason IS NOT NULL")


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderdate <= last THEN 'historical' ELSE 'new' END AS verdict FROM orders JOIN (SELECT o_custkey AS c, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c WHERE o_orderstatus = 'O'")
def mu09_historical_inserts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    last = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return o.where("o_orderstatus = 'O'").join(last, "o_custkey").select("o_custkey", "o_orderkey", F.when(F.col("o_orderdate") <= F.col("last"), "historical").otherwise("new").alias("verdict"))


# ---- alignment --------------------------------------------------------------------------------


@query("SELECT series, date, round(ret, 6) AS ret, CASE WHEN n20 = 20 THEN round(vol * sqrt(252), 6) END AS vol20, CASE WHEN k >= 200 THEN round(close / m200 - 1, 6) END AS dist200, round(close / peak - 1, 6) AS drawdown, round(100 * close / base, 6) AS idx FROM (SELECT *, stddev_samp(lr) OVER f20 AS vol, count(lr) OVER f20 AS n20 FROM (SELECT *, close / lag(close) OVER w - 1 AS ret, ln(close) - lag(ln(close)) OVER w AS lr, avg(close) OVER (PARTITION BY series ORDER BY date ROWS 199 PRECEDING) AS m200, max(close) OVER w AS peak, first_value(close) OVER w AS base, row_number() OVER w AS k FROM v_price WINDOW w AS (PARTITION BY series ORDER BY date)) WINDOW f20 AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING))")
def al01_derived_daily(spark: SparkSession, d: str) -> DataFrame:
    """All daily indicators over one partitioning and one sort."""
    p = V.prices(spark, d).withColumn("lr", S.log_change(close()))
    return p.select("series", "date", r6(S.change(close())).alias("ret"), r6(S.rolling(F.stddev_samp, F.col("lr"), 20) * F.sqrt(F.lit(252.0))).alias("vol20"), r6(close() / S.rolling(F.avg, close(), 200) - 1).alias("dist200"), r6(S.drawdown(close())).alias("drawdown"), r6(100 * close() / F.first("close").over(S.w)).alias("idx"))


@query("SELECT k::int AS shift, n, rmse FROM (SELECT k, count(*) AS n, round(sqrt(avg((a.z - b.z) * (a.z - b.z))), 6) AS rmse FROM (SELECT unnest(range(-12, 13)) AS k), (SELECT year(month) * 12 + month(month) AS m, (close - avg(close) OVER ()) / stddev_pop(close) OVER () AS z FROM " + _MONTHS + " WHERE series = '1-URGENT') a, (SELECT year(month) * 12 + month(month) AS m, (close - avg(close) OVER ()) / stddev_pop(close) OVER () AS z FROM " + _MONTHS + " WHERE series = '2-HIGH') b WHERE b.m = a.m + k GROUP BY k) WHERE n >= 24 ORDER BY rmse, k LIMIT 1")
def al07_best_shift(spark: SparkSession, d: str) -> DataFrame:
    m = _months(spark, d).where("series IN ('1-URGENT', '2-HIGH')").withColumn("m", F.year("month") * 12 + F.month("month"))
    w = Window.partitionBy("series")
    z = m.select("series", "m", ((close() - F.avg("close").over(w)) / F.stddev_pop("close").over(w)).alias("z"))
    a = z.where("series = '1-URGENT'").select("m", F.col("z").alias("x"), F.explode(F.sequence(F.lit(-12), F.lit(12))).alias("shift"))
    b = z.where("series = '2-HIGH'").select(F.col("m").alias("mb"), F.col("z").alias("y"))
    diff = F.col("x") - F.col("y")
    return a.join(b, F.col("mb") == F.col("m") + F.col("shift")).groupBy("shift").agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(diff * diff))).alias("rmse")).where("n >= 24").orderBy("rmse", "shift").limit(1)


@query("SELECT p.series, round(l.close / o.close - 1, 6) AS one_year, round(100 * avg((p.close <= l.close)::int), 6) AS pctile FROM v_price p JOIN (SELECT series, close FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS k FROM v_price) WHERE k = 1) l ON p.series = l.series JOIN (SELECT series, close FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS k FROM v_price) WHERE k = 253) o ON p.series = o.series GROUP BY p.series, l.close, o.close")
def al10_digest(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.col("date").desc())))
    ends = p.where("k IN (1, 253)").groupBy("series").agg(F.max(F.when(F.col("k") == 1, close())).alias("now"), F.max(F.when(F.col("k") == 253, close())).alias("then")).where("then IS NOT NULL")
    return p.join(ends, "series").groupBy("series", "now", "then").agg(r6(100 * F.avg((close() <= F.col("now")).cast("int"))).alias("pctile")).select("series", r6(F.col("now") / F.col("then") - 1).alias("one_year"), "pctile")


@query("SELECT series, month, k FROM (SELECT a.series, a.month, row_number() OVER (PARTITION BY a.series ORDER BY abs(date_diff('month', a.month, DATE '1998-06-01')), a.month) AS k FROM " + _MONTHS + " a WHERE abs(date_diff('month', a.month, DATE '1998-06-01')) <= 6) WHERE k <= 4")
def al12_band_with_cap(spark: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.months_between("month", F.lit("1998-06-01").cast("date"))).cast("int")
    near = _months(spark, d).withColumn("gap", gap).where("gap <= 6")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy("gap", "month")).cast("long")).where("k <= 4").select("series", "month", "k")


@query("""WITH e AS (SELECT series, y, make_date(y, 11, 5) AS e FROM (SELECT DISTINCT series, year(date)::int AS y FROM v_price)), w AS (SELECT series, year(date)::int AS y, min(dd) AS dd FROM (SELECT series, date, close / max(close) OVER (PARTITION BY series, year(date) ORDER BY date) - 1 AS dd FROM v_price WHERE date BETWEEN make_date(year(date), 8, 1) AND make_date(year(date), 11, 5)) GROUP BY ALL),
    c AS (SELECT e.series, e.y, (SELECT arg_max(close, date) FROM v_price p WHERE p.series = e.series AND p.date <= e.e) AS a, (SELECT arg_max(close, date) FROM v_price p WHERE p.series = e.series AND p.date <= make_date(e.y, 12, 31)) AS b, (SELECT arg_max(close, date) FROM v_price p WHERE p.series = e.series AND p.date <= e.e + 365) AS c, (SELECT max(date) FROM v_price p WHERE p.series = e.series) AS last, e.e FROM e)
    SELECT series, y AS year, round(dd, 6) AS pre_window_dd, round(b / a - 1, 6) AS to_year_end, round(c / a - 1, 6) AS plus_12m FROM c JOIN w USING (series, y) WHERE e + 370 <= last""")
def al13_seasonality(spark: SparkSession, d: str) -> DataFrame:
    """Around 5 November of each year: the deepest fall since August, then the change to the year's end and in twelve months, by closes as of each day."""
    p = V.prices(spark, d).withColumn("year", F.year("date"))
    event = F.make_date("year", F.lit(11), F.lit(5))
    pre = p.where(F.col("date").between(F.make_date("year", F.lit(8), F.lit(1)), event)).withColumn("dd", Series(["series", "year"], "date").drawdown(close())).groupBy("series", "year").agg(F.min("dd").alias("dd"))
    last = p.groupBy("series").agg(F.max("date").alias("last"))
    x = pre.join(last, "series").withColumn("e", event).where(F.date_add("e", 370) <= F.col("last"))
    for name, at in (("a", F.col("e")), ("b", F.make_date("year", F.lit(12), F.lit(31))), ("c", F.date_add("e", 365))):
        known = p.select("series", "date", F.col("close").alias(name))
        x = asof_join(x.withColumn("_at", at), known, by=["series"], left_time="_at", right_time="date", values=[name]).drop("_at")
    return x.select("series", "year", r6(F.col("dd")).alias("pre_window_dd"), r6(F.col("b") / F.col("a") - 1).alias("to_year_end"), r6(F.col("c") / F.col("a") - 1).alias("plus_12m"))


@query("SELECT era, series, first, last, round(b / a - 1, 6) AS ret FROM (SELECT era, series, min(date) AS first, max(date) AS last, arg_min(close, date) AS a, arg_max(close, date) AS b FROM v_price JOIN (VALUES ('one', DATE '1996-03-01', DATE '1996-09-30'), ('two', DATE '1998-08-01', DATE '1998-12-31'), ('none', DATE '1980-01-01', DATE '1980-12-31')) e(era, s, t) ON date BETWEEN e.s AND e.t GROUP BY ALL HAVING min(date) <= min(e.s) + 14)")
def al14_event_study(spark: SparkSession, d: str) -> DataFrame:
    eras = spark.sql("SELECT * FROM VALUES ('one', DATE '1996-03-01', DATE '1996-09-30'), ('two', DATE '1998-08-01', DATE '1998-12-31'), ('none', DATE '1980-01-01', DATE '1980-12-31') AS e(era, s, t)")
    x = V.prices(spark, d).join(F.broadcast(eras), F.col("date").between(F.col("s"), F.col("t"))).groupBy("era", "series", "s").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"))
    return x.where(F.col("first") <= F.date_add("s", 14)).select("era", "series", "first", "last", r6(F.col("b") / F.col("a") - 1).alias("ret"))


@query("""WITH o AS (SELECT series, date_trunc('month', date)::date AS origin FROM v_price GROUP BY ALL), e AS (SELECT series, origin, (SELECT min(date) FROM v_price p WHERE p.series = o.series AND p.date >= o.origin + INTERVAL 1 MONTH) AS entry FROM o),
    x AS (SELECT *, (SELECT min(date) FROM v_price p WHERE p.series = e.series AND p.date >= e.entry + INTERVAL 6 MONTH) AS out FROM e WHERE date_trunc('month', entry) = origin + INTERVAL 1 MONTH), v AS (SELECT series, min(date) AS ex FROM v_price WHERE month(date) IN (3, 6, 9, 12) GROUP BY series, date_trunc('month', date)),
    h AS (SELECT x.series, x.origin, x.entry, p.date, p.close, p.close * exp(sum(CASE WHEN v.ex > x.entry THEN ln(1 + 500 / p.close) ELSE 0 END) OVER (PARTITION BY x.series, x.origin ORDER BY p.date)) AS total FROM x JOIN v_price p ON p.series = x.series AND p.date BETWEEN x.entry AND x.out LEFT JOIN v ON v.series = p.series AND v.ex = p.date),
    k AS (SELECT *, max(total) OVER (PARTITION BY series, origin ORDER BY date) AS peak FROM h), m AS (SELECT series, origin, entry, arg_min(close, date) AS c0, arg_max(close, date) AS c1, arg_min(total, date) AS t0, arg_max(total, date) AS t1, min(round(total / peak - 1, 12)) AS dd, arg_min(date, (round(total / peak - 1, 12), date)) AS trough, arg_min(peak, (round(total / peak - 1, 12), date)) AS top FROM k GROUP BY ALL)
    SELECT series, origin, entry, round(c1 * 0.9995 / (c0 * 1.0005) - 1, 6) AS price_return, round(t1 * 0.9995 / (t0 * 1.0005) - 1, 6) AS total_return, round(dd, 6) AS max_drawdown, CASE WHEN dd = 0 THEN 0 ELSE (SELECT min(date) FROM h WHERE h.series = m.series AND h.origin = m.origin AND h.date > m.trough AND h.total >= m.top) - trough END::int AS recovery_days FROM m""")
def al16_entry_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Entry at the first session after each month, held six months to the next session, 5 + 5 bp of costs; dividends of 500
    at the first session of each quarter's last month buy further shares at that close. Incomplete holdings have no row."""
    p = V.prices(spark, d)
    ex = p.where(F.month("date").isin(3, 6, 9, 12)).groupBy("series", F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date")).select("series", "date", F.lit(True).alias("ex"))
    days = p.join(ex, ["series", "date"], "left")
    origins = p.select("series", F.trunc("date", "month").alias("origin")).distinct().withColumn("from", F.add_months("origin", 1))
    first = lambda left, at, name: asof_join(left, p.select("series", "date", F.col("date").alias(name)), by=["series"], left_time=at, right_time="date", values=[name], forward=True).where(F.col(name).isNotNull())
    entry = first(origins, "from", "entry").where(F.trunc("entry", "month") == F.col("from")).withColumn("to", F.add_months("entry", 6))
    held = first(entry, "to", "out").select("series", "origin", "entry", "out")
    # the calendar bounds both sides: a day can only belong to the origins of the eight months before it, and of a gap before that one's end
    per = held.withColumn("m", F.explode(F.sequence(F.trunc("entry", "month"), F.trunc("out", "month"), F.expr("INTERVAL 1 MONTH"))))
    both = days.withColumn("m", F.trunc("date", "month")).join(per, ["series", "m"]).where(F.col("date").between(F.col("entry"), F.col("out")))
    s = Series(["series", "origin"], "date")
    grown = F.sum(F.when(F.col("ex") & (F.col("date") > F.col("entry")), F.log1p(500 / F.col("close"))).otherwise(0.0)).over(s.so_far)
    t = both.withColumn("total", F.col("close") * F.exp(grown)).withColumn("peak", F.max("total").over(s.so_far)).withColumn("dd", F.round(F.col("total") / F.col("peak") - 1, 12))
    m = t.groupBy("series", "origin", "entry").agg(F.min_by("close", "date").alias("c0"), F.max_by("close", "date").alias("c1"), F.min_by("total", "date").alias("t0"), F.max_by("total", "date").alias("t1"), F.min(F.struct("dd", "date", "peak")).alias("w"))
    back = t.join(m.select("series", "origin", F.col("w.date").alias("trough"), F.col("w.peak").alias("top")), ["series", "origin"]).where("date > trough AND total >= top").groupBy("series", "origin").agg(F.min("date").alias("back"))
    earned = lambda a, b: r6(F.col(b) * 0.9995 / (F.col(a) * 1.0005) - 1)
    return m.join(back, ["series", "origin"], "left").select("series", "origin", "entry", earned("c0", "c1").alias("price_return"), earned("t0", "t1").alias("total_return"), r6(F.col("w.dd")).alias("max_drawdown"), F.when(F.col("w.dd") == 0, 0).otherwise(F.datediff("back", "w.date")).alias("recovery_days"))


@query("SELECT f.d AS friday, a.value - b.value - c.value / 1000 AS net FROM (SELECT unnest(range(DATE '1996-01-05'::timestamp, DATE '2001-06-29'::timestamp, INTERVAL 7 DAY))::date AS d) f JOIN LATERAL (SELECT value FROM v_macro WHERE series_id = 'AF' AND date <= f.d ORDER BY date DESC LIMIT 1) a ON true JOIN LATERAL (SELECT value FROM v_macro WHERE series_id = 'NO' AND date <= f.d ORDER BY date DESC LIMIT 1) b ON true JOIN LATERAL (SELECT value FROM v_macro WHERE series_id = 'RF' AND date <= f.d ORDER BY date DESC LIMIT 1) c ON true")
def al17_composite_as_of(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.calendar import weekday_grid

    x = weekday_grid(spark, "1996-01-01", "2001-06-28", 4).withColumn("k", F.lit(1))
    for i in ("AF", "NO", "RF"):
        m = V.macro(spark, d).where(F.col("series_id") == i).select(F.lit(1).alias("k"), "date", F.col("value").alias(i))
        x = asof_join(x, m, by=["k"], left_time="day", right_time="date", values=[i])
    return x.where("AF IS NOT NULL AND NO IS NOT NULL AND RF IS NOT NULL").select(F.col("day").alias("friday"), (F.col("AF") - F.col("NO") - F.col("RF") / 1000).alias("net"))


@query("SELECT step, round(exp(median(l)), 6) AS mid, round(exp(quantile_cont(l, 0.75)) - exp(quantile_cont(l, 0.25)), 6) AS iqr FROM (SELECT step, ln(level) AS l FROM v_paths) GROUP BY step")
def al18_log_composite(spark: SparkSession, d: str) -> DataFrame:
    x = quantiles(V.paths(spark, d), ["step"], F.log("level"), [0.25, 0.5, 0.75])
    return x.select("step", r6(F.exp(F.col("q")[1])).alias("mid"), r6(F.exp(F.col("q")[2]) - F.exp(F.col("q")[0])).alias("iqr"))


# ---- paths and scores -------------------------------------------------------------------------


@query("SELECT engine, path_id, centrality FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY centrality, path_id) AS k FROM (SELECT a.engine, a.path_id, round(sum(abs(a.fin - b.fin)), 4) AS centrality FROM (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) a JOIN (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) b ON a.engine = b.engine GROUP BY ALL)) WHERE k = 1")
def fm22_medoid(spark: SparkSession, d: str) -> DataFrame:
    """The path whose end is nearest to all others' in sum, from prefix sums instead of pairs."""
    ends = V.paths(spark, d).groupBy("path_id", "engine").agg(F.max_by("level", "step").alias("fin"))
    return scoring.weighted_medoid(ends.withColumn("one", F.lit(1.0)), ["engine"], "path_id", "fin", "one").select("engine", "path_id", "centrality")


@query("SELECT domain, w, round(w * least(1, 0.35 / sum(w) OVER (PARTITION BY c)), 6) AS capped FROM (SELECT domain, substr(domain, 1, 1) AS c, round(count(*) / 10000.0, 6)::double AS w FROM v_res GROUP BY 1)")
def fm24_dependency_cap(spark: SparkSession, d: str) -> DataFrame:
    w = V.resolutions(spark, d).groupBy("domain").agg(r6(F.count(F.lit(1)) / 10000.0).alias("w"))
    return w.select("domain", "w", r6(F.col("w") * F.least(F.lit(1.0), 0.35 / F.sum("w").over(Window.partitionBy(F.substring("domain", 1, 1))))).alias("capped"))


@query("SELECT series, estimate, CASE WHEN n < 20 THEN 'insufficient' WHEN lo > 0 OR hi < 0 THEN 'significant' ELSE 'inconclusive' END AS state FROM (SELECT series, n, round(m, 6) AS estimate, m - 1.645 * s / sqrt(n) AS lo, m + 1.645 * s / sqrt(n) AS hi FROM (SELECT series, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s FROM (SELECT series, ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY month) AS r FROM " + _MONTHS + ") GROUP BY series))")
def fm27_significance(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series"], "month")
    r = _months(spark, d).select("series", s.log_change(close()).alias("r")).groupBy("series").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    half = 1.645 * F.col("s") / F.sqrt("n")
    return r.select("series", r6(F.col("m")).alias("estimate"), F.when(F.col("n") < 20, "insufficient").when((F.col("m") - half > 0) | (F.col("m") + half < 0), "significant").otherwise("inconclusive").alias("state"))


_LEVELS = "[0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95]"


@query(f"SELECT engine, step, round(sum((1 + 4 * abs(q - 0.5)) * greatest(q * (100 - x), (q - 1) * (100 - x))) / sum(1 + 4 * abs(q - 0.5)), 6) AS twcrps FROM (SELECT engine, step, unnest({_LEVELS}::double[]) AS q, unnest(quantile_cont(level, {_LEVELS})) AS x FROM v_paths GROUP BY engine, step) GROUP BY ALL")
def ev04_tail_weighted(spark: SparkSession, d: str) -> DataFrame:
    levels = [0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95]
    q = quantiles(V.paths(spark, d), ["engine", "step"], "level", levels).withColumnRenamed("q", "x")
    long = q.select("engine", "step", F.explode(F.arrays_zip(F.array(*(F.lit(v) for v in levels)).alias("q"), F.col("x").alias("x"))).alias("z")).select("engine", "step", "z.*")
    w = 1 + 4 * F.abs(F.col("q") - 0.5)
    return long.groupBy("engine", "step").agg(r6(F.sum(w * scoring.pinball(F.col("q"), F.col("x"), F.lit(100.0))) / F.sum(w)).alias("twcrps"))


@query("SELECT h, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)) / avg(abs(b)), 6) AS mase FROM (SELECT h, lead_r - mean_r AS e, lead_r AS b FROM (SELECT 5::int AS h, ln(lead(close, 5) OVER w / close) AS lead_r, avg(0.001) OVER w AS mean_r FROM v_price WINDOW w AS (PARTITION BY series ORDER BY date) UNION ALL SELECT 21, ln(lead(close, 21) OVER w / close), avg(0.002) OVER w FROM v_price WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE lead_r IS NOT NULL) GROUP BY h")
def ev08_backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    ahead = V.prices(spark, d).select(*(F.log(F.lead("close", h).over(S.w) / close()).alias(f"b{h}") for h in (5, 21)))
    p = ahead.select(F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(m).alias("m"), F.col(f"b{h}").alias("b")) for h, m in ((5, 0.001), (21, 0.002))))).alias("x")).select("x.*").where("b IS NOT NULL").withColumn("e", F.col("b") - F.col("m"))
    return p.groupBy("h").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs("e"))).alias("mae"), r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), r6(F.avg(F.abs("e")) / F.avg(F.abs("b"))).alias("mase"))


@query("SELECT domain, array_to_string(list_filter([CASE WHEN n < 1500 THEN 'few' END, CASE WHEN brier > 0.34 THEN 'brier' END, CASE WHEN years < 5 THEN 'span' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT domain, count(*) AS n, avg(brier) AS brier, count(DISTINCT resolved_date) AS years FROM v_res GROUP BY 1)")
def ev13_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    g = V.resolutions(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg("brier").alias("brier"), F.count_distinct("resolved_date").alias("years"))
    why = F.array_compact(F.array(F.when(F.col("n") < 1500, F.lit("few")), F.when(F.col("brier") > 0.34, F.lit("brier")), F.when(F.col("years") < 5, F.lit("span"))))
    return g.select("domain", F.concat_ws(",", why).alias("reasons"))


@query("SELECT q.engine, q.step, a.v AS actual, (a.v BETWEEN q.lo AND q.hi)::int AS inside FROM (SELECT engine, step, quantile_cont(level, 0.1) AS lo, quantile_cont(level, 0.9) AS hi FROM v_paths GROUP BY ALL) q JOIN (SELECT row_number() OVER (ORDER BY date) - 1 AS step, round(100 * value / first_value(value) OVER (ORDER BY date), 6) AS v FROM v_macro WHERE series_id = 'AF') a ON q.step = a.step")
def ev16_band_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series_id"], "date")
    a = V.macro(spark, d).where("series_id = 'AF'").select((s.number() - 1).alias("step"), r6(100 * F.col("value") / F.first("value").over(s.w)).alias("actual"))
    q = quantiles(V.paths(spark, d), ["engine", "step"], "level", [0.1, 0.9]).select("engine", "step", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return q.join(a, "step").select("engine", "step", "actual", F.col("actual").between(F.col("lo"), F.col("hi")).cast("int").alias("inside"))


@query("SELECT domain, n, llm, reference, CASE WHEN n >= 30 THEN (llm < reference)::int END AS better FROM (SELECT r.domain, count(*) AS n, round(avg(r.brier), 6) AS llm, round(avg((p.probability / 100 - r.outcome) * (p.probability / 100 - r.outcome)), 6) AS reference FROM v_res r JOIN v_forecasts f ON f.forecast_id = r.forecast_id JOIN v_forecasts p ON p.question_id = f.question_id AND p.round = f.round - 1 GROUP BY 1)")
def ev17_benchmark(spark: SparkSession, d: str) -> DataFrame:
    f = V.forecasts(spark, d).select("forecast_id", "question_id", "round", F.col("probability").alias("p"))
    pairs = f.join(f.select("question_id", (F.col("round") + 1).alias("round"), (F.col("p") / 100).alias("q")), ["question_id", "round"]).select("forecast_id", "q")
    g = V.resolutions(spark, d).join(pairs, "forecast_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("brier")).alias("llm"), r6(scoring.brier(F.col("q"), F.col("outcome"))).alias("reference"))
    return g.withColumn("better", F.when(F.col("n") >= 30, (F.col("llm") < F.col("reference")).cast("int")))


# ---- small operators -----------------------------------------------------------------------------


@query("SELECT forecast_id, round((probability - m) / nullif(s, 0), 6) AS surprise, round(exp(probability / 50) / sum(exp(probability / 50)) OVER (PARTITION BY question_id), 8) AS branch FROM v_forecasts JOIN (SELECT question_id AS q, avg(probability) AS m, stddev_pop(probability) AS s FROM v_forecasts GROUP BY 1) ON question_id = q")
def so03_surprise_and_branches(spark: SparkSession, d: str) -> DataFrame:
    f, w = V.forecasts(spark, d), Window.partitionBy("question_id")
    p = F.col("probability")
    e = F.exp(p / 50)
    return f.select("forecast_id", r6((p - F.avg(p).over(w)) / F.nullif(F.stddev_pop(p).over(w), F.lit(0.0))).alias("surprise"), F.round(e / F.sum(e).over(w), 8).alias("branch"))


@query("SELECT fact_id, value FROM v_facts WHERE vintage_start <= TIMESTAMP '2024-01-15'")
def so04_guarded_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rows visible at T; a visible row whose actual is later raises."""
    t = ntz("2024-01-15 00:00:00")
    seen = V.facts(spark, d).where(F.col("vintage_start") <= t)
    checked = F.when(F.to_date("vintage_start") >= F.col("observation_date"), F.col("value")).otherwise(F.raise_error(F.lit("actual later than the cut-off")).cast("double"))
    return seen.select("fact_id", checked.alias("value"))


@query("SELECT forecast_id, CASE WHEN n >= 5 THEN round(1 / (1 + exp(-(0.1 + 0.8 * ln(p / (1 - p))))), 8) ELSE p END AS calibrated FROM (SELECT forecast_id, probability / 100 AS p, count(*) OVER (PARTITION BY question_id) AS n FROM v_forecasts)")
def so07_logit_calibration(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("probability") / 100
    n = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    return V.forecasts(spark, d).select("forecast_id", F.when(n >= 5, F.round(1 / (1 + F.exp(-(0.1 + 0.8 * F.log(p / (1 - p))))), 8)).otherwise(p).alias("calibrated"))


@query("SELECT series_id, date, round(sign * (value - m) / s, 6) AS aligned, round(sign * (value - lag(value, 3) OVER (PARTITION BY series_id ORDER BY date)) / s, 6) AS change3 FROM v_macro JOIN (SELECT a.series_id AS id, CASE WHEN corr(a.value, b.value) < 0 THEN -1 ELSE 1 END AS sign, avg(a.value) AS m, stddev_samp(a.value) AS s FROM v_macro a JOIN v_macro b ON a.date = b.date AND b.series_id = 'AF' WHERE a.date < DATE '1999-01-01' GROUP BY 1) ON id = series_id")
def so08_factor_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Sign by correlation with a reference, scale from a fixed slice of time."""
    m = V.macro(spark, d)
    ref = m.where("series_id = 'AF'").select("date", F.col("value").alias("ref"))
    fit = m.where("date < '1999-01-01'").join(ref, "date").groupBy("series_id").agg(F.when(F.corr("value", "ref") < 0, -1).otherwise(1).alias("sign"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    v = F.col("value")
    change = v - Series(["series_id"], "date").lag(v, 3)
    return m.withColumn("change", change).join(fit, "series_id").select("series_id", "date", r6(F.col("sign") * (v - F.col("m")) / F.col("s")).alias("aligned"), r6(F.col("sign") * F.col("change") / F.col("s")).alias("change3"))


@query("SELECT o_custkey, coalesce(min(o_orderpriority) FILTER (o_orderdate >= TIMESTAMP '2001-01-01'), 'stale') AS tag FROM orders GROUP BY 1")
def so09_fallback_tag(spark: SparkSession, d: str) -> DataFrame:
    fresh = F.min(F.when(F.col("o_orderdate") >= ntz("2001-01-01 00:00:00"), F.col("o_orderpriority")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(fresh, F.lit("stale")).alias("tag"))


@query("SELECT p.series, p.date, round(p.close / o.close - 1, 6) AS since FROM v_price p JOIN (SELECT series, date, close FROM v_price WHERE date = (SELECT min(date) FROM v_price q WHERE q.series = v_price.series AND q.date >= DATE '1999-01-01')) o ON p.series = o.series AND p.date >= o.date")
def so11_tracking(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    origin = p.where("date >= '1999-01-01'").groupBy("series").agg(F.min(F.struct("date", "close")).alias("o"))
    return p.join(origin, "series").where("date >= o.date").select("series", "date", r6(close() / F.col("o.close") - 1).alias("since"))


@query("SELECT k, round(quantile_cont(ratio, 0.5), 6) AS shape, count(*) AS n FROM (SELECT series, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS k, close / first_value(close) OVER (PARTITION BY series ORDER BY month) AS ratio FROM " + _MONTHS + ") GROUP BY k")
def so12_analog_shape(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series"], "month")
    x = _months(spark, d).select((s.number() - 1).cast("long").alias("k"), (close() / F.first("close").over(s.w)).alias("ratio"))
    return x.groupBy("k").agg(r6(F.expr("percentile(ratio, 0.5)")).alias("shape"), F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT series, month, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY month), 0) AS r FROM " + _MONTHS + "), a AS (SELECT series, list_prepend({'l': 0.0::double, 'p': 0.0::double, 'd': 0.0::double}, list({'l': r, 'p': 0.0::double, 'd': 0.0::double} ORDER BY month)) AS xs FROM r GROUP BY 1), b AS (SELECT series, xs, 0.0::double AS lo, 1.0::double AS hi, 1 AS i FROM a UNION ALL SELECT series, xs, CASE WHEN exp(list_reduce(xs, lambda s, x: {'l': s.l + ((lo + hi) / 2) * x.l, 'p': greatest(s.p, s.l + ((lo + hi) / 2) * x.l), 'd': least(s.d, s.l + ((lo + hi) / 2) * x.l - greatest(s.p, s.l + ((lo + hi) / 2) * x.l))}).d) - 1 > -0.3 THEN ((lo + hi) / 2) ELSE lo END, CASE WHEN exp(list_reduce(xs, lambda s, x: {'l': s.l + ((lo + hi) / 2) * x.l, 'p': greatest(s.p, s.l + ((lo + hi) / 2) * x.l), 'd': least(s.d, s.l + ((lo + hi) / 2) * x.l - greatest(s.p, s.l + ((lo + hi) / 2) * x.l))}).d) - 1 > -0.3 THEN hi ELSE ((lo + hi) / 2) END, i + 1 FROM b WHERE i <= 40) SELECT series, round((lo + hi) / 2, 6) AS strength, CASE WHEN exp(list_reduce(xs, lambda s, x: {'l': s.l + 1 * x.l, 'p': greatest(s.p, s.l + 1 * x.l), 'd': least(s.d, s.l + 1 * x.l - greatest(s.p, s.l + 1 * x.l))}).d) - 1 > -0.3 THEN 'outside' ELSE 'found' END AS status FROM b WHERE i = 41")
def so13_strength_by_bisection(spark: SparkSession, d: str) -> DataFrame:
    """How much the residuals of each series must be damped for a worst fall of 30 %, by 40 halvings at once for all."""
    s = Series(["series"], "month")
    x = _months(spark, d).withColumn("r", F.coalesce(s.log_change(close()), F.lit(0.0)))
    arrays = x.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("month", "r"))).alias("a"))
    depth = "aggregate(a, named_struct('l', 0D, 'p', 0D, 'd', 0D), (s, e) -> named_struct('l', s.l + {k} * e.r, 'p', greatest(s.p, s.l + {k} * e.r), 'd', least(s.d, s.l + {k} * e.r - greatest(s.p, s.l + {k} * e.r))), s -> exp(s.d) - 1)"
    mid = "((b.lo + b.hi) / 2)"
    found = F.expr(f"aggregate(sequence(1, 40), named_struct('lo', 0D, 'hi', 1D), (b, i) -> CASE WHEN {depth.format(k=mid)} > -0.3 THEN named_struct('lo', {mid}, 'hi', b.hi) ELSE named_struct('lo', b.lo, 'hi', {mid}) END, b -> (b.lo + b.hi) / 2)")
    return arrays.select("series", r6(found).alias("strength"), F.when(F.expr(depth.format(k="1D")) > -0.3, "outside").otherwise("found").alias("status"))


@query("SELECT fact_id, value FROM v_facts WHERE vintage_start <= TIMESTAMP '2024-01-20' AND (vintage_end IS NULL OR vintage_end > TIMESTAMP '2024-01-20')")
def so17_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(spark, d).where(pit.knowable(ntz("2024-01-20 00:00:00"))).select("fact_id", "value")


@query("SELECT source_id, count(*) AS n, sha256(sum(h)::varchar) AS hash FROM (SELECT source_id, ('0x' || substr(sha256('observation_date=1' || observation_date || chr(31) || 'series_id=1' || series_id || chr(31) || 'source_id=1' || source_id || chr(31) || 'value=1' || value), 1, 15))::hugeint AS h FROM v_facts WHERE vintage_start <= TIMESTAMP '2024-01-15') GROUP BY 1")
def so18_source_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash per source of all facts known at T, from the hashes of its rows: any order gives the same."""
    known = V.facts(spark, d).where(F.col("vintage_start") <= ntz("2024-01-15 00:00:00"))
    part = F.conv(F.substring(row_hash("source_id", "series_id", "observation_date", "value"), 1, 15), 16, 10).cast("decimal(38,0)")
    return known.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.sum(part).cast("string"), 256).alias("hash"))


@query("SELECT date, round(tanh(0.5 * a + 0.35 * b + 0.15 * c), 6) AS score FROM (SELECT date, max(z) FILTER (series_id = 'AF') AS a, max(z) FILTER (series_id = 'NO') AS b, max(z) FILTER (series_id = 'RF') AS c FROM (SELECT series_id, date, (value - avg(value) OVER (PARTITION BY series_id)) / stddev_samp(value) OVER (PARTITION BY series_id) AS z FROM v_macro) GROUP BY date)")
def so19_evidence_score(spark: SparkSession, d: str) -> DataFrame:
    m = V.macro(spark, d).where("series_id IN ('AF', 'NO', 'RF')")
    w = Window.partitionBy("series_id")
    z = m.select("date", "series_id", ((F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)).alias("z")).groupBy("date").agg(*(F.max(F.when(F.col("series_id") == i, F.col("z"))).alias(i) for i in ("AF", "NO", "RF")))
    full = V.macro(spark, d).select("date").distinct()
    return full.join(z, "date", "left").select("date", r6(F.tanh(0.5 * F.col("AF") + 0.35 * F.col("NO") + 0.15 * F.col("RF"))).alias("score"))


@query("SELECT p.path_id FROM (SELECT path_id, engine, min(level) AS lo, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) p JOIN (SELECT engine AS e, quantile_cont(lo, 0.1) a, quantile_cont(lo, 0.9) b, quantile_cont(fin, 0.1) c, quantile_cont(fin, 0.9) f FROM (SELECT path_id, engine, min(level) AS lo, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) GROUP BY 1) ON engine = e WHERE lo BETWEEN a AND b AND fin BETWEEN c AND f")
def so20_realism_filter(spark: SparkSession, d: str) -> DataFrame:
    per = V.paths(spark, d).groupBy("path_id", "engine").agg(F.min("level").alias("lo"), F.max_by("level", "step").alias("fin"))
    a, b = (quantiles(per, ["engine"], c, [0.1, 0.9]).select("engine", F.col("q").alias(n)) for c, n in (("lo", "a"), ("fin", "b")))
    q = a.join(b, "engine")
    return per.join(q, "engine").where(F.col("lo").between(F.col("a")[0], F.col("a")[1]) & F.col("fin").between(F.col("b")[0], F.col("b")[1])).select("path_id")


@query("SELECT path_id, coalesce(max(n) FILTER (under = 1), 0) AS longest FROM (SELECT path_id, under, g, count(*) AS n FROM (SELECT path_id, under, row_number() OVER (PARTITION BY path_id ORDER BY step) - row_number() OVER (PARTITION BY path_id, under ORDER BY step) AS g FROM (SELECT path_id, step, (level < greatest(100, max(level) OVER (PARTITION BY path_id ORDER BY step)))::int AS under FROM v_paths)) GROUP BY ALL) GROUP BY path_id")
def so21_longest_underwater(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["path_id"], "step")
    x = V.paths(spark, d).withColumn("under", (F.col("level") < F.greatest(F.lit(100.0), F.max("level").over(s.so_far))).cast("int")).select("path_id", "step", "under")
    return runs(x, ["path_id"], "step", "under").groupBy("path_id").agg(F.coalesce(F.max(F.when(F.col("under") == 1, F.col("length"))), F.lit(0)).alias("longest"))


@query("SELECT engine, n, round(med, 6) AS med, round(iqr, 6) AS iqr, CASE WHEN n >= 40 THEN round(abs(med - 100) / iqr, 6) END AS score FROM (SELECT engine, count(*) AS n, quantile_cont(fin, 0.5) AS med, quantile_cont(fin, 0.75) - quantile_cont(fin, 0.25) AS iqr FROM (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) GROUP BY 1)")
def so23_cluster_audit(spark: SparkSession, d: str) -> DataFrame:
    q = V.paths(spark, d).groupBy("path_id", "engine").agg(F.max_by("level", "step").alias("fin"))
    q = quantiles(q, ["engine"], "fin", [0.25, 0.5, 0.75])
    med, iqr = F.col("q")[1], F.col("q")[2] - F.col("q")[0]
    return q.select("engine", "n", r6(med).alias("med"), r6(iqr).alias("iqr"), F.when(F.col("n") >= 40, r6(F.abs(med - 100) / iqr)).alias("score"))


@query("SELECT series, date, round(s, 6) AS total FROM (SELECT series, date, s, quantile_cont(s, 0.2) OVER (PARTITION BY series) AS a, quantile_cont(s, 0.4) OVER (PARTITION BY series) AS b FROM (SELECT series, date, k, sum(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS s, count(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS n FROM (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS k, ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price)) WHERE n = 21) WHERE s BETWEEN a AND b")
def so24_conditional_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 21 returns whose sum lies in a slice of its series' distribution."""
    ahead = S.w.rowsBetween(0, 20)
    x = V.prices(spark, d).withColumn("r", S.log_change(close())).select("series", "date", F.sum("r").over(ahead).alias("s"), F.count("r").over(ahead).alias("n")).where("n = 21")
    q = x.groupBy("series").agg(F.expr("percentile(s, array(0.2, 0.4))").alias("q"))
    return x.join(q, "series").where(F.col("s").between(F.col("q")[0], F.col("q")[1])).select("series", "date", r6(F.col("s")).alias("total"))


@query("SELECT series, date, CASE WHEN s <= a THEN 'down' WHEN s >= b THEN 'up' ELSE 'flat' END AS phase FROM (SELECT series, date, s, quantile_cont(s, 0.3) OVER (PARTITION BY series) AS a, quantile_cont(s, 0.7) OVER (PARTITION BY series) AS b FROM (SELECT series, date, sum(r) OVER (PARTITION BY series ORDER BY date ROWS 9 PRECEDING) AS s FROM (SELECT series, date, ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price)))")
def so26_phase_labels(spark: SparkSession, d: str) -> DataFrame:
    x = V.prices(spark, d).withColumn("r", S.log_change(close())).select("series", "date", S.rolling(F.sum, F.col("r"), 10, full=False).alias("s"))
    q = x.groupBy("series").agg(F.expr("percentile(s, array(0.3, 0.7))").alias("q"))
    return x.join(q, "series").select("series", "date", F.when(F.col("s") <= F.col("q")[0], "down").when(F.col("s") >= F.col("q")[1], "up").otherwise("flat").alias("phase"))


@query("SELECT engine, round(quantile_cont(depth, 0.5), 6) AS depth, round(quantile_cont(low, 0.5), 6) AS trough, round(quantile_cont(coalesce(back - low, 63 - low), 0.5), 6) AS recovery FROM (SELECT d.path_id, d.engine, d.depth, d.low, (SELECT min(step) FROM v_paths r WHERE r.path_id = d.path_id AND r.step > d.low AND r.level >= d.top) AS back FROM (SELECT path_id, engine, dd AS depth, step AS low, top FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY dd, step) AS k FROM (SELECT path_id, engine, step, greatest(100, max(level) OVER w) AS top, level / greatest(100, max(level) OVER w) - 1 AS dd FROM v_paths WINDOW w AS (PARTITION BY path_id ORDER BY step))) WHERE k = 1) d) GROUP BY engine")
def so27_kernel_summary(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["path_id"], "step")
    x = V.paths(spark, d).withColumn("top", F.greatest(F.lit(100.0), F.max("level").over(s.so_far))).withColumn("dd", F.col("level") / F.col("top") - 1)
    worst = x.groupBy("path_id", "engine").agg(F.min(F.struct("dd", "step", "top")).alias("m"))
    back = x.join(worst.select("path_id", F.col("m.step").alias("at"), F.col("m.top").alias("peak")), "path_id").where("step > at AND level >= peak").groupBy("path_id").agg(F.min("step").alias("back"))
    per = worst.join(back, "path_id", "left").select("engine", F.col("m.dd").alias("depth"), F.col("m.step").alias("at"), F.coalesce(F.col("back") - F.col("m.step"), 63 - F.col("m.step")).alias("rest"))
    parts = [quantiles(per, ["engine"], c, [0.5]).select("engine", r6(F.col("q")[0]).alias(n)) for c, n in (("depth", "depth"), ("at", "trough"), ("rest", "recovery"))]
    return parts[0].join(parts[1], "engine").join(parts[2], "engine")


@query("SELECT engine, coalesce(round(avg(c) FILTER (step BETWEEN 20 AND 40), 6), 1e308) AS score FROM (SELECT engine, step, avg(abs(level - 100)) AS c FROM v_paths GROUP BY ALL) GROUP BY engine")
def so31_candidate_score(spark: SparkSession, d: str) -> DataFrame:
    c = V.paths(spark, d).groupBy("engine", "step").agg(F.avg(F.abs(F.col("level") - 100)).alias("c"))
    return c.groupBy("engine").agg(F.coalesce(r6(F.avg(F.when(F.col("step").between(20, 40), F.col("c")))), F.lit(1e308)).alias("score"))
