"""Windows over series, analog search, simulated paths and scores over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import pit, scoring
from tidemark.operators.ranks import quantiles, rolling
from tidemark.operators.series import Series, correction_episodes, ewma_variance, greedy_gap, rsi, runs
from tidemark.plans import views as V
from tidemark.plans.tables import table
from tidemark.plans.views import close, query

S = Series(["series"], "date")
W = "WINDOW w AS (PARTITION BY series ORDER BY date)"
r6 = lambda c: F.round(c, 6)


@query("SELECT source_id, series_id, observation_date, arg_max(value, revision_seq) AS value, max(revision_seq) AS revision_seq FROM v_facts GROUP BY ALL")
def wn01_latest_vintage(spark: SparkSession, d: str) -> DataFrame:
    f = V.facts(spark, d).select("source_id", "series_id", "observation_date", "revision_seq", "value")
    return pit.latest(f, ["source_id", "series_id", "observation_date"], "revision_seq").withColumn("revision_seq", F.col("revision_seq").cast("long"))


@query("SELECT fact_id, reason FROM (SELECT fact_id, CASE WHEN seq <> coalesce(lag(seq) OVER w + 1, 0) THEN 'seq' WHEN sup IS DISTINCT FROM lag(fact_id) OVER w THEN 'supersedes' END AS reason FROM (SELECT fact_id, source_id, series_id, observation_date, revision_seq AS seq, CASE WHEN value < 5 THEN NULL ELSE lag(fact_id) OVER (PARTITION BY source_id, series_id, observation_date ORDER BY revision_seq) END AS sup FROM v_facts) WINDOW w AS (PARTITION BY source_id, series_id, observation_date ORDER BY seq)) WHERE reason IS NOT NULL")
def wn02_chain_check(spark: SparkSession, d: str) -> DataFrame:
    k = ["source_id", "series_id", "observation_date"]
    w = Window.partitionBy(*k).orderBy("revision_seq")
    rows = V.facts(spark, d).withColumn("supersedes", F.when(F.col("value") >= 5, F.lag("fact_id").over(w)))
    return pit.chain_errors(rows, k, id="fact_id", seq="revision_seq", supersedes="supersedes").select("fact_id", "reason")


@query("SELECT fact_id, vintage_start, vintage_end FROM v_facts")
def wn03_close_intervals(spark: SparkSession, d: str) -> DataFrame:
    open_ended = V.facts(spark, d).withColumn("vintage_end", F.lit(None).cast("timestamp_ntz"))
    return pit.close_intervals(open_ended, ["source_id", "series_id", "observation_date"]).select("fact_id", "vintage_start", "vintage_end")


@query(f"SELECT series, date, round(close / lag(close) OVER w - 1, 6) AS ret, round(ln(close) - lag(ln(close)) OVER w, 6) AS log_ret, round(close - lag(close) OVER w, 4) AS diff FROM v_price {W}")
def wn04_returns(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).select("series", "date", r6(S.change(close())).alias("ret"), r6(S.log_change(close())).alias("log_ret"), F.round(close() - S.lag(close()), 4).alias("diff"))


_R = "(SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price)"


@query(f"SELECT series, date, CASE WHEN count(r) OVER f20 = 20 THEN round(stddev_samp(r) OVER f20 * sqrt(252), 6) END AS vol20, CASE WHEN count(r) OVER f60 = 60 THEN round(stddev_samp(r) OVER f60 * sqrt(252), 6) END AS vol60 FROM {_R} WINDOW f20 AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING), f60 AS (PARTITION BY series ORDER BY date ROWS 59 PRECEDING)")
def wn05_rolling_volatility(spark: SparkSession, d: str) -> DataFrame:
    r = V.prices(spark, d).withColumn("r", S.log_change(close()))
    vol = lambda n: r6(S.rolling(F.stddev_samp, F.col("r"), n) * F.sqrt(F.lit(252.0)))
    return r.select("series", "date", vol(20).alias("vol20"), vol(60).alias("vol60"))


@query("SELECT series, date, CASE WHEN count(close) OVER f = 200 THEN round(close / avg(close) OVER f - 1, 6) END AS distance FROM v_price WINDOW f AS (PARTITION BY series ORDER BY date ROWS 199 PRECEDING)")
def wn06_mean_distance(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).select("series", "date", r6(close() / S.rolling(F.avg, close(), 200) - 1).alias("distance"))


_ERA = "(VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1997-07-01', DATE '2001-12-31')) e(era, a, b)"
_ERAS = "SELECT * FROM VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('late', DATE '1997-07-01', DATE '2001-12-31') AS e(era, a, b)"


def _in_eras(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).join(F.broadcast(spark.sql(_ERAS)), F.col("date").between(F.col("a"), F.col("b")))  # two rows


@query(f"SELECT era, series, date, round(close / max(close) OVER (PARTITION BY era, series ORDER BY date) - 1, 6) AS drawdown FROM v_price JOIN {_ERA} ON date BETWEEN e.a AND e.b")
def wn07_drawdown_in_era(spark: SparkSession, d: str) -> DataFrame:
    return _in_eras(spark, d).select("era", "series", "date", r6(Series(["era", "series"], "date").drawdown(close())).alias("drawdown"))


@query("SELECT series, date, row_number() OVER w - min(CASE WHEN date >= DATE '1998-01-01' THEN k END) OVER (PARTITION BY series) AS cycle_day FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM v_price) WINDOW w AS (PARTITION BY series ORDER BY date)")
def wn08_offset_from_anchor(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).withColumn("k", S.number())
    anchor = F.min(F.when(F.col("date") >= "1998-01-01", F.col("k"))).over(Window.partitionBy("series"))
    return p.select("series", "date", (F.col("k") - anchor).cast("long").alias("cycle_day"))


@query(f"SELECT era, series, date, round(100 * close / first_value(close) OVER (PARTITION BY era, series ORDER BY date), 6) AS idx FROM v_price JOIN {_ERA} ON date BETWEEN e.a AND e.b")
def wn09_rebase(spark: SparkSession, d: str) -> DataFrame:
    return _in_eras(spark, d).select("era", "series", "date", r6(100 * close() / F.first("close").over(Window.partitionBy("era", "series").orderBy("date"))).alias("idx"))


@query("SELECT domain, forecast_id, round(avg(brier) OVER w, 8) AS rolling, count(*) OVER w AS n FROM v_res WINDOW w AS (PARTITION BY domain ORDER BY resolved_date, forecast_id ROWS 9 PRECEDING)")
def wn10_rolling_brier(spark: SparkSession, d: str) -> DataFrame:
    """Over the last ten forecasts of a domain; a domain may hold any share of the rows."""
    r = V.resolutions(spark, d).select("domain", "resolved_date", "forecast_id", "brier")
    got = rolling(r, ["domain"], ["resolved_date", "forecast_id"], 10, {"rolling": F.avg("brier"), "n": F.count(F.lit(1))})
    return got.select("domain", "forecast_id", F.round("rolling", 8).alias("rolling"), "n")


@query("SELECT series_id, date, CASE WHEN count(*) OVER f = 12 THEN round((value - avg(value) OVER f) / nullif(stddev_samp(value) OVER f, 0), 6) END AS z FROM v_macro WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS 11 PRECEDING)")
def wn11_rolling_z(spark: SparkSession, d: str) -> DataFrame:
    s, v = Series(["series_id"], "date"), F.col("value")
    z = (v - s.rolling(F.avg, v, 12)) / F.nullif(s.rolling(F.stddev_samp, v, 12), F.lit(0.0))
    return V.macro(spark, d).select("series_id", "date", r6(z).alias("z"))


@query("SELECT series_id, date, round((m - avg(m) OVER p) / nullif(stddev_samp(m) OVER p, 0), 6) AS z FROM (SELECT series_id, date, avg(value) OVER f AS m, count(*) OVER f AS n FROM v_macro WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS 11 PRECEDING)) WHERE n = 12 WINDOW p AS (PARTITION BY series_id)")
def wn12_z_of_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    s, p = Series(["series_id"], "date"), Window.partitionBy("series_id")
    m = V.macro(spark, d).select("series_id", "date", s.rolling(F.avg, F.col("value"), 12).alias("m")).where("m IS NOT NULL")
    return m.select("series_id", "date", r6((F.col("m") - F.avg("m").over(p)) / F.nullif(F.stddev_samp("m").over(p), F.lit(0.0))).alias("z"))


@query(f"SELECT series, date, CASE WHEN count(r) OVER f = 21 THEN round(sum(r) OVER f, 6) END AS r21 FROM {_R} WINDOW f AS (PARTITION BY series ORDER BY date ROWS 20 PRECEDING)")
def wn13_rolling_sum(spark: SparkSession, d: str) -> DataFrame:
    r = V.prices(spark, d).withColumn("r", S.log_change(close()))
    return r.select("series", "date", r6(S.rolling(F.sum, F.col("r"), 21)).alias("r21"))


@query("SELECT series_id, date, round(value / lag(value, 4) OVER w - 1, 6) AS pct, round((value - lag(value, 4) OVER w) * 100, 4) AS bp FROM v_macro WINDOW w AS (PARTITION BY series_id ORDER BY date)")
def wn14_change_over_k(spark: SparkSession, d: str) -> DataFrame:
    s, v = Series(["series_id"], "date"), F.col("value")
    return V.macro(spark, d).select("series_id", "date", r6(s.change(v, 4)).alias("pct"), F.round((v - s.lag(v, 4)) * 100, 4).alias("bp"))


@query("SELECT series, date, round(close - max(close) OVER (PARTITION BY series ORDER BY date ROWS 12 PRECEDING), 4) AS off_peak FROM v_price")
def wn15_off_rolling_peak(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).select("series", "date", F.round(close() - S.rolling(F.max, close(), 13, full=False), 4).alias("off_peak"))


@query("SELECT series_id, date, sum((value > p)::int) OVER f::bigint AS rises, sum((value < p)::int) OVER f::bigint AS falls FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS p FROM v_macro) WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS 3 PRECEDING)")
def wn16_rises_and_falls(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series_id"], "date")
    m = V.macro(spark, d).withColumn("p", s.lag(F.col("value")))
    count = lambda c: s.rolling(F.sum, c.cast("int"), 4, full=False)
    return m.select("series_id", "date", count(F.col("value") > F.col("p")).alias("rises"), count(F.col("value") < F.col("p")).alias("falls"))


@query("SELECT a.series_id, a.date, round(a.value / b.value - 1, 6) AS yoy FROM v_macro a JOIN v_macro b ON a.series_id = b.series_id AND b.date = a.date - INTERVAL 1 YEAR")
def wn17_year_on_year(spark: SparkSession, d: str) -> DataFrame:
    m = V.macro(spark, d)
    prior = m.select("series_id", F.add_months("date", 12).alias("date"), F.col("value").alias("was"))
    return m.join(prior, ["series_id", "date"]).select("series_id", "date", r6(F.col("value") / F.col("was") - 1).alias("yoy"))


@query("SELECT series, month, round(ln(close) - ln(p), 6) AS r FROM (SELECT series, month, close, lag(close) OVER w AS p, lag(month) OVER w AS pm FROM (SELECT series, date_trunc('month', date)::date AS month, arg_max(close, date) AS close FROM v_price GROUP BY ALL) WINDOW w AS (PARTITION BY series ORDER BY month)) WHERE pm = month - INTERVAL 1 MONTH")
def wn18_adjacent_months(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series"], "month")
    m = V.prices(spark, d).groupBy("series", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))
    return m.withColumn("r", r6(s.log_change(close()))).withColumn("pm", s.lag(F.col("month"))).where("pm = add_months(month, -1)").select("series", "month", "r")


@query(f"SELECT era, series, date, round(lead(close, 21) OVER w / close - 1, 6) AS f21 FROM v_price JOIN {_ERA} ON date BETWEEN e.a AND e.b WINDOW w AS (PARTITION BY era, series ORDER BY date)")
def wn19_forward_return(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("era", "series").orderBy("date")
    return _in_eras(spark, d).select("era", "series", "date", r6(F.lead("close", 21).over(w) / close() - 1).alias("f21"))


@query(f"SELECT series, date, CASE WHEN count(r) OVER f = 21 THEN round(avg(least(r, 0) * least(r, 0)) OVER f, 8) END AS semivariance FROM {_R} WINDOW f AS (PARTITION BY series ORDER BY date ROWS 20 PRECEDING)")
def wn20_downside_semivariance(spark: SparkSession, d: str) -> DataFrame:
    r = V.prices(spark, d).withColumn("r", S.log_change(close())).withColumn("q", F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), F.lit(2))))
    return r.select("series", "date", F.round(S.rolling(F.avg, F.col("q"), 21), 8).alias("semivariance"))


@query("""SELECT series, t AS date, round(v, 4) AS rsi FROM (SELECT series, unnest(ts) AS t, unnest(list_reduce(list_transform(xs, lambda x: [{'i': x, 'g': 0.0, 'l': 0.0, 'n': -1.0, 'v': NULL::double}]),
    lambda a, b: a || [{'i': b[1].i, 'n': a[len(a)].n + 1,
        'g': CASE WHEN a[len(a)].n + 1 < 14 THEN a[len(a)].g + greatest(b[1].i - a[len(a)].i, 0) / 14 ELSE (a[len(a)].g * 13 + greatest(b[1].i - a[len(a)].i, 0)) / 14 END,
        'l': CASE WHEN a[len(a)].n + 1 < 14 THEN a[len(a)].l + greatest(a[len(a)].i - b[1].i, 0) / 14 ELSE (a[len(a)].l * 13 + greatest(a[len(a)].i - b[1].i, 0)) / 14 END,
        'v': CASE WHEN a[len(a)].n + 1 >= 14 THEN CASE WHEN a[len(a)].l * 13 + greatest(a[len(a)].i - b[1].i, 0) = 0 THEN 100 ELSE 100 - 100 / (1 + (a[len(a)].g * 13 + greatest(b[1].i - a[len(a)].i, 0)) / (a[len(a)].l * 13 + greatest(a[len(a)].i - b[1].i, 0))) END END}])).v AS v
    FROM (SELECT series, list(date ORDER BY date) AS ts, list(close ORDER BY date) AS xs FROM v_price GROUP BY series))""")
def wn21_rsi(spark: SparkSession, d: str) -> DataFrame:
    return rsi(V.prices(spark, d), ["series"], "date", "close").select("series", "date", F.round("rsi", 4).alias("rsi"))


@query(f"""SELECT a.series, a.date, round(sum(CASE WHEN b.k = 1 THEN power(0.94, a.k - b.k) ELSE 0.06 * power(0.94, a.k - b.k) END * b.r * b.r), 8) AS variance FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM {_R} WHERE r IS NOT NULL) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM {_R} WHERE r IS NOT NULL) b ON a.series = b.series AND b.k <= a.k GROUP BY a.series, a.date""")
def wn22_ewma_variance(spark: SparkSession, d: str) -> DataFrame:
    r = V.prices(spark, d).withColumn("r", S.log_change(close())).where("r IS NOT NULL")
    return ewma_variance(r, ["series"], "date", "r").select("series", "date", F.round("variance", 8).alias("variance"))


@query("SELECT p.date, last_value(m.value IGNORE NULLS) OVER (ORDER BY p.date) AS value FROM (SELECT DISTINCT date FROM v_price) p LEFT JOIN v_macro m ON p.date = m.date AND m.series_id = 'AF'")
def wn23_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    days = V.prices(spark, d).select("date").distinct().join(V.macro(spark, d).where("series_id = 'AF'").select("date", "value"), "date", "left").withColumn("one", F.lit("AF"))
    return days.select("date", Series(["one"], "date").known(F.col("value")).alias("value"))


@query("SELECT series, date, (close > q1)::int + (close > q2)::int + (close > q3)::int + 1 AS quartile FROM v_price JOIN (SELECT series AS s, quantile_cont(close, 0.25) q1, quantile_cont(close, 0.5) q2, quantile_cont(close, 0.75) q3 FROM v_price GROUP BY 1) ON series = s")
def wn24_quartile_labels(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    q = p.groupBy("series").agg(F.expr("percentile(close, array(0.25, 0.5, 0.75))").alias("q"))
    above = sum(((close() > F.col("q")[i]).cast("int") for i in range(3)), F.lit(1))
    return p.join(q, "series").select("series", "date", above.alias("quartile"))


@query("SELECT series, date, k FROM (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY close DESC, date) AS k FROM v_price) WHERE k <= 3")
def wn25_cap_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy(F.col("close").desc(), "date")
    return V.prices(spark, d).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 3").select("series", "date", "k")


@query("SELECT series, date, coalesce(last_value(CASE WHEN close > 450000 THEN 1 WHEN close < 50000 THEN 0 END IGNORE NULLS) OVER (PARTITION BY series ORDER BY date), 0) AS state FROM v_price")
def wn26_latched_signal(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.ledger import running_latch

    return V.prices(spark, d).select("series", "date", running_latch(None, ["series"], "date", close() > 450000, close() < 50000).cast("int").alias("state"))


# ---- alignment and analogs -------------------------------------------------------------------

_MONTHS = "(SELECT series, date_trunc('month', date)::date AS month, arg_max(close, date) AS close FROM v_price GROUP BY ALL)"


def _month_ends(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("series", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))


@query(f"""SELECT series, peak, trough, round(depth, 6) AS depth, recovered FROM (SELECT series, min(month) AS peak, arg_min(month, (close, month)) AS trough, min(close) / arg_min(close, month) - 1 AS depth, lead(min(month)) OVER (PARTITION BY series ORDER BY block) AS recovered
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY month) AS block FROM (SELECT *, (coalesce(max(close) OVER (PARTITION BY series ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < close, true))::int AS fresh FROM {_MONTHS})) GROUP BY series, block) WHERE depth <= -0.05""")
def al02_correction_episodes(spark: SparkSession, d: str) -> DataFrame:
    return correction_episodes(_month_ends(spark, d), ["series"], "month", "close").select("series", "peak", "trough", r6(F.col("depth")).alias("depth"), "recovered")


@query(f"SELECT round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY month) AS k, 100 * close / first_value(close) OVER (ORDER BY month) AS x FROM {_MONTHS} WHERE series = '1-URGENT' AND month >= DATE '1995-01-01') a JOIN (SELECT row_number() OVER (ORDER BY month) AS k, 100 * close / first_value(close) OVER (ORDER BY month) AS x FROM {_MONTHS} WHERE series = '2-HIGH' AND month >= DATE '1996-01-01') b ON a.k = b.k WHERE a.k <= 43")
def al03_overlay(spark: SparkSession, d: str) -> DataFrame:
    m = _month_ends(spark, d).where("(series = '1-URGENT' AND month >= '1995-01-01') OR (series = '2-HIGH' AND month >= '1996-01-01')")
    w = Window.partitionBy("series").orderBy("month")
    x = m.select("series", F.row_number().over(w).alias("k"), (100 * close() / F.first("close").over(w)).alias("x")).where("k <= 43")
    pair = x.groupBy("k").agg(F.max(F.when(F.col("series") == "1-URGENT", F.col("x"))).alias("a"), F.max(F.when(F.col("series") == "2-HIGH", F.col("x"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return pair.agg(r6(F.corr("a", "b")).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH f AS (SELECT series, month, close / lag(close, 1) OVER w - 1 AS f0, close / lag(close, 3) OVER w - 1 AS f1, close / lag(close, 12) OVER w - 1 AS f2, close / max(close) OVER w - 1 AS f3, CASE WHEN count(close) OVER (PARTITION BY series ORDER BY month ROWS 5 PRECEDING) = 6 THEN stddev_samp(close) OVER (PARTITION BY series ORDER BY month ROWS 5 PRECEDING) END AS f4, lead(close, 3) OVER w / close - 1 AS f3m FROM {_MONTHS} WINDOW w AS (PARTITION BY series ORDER BY month)),
    x AS (SELECT *, max(month) OVER (PARTITION BY series) AS origin FROM f WHERE f0 + f1 + f2 + f3 + f4 IS NOT NULL), s AS (SELECT series, {', '.join(f"coalesce(nullif(stddev_samp(f{i}), 0), 1) AS s{i}" for i in range(5))} FROM x WHERE month < origin GROUP BY 1), h AS (SELECT series, {', '.join(f"f{i} AS q{i}" for i in range(5))} FROM x WHERE month = origin),
    near AS (SELECT x.series, month, round(sqrt({' + '.join(f"((f{i} - q{i}) / s{i}) ** 2" for i in range(5))}), 6) AS distance FROM x JOIN s ON s.series = x.series JOIN h ON h.series = x.series WHERE month < origin), c AS (SELECT series, list((distance, month) ORDER BY distance, month) AS xs FROM near GROUP BY 1),
    g AS (SELECT series, xs, 1 AS pos, []::STRUCT(distance DOUBLE, month DATE)[] AS got FROM c UNION ALL SELECT series, xs, pos + 1, CASE WHEN len(got) < 5 AND len(list_filter(got, lambda y: abs(y.month - xs[pos][2]) < 90)) = 0 THEN list_append(got, {{'distance': xs[pos][1], 'month': xs[pos][2]}}) ELSE got END FROM g WHERE pos <= len(xs)),
    p AS (SELECT series, unnest(range(1, len(got) + 1))::int AS rank, unnest(list_transform(got, lambda y: y.month)) AS month, unnest(list_transform(got, lambda y: y.distance)) AS distance FROM g WHERE pos = len(xs) + 1) SELECT p.series, rank, p.month, distance, round(f3m, 6) AS f3m FROM p JOIN f ON f.series = p.series AND f.month = p.month""")
def al04_analogs(spark: SparkSession, d: str) -> DataFrame:
    """Months most like each series' last one by five standardised features, at least 90 days apart, with what followed."""
    s = Series(["series"], "month")
    f = _month_ends(spark, d).select(
        "series", "month", "close", s.change(close(), 1).alias("f0"), s.change(close(), 3).alias("f1"), s.change(close(), 12).alias("f2"), s.drawdown(close()).alias("f3"), s.rolling(F.stddev_samp, close(), 6).alias("f4"),
        (F.lead("close", 3).over(s.w) / close() - 1).alias("f3m"),
    ).dropna(subset=["f0", "f1", "f2", "f3", "f4"])
    last = f.groupBy("series").agg(F.max("month").alias("origin"))
    pool = f.join(last, "series").where("month < origin")
    fit = pool.groupBy("series").agg(*(x for i in range(5) for x in (F.avg(f"f{i}").alias(f"m{i}"), F.coalesce(F.nullif(F.stddev_samp(f"f{i}"), F.lit(0.0)), F.lit(1.0)).alias(f"s{i}"))))
    here = f.join(last, "series").where("month = origin").select("series", *(F.col(f"f{i}").alias(f"q{i}") for i in range(5)))
    near = pool.join(fit, "series").join(here, "series").withColumn("distance", F.round(F.sqrt(sum((F.pow((F.col(f"f{i}") - F.col(f"q{i}")) / F.col(f"s{i}"), F.lit(2)) for i in range(5)), F.lit(0.0))), 6))
    picks = greedy_gap(near, ["series"], "month", "distance", 5, 90)
    return picks.join(f.select("series", "month", "f3m"), ["series", "month"]).select("series", "rank", "month", "distance", r6(F.col("f3m")).alias("f3m"))


@query(f"SELECT w, series, round(last / first - 1, 6) AS total, round(mdd, 6) AS mdd, n FROM (SELECT era AS w, series, arg_max(close, date) AS last, arg_min(close, date) AS first, min(dd) AS mdd, count(*) AS n FROM (SELECT era, series, date, close, close / max(close) OVER (PARTITION BY era, series ORDER BY date) - 1 AS dd FROM v_price JOIN {_ERA} ON date BETWEEN e.a AND e.b) GROUP BY ALL)")
def al08_window_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = _in_eras(spark, d).withColumn("dd", Series(["era", "series"], "date").drawdown(close()))
    return x.groupBy(F.col("era").alias("w"), "series").agg(r6(F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total"), r6(F.min("dd")).alias("mdd"), F.count(F.lit(1)).alias("n"))


@query("""SELECT round(max(abs(fa - fb)), 6) AS ks FROM (SELECT x, sum(a) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING) / sum(b) OVER () AS fb
    FROM (SELECT value AS x, (series_id = 'AF')::int AS a, (series_id = 'NO')::int AS b FROM v_macro WHERE series_id IN ('AF', 'NO')))""")
def al11_ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    per = V.macro(spark, d).where("series_id IN ('AF', 'NO')").groupBy("value").agg(F.sum((F.col("series_id") == "AF").cast("int")).alias("a"), F.sum((F.col("series_id") == "NO").cast("int")).alias("b")).withColumn("one", F.lit(1))
    w, every = Series(["one"], "value").so_far, Window.partitionBy("one")
    return per.select(F.abs(F.sum("a").over(w) / F.sum("a").over(every) - F.sum("b").over(w) / F.sum("b").over(every)).alias("gap")).agg(r6(F.max("gap")).alias("ks"))


@query("""SELECT lag, n, CASE WHEN n >= 24 THEN r END AS r FROM (SELECT k AS lag, count(*) AS n, round(corr(a.r, b.r), 3) AS r FROM (SELECT unnest([0, 1, 2, 3]) AS k) JOIN (SELECT row_number() OVER (ORDER BY date) AS i, ln(value) - lag(ln(value)) OVER (ORDER BY date) AS r FROM v_macro WHERE series_id = 'AF') a ON true
    JOIN (SELECT row_number() OVER (ORDER BY date) AS i, ln(value) - lag(ln(value)) OVER (ORDER BY date) AS r FROM v_macro WHERE series_id = 'RF') b ON b.i = a.i + k WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY k)""")
def al15_lead_lag(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series_id"], "date")
    m = V.macro(spark, d).where("series_id IN ('AF', 'RF')").select("series_id", s.number().alias("i"), s.log_change(F.col("value")).alias("r")).where("r IS NOT NULL")
    a = m.where("series_id = 'AF'").select("i", F.col("r").alias("x"), F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("lag"))
    b = m.where("series_id = 'RF'").select(F.col("i").alias("j"), F.col("r").alias("y"))
    return a.join(b, F.col("j") == F.col("i") + F.col("lag")).groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.when(F.count(F.lit(1)) >= 24, F.corr("x", "y")), 3).alias("r"))


@query("SELECT series, up, min(date) AS begin, max(date) AS end, count(*) AS length FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - row_number() OVER (PARTITION BY series, up ORDER BY date) AS g FROM (SELECT series, date, coalesce(close > lag(close) OVER (PARTITION BY series ORDER BY date), false)::int AS up FROM v_price)) GROUP BY series, up, g HAVING count(*) >= 5")
def al20_phase_runs(spark: SparkSession, d: str) -> DataFrame:
    up = V.prices(spark, d).select("series", "date", F.coalesce((close() > S.lag(close())).cast("int"), F.lit(0)).alias("up"))
    return runs(up, ["series"], "date", "up").where("length >= 5")


# ---- simulated paths ------------------------------------------------------------------------


@query("SELECT engine, step, round(quantile_cont(level, 0.05), 6) AS q05, round(quantile_cont(level, 0.5), 6) AS q50, round(quantile_cont(level, 0.95), 6) AS q95 FROM v_paths GROUP BY ALL")
def fm09_quantile_bands(spark: SparkSession, d: str) -> DataFrame:
    q = quantiles(V.paths(spark, d), ["engine", "step"], "level", [0.05, 0.5, 0.95])
    return q.select("engine", "step", *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q05", "q50", "q95"))))


@query("SELECT engine, count(*) AS n, sum((low < 90)::int)::bigint AS touched, round(avg((low < 90)::int), 6) AS p_touch, round(avg((fin > 100)::int), 6) AS p_up, round(quantile_cont(mdd, 0.5), 6) AS mdd50 FROM (SELECT path_id, engine, min(level) AS low, arg_max(level, step) AS fin, min(dd) AS mdd FROM (SELECT *, level / greatest(100, max(level) OVER (PARTITION BY path_id ORDER BY step)) - 1 AS dd FROM v_paths) GROUP BY ALL) GROUP BY engine")
def fm08_barrier_touch(spark: SparkSession, d: str) -> DataFrame:
    p = V.paths(spark, d)
    peak = F.max("level").over(Window.partitionBy("path_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    per = p.withColumn("dd", F.col("level") / F.greatest(F.lit(100.0), peak) - 1).groupBy("path_id", "engine").agg(F.min("level").alias("low"), F.max_by("level", "step").alias("fin"), F.min("dd").alias("mdd"))
    hit, up = (F.col("low") < 90).cast("int"), (F.col("fin") > 100).cast("int")
    shares = per.groupBy("engine").agg(F.sum(hit).alias("touched"), r6(F.avg(hit)).alias("p_touch"), r6(F.avg(up)).alias("p_up"))
    return shares.join(quantiles(per, ["engine"], "mdd", [0.5]), "engine").select("engine", "n", "touched", "p_touch", "p_up", r6(F.col("q")[0]).alias("mdd50"))


@query("SELECT path_id, round(w, 10) AS w FROM (SELECT path_id, exp(l - max(l) OVER ()) / sum(exp(l - m)) OVER () AS w FROM (SELECT path_id, l, max(l) OVER () AS m FROM (SELECT path_id, -10 * avg(r * r) AS l FROM v_path0 GROUP BY 1)))")
def fm19_log_weights(spark: SparkSession, d: str) -> DataFrame:
    """Normalised weights; the total and the greatest weight come from one aggregated row."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("path_id"), F.transform("embedding", lambda x: x.cast("double") / 10).alias("r"))
    l = e.select("path_id", (-10 * F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x) / F.size("r")).alias("l"))  # noqa: E741
    top = l.agg(F.max("l").alias("m"))
    total = l.crossJoin(F.broadcast(top)).agg(F.max("m").alias("m"), F.sum(F.exp(F.col("l") - F.col("m"))).alias("t"))
    return l.crossJoin(F.broadcast(total)).select("path_id", F.round(F.exp(F.col("l") - F.col("m")) / F.col("t"), 10).alias("w"))


@query("""SELECT engine, round(coalesce(max(CASE WHEN c <= 0.5 AND c1 > 0.5 THEN x + (0.5 - c) / (c1 - c) * (x1 - x) END), CASE WHEN min(c) > 0.5 THEN min(x) ELSE max(x) END), 5) AS q50 FROM (SELECT *, lead(c) OVER w AS c1, lead(x) OVER w AS x1 FROM
    (SELECT engine, x, (sum(w) OVER (PARTITION BY engine ORDER BY x) - w / 2) / sum(w) OVER (PARTITION BY engine) AS c FROM (SELECT engine, x, sum(w) AS w FROM (SELECT path_id, engine, arg_max(level, step) AS x, exp(-10 * avg(r * r)) AS w FROM v_paths GROUP BY ALL) GROUP BY ALL)) WINDOW w AS (PARTITION BY engine ORDER BY x)) GROUP BY engine""")
def fm20_weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    ends = V.paths(spark, d).groupBy("path_id", "engine").agg(F.max_by("level", "step").alias("x"), F.exp(-10 * F.avg(F.col("r") * F.col("r"))).alias("w"))
    return scoring.weighted_quantiles(ends, ["engine"], "x", "w", [0.5]).select("engine", F.round("q50", 5).alias("q50"))


@query("SELECT engine, step, n, round(sum(n) OVER (PARTITION BY engine ORDER BY step) / total, 6) AS cdf FROM (SELECT engine, step, count(*) AS n FROM (SELECT path_id, engine, min(step) AS step FROM v_paths WHERE level < 95 GROUP BY ALL) GROUP BY ALL) JOIN (SELECT label AS e, count(*) AS total FROM embeddings GROUP BY 1) ON engine = e")
def fm21_first_touch(spark: SparkSession, d: str) -> DataFrame:
    p = V.paths(spark, d)
    total = p.where("step = 0").groupBy("engine").agg(F.count(F.lit(1)).alias("total"))
    first = p.where("level < 95").groupBy("path_id", "engine").agg(F.min("step").alias("step")).groupBy("engine", "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("engine").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return first.join(total, "engine").select("engine", "step", "n", r6(F.sum("n").over(w) / F.col("total")).alias("cdf"))


@query("SELECT scenario, count(*) AS n FROM (SELECT CASE WHEN max(level) >= 110 THEN 'S1' WHEN arg_max(level, step) < 95 THEN 'S2' ELSE 'S3' END AS scenario FROM v_paths GROUP BY path_id) GROUP BY scenario")
def fm23_path_partition(spark: SparkSession, d: str) -> DataFrame:
    per = V.paths(spark, d).groupBy("path_id").agg(F.max("level").alias("high"), F.max_by("level", "step").alias("fin"))
    return per.groupBy(F.when(F.col("high") >= 110, "S1").when(F.col("fin") < 95, "S2").otherwise("S3").alias("scenario")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT step, round(quantile_cont(m, 0.5), 6) AS median, round(max(m) - min(m), 6) AS disagreement FROM (SELECT engine, step, avg(level) AS m FROM v_paths GROUP BY ALL) GROUP BY step")
def fm25_median_combine(spark: SparkSession, d: str) -> DataFrame:
    m = V.paths(spark, d).groupBy("engine", "step").agg(F.avg("level").alias("m"))
    return m.groupBy("step").agg(r6(F.expr("percentile(m, 0.5)")).alias("median"), r6(F.max("m") - F.min("m")).alias("disagreement"))


@query("SELECT series_id, n, round(med, 6) AS med, round(iqr, 6) AS iqr, round(quantile_cont(abs(value - med), 0.5), 6) AS mad FROM v_macro JOIN (SELECT series_id AS s, count(*) AS n, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM v_macro GROUP BY 1) ON series_id = s GROUP BY ALL")
def fm01_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    m = V.macro(spark, d)
    q = m.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(value, array(0.25, 0.5, 0.75))").alias("q"))
    return m.join(q, "series_id").groupBy("series_id", "n", F.col("q")[1].alias("m"), (F.col("q")[2] - F.col("q")[0]).alias("i")).agg(r6(F.expr("percentile(abs(value - q[1]), 0.5)")).alias("mad")).select("series_id", "n", r6(F.col("m")).alias("med"), r6(F.col("i")).alias("iqr"), "mad")


@query("SELECT * FROM (SELECT series_id, date, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 5) OVER w AS l5 FROM v_macro WINDOW w AS (PARTITION BY series_id ORDER BY date)) WHERE l5 IS NOT NULL")
def fm02_lag_design(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series_id"], "date")
    return V.macro(spark, d).select("series_id", "date", "value", *(s.lag(F.col("value"), k).alias(f"l{k}") for k in (1, 2, 5))).where("l5 IS NOT NULL")


# ---- scores ---------------------------------------------------------------------------------


@query("SELECT domain, round(avg((p - outcome) * (p - outcome)), 6) AS brier, round(-avg(outcome * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - outcome) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12))), 6) AS log_score FROM (SELECT *, probability / 100 AS p FROM v_res) GROUP BY domain")
def ev01_brier_log(spark: SparkSession, d: str) -> DataFrame:
    p, y = F.col("probability") / 100, F.col("outcome")
    return V.resolutions(spark, d).groupBy("domain").agg(r6(scoring.brier(p, y)).alias("brier"), r6(scoring.log_score(p, y)).alias("log_score"))


@query("SELECT series, round(avg(greatest(0.1 * (close - q), -0.9 * (close - q))), 4) AS loss FROM v_price JOIN (SELECT series AS s, quantile_cont(close, 0.1) AS q FROM v_price GROUP BY 1) ON series = s GROUP BY series")
def ev02_pinball(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    q = p.groupBy("series").agg(F.expr("percentile(close, 0.1)").alias("q"))
    return p.join(q, "series").groupBy("series").agg(F.round(F.avg(scoring.pinball(F.lit(0.1), F.col("q"), close())), 4).alias("loss"))


@query("SELECT engine, step, round(avg(abs(level - 100)) - sum((2 * k - n - 1) * level) / max(n * n), 6) AS crps FROM (SELECT engine, step, level, row_number() OVER (PARTITION BY engine, step ORDER BY level) AS k, count(*) OVER (PARTITION BY engine, step) AS n FROM v_paths) GROUP BY engine, step")
def ev03_crps(spark: SparkSession, d: str) -> DataFrame:
    s = V.paths(spark, d).withColumn("actual", F.lit(100.0))
    return scoring.crps(s, ["engine", "step"], "level", "actual").select("engine", "step", r6(F.col("crps")).alias("crps"))


@query("""SELECT engine, n, hits, round(hits / n, 6) AS coverage, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS lo, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS hi
    FROM (SELECT engine, count(*) AS n, sum((fin BETWEEN 90 AND 110)::int)::bigint AS hits, avg((fin BETWEEN 90 AND 110)::int) AS p, 1.6448536269514722::double AS z FROM (SELECT engine, arg_max(level, step) AS fin FROM v_paths GROUP BY path_id, engine) GROUP BY engine)""")
def ev05_coverage(spark: SparkSession, d: str) -> DataFrame:
    per = V.paths(spark, d).groupBy("path_id", "engine").agg(F.max_by("level", "step").alias("fin")).groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fin").between(90, 110).cast("int")).alias("hits"))
    lo, hi = scoring.wilson(F.col("hits"), F.col("n"))
    return per.select("engine", "n", "hits", r6(F.col("hits") / F.col("n")).alias("coverage"), r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("SELECT split, a AS train_end, a + 3 AS test_from, a + 8 AS test_to FROM (SELECT i AS split, 10 + i * 7 AS a FROM (SELECT unnest(range(0, 12))::bigint AS i)) WHERE a + 8 <= 90")
def ev06_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Expanding splits of 90 rows: 10 to train at least, purge 3, 5 to test, embargo 2."""
    n, least, test, purge, embargo = 90, 10, 5, 3, 2
    return spark.range(0, (n - least) // (test + embargo) + 1).select(F.col("id").alias("split"), (F.col("id") * (test + embargo) + least).alias("a")).where(F.col("a") + purge + test <= n).select("split", F.col("a").alias("train_end"), (F.col("a") + purge).alias("test_from"), (F.col("a") + purge + test).alias("test_to"))


@query("""SELECT series, n, round(m, 6) AS mean, round(m / sqrt((s0 + 2 * (2.0 / 3) * s1 + 2 * (1.0 / 3) * s2) / n), 4) AS dm FROM (SELECT series, count(*) AS n, max(m) AS m, sum(d * d) / count(*) AS s0, sum(d * l1) / count(*) AS s1, sum(d * l2) / count(*) AS s2 FROM
    (SELECT series, m, d, lag(d) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM (SELECT series, date, r, avg(r) OVER (PARTITION BY series) AS m, r - avg(r) OVER (PARTITION BY series) AS d FROM """ + _R + """ WHERE r IS NOT NULL) WINDOW w AS (PARTITION BY series ORDER BY date)) GROUP BY series) WHERE s0 + 2 * (2.0 / 3) * s1 + 2 * (1.0 / 3) * s2 > 0""")
def ev09_diebold_mariano(spark: SparkSession, d: str) -> DataFrame:
    r = V.prices(spark, d).withColumn("r", S.log_change(close())).where("r IS NOT NULL")
    return scoring.diebold_mariano(r, ["series"], "date", "r", 2).where("dm IS NOT NULL").select("series", "n", r6(F.col("mean")).alias("mean"), F.round("dm", 4).alias("dm"))


@query("SELECT label_type, label, count(*) AS n, round(avg(brier), 6) AS brier FROM (SELECT brier, unnest(['domain', 'year', 'side']) AS label_type, unnest([domain, year(resolved_date)::varchar, CASE WHEN probability >= 50 THEN 'yes' ELSE 'no' END]) AS label FROM v_res) GROUP BY ALL")
def ev11_conditional_tables(spark: SparkSession, d: str) -> DataFrame:
    labels = {"domain": F.col("domain"), "year": F.year("resolved_date").cast("string"), "side": F.when(F.col("probability") >= 50, "yes").otherwise("no")}
    long = V.resolutions(spark, d).select("brier", F.explode(F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), v)))).alias("label_type", "label"))
    return long.groupBy("label_type", "label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("brier")).alias("brier"))


@query("SELECT least(floor(u * 10)::int, 9)::bigint AS bin, count(*) AS n FROM (SELECT avg((p.level <= a.v)::int) AS u FROM v_paths p JOIN (SELECT row_number() OVER (ORDER BY date) - 1 AS step, round(100 * value / first_value(value) OVER (ORDER BY date), 6) AS v FROM v_macro WHERE series_id = 'AF') a ON p.step = a.step GROUP BY p.engine, p.step) GROUP BY 1")
def ev12_pit_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Where each actual value lies among the paths of its engine and step; the last bin is closed on the right."""
    s = Series(["series_id"], "date")
    a = V.macro(spark, d).where("series_id = 'AF'").select((s.number() - 1).alias("step"), r6(100 * F.col("value") / F.first("value").over(s.w)).alias("v"))
    u = V.paths(spark, d).join(a, "step").groupBy("engine", "step").agg(F.avg((F.col("level") <= F.col("v")).cast("int")).alias("u"))
    return u.groupBy(F.least(F.floor(F.col("u") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT domain, CASE WHEN count(*) >= 30 THEN round(least(2.5, greatest(0.5, quantile_cont(abs(probability / 100 - outcome), 0.8) / 0.5)), 6) END AS scale FROM v_res GROUP BY domain")
def ev14_conformal_scale(spark: SparkSession, d: str) -> DataFrame:
    q = quantiles(V.resolutions(spark, d), ["domain"], F.abs(F.col("probability") / 100 - F.col("outcome")), [0.8])
    return q.select("domain", F.when(F.col("n") >= 30, r6(F.least(F.lit(2.5), F.greatest(F.lit(0.5), F.col("q")[0] / 0.5)))).alias("scale"))


@query("SELECT series_id, date, max(value) OVER (PARTITION BY series_id ORDER BY date) AS value FROM v_macro")
def ev15_monotone_repair(spark: SparkSession, d: str) -> DataFrame:
    return scoring.monotone(V.macro(spark, d), ["series_id"], "date", "value")


@query("SELECT question_id, count(DISTINCT probability) AS sources, (count(DISTINCT probability) = 1 AND count(*) >= 2)::int AS agreed FROM v_res GROUP BY question_id")
def ev18_sources_agree(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("probability")
    return V.resolutions(spark, d).groupBy("question_id").agg(n.alias("sources"), ((n == 1) & (F.count(F.lit(1)) >= 2)).cast("int").alias("agreed"))
