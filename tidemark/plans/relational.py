"""Projections, filters, joins, aggregations, top-k and set operations over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.operators.asof import asof_join
from tidemark.operators.ledger import first_of
from tidemark.plans import views as V
from tidemark.plans.tables import table
from tidemark.plans.views import query

T0 = "2024-01-15 00:00:00"


def _t0() -> F.Column:
    return F.lit(T0).cast("timestamp_ntz")


# ---- scans, projections, filters ------------------------------------------------------------


@query("SELECT n_name, r_name, n_nationkey * 10 + r_regionkey AS code, coalesce(nullif(n_name, 'FRANCE'), '-') AS shown FROM nation JOIN region ON n_regionkey = r_regionkey")
def pf01_projection(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", (F.col("n_nationkey") * 10 + F.col("r_regionkey")).alias("code"), F.coalesce(F.nullif(F.col("n_name"), F.lit("FRANCE")), F.lit("-")).alias("shown"))


@query("SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem WHERE l_quantity >= 49")
def pf02_exclude_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity >= 49").drop("l_tax", "l_discount")


@query("SELECT o_orderkey, o_orderdate::date AS day FROM orders WHERE o_orderdate::date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND o_orderstatus IN ('O', 'P') AND o_totalprice IS NOT NULL")
def pf03_between_in_null(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    in_half = at.between(F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1997-06-30 23:59:59.999999").cast("timestamp_ntz"))
    return table(spark, d, "orders").where(in_half & F.col("o_orderstatus").isin("O", "P") & F.col("o_totalprice").isNotNull()).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'STANDARD%' OR p_brand LIKE 'Brand#1%'")
def pf04_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_type").startswith("STANDARD") | F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_name")


@query("SELECT f.forecast_id, f.question_id, f.probability FROM v_forecasts f LEFT JOIN v_overrides o ON f.forecast_id = o.forecast_id WHERE coalesce(o.status, f.research_status, 'ok') <> 'failed'")
def pf05_effective_status(spark: SparkSession, d: str) -> DataFrame:
    f, o = V.forecasts(spark, d), V.overrides(spark, d)
    return f.join(o, "forecast_id", "left").where(F.coalesce("status", "research_status", F.lit("ok")) != "failed").select("forecast_id", "question_id", "probability")


@query("SELECT domain, count(*) AS n, (count(*) >= 30 AND avg(brier) < 0.34)::int AS passes FROM v_res GROUP BY domain")
def pf06_gate_flag(spark: SparkSession, d: str) -> DataFrame:
    return V.resolutions(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) >= 30) & (F.avg("brier") < 0.34)).cast("int").alias("passes"))


_ASOF = f"vintage_start <= TIMESTAMP '{T0}' AND (vintage_end IS NULL OR vintage_end > TIMESTAMP '{T0}')"


@query(f"SELECT fact_id, source_id, series_id, observation_date, value FROM v_facts WHERE {_ASOF} AND observation_date <= DATE '2024-01-08'")
def pf07_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(spark, d).where(pit.knowable(_t0(), observed="observation_date", market_date=F.lit("2024-01-08").cast("date"))).select("fact_id", "source_id", "series_id", "observation_date", "value")


@query(f"SELECT source_id, count(*) AS late FROM v_facts WHERE vintage_start > TIMESTAMP '{T0}' GROUP BY source_id")
def pf08_leaks(spark: SparkSession, d: str) -> DataFrame:
    return pit.leaks(V.facts(spark, d), _t0()).groupBy("source_id").agg(F.count(F.lit(1)).alias("late"))


@query("SELECT series_id, date, CASE WHEN value >= 500 AND series_id LIKE 'A%' THEN 'high' WHEN value < 300 THEN 'low' ELSE 'neutral' END AS zone FROM v_macro")
def pf10_rule_priority(spark: SparkSession, d: str) -> DataFrame:
    zone = first_of(((F.col("value") >= 500) & F.col("series_id").startswith("A"), F.lit("high")), (F.col("value") < 300, F.lit("low"))).otherwise("neutral")
    return V.macro(spark, d).select("series_id", "date", zone.alias("zone"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN u.unit = 'percent' THEN x / 100 WHEN u.unit = 'bps' THEN x / 10000 ELSE x END AS p FROM (SELECT *, l_discount * 1000 AS x FROM lineitem) JOIN (VALUES ('A', 'percent'), ('N', 'bps'), ('R', 'unit')) u(flag, unit) ON l_returnflag = u.flag WHERE CASE WHEN u.unit = 'percent' THEN x / 100 WHEN u.unit = 'bps' THEN x / 10000 ELSE x END BETWEEN 0 AND 1")
def pf14_probability_units(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_discount") * 1000
    p = F.when(F.col("l_returnflag") == "A", x / 100).when(F.col("l_returnflag") == "N", x / 10000).otherwise(x)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).where("p BETWEEN 0 AND 1")


@query("SELECT question_id, round, probability, prior FROM (SELECT question_id, round, probability, lag(probability) OVER (PARTITION BY question_id ORDER BY round) AS prior FROM v_forecasts) WHERE prior IS NOT NULL AND probability < prior")
def pf15_monotone_violations(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy("round")
    return V.forecasts(spark, d).select("question_id", "round", "probability", F.lag("probability").over(w).alias("prior")).where("prior IS NOT NULL AND probability < prior")


@query("""SELECT * FROM (
    SELECT question_id, 'stale' AS due, 1 AS ord FROM v_forecasts GROUP BY question_id HAVING max(ts) < TIMESTAMP '1998-01-01'
    UNION ALL SELECT f.question_id, 'resolve', 0 FROM v_forecasts f ANTI JOIN v_res r ON f.question_id = r.question_id GROUP BY f.question_id
    UNION ALL SELECT question_id, 'divergent', 2 FROM (SELECT question_id, max(probability) - min(probability) AS spread FROM v_forecasts GROUP BY question_id) WHERE spread >= 95) ORDER BY ord, question_id""")
def pf16_due_items(spark: SparkSession, d: str) -> DataFrame:
    f = V.forecasts(spark, d)
    per = f.groupBy("question_id").agg(F.max("ts").alias("last"), (F.max("probability") - F.min("probability")).alias("spread"))
    kind = lambda rows, name, rank: rows.select("question_id", F.lit(name).alias("due"), F.lit(rank).alias("ord"))
    stale = kind(per.where(F.col("last") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")), "stale", 1)
    resolve = kind(per.join(V.resolutions(spark, d), "question_id", "left_anti"), "resolve", 0)
    return stale.unionByName(resolve).unionByName(kind(per.where("spread >= 95"), "divergent", 2)).orderBy("ord", "question_id")


@query("SELECT a.question_id, a.probability, b.probability AS reference FROM v_forecasts a JOIN v_forecasts b ON a.question_id = b.question_id AND b.round = a.round - 1 WHERE abs(a.probability / 100 - b.probability / 100) >= 0.5")
def pf17_divergence(spark: SparkSession, d: str) -> DataFrame:
    a = V.forecasts(spark, d).select("question_id", "round", "probability")
    b = a.select("question_id", (F.col("round") + 1).alias("round"), F.col("probability").alias("reference"))
    return a.join(b, ["question_id", "round"]).where(F.abs(F.col("probability") / 100 - F.col("reference") / 100) >= 0.5).select("question_id", "probability", "reference")


@query("SELECT source_id, series_id, max(vintage_start) AS seen, (max(vintage_start) + INTERVAL 72 HOUR < TIMESTAMP '2024-01-30')::int AS stale FROM v_facts GROUP BY ALL")
def pf18_freshness(spark: SparkSession, d: str) -> DataFrame:
    seen = V.facts(spark, d).groupBy("source_id", "series_id").agg(F.max("vintage_start").alias("seen"))
    return seen.withColumn("stale", (F.col("seen") + F.expr("INTERVAL 72 HOUR") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).cast("int"))


# ---- joins -----------------------------------------------------------------------------------


@query("SELECT f.question_id, f.round, f.probability FROM v_forecasts f JOIN (SELECT question_id, max(round) AS m FROM v_forecasts GROUP BY 1) x ON f.question_id = x.question_id AND f.round = x.m")
def jn01_latest_round(spark: SparkSession, d: str) -> DataFrame:
    return pit.latest(V.forecasts(spark, d).select("question_id", "round", "probability"), ["question_id"], "round")


@query("SELECT r.forecast_id, r.domain, f.round, o.status FROM v_res r LEFT JOIN v_forecasts f ON r.forecast_id = f.forecast_id LEFT JOIN v_overrides o ON r.forecast_id = o.forecast_id")
def jn02_left_joins(spark: SparkSession, d: str) -> DataFrame:
    f = V.forecasts(spark, d).select("forecast_id", "round")
    return V.resolutions(spark, d).join(f, "forecast_id", "left").join(V.overrides(spark, d), "forecast_id", "left").select("forecast_id", "domain", "round", "status")


@query("""SELECT a.domain, a.n, round(a.brier, 6) AS brier, b.n AS n_primary, round(b.brier, 6) AS brier_primary FROM (SELECT domain, count(*) n, avg(brier) brier FROM v_res GROUP BY 1) a
    LEFT JOIN (SELECT r.domain, count(*) n, avg(r.brier) brier FROM v_res r JOIN v_forecasts f USING (forecast_id) WHERE f.round = 1 GROUP BY 1) b ON a.domain = b.domain""")
def jn03_joined_aggregates(spark: SparkSession, d: str) -> DataFrame:
    r = V.resolutions(spark, d).join(V.forecasts(spark, d).select("forecast_id", "round"), "forecast_id", "left")
    first = F.col("round") == 1
    return r.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brier"), 6).alias("brier"), F.count(F.when(first, 1)).alias("n_primary"), F.round(F.avg(F.when(first, F.col("brier"))), 6).alias("brier_primary"))


@query("SELECT forecast_id, question_id FROM v_forecasts f WHERE NOT EXISTS (SELECT 1 FROM v_res r WHERE r.forecast_id = f.forecast_id)")
def jn04_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return V.forecasts(spark, d).join(V.resolutions(spark, d).select("forecast_id"), "forecast_id", "left_anti").select("forecast_id", "question_id")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def jn05_semi_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, (SELECT arg_max(o_totalprice, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS latest_f, (SELECT arg_max(o_totalprice, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS latest_o FROM customer")
def jn06_latest_per_field(spark: SparkSession, d: str) -> DataFrame:
    """Several correlated lookups at once: one pivoting aggregation and one join."""
    pick = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.struct("o_orderdate", "o_orderkey", "o_totalprice")))["o_totalprice"]
    last = table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").groupBy(F.col("o_custkey").alias("c_custkey")).agg(pick("F").alias("latest_f"), pick("O").alias("latest_o"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("SELECT a.date, round(a.close / b.close, 6) AS ratio FROM v_price a JOIN v_price b ON a.date = b.date AND a.series = '1-URGENT' AND b.series = '2-HIGH'")
def jn07_series_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).where("series IN ('1-URGENT', '2-HIGH')").groupBy("date").agg(F.max(F.when(F.col("series") == "1-URGENT", F.col("close"))).alias("a"), F.max(F.when(F.col("series") == "2-HIGH", F.col("close"))).alias("b"))
    return p.where("a IS NOT NULL AND b IS NOT NULL").select("date", F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query("SELECT series, max(date) AS date, arg_max(close, date) AS close FROM v_price GROUP BY series")
def jn08_last_row_per_series(spark: SparkSession, d: str) -> DataFrame:
    return pit.latest(V.prices(spark, d).select("series", "date", "close"), ["series"], "date")


_LAST_SIGN = "SELECT {cols} FROM v_buy b LEFT JOIN LATERAL (SELECT * FROM v_sign s WHERE s.user_id = b.user_id AND s.signup_ts {op} b.ts ORDER BY signup_ts {dir}, signup_id {dir} LIMIT 1) s ON true"
_COLS = "b.event_id, s.signup_id, s.signup_value"


def _asof(spark: SparkSession, d: str, **how) -> DataFrame:
    return asof_join(V.purchases(spark, d), V.signups(spark, d), by=["user_id"], left_time="ts", right_time="signup_ts", values=["signup_id", "signup_ts", "signup_value"], **how)


@query(_LAST_SIGN.format(cols=_COLS, op="<=", dir="DESC"))
def jn09_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d).select("event_id", "signup_id", "signup_value")


@query(_LAST_SIGN.format(cols=_COLS, op="<", dir="DESC"))
def jn10_asof_strict(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, strict=True).select("event_id", "signup_id", "signup_value")


@query(_LAST_SIGN.format(cols=_COLS, op=">=", dir="ASC"))
def jn11_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, forward=True).select("event_id", "signup_id", "signup_value")


@query(_LAST_SIGN.format(cols="b.event_id, s.signup_value AS value, round(date_diff('microsecond', s.signup_ts, b.ts) / 86400000000.0, 6) AS age_days", op="<=", dir="DESC"))
def jn12_asof_with_age(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("signup_ts").cast("timestamp"))) / 86_400_000_000
    return _asof(spark, d).select("event_id", F.col("signup_value").alias("value"), F.round(age, 6).alias("age_days"))


@query("""SELECT c.source_id, c.series_id, c.cutoff, c.latest_period, c.latest_value, c.prior_value FROM (
    SELECT source_id, series_id, k.cutoff, max(observation_date) AS latest_period, arg_max(value, observation_date) AS latest_value, list(value ORDER BY observation_date DESC)[2] AS prior_value
    FROM v_facts JOIN (SELECT unnest(range(1, 5))::bigint AS cutoff) k ON vintage_start <= TIMESTAMP '2024-01-01' + to_days((k.cutoff * 7)::int) AND (vintage_end IS NULL OR vintage_end > TIMESTAMP '2024-01-01' + to_days((k.cutoff * 7)::int)) GROUP BY ALL) c""")
def jn13_release_with_revisions(spark: SparkSession, d: str) -> DataFrame:
    """At each weekly cutoff the latest and second latest period as then revised."""
    week = 7 * 86_400_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    first = lambda c: F.greatest(F.lit(1), F.ceil(us(c) / week)).cast("long")
    at = pit.revisions_at_cutoffs(V.facts(spark, d), keys=["source_id", "series_id"], cutoff_of=first("vintage_start"), next_cutoff=F.ceil(us("vintage_end") / week).cast("long"), last_cutoff=F.lit(4).cast("long")).where("cutoff <= 4")
    ranked = at.groupBy("source_id", "series_id", "cutoff").agg(F.sort_array(F.collect_list(F.struct("observation_date", "value")), asc=False).alias("p"))
    return ranked.select("source_id", "series_id", "cutoff", F.col("p")[0]["observation_date"].alias("latest_period"), F.col("p")[0]["value"].alias("latest_value"), F.get("p", F.lit(1))["value"].alias("prior_value"))


@query(f"SELECT event_id, CASE WHEN signup_value >= 10 THEN signup_value END AS value FROM ({_LAST_SIGN.format(cols=_COLS, op='<=', dir='DESC')})")
def jn14_asof_blocking(spark: SparkSession, d: str) -> DataFrame:
    """A failed right row (here a value under 10) blocks: nothing older is carried past it."""
    return _asof(spark, d).select("event_id", F.when(F.col("signup_value") >= 10, F.col("signup_value")).alias("value"))


@query("SELECT date, count(*) AS n, round(sum(close), 2) AS total FROM v_price GROUP BY date HAVING count(*) = 5")
def jn16_date_intersection(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total")).where("n = 5")


@query("SELECT a.date, round(a.value / b.value, 6) AS ratio FROM v_macro a JOIN v_macro b ON a.date = b.date AND a.series_id = 'AF' AND b.series_id = 'NO' WHERE b.value <> 0")
def jn17_month_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = V.macro(spark, d)
    a, b = m.where("series_id = 'AF'").select("date", F.col("value").alias("a")), m.where("series_id = 'NO' AND value != 0").select("date", F.col("value").alias("b"))
    return a.join(b, "date").select("date", F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query("""SELECT k::int AS shift, count(*) AS n, round(sqrt(avg((a.value - b.value) * (a.value - b.value))), 6) AS rmse FROM (SELECT unnest(range(0, 13)) AS k) JOIN v_macro a ON a.series_id = 'AF' JOIN v_macro b ON b.series_id = 'RF'
    AND year(b.date) * 12 + month(b.date) = year(a.date) * 12 + month(a.date) + k GROUP BY k HAVING count(*) >= 24""")
def jn18_shifted_join(spark: SparkSession, d: str) -> DataFrame:
    m = V.macro(spark, d).withColumn("m", F.year("date") * 12 + F.month("date"))
    a = m.where("series_id = 'AF'").select("m", F.col("value").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("shift"))
    b = m.where("series_id = 'RF'").select(F.col("m").alias("mb"), F.col("value").alias("y"))
    diff = F.col("x") - F.col("y")
    return a.join(b, F.col("mb") == F.col("m") + F.col("shift")).groupBy("shift").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(diff * diff)), 6).alias("rmse")).where("n >= 24")


_ERAS = "(VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('middle', DATE '1997-01-01', DATE '1999-12-31'), ('late', DATE '1999-06-01', NULL)) e(era, a, b)"


def _eras(spark: SparkSession) -> DataFrame:
    """Overlapping windows of the calendar; three rows whatever the data."""
    return spark.sql("SELECT * FROM VALUES ('early', DATE '1995-01-01', DATE '1997-12-31'), ('middle', DATE '1997-01-01', DATE '1999-12-31'), ('late', DATE '1999-06-01', NULL) AS e(era, a, b)")


@query(f"SELECT era, series, count(*) AS n, round(sum(close), 2) AS total FROM v_price JOIN {_ERAS} ON date BETWEEN e.a AND coalesce(e.b, DATE '9999-12-31') GROUP BY ALL")
def jn19_range_join(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).join(F.broadcast(_eras(spark)), F.col("date").between(F.col("a"), F.coalesce("b", F.lit("9999-12-31").cast("date"))))
    return p.groupBy("era", "series").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("SELECT a.date, coalesce(b.close, a.close) AS close, (b.close IS NULL)::int AS bridged FROM v_price a LEFT JOIN v_price b ON a.date = b.date AND b.series = '2-HIGH' WHERE a.series = '1-URGENT'")
def jn21_bridge(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    a, b = p.where("series = '1-URGENT'").select("date", "close"), p.where("series = '2-HIGH'").select("date", F.col("close").alias("other"))
    return a.join(b, "date", "left").select("date", F.coalesce("other", "close").alias("close"), F.col("other").isNull().cast("int").alias("bridged"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey")
def jn22_orphans(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(ok, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


# ---- aggregations ----------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(avg(brier), 6) AS brier, sum(outcome)::bigint AS hits, min(probability) AS lo, max(probability) AS hi FROM v_res")
def ag01_global(spark: SparkSession, d: str) -> DataFrame:
    return V.resolutions(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brier"), 6).alias("brier"), F.sum("outcome").alias("hits"), F.min("probability").alias("lo"), F.max("probability").alias("hi"))


@query("SELECT coalesce(domain, '(all)') AS domain, count(*) AS n, round(avg(brier), 6) AS brier FROM v_res GROUP BY ROLLUP (domain)")
def ag02_total_row(spark: SparkSession, d: str) -> DataFrame:
    return V.resolutions(spark, d).rollup("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brier"), 6).alias("brier"), F.grouping("domain").alias("g")).select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("domain")).alias("domain"), "n", "brier")


@query("SELECT least(probability // 10, 9) AS bucket, count(*) AS n, round(avg(probability), 6) AS mean_p, round(avg(outcome), 6) AS freq FROM v_res GROUP BY 1")
def ag03_calibration(spark: SparkSession, d: str) -> DataFrame:
    return V.resolutions(spark, d).groupBy(F.expr("least(probability div 10, 9)").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("mean_p"), F.round(F.avg("outcome"), 6).alias("freq"))


@query("SELECT domain, count(*) AS n, round(avg(brier), 6) AS brier, (count(*) >= 10 AND avg(brier) > 0.34)::int AS blocked FROM v_res GROUP BY domain")
def ag04_domain_skill(spark: SparkSession, d: str) -> DataFrame:
    return V.resolutions(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brier"), 6).alias("brier"), ((F.count(F.lit(1)) >= 10) & (F.avg("brier") > 0.34)).cast("int").alias("blocked"))


@query("SELECT provider, count(*) FILTER (model = 'F') AS n_f, round(avg(cost) FILTER (model = 'F'), 4) AS cost_f, count(*) FILTER (model = 'O') AS n_o, round(avg(cost) FILTER (model = 'O'), 4) AS cost_o FROM v_costs GROUP BY provider")
def ag05_pairwise(spark: SparkSession, d: str) -> DataFrame:
    is_f, is_o = F.col("model") == "F", F.col("model") == "O"
    return V.costs(spark, d).groupBy("provider").agg(F.count(F.when(is_f, 1)).alias("n_f"), F.round(F.avg(F.when(is_f, F.col("cost"))), 4).alias("cost_f"), F.count(F.when(is_o, 1)).alias("n_o"), F.round(F.avg(F.when(is_o, F.col("cost"))), 4).alias("cost_o"))


@query("SELECT question_id, max(ts) AS ts, max(round) AS round, max(probability) AS probability FROM v_forecasts GROUP BY question_id")
def ag06_independent_maxima(spark: SparkSession, d: str) -> DataFrame:
    return V.forecasts(spark, d).groupBy("question_id").agg(F.max("ts").alias("ts"), F.max("round").alias("round"), F.max("probability").alias("probability"))


@query("SELECT series, date_trunc('month', date)::date AS month, arg_max(close, date) AS close, max(date) AS date FROM v_price GROUP BY ALL")
def ag07_month_end(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("series", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


@query("SELECT series, isoyear(date)::int AS y, week(date)::int AS w, arg_max(close, date) AS close FROM v_price GROUP BY ALL")
def ag08_week_end(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("series", F.expr("cast(extract(yearofweek FROM date) AS int)").alias("y"), F.weekofyear("date").alias("w")).agg(F.max_by("close", "date").alias("close"))


@query("SELECT series, year(date)::int AS y, quarter(date)::int AS q, round(sum(close), 2) AS total, arg_max(close, date) AS last FROM v_price GROUP BY ALL")
def ag09_mean_or_last(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("series", F.year("date").alias("y"), F.quarter("date").alias("q")).agg(F.round(F.sum("close"), 2).alias("total"), F.max_by("close", "date").alias("last"))


@query("SELECT provider, model, strftime(ts, '%Y-%m') AS month, sum(tokens)::double AS tokens, round(sum(cost), 2) AS cost FROM v_costs GROUP BY ALL")
def ag10_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return V.costs(spark, d).groupBy("provider", "model", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"))


@query("SELECT s.series, n, first, last, round(1 - n / days, 6) AS missing FROM (SELECT series, count(*) n, min(date) AS first, max(date) AS last FROM v_price GROUP BY 1) s JOIN (SELECT series, count(*) AS days FROM (SELECT series, unnest(range(min(date)::timestamp, max(date)::timestamp + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x FROM v_price GROUP BY 1) WHERE isodow(x) < 6 GROUP BY 1) w ON s.series = w.series")
def ag13_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rows, span and missing share against the weekdays of the span, counted by arithmetic."""
    s = V.prices(spark, d).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    weekdays = lambda day: F.floor((F.unix_date(day) + 3) / 7) * 5 + F.least(F.pmod(F.unix_date(day) + 3, F.lit(7)) + 1, F.lit(5))
    before = F.floor((F.unix_date("first") + 2) / 7) * 5 + F.least(F.pmod(F.unix_date("first") + 2, F.lit(7)) + 1, F.lit(5))
    return s.select("series", "n", "first", "last", F.round(1 - F.col("n") / (weekdays(F.col("last")) - before), 6).alias("missing"))


@query("SELECT source_id, count(*) AS n, sum((vintage_end IS NULL)::int)::bigint AS open FROM v_facts GROUP BY source_id")
def ag14_null_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("vintage_end").isNull().cast("int")).alias("open"))


@query("SELECT source_id, count(DISTINCT series_id) AS series, count(DISTINCT observation_date) AS periods FROM v_facts GROUP BY source_id")
def ag15_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(spark, d).groupBy("source_id").agg(F.count_distinct("series_id").alias("series"), F.count_distinct("observation_date").alias("periods"))


@query("SELECT series, round(quantile_cont(close, 0.1), 6) AS q10, round(quantile_cont(close, 0.5), 6) AS q50, round(quantile_cont(close, 0.9), 6) AS q90 FROM v_price GROUP BY series")
def ag16_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.round(F.expr(f"percentile(close, {p})"), 6)
    return V.prices(spark, d).groupBy("series").agg(q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"))


@query("SELECT p.series, round(100 * avg((p.close <= l.close)::int), 6) AS pctile FROM v_price p JOIN (SELECT series, arg_max(close, date) AS close FROM v_price GROUP BY 1) l ON p.series = l.series GROUP BY p.series")
def ag17_percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    last = p.groupBy("series").agg(F.max_by("close", "date").alias("last"))
    return p.join(last, "series").groupBy("series").agg(F.round(100 * F.avg((F.col("close") <= F.col("last")).cast("int")), 6).alias("pctile"))


@query("SELECT date, round(sum(z), 6) AS score FROM (SELECT date, (value - avg(value) OVER (PARTITION BY series_id)) / nullif(stddev_pop(value) OVER (PARTITION BY series_id), 0) AS z FROM v_macro) GROUP BY date")
def ag18_z_composite(spark: SparkSession, d: str) -> DataFrame:
    m = V.macro(spark, d)
    s = m.groupBy("series_id").agg(F.avg("value").alias("mean"), F.nullif(F.stddev_pop("value"), F.lit(0.0)).alias("sd"))
    return m.join(s, "series_id").groupBy("date").agg(F.round(F.sum((F.col("value") - F.col("mean")) / F.col("sd")), 6).alias("score"))


@query("""SELECT round(sum(n * (p - o) * (p - o)) / sum(n), 8) AS reliability, round(sum(n * (o - base) * (o - base)) / sum(n), 8) AS resolution, round(max(base) * (1 - max(base)), 8) AS uncertainty
    FROM (SELECT least(floor(probability / 100 * 10)::int, 9) AS b, count(*) n, avg(probability / 100) p, avg(outcome) o FROM v_res GROUP BY 1), (SELECT avg(outcome) AS base FROM v_res)""")
def ag19_murphy(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.scoring import murphy

    return murphy(V.resolutions(spark, d).select((F.col("probability") / 100).alias("p"), "outcome"))


@query("""SELECT question_id, year, round(sum(p * w) / sum(w), 6) AS weighted, count(*) AS rounds, min(p)::bigint AS least FROM (SELECT r.question_id, year(r.resolved_date)::int AS year, f.probability AS p,
    greatest(1, date_diff('second', f.ts, coalesce(lead(f.ts) OVER (PARTITION BY r.question_id, r.resolved_date ORDER BY f.ts, f.forecast_id), r.resolved_date::timestamp + INTERVAL 86399 SECOND))) AS w
    FROM v_res r JOIN v_forecasts f USING (forecast_id)) GROUP BY question_id, year""")
def ag21_time_weighted(spark: SparkSession, d: str) -> DataFrame:
    rf = V.resolutions(spark, d).select("forecast_id", "question_id", "resolved_date").join(V.forecasts(spark, d).select("forecast_id", "ts", "probability"), "forecast_id")
    w = Window.partitionBy("question_id", "resolved_date").orderBy("ts", "forecast_id")
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    end = F.coalesce(sec(F.lead("ts").over(w)), sec(F.col("resolved_date")) + 86_399)
    held = rf.withColumn("w", F.greatest(F.lit(1), end - sec(F.col("ts"))))
    return held.groupBy("question_id", F.year("resolved_date").alias("year")).agg(F.round(F.sum(F.col("probability") * F.col("w")) / F.sum("w"), 6).alias("weighted"), F.count(F.lit(1)).alias("rounds"), F.min("probability").alias("least"))


@query("SELECT a.series_id AS x, b.series_id AS y, count(*) AS n, CASE WHEN count(*) >= 12 THEN round(corr(a.value, b.value), 3) END AS r, CASE WHEN count(*) >= 12 THEN round(covar_pop(a.value, b.value) / nullif(var_pop(b.value), 0), 3) END AS beta FROM v_macro a JOIN v_macro b ON a.date = b.date AND a.series_id < b.series_id GROUP BY ALL")
def ag22_correlation(spark: SparkSession, d: str) -> DataFrame:
    m = V.macro(spark, d)
    a, b = m.select(F.col("date").alias("ad"), F.col("series_id").alias("x"), F.col("value").alias("u")), m.select(F.col("date").alias("bd"), F.col("series_id").alias("y"), F.col("value").alias("v"))
    enough = lambda c: F.round(F.when(F.count(F.lit(1)) >= 12, c), 3)
    # half of the pairs by the join itself; which pairs are wanted is the caller's to say where there are many series
    return a.join(b, (F.col("ad") == F.col("bd")) & (F.col("x") < F.col("y"))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), enough(F.corr("u", "v")).alias("r"), enough(F.covar_pop("u", "v") / F.nullif(F.var_pop("v"), F.lit(0.0))).alias("beta"))


@query("""SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b
    FROM (SELECT u.value AS x, v.value AS y FROM v_macro u JOIN v_macro v ON u.date = v.date AND u.series_id = 'AF' AND v.series_id = 'NO'))""")
def ag23_spearman(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.scoring import spearman

    m = V.macro(spark, d)
    pair = m.where("series_id = 'AF'").select("date", F.col("value").alias("x")).join(m.where("series_id = 'NO'").select("date", F.col("value").alias("y")), "date")
    return spearman(pair, "x", "y")


@query("SELECT series, round(regr_slope(close, t), 6) AS slope, round(regr_intercept(close, t), 4) AS intercept, round(regr_r2(close, t), 6) AS r2 FROM (SELECT series, close, date_diff('day', DATE '1995-01-01', date) AS t FROM v_price) GROUP BY series")
def ag24_trend(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).withColumn("t", F.datediff("date", F.lit("1995-01-01").cast("date")))
    return p.groupBy("series").agg(F.round(F.regr_slope("close", "t"), 6).alias("slope"), F.round(F.regr_intercept("close", "t"), 4).alias("intercept"), F.round(F.regr_r2("close", "t"), 6).alias("r2"))


@query("SELECT series_id, date FROM (SELECT series_id, date, value / lag(value) OVER w - 1 AS g, lag(value) OVER w / lag(value, 2) OVER w - 1 AS g1 FROM v_macro WINDOW w AS (PARTITION BY series_id ORDER BY date)) WHERE g >= 0.01 AND g1 >= 0.01")
def ag26_consecutive_rises(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("date")
    g = V.macro(spark, d).withColumn("g", F.col("value") / F.lag("value").over(w) - 1).withColumn("g1", F.lag("value").over(w) / F.lag("value", 2).over(w) - 1)
    return g.where("g >= 0.01 AND g1 >= 0.01").select("series_id", "date")


@query("""SELECT b AS bucket, count(*) AS n, round(avg((nxt > 0)::int), 6) AS up FROM (SELECT r, nxt, (r > c1)::int + (r > c2)::int + (r > c3)::int + (r > c4)::int AS b FROM
    (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r, lead(close) OVER (ORDER BY date) / close - 1 AS nxt FROM v_price WHERE series = '1-URGENT'),
    (SELECT s[1 + floor(len(s) * 0.2)::int] c1, s[1 + floor(len(s) * 0.4)::int] c2, s[1 + floor(len(s) * 0.6)::int] c3, s[1 + floor(len(s) * 0.8)::int] c4 FROM (SELECT list(r ORDER BY r) AS s FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM v_price WHERE series = '1-URGENT') WHERE r IS NOT NULL AND date < DATE '1998-01-01')) WHERE date >= DATE '1998-01-01' AND r IS NOT NULL AND nxt IS NOT NULL) GROUP BY b""")
def ag27_quintiles_from_training(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy("date")
    r = V.prices(spark, d).where("series = '1-URGENT'").select("date", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), (F.lead("close").over(w) / F.col("close") - 1).alias("nxt")).where("r IS NOT NULL")
    ranked = r.where("date < '1998-01-01'").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("r")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    cuts = ranked.agg(*(F.max(F.when(F.col("k") == F.floor(F.col("n") * q), F.col("r"))).alias(f"c{i}") for i, q in enumerate((0.2, 0.4, 0.6, 0.8))))
    b = sum(((F.col("r") > F.col(f"c{i}")).cast("int") for i in range(4)), F.lit(0))
    return r.where("date >= '1998-01-01' AND nxt IS NOT NULL").crossJoin(F.broadcast(cuts)).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("nxt") > 0).cast("int")), 6).alias("up"))


@query("""SELECT cohort, h, count(*) AS n, sum((f IS NULL)::int)::bigint AS incomplete, round(median(f), 6) AS median, round(avg((f > 0)::int), 6) AS hits, round(min(f), 6) AS worst FROM
    (SELECT h, unnest(CASE WHEN volume > 1 THEN ['all', 'busy'] ELSE ['all'] END) AS cohort, f FROM (SELECT volume, 5::int AS h, lead(close, 5) OVER w / close - 1 AS f FROM v_price WINDOW w AS (PARTITION BY series ORDER BY date) UNION ALL
     SELECT volume, 21, lead(close, 21) OVER w / close - 1 FROM v_price WINDOW w AS (PARTITION BY series ORDER BY date))) GROUP BY ALL""")
def ag28_cohorts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy("date")
    f = V.prices(spark, d).select("volume", *((F.lead("close", h).over(w) / F.col("close") - 1).alias(f"f{h}") for h in (5, 21)))
    long = f.select(F.explode(F.when(F.col("volume") > 1, F.array(F.lit("all"), F.lit("busy"))).otherwise(F.array(F.lit("all")))).alias("cohort"), "f5", "f21").select("cohort", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("f")) for h in (5, 21)))).alias("x")).select("cohort", "x.*")
    return long.groupBy("cohort", "h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("f").isNull().cast("int")).alias("incomplete"), F.round(F.expr("percentile(f, 0.5)"), 6).alias("median"), F.round(F.avg((F.col("f") > 0).cast("int")), 6).alias("hits"), F.round(F.min("f"), 6).alias("worst"))


@query("""SELECT a.series AS x, b.series AS y, count(*) AS n, round(avg(((a.r >= 0) = (b.r >= 0))::int), 6) AS agree FROM (SELECT series, date, close - lag(close) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price) a
    JOIN (SELECT series, date, close - lag(close) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price) b ON a.date = b.date AND a.series < b.series WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL""")
def ag29_direction_agreement(spark: SparkSession, d: str) -> DataFrame:
    r = V.prices(spark, d).select("series", "date", (F.col("close") - F.lag("close").over(Window.partitionBy("series").orderBy("date"))).alias("r")).where("r IS NOT NULL")
    a, b = r.select(F.col("date").alias("ad"), F.col("series").alias("x"), F.col("r").alias("u")), r.select(F.col("date").alias("bd"), F.col("series").alias("y"), F.col("r").alias("v"))
    # half of the pairs by the join itself; which pairs are wanted is the caller's to say where there are many series
    return a.join(b, (F.col("ad") == F.col("bd")) & (F.col("x") < F.col("y"))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("u") >= 0) == (F.col("v") >= 0)).cast("int")), 6).alias("agree"))


@query("SELECT o_orderstatus AS part, (round_even(share, 0) + CASE WHEN row_number() OVER (ORDER BY share DESC, o_orderstatus) = 1 THEN 100 - sum(round_even(share, 0)) OVER () ELSE 0 END)::bigint AS pct FROM (SELECT o_orderstatus, 100 * count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1)")
def ag31_shares_to_100(spark: SparkSession, d: str) -> DataFrame:
    """Shares rounded half to even, what is left over going to the greatest; a handful of groups."""
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))
    share = n.withColumn("share", 100 * F.col("n") / F.sum("n").over(everything)).withColumn("r", F.bround("share", 0))
    first = F.row_number().over(everything.orderBy(F.col("share").desc(), "part")) == 1
    return share.select("part", (F.col("r") + F.when(first, 100 - F.sum("r").over(everything)).otherwise(0)).cast("long").alias("pct"))


# ---- top-k, sets -------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def tk01_top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT series, arg_min(date, (close, date)) AS date, min(close) AS close FROM v_price GROUP BY series")
def tk03_argmin(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).groupBy("series").agg(F.min(F.struct("close", "date")).alias("m")).select("series", "m.date", "m.close")


@query("SELECT user_id, CASE WHEN max(ts) >= TIMESTAMP '2024-01-23' THEN arg_max(value, (ts, event_id)) END AS value FROM v_buy WHERE ts <= TIMESTAMP '2024-01-30' GROUP BY user_id")
def tk04_latest_with_max_age(spark: SparkSession, d: str) -> DataFrame:
    last = V.purchases(spark, d).where(F.col("ts") <= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    return last.select("user_id", F.when(F.col("r.ts") >= F.lit("2024-01-23 00:00:00").cast("timestamp_ntz"), F.col("r.value")).alias("value"))


@query("SELECT series, date, k FROM (SELECT p.series, p.date, row_number() OVER (PARTITION BY p.series ORDER BY abs(p.close - l.close), p.date) AS k FROM v_price p JOIN (SELECT series, arg_max(close, date) AS close, max(date) AS last FROM v_price GROUP BY 1) l ON p.series = l.series WHERE p.date < l.last) WHERE k <= 5")
def tk06_nearest_states(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    last = p.groupBy("series").agg(F.max_by("close", "date").alias("here"), F.max("date").alias("last"))
    near = p.join(last, "series").where("date < last").withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.abs(F.col("close") - F.col("here")), "date")))
    return near.where("k <= 5").select("series", "date", F.col("k").cast("long").alias("k"))


@query("SELECT a.user_id, a.value AS now, b.value AS was FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM v_buy WHERE ts <= TIMESTAMP '2024-01-29' GROUP BY 1) a LEFT JOIN (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM v_buy WHERE ts <= TIMESTAMP '2024-01-22' GROUP BY 1) b ON a.user_id = b.user_id")
def tk09_delta_days_before(spark: SparkSession, d: str) -> DataFrame:
    upto = lambda t: F.max(F.when(F.col("ts") <= F.lit(t).cast("timestamp_ntz"), F.struct("ts", "event_id", "value")))["value"]
    both = V.purchases(spark, d).groupBy("user_id").agg(upto("2024-01-29 00:00:00").alias("now"), upto("2024-01-22 00:00:00").alias("was"))
    return both.where("now IS NOT NULL").select("user_id", "now", "was")


@query("SELECT series AS key, 'price' AS source FROM v_price GROUP BY 1 UNION ALL SELECT series_id, 'macro' FROM v_macro GROUP BY 1")
def st01_union_all(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).select(F.col("series").alias("key"), F.lit("price").alias("source")).distinct().unionByName(V.macro(spark, d).select(F.col("series_id").alias("key"), F.lit("macro").alias("source")).distinct())


@query("SELECT user_id FROM v_buy INTERSECT SELECT user_id FROM v_sign")
def st02_intersect(spark: SparkSession, d: str) -> DataFrame:
    return V.purchases(spark, d).select("user_id").intersect(V.signups(spark, d).select("user_id"))


@query("SELECT date FROM v_price WHERE series = '1-URGENT' EXCEPT SELECT date FROM v_price WHERE series = '2-HIGH'")
def st03_except(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    return p.where("series = '1-URGENT'").select("date").subtract(p.where("series = '2-HIGH'").select("date"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def st04_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return pit.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("SELECT round(1 - count(DISTINCT k) / count(*), 6) AS duplicate_share FROM (SELECT path_id, list(round(r, 2) ORDER BY step) AS k FROM v_path0 GROUP BY path_id)")
def st05_duplicate_paths(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: F.round(x.cast("double") / 10, 2)).alias("k"))
    return e.agg(F.round(1 - F.count_distinct("k") / F.count(F.lit(1)), 6).alias("duplicate_share"))
