"""Sources and sinks, ledger semantics, scalar functions and small operators over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import ledger as L
from tidemark.operators import pit, scoring
from tidemark.operators.series import Series
from tidemark.plans import views as V
from tidemark.plans.tables import table
from tidemark.plans.views import query
from tidemark.streaming.ledgers import weekly

r6 = lambda c: F.round(c, 6)

# ---- sources that SQL can express over the driver's tables ------------------------------------


@query("SELECT series, date, close FROM v_price")
def sc17_parallel_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Quotes as JSON with parallel arrays (times, closes) and back to rows."""
    from tidemark.sources.formats import parallel_arrays

    p = V.prices(spark, d).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("x"))
    text = p.select("series", F.to_json(F.struct(F.col("x.date").alias("date"), F.col("x.close").alias("close"))).alias("json"))
    return parallel_arrays(text, "json", {"date": "date", "close": "double"}).where("close IS NOT NULL").select("series", "date", "close")


@query("SELECT event_type AS kind, count(*) AS n, sum(CASE event_type WHEN 'view' THEN (props->>'k')::int WHEN 'click' THEN 2 * (props->>'k')::int ELSE 0 END)::bigint AS total FROM events GROUP BY 1")
def sc23_fan_out_by_kind(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") == "view", k).when(F.col("event_type") == "click", 2 * k).otherwise(0)).alias("total"))


# ---- ledger semantics ---------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, (o_totalprice > 250000)::int AS conflict FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 250000")
def sk02_append_unique(spark: SparkSession, d: str) -> DataFrame:
    """The ledger holds the orders with status F; all orders come, those over 250,000 changed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    led = o.where("o_orderstatus = 'F' OR v > 250000").select("id", "v")
    incoming = o.select("id", F.when(F.col("v") > 250000, -F.col("v")).otherwise(F.col("v")).alias("v"))
    new, conflicts = L.append_unique(led, incoming, "id", ["v"])
    return new.select("id", F.lit(0).alias("conflict")).unionByName(conflicts.select("id", F.lit(1).alias("conflict")))


@query("SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_retailprice AS v FROM part) a FULL JOIN (SELECT l_partkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) b ON a.k = b.k")
def mu01_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    new = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("v"))
    return L.upsert(old, new, ["k"])


@query("SELECT a.date, CASE WHEN b.close IS NOT NULL THEN b.close ELSE a.close END AS close, CASE WHEN b.close IS NOT NULL THEN 'promoted' ELSE 'own' END AS source FROM v_price a LEFT JOIN v_price b ON a.date = b.date AND b.series = '3-MEDIUM' AND b.volume > 1 WHERE a.series = '5-LOW'")
def mu03_promote_source(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d)
    b = p.where("series = '3-MEDIUM' AND volume > 1").select("date", F.col("close").alias("better"))
    return p.where("series = '5-LOW'").join(b, "date", "left").select("date", F.coalesce("better", "close").alias("close"), F.when(F.col("better").isNotNull(), "promoted").otherwise("own").alias("source"))


@query("SELECT c_custkey AS line, CASE WHEN c_acctbal < 0 THEN 'removed' WHEN c_nationkey = 3 THEN 'changed' END AS change FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3")
def mu05_line_changes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("line"), "c_nationkey", "c_acctbal", L.row_hash("c_name", "c_acctbal").alias("h"))
    now = c.where("c_acctbal >= 0").withColumn("h", F.when(F.col("c_nationkey") == 3, F.sha2("h", 256)).otherwise(F.col("h")))
    return L.line_changes(c, now, "line", "h")


@query("SELECT question_id, round, probability, CASE WHEN round = 1 THEN 0 ELSE m + 1 END::bigint AS revision_seq, CASE WHEN round > 1 THEN pid END AS supersedes FROM (SELECT f.*, x.m, x.pid, x.pp FROM (SELECT *, max(round) OVER (PARTITION BY question_id) AS last FROM v_forecasts) f JOIN (SELECT question_id, max(round) - 2 AS m, arg_max(forecast_id, round) FILTER (round < l) AS pid, arg_max(probability, round) FILTER (round < l) AS pp FROM (SELECT *, max(round) OVER (PARTITION BY question_id) AS l FROM v_forecasts) GROUP BY 1) x ON f.question_id = x.question_id WHERE f.round = f.last) WHERE round = 1 OR probability <> pp")
def mu06_revision_append(spark: SparkSession, d: str) -> DataFrame:
    """The ledger has all rounds but the last of each question; the last comes: skipped if it says the same."""
    f = V.forecasts(spark, d).withColumn("last", F.max("round").over(Window.partitionBy("question_id")))
    known = pit.latest(f.where("round < last").select("question_id", "round", "forecast_id", "probability"), ["question_id"], "round").withColumn("revision_seq", F.col("round") - 1)
    came = f.where("round = last").select("question_id", "round", "probability")
    return L.revise(known.drop("round"), came, ["question_id"], ["probability"], id="forecast_id").select("question_id", "round", "probability", F.col("revision_seq").cast("long").alias("revision_seq"), "supersedes")


@query("SELECT c_custkey, coalesce(n.v, c_name) AS c_name, coalesce(b.v::double, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max('order ' || o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) n ON n.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey")
def mu08_correction_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Orders act as corrections: those with status F correct a customer's name, O the balance, P none."""
    o = table(spark, d, "orders")
    fixes = o.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "c_name").otherwise("c_acctbal").alias("field"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("new_value"), F.struct("o_orderdate", "o_orderkey").alias("approved_at"), F.when(F.col("o_orderstatus") != "P", "approved").otherwise("open").alias("status"))
    return L.overlay_corrections(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), fixes, "c_custkey", ["c_name", "c_acctbal"])


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 400000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P'")
def mu11_quarantine(spark: SparkSession, d: str) -> DataFrame:
    _, bad = L.quarantine(table(spark, d, "orders"), {"price": F.col("o_totalprice") <= 400000, "status": F.col("o_orderstatus") != "P"})
    return bad.select("o_orderkey", F.concat_ws(",", "reasons").alias("reasons"))


@query("SELECT s.series, x::date AS date FROM (SELECT series, unnest(range(min(date)::timestamp, max(date)::timestamp + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x FROM v_price GROUP BY 1) s ANTI JOIN v_price p ON p.series = s.series AND p.date = x::date WHERE isodow(x) < 6")
def mu12_calendar_gaps(spark: SparkSession, d: str) -> DataFrame:
    return L.calendar_gaps(V.prices(spark, d), "series", "date").select("series", "date")


@query("SELECT series, count(*) FILTER (date > coalesce(bad, DATE '1900-01-01')) AS tail FROM v_price JOIN (SELECT series AS s, max(date) FILTER (volume < 2) AS bad FROM v_price GROUP BY 1) ON series = s GROUP BY series")
def sm07_healthy_tail(spark: SparkSession, d: str) -> DataFrame:
    return L.healthy_tail(V.prices(spark, d).withColumn("ok", F.col("volume") >= 2), "series", "date", "ok")


@query("SELECT source_id, series_id, date_trunc('week', vintage_start)::timestamp AS week, count(*) AS n, arg_max(value, (vintage_start, value)) AS last FROM v_facts GROUP BY ALL")
def sm05_weekly_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Weeks from Monday, by the function that the stream uses: here over the whole ledger at once."""
    f = V.facts(spark, d).withColumn("at", F.col("vintage_start").cast("timestamp"))
    return weekly(f, ["source_id", "series_id"], "at", "value").withColumn("week", F.col("week").cast("timestamp_ntz"))


# ---- scalar functions -------------------------------------------------------------------------


@query("SELECT p_partkey, round(p_retailprice / 7, 2) AS r, p_size % 7 AS m, least(p_size // 10, 4) AS b, substr(p_name, 1, 5) AS s, upper(p_brand) AS u, abs(p_size - 25) AS a FROM part")
def sf01_arithmetic_and_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 2).alias("r"), (F.col("p_size") % 7).alias("m"), F.expr("cast(least(p_size div 10, 4) AS int)").alias("b"), F.substring("p_name", 1, 5).alias("s"), F.upper("p_brand").alias("u"), F.abs(F.col("p_size") - 25).alias("a"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, year(o_orderdate) * 12 + month(o_orderdate) AS mi, (o_orderdate::date - INTERVAL 1 MONTH)::date AS prior, isoyear(o_orderdate)::int AS iy, week(o_orderdate)::int AS iw, last_day(o_orderdate) AS eom FROM orders")
def sf02_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("mi"), F.add_months(day, -1).alias("prior"), F.expr("cast(extract(yearofweek FROM o_orderdate) AS int)").alias("iy"), F.weekofyear("o_orderdate").alias("iw"), F.last_day(day).alias("eom"))


@query("SELECT event_id, (props->>'k')::int AS k, md5(props) AS md5, sha256(event_type || '|' || user_id) AS sha, regexp_extract(props, '([0-9]+)', 1) AS digits FROM events")
def sf03_json_hash_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.md5("props").alias("md5"), F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("sha"), F.regexp_extract("props", "([0-9]+)", 1).alias("digits"))


@query("SELECT unnest(range(DATE '2024-01-05'::timestamp, DATE '2026-12-31'::timestamp, INTERVAL 7 DAY))::date AS friday")
def sf04_friday_grid(spark: SparkSession, d: str) -> DataFrame:
    return cal.weekday_grid(spark, "2024-01-01", "2026-12-30", 4).select(F.col("day").alias("friday"))


@query("""SELECT y::int AS year, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * (b % 4) * 0 + 2 * e + 2 * i - h - k) % 7 AS l FROM
    (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h, b % 4 AS e, c // 4 AS i, c % 4 AS k FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT unnest(range(1990, 2050)) AS y)))))""")
def sf05_easter(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1990, 2050).select(F.col("id").cast("int").alias("year")).select("year", cal.easter(F.col("year")).alias("easter"))


@query("SELECT o_orderkey, timezone('UTC', timezone('America/New_York', o_orderdate::date + INTERVAL 16 HOUR)) AS cutoff FROM orders")
def sf06_session_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """16:00 New York of the day, in UTC."""
    return table(spark, d, "orders").select("o_orderkey", cal.zoned_cutoff(F.to_date("o_orderdate"), 16, "America/New_York").cast("timestamp_ntz").alias("cutoff"))


@query("SELECT p_partkey, round(1 / (1 + exp(-(p_retailprice - 1000) / 300)), 8) AS s, round(ln(p_retailprice), 8) AS l, round(sqrt(p_retailprice), 8) AS q FROM part")
def sf07_logistic(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(1 / (1 + F.exp(-(x - 1000) / 300)), 8).alias("s"), F.round(F.log(x), 8).alias("l"), F.round(F.sqrt(x), 8).alias("q"))


@query("""SELECT p_partkey, round(CASE WHEN x >= 0 THEN 1 - u ELSE u END, 6) AS phi FROM (SELECT p_partkey, x, exp(-x * x / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * t * t + 1.781477937 * t * t * t - 1.821255978 * power(t, 4) + 1.330274429 * power(t, 5)) AS u
    FROM (SELECT p_partkey, x, 1 / (1 + 0.2316419 * abs(x)) AS t FROM (SELECT p_partkey, (p_retailprice - 1500) / 400 AS x FROM part)))""")
def sf08_normal_cdf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", r6(scoring.normal_cdf((F.col("p_retailprice") - 1500) / 400)).alias("phi"))


@query("SELECT vec_id, round(list_sum(e), 5) AS s, round(list_max(e), 6) AS hi, list_position(e, list_max(e)) AS at, round(e[1] + e[2], 6) AS two FROM (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings)")
def sf09_arrays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 5).alias("s"), r6(F.array_max("e")).alias("hi"), F.array_position("e", F.array_max("e")).cast("int").alias("at"), r6(F.col("e")[0] + F.col("e")[1]).alias("two"))


@query("SELECT date, round(v, 6) AS value FROM (SELECT p.date, CASE WHEN b.date = a.date THEN a.value ELSE a.value + date_diff('day', a.date, p.date) * (b.value - a.value) / date_diff('day', a.date, b.date) END AS v FROM (SELECT DISTINCT date FROM v_price) p JOIN v_macro a ON a.series_id = 'AF' AND a.date = (SELECT max(date) FROM v_macro m WHERE m.series_id = 'AF' AND m.date <= p.date) JOIN v_macro b ON b.series_id = 'AF' AND b.date = (SELECT min(date) FROM v_macro m WHERE m.series_id = 'AF' AND m.date >= p.date))")
def sf10_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Linear between the months around each day; days outside the months have no row."""
    days = V.prices(spark, d).select("date").distinct().withColumn("s", F.lit("AF"))
    m = V.macro(spark, d).where("series_id = 'AF'").select("date", F.struct(F.col("date").alias("d"), F.col("value").alias("v")).alias("known"))
    x = days.join(m, "date", "left").unionByName(m.join(days, "date", "left_anti").withColumn("s", F.lit("AF")))
    w = Window.partitionBy("s").orderBy("date")
    x = x.withColumn("a", F.last("known", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.last("known", True).over(Window.partitionBy("s").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    slope = (F.col("b.v") - F.col("a.v")) / F.nullif(F.datediff("b.d", "a.d"), F.lit(0))
    v = F.coalesce(F.col("a.v") + F.datediff("date", "a.d") * slope, F.when(F.col("a.d") == F.col("b.d"), F.col("a.v")))
    return x.join(days.select("date"), "date", "left_semi").where("a IS NOT NULL AND b IS NOT NULL").select("date", r6(v).alias("value"))


# ---- small operators ------------------------------------------------------------------------


@query("SELECT question_id, round(tanh(sum(CASE WHEN probability >= 50 THEN 0.1 ELSE -0.1 END * probability / 100)), 6) AS score FROM v_forecasts f WHERE NOT EXISTS (SELECT 1 FROM v_overrides o WHERE o.forecast_id = f.forecast_id) GROUP BY question_id")
def so01_bounded_score(spark: SparkSession, d: str) -> DataFrame:
    f = V.forecasts(spark, d).join(V.overrides(spark, d), "forecast_id", "left_anti")
    part = F.when(F.col("probability") >= 50, 0.1).otherwise(-0.1) * F.col("probability") / 100
    return f.groupBy("question_id").agg(r6(F.tanh(F.sum(part))).alias("score"))


@query("SELECT domain, round(sum(mid * n) / sum(n), 6) AS expected FROM (SELECT domain, (probability // 10) * 10 + 5 AS mid, count(*) AS n FROM v_res GROUP BY ALL) GROUP BY domain")
def so02_expected_of_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges "lo-hi" with their weight in a map, back to an expected midpoint."""
    lo = F.expr("probability div 10") * 10
    per = V.resolutions(spark, d).groupBy("domain", F.concat(lo.cast("string"), F.lit("-"), (lo + 10).cast("string")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    ends = F.split("k", "-")
    long = maps.select("domain", F.explode("m").alias("k", "n")).withColumn("mid", (ends[0].cast("double") + ends[1].cast("double")) / 2)
    return long.groupBy("domain").agg(r6(F.sum(F.col("mid") * F.col("n")) / F.sum("n")).alias("expected"))


@query("SELECT source_id, series_id, round(sum(w * value) / nullif(sum(w), 0), 6) AS signal FROM (SELECT source_id, series_id, observation_date, arg_max(value, revision_seq) AS value, least(1, greatest(0, max(revision_seq) / 4.0)) AS w FROM v_facts GROUP BY ALL) GROUP BY ALL")
def so05_weighted_signal(spark: SparkSession, d: str) -> DataFrame:
    last = pit.latest(V.facts(spark, d).select("source_id", "series_id", "observation_date", "revision_seq", "value"), ["source_id", "series_id", "observation_date"], "revision_seq")
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("revision_seq") / 4))
    return last.withColumn("w", w).groupBy("source_id", "series_id").agg(r6(F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("signal"))


@query("SELECT series, date, round(exp(sum(CASE WHEN r < 0 THEN 1.5 * r ELSE 0.8 * r END) OVER (PARTITION BY series ORDER BY date)), 6) AS path FROM (SELECT series, date, ln(close) - lag(ln(close)) OVER (PARTITION BY series ORDER BY date) AS r FROM v_price) WHERE r IS NOT NULL")
def so10_asymmetric_beta(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series"], "date")
    r = V.prices(spark, d).withColumn("r", s.log_change(F.col("close"))).where("r IS NOT NULL")
    return r.select("series", "date", r6(F.exp(F.sum(F.when(F.col("r") < 0, 1.5 * F.col("r")).otherwise(0.8 * F.col("r"))).over(s.so_far))).alias("path"))


@query("""SELECT series, peak, trough, round(depth, 6) AS depth, (SELECT min(date) FROM v_price r WHERE r.series = x.series AND r.date > x.trough AND r.close >= x.top) AS recovered FROM (SELECT series, date AS trough, dd AS depth, top, (SELECT min(date) FROM v_price q WHERE q.series = y.series AND q.date <= y.date AND q.close = y.top) AS peak FROM
    (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dd, date) AS k FROM (SELECT series, date, max(close) OVER w AS top, close / max(close) OVER w - 1 AS dd FROM v_price WINDOW w AS (PARTITION BY series ORDER BY date))) y WHERE k = 1) x""")
def so14_deepest_drawdown(spark: SparkSession, d: str) -> DataFrame:
    s, p = Series(["series"], "date"), V.prices(spark, d)
    x = p.withColumn("top", F.max("close").over(s.so_far)).withColumn("dd", s.drawdown(F.col("close")))
    worst = x.groupBy("series").agg(F.min(F.struct("dd", "date", "top")).alias("m")).select("series", F.col("m.date").alias("trough"), F.col("m.dd").alias("depth"), F.col("m.top").alias("peak_value"))
    dates = p.join(worst, "series").groupBy("series", "trough", "depth").agg(F.min(F.when((F.col("date") <= F.col("trough")) & (F.col("close") == F.col("peak_value")), F.col("date"))).alias("peak"), F.min(F.when((F.col("date") > F.col("trough")) & (F.col("close") >= F.col("peak_value")), F.col("date"))).alias("recovered"))
    return dates.select("series", "peak", "trough", r6(F.col("depth")).alias("depth"), "recovered")


@query("SELECT forecast_id, floor(date_diff('day', ts::date, DATE '2001-12-31') / 7)::bigint AS whole, ceil(date_diff('day', ts::date, DATE '2001-12-31') / 7)::bigint AS begun FROM v_forecasts")
def so15_steps_of_window(spark: SparkSession, d: str) -> DataFrame:
    weeks = F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("ts")) / 7
    return V.forecasts(spark, d).select("forecast_id", F.floor(weeks).alias("whole"), F.ceil(weeks).alias("begun"))


@query("SELECT domain, n, t1, round(t1 / n, 6) AS ratio FROM (SELECT c_mktsegment AS domain, count(DISTINCT o_clerk) AS n, count(DISTINCT o_clerk) FILTER (o_clerk LIKE 'u%0') AS t1 FROM (SELECT c_mktsegment, 'u' || o_custkey AS o_clerk FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)")
def so16_quality_ratio(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("domain"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("u")).distinct()
    top = F.col("u").like("u%0")
    return o.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(top, 1)).alias("t1")).withColumn("ratio", r6(F.col("t1") / F.col("n")))


@query("SELECT domain, round(w, 6) AS w, round(w * least(1, 0.35 / s), 6) AS capped FROM (SELECT domain, question_id, w, sum(w) OVER (PARTITION BY domain) AS s FROM (SELECT domain, question_id, exp(-ln(2) * date_diff('day', max(resolved_date), DATE '2001-12-31') / 365.0) / 100 AS w FROM v_res GROUP BY ALL))")
def so28_decay_and_cap(spark: SparkSession, d: str) -> DataFrame:
    last = V.resolutions(spark, d).groupBy("domain", "question_id").agg(F.max("resolved_date").alias("t"))
    w = last.select("domain", (F.exp(-F.log(F.lit(2.0)) * F.datediff(F.lit("2001-12-31").cast("date"), "t") / 365.0) / 100).alias("w"))
    total = w.groupBy("domain").agg(F.sum("w").alias("s"))
    return w.join(total, "domain").select("domain", r6(F.col("w")).alias("w"), r6(F.col("w") * F.least(F.lit(1.0), 0.35 / F.col("s"))).alias("capped"))


@query("SELECT a.series, a.date, 21::int AS h, b.date AS target, round(b.close / a.close - 1, 6) AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM v_price) a JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM v_price) b ON a.series = b.series AND b.k = a.k + 21 WHERE a.volume > 1")
def so29_matured_by_offset(spark: SparkSession, d: str) -> DataFrame:
    p = V.prices(spark, d).withColumn("k", Series(["series"], "date").number())
    b = p.select("series", (F.col("k") - 21).alias("k"), F.col("date").alias("target"), F.col("close").alias("later"))
    return p.where("volume > 1").join(b, ["series", "k"]).select("series", "date", F.lit(21).alias("h"), "target", r6(F.col("later") / F.col("close") - 1).alias("outcome"))


@query("SELECT domain, round(avg(brier), 6) AS brier, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY domain ORDER BY resolved_date DESC) AS k FROM v_res) WHERE k <= 3 GROUP BY domain")
def so30_last_origins(spark: SparkSession, d: str) -> DataFrame:
    r = V.resolutions(spark, d)
    # dates are ranked, a row each, not forecasts
    dates = r.select("domain", "resolved_date").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy("domain").orderBy(F.col("resolved_date").desc())))
    return r.join(dates.where("k <= 3"), ["domain", "resolved_date"]).groupBy("domain").agg(r6(F.avg("brier")).alias("brier"), F.count(F.lit(1)).alias("n"))


@query("SELECT series, i, round(q, 4) AS q FROM (SELECT series, unnest(range(0, 201))::int AS i, unnest(quantile_cont(close, list_transform(range(0, 201), lambda i: (i + 0.5) / 201))) AS q FROM v_price GROUP BY series)")
def so32_compact_distribution(spark: SparkSession, d: str) -> DataFrame:
    levels = ", ".join(repr((i + 0.5) / 201) for i in range(201))
    q = V.prices(spark, d).groupBy("series").agg(F.expr(f"percentile(close, array({levels}))").alias("q"))
    return q.select("series", F.posexplode("q").alias("i", "q")).select("series", "i", F.round("q", 4).alias("q"))


@query("SELECT series, date AS origin, nxt AS first_target FROM (SELECT series, date, lead(date) OVER (PARTITION BY series ORDER BY date) AS nxt, max(date) OVER (PARTITION BY series, isoyear(date), week(date)) AS last FROM v_price) WHERE date = last AND nxt IS NOT NULL")
def so33_weekly_origins(spark: SparkSession, d: str) -> DataFrame:
    s = Series(["series"], "date")
    p = V.prices(spark, d).withColumn("nxt", F.lead("date").over(s.w)).withColumn("last", F.max("date").over(Window.partitionBy("series", F.trunc("date", "week"))))
    return p.where("date = last AND nxt IS NOT NULL").select("series", F.col("date").alias("origin"), F.col("nxt").alias("first_target"))


@query("""SELECT round(sum(abs(fa - fb) * dx), 4) AS w1, round(max(abs(fa - fb)), 6) AS gap FROM (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb, coalesce(lead(x) OVER w - x, 0) AS dx FROM
    (SELECT value AS x, sum((series_id = 'AF')::int) AS a, sum((series_id = 'NO')::int) AS b FROM v_macro WHERE series_id IN ('AF', 'NO') GROUP BY 1) WINDOW w AS (ORDER BY x))""")
def so22_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    per = V.macro(spark, d).where("series_id IN ('AF', 'NO')").groupBy("value").agg(F.sum((F.col("series_id") == "AF").cast("int")).alias("a"), F.sum((F.col("series_id") == "NO").cast("int")).alias("b")).withColumn("one", F.lit(1))
    s, every = Series(["one"], "value"), Window.partitionBy("one")
    gap = F.abs(F.sum("a").over(s.so_far) / F.sum("a").over(every) - F.sum("b").over(s.so_far) / F.sum("b").over(every))
    x = per.select(gap.alias("gap"), F.coalesce(F.lead("value").over(s.w) - F.col("value"), F.lit(0.0)).alias("dx"))
    return x.agg(F.round(F.sum(F.col("gap") * F.col("dx")), 4).alias("w1"), r6(F.max("gap")).alias("gap"))
