"""The driver's tables seen as point-in-time data: adapter views, each in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {VIEWS}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH RECURSIVE {VIEWS} {sql}"
        return f

    return register


def three_factor_ridge(rows: str, names: tuple[str, str, str], alpha: float, by: str | None = None) -> str:
    """SQL of the coefficients on x1, x2, x3 and a constant that isn't penalised, by Cramer's rule on the centred sums; rows with nulls are left out."""
    pairs = {(i, j): f"covar_pop(x{i}, x{j}) * count(*){f' + {alpha}' if i == j else ''}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j}
    sums = ", ".join(f"{e} AS s{i}{j}" for (i, j), e in pairs.items()) + ", " + ", ".join(f"covar_pop(x{i}, y) * count(*) AS t{i}, avg(x{i}) AS m{i}" for i in (1, 2, 3)) + ", avg(y) AS my"
    at = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def det(column: int | None) -> str:
        m = [[f"t{i}" if j == column else at(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
        return " + ".join(f"{m[0][a]} * ({m[1][b]} * {m[2][c]} - {m[1][c]} * {m[2][b]})" for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    solved = f"SELECT *, {', '.join(f'({det(j)}) / ({det(None)}) AS b{j}' for j in (1, 2, 3))} FROM (SELECT {key}{sums} FROM ({rows}) WHERE x1 + x2 + x3 + y IS NOT NULL{group})"
    labels = ", ".join(f"'{n}'" for n in (*names, "const"))
    return f"SELECT {key}unnest([{labels}]) AS term, round(unnest([b1, b2, b3, my - b1 * m1 - b2 * m2 - b3 * m3]), 6) AS coefficient FROM ({solved})"


def close() -> Column:
    """The close of a daily price."""
    return F.col("close")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Daily closes: (series, date, close, volume), one row per series and day."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume"))


def macro(spark: SparkSession, d: str) -> DataFrame:
    """Monthly macro values: (series_id, date, value)."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.sum("l_quantity").alias("value"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Bitemporal facts: an event's week is what it describes, its time is when it became known."""
    e = table(spark, d, "events").select(F.col("event_type").alias("source_id"), F.col("user_id").alias("series_id"), F.to_date(F.date_trunc("week", "ts")).alias("observation_date"), F.col("ts").alias("vintage_start"), F.col("event_id").alias("fact_id"), "value")
    w = Window.partitionBy("source_id", "series_id", "observation_date").orderBy("vintage_start", "fact_id")
    return e.withColumn("vintage_end", F.lead("vintage_start").over(w)).withColumn("revision_seq", (F.row_number().over(w) - 1).cast("long"))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Forecast rounds: (forecast_id, question_id, round, ts, probability, research_status)."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("forecast_id"), F.col("o_custkey").alias("question_id"), F.row_number().over(w).cast("long").alias("round"), F.col("o_orderdate").alias("ts"),
        (F.pmod(F.floor("o_totalprice"), F.lit(99)) + 1).cast("long").alias("probability"), F.when(F.col("o_orderpriority") == "5-LOW", "failed").alias("research_status"),
    )


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Later rulings on a forecast's status."""
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')").select(F.col("o_orderkey").alias("forecast_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"))


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes: (forecast_id, question_id, resolved_date, outcome, domain, probability, brier)."""
    o, c = table(spark, d, "orders").where("o_orderstatus != 'P'"), table(spark, d, "customer")
    year = F.year("o_orderdate")
    both = o.join(c, o.o_custkey == c.c_custkey)
    p = (F.pmod(F.floor("o_totalprice"), F.lit(99)) + 1).cast("long")
    outcome = (F.pmod(F.col("o_custkey") * 7 + year, F.lit(3)) == 0).cast("int")
    return both.select(F.col("o_orderkey").alias("forecast_id"), F.col("o_custkey").alias("question_id"), F.make_date(year, F.lit(12), F.lit(31)).alias("resolved_date"), outcome.alias("outcome"), F.col("c_mktsegment").alias("domain"), p.alias("probability"), ((p / 100 - outcome) * (p / 100 - outcome)).alias("brier"))


def costs(spark: SparkSession, d: str) -> DataFrame:
    """A cost log: (provider, model, ts, tokens, cost)."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("cost"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Simulated paths: (path_id, engine, step, r, level), level 100 before the first step; cumulated in the path's own row."""
    r = F.transform("embedding", lambda x: x.cast("double") / 10)
    so_far = F.aggregate("r", F.struct(F.lit(0.0).alias("t"), F.array().cast("array<double>").alias("xs")), lambda s, x: F.struct((s["t"] + x).alias("t"), F.array_append(s["xs"], s["t"] + x).alias("xs")))["xs"]
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("path_id"), F.col("label").alias("engine"), r.alias("r"))
    return e.select("path_id", "engine", F.posexplode(F.arrays_zip(F.col("r").alias("r"), so_far.alias("t"))).alias("step", "z")).select("path_id", "engine", "step", "z.r", (F.exp("z.t") * 100).alias("level"))


def purchases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")


def signups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_ts"), F.col("value").alias("signup_value"))


VIEWS = """
v_price AS (SELECT o_orderpriority AS series, o_orderdate::date AS date, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL),
v_macro AS (SELECT l_returnflag || l_linestatus AS series_id, date_trunc('month', l_shipdate)::date AS date, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
v_facts AS (SELECT event_type AS source_id, user_id AS series_id, date_trunc('week', ts)::date AS observation_date, ts AS vintage_start, event_id AS fact_id, value,
    lead(ts) OVER w AS vintage_end, row_number() OVER w - 1 AS revision_seq FROM events WINDOW w AS (PARTITION BY event_type, user_id, date_trunc('week', ts)::date ORDER BY ts, event_id)),
v_forecasts AS (SELECT o_orderkey AS forecast_id, o_custkey AS question_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round, o_orderdate AS ts,
    floor(o_totalprice)::bigint % 99 + 1 AS probability, CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' END AS research_status FROM orders),
v_overrides AS (SELECT o_orderkey AS forecast_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')),
v_res0 AS (SELECT o_orderkey AS forecast_id, o_custkey AS question_id, make_date(year(o_orderdate), 12, 31) AS resolved_date, ((o_custkey * 7 + year(o_orderdate)) % 3 = 0)::int AS outcome, c_mktsegment AS domain,
    floor(o_totalprice)::bigint % 99 + 1 AS probability FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
v_res AS (SELECT *, (probability / 100 - outcome) * (probability / 100 - outcome) AS brier FROM v_res0),
v_costs AS (SELECT l_returnflag AS provider, l_linestatus AS model, l_shipdate AS ts, l_quantity AS tokens, l_extendedprice AS cost FROM lineitem),
v_path0 AS (SELECT vec_id AS path_id, label AS engine, unnest(range(len(embedding)))::int AS step, unnest(embedding)::double / 10 AS r FROM embeddings),
v_paths AS (SELECT *, exp(sum(r) OVER (PARTITION BY path_id ORDER BY step)) * 100 AS level FROM v_path0),
v_buy AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase'),
v_sign AS (SELECT user_id, event_id AS signup_id, ts AS signup_ts, value AS signup_value FROM events WHERE event_type = 'signup')
"""
