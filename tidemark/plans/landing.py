"""Sources and sinks end to end: a table is written in a format, read back, and must be the table again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans import views as V
from tidemark.plans.tables import table
from tidemark.plans.views import query
from tidemark.session import checkpoint_dir
from tidemark.sources import formats, store

r6 = lambda c: F.round(c, 6)


def scratch(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which all executors share; it goes when the session's JVM does."""
    at = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def put_files(spark: SparkSession, root: str, files: DataFrame) -> None:
    """Lay down one binary file for each row (name, content): a landing zone of a few small published files."""
    fs, at = store._fs(spark, root)
    for name, content in files.collect():
        out = fs.create(at(f"{root}/{name}"), True)
        out.write(bytearray(content))
        out.close()


_FACTS = "SELECT fact_id, source_id, series_id, observation_date, value FROM v_facts"
COLUMNS = ("fact_id", "source_id", "series_id", "observation_date", "value")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(spark, d).select(*COLUMNS)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 450000")
def sc01_table_scan(spark: SparkSession, d: str) -> DataFrame:
    """Columns and filter reach the scan (ReadSchema, PushedFilters)."""
    return table(spark, d, "orders").where("o_totalprice >= 450000").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"{_FACTS} WHERE year(observation_date) <= 2024")
def sc02_hive_scan(spark: SparkSession, d: str) -> DataFrame:
    root = f"{scratch(spark)}/facts"
    store.append_facts(_facts(spark, d), root, keys=["fact_id"])
    return store.read_facts(spark, root, upto_year=2024).select(*COLUMNS)


@query("SELECT source_id, count(*) AS n FROM v_facts GROUP BY source_id")
def sk01_append_once(spark: SparkSession, d: str) -> DataFrame:
    """The same facts appended twice are there once."""
    root = f"{scratch(spark)}/facts"
    for _ in range(2):
        store.append_facts(_facts(spark, d), root, keys=["fact_id"])
    return store.read_facts(spark, root).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(_FACTS)
def sc03_jsonl(spark: SparkSession, d: str) -> DataFrame:
    root = f"{scratch(spark)}/jsonl"
    _facts(spark, d).write.json(root)
    return formats.jsonl(spark, root, "fact_id long, source_id string, series_id long, observation_date date, value double").select(*COLUMNS)


@query(_FACTS)
def sc04_manifest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Gzip chunks by source; a manifest of names, hashes and counts is written beside them and checked on reading."""
    root = f"{scratch(spark)}/chunks"
    _facts(spark, d).repartition("source_id").write.option("compression", "gzip").json(root)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(root).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))
    counts = spark.read.schema("fact_id long").json(root).groupBy(F.col("_metadata.file_name").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    manifest = files.join(counts, "path")
    return formats.manifest_jsonl(spark, root, manifest, "fact_id long, source_id string, series_id long, observation_date date, value double").select(*COLUMNS)


@query("SELECT strftime(resolved_date, '%Y-%m-%d') AS resolved_date, forecast_id, probability, outcome FROM v_res")
def sk05_csv_append(spark: SparkSession, d: str) -> DataFrame:
    """A CSV ledger, appended to in two parts and read with a strict header."""
    root = f"{scratch(spark)}/ledger"
    r = V.resolutions(spark, d).select(F.date_format("resolved_date", "yyyy-MM-dd").alias("resolved_date"), "forecast_id", "probability", "outcome")
    for part in (r.where("outcome = 0"), r.where("outcome = 1")):
        part.write.mode("append").option("header", True).csv(root)
    return formats.ledger_csv(spark, root, "resolved_date string, forecast_id long, probability long, outcome int").where("NOT bad").select("resolved_date", "forecast_id", "probability", "outcome")


@query("SELECT forecast_id, CASE WHEN round = 1 THEN 'first' ELSE 'later' END AS phase, probability FROM v_forecasts")
def sc06_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """A text record per forecast, front matter and body, taken apart again."""
    f = V.forecasts(spark, d)
    text = F.concat(F.lit("---\nforecast_id: "), F.col("forecast_id").cast("string"), F.lit("\nphase: "), F.when(F.col("round") == 1, "first").otherwise("later"), F.lit("\nprobability: "), F.col("probability").cast("string"), F.lit("\n---\n\nBody of the record."))
    got = formats.parse_records(f.select("forecast_id", text.alias("text")), "forecast_id", "text")
    return got.select(F.col("fields.forecast_id").cast("long").alias("forecast_id"), F.col("fields.phase").alias("phase"), F.col("fields.probability").cast("long").alias("probability"))


@query("SELECT series_id, date, CASE WHEN value < 100 THEN NULL ELSE value END AS value FROM v_macro")
def sc08_csv_with_sentinels(spark: SparkSession, d: str) -> DataFrame:
    """Dates and values as text, missing values as a dot; a folder per series, all read at once."""
    root = f"{scratch(spark)}/csv"
    out = V.macro(spark, d).select("series_id", F.date_format("date", "yyyy-MM-dd").alias("DATE"), F.when(F.col("value") < 100, ".").otherwise(F.col("value").cast("string")).alias("VALUE"))
    out.write.partitionBy("series_id").option("header", True).csv(root)
    return formats.dated_csv(spark, root, value="VALUE", keep=("series_id",))


@query("SELECT series, date, close FROM v_price")
def sc09_us_dates(spark: SparkSession, d: str) -> DataFrame:
    root = f"{scratch(spark)}/csv"
    V.prices(spark, d).select("series", F.date_format("date", "MM/dd/yyyy").alias("DATE"), F.col("close").alias("CLOSE")).write.partitionBy("series").option("header", True).csv(root)
    return formats.vix_csv(spark, root, keep=("series",)).withColumnRenamed("value", "close")


@query("SELECT date, max(value) FILTER (series_id = 'AF') AS y2, max(value) FILTER (series_id = 'NO') AS y10 FROM v_macro GROUP BY date")
def sc10_xml(spark: SparkSession, d: str) -> DataFrame:
    root = f"{scratch(spark)}/xml"
    m = V.macro(spark, d).groupBy("date").agg(F.max(F.when(F.col("series_id") == "AF", F.col("value"))).alias("d:BC_2YEAR"), F.max(F.when(F.col("series_id") == "NO", F.col("value"))).alias("d:BC_10YEAR"))
    m.withColumn("d:NEW_DATE", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")).drop("date").write.format("xml").option("rootTag", "feed").option("rowTag", "m:properties").option("validateName", False).save(root)
    return formats.yields_xml(spark, root, {"y2": "BC_2YEAR", "y10": "BC_10YEAR"})


@query("SELECT series_id, date, value FROM v_macro")
def sc11_monthly_csv(spark: SparkSession, d: str) -> DataFrame:
    root = f"{scratch(spark)}/csv"
    V.macro(spark, d).select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "value").write.partitionBy("series_id").option("header", True).csv(root)
    return formats.dated_csv(spark, root, value="value", date="date", keep=("series_id",))


@query("SELECT series_id, strftime(date, '%Y-%m-%d') AS date, value FROM v_macro")
def sc13_zipped(spark: SparkSession, d: str) -> DataFrame:
    """Zip files with a monthly block and an annual one below it, which is not read."""
    import io
    import zipfile

    import pandas as pd

    root = scratch(spark)

    def zipped(part: pd.DataFrame) -> pd.DataFrame:
        lines = [",v"] + [f"{t:%Y%m},{v}" for t, v in sorted(zip(part["date"], part["value"], strict=True))] + ["", " Annual", "1999,1.0"]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("data.csv", "\n".join(lines))
        return pd.DataFrame({"series_id": part["series_id"].iloc[:1], "content": [buffer.getvalue()]})

    made = V.macro(spark, d).groupBy("series_id").applyInPandas(zipped, "series_id string, content binary")
    put_files(spark, root, made.select(F.concat("series_id", F.lit(".zip")), "content"))
    got = formats.zipped_factors(spark, f"{root}/*.zip")
    return got.select(F.regexp_extract("path", r"(\w+)\.zip$", 1).alias("series_id"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("values")[0].alias("value"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def sc20_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays per filer, filtered by form after they are rows."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("x"))
    text = o.select("o_custkey", F.to_json(F.struct(F.col("x.o_orderkey").alias("accession"), F.col("x.o_orderpriority").alias("form"))).alias("json"))
    return formats.parallel_arrays(text, "json", {"accession": "bigint", "form": "string"}).where("form IN ('1-URGENT', '2-HIGH')").select("o_custkey", F.col("accession").alias("o_orderkey"), F.col("form").alias("o_orderpriority"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS expiry, CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'P' END AS side, floor(o_totalprice)::bigint / 1000 AS strike FROM orders")
def sc21_option_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Option symbols (root, date, side, strike in thousandths) taken apart by pattern."""
    o = table(spark, d, "orders")
    symbol = F.concat(F.lit("QQQ"), F.date_format("o_orderdate", "yyMMdd"), F.when(F.col("o_orderstatus") == "F", "C").otherwise("P"), F.lpad(F.floor("o_totalprice").cast("string"), 8, "0"))
    pattern = r"^([A-Z]+)(\d{6})([CP])(\d{8})$"
    part = lambda i: F.regexp_extract("symbol", pattern, i)
    year = F.when(F.substring(part(2), 1, 2) > "50", "19").otherwise("20")
    return o.select("o_orderkey", symbol.alias("symbol")).select("o_orderkey", F.concat(year, F.substring(part(2), 1, 2), F.lit("-"), F.substring(part(2), 3, 2), F.lit("-"), F.substring(part(2), 5, 2)).alias("expiry"), part(3).alias("side"), (part(4).cast("long") / 1000).alias("strike"))


@query("SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc15_html_table(spark: SparkSession, d: str) -> DataFrame:
    """One page per region with a table of its nations below a table that isn't wanted; entities and blanks are read."""
    root = f"{scratch(spark)}/pages"
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    row = F.concat(F.lit("<tr>\n<td> "), F.regexp_replace("n_name", " ", "&#32;"), F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    pages = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.concat_ws("", F.collect_list(row)).alias("rows"))
    html = F.concat(F.lit("<html><table><tr><td>menu</td></tr></table><table><tr><th>name</th><th>key</th></tr>"), "rows", F.lit("</table></html>"))
    pages.select("r_name", html.alias("value")).repartition("r_name").write.partitionBy("r_name").text(root)
    cells = formats.html_tables(spark, f"{root}/*/*.txt").where("table = 1 AND row > 0")
    return cells.select(F.url_decode(F.regexp_extract("path", "r_name=([^/]+)/", 1)).alias("r_name"), F.col("cells")[0].alias("n_name"), F.col("cells")[1].cast("int").alias("n_nationkey"))


@query("SELECT series, date, close - 1 AS open, close + 2 AS high, close - 2 AS low, close, volume::double AS volume FROM v_price WHERE volume > 1")
def sc18_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars by series; days without a close come as N/D and are dropped."""
    root = f"{scratch(spark)}/csv"
    c = F.col("close")
    said = F.when(F.col("volume") > 1, c.cast("string")).otherwise("N/D")
    p = V.prices(spark, d).select("series", F.col("date").alias("Date"), (c - 1).alias("Open"), (c + 2).alias("High"), (c - 2).alias("Low"), said.alias("Close"), F.col("volume").alias("Volume"))
    p.write.partitionBy("series").option("header", True).csv(root)
    return formats.ohlcv_csv(spark, root, keep=("series",))


@query("SELECT source_id, (year(observation_date) // 10 * 10)::bigint AS decade, count(*) AS n FROM v_facts GROUP BY ALL")
def sk03_chunks_by_decade(spark: SparkSession, d: str) -> DataFrame:
    root = f"{scratch(spark)}/chunks"
    f = _facts(spark, d).withColumn("decade", F.expr("year(observation_date) div 10 * 10"))
    f.repartition("source_id", "decade").write.partitionBy("source_id", "decade").option("compression", "gzip").json(root)
    return spark.read.schema("fact_id long, source_id string, decade long").json(root).groupBy("source_id", "decade").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT series, date, close FROM v_price WHERE series <> '5-LOW'")
def sk04_rebuild_and_swap(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a table published one after the other; readers see the second."""
    root = scratch(spark)
    p = V.prices(spark, d).select("series", "date", "close")
    store.publish(p, root, "view")
    store.publish(p.where("series != '5-LOW'"), root, "view")
    return store.latest(spark, root, "view")


@query("SELECT series, count(*) AS n FROM v_price GROUP BY series")
def sk06_write_once(spark: SparkSession, d: str) -> DataFrame:
    """A second write to the same place fails and changes nothing."""
    root = f"{scratch(spark)}/once"
    p = V.prices(spark, d).select("series", "date")
    store.write_once(p, root)
    try:
        store.write_once(p.limit(1), root)
        raise AssertionError("written twice")
    except Exception as e:
        if "ALREADY_EXISTS" not in str(e):
            raise
    return spark.read.parquet(root).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT series, date, close FROM v_price WHERE close > 0")
def mu04_staged_build(spark: SparkSession, d: str) -> DataFrame:
    """Built aside, checked, then made current; a build that fails its check never is."""
    root = scratch(spark)
    p = V.prices(spark, d).select("series", "date", "close")
    for build in (p.where("close > 0"), p.withColumn("close", -F.col("close"))):
        if build.where("close <= 0").limit(1).count() == 0:
            store.publish(build, root, "prices")
    return store.latest(spark, root, "prices")


@query("SELECT series_id, date, value FROM v_macro")
def mu10_content_pointer(spark: SparkSession, d: str) -> DataFrame:
    """The same content published again, in another order, is the same version; other content is a new one."""
    root = scratch(spark)
    m = V.macro(spark, d).select("series_id", "date", "value")
    other = store.publish(m.where("value IS NULL"), root, "macro")
    first = store.publish(m, root, "macro")
    again = store.publish(m.orderBy("value"), root, "macro")
    if first != again or first == other:
        raise AssertionError("the pointer doesn't follow the content")
    return store.latest(spark, root, "macro")


@query("SELECT o_custkey, round(sum(o_totalprice * (o_orderstatus = 'F')::int), 2) AS before, count(*) AS n FROM orders GROUP BY 1")
def mu02_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A derived table deleted and built anew from its source; nothing of the stale one is left."""
    path = f"{scratch(spark)}/derived"
    derived = lambda o: o.groupBy("o_custkey").agg(F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("before"), F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders")
    store.rebuild(derived(o.where("o_totalprice < 100000").withColumn("o_custkey", -F.col("o_custkey"))), path)
    store.rebuild(derived(o), path)
    return spark.read.parquet(path)


@query("SELECT series_id, strftime(date, '%Y-%m-%d') AS date, value, row_number() OVER (PARTITION BY series_id ORDER BY date) + 1 AS line_no, sha256(series_id || ',' || strftime(date, '%Y-%m-%d') || ',' || value::bigint) AS line_hash FROM v_macro")
def sc05_ledger_lines(spark: SparkSession, d: str) -> DataFrame:
    """A CSV ledger per series, read with a strict header, the lines' numbers in their file and their hashes."""
    root = f"{scratch(spark)}/ledger"
    m = V.macro(spark, d).select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("value").cast("long").alias("value"), F.col("series_id").alias("s"))
    m.repartition("s").sortWithinPartitions("s", "date").write.partitionBy("s").option("header", True).csv(root)
    got = formats.ledger_csv(spark, f"{root}/*/*.csv", "series_id string, date string, value double")
    return got.where("NOT bad").select("series_id", "date", "value", "line_no", "line_hash")


@query("SELECT n_nationkey, n_name, r FROM (SELECT n_nationkey, n_name, n_regionkey::int AS r FROM nation)")
def sc06_record_files(spark: SparkSession, d: str) -> DataFrame:
    """A file per record, with front matter and a body, scanned and taken apart; other files beside them have no fields."""
    root = f"{scratch(spark)}/records"
    n = table(spark, d, "nation")
    text = F.concat(F.lit("---\nnation: "), F.col("n_nationkey").cast("string"), F.lit("\nname: '"), "n_name", F.lit("'\nregion: "), F.col("n_regionkey").cast("string"), F.lit("\nextra: kept\n---\n\nBody: of the record"))
    n.select(F.col("n_nationkey").alias("k"), text.alias("value")).unionByName(spark.sql("SELECT -1 AS k, 'a template without front matter' AS value").withColumn("k", F.col("k").cast(n.schema["n_nationkey"].dataType))).write.partitionBy("k").text(root)
    got = formats.records(spark, f"{root}/*/*.txt").where("size(fields) > 0 AND body = 'Body: of the record'")
    return got.select(F.col("fields.nation").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("fields.name").alias("n_name"), F.col("fields.region").cast("int").alias("r"))


@query("SELECT r_regionkey::int AS id, r_name AS name, 'weekly' AS schedule FROM region")
def sc07_registry(spark: SparkSession, d: str) -> DataFrame:
    """A YAML list of questions, a small file as registries are."""
    root = scratch(spark)
    entry = F.concat(F.lit("  - id: "), F.col("r_regionkey").cast("string"), F.lit("\n    name: \""), "r_name", F.lit("\"\n    schedule: weekly\n"))
    text = table(spark, d, "region").agg(F.concat(F.lit("questions:\n"), F.concat_ws("", F.collect_list(entry))).alias("text"))
    put_files(spark, root, text.select(F.lit("registry.yaml"), F.encode("text", "UTF-8")))
    return formats.registry(spark, f"{root}/registry.yaml", "id int, name string, schedule string")


@query("WITH m AS (SELECT date_trunc('month', l_shipdate)::date AS date, v.y, sum(l_quantity) AS value FROM lineitem, (SELECT unnest(range(1996, 2003)) AS y) v WHERE l_linenumber <= v.y - 1995 AND year(l_shipdate) < v.y GROUP BY ALL) SELECT date, make_date(y, 1, 31) AS realtime_start, value, lead(make_date(y, 1, 31)) OVER (PARTITION BY date ORDER BY y) - 1 AS realtime_end FROM m")
def sc12_wide_vintages(spark: SparkSession, d: str) -> DataFrame:
    """A CSV with one column per vintage (SERIES_YYYYMMDD) back to observations with the period each stood; a dot is no value.

    The vintage of January of a year knows the months before that year, from more lines each year.
    """
    root = f"{scratch(spark)}/wide"
    li = table(spark, d, "lineitem").withColumn("date", F.to_date(F.date_trunc("month", "l_shipdate")))
    known = lambda y: F.sum(F.when((F.col("l_linenumber") <= y - 1995) & (F.year("l_shipdate") < y), F.col("l_quantity")))
    wide = li.groupBy("date").agg(*(F.coalesce(known(y).cast("string"), F.lit(".")).alias(f"QTY_{y}0131") for y in range(1996, 2003)))
    wide.write.option("header", True).csv(root)
    got = formats.vintages(spark.read.option("header", True).csv(root), "QTY")
    return got.select(F.to_date("date").alias("date"), "realtime_start", "value", "realtime_end")


@query("SELECT n_regionkey::bigint AS region, n_name, n_nationkey::double AS key FROM nation")
def sc14_workbook(spark: SparkSession, d: str) -> DataFrame:
    """A workbook per region, written and read by cells."""
    import pandas as pd

    root = scratch(spark)

    def booked(part: pd.DataFrame) -> pd.DataFrame:
        rows = [["name", None, "key"]] + [[r.n_name, None, int(r.n_nationkey)] for r in part.itertuples()]
        return pd.DataFrame({"name": [f"{part['n_regionkey'].iloc[0]}.xlsx"], "content": [formats.workbook_bytes(rows)]})

    put_files(spark, root, table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(booked, "name string, content binary"))
    cells = formats.workbook(spark, f"{root}/*.xlsx").where("row > 0")
    return cells.select(F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("long").alias("region"), F.col("cells")[0].alias("n_name"), F.col("cells")[2].cast("double").alias("key"))


@query("""WITH f AS (SELECT o_custkey AS cik, strftime(o_orderdate, '%Y-01-01') AS start, strftime(o_orderdate, '%Y-12-31') AS "end", o_totalprice AS val, CASE o_orderstatus WHEN 'O' THEN '10-Q' WHEN 'F' THEN '10-K' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, printf('%012d', o_orderkey) AS accn FROM orders),
    l AS (SELECT cik, start, "end", arg_max(val, (filed, accn)) AS val, arg_max(form, (filed, accn)) AS form, max(filed) AS filed FROM f WHERE form <> '8-K' AND filed <= '2000-06-30' GROUP BY ALL) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC) <= 3""")
def sc19_company_facts(spark: SparkSession, d: str) -> DataFrame:
    """Nested facts per filer as one JSON document each: forms, what was filed by a day, last revision, last periods."""
    o = table(spark, d, "orders")
    day = lambda pattern: F.date_format("o_orderdate", pattern)
    unit = F.struct(day("yyyy-01-01").alias("start"), day("yyyy-12-31").alias("end"), F.col("o_totalprice").alias("val"), F.when(F.col("o_orderstatus") == "O", "10-Q").when(F.col("o_orderstatus") == "F", "10-K").otherwise("8-K").alias("form"), day("yyyy-MM-dd").alias("filed"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accn"))
    root = f"{scratch(spark)}/facts"
    o.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(unit).alias("u")).select(F.to_json(F.struct("cik", F.struct(F.col("u").alias("USD")).alias("units"))).alias("value")).write.text(root)
    return formats.company_facts(spark.read.text(root), "value", as_of="2000-06-30", keep=3)


@query("SELECT r_name AS era, strftime(m, '%Y-%m') AS month, k FROM (SELECT r_name, unnest(range(make_date(1995 + r_regionkey::int, 1, 1)::timestamp, make_date(1997 + r_regionkey::int, 12, 1)::timestamp + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m, generate_subscripts(range(make_date(1995 + r_regionkey::int, 1, 1)::timestamp, make_date(1997 + r_regionkey::int, 12, 1)::timestamp + INTERVAL 1 DAY, INTERVAL 1 MONTH), 1) - 1 AS k FROM region)")
def sc22_alignment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Eras from a seed file, each with its months numbered from its anchor."""
    root = f"{scratch(spark)}/seed"
    first = F.col("r_regionkey").cast("int") + 1995
    table(spark, d, "region").select(F.col("r_name").alias("era"), F.make_date(first, F.lit(1), F.lit(1)).alias("anchor"), F.make_date(first + 2, F.lit(12), F.lit(1)).alias("last")).write.option("header", True).csv(root)
    eras = formats.seed_csv(spark, root, "era string, anchor date, last date")
    return eras.select("era", F.posexplode(F.expr("sequence(anchor, last, INTERVAL 1 MONTH)")).alias("k", "m")).select("era", F.date_format("m", "yyyy-MM").alias("month"), F.col("k").cast("long").alias("k"))


# ---- weights of components, which need no file --------------------------------------------------


@query("SELECT engine, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT engine, least(0.75, greatest(0.25, 1 / avg(abs(fin - 100)) / max(t))) AS w FROM (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL), (SELECT sum(1 / m) AS t FROM (SELECT avg(abs(fin - 100)) AS m FROM (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) GROUP BY engine)) GROUP BY engine)")
def fm05_ensemble_weights(spark: SparkSession, d: str) -> DataFrame:
    """Inverse mean loss per engine, kept between bounds, summing to one."""
    loss = V.paths(spark, d).groupBy("path_id", "engine").agg(F.max_by("level", "step").alias("fin")).groupBy("engine").agg((1 / F.avg(F.abs(F.col("fin") - 100))).alias("i"))
    every = Window.partitionBy(F.lit(1))  # a row per engine
    w = loss.select("engine", F.least(F.lit(0.75), F.greatest(F.lit(0.25), F.col("i") / F.sum("i").over(every))).alias("w"))
    return w.select("engine", r6(F.col("w") / F.sum("w").over(every)).alias("weight"))


@query("SELECT engine, round(CASE WHEN engine = 0 THEN 0.35 + 0.65 * s ELSE 0.65 * s END, 6) AS weight FROM (SELECT engine, CASE WHEN m > a THEN 0 ELSE exp(-m) END / sum(CASE WHEN m > a THEN 0 ELSE exp(-m) END) OVER () AS s FROM (SELECT engine, round(avg(abs(fin - 100)), 9) AS m FROM (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) GROUP BY 1), (SELECT round(avg(abs(fin - 100)), 9) AS a FROM (SELECT path_id, engine, arg_max(level, step) AS fin FROM v_paths GROUP BY ALL) WHERE engine = 0))")
def fm14_constrained_stacking(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of the losses; none for components worse than the anchor (engine 0), which keeps its floor."""
    m = V.paths(spark, d).groupBy("path_id", "engine").agg(F.max_by("level", "step").alias("fin")).groupBy("engine").agg(F.round(F.avg(F.abs(F.col("fin") - 100)), 9).alias("m"))
    every = Window.partitionBy(F.lit(1))  # a row per engine
    anchor = F.max(F.when(F.col("engine") == 0, F.col("m"))).over(every)
    raw = m.withColumn("e", F.when(F.col("m") > anchor, 0.0).otherwise(F.exp(-F.col("m"))))
    share = raw.withColumn("s", F.col("e") / F.sum("e").over(every))
    return share.select("engine", r6(F.when(F.col("engine") == 0, 0.35 + 0.65 * F.col("s")).otherwise(0.65 * F.col("s"))).alias("weight"))
