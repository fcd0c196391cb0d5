"""The data problems in this project's terms: queries over its tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_US, day_number, decimal_key, folded, instant_us, utc_text
from tidemark.operators import diff, late_events
from tidemark.operators.history import bitmap_history, connected
from tidemark.operators.known_at import NEVER, known_at
from tidemark.operators.nearest import nearest_in_time
from tidemark.operators.regrid import period_number, regrid
from tidemark.operators.spikes import SPIKE, implausible
from tidemark.plans.tables import table
from tidemark.session import cut_lineage

SLACK_US = 10 * DAY_US


# ---- 1: differences between two copies -------------------------------------------------


def _differences(spark: SparkSession, folder: str) -> DataFrame:
    quotes = diff.diff_copies(
        table(spark, folder, "yahoo_crosscheck"), table(spark, folder, "yahoo_mirror"),
        keys={"symbol": F.upper(F.trim("symbol")), "us": instant_us(F.col("observation_time")), "unread": F.when(instant_us(F.col("observation_time")).isNull(), F.col("observation_time"))},
        fields={"close": ("close", diff.within(0.00005))},
    )
    observed = diff.diff_copies(
        table(spark, folder, "source_observation"), table(spark, folder, "source_observation_copy"),
        keys={"key_1": "question_id", "key_2": "slot"},
        fields={"actual": (decimal_key(F.col("actual")), diff.SAME), "source": (folded(F.col("source")), diff.SAME), "reference": (decimal_key(F.col("reference")), diff.SAME)},
    )
    values = ("finding", "main_value", "copy_value")
    return quotes.select(F.lit("yahoo_crosscheck").alias("dataset"), F.col("symbol").alias("key_1"), F.coalesce(utc_text(F.col("us")), "unread").alias("key_2"), *values).unionByName(
        observed.select(F.lit("source_observation").alias("dataset"), "key_1", "key_2", *values)
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _differences(spark, folder).select("dataset", "key_1", "key_2", "finding")


def p1_summary(spark: SparkSession, folder: str) -> DataFrame:
    return diff.summarise(_differences(spark, folder))


# ---- 2: late and out-of-order events ----------------------------------------------------


def _replayed(spark: SparkSession, folder: str) -> DataFrame:
    """A delivery arrives when its receipt says; the fact's own time counts where there is no such receipt."""
    told = table(spark, folder, "event_fact").select("event_id", "event_type", instant_us(F.col("scheduled_at")).alias("event_us"), instant_us(F.col("retrieved_at")).alias("told_us"), "actual", "receipt_id")
    receipts = table(spark, folder, "raw_time_series_receipt").select("receipt_id", instant_us(F.col("retrieved_at")).alias("received_us")).groupBy("receipt_id").agg(F.min("received_us").alias("received_us"))
    facts = told.join(receipts, "receipt_id", "left").withColumn("arrival_us", F.coalesce("received_us", "told_us"))
    return late_events.kslack_replay(facts, id="event_id", category="event_type", event_us="event_us", arrival_us="arrival_us", value="actual", slack_us=SLACK_US, all_fates=False)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return late_events.fates(_replayed(spark, folder), "event_id").where(F.col("fate") != late_events.ON_TIME).select("event_id", "fate")


def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    final = late_events.periods(_replayed(spark, folder))
    return final.select(F.col("category").alias("event_type"), F.date_from_unix_date("day").cast("string").alias("day"), "n", F.col("n_value").alias("n_actual"), F.round("mean", 10).alias("mean_actual"))


def p2_provisional(spark: SparkSession, folder: str) -> DataFrame:
    """The values published while a period's buffer was still open, with the moment of publishing."""
    shown = late_events.provisional(_replayed(spark, folder))
    return shown.select(F.col("category").alias("event_type"), F.date_from_unix_date("day").cast("string").alias("day"), utc_text(F.col("at_us")).alias("published_at"), "n", F.col("n_value").alias("n_actual"), F.round("mean", 10).alias("mean_actual"))


# ---- 3: attributes as known at event time ----------------------------------------------


def _new_york_tick(us: F.Column) -> F.Column:
    """The New York date of an instant, a day beginning at 08:30 there."""
    wall = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), "America/New_York"))
    return F.floor((wall - F.lit(8 * 3_600_000_000 + 30 * 60_000_000)) / F.lit(DAY_US))


def _vintages(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of alfred with a value: what was observed, from which day to which it stood."""
    end = day_number(F.col("realtime_end"))
    return table(spark, folder, "alfred").where("value IS NOT NULL").select(
        "series_id", "alfred_id", "value", day_number(F.col("observation_time")).alias("observed"), day_number(F.col("realtime_start")).alias("since"),
        F.when(F.substring(F.trim("realtime_end"), 1, 4) == "9999", None).otherwise(end).alias("until"),
    )


def _known(spark: SparkSession, folder: str, *wide: str) -> DataFrame:
    facts = table(spark, folder, "event_fact").select("event_id", "receipt_id", instant_us(F.col("available_at")).alias("us")).where("receipt_id IS NOT NULL AND us IS NOT NULL")
    receipts = table(spark, folder, "raw_time_series_receipt").select("receipt_id", F.col("series_id").alias("entity")).where("receipt_id IS NOT NULL AND entity IS NOT NULL").distinct()
    asked = facts.join(receipts, "receipt_id").select("entity", _new_york_tick(F.col("us")).alias("tick"), F.col("event_id").alias("id")).distinct()
    v = _vintages(spark, folder)
    versions = v.select(F.col("series_id").alias("entity"), F.col("since").alias("lo"), F.coalesce(F.col("until") + 1, F.lit(NEVER)).alias("hi"), F.col("observed").alias("rank_1"), F.col("since").alias("rank_2"), F.col("alfred_id").alias("version"))
    attributes = v.select(F.col("alfred_id").alias("version"), "value", F.date_from_unix_date("observed").cast("string").alias("observation_date")) if wide else None
    return known_at(asked, versions, wide=attributes)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _known(spark, folder).select(F.col("id").alias("event_id"), F.col("version").alias("alfred_id"))


def p3_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return _known(spark, folder, "value").select(F.col("id").alias("event_id"), F.col("entity").alias("series_id"), F.col("version").alias("alfred_id"), "observation_date", "value")


# ---- 4: matching records by nearest time --------------------------------------------------


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "series_map")
    quotes = table(spark, folder, "yahoo_crosscheck").where("close IS NOT NULL").select("symbol", instant_us(F.col("observation_time")).alias("us"), "yahoo_id").join(named.select("symbol", "series_id"), "symbol")
    readings = table(spark, folder, "nyfed_markets").where("value IS NOT NULL").select("series_id", instant_us(F.col("observation_time")).alias("us"), "nyfed_id")
    return nearest_in_time(quotes, readings, key="series_id", time="us", left_id="yahoo_id", right_id="nyfed_id", tolerance_us=90_000_000)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder).select("yahoo_id", "nyfed_id")


# ---- 5: history of changing attributes --------------------------------------------------

FACT_VALUES = ("consensus", "model_nowcast", "policy_relief", "actual", "outcome_return_5d")


def _releases(spark: SparkSession, folder: str) -> DataFrame:
    """Each event_id once, with the release that it belongs to."""
    us = lambda c: instant_us(F.col(c))
    facts = table(spark, folder, "event_fact").select(
        "event_id", "supersedes", F.concat_ws("\u0001", F.coalesce("source_id", F.lit("\u0002")), F.coalesce("event_type", F.lit("\u0002")), F.coalesce(us("scheduled_at").cast("string"), F.col("scheduled_at"), F.lit("\u0002"))).alias("slot"),
        us("scheduled_at").alias("scheduled_us"), us("available_at").alias("available_us"), "revision_seq", "unit", *((F.col(c) + F.lit(0.0)).alias(c) for c in FACT_VALUES),
    )
    # read by both sides of the links and once more below
    once = cut_lineage(facts.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.struct(*(c for c in facts.columns if c != "event_id"))).alias("r")).select("event_id", "r.*"))
    links = once.where("supersedes IS NOT NULL").select("supersedes", F.col("slot").alias("a")).join(once.select(F.col("event_id").alias("supersedes"), F.col("slot").alias("b")), "supersedes").where("a != b").select("a", "b").distinct()
    merged = connected(links).withColumnRenamed("node", "slot")
    return once.join(merged, "slot", "left").withColumn("release", F.coalesce("root", "slot")).drop("root", "slot")


def _fact_history(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    facts = _releases(spark, folder).where("revision_seq IS NOT NULL AND available_us IS NOT NULL")
    # the earliest that is known of a higher revision, from one row per release and revision
    steps = facts.groupBy("release", "revision_seq").agg(F.min("available_us").alias("known_us"))
    higher = Window.partitionBy("release").orderBy(F.col("revision_seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = steps.select("release", "revision_seq", F.min("known_us").over(higher).alias("end_us"))
    valid = facts.join(ends, ["release", "revision_seq"]).where("end_us IS NULL OR end_us > available_us")
    return bitmap_history(valid, entity=["release"], snapshot="revision_seq", attributes=F.struct("scheduled_us", *FACT_VALUES, "unit"), key="event_id", start="available_us")


def _macro_history(spark: SparkSession, folder: str) -> DataFrame:
    v = _vintages(spark, folder).withColumn("value", F.col("value") + F.lit(0.0))
    return bitmap_history(v, entity=["series_id", "observed"], snapshot="since", attributes=F.struct("value"), key="alfred_id", start="since")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    facts = _fact_history(spark, folder).where("versions > 1").select(F.lit("event_fact").alias("dataset"), F.col("version_key"), utc_text(F.col("valid_from")).alias("valid_from"), F.coalesce(utc_text(F.col("valid_to")), F.lit("9999-12-31 00:00:00")).alias("valid_to"))
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int")).cast("string")
    macro = _macro_history(spark, folder).where("versions > 1").select(F.lit("alfred").alias("dataset"), F.col("version_key").cast("string").alias("version_key"), day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("9999-12-31")).alias("valid_to"))
    return facts.unionByName(macro)


# ---- 6: implausible spikes --------------------------------------------------------------


def _faults(spark: SparkSession, folder: str) -> DataFrame:
    quotes = table(spark, folder, "yahoo_crosscheck").select(F.lit("yahoo_crosscheck").alias("dataset"), F.col("symbol").alias("source"), instant_us(F.col("observation_time")).alias("moment"), F.lit(0).alias("rank"), F.col("yahoo_id").alias("row_id"), F.col("close").alias("value"))
    macro = table(spark, folder, "alfred").select(F.lit("alfred").alias("dataset"), F.col("series_id").alias("source"), day_number(F.col("observation_time")).cast("long").alias("moment"), day_number(F.col("realtime_start")).alias("rank"), F.col("alfred_id").alias("row_id"), "value")
    return implausible(quotes.unionByName(macro))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _faults(spark, folder).select("dataset", "row_id").distinct()


def p6_run_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The faults that SQL can tell too: impossible readings and stuck runs, with their kind."""
    return _faults(spark, folder).where(F.col("fault") != SPIKE).select("dataset", "row_id", "fault")


# ---- 7: readings onto a regular grid ------------------------------------------------------


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "alfred").where("value IS NOT NULL").select("series_id", "alfred_id", "observation_time", "realtime_start", "value").join(table(spark, folder, "series_catalog").select("series_id", "frequency"), "series_id")
    observed = day_number(F.col("observation_time"))
    readings = known.select(F.col("series_id").alias("entity"), "frequency", period_number(observed, F.col("frequency")).alias("period"), F.struct(observed.alias("observed"), day_number(F.col("realtime_start")).alias("since"), "alfred_id").alias("rank"), "value")
    return regrid(readings)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where("missing").select(F.col("entity").alias("series_id"), F.col("period_start").cast("string").alias("period_start"))


def p7_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).select(F.col("entity").alias("series_id"), F.col("period_start").cast("string").alias("period_start"), "value", "missing")


QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p2_found, p2_periods, p2_provisional, p3_found, p3_attributes, p4_found, p5_found, p6_found, p6_run_faults, p7_found, p7_grid)}
