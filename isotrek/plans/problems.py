"""The pN_ queries of the general operators (problems 1, 3, 4, 5, 6) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrek.functions.values import decimal_between, digits_only, key, real_day, day_text, strip
from isotrek.operators.intervals import periods_and_gaps
from isotrek.operators.orphans import Reference, orphan_cascade, orphan_report
from isotrek.operators.proximity import near_pairs, points_in_zones
from isotrek.operators.records import LOADED, faulty_lines, faulty_values, readable_lines
from isotrek.operators.timestamps import change_day_rows, normalise_timestamps
from isotrek.session import keep, table

WALK_REACH_M = 150.0
REFERENCES = [
    Reference("trips", "route_id", "trip_id", "routes", "route_id", "feed_day"),
    Reference("stop_times", "trip_id", "st_id", "trips", "trip_id", "feed_day"),
    Reference("stop_times", "stop_id", "st_id", "stops", "stop_id", "feed_day"),
]


def trip_zones(spark: SparkSession, d: str) -> DataFrame:
    """(trip_id, zone): the time zone of the agency of each trip's route."""
    agencies = table(spark, d, "agency").select(key("agency_id").alias("agency_id"), key("agency_timezone").alias("zone")).dropna().distinct()
    routes = table(spark, d, "routes").select(key("route_id").alias("route_id"), key("agency_id").alias("agency_id")).dropna().distinct()
    trips = table(spark, d, "trips").select(key("trip_id").alias("trip_id"), key("route_id").alias("route_id")).dropna().distinct()
    return trips.join(routes.join(agencies, "agency_id").select("route_id", "zone").distinct(), "route_id").select("trip_id", "zone").distinct()


def stop_time_values(spark: SparkSession, d: str) -> DataFrame:
    """(st_id, trip_id, feed_day, field, value, plain): every non-blank time of stop_times; plain: written [H]H:MM:SS."""
    fields = [F.struct(F.lit(f).alias("field"), key(f).alias("value")) for f in ("arrival_time", "departure_time")]
    rows = table(spark, d, "stop_times").select("st_id", key("trip_id").alias("trip_id"), strip("feed_day").alias("feed_day"), F.explode(F.array(*fields)).alias("v"))
    return rows.select("st_id", "trip_id", "feed_day", "v.field", "v.value").filter("value is not null and trip_id is not null").withColumn("plain", F.col("value").rlike("^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    zones = trip_zones(spark, d)
    # bounded by the zones and changes that the time zone database has
    names = [r[0] for r in table(spark, d, "agency").select(key("agency_timezone")).dropna().distinct().collect()]
    changes = spark.createDataFrame(change_day_rows(names), "zone string, feed_day string")
    days = changes.select("feed_day").distinct().withColumn("some_change", F.lit(True))
    values = stop_time_values(spark, d).join(F.broadcast(days), "feed_day", "left").filter("not plain or some_change")
    cases = (
        values.join(zones, "trip_id")
        .join(F.broadcast(changes.withColumn("change", F.lit(True))), ["zone", "feed_day"], "left")
        .filter("not plain or change")
        .select("st_id", "field", "value", "zone", "feed_day")
    )
    return normalise_timestamps(cases, "value", "zone", "feed_day").filter("utc_epoch is not null").select("st_id", "field", "utc_epoch").distinct()


def p1_masks(spark: SparkSession, d: str) -> DataFrame:
    """Profile: how many times of stop_times have each shape (digits 9, letters A)."""
    mask = F.translate(F.col("value"), "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "A" * 52)
    return stop_time_values(spark, d).groupBy("field", mask.alias("mask")).agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stops, times, calendar = (table(spark, d, t) for t in ("stops", "stop_times", "calendar"))
    typed = [
        faulty_values(stops, "stops", strip("stop_id"), decimal_between(F.col("stop_lat"), -90, 90).isNotNull()),
        faulty_values(times, "stop_times", F.col("st_id"), digits_only(F.col("stop_sequence"))),
        faulty_values(calendar, "calendar", F.col("cal_id"), real_day(F.col("start_date")).isNotNull()),
    ]
    lines = faulty_lines(table(spark, d, "raw_lines")).select(F.lit("raw_lines").alias("src"), F.col("line_id").cast("string").alias("rec_key"), "reason")
    return typed[0].unionByName(typed[1]).unionByName(typed[2]).unionByName(lines).distinct()


def p3_located(spark: SparkSession, d: str) -> DataFrame:
    """Where in its record each fault of raw_lines was met."""
    return faulty_lines(table(spark, d, "raw_lines"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The records of raw_lines that can be read, typed; the columns of other files are null."""
    parts = []
    for base, columns in LOADED.items():
        shown = {"day": lambda c: F.col(c).cast("string"), "number": F.col}
        parts.append(readable_lines(table(spark, d, "raw_lines"), base).select(F.lit(base).alias("src"), "line_id", *(shown.get(k, F.col)(c).alias(c) for c, k in columns.items())))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def placed_stops(spark: SparkSession, d: str) -> DataFrame:
    """(key, lat, lon) of the stops with a readable position."""
    stops = table(spark, d, "stops")
    return stops.select(key("stop_id").alias("key"), decimal_between(F.col("stop_lat"), -90, 90).alias("lat"), decimal_between(F.col("stop_lon"), -180, 180).alias("lon")).dropna()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    stops = keep(placed_stops(spark, d).distinct())  # read and parsed once for both kinds
    near = near_pairs(stops, WALK_REACH_M, repeated=False).select(F.lit("near").alias("kind"), "key_a", "key_b")
    held = points_in_zones(stops, table(spark, d, "zones"), repeated=False).select(F.lit("zone").alias("kind"), F.col("key").alias("key_a"), F.col("zone_id").alias("key_b"))
    return near.unionByName(held)


def _feed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("stops", "routes", "trips", "stop_times")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct kinds of the cascade."""
    return orphan_cascade(_feed(spark, d), REFERENCES).filter("level = 0").drop("level")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, field, month and kind."""
    return orphan_report(orphan_cascade(_feed(spark, d), REFERENCES))


def service_intervals(spark: SparkSession, d: str) -> DataFrame:
    """(entity, kind, first, last): what adds days to a service and what cuts them."""
    calendar = table(spark, d, "calendar").select(key("service_id").alias("entity"), F.lit("add").alias("kind"), real_day(F.col("start_date")).alias("first"), real_day(F.col("end_date")).alias("last"))
    dates = table(spark, d, "calendar_dates").select("cd_id", key("service_id").alias("entity"), real_day(F.col("date")).alias("day"), strip("exception_type").alias("type"))
    last = lambda kind: F.max(F.when(F.col("type") == kind, F.col("cd_id")))
    decided = dates.filter("type in ('1', '2') and day is not null").groupBy("entity", "day").agg(last("1").alias("added"), last("2").alias("removed"))
    kind = F.when(F.col("removed").isNull() | (F.col("added") > F.col("removed")), "add").otherwise("cut")
    exceptions = decided.select("entity", kind.alias("kind"), F.col("day").alias("first"), F.col("day").alias("last"))
    return calendar.unionByName(exceptions)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = periods_and_gaps(service_intervals(spark, d))
    return found.select(F.col("entity").alias("service_id"), "kind", day_text(F.col("first")).alias("first_day"), day_text(F.col("last")).alias("last_day"))


QUERIES = {f.__name__: f for f in (p1_found, p1_masks, p3_found, p3_located, p3_loaded, p4_found, p5_found, p5_report, p6_found)}
