"""Service days: which services run on which day, and which day stands for the timetable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.functions.values import key, real_day, strip

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
BUSIEST_SHARE = 0.92


WEEKS = 8  # of a block, which begins on a Monday and has a bit for each day
_DAYS = 7 * WEEKS


def calendar_blocks(calendar: DataFrame) -> DataFrame:
    """(service_id, block, mask): the running days of every calendar row as bits, a row for each block of eight weeks that it touches; unreadable or reversed dates give none."""
    week = sum((F.when(strip(c) == "1", F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(WEEKDAYS)), F.lit(0).cast("long"))
    rows = calendar.select(key("service_id").alias("service_id"), (real_day(F.col("start_date")) + 3).alias("a"), (real_day(F.col("end_date")) + 3).alias("b"), week.alias("week"))  # 3: from a Monday on
    rows = rows.filter("service_id is not null and a <= b and week <> 0")
    blocks = rows.withColumn("block", F.explode(F.expr(f"sequence(cast(floor(a / {_DAYS}) as int), cast(floor(b / {_DAYS}) as int))")))
    every = sum(1 << 7 * i for i in range(WEEKS))
    first, last = f"greatest(a - block * {_DAYS}, 0)", f"least(b - block * {_DAYS}, {_DAYS - 1})"
    within = f"(shiftleft(1L, cast({last} + 1 as int)) - shiftleft(1L, cast({first} as int)))"
    return blocks.select("service_id", "block", F.expr(f"(week * {every}L) & {within}").alias("mask")).filter("mask <> 0")


def service_blocks(calendar: DataFrame, calendar_dates: DataFrame, row_order: str, other_types_remove: bool = False) -> DataFrame:
    """(service_id, block, mask): service_days as bits, a row for each service and block of eight weeks.

    Exceptions are decided by service and day first; then bits meet in one aggregation, which is combined
    before the shuffle, so that no row is made of a single day.
    """
    kind = strip("exception_type")
    rows = calendar_dates.select(key("service_id").alias("service_id"), (real_day(F.col("date")) + 3).alias("d"), kind.alias("kind"), F.col(row_order).cast("long").alias("_row"))
    rows = rows.filter("service_id is not null and d is not null")
    rows = rows if other_types_remove else rows.filter("kind in ('1', '2')")
    adds = F.coalesce(F.col("kind") == "1", F.lit(False))
    last = rows.groupBy("service_id", "d").agg(F.max(F.when(adds, F.col("_row"))).alias("_add"), F.max(F.when(~adds, F.col("_row"))).alias("_cut"))
    bit, on = f"shiftleft(1L, cast(pmod(d, {_DAYS}) as int))", "(_add is not null and (_cut is null or _add > _cut))"
    exceptions = last.filter("_add is not null or _cut is not null").selectExpr(
        "service_id", f"cast(floor(d / {_DAYS}) as int) as block", "0L as mask", f"case when {on} then {bit} else 0L end as _add", f"case when {on} then 0L else {bit} end as _cut")
    whole = calendar_blocks(calendar).selectExpr("service_id", "block", "mask", "0L as _add", "0L as _cut").unionByName(exceptions)
    met = whole.groupBy("service_id", "block").agg(*(F.bit_or(c).alias(c) for c in ("mask", "_add", "_cut")))
    return met.selectExpr("service_id", "block", "(mask & ~_cut) | _add as mask").filter("mask <> 0")


def days_of_blocks(blocks: DataFrame) -> DataFrame:
    """The rows of blocks (.., block, mask), one for each day whose bit is set: (.., day)."""
    days = F.expr(f"transform(filter(sequence(0, {_DAYS - 1}), i -> (shiftright(mask, i) & 1L) = 1L), i -> date_from_unix_date(block * {_DAYS} + i - 3))")
    return blocks.withColumn("day", F.explode(days)).drop("block", "mask")


def service_days(calendar: DataFrame, calendar_dates: DataFrame, row_order: str, other_types_remove: bool = False) -> DataFrame:
    """(service_id, day) that runs: calendar days plus additions less removals; of several exceptions for a service and day the last row decides.

    ``row_order`` numbers the exception rows. Types other than 1 and 2 are ignored, or remove if
    ``other_types_remove`` (the second rule set). Dates that name no day count for nothing.
    """
    return days_of_blocks(service_blocks(calendar, calendar_dates, row_order, other_types_remove))


def _each_day(days: DataFrame) -> DataFrame:
    return days_of_blocks(days) if "mask" in days.columns else days


def services_on(days: DataFrame, day: Column) -> DataFrame:
    """(service_id) running on one day; empty if none does."""
    return days.filter(F.col("day") == day).select("service_id").distinct()


def feed_validity(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """(valid_from, valid_to), one row: smallest and largest date among calendar bounds and added dates; flags and removals do not matter."""
    bounds = calendar.select(F.explode(F.array(real_day(F.col("start_date")), real_day(F.col("end_date")))).alias("d"))
    added = calendar_dates.filter(strip("exception_type") == "1").select(real_day(F.col("date")).alias("d"))
    return bounds.unionByName(added).agg(F.date_from_unix_date(F.min("d")).alias("valid_from"), F.date_from_unix_date(F.max("d")).alias("valid_to"))


def trips_per_service(trips: DataFrame) -> DataFrame:
    return trips.groupBy(key("service_id").alias("service_id")).agg(F.count("*").alias("trips"))


def day_volumes(days: DataFrame, trips: DataFrame, weekdays: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(day, volume): trips on each day of the given weekdays (Monday 0) that has any; days may be those of service_blocks, which meet the trips before they become rows."""
    per_service = trips_per_service(trips)
    if "mask" in days.columns:
        wanted = sum(1 << 7 * i + w for i in range(WEEKS) for w in weekdays)
        days = days.withColumn("mask", F.col("mask").bitwiseAND(F.lit(wanted).cast("long"))).filter("mask <> 0")
    met = _each_day(days.join(per_service, "service_id"))
    return met.filter(F.weekday("day").isin(*weekdays)).groupBy("day").agg(F.sum("trips").alias("volume"))


def reference_day(days: DataFrame, trips: DataFrame, today: Column) -> DataFrame:
    """(day), one row or none: the earliest near-busiest Tuesday to Thursday from today on, else among all of them."""
    volumes = day_volumes(days, trips)
    marked = volumes.withColumn("ahead", F.max((F.col("day") >= today).cast("int")).over(Window.partitionBy()))
    pool = marked.filter((F.col("ahead") == 0) | (F.col("day") >= today))
    busy = pool.withColumn("busiest", F.max("volume").over(Window.partitionBy()))
    return busy.filter(F.col("volume") >= BUSIEST_SHARE * F.col("busiest")).agg(F.min("day").alias("day")).filter("day is not null")


def typical_day(days: DataFrame, trips: DataFrame, horizon: int = 60, enough: int = 4, since: Column | None = None) -> DataFrame:
    """(day), one row or none, by the second rule set: the first day that has the commonest set of services.

    Only near-busiest Tuesdays and Thursdays count, within ``horizon`` days of the first of them if at
    least ``enough`` lie there. Of equally common sets the one seen first wins. ``since``: the first
    day that counts at all. The days in question, at most one row a date, are broadcast.
    """
    volumes = day_volumes(days, trips, (1, 3))
    volumes = volumes if since is None else volumes.filter(F.col("day") >= since)
    everywhere = Window.partitionBy()
    near = volumes.withColumn("busiest", F.max("volume").over(everywhere)).filter(F.col("volume") >= BUSIEST_SHARE * F.col("busiest"))
    near = near.withColumn("first", F.min("day").over(everywhere)).withColumn("soon", F.datediff("day", "first") <= horizon)
    near = near.withColumn("soon_days", F.sum(F.col("soon").cast("int")).over(everywhere)).filter((F.col("soon_days") < enough) | F.col("soon"))
    sets = _each_day(days).join(F.broadcast(near.select("day")), "day").groupBy("day").agg(F.array_sort(F.collect_set("service_id")).alias("services"))
    counted = sets.groupBy("services").agg(F.count("*").alias("n"), F.min("day").alias("day"))
    return counted.orderBy(F.desc("n"), F.asc("day")).limit(1).select("day")


def next_service_saturday(days: DataFrame, today: Column) -> DataFrame:
    """(day): the first Saturday from today on on which anything runs."""
    return days.filter((F.weekday("day") == 5) & (F.col("day") >= today)).agg(F.min("day").alias("day")).filter("day is not null")
