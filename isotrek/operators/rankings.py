"""Timetable rankings: busiest station, peak frequency, end-to-end time, first and last passages, published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.operators.network import clock_text

DAY_START, DAY = 3 * 3600 + 1800, 86_400


def boardable(stop_times: DataFrame, trip: str = "trip_id", order: list[str] = ("seq",)) -> DataFrame:
    """Departures one can board: every stop of a trip but its last, where boarding is allowed (pickup_type other than 1)."""
    along = Window.partitionBy(trip).orderBy(*(F.desc(c) for c in order))
    marked = stop_times.withColumn("_from_end", F.row_number().over(along))
    return marked.filter((F.col("_from_end") > 1) & (F.coalesce(F.col("pickup_type"), F.lit("0")) != "1")).drop("_from_end")


def transport_day(day: DataFrame, before: DataFrame, after: DataFrame, seconds: str = "dep", start: int = DAY_START) -> DataFrame:
    """Departures of one transport day: those of the service day and of the ones beside it that fall between ``start`` and 24 hours later."""
    shifted = [df.withColumn(seconds, F.col(seconds) + shift) for df, shift in ((day, 0), (before, -DAY), (after, DAY))]
    whole = shifted[0].unionByName(shifted[1]).unionByName(shifted[2])
    return whole.filter((F.col(seconds) >= start) & (F.col(seconds) < start + DAY))


def first_and_last(departures: DataFrame, keys: list[str], line: str, seconds: str = "dep") -> DataFrame:
    """(keys.., first_seconds, first_line, last_seconds, last_line, first_time, last_time); the smaller line of equal times."""
    ends = departures.groupBy(*keys).agg(F.min(F.struct(seconds, line)).alias("a"), F.max(F.struct(F.col(seconds).alias("s"))).alias("b"))
    last_line = departures.join(ends.select(*keys, F.col("b.s").alias("_s")), keys).filter(F.col(seconds) == F.col("_s")).groupBy(*keys).agg(F.min(line).alias("last_line"))
    joined = ends.join(last_line, keys)
    a, b = F.col(f"a.{seconds}"), F.col("b.s")
    return joined.select(*keys, a.alias("first_seconds"), F.col(f"a.{line}").alias("first_line"), b.alias("last_seconds"), "last_line", clock_text(a).alias("first_time"), clock_text(b).alias("last_time"))


def busiest(departures: DataFrame, station: str) -> DataFrame:
    """(station, tied, passages), one row: the station of most passages; equally busy ones are listed and none is named."""
    counted = departures.groupBy(F.col(station).alias("station")).agg(F.count("*").alias("passages"))
    most = counted.agg(F.max("passages").alias("passages"))
    top = counted.join(F.broadcast(most), "passages")  # one row
    listed = top.groupBy("passages").agg(F.array_sort(F.collect_list("station")).alias("all"))
    single = F.size("all") == 1
    return listed.select(F.when(single, F.element_at("all", 1)).alias("station"), F.when(single, F.array().cast("array<string>")).otherwise(F.col("all").cast("array<string>")).alias("tied"), "passages")


def peak_headway(departures: DataFrame, line: list[str], at: list[str], seconds: str, start: int, end: int) -> DataFrame:
    """(line.., peak_passages, peak_headway): most passages in [start, end) at one stop and direction of a line; headway in minutes to 1 decimal."""
    inside = departures.filter((F.col(seconds) >= start) & (F.col(seconds) < end))
    most = inside.groupBy(*line, *at).agg(F.count("*").alias("n")).groupBy(*line).agg(F.max("n").alias("peak_passages"))
    return most.withColumn("peak_headway", F.round(F.lit((end - start) / 60.0) / F.col("peak_passages"), 1))


def end_to_end(patterns: DataFrame, line: list[str]) -> DataFrame:
    """(line.., minutes, first_stop, last_stop): the longest median duration among patterns run at least a third as often as the commonest.

    patterns (line.., pattern, duration in seconds) one row a trip; trips of fewer than two stops do not count.
    """
    runs = patterns.filter(F.size("pattern") >= 2).groupBy(*line, "pattern").agg(F.count("*").alias("n"), F.median("duration").alias("m"))
    main = runs.withColumn("most", F.max("n").over(Window.partitionBy(*line))).filter("n * 3 >= most")
    best = main.groupBy(*line).agg(F.max(F.struct("m", F.col("pattern"))).alias("x"))
    return best.select(*line, F.rint(F.col("x.m") / 60).cast("int").alias("minutes"), F.element_at("x.pattern", 1).alias("first_stop"), F.element_at("x.pattern", -1).alias("last_stop"))


def competition_ranks(df: DataFrame, by: Column, name: str = "rank", keys: list[str] = ()) -> DataFrame:
    """1, 2, 2, 4 in the order of ``by``."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(by)))


def published_rankings(cities: DataFrame, lines: DataFrame) -> DataFrame:
    """(ranking, rank, city, line, value): latest Saturday passage, most frequent line, busiest station, longest line, most trips.

    cities (city, last_saturday, busiest_passages, weekday_trips), lines (city, line, peak_headway,
    minutes); rows without a value are not ranked; equal ones share a rank.
    """
    none = F.lit(None).cast("string")
    parts = [
        cities.select(F.lit("latest_saturday").alias("ranking"), "city", none.alias("line"), F.col("last_saturday").cast("double").alias("value"), F.lit(-1.0).alias("sign")),
        lines.select(F.lit("most_frequent_line"), "city", "line", F.col("peak_headway").cast("double"), F.lit(1.0)),
        cities.select(F.lit("busiest_station"), "city", none, F.col("busiest_passages").cast("double"), F.lit(-1.0)),
        lines.select(F.lit("longest_line"), "city", "line", F.col("minutes").cast("double"), F.lit(-1.0)),
        cities.select(F.lit("most_trips"), "city", none, F.col("weekday_trips").cast("double"), F.lit(-1.0)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    ranked = whole.filter("value is not null").withColumn("rank", F.rank().over(Window.partitionBy("ranking").orderBy(F.col("value") * F.col("sign"))))
    return ranked.select("ranking", "rank", "city", "line", "value")


def city_positions(ranked: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """(city, ranking, rank, line, value): each city's best row in each ranking; with ``modes`` (city, line, mode) ranks count within the same mode."""
    if modes is not None:
        ranked = ranked.join(modes, ["city", "line"], "left").withColumn("mode", F.coalesce("mode", F.lit("")))
        ranked = ranked.withColumn("rank", F.rank().over(Window.partitionBy("ranking", "mode").orderBy("rank")))
    best = Window.partitionBy("city", "ranking").orderBy("rank", "line")
    return ranked.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("city", "ranking", "rank", "line", "value")


def city_rankings(day: DataFrame, before: DataFrame, after: DataFrame, centre: DataFrame) -> dict[str, DataFrame]:
    """The rankings of one city from the stop times of a service day and of the days beside it.

    Rows (trip_id, route_id, direction, seq, stop_id, name, arr, dep, pickup_type), ``name`` normalised; centre
    (name): the stations that count as the city's centre. Gives busiest (station, tied, passages), lines
    (route_id, peak_passages, peak_headway, minutes, first_stop, last_stop), centre (first and last passage
    of the transport day) and trips (weekday_trips), each of one row or one a line.
    """
    boards = {k: boardable(df, "trip_id", ["seq"]).filter("dep is not null") for k, df in (("day", day), ("before", before), ("after", after))}
    peak = peak_headway(boards["day"], ["route_id"], ["stop_id", "direction"], "dep", 8 * 3600, 9 * 3600)
    timed = day.filter("arr is not null and dep is not null").groupBy("trip_id", "route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "arr", "dep"))).alias("r"))  # a trip's calls in a day
    patterns = timed.select("route_id", F.col("r.stop_id").alias("pattern"), (F.element_at("r.arr", -1) - F.element_at("r.dep", 1)).alias("duration"))
    at_centre = transport_day(*(boards[k].join(F.broadcast(centre.select("name").distinct()), "name", "left_semi") for k in ("day", "before", "after")))
    return {
        "busiest": busiest(boards["day"], "name"), "lines": peak.join(end_to_end(patterns, ["route_id"]), "route_id", "full_outer"),
        "centre": first_and_last(at_centre.withColumn("place", F.lit("centre")), ["place"], "route_id").drop("place"), "trips": day.agg(F.countDistinct("trip_id").alias("weekday_trips")),
    }
