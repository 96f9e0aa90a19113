"""The schedule network: consecutive hops of trips, ride minutes, headways, boarding waits, neighbours, line geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.functions.geo import thin_line
from isotrek.functions.numbers import round_half_even
from isotrek.functions.values import key, strip
from isotrek.operators.numbering import dense_index
from isotrek.operators.proximity import near_join
from isotrek.params import MIN_RIDE_MINUTES, City
from isotrek.session import keep


@dataclass
class Network:
    """A city's schedule network as tables; every index is dense and starts at 0."""

    stops: DataFrame  # stop_ix, stop_id, name, lat, lon
    lines: DataFrame  # line_ix, line_id, route_id, direction, mode
    rides: DataFrame  # line_ix, a, b, minutes
    waits: DataFrame  # stop_ix, line_ix, departures, headway, wait
    neighbors: DataFrame  # a, b, minutes


def service_seconds(col: Column) -> Column:
    """'H:MM:SS' to seconds of the service day; hours may pass 24; anything else is null."""
    text = F.regexp_substr(strip(col), F.lit("^[0-9]+:[0-9]{1,2}:[0-9]{1,2}$"))
    hours, minutes, seconds = F.substring_index(text, ":", 1), F.substring_index(F.substring_index(text, ":", 2), ":", -1), F.substring_index(text, ":", -1)
    return F.try_add(F.try_multiply(hours.try_cast("int"), F.lit(3600)), minutes.try_cast("int") * 60 + seconds.try_cast("int"))


def sequence_number(col: Column) -> Column:
    """A stop_sequence of ASCII digits as a number; anything else is null. Rows without a sequence or a stop take no part in a trip."""
    return F.regexp_substr(strip(col), F.lit("^[0-9]+$")).try_cast("int")


def clock_text(seconds: Column) -> Column:
    """Seconds of the service day as 'HH:MM', with '(+1)' for the next day."""
    day = F.floor(seconds / 86_400).cast("int")
    text = F.format_string("%02d:%02d", F.floor(F.pmod(seconds, F.lit(86_400)) / 3600).cast("int"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"))
    return F.when(day > 0, F.concat(text, F.lit(" (+"), day.cast("string"), F.lit(")"))).otherwise(text)


def hops(stop_times: DataFrame, trip: str, order: list[str], stop: str, arrival: str, departure: str) -> DataFrame:
    """Every row paired with the next one of its trip: (trip, a, b, dep, arr) plus whatever ``stop_times`` has under other names is dropped.

    Pairs come first; invalid ones (a time missing, or the same stop twice) are dropped afterwards, so a
    row without a time breaks the chain. ``order`` must make the order within a trip total.
    """
    along = Window.partitionBy(trip).orderBy(*order)
    paired = stop_times.select(
        F.col(trip).alias("trip"), F.col(stop).alias("a"), F.lead(stop).over(along).alias("b"),
        F.col(departure).alias("dep"), F.lead(arrival).over(along).alias("arr"),
    )
    return paired.filter("b is not null and a <> b and dep is not null and arr is not null")


def ride_medians(hops_of_lines: DataFrame, line: list[str]) -> DataFrame:
    """(line.., a, b, minutes): exact median of the scheduled minutes of each hop, not under the floor."""
    minutes = F.greatest(F.lit(0), F.col("arr") - F.col("dep")) / 60.0
    return hops_of_lines.groupBy(*line, "a", "b").agg(F.greatest(F.lit(MIN_RIDE_MINUTES), F.median(minutes)).alias("minutes"))


def ride_minutes(hops_of_lines: DataFrame, line: list[str]) -> DataFrame:
    """ride_medians rounded to 2, as they are published."""
    return ride_medians(hops_of_lines, line).withColumn("minutes", round_half_even(F.col("minutes"), 2))


def boarding_wait(headway: Column, factor: Column, low: Column, high: Column) -> Column:
    """factor x headway, clamped."""
    return F.least(high, F.greatest(low, headway * factor))


def departures(hops_of_lines: DataFrame, line: list[str], window_minutes: float) -> DataFrame:
    """(line.., a, departures, headway): valid hops leaving each stop, and the unrounded headway in minutes."""
    return hops_of_lines.groupBy(*line, "a").agg(F.count("*").alias("departures")).withColumn("headway", F.lit(float(window_minutes)) / F.col("departures"))


def line_hops(feed: dict[str, DataFrame], active: DataFrame, city: City) -> DataFrame:
    """The valid hops of the day's trips in the city's window, with route, direction and mode.

    feed: stop_times, trips, routes as string tables; stop_times may carry ``row_no`` (file order) to
    settle equal sequence numbers. Semi-joins go before the pairing window, whose key they share.
    """
    spark = active.sparkSession
    modes = spark.createDataFrame(sorted(city.mode_of_route_type().items()) or [("", "")], "route_type string, mode string")
    routes = feed["routes"].select(key("route_id").alias("route_id"), key("route_type").alias("route_type")).join(F.broadcast(modes), "route_type").select("route_id", "mode").distinct()
    trips = feed["trips"].select(
        key("trip_id").alias("trip_id"), key("route_id").alias("route_id"), key("service_id").alias("service_id"), F.coalesce(key("direction_id"), F.lit("0")).alias("direction")
    ).filter("route_id is not null")
    trips = trips.groupBy("trip_id").agg(F.min(F.struct("route_id", "direction", "service_id")).alias("t")).select("trip_id", "t.*")
    trips = trips.join(active, "service_id", "left_semi").join(routes, "route_id").select("trip_id", "route_id", "direction", "mode")
    times = feed["stop_times"]
    row_no = F.col("row_no") if "row_no" in times.columns else F.lit(0)
    times = times.select(
        key("trip_id").alias("trip_id"), key("stop_id").alias("stop_id"), sequence_number(F.col("stop_sequence")).alias("seq"), row_no.alias("row_no"),
        service_seconds(F.col("arrival_time")).alias("arr"), service_seconds(F.col("departure_time")).alias("dep"),
    ).filter("seq is not null and stop_id is not null").join(trips.select("trip_id"), "trip_id", "left_semi")
    start, end = city.window.seconds
    valid = hops(times, "trip_id", ["seq", "row_no", "stop_id"], "stop_id", "arr", "dep").filter((F.col("dep") >= start) & (F.col("dep") < end))
    return valid.join(trips, valid["trip"] == trips["trip_id"]).drop("trip_id")


def waits_table(spark, city: City) -> DataFrame:
    rows = [(m.id, float(m.wait.factor), float(m.wait.min), float(m.wait.max)) for m in city.modes]
    return spark.createDataFrame(rows or [("", 0.5, 1.0, 15.0)], "mode string, factor double, low double, high double")


@dataclass
class Timetable:
    """The same network by ids, before anything is numbered."""

    rides: DataFrame  # route_id, direction, mode, a, b, minutes
    waits: DataFrame  # route_id, direction, mode, stop_id, departures, headway, wait
    stops: DataFrame  # stop_id, name, lat, lon
    hops: DataFrame | None = None  # route_id, direction, mode, a, b, minutes, n: rides with how often they leave, of which waits are made


def stop_places(stops: DataFrame) -> DataFrame:
    """(stop_id, name, lat, lon): one row a stop; of repeated rows the one of the lowest latitude, longitude and name."""
    number = lambda c: strip(c).try_cast("double").alias(c[5:])
    rows = stops.select(key("stop_id").alias("stop_id"), strip("stop_name").alias("name"), number("stop_lat"), number("stop_lon")).filter("stop_id is not null")
    return rows.groupBy("stop_id").agg(F.min(F.struct(F.col("lat").isNull().alias("lost"), "lat", "lon", "name")).alias("p")).select("stop_id", "p.name", "p.lat", "p.lon")


def timetable(feed: dict[str, DataFrame], active: DataFrame, city: City) -> Timetable:
    """Rides, waits and the stops in use of one service day.

    ``active``: (service_id) of the day. No hop in the window gives empty tables. The timetable is read
    once: rides and departures come from one aggregation by hop, which is kept as a table.
    """
    found = line_hops(feed, active, city)
    line = ["route_id", "direction", "mode"]
    start, end = city.window.seconds
    minutes = F.greatest(F.lit(0), F.col("arr") - F.col("dep")) / 60.0
    measured = keep(found.groupBy(*line, "a", "b").agg(F.median(minutes).alias("m"), F.count("*").alias("n")))
    hops = measured.select(*line, "a", "b", round_half_even(F.greatest(F.lit(MIN_RIDE_MINUTES), F.col("m")), 2).alias("minutes"), "n")
    rides = hops.drop("n")
    headway, wait = F.lit((end - start) / 60.0) / F.col("departures"), boarding_wait(F.col("headway"), F.col("factor"), F.col("low"), F.col("high"))
    boards = measured.groupBy(*line, F.col("a").alias("stop_id")).agg(F.sum("n").alias("departures")).withColumn("headway", headway).join(F.broadcast(waits_table(active.sparkSession, city)), "mode")
    waits = boards.select(*line, "stop_id", "departures", round_half_even(F.col("headway"), 2).alias("headway"), round_half_even(wait, 2).alias("wait"))
    used = rides.select(F.col("a").alias("stop_id")).union(rides.select("b")).distinct()
    return Timetable(rides, waits, used.join(stop_places(feed["stops"]), "stop_id").select("stop_id", "name", "lat", "lon"), hops)


def walking_neighbors(stops: DataFrame, ident: str, city: City) -> DataFrame:
    """(a, b, minutes): stops within the transfer walk of each other in a straight line, by their column ``ident``."""
    points = stops.select(F.col(ident).alias("key"), "lat", "lon")
    near = near_join(points, points, city.walk.max_transfer_walk_m, "key_a <> key_b")
    return near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), (F.col("metres") * city.walk.detour_factor / city.walk.speed_m_per_min).alias("minutes"))


def numbered(found: Timetable, city: City) -> Network:
    """The network with dense numbers: stops by id, lines by route and direction."""
    rides = found.rides
    lines = dense_index(rides.select("route_id", "direction", "mode").distinct(), ["route_id", "direction"], "line_ix").withColumn("line_ix", F.col("line_ix").cast("int")).withColumn("line_id", F.concat_ws(":", "route_id", "direction"))
    stops = dense_index(found.stops, ["stop_id"], "stop_ix").withColumn("stop_ix", F.col("stop_ix").cast("int"))
    number = stops.select("stop_id", "stop_ix")
    at = lambda df, c, name: df.join(number.select(F.col("stop_id").alias(c), F.col("stop_ix").alias(name)), c)
    of_line = lines.select("route_id", "direction", "line_ix")
    ride_ix = at(at(rides.join(of_line, ["route_id", "direction"]), "a", "ix_a"), "b", "ix_b").select("line_ix", F.col("ix_a").alias("a"), F.col("ix_b").alias("b"), "minutes")
    waits = at(found.waits.join(of_line, ["route_id", "direction"]), "stop_id", "stop_ix").select("stop_ix", "line_ix", "departures", "headway", "wait")
    return Network(stops.select("stop_ix", "stop_id", "name", "lat", "lon"), lines.select("line_ix", "line_id", "route_id", "direction", "mode"), ride_ix, waits, walking_neighbors(stops, "stop_ix", city))


def build_network(feed: dict[str, DataFrame], active: DataFrame, city: City) -> Network:
    """The network of one service day: stops in use, lines (route and direction), rides, waits and walking neighbours (straight lines)."""
    return numbered(timetable(feed, active, city), city)


def most_common(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group.., value, n): the commonest value of each group, the smaller one of equally common ones; null values do not count."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc(value))
    return counted.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def trip_patterns(stop_times: DataFrame, trip: str, order: list[str], stop: str) -> DataFrame:
    """(trip, pattern): the whole sequence of stops of each trip. One trip's rows are bounded by what a vehicle can serve in a day."""
    rows = stop_times.groupBy(F.col(trip).alias("trip")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(stop).alias("_stop")))).alias("rows"))
    return rows.select("trip", F.col("rows._stop").alias("pattern"))


def feed_geometry(feed: dict[str, DataFrame], active: DataFrame, lines: DataFrame) -> DataFrame:
    """line_geometry of a feed's own shapes and stop patterns, over all trips of the day's services."""
    spark = active.sparkSession
    trips = feed["trips"].withColumn("shape", key("shape_id") if "shape_id" in feed["trips"].columns else F.lit(None).cast("string"))
    trips = trips.select(key("trip_id").alias("trip"), F.concat_ws(":", key("route_id"), F.coalesce(key("direction_id"), F.lit("0"))).alias("line_id"), key("service_id").alias("service_id"), "shape")
    trips = trips.filter("trip is not null").groupBy("trip").agg(F.min(F.struct("line_id", "service_id", "shape")).alias("t")).select("trip", "t.*").join(active, "service_id", "left_semi")
    number = lambda c: strip(c).try_cast("double")
    if "shapes" in feed:
        rows = feed["shapes"].select(key("shape_id").alias("shape_id"), sequence_number(F.col("shape_pt_sequence")).alias("seq"), number("shape_pt_lat").alias("lat"), number("shape_pt_lon").alias("lon")).dropna()
        placed = rows.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
        shapes = placed.select("shape_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))
    else:
        shapes = spark.createDataFrame([], "shape_id string, points array<struct<lat:double,lon:double>>")
    times = feed["stop_times"].select(key("trip_id").alias("trip"), key("stop_id").alias("stop_id"), sequence_number(F.col("stop_sequence")).alias("seq")).filter("seq is not null and stop_id is not null")
    patterns = trip_patterns(times.join(trips.select("trip"), "trip", "left_semi"), "trip", ["seq"], "stop_id").join(trips.select("trip", "line_id"), "trip")
    stops = stop_places(feed["stops"]).select("stop_id", "lat", "lon").dropna()
    drawn = spark.createDataFrame([], "line_id string, points array<struct<lat:double,lon:double>>")
    found = line_geometry(lines, trips.select("line_id", F.col("shape").alias("shape_id")), shapes, drawn, patterns.select("line_id", "pattern"), stops)
    return found.join(lines.select("line_id", "line_ix", "mode"), "line_id")


def line_geometry(lines: DataFrame, shape_uses: DataFrame, shapes: DataFrame, osm: DataFrame, patterns: DataFrame, stops: DataFrame, min_distance_m: float = 15.0) -> DataFrame:
    """(line_id, source, points, warning): each line's polyline from its most used shape, else from the map, else from its commonest stop pattern, else none.

    shape_uses (line_id, shape_id) one row a trip; shapes (shape_id, points); osm (line_id, points);
    patterns (line_id, pattern) one row a trip; stops (stop_id, lat, lon). Points are thinned and
    rounded to 5 decimals.
    """
    by_shape = most_common(shape_uses.join(shapes.select("shape_id"), "shape_id", "left_semi"), ["line_id"], "shape_id").join(shapes, "shape_id").select("line_id", F.col("points").alias("shape_points"))
    by_map = osm.select("line_id", F.col("points").alias("map_points"))
    common = most_common(patterns, ["line_id"], "pattern").select("line_id", F.posexplode("pattern").alias("pos", "stop_id"))
    by_stops = common.join(stops, "stop_id").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p")).select(
        "line_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("stop_points")
    )
    joined = lines.select("line_id").join(by_shape, "line_id", "left").join(by_map, "line_id", "left").join(by_stops, "line_id", "left")
    source = F.when(F.col("shape_points").isNotNull(), "shapes").when(F.col("map_points").isNotNull(), "osm").when(F.col("stop_points").isNotNull(), "stops")
    warning = F.when(source == "stops", "straight stop segments").when(source.isNull(), "no geometry")
    points = thin_line(F.coalesce("shape_points", "map_points", "stop_points"), min_distance_m)
    rounded = F.transform(points, lambda p: F.struct(round_half_even(p["lat"], 5).alias("lat"), round_half_even(p["lon"], 5).alias("lon")))
    return joined.select("line_id", source.alias("source"), F.when(source.isNotNull(), rounded).alias("points"), warning.alias("warning"))
