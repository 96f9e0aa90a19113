"""Queries of the transit operators on the whole test tables. Stand-ins: suppliers are stops, customers are points, orders are trips."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrek.functions.geo import hilbert_key, inside_polygons, thin_line
from isotrek.functions.links import parameters, parse_state
from isotrek.functions.numbers import display_minutes, round_decimal
from isotrek.functions.text import display_name, fold_accents, normalise_name, route_mode
from isotrek.functions.values import decimal_between, key, strip
from isotrek.operators import network as net_ops
from isotrek.operators import rankings, raster, search, service_days, stats, streets, variants
from isotrek.operators.checks import foreign_keys_hold
from isotrek.operators.itinerary import itineraries
from isotrek.operators.proximity import k_nearest, near_pairs, nearest
from isotrek.params import City, Mode, Wait, Walk, Window
from isotrek.session import cut, table

TODAY = date(2026, 3, 2)
CITY = City(
    "test", (-180.0, -90.0, 180.0, 90.0), (36.0, -9.0), Walk(detour_factor=1.3, speed_m_per_min=75, max_access_m=1000, max_transfer_walk_m=400),
    (Mode("bus", ("3", "700")), Mode("ferry", ("4",), Wait(0.5, 2, 20), 4), Mode("rail", ("0", "1", "2"), Wait(0.5, 1, 10), 2)), Window("07:00", "22:00"),
)
BOX = (0.0, 41.5, 0.2, 41.7)
GRID = raster.Grid(0.0, 41.5, 0.2, 41.7, 500.0)
POLYGON = [[[(41.52, 0.02), (41.68, 0.05), (41.66, 0.18), (41.55, 0.16), (41.52, 0.02)], [(41.58, 0.08), (41.62, 0.08), (41.62, 0.12), (41.58, 0.12), (41.58, 0.08)]]]


def _r(c: str, digits: int = 4):
    return round_decimal(F.col(c), digits).alias(c)


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Stops with positions made from their keys."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("key"), (41.5 + ((k * 37) % 1000) / 5000).alias("lat"), (((k * 91) % 1000) / 5000).alias("lon"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("key"), (41.5 + ((k * 53) % 997) / 5000).alias("lat"), (((k * 29) % 991) / 5000).alias("lon"))


def timed_rows(spark: SparkSession, d: str) -> DataFrame:
    """(trip_id, seq, st_id, stop_id, arr, dep, pickup_type): stop_times with a readable sequence; times that are no H:MM:SS are null."""
    return table(spark, d, "stop_times").select(
        key("trip_id").alias("trip_id"), net_ops.sequence_number(F.col("stop_sequence")).alias("seq"), "st_id", key("stop_id").alias("stop_id"),
        net_ops.service_seconds(F.col("arrival_time")).alias("arr"), net_ops.service_seconds(F.col("departure_time")).alias("dep"), strip("pickup_type").alias("pickup_type"),
    ).filter("trip_id is not null and seq is not null and stop_id is not null")


def trip_lines(spark: SparkSession, d: str) -> DataFrame:
    """(trip_id, route_id, direction): one row a trip."""
    rows = table(spark, d, "trips").select(key("trip_id").alias("trip_id"), key("route_id").alias("route_id"), F.coalesce(key("direction_id"), F.lit("0")).alias("direction")).filter("trip_id is not null and route_id is not null")
    return rows.groupBy("trip_id").agg(F.min(F.struct("route_id", "direction")).alias("t")).select("trip_id", "t.route_id", "t.direction")


def line_hops(spark: SparkSession, d: str) -> DataFrame:
    hops = net_ops.hops(timed_rows(spark, d), "trip_id", ["seq", "st_id"], "stop_id", "arr", "dep")
    start, end = CITY.window.seconds
    return hops.filter((F.col("dep") >= start) & (F.col("dep") < end)).withColumnRenamed("trip", "trip_id").join(trip_lines(spark, d), "trip_id")


LINE = ["route_id", "direction"]


def hop_median(spark: SparkSession, d: str) -> DataFrame:
    return net_ops.ride_medians(line_hops(spark, d), LINE).select(*LINE, F.col("a").alias("from_stop"), F.col("b").alias("to_stop"), _r("minutes"))


def headway_wait(spark: SparkSession, d: str) -> DataFrame:
    boards = net_ops.departures(line_hops(spark, d), LINE, 900)
    wait = net_ops.boarding_wait(F.col("headway"), F.lit(0.5), F.lit(1.0), F.lit(15.0))
    return boards.withColumn("wait", wait).select(*LINE, F.col("a").alias("stop_id"), "departures", _r("headway"), _r("wait"))


def line_headway(spark: SparkSession, d: str) -> DataFrame:
    boards = net_ops.departures(line_hops(spark, d), LINE, 900)
    return boards.groupBy(*LINE).agg(F.median("headway").alias("median_min"), F.min("headway").alias("best_min")).select(*LINE, _r("median_min"), _r("best_min"))


def typical_headway(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "events").select("event_type", F.round(F.col("value"), 1).alias("value")).filter("value > 0").withColumn("w", F.lit(1.0))
    return stats.weighted_median(values, "value", "w", ["event_type"]).select("event_type", _r("value"))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return service_days.service_days(table(spark, d, "calendar"), table(spark, d, "calendar_dates"), "cd_id")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return service_days.service_blocks(table(spark, d, "calendar"), table(spark, d, "calendar_dates"), "cd_id")


def service_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return _days(spark, d).groupBy("service_id").agg(F.count("*").alias("days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


def services_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Every day of the year and how many services run; other exception types remove, by the second rule set."""
    days = service_days.service_days(table(spark, d, "calendar"), table(spark, d, "calendar_dates"), "cd_id", other_types_remove=True)
    return days.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("services"))


def reference_day(spark: SparkSession, d: str) -> DataFrame:
    return service_days.reference_day(_blocks(spark, d), table(spark, d, "trips"), F.lit(TODAY)).select(F.col("day").cast("string").alias("day"))


def typical_day(spark: SparkSession, d: str) -> DataFrame:
    return service_days.typical_day(_blocks(spark, d), table(spark, d, "trips"), since=F.lit(TODAY)).select(F.col("day").cast("string").alias("day"))


def next_saturday(spark: SparkSession, d: str) -> DataFrame:
    return service_days.next_service_saturday(_days(spark, d), F.lit(TODAY)).select(F.col("day").cast("string").alias("day"))


def feed_validity(spark: SparkSession, d: str) -> DataFrame:
    return service_days.feed_validity(table(spark, d, "calendar"), table(spark, d, "calendar_dates")).select(F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


def trips_per_service(spark: SparkSession, d: str) -> DataFrame:
    return service_days.trips_per_service(table(spark, d, "trips"))


def anti_refs(spark: SparkSession, d: str) -> DataFrame:
    return foreign_keys_hold({t: table(spark, d, t) for t in ("stops", "routes", "trips", "stop_times")})


def common_pattern(spark: SparkSession, d: str) -> DataFrame:
    patterns = net_ops.trip_patterns(timed_rows(spark, d), "trip_id", ["seq", "st_id"], "stop_id").withColumnRenamed("trip", "trip_id").join(trip_lines(spark, d), "trip_id")
    return net_ops.most_common(patterns.withColumn("pattern", F.array_join("pattern", ">")), LINE, "pattern").select(*LINE, "pattern", F.col("n").alias("trips"))


def nearest_stop(spark: SparkSession, d: str) -> DataFrame:
    return nearest(customers(spark, d), suppliers(spark, d), 2500).select("key", F.col("nearest").cast("string").alias("nearest"), _r("metres", 2))


def within_radius(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(suppliers(spark, d), 2500).select("key_a", "key_b", _r("metres", 2))


def k_nearest_stops(spark: SparkSession, d: str) -> DataFrame:
    return k_nearest(customers(spark, d), suppliers(spark, d), 5000, 3).select("key", "nearest", _r("metres", 2), "rank")


def _polygon():
    ring = lambda r: F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in r))
    return F.array(*(F.array(*(ring(r) for r in p)) for p in POLYGON))


def points_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).filter(inside_polygons(_polygon(), F.col("lat"), F.col("lon"))).select("key")


def _raster(spark: SparkSession, d: str) -> DataFrame:
    near = raster.cells_near(GRID, suppliers(spark, d).withColumn("base", F.col("key") % 20), 1800.0)
    return near.groupBy("cell").agg(F.min(F.col("base") + F.col("metres") / 75).alias("minutes"))


def raster_min(spark: SparkSession, d: str) -> DataFrame:
    return _raster(spark, d).select("cell", _r("minutes"))


def raster_smooth(spark: SparkSession, d: str) -> DataFrame:
    whole = _raster(spark, d).withColumn("minutes", F.floor("minutes").cast("float"))
    return raster.smooth(whole, GRID.cols, GRID.rows).select("cell", round_decimal(F.col("minutes").cast("double"), 3).alias("minutes"))


def raster_gaps(spark: SparkSession, d: str) -> DataFrame:
    whole = _raster(spark, d).withColumn("minutes", F.floor("minutes").cast("float"))
    return raster.fill_gaps(whole, GRID.cols, GRID.rows).select("cell", round_decimal(F.col("minutes").cast("double"), 3).alias("minutes"))


def raster_contours(spark: SparkSession, d: str) -> DataFrame:
    whole = _raster(spark, d).withColumn("minutes", F.floor("minutes"))
    found = raster.contours(GRID, whole, [10.5, 20.5])
    return found.groupBy("threshold", "row", "col").agg(F.count("*").alias("segments"), round_decimal(F.sum(F.col("lat1") + F.col("lat2")), 6).alias("lat_sum"), round_decimal(F.sum(F.col("lon1") + F.col("lon2")), 6).alias("lon_sum"))


def coverage_reach(spark: SparkSession, d: str) -> DataFrame:
    covered = raster.coverage(GRID, suppliers(spark, d), 1000.0, _polygon())
    return raster.reach_percent(_raster(spark, d), covered, 15).select(_r("percent"))


def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("value"))
    return streets.delta_decode(steps, "value", "p_partkey", ["p_brand"])


def _street_edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers joined to the next ones in key order, and by a rule to others: a sparse connected graph with whole metres."""
    k, n = F.col("s_suppkey"), table(spark, d, "supplier").count()
    keys = table(spark, d, "supplier").select(k.alias("a"))
    chain = keys.select("a", ((F.col("a") + 1) % n).alias("b"), (100 + F.col("a") % 7 * 10).alias("metres"))
    leap = keys.select("a", ((F.col("a") * 7 + 3) % n).alias("b"), (300 + F.col("a") % 11 * 20).alias("metres")).filter("a <> b")
    return chain.union(leap).filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("metres").alias("metres"))


def bounded_reach(spark: SparkSession, d: str) -> DataFrame:
    edges = _street_edges(spark, d)
    sources = table(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_nationkey").cast("long").alias("node"), F.lit(0.0).alias("metres0"))
    return search.street_reach(edges, sources, 900.0).select(F.col("source").cast("int").alias("source"), "node", F.col("metres").cast("long").alias("metres"))


def relaxed_reach(spark: SparkSession, d: str) -> DataFrame:
    """bounded_reach by joins instead of the array kernel."""
    edges = _street_edges(spark, d)
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("metres").cast("double").alias("cost")).union(edges.select("b", "a", F.col("metres").cast("double")))
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").alias("origin"), F.col("n_nationkey").cast("long").alias("state"), F.lit(0.0).alias("minutes"))
    found = search.relaxed_stop_times(both, seeds, 900.0)
    return found.select(F.col("origin").cast("int").alias("source"), F.col("state").alias("node"), F.col("minutes").cast("long").alias("metres"))


def stop_components(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_pairs(suppliers(spark, d), 1500).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return streets.components(pairs)


def _boardings(spark: SparkSession, d: str) -> DataFrame:
    return rankings.boardable(timed_rows(spark, d), "trip_id", ["seq", "st_id"]).filter("dep is not null")


def busiest_stop(spark: SparkSession, d: str) -> DataFrame:
    found = rankings.busiest(_boardings(spark, d), "stop_id")
    return found.select("station", F.array_join("tied", ",").alias("tied"), "passages")


def peak_headway(spark: SparkSession, d: str) -> DataFrame:
    timed = _boardings(spark, d).join(trip_lines(spark, d), "trip_id")
    return rankings.peak_headway(timed, ["route_id"], ["stop_id", "direction"], "dep", 8 * 3600, 9 * 3600).select("route_id", "peak_passages", _r("peak_headway", 1))


def end_to_end(spark: SparkSession, d: str) -> DataFrame:
    rows = timed_rows(spark, d).filter("arr is not null and dep is not null")
    whole = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "st_id", "stop_id", "arr", "dep"))).alias("r"))
    patterns = whole.select("trip_id", F.array_join("r.stop_id", ">").alias("joined"), F.col("r.stop_id").alias("pattern"), (F.element_at("r.arr", -1) - F.element_at("r.dep", 1)).alias("duration")).join(trip_lines(spark, d), "trip_id")
    return rankings.end_to_end(patterns, ["route_id"])


def rank_lines(spark: SparkSession, d: str) -> DataFrame:
    trips = trip_lines(spark, d).groupBy("route_id").agg(F.count("*").alias("trips"))
    return rankings.competition_ranks(trips, F.desc("trips"))


def transport_day(spark: SparkSession, d: str, day: str = "20260602") -> DataFrame:
    """First and last departure at each stop on the transport day of one feed_day (a fixed one, as in the SQL twin, unless given), with the days beside it."""
    rows = _boardings(spark, d).join(table(spark, d, "trips").select(key("trip_id").alias("trip_id"), strip("feed_day").alias("feed_day")).distinct(), "trip_id").join(trip_lines(spark, d), "trip_id")
    middle = datetime.strptime(day, "%Y%m%d")
    of = lambda shift: rows.filter(F.col("feed_day") == (middle + timedelta(days=shift)).strftime("%Y%m%d")).select("stop_id", "route_id", "dep")
    return rankings.first_and_last(rankings.transport_day(of(0), of(-1), of(1)), ["stop_id"], "route_id")


def normalise_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "stops").select("stop_name").filter("stop_name is not null").distinct()
    return names.select("stop_name", normalise_name(F.col("stop_name")).alias("norm"))


def display_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.upper("p_name").alias("name")).distinct()
    return names.select("name", display_name(F.col("name")).alias("shown"))


def route_modes(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(F.col("p_partkey")).cast("string").alias("route_type"))
    return numbers.distinct().select("route_type", route_mode(F.col("route_type")).alias("mode"))


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "routes").select("route_id", fold_accents(F.col("route_long_name")).alias("folded")).distinct()


def link_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    link = F.concat(F.lit("?city=test&o="), (41.5 + k % 50 / 100).cast("decimal(8,3)").cast("string"), F.lit(","), (k % 40 / 100).cast("decimal(8,3)").cast("string"), F.lit("&max="), (k % 200).cast("string"), F.lit("&dir="), F.when(k % 3 == 0, "to").when(k % 3 == 1, "from").otherwise("up"))
    state = parse_state(link, "test", ["bus", "rail"], BOX)
    parsed = table(spark, d, "customer").select(k.alias("key"), state.alias("s"), F.size(parameters(link)).alias("parameters"))
    return parsed.select("key", F.col("s.origin.lat").alias("lat"), F.col("s.origin.lon").alias("lon"), "s.max_minutes", "s.direction", F.array_join("s.ignored", ",").alias("ignored"), "parameters")


def clock_texts(spark: SparkSession, d: str) -> DataFrame:
    return timed_rows(spark, d).filter("dep is not null").select("dep").distinct().select("dep", net_ops.clock_text(F.col("dep")).alias("shown"), display_minutes(F.col("dep") / 60).alias("minutes"))


def feed_merge(spark: SparkSession, d: str) -> DataFrame:
    text = lambda df, *c: df.select(*(F.col(x).cast("string").alias(y) for x, y in c))
    main = text(table(spark, d, "supplier"), ("s_suppkey", "stop_id"), ("s_name", "stop_name"), ("s_nationkey", "zone"))
    extra = text(table(spark, d, "customer"), ("c_custkey", "stop_id"), ("c_name", "stop_name"), ("c_mktsegment", "segment"))
    return variants.merge_feeds(main, extra, "x", ["stop_id"])


def direction_waits_table(spark: SparkSession, d: str) -> DataFrame:
    rows = timed_rows(spark, d).filter("arr is not null").join(trip_lines(spark, d), "trip_id").withColumnRenamed("trip_id", "trip")
    members = table(spark, d, "stops").select(key("stop_id").alias("stop_id"), key("stop_id").alias("complex_id")).distinct()
    return variants.direction_waits(variants.complex_hops(rows, members), 900)


def direction_waits(spark: SparkSession, d: str) -> DataFrame:
    return direction_waits_table(spark, d).select("complex_id", "route_id", _r("wait", 1))


def branch_waits(spark: SparkSession, d: str) -> DataFrame:
    rows = timed_rows(spark, d).filter("arr is not null").join(trip_lines(spark, d), "trip_id").withColumnRenamed("trip_id", "trip")
    members = table(spark, d, "stops").select(key("stop_id").alias("stop_id"), key("stop_id").alias("complex_id")).distinct()
    hops = variants.complex_hops(rows, members)
    return variants.branch_waits(hops, hops.filter("dep >= 25200 and dep < 72000"), 780)


def stop_complexes(spark: SparkSession, d: str) -> DataFrame:
    stops = table(spark, d, "stops").select(key("stop_id").alias("stop_id"), F.coalesce(strip("stop_name"), F.lit("")).alias("name"), decimal_between(F.col("stop_lat"), -90, 90).alias("lat"), decimal_between(F.col("stop_lon"), -180, 180).alias("lon")).dropna()
    return variants.stop_complexes(stops)[1]


def street_segments(spark: SparkSession, d: str) -> DataFrame:
    """Undirected segments between consecutive stops of trips, each once, by its first trip."""
    rows = timed_rows(spark, d).groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "st_id", "stop_id"))).alias("r"))
    ways = rows.select(F.col("trip_id").alias("way"), F.col("r.stop_id").alias("nodes"), F.lit(1).alias("cls"))
    stops = table(spark, d, "stops").select(key("stop_id").alias("node"), decimal_between(F.col("stop_lat"), -90, 90).alias("lat"), decimal_between(F.col("stop_lon"), -180, 180).alias("lon")).dropna().groupBy("node").agg(F.min(F.struct("lat", "lon")).alias("p")).select("node", "p.lat", "p.lon")
    return streets.segments(stops, ways).select("a", "b", "way", _r("metres", 2))


def street_junctions(spark: SparkSession, d: str) -> DataFrame:
    return streets.junctions(_street_edges(spark, d).withColumn("cls", F.col("metres") % 2))


def hilbert_order(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers along a Hilbert curve."""
    return streets.hilbert_numbers(suppliers(spark, d).withColumnRenamed("key", "node"))


def thinned_trips(spark: SparkSession, d: str) -> DataFrame:
    """Each trip's stop polyline thinned to points at least 500 m apart."""
    places = table(spark, d, "stops").select(key("stop_id").alias("stop_id"), decimal_between(F.col("stop_lat"), -90, 90).alias("lat"), decimal_between(F.col("stop_lon"), -180, 180).alias("lon")).dropna()
    lowest = places.groupBy("stop_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("stop_id", "p.lat", "p.lon")
    rows = timed_rows(spark, d).join(lowest, "stop_id")
    lines = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "st_id", "lat", "lon"))).alias("r"))
    points = F.transform("r", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return lines.select("trip_id", F.size("r").alias("points"), F.size(thin_line(points, 500.0)).alias("kept"))


def _timetable(spark: SparkSession, d: str) -> net_ops.Timetable:
    """The timetable of all services at once, so that the test tables give a dense one."""
    feed = {t: table(spark, d, t) for t in ("routes", "trips", "stop_times")}
    feed["stop_times"] = feed["stop_times"].withColumn("row_no", F.col("st_id"))
    feed["stops"] = table(spark, d, "stops").filter(decimal_between(F.col("stop_lat"), -90, 90).isNotNull() & decimal_between(F.col("stop_lon"), -180, 180).isNotNull())
    active = feed["trips"].select(key("service_id").alias("service_id")).distinct()
    return net_ops.timetable(feed, active, CITY)


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zones").select(F.col("zone_id").alias("origin"), F.expr("polygons[0][0][0].lat").alias("lat"), F.expr("polygons[0][0][0].lon").alias("lon"))


def network_waits(spark: SparkSession, d: str) -> DataFrame:
    found = _timetable(spark, d)
    placed = found.waits.join(found.stops.select("stop_id"), "stop_id", "left_semi")
    return placed.select(F.concat_ws(":", "route_id", "direction").alias("line_id"), "mode", "stop_id", "departures", "headway", "wait")


def transit_times(spark: SparkSession, d: str) -> DataFrame:
    """Minutes from a corner of every zone to the stops reached, by the array kernel."""
    return search.timetable_stop_times(_timetable(spark, d), CITY, _origins(spark, d))


def point_times(spark: SparkSession, d: str) -> DataFrame:
    """Minutes from every zone's corner to the stops near what is reached."""
    found = _timetable(spark, d)
    stops = cut(found.stops.dropna(subset=["lat", "lon"]))
    points = stops.select(F.col("stop_id").alias("point"), "lat", "lon")
    return search.timetable_point_times(replace(found, stops=stops), CITY, _origins(spark, d), points)


def trips_between_zones(spark: SparkSession, d: str) -> DataFrame:
    """Itineraries from every zone's corner to the next zone's one."""
    arrays = search.network_arrays(_timetable(spark, d), CITY)
    origins = _origins(spark, d).withColumn("i", F.expr("cast(substring(origin, 2) as int)"))
    ends = origins.select((F.col("i") - 1).alias("i"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    found = itineraries(arrays, origins.join(ends, "i").select(F.col("origin").alias("trip"), "lat", "lon", "to_lat", "to_lon"), direct_walk_m=10_000)
    return found.select("trip", "total", F.size("legs").alias("legs"), F.size("path").alias("points"))


QUERIES = {f.__name__: f for f in (
    hop_median, headway_wait, line_headway, typical_headway, service_day_counts, services_of_days, reference_day, typical_day, next_saturday, feed_validity,
    trips_per_service, anti_refs, common_pattern, nearest_stop, within_radius, k_nearest_stops, points_in_polygon, raster_min, raster_smooth, raster_gaps,
    raster_contours, coverage_reach, delta_decode, bounded_reach, relaxed_reach, stop_components, busiest_stop, peak_headway, end_to_end, rank_lines, transport_day,
    normalise_names, display_names, route_modes, folded_names, link_parse, clock_texts, feed_merge, direction_waits, branch_waits, stop_complexes, street_segments,
    street_junctions, hilbert_order, thinned_trips, network_waits, transit_times, point_times, trips_between_zones,
)}
