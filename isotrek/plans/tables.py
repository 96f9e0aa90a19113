"""Queries of the operators on the real timetable tables and zones, as far as SQL can express them too."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrek.functions import colour, geo, links, numbers, text
from isotrek.functions.values import decimal_between, key, real_day, strip
from isotrek.operators import checks, network, places, proximity, published, rankings, raster, search, stats, streets, variants
from isotrek.plans import reference as R
from isotrek.session import table

ZONE = "Z0009"
CENTRE, RIVER = (40.4, -3.7), ((-30.0, -60.0), (60.0, 80.0))  # river: two ends as (lat, lon)
RAMP = [(0.0, (10, 20, 200)), (0.4, (60, 180, 90)), (1.0, (240, 30, 20))]
BOX = (-10.0, 30.0, 30.0, 60.0)


def stop_points(spark: SparkSession, d: str) -> DataFrame:
    """(key, lat, lon): one position a stop, the lowest of repeated ones."""
    rows = table(spark, d, "stops").select(key("stop_id").alias("key"), decimal_between(F.col("stop_lat"), -90, 90).alias("lat"), decimal_between(F.col("stop_lon"), -180, 180).alias("lon")).dropna()
    return rows.groupBy("key").agg(F.min(F.struct("lat", "lon")).alias("p")).select("key", "p.lat", "p.lon")


def zone_corners(spark: SparkSession, d: str) -> DataFrame:
    return R._origins(spark, d).withColumnRenamed("origin", "key")


def stop_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Stops within the transfer walk of each other, in both directions, with the walk's minutes."""
    found = network.walking_neighbors(stop_points(spark, d), "key", R.CITY)
    return found.select("a", "b", R._r("minutes"))


def corner_stops(spark: SparkSession, d: str) -> DataFrame:
    found = proximity.nearest(zone_corners(spark, d), stop_points(spark, d), 20_000)
    return found.select("key", "nearest", R._r("metres", 2))


def corner_three_stops(spark: SparkSession, d: str) -> DataFrame:
    return proximity.k_nearest(zone_corners(spark, d), stop_points(spark, d), 20_000, 3).select("key", "nearest", "rank", R._r("metres", 2))


def network_rides(spark: SparkSession, d: str) -> DataFrame:
    """Published ride minutes: the median of at least 0.4, rounded half to even."""
    return R._timetable(spark, d).rides.select("route_id", "direction", "mode", "a", "b", "minutes")


def _medians(spark: SparkSession, d: str) -> DataFrame:
    waits = R.network_waits(spark, d)
    return stats.line_headways(waits, "line_id")


def line_medians(spark: SparkSession, d: str) -> DataFrame:
    return _medians(spark, d)


def headway_figures(spark: SparkSession, d: str) -> DataFrame:
    """Typical headway (median of the line medians weighted by 1/median) and the best one."""
    return stats.headway_summary(_medians(spark, d))


def amount_medians(spark: SparkSession, d: str) -> DataFrame:
    """Weighted medians with uneven weights: discounts by quantity."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_discount").alias("value"), F.col("l_quantity").alias("w"))
    return stats.weighted_median(rows, "value", "w", ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", R._r("value", 6))


def _ring() -> Column:
    return F.expr("transform(polygons[0][0], v -> named_struct('x', v.lon, 'y', v.lat))")


def zone_measures(spark: SparkSession, d: str) -> DataFrame:
    """Area and centroid of each zone's first ring, and its bounds over all rings, in degrees."""
    zones = table(spark, d, "zones").select("zone_id", geo.ring_area(_ring()).alias("area"), geo.ring_centroid(_ring()).alias("c"), geo.polygon_bounds(F.col("polygons"), 0.5).alias("b"))
    shown = lambda c, n: numbers.round_decimal(F.col(c), 6).alias(n)
    return zones.select("zone_id", shown("area", "area"), shown("c.x", "x"), shown("c.y", "y"), *(shown(f"b.{s}", s) for s in ("west", "south", "east", "north")))


def planar_stops(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.planar(F.col("lat"), F.col("lon"), *CENTRE)
    return stop_points(spark, d).select("key", numbers.round_decimal(x, 1).alias("x"), numbers.round_decimal(y, 1).alias("y"))


def river_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Segments between consecutive stops that cross one straight river, in degrees."""
    segs = R.street_segments(spark, d).select("a", "b")
    at = lambda c: stop_points(spark, d).select(F.col("key").alias(c), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    (lat1, lon1), (lat2, lon2) = RIVER
    placed = segs.join(at("a"), "a").join(at("b"), "b")
    crosses = geo.segments_cross(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"), F.lit(lon1), F.lit(lat1), F.lit(lon2), F.lit(lat2))
    return placed.filter(crosses).select("a", "b")


def long_segments(spark: SparkSession, d: str) -> DataFrame:
    """How segments between stops fall into parts of at most 5 km: inner nodes and links of each."""
    segs = R.street_segments(spark, d).select("metres").filter("metres <= 200000")
    parts = segs.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("metres") / 5000)).cast("int"))
    return parts.groupBy("parts").agg(F.count("*").alias("segments"), F.sum(F.col("parts") - 1).alias("inner_nodes"))


def open_routes(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "routes").select(key("route_id").alias("route_id"), key("agency_id").alias("agency_id"), strip("route_type").alias("route_type"), key("route_short_name").alias("route_short_name"))
    return variants.open_routes(routes, types=["2"], names=["7", "12"], ids=["R0003"]).select("route_id").distinct()


def stops_in_box(spark: SparkSession, d: str) -> DataFrame:
    west, south, east, north = BOX
    return stop_points(spark, d).filter(geo.in_box(F.col("lat"), F.col("lon"), west, south, east, north)).select("key")


def stops_in_zone(spark: SparkSession, d: str) -> DataFrame:
    """In-city test: inside the box of a zone and inside the zone."""
    zone = table(spark, d, "zones").filter(F.col("zone_id") == ZONE).select("polygons")
    inside = stop_points(spark, d).crossJoin(F.broadcast(zone)).withColumn("b", geo.polygon_bounds(F.col("polygons")))  # one zone
    return inside.filter(F.col("lat").between(F.col("b.south"), F.col("b.north")) & F.col("lon").between(F.col("b.west"), F.col("b.east")) & geo.inside_polygons(F.col("polygons"), F.col("lat"), F.col("lon"))).select("key")


def found_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops whose folded name holds all of some words."""
    names = table(spark, d, "stops").select("stop_id", "stop_name").filter("stop_name is not null").distinct()
    return names.filter(text.has_all_words(F.col("stop_name"), F.lit("ma  RÍ"))).select("stop_id", "stop_name")


def date_texts(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), text.long_date(F.col("day")).alias("long"), text.day_first(F.col("day")).alias("short"))


def number_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 1).alias("v"))
    return rows.select("c_custkey", numbers.thousands(F.col("c_custkey") * 7919, " ").alias("thousands"), numbers.decimal_comma(F.col("v")).alias("comma"), numbers.display_duration(F.col("c_custkey") / 9).alias("duration"))


def label_texts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return n.select("c_custkey", text.ordinal_label(F.concat(F.lit("Paris "), (F.col("c_custkey") % 21).cast("string"))).alias("district"), text.address_label(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")), F.col("c_mktsegment"), F.lit(None).cast("string")).alias("label"), text.query_key(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" \t Nord "))).alias("query"))


def rewritten_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "stops").select("stop_name").filter("stop_name is not null").distinct()
    return names.select("stop_name", text.rewrite_names(F.col("stop_name"), [("^Plaza ", "Pl. "), ("[0-9]+", "#"), ("  +", " ")]).alias("rewritten"))


def _hex(k: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex((k * 7919) % 16_777_216)), 6, "0"))


def colour_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text colour, luminance and contrast with white of a colour made from each key."""
    rows = table(spark, d, "customer").select("c_custkey", _hex(F.col("c_custkey")).alias("hex"))
    return rows.select("c_custkey", "hex", text.text_colour(F.col("hex")).alias("ink"), numbers.round_decimal(text.luminance(F.col("hex")), 6).alias("luminance"), numbers.round_decimal(text.contrast(F.col("hex"), F.lit("#ffffff")), 4).alias("contrast"))


def heat_colours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 80).cast("double").alias("minutes"))
    return rows.select("c_custkey", colour.heat_colour(F.col("minutes"), 60.0, RAMP).alias("c"), colour.street_width((F.col("c_custkey") % 3).cast("int"), F.col("c_custkey") % 7 / 2).alias("width")).select("c_custkey", "c.r", "c.g", "c.b", "c.a", R._r("width"))


def street_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Colour bucket of each edge of the stand-in street graph."""
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 70).cast("double").alias("minutes")).filter("node % 5 <> 0")
    return raster.edge_buckets(R._street_edges(spark, d), nodes, 60.0).select("a", "b", F.col("bucket").cast("int").alias("bucket"))


def share_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    link = F.concat(F.lit("?d=41.6,0.1&modes=rail,bus,x&iso=30,15,30&max="), (k % 150).cast("string"), F.lit("&dir=to"))
    state = links.parse_state(link, "test", ["bus", "rail"], R.BOX)
    return table(spark, d, "customer").select("c_custkey", state.alias("s")).select("c_custkey", links.serialise_state(F.lit("test"), F.col("s")).alias("link"))


def reach_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the second rule set."""
    k = F.col("c_custkey")
    link = F.concat(F.lit("?from=41.61,0.1&to="), F.when(k % 4 == 0, "x").otherwise("41.7,0.2"), F.lit("&carte="), F.when(k % 2 == 0, "arrivee").otherwise("autre"), F.lit("&bus="), (k % 3).cast("string"), F.lit("&max="), (k % 120).cast("string"), F.lit("&iso=45,7,15,x"))
    s = links.parse_reach_link(link)
    return table(spark, d, "customer").select("c_custkey", s.alias("s")).select("c_custkey", F.col("s.from.lat").alias("from_lat"), F.col("s.to.lat").alias("to_lat"), "s.arrival", "s.bus", "s.max_minutes", F.array_join("s.isochrones", ",").alias("iso"))


def _cities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    routes = table(spark, d, "routes").select(key("route_id").alias("line"), key("agency_id").alias("city")).dropna().groupBy("line").agg(F.min("city").alias("city"))
    trips = table(spark, d, "trips").select(key("route_id").alias("line")).dropna().groupBy("line").agg(F.count("*").alias("trips"))
    lines = routes.join(trips, "line").select("city", "line", F.round(600 / F.col("trips"), 1).alias("peak_headway"), (F.col("trips") % 97).alias("minutes"))
    cities = routes.join(trips, "line").groupBy("city").agg(F.sum("trips").alias("weekday_trips"), F.max("trips").alias("busiest_passages")).withColumn("last_saturday", F.col("weekday_trips") % 86_400)
    return cities, lines


def ranked_cities(spark: SparkSession, d: str) -> DataFrame:
    """The five published rankings, agencies as cities."""
    found = rankings.published_rankings(*_cities(spark, d))
    return found.select("ranking", "rank", "city", F.coalesce("line", F.lit("")).alias("line"), R._r("value"))


def city_positions(spark: SparkSession, d: str) -> DataFrame:
    found = rankings.city_positions(rankings.published_rankings(*_cities(spark, d)))
    return found.select("city", "ranking", "rank", F.coalesce("line", F.lit("")).alias("line"), R._r("value"))


def agency_releases(spark: SparkSession, d: str) -> DataFrame:
    """The release gate over agencies, with metadata made from their names."""
    n = F.length("agency_name")
    agencies = table(spark, d, "agency").select(F.col("agency_id").alias("city"), n.alias("n"))
    metas = agencies.filter("n % 5 <> 0").select("city", F.when(F.col("n") % 3 == 0, "2026-3-1").when(F.col("n") % 2 == 0, "2025-12-31").otherwise("2026-12-31").alias("valid_to"), (F.col("n") % 7 == 0).alias("expired"))
    return checks.release_problems(metas, agencies, date(2026, 3, 2))


def lines_by_mode(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "routes").select(key("route_id").alias("route_id"), text.route_mode(strip("route_type")).alias("mode")).dropna().distinct()
    return routes.groupBy("mode").agg(F.count("*").alias("lines"))


def walk_figures(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of straight and of street walks of so many metres, and metres of so many minutes."""
    m = F.col("p_partkey").cast("double")
    return table(spark, d, "part").select("p_partkey", numbers.round_decimal(geo.walk_minutes(m, 1.3, 75.0), 6).alias("straight"), numbers.round_decimal(geo.street_minutes(m, 75.0), 6).alias("along"), F.lit(geo.walk_limit_m(20.0, 75.0, 1.3, False)).cast("decimal(12,4)").cast("double").alias("limit_m"))


def thinned_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many points of each trip's polyline stay when thinned to 500 m."""
    rows = R.timed_rows(spark, d).join(stop_points(spark, d).withColumnRenamed("key", "stop_id"), "stop_id")
    lines = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "st_id", "lat", "lon"))).alias("r"))
    points = F.transform("r", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return lines.select("trip_id", F.size("r").alias("points"), F.size(geo.thin_line(points, 500.0)).alias("kept"))


def complex_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Stop complexes by their first stop: how many stops each has."""
    stops = stop_points(spark, d).join(table(spark, d, "stops").select(key("stop_id").alias("key"), strip("stop_name").alias("name")).filter("name <> ''").groupBy("key").agg(F.min("name").alias("name")), "key")
    members = variants.stop_complexes(stops.select(F.col("key").alias("stop_id"), "name", "lat", "lon"))[0]
    return members.groupBy("complex_id").agg(F.count("*").alias("stops"))


def transfer_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Median published transfer time per pair of stop and line; times made from the stops' numbers, lines from the trips."""
    served = R.timed_rows(spark, d).join(R.trip_lines(spark, d), "trip_id").select("stop_id", "route_id").distinct()
    stops = served.select("stop_id").distinct()
    n = F.regexp_extract("stop_id", "([0-9]+)$", 1).try_cast("int")
    rows = stops.select(F.col("stop_id").alias("from_stop_id"), F.col("stop_id").alias("to_stop_id"), F.when(n % 5 == 0, "3").when(n % 2 == 0, "2").alias("transfer_type"), F.when(n % 7 == 0, " ").otherwise((n % 300).cast("string")).alias("min_transfer_time"))
    found = variants.published_transfers(rows, served, stops.select("stop_id", F.col("stop_id").alias("complex_id")))
    return found.select("complex_a", "route_a", "route_b", "minutes")


def route_line_stats(spark: SparkSession, d: str) -> DataFrame:
    """Stations and headway of each line from the waits of the second rule set."""
    return variants.line_stats(R.direction_waits_table(spark, d)).select("route_id", "stations", "headway")


def probe_speeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    probes = table(spark, d, "orders").select(k.alias("from_id"), (k + 1).alias("to_id"), (k % 9000).cast("double").alias("metres"), F.when(k % 11 != 0, (k % 70).cast("double")).alias("minutes")).distinct()
    return variants.trip_sanity(probes).select("from_id", R._r("kmh"), "flag")


def markers_at(spark: SparkSession, d: str) -> DataFrame:
    """Which marker each click meets: suppliers are markers, customers clicks, on a screen of 400 by 400."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    markers = table(spark, d, "supplier").select(k.alias("ix"), ((k * 37) % 400).cast("double").alias("x"), ((k * 91) % 400).cast("double").alias("y"))
    clicks = table(spark, d, "customer").select(c.alias("click"), ((c * 53) % 401).cast("double").alias("x"), ((c * 29) % 397).cast("double").alias("y"))
    return places.marker_at(markers, clicks, "touch")


def street_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Shortest street metres between nations' nodes, ends included, and whether the node list is one such way."""
    n = F.col("n_nationkey")
    pairs = table(spark, d, "nation").select(n.alias("route"), n.alias("node_a"), F.lit(10.0).alias("snap_a"), ((n + 5) % 25).alias("node_b"), F.lit(5.0).alias("snap_b"))
    found = search.street_routes(R._street_edges(spark, d), pairs, 915.0)
    steps = found.select("route", "metres", F.explode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] as u, nodes[i] as v))")).alias("s"))
    edges = R._street_edges(spark, d).withColumnRenamed("metres", "m")
    summed = steps.join(edges, (F.least("s.u", "s.v") == F.col("a")) & (F.greatest("s.u", "s.v") == F.col("b"))).groupBy("route", "metres").agg(F.sum("m").alias("walked"))
    return summed.select(F.col("route").cast("int").alias("route"), F.col("metres").cast("long").alias("metres"), (F.col("walked") + 15 == F.col("metres")).alias("exact"))


def street_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Stops joined along streets: nations stand at street nodes, some metres away from them."""
    n = F.col("n_nationkey")
    snaps = table(spark, d, "nation").select(n.alias("stop_ix"), n.cast("long").alias("node"), (n % 10).cast("double").alias("snap_m"))
    walks = search.street_reach(R._street_edges(spark, d), snaps.select(F.col("stop_ix").alias("source"), "node", F.col("snap_m").alias("metres0")), 700.0)
    return search.street_neighbors(walks, snaps, 700.0, 75.0).select("a", "b", R._r("minutes"))


def street_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Least minutes at street nodes: on foot from the origin, or from stops after a ride; nations are origins and stops."""
    n = F.col("n_nationkey")
    walks = search.street_reach(R._street_edges(spark, d), table(spark, d, "nation").select(n.alias("source"), n.cast("long").alias("node"), F.lit(0.0).alias("metres0")), 600.0)
    nations = table(spark, d, "nation").select(n.alias("stop_ix"))
    at_stops = nations.filter("stop_ix < 5").select(F.col("stop_ix").cast("string").alias("origin")).crossJoin(nations.filter("stop_ix % 6 = 1")).withColumn("minutes", 4.0 + F.col("stop_ix") % 3)  # 20 rows
    return search.node_times(at_stops, walks, walks.filter("cast(source as int) < 5"), 75.0).select(F.col("origin").cast("int").alias("origin"), "node", R._r("minutes"))


def countries(spark: SparkSession, d: str) -> DataFrame:
    cities = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("city"), F.col("n_name").alias("country"))
    found = published.cities_by_country(cities)
    return found.select(F.col(found.columns[0]).alias("country"), F.col(found.columns[1]).alias("cities"))


def kept_trips(spark: SparkSession, d: str) -> DataFrame:
    """Trips cut to the stops of a box, where two or more stops are left."""
    inside = stops_in_box(spark, d).withColumnRenamed("key", "stop_id")
    return variants.trips_inside(R.timed_rows(spark, d), inside).groupBy("trip_id").agg(F.count("*").alias("rows"))


def exception_days(spark: SparkSession, d: str) -> DataFrame:
    """Real days named by exceptions, with their weekday (Monday 0)."""
    day = F.date_from_unix_date(real_day(F.col("date")))
    return table(spark, d, "calendar_dates").select(day.alias("day")).dropna().distinct().select(F.col("day").cast("string").alias("day"), F.weekday("day").alias("weekday"))


def delta_coded(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("value"))
    return streets.delta_encode(steps, "value", "p_partkey", ["p_brand"])


QUERIES = {f.__name__: f for f in (
    stop_neighbors, corner_stops, corner_three_stops, network_rides, line_medians, headway_figures, amount_medians, zone_measures, planar_stops, river_crossings, long_segments,
    open_routes, stops_in_box, stops_in_zone, found_stops, date_texts, number_texts, label_texts, rewritten_names, colour_texts, heat_colours, street_buckets, share_links,
    reach_links, ranked_cities, city_positions, agency_releases, lines_by_mode, walk_figures, thinned_lines, complex_sizes, transfer_minutes, route_line_stats, probe_speeds,
    markers_at, street_pairs, street_neighbors, street_minutes, countries, kept_trips, exception_days, delta_coded,
)}
