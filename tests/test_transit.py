import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrek.operators import network, search, service_days, stats
from isotrek.operators.itinerary import describe_leg, itineraries, route_line
from isotrek.params import City, Mode, Query, Wait, Walk, Window
from tests.conftest import rows
from tests.feeds import BASE, at, feed, six_an_hour

CITY = City("t", (-5.0, 41.0, -4.0, 42.0), BASE, Walk(1.0, 75, 1000, 400), (Mode("bus", ("3",), Wait(0.5, 1, 15), 1.5), Mode("tram", ("0",), Wait(0.5, 1, 15), 2.0)), Window("08:00", "09:00"))
STOPS = {"A": (0, 0), "B": (3000, 0), "C": (3150, 0), "D": (3150, 4000), "E": (6000, 0)}


@pytest.fixture(scope="module")
def net(spark):
    trips = six_an_hour("L1", [("A", 0), ("B", 6), ("E", 10)]) + six_an_hour("L2", [("C", 1), ("D", 9)]) + [("L1", "1", [("B", 5), ("A", None), ("E", 9)])]
    f = feed(spark, STOPS, trips, {"L2": "0"})
    return network.build_network(f, f["trips"].select("service_id").distinct(), CITY)


def test_network_tables(net):
    assert rows(net.lines.select("line_id", "mode")) == [("L1:0", "bus"), ("L2:0", "tram")]  # a stop without a time breaks the chain
    assert rows(net.stops.select("stop_ix", "stop_id")) == [(0, "A"), (1, "B"), (2, "C"), (3, "D"), (4, "E")]
    assert rows(net.rides) == [(0, 0, 1, 6.0), (0, 1, 4, 4.0), (1, 2, 3, 8.0)]
    assert rows(net.waits.select("stop_ix", "line_ix", "departures", "headway", "wait"))[0] == (0, 0, 6, 10.0, 5.0)
    assert [(r.a, r.b, round(r.minutes, 6)) for r in net.neighbors.orderBy("a").collect()] == [(1, 2, 2.0), (2, 1, 2.0)]


def test_search_rules(spark, net):
    arrays = search.net_arrays(net, CITY)
    origins = spark.createDataFrame([("o", *at(0, 0)), ("far", *at(50_000, 0)), ("null", None, 1.0)], "origin string, lat double, lon double")
    got = {(r.origin, r.stop_ix): r.minutes for r in search.stop_times(arrays, origins).collect()}
    # wait 5 + ride 6; then change: penalty 2 + walk 2 + wait 5 + ride 8; A cannot be left after riding
    assert {k: round(v, 6) for k, v in got.items()} == {("o", 1): 11.0, ("o", 4): 15.0, ("o", 3): 28.0}
    only_bus = {r.stop_ix for r in search.stop_times(arrays, origins, modes=("bus",)).collect()}
    assert only_bus == {1, 4} and search.stop_times(arrays, origins, modes=()).collect() == []
    back = {r.stop_ix: round(r.minutes, 6) for r in search.stop_times(arrays, spark.createDataFrame([("d", *at(3150, 4000))], "origin string, lat double, lon double"), reverse=True).collect()}
    assert back == {2: 13.0, 0: 28.0}
    points = spark.createDataFrame([("D", *at(3150, 4000)), ("near", *at(0, 150)), ("beyond", *at(0, 1500))], "point string, lat double, lon double")
    times = {r.point: round(r.minutes, 3) for r in search.point_times(search.stop_times(arrays, origins), net.stops, origins, points, CITY.walk).collect()}
    assert times == {"D": 28.0, "near": 2.0}
    longer = {r.point for r in search.point_times(search.stop_times(arrays, origins), net.stops, origins, points, CITY.walk, 2000).collect()}
    assert longer == {"D", "near", "beyond"}


def test_itinerary_totals_and_legs(spark, net):
    arrays = search.net_arrays(net, CITY)
    trips = spark.createDataFrame([("x", *at(0, 75), *at(3150, 4075)), ("walk", *at(0, 0), *at(0, 750)), ("none", *at(0, 0), *at(0, 90_000))], "trip string, lat double, lon double, to_lat double, to_lon double")
    got = {r.trip: r for r in itineraries(arrays, trips).collect()}
    assert set(got) == {"x", "walk"} and [leg.type for leg in got["walk"].legs] == ["walk"]
    assert [leg.type for leg in got["x"].legs] == ["walk", "wait", "ride", "transfer", "wait", "ride", "walk"]
    assert abs(sum(leg.minutes for leg in got["x"].legs) - got["x"].total) < 1e-9 and abs(got["x"].total - 30.0) < 1e-3
    reverse = itineraries(arrays, trips.filter("trip = 'x'").select("trip", F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")), reverse=True).first()
    assert abs(reverse.total - got["x"].total) < 1e-9 and [leg.type for leg in reverse.legs] == [leg.type for leg in got["x"].legs]
    assert itineraries(arrays, trips, scale_minutes=20.0).count() == 1
    names, lines = F.create_map(*(F.lit(x) for i in range(5) for x in (i, f"Stop {i}"))), F.create_map(F.lit(0), F.lit("L1"), F.lit(1), F.lit("L2"))
    texts = [r[0] for r in itineraries(arrays, trips.filter("trip = 'x'")).select(F.explode("legs").alias("l")).select(describe_leg(F.col("l"), names, lines)).collect()]
    assert texts[2] == "Ride L1 to Stop 1, 6 min" and texts[3].startswith("Change at Stop 2")


def random_net(spark, seed):
    r = random.Random(seed)
    stops = {f"S{i:02}": (r.randrange(0, 4000), r.randrange(0, 4000)) for i in range(14)}
    trips = []
    for line in range(5):
        calls, minute = [], 0
        for s in r.sample(sorted(stops), 5):
            calls.append((s, minute))
            minute += r.randrange(1, 9)
        trips += six_an_hour(f"L{line}", calls)
    f = feed(spark, stops, trips, {"L0": "0", "L3": "0"})
    return network.build_network(f, f["trips"].select("service_id").distinct(), CITY)


@pytest.mark.parametrize("seed", [1, 2])
def test_kernel_equals_joins_on_random_networks(spark, seed):
    net = random_net(spark, seed)
    arrays = search.net_arrays(net, CITY)
    origins = [(f"o{i}", *at(700 * i, 900 * i)) for i in range(5)]
    df = spark.createDataFrame(origins, "origin string, lat double, lon double")
    kernel = {(r.origin, r.stop_ix): r.minutes for r in search.stop_times(arrays, df).collect()}
    seeds = [(o, f"S:{s}", m) for o, lat, lon in origins for s, m in search.walkable_stops(arrays, lat, lon)]
    relaxed = search.relaxed_stop_times(search.state_edges(net, CITY), spark.createDataFrame(seeds, "origin string, state string, minutes double"))
    joins = {}
    for r in relaxed.filter("state like 'R:%'").collect():
        k = (r.origin, int(r.state.split(":")[1]))
        joins[k] = min(joins.get(k, np.inf), r.minutes)
    assert kernel.keys() == joins.keys() and len(kernel) > 10
    assert max(abs(kernel[k] - joins[k]) for k in kernel) < 1e-9


def test_streets_along_nodes(spark):
    edges = spark.createDataFrame([(0, 1, 100), (0, 2, 300), (1, 2, 50)], "a long, b long, metres int")
    sources = spark.createDataFrame([("0", 0, 10.0), ("1", 2, 200.0)], "source string, node long, metres0 double")
    walks = search.street_reach(edges, sources, 160.0)
    assert rows(walks) == [("0", 0, 10.0), ("0", 1, 110.0), ("0", 2, 160.0)]
    snaps = spark.createDataFrame([(0, 0, 10.0), (1, 2, 5.0)], "stop_ix int, node long, snap_m double")
    assert rows(search.street_neighbors(walks, snaps, 165.0, 75.0)) == [(0, 1, 2.2)]
    at_stops = spark.createDataFrame([("o", 0, 7.0)], "origin string, stop_ix int, minutes double")
    assert rows(search.node_times(at_stops, walks, walks.filter("false"), 10.0)) == [("o", 0, 8.0), ("o", 1, 18.0), ("o", 2, 23.0)]
    shaped = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 1.0, [(0.0, 0.5)]), (1, 2, 0.0, 1.0, 1.0, 1.0, [])], "a long, b long, lat_a double, lon_a double, lat_b double, lon_b double, shape array<struct<lat:double,lon:double>>")
    line = route_line(spark.createDataFrame([("r", [2, 1, 0])], "route string, nodes array<long>"), shaped).first().points
    assert [tuple(p) for p in line] == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.5), (0.0, 0.0)]


def test_line_geometry_sources(spark):
    lines = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "line_id string")
    pts = "array<struct<lat:double,lon:double>>"
    got = network.line_geometry(
        lines, spark.createDataFrame([("a", "s2"), ("a", "s1"), ("b", "missing")], "line_id string, shape_id string"), spark.createDataFrame([("s1", [(1.0, 1.0), (2.0, 2.0)]), ("s2", [(3.0, 3.0)])], f"shape_id string, points {pts}"),
        spark.createDataFrame([("b", [(5.0, 5.0), (6.0, 6.0)])], f"line_id string, points {pts}"), spark.createDataFrame([("c", ["x", "y"]), ("c", ["x", "y"]), ("c", ["y"])], "line_id string, pattern array<string>"),
        spark.createDataFrame([("x", 7.0, 7.0), ("y", 8.0, 8.0)], "stop_id string, lat double, lon double"),
    )
    assert {r.line_id: (r.source, len(r.points or [])) for r in got.collect()} == {"a": ("shapes", 2), "b": ("osm", 2), "c": ("stops", 2), "d": (None, 0)}


def test_calendar_rules(spark):
    f = feed(spark, {"A": (0, 0)}, [("L", "0", [("A", 0)])])
    cal = f["calendar"]
    dates = spark.createDataFrame([(1, "W", "20260105", "2"), (2, "W", "20260105", "1"), (3, "W", "20260106", "2"), (4, "X", "20260103", "1"), (5, "W", "20260107", "9"), (6, "W", "bad", "2"), (7, None, "20260105", "1")], "n int, service_id string, date string, exception_type string")
    days = service_days.service_days(cal, dates, "n")
    running = {(r.service_id, str(r.day)) for r in days.filter("day < '2026-01-09'").collect()}
    assert running == {("W", f"2026-01-0{d}") for d in (1, 2, 5, 7, 8)} | {("X", "2026-01-03")}
    other = service_days.service_days(cal, dates, "n", other_types_remove=True)
    assert ("W", "2026-01-07") not in {(r.service_id, str(r.day)) for r in other.filter("day < '2026-01-09'").collect()}
    today = F.to_date(F.lit("2026-01-05"))
    assert str(service_days.reference_day(days, f["trips"], today).first().day) == "2026-01-07"
    assert str(service_days.reference_day(days, f["trips"], F.to_date(F.lit("2030-01-01"))).first().day) == "2026-01-01"
    assert str(service_days.next_service_saturday(days, F.to_date(F.lit("2026-01-01"))).first().day) == "2026-01-03"
    assert str(service_days.typical_day(days, f["trips"]).first().day) == "2026-01-01"
    assert service_days.reference_day(days.limit(0), f["trips"], today).collect() == []


def test_statistics(spark):
    w = spark.createDataFrame([(10.0, 1.0), (20.0, 0.5), (20.0, 0.5), (30.0, 0.0), (None, 5.0)], "v double, w double")
    assert rows(stats.weighted_median(w, "v", "w")) == [(15.0,)]
    assert stats.weighted_median(w.limit(0), "v", "w").collect() == []
    medians = spark.createDataFrame([(0, 60.0), (1, 10.0), (2, 12.0)], "line_ix int, median_min double")
    assert rows(stats.headway_summary(medians)) == [(11.0, 10.0)]  # weights 1/60, 1/10, 1/12: exactly half at 10, so the middle to 12
    assert rows(stats.headway_summary(medians.limit(0))) == [(None, None)]
    times = spark.createDataFrame([("o", "a", 10.0), ("o", "b", 31.0), ("p", "a", 30.0), ("p", "b", 1.0)], "origin string, point string, minutes double")
    points, origins = spark.createDataFrame([("a",), ("b",), ("c",)], "point string"), spark.createDataFrame([("o",), ("p",)], "origin string")
    assert rows(stats.reach_share(times, points, origins, 30)) == [(50.0, 2)]


def test_city_stats(spark, net):
    share = spark.createDataFrame([(50.0, 1)], "percent_stops double, origins long")
    row = stats.usable(stats.city_stats(net.waits, net.lines, net.stops, share, 30, stats.scope(False, False))).first()
    assert (row.stops, row.lines, row.reach.scope, row.headway.best_min) == (5, 2, "served", 10.0)


def test_query_state():
    from isotrek.params import reduce_query, stale_parts

    q = Query(origin=(1, 2), modes=("bus",))
    assert reduce_query(q, "direction", "from") is q
    everything = Query()
    assert reduce_query(everything, "toggle_mode", "bus", CITY).modes == ("tram",) and reduce_query(everything, "toggle_mode", "ferry", CITY) is everything
    assert reduce_query(everything, "travel", "walk", CITY).modes == () and reduce_query(reduce_query(q, "travel", "walk", CITY), "travel", "transit", CITY).modes == ("bus", "tram") and reduce_query(q, "travel", "transit", CITY) is q
    assert reduce_query(q, "invert").direction == "to" and reduce_query(reduce_query(q, "invert"), "invert") == q
    assert reduce_query(q, "max_minutes", 9999).max_minutes == 120 and reduce_query(q, "max_minutes", 12.5).max_minutes == 13 and reduce_query(q, "max_minutes", float("nan")) is q
    assert reduce_query(q, "origin", (0.0, 0.0), CITY) is q and reduce_query(q, "origin", BASE, CITY).origin == BASE and reduce_query(q, "destination", None) is q
    with pytest.raises(ValueError):
        reduce_query(q, "zoom")
    walk = reduce_query(q, "toggle_mode", "bus")
    assert walk.modes == () and walk.direct_minutes == 60 and q.direct_minutes is None
    assert stale_parts(q, reduce_query(q, "max_minutes", 30)) == {"paint", "trip"}
    assert "times" in stale_parts(walk, reduce_query(walk, "max_minutes", 30)) and stale_parts(q, q) == set()


def test_itineraries_along_streets(spark):
    """A river with one bridge: every walk goes over it, totals equal street_point_times, and the walks are drawn."""
    from isotrek.operators.itinerary import street_walks, walked_legs

    walk = Walk(1.3, 75, 1300, 400, "streets")
    places = {0: (0, 0), 1: (0, 300), 2: (600, 300), 3: (600, 0), 4: (3000, 0), 5: (3000, 350), 6: (3400, 350)}
    pairs = [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)]
    span = {(a, b): int(abs(places[a][0] - places[b][0]) + abs(places[a][1] - places[b][1])) for a, b in pairs}
    edges = spark.createDataFrame([(a, b, m) for (a, b), m in span.items()], "a long, b long, metres int")
    shaped = spark.createDataFrame([(a, b, *at(*places[a]), *at(*places[b]), []) for a, b in pairs], "a long, b long, lat_a double, lon_a double, lat_b double, lon_b double, shape array<struct<lat:double,lon:double>>")
    f = feed(spark, {"A": (600, 0), "B": (3000, 0), "C": (3400, 350), "D": (9000, 0)}, six_an_hour("L", [("A", 0), ("B", 6)]) + six_an_hour("M", [("C", 2), ("D", 9)]))
    net = network.build_network(f, f["trips"].select("service_id").distinct(), CITY)
    snaps = spark.createDataFrame([(0, 3, 5.0), (1, 4, 5.0), (2, 6, 10.0)], "stop_ix int, node long, snap_m double")
    walks = search.street_reach(edges, snaps.select(F.col("stop_ix").alias("source"), "node", F.col("snap_m").alias("metres0")), 1300.0)
    net.neighbors = search.street_neighbors(walks, snaps, 800.0, 75.0)
    arrays = search.net_arrays(net, City("t", CITY.bbox, BASE, walk, CITY.modes, CITY.window))
    ends = spark.createDataFrame([("x", 0, 20.0, 5, 30.0), ("near", 0, 20.0, 1, 0.0), ("lost", 0, 20.0, None, None)], "trip string, node_a long, snap_a double, node_b long, snap_b double")
    trips = spark.createDataFrame([("x", *at(0, -20), *at(3000, 380)), ("near", *at(0, -20), *at(0, 300)), ("lost", *at(0, 0), *at(50_000, 0))], "trip string, lat double, lon double, to_lat double, to_lon double")
    got = {r.trip: r for r in itineraries(arrays, trips, walked=street_walks(edges, ends, snaps, walk)).collect()}
    assert set(got) == {"x", "near"} and abs(got["near"].total - 320 / 75) < 1e-9
    assert [leg.type for leg in got["near"].legs] == ["walk"] and [leg.type for leg in got["x"].legs] == ["walk", "wait", "ride", "walk"]
    assert abs(got["x"].total - (1225 / 75 + 5 + 6 + 385 / 75)) < 1e-9 and abs(sum(leg.minutes for leg in got["x"].legs) - got["x"].total) < 1e-9
    stops = spark.createDataFrame([("x", 0, 20.0, 5, 30.0), ("near", 0, 20.0, 1, 0.0)], "trip string, from_node long, from_snap double, to_node long, to_snap double")
    found = itineraries(arrays, trips, walked=street_walks(edges, ends, snaps, walk))
    drawn = {(r.trip, r.leg): (r.metres, len(r.points)) for r in walked_legs(found, stops, edges, snaps, shaped, 1300.0).collect()}
    assert drawn == {("x", 0): (1225.0, 4), ("x", 3): (385.0, 2), ("near", 0): (320.0, 2)}
    turned = trips.select("trip", F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    back_ends = ends.select("trip", F.col("node_b").alias("node_a"), F.col("snap_b").alias("snap_a"), F.col("node_a").alias("node_b"), F.col("snap_a").alias("snap_b"))
    back = {r.trip: r for r in itineraries(arrays, turned, reverse=True, walked=street_walks(edges, back_ends, snaps, walk)).collect()}
    assert back.keys() == got.keys() and all(abs(back[k].total - got[k].total) < 1e-9 and [x.type for x in back[k].legs] == [x.type for x in got[k].legs] for k in got)
