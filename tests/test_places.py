import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrek.functions.colour import heat_colour, street_width
from isotrek.operators import places
from isotrek.operators.route_states import route_itineraries, route_states, station_minutes, steps_to
from tests.conftest import rows
from tests.feeds import BASE, at
from tests.test_spatial import box, zone

POLYGONS = "polygons array<array<array<struct<lat:double,lon:double>>>>"


def test_names_and_districts(spark):
    stops = spark.createDataFrame([("a", "Bus Stop", False, *at(50, 0)), ("r", "Station", True, *at(300, 0)), ("r2", "Far Station", True, *at(9000, 0)), ("b", "Bus 2", False, *at(0, 90))], "key string, name string, rail boolean, lat double, lon double")
    points = spark.createDataFrame([("p", *at(0, 0)), ("q", *at(2000, 0)), ("far", 0.0, 0.0)], "key string, lat double, lon double")
    assert rows(places.nearest_stop_names(points, stops)) == [("p", "Station"), ("q", "Station")]
    city = zone([box(41, -5, 42, -4)])
    zones = spark.createDataFrame([("city", 2, city), ("inner", 1, zone([box(41.599, -4.702, 41.601, -4.698)]))], f"zone_id string, priority int, {POLYGONS}")
    assert rows(places.districts(points, zones)) == [("p", "inner"), ("q", "city")]
    names = spark.createDataFrame([("city", "Town"), ("inner", "Centre")], "zone_id string, zone_name string")
    assert rows(places.describe_places(points, stops, zones, names, "Town")) == [("p", "near Station (Centre)"), ("q", "near Station")]
    assert rows(places.served_districts(stops, zones)) == [("city", 4)]
    assert [r.name for r in places.find_stops(stops, "státion far").collect()] == ["Far Station"]
    areas = spark.createDataFrame([("water", 1, city, False), ("water", 2, zone([box(41, -4, 41.0015, -3.9985)]), True), ("parks", 3, zone([box(41, -4, 41.002, -3.998)]), None)], f"layer string, id int, {POLYGONS}, lagoon boolean")
    assert rows(places.kept_areas(areas, 41.5, -4.5).select("id", "masked")) == [(1, True), (2, True), (3, False)]


def test_geocoder_replies(spark):
    feature = lambda lon, lat, **p: {"geometry": {"coordinates": [lon, lat]}, "properties": p}
    import json

    body = json.dumps({"features": [feature(-4.7, 41.6, name="Plaza", city="Town"), feature(-4.7, 41.6, name="Plaza", city="Town"), feature(9.0, 9.0, name="Away"), {"geometry": {}}, feature(-4.71, 41.6, street="Calle", housenumber="3", postcode="47001", village="V")]})
    got = places.geocoder_places(spark.createDataFrame([("q", body), ("bad", "no json")], "query string, body string"), (-5, 41, -4, 42)).collect()
    assert [(r.query, [x.label for x in r.results], r.outside) for r in got] == [("q", ["Plaza, Town", "Calle 3, 47001 V"], 1)]


def test_route_states(spark):
    stations = spark.createDataFrame([(0, *at(0, 0)), (1, *at(3000, 0)), (2, *at(6000, 0))], "station int, lat double, lon double")
    states = spark.createDataFrame([(0, 0, "M", 2.0, 1.0, True), (1, 1, "M", 2.0, 1.0, True), (2, 1, "B", 5.0, 0.0, False), (3, 2, "B", 5.0, 0.0, False)], "state int, station int, route_id string, wait double, access double, rail boolean")
    edges = spark.createDataFrame([(0, 1, 8.0, 3.0), (1, 2, 7.5, 0.0), (2, 3, 4.0, 0.0)], "src int, dst int, weight double, extra_wait double")
    net = route_states(states, edges, stations)
    total, steps = steps_to(net, at(0, 0), at(6000, 75))
    assert [s["kind"] for s in steps] == ["walk", "ride", "walk", "ride", "walk"] and steps[1]["wait"] == 5.0
    assert sum(s["minutes"] + s["wait"] for s in steps) == pytest.approx(total, abs=1e-6)
    assert total == pytest.approx(1 + 2 + 8 + 7.5 + 4 + 1, abs=1e-3)
    origins = spark.createDataFrame([("o", *at(0, 0))], "origin string, lat double, lon double")
    minutes = {r.station: r.minutes for r in station_minutes(net, origins).collect()}
    assert minutes[1] == pytest.approx(12.0, abs=1e-3)
    assert set(r.station for r in station_minutes(route_states(states, edges, stations, rail_only=True), origins).collect()) == {0, 1}
    trips = spark.createDataFrame([("t", *at(0, 0), *at(6000, 75)), ("w", *at(0, 0), *at(0, 150))], "trip string, lat double, lon double, to_lat double, to_lon double")
    assert {r.trip: (round(r.total, 2), len(r.steps)) for r in route_itineraries(net, trips).collect()} == {"t": (round(total, 2), 5), "w": (2.0, 1)}
    assert np.isfinite(total) and BASE


def test_colours(spark):
    ramp = [(0.0, (0, 0, 0)), (0.5, (100, 0, 0)), (1.0, (100, 200, 0))]
    df = spark.createDataFrame([(15.0,), (45.0,), (63.0,), (70.0,), (None,), (float("nan"),)], "m double")
    assert [tuple(r[0]) for r in df.select(heat_colour(F.col("m"), 60.0, ramp)).collect()] == [(50, 0, 0, 255), (100, 100, 0, 255), (100, 200, 0, 170), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert spark.range(1).select(street_width(F.lit(2), F.lit(100.0)), street_width(F.lit(0), F.lit(0.1))).first() == (6.0, 0.4)


def test_markers_and_links(spark):
    from pyspark.sql import functions as F

    from isotrek.functions.links import parse_reach_link, serialise_reach
    from isotrek.operators.places import marker_at

    markers = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 6.0), (2, 6.0, 0.0), (3, 500.0, 0.0)], "ix int, x double, y double")
    clicks = spark.createDataFrame([("tie", 3.0, 3.0), ("edge", 500.0, 10.0), ("out", 500.0, 10.01), ("none", -90.0, -90.0)], "click string, x double, y double")
    assert dict(map(tuple, marker_at(markers, clicks).collect())) == {"tie": 2, "edge": 3, "out": None, "none": None}
    assert dict(map(tuple, marker_at(markers, clicks, "touch").collect()))["out"] == 3 and marker_at(markers, clicks.limit(0)).collect() == []
    texts = ["?from=41.5,-4.7&to=41,2&carte=arrivee&bus=1&max=45&iso=45,15", "?to=x&carte=arrivee&max=95&iso=0", "", None]
    states = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_reach_link(F.col("t")).alias("s"))
    got = [r for r in states.select("s.*", serialise_reach(F.col("s")).alias("link")).collect()]
    assert got[0].link == "from=41.50000,-4.70000&to=41.00000,2.00000&carte=arrivee&bus=1&max=45&iso=15,45" and got[0].arrival and got[0].bus
    assert (got[1].to, got[1].arrival, got[1].max_minutes, got[1].isochrones, got[1].link) == (None, False, 60, [], "iso=0") and got[2].link == "" and got[3].max_minutes == 60


def test_second_rule_set_configuration(tmp_path):
    import json

    from isotrek.params import load_second_city
    from isotrek.sources import osm

    (tmp_path / "x.json").write_text(json.dumps({"slug": "x", "defaultFrom": {"lat": 47.21, "lon": -1.55}, "country": "BE", "osmBbox": [1, 2, 3, 4]}))
    city = load_second_city("x", str(tmp_path))
    assert city["geocoder"] == "photon" and city["osmRailBbox"] == [1, 2, 3, 4] and city["parksBbox"] == [47.15, -1.63, 47.27, -1.47] and city["lat0"] == 47.21 and city["railGeometry"] == "gtfs"
    assert "route" in osm.rail_query([1, 2, 3, 4], ["G", "H+"], "N") and "H\\+" in osm.rail_query([1, 2, 3, 4], ["G", "H+"], "N") and "bus" not in osm.rail_query([1, 2, 3, 4])
    assert "( - .*)?$" in osm.river_query([1, 2, 3, 4], ["La Loire"]) and "bridge" in osm.bridge_query([1, 2, 3, 4]) and osm.land_query([5, 6]).count("relation(") == 2


def test_seeds_around_a_river(spark):
    import numpy as np

    from isotrek.operators.route_states import around_rivers, solve

    rivers, bridges = np.array([[50.0, -1000.0, 50.0, 1000.0]]), np.array([[50.0, 900.0]])
    got = around_rivers(np.array([0.0, 0.0]), np.array([[40.0, 0.0], [60.0, 0.0], [60.0, 900.0], [60.0, 1500.0]]), rivers, bridges)
    assert got[0] == 40.0 and abs(got[1] - (np.hypot(50, 900) + np.hypot(10, 900))) < 1e-9 and abs(got[2] - (np.hypot(50, 900) + 10)) < 1e-9
    assert np.isinf(around_rivers(np.array([0.0, 0.0]), np.array([[60.0, 0.0]]), rivers, bridges, 1000.0)[0]) and np.isinf(around_rivers(np.array([0.0, 0.0]), np.array([[60.0, 0.0]]), rivers, np.zeros((0, 2)))[0])
    states = spark.createDataFrame([(0, 0, "R", 2.0, 0.0, True), (1, 1, "R", 2.0, 0.0, True)], "state int, station int, route_id string, wait double, access double, rail boolean")
    edges = spark.createDataFrame([], "src int, dst int, weight double, extra_wait double")
    stations = spark.createDataFrame([(0, 0.0, 60 / 111_320), (1, 0.0, -100 / 111_320)], "station int, lat double, lon double")
    water = spark.createDataFrame([(50.0, -5000.0, 50.0, 5000.0)], "x1 double, y1 double, x2 double, y2 double")
    for river, want in ((None, {0, 1}), (water, {1})):
        net = route_states(states, edges, stations, rivers=river, origin=(0.0, 0.0))
        assert set(solve(net, 0.0, 0.0)[3]) == want
