import random
import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from isotrek.functions import links, numbers, text
from isotrek.operators import checks, rankings, raster, streets, variants
from isotrek.params import ConfigError, parse_city
from isotrek.sources import assets, gtfs, osm
from tests.conftest import rows
from tests.feeds import at

GRID = raster.Grid(-4.72, 41.58, -4.68, 41.62, 200.0)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_rounding(spark):
    data = [(2.675, 2.67), (0.125, 0.12), (1.005, 1.0), (-2.5, -2.5), (0.375, 0.38), (None, None)]
    df = spark.createDataFrame(data, "v double, want double")
    assert all(r[0] == r[1] for r in df.select(numbers.round_half_even(F.col("v"), 2), "want").collect())
    shown = spark.createDataFrame([(0.2,), (0.0,), (2.5,), (61.4,), (None,)], "m double").select(numbers.display_minutes(F.col("m")), numbers.display_duration(F.col("m"))).collect()
    assert [tuple(r) for r in shown] == [(1, "< 1 min"), (0, "< 1 min"), (3, "3 min"), (61, "1 h 01"), (None, None)]
    assert value(spark, numbers.thousands(F.lit(2445))) == "2\u202f445" and value(spark, numbers.decimal_comma(F.lit(4.4))) == "4,4"


def test_names(spark):
    one = lambda f, v: value(spark, f(F.lit(v)))
    assert one(text.display_name, "LYCEE D'ARTAGNAN - GARE SNCF DE LA SAINT-JEAN") == "Lycee d'Artagnan - Gare SNCF de la Saint-Jean"
    assert one(text.display_name, "Already Fine") == "Already Fine" and one(text.display_name, "ABC") == "ABC"
    assert one(text.normalise_name, "  Saint-Jean  d’Arc ") == "saint jean d'arc"
    assert one(text.fold_accents, "Señal ÉÎ e\u0301") == "senal ei e"
    assert value(spark, text.has_all_words(F.lit("Plaza Mayor"), F.lit("mÁyor pla"))) and not value(spark, text.has_all_words(F.lit("Plaza"), F.lit("  ")))
    assert [one(text.route_mode, v) for v in ("0", "109", "715", "1400", "", "x", "6")] == ["tram", "metro", "bus", "funicular", "bus", "bus", "cable"]
    assert one(text.text_colour, "#ffff00") == "#111" and one(text.text_colour, "#000080") == "#fff"
    assert round(value(spark, text.contrast(F.lit("#000000"), F.lit("#ffffff"))), 6) == 21.0
    assert one(text.ordinal_label, "Paris 1") == "1er arrondissement" and one(text.ordinal_label, "Paris") is None


def test_links(spark):
    box = (-5.0, 41.0, -4.0, 42.0)
    def parse(q):
        return value(spark, links.parse_state(F.lit(q), "vll", ["bus", "tram"], box))
    s = parse("?city=vll&o=41.6,-4.7&dir=to&modes=bus,boat&max=200&iso=15,7.6,x,15&d=50,0")
    assert (tuple(s.origin), s.destination, s.direction, s.modes, s.max_minutes, s.isochrones, s.ignored) == ((41.6, -4.7), None, "to", ["bus"], 120, [8, 15], ["d", "modes"])
    assert parse("?city=other&o=41.6,-4.7").ignored == ["city", "o"] and parse("").direction == "from"
    assert parse("?o=41.6,-4.7&" + "x" * 3000).origin is None
    state = links.parse_state(F.lit("?o=41.6,-4.7&max=30"), "vll", ["bus"], box)
    assert value(spark, links.serialise_state(F.lit("vll"), state)) == "city=vll&o=41.60000,-4.70000&dir=from&max=30"


def test_raster_cone(spark):
    minutes = F.col("metres") / 75
    cone = raster.cells_near(GRID, spark.createDataFrame([at(0, 0)], "lat double, lon double"), 1400.0).select("cell", minutes.alias("minutes"))
    n = cone.count()
    assert n == pytest.approx(3.1416 * 7 * 7, rel=0.1)
    smooth = raster.smooth(cone, GRID.cols, GRID.rows)
    assert smooth.count() == n
    rings = raster.contours(GRID, smooth, [8.0, 12.0]).collect()
    for r in rings:
        d = raster._metres((r.lat1, r.lon1), at(0, 0))
        assert abs(d - 75 * r.threshold) < 60
    assert {r.threshold for r in rings} == {8.0, 12.0}
    ends = [p for r in rings if r.threshold == 8.0 for p in ((round(r.lat1, 9), round(r.lon1, 9)), (round(r.lat2, 9), round(r.lon2, 9)))]
    assert all(ends.count(p) == 2 for p in ends)  # closed
    spot = raster.label_spots(raster.contours(GRID, smooth, [8.0]), -5, 41, -4, 42).first()
    assert spot.lat > at(0, 500)[0]
    filled = raster.fill_gaps(cone, GRID.cols, GRID.rows, 1)
    assert filled.count() > n
    covered = raster.coverage(GRID, spark.createDataFrame([at(0, 0)], "lat double, lon double"), 1400.0)
    half = raster.reach_percent(cone, covered, 1400 / 75 / 2 ** 0.5).first().percent
    assert 40 < half < 60 and raster.reach_percent(cone, covered.limit(0), 5).first().percent == 0
    origins = spark.createDataFrame([("o", *at(0, 0))], "origin string, lat double, lon double")
    stops = spark.createDataFrame([(0, *at(1000, 0))], "stop_ix int, lat double, lon double")
    both = raster.time_raster(GRID, origins, spark.createDataFrame([("o", 0, 2.0)], "origin string, stop_ix int, minutes double"), stops, 1 / 75, 300.0, 500.0)
    assert both.count() > 20 and dict(both.dtypes)["minutes"] == "float"
    nodes = spark.createDataFrame([(0, *at(0, 0)), (1, *at(600, 0))], "node int, lat double, lon double")
    timed = spark.createDataFrame([("o", 0, 5.0), ("o", 1, 90.0)], "origin string, node int, minutes double")
    assert raster.street_raster(GRID, timed, nodes, 1 / 75, 150.0).count() > 0
    edges = spark.createDataFrame([(0, 1), (0, 0), (1, 2)], "a int, b int")
    assert rows(raster.edge_buckets(edges, timed.select("node", "minutes"), 60.0)) == [(0, 0, 4), (0, 1, 38), (1, 2, -1)]
    assert raster.heat_samples(cone, GRID.cols, GRID.rows).count() > 9 * n * 0.9
    with pytest.raises(ValueError):
        raster.Grid(1, 0, 0, 1, 10)


def street_input(spark):
    """A ladder of two long streets, one bridge, a loose piece, a repeated segment and a loop."""
    pts = {0: (0, 0), 1: (500, 0), 2: (500, 300), 3: (0, 300), 4: (5000, 5000), 5: (5050, 5000), 6: (250, 300)}
    nodes = spark.createDataFrame([(i, round(at(*p)[0], 5), round(at(*p)[1], 5)) for i, p in pts.items()], "node long, lat double, lon double")
    ways = spark.createDataFrame([(0, [0, 1], 1), (1, [1, 2], 2), (2, [2, 6, 3], 1), (3, [4, 5, 5], 1), (4, [1, 0, 3], 0)], "way long, nodes array<long>, cls int")
    return nodes, ways


def test_street_graph(spark):
    nodes, ways = street_input(spark)
    segs = streets.segments(nodes, ways)
    assert rows(segs.select("a", "b", "way")) == [(0, 1, 0), (0, 3, 4), (1, 2, 1), (2, 6, 2), (4, 5, 3), (6, 3, 2)]
    inner, cut_links = streets.split_long(segs)
    assert cut_links.agg(F.max("metres")).first()[0] <= 60 and inner.count() == cut_links.count() - segs.count()
    assert abs(cut_links.agg(F.sum("metres")).first()[0] - segs.agg(F.sum("metres")).first()[0]) < 1e-6
    assert streets.largest_component(cut_links).count() == 5 + inner.count()
    graph_nodes, edges = streets.build_street_graph(nodes, ways)
    e = edges.collect()
    assert all(r.a < r.b and 1 <= r.metres <= 60 for r in e) and len({(r.a, r.b) for r in e}) == len(e)
    assert abs(sum(r.metres for r in e) - 1600) < 20 and graph_nodes.count() == len({x for r in e for x in (r.a, r.b)}) == len(e)  # one ring
    stops = spark.createDataFrame([("s", *at(250, 20)), ("t", *at(9000, 0))], "key string, lat double, lon double")
    snapped = {r.key: r for r in streets.snap(stops, graph_nodes, 150.0).collect()}
    assert snapped["t"].node_ix is None and snapped["s"].snap_m < 45
    asset = assets.street_asset([(r.lat, r.lon) for r in graph_nodes.orderBy("node_ix").collect()], [(r.a, r.b, r.metres, r.cls, [tuple(p) for p in r.shape]) for r in e], [None, (3, 12.6)])
    back_nodes, back_edges = assets.decode_street_asset(spark, json.loads(assets.canonical(asset)))
    assert rows(back_edges.select("a", "b", "metres", "cls")) == rows(edges.select("a", "b", "metres", "cls")) and asset["stops"] == {"node": [-1, 3], "snap_m": [0, 13]}
    assert rows(back_nodes.select(F.round("lat", 5), F.round("lon", 5))) == rows(graph_nodes.select(F.round("lat", 5), F.round("lon", 5)))
    coded = streets.delta_encode(spark.createDataFrame([(0, 5), (1, 9), (2, 2)], "i int, v int"), "v", "i")
    assert rows(coded) == [(0, 5), (1, 4), (2, -7)] and rows(streets.delta_decode(coded, "v", "i")) == [(0, 5), (1, 9), (2, 2)]


def test_contraction_of_random_trees(spark):
    r = random.Random(8)
    edges = [(i, r.randrange(max(0, i - 4), i)) if r.random() < 0.3 else (i, i - 1) for i in range(1, 200)]
    nodes = spark.createDataFrame([(i, 41.0 + r.random() / 100, -4.0 + r.random() / 100) for i in range(200)], "node long, lat double, lon double")
    links = spark.createDataFrame([(a, b, 5.0 + r.random() * 50, 1) for a, b in edges], "a long, b long, metres double, cls int")
    got, kept = streets.contract(nodes, links, 60.0).collect(), {x.node for x in streets.junctions(links).collect()}
    assert abs(sum(x.metres for x in got) - links.agg(F.sum("metres")).first()[0]) <= len(got) / 2 and all(x.a < x.b and x.metres <= 60 for x in got)
    ends = {x for e in got for x in (e.a, e.b)}
    assert kept <= ends and len(got) == len(ends) - 1 and len(ends) < 200  # a tree stays a tree
    one = spark.createDataFrame([(0, 1, 40.0, 1), (1, 2, 10.0, 1), (2, 3, 15.0, 1), (0, 4, 20.0, 1), (0, 5, 20.0, 1), (3, 6, 9.0, 1), (3, 7, 9.0, 1), (8, 9, 1.0, 1), (9, 10, 1.0, 1), (10, 8, 1.0, 1)], "a long, b long, metres double, cls int")
    assert rows(streets.contract(nodes, one, 60.0).select("a", "b", "metres")) == [(0, 2, 50), (0, 4, 20), (0, 5, 20), (2, 3, 15), (3, 6, 9), (3, 7, 9)]  # the ring 8-9-10 hangs on nothing


def test_components_on_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert rows(streets.components(path).groupBy("component").count()) == [(0, 61), (100, 2)]


def test_rankings(spark):
    calls = [("t1", 1, "A", 100, "0"), ("t1", 2, "B", 200, "1"), ("t1", 3, "C", 300, "0"), ("t2", 1, "A", 150, None), ("t2", 2, "C", 250, None)]
    df = spark.createDataFrame(calls, "trip_id string, seq int, stop_id string, dep int, pickup_type string")
    board = rankings.boardable(df)
    assert rows(board.select("stop_id", "dep")) == [("A", 100), ("A", 150)]
    assert rankings.busiest(board, "stop_id").first().station == "A"
    tie = rankings.busiest(df, "stop_id").first()
    assert tie.station is None and tie.tied == ["A", "C"]
    day = rankings.transport_day(*[spark.createDataFrame([(s,)], "dep int") for s in (13_000, 99_500, 500)])
    assert rows(day) == [(13_000,), (13_100,), (86_900,)]
    ranked = rankings.competition_ranks(spark.createDataFrame([(9,), (7,), (7,), (1,)], "v int"), F.desc("v"))
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == [1, 2, 2, 4]
    patterns = spark.createDataFrame([("L", ["A", "B"], 600)] * 3 + [("L", ["A", "B", "C"], 1500), ("L", ["X"], 9000)], "line string, pattern array<string>, duration int")
    assert rows(rankings.end_to_end(patterns, ["line"])) == [("L", 25, "A", "C")]
    cities = spark.createDataFrame([("x", 90_000, 10, 5), ("y", 80_000, 10, None)], "city string, last_saturday int, busiest_passages int, weekday_trips int")
    lines = spark.createDataFrame([("x", "1", 4.0, 30), ("y", "2", 5.0, 60)], "city string, line string, peak_headway double, minutes int")
    table = rankings.published_rankings(cities, lines)
    assert {(r.ranking, r.city): r["rank"] for r in table.collect()}[("busiest_station", "y")] == 1
    assert {(r.ranking, r["rank"]) for r in rankings.city_positions(table).filter("city = 'y'").collect()} == {("latest_saturday", 2), ("most_frequent_line", 2), ("busiest_station", 1), ("longest_line", 1)}


def test_second_rule_set(spark):
    stops = spark.createDataFrame([("a", "Plaza-Mayor", *at(0, 0)), ("b", "plaza mayor", *at(300, 0)), ("c", "Plaza Mayor", *at(600, 0)), ("d", "Plaza Mayor", *at(5000, 0)), ("e", "Other", *at(0, 0))], "stop_id string, name string, lat double, lon double")
    members, complexes = variants.stop_complexes(stops)
    assert rows(members) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")] and complexes.count() == 3
    times = spark.createDataFrame([("t", "R", "0", 1, "a", 0, 0), ("t", "R", "0", 2, "b", 60, 60), ("t", "R", "0", 3, "x", None, None), ("t", "R", "0", 4, "d", 300, 300), ("t", "R", "0", 5, "e", 500, 500)], "trip string, route_id string, direction string, seq int, stop_id string, arr int, dep int")
    hops = variants.complex_hops(times, members)
    assert rows(hops.select("before", "a", "b", "dep", "arr")) == [("a", "d", "e", 300, 500), (None, "a", "d", 60, 300)]
    assert rows(variants.direction_waits(hops, 60)) == [("a", "R", 15.0), ("d", "R", 15.0)]
    branch = spark.createDataFrame([("R", "0", None, "a", "b", 0, 60)] * 3 + [("R", "0", None, "a", "c", 0, 60)], "route_id string, direction string, before string, a string, b string, dep int, arr int")
    extra = {r.b: r.extra for r in variants.branch_waits(branch, branch, 60.0).collect()}
    assert extra == {"b": round(10 - 7.5, 2), "c": 7.5}  # half headways 10, 15 (clamped from 30) and 7.5
    rivers = spark.createDataFrame([(-1000.0, 0.0, 1000.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    bridges = spark.createDataFrame([(0, 100.0, -5.0, 100.0, 5.0)], "walk long, ax double, ay double, bx double, by double")
    found = variants.bridges_over_rivers(bridges, rivers)
    assert rows(found) == [(100.0, 0.0)]
    walks = spark.createDataFrame([(1, 0.0, -100.0, 0.0, 100.0), (2, 0.0, 10.0, 0.0, 90.0), (3, 900.0, -4000.0, 900.0, 100.0)], "walk long, ax double, ay double, bx double, by double")
    assert [(r.walk, round(r.metres, 3)) for r in variants.river_walks(walks, rivers, found).orderBy("walk").collect()] == [(1, 282.843), (2, 80.0)]
    transfers = spark.createDataFrame([("a", "d", "120", "2"), ("a", "d", "180", None), ("a", "d", "60", "3"), ("a", "d", "", "2")], "from_stop_id string, to_stop_id string, min_transfer_time string, transfer_type string")
    routes = spark.createDataFrame([("a", "R"), ("d", "R"), ("d", "Q")], "stop_id string, route_id string")
    published = variants.published_transfers(transfers, routes, members)
    assert rows(published) == [("a", "R", "d", "Q", 2.5)]
    states = spark.createDataFrame([(0, "a", "R", 5.0, 1.0), (1, "d", "Q", 3.0, 2.0), (2, "a", "P", 4.0, 0.0)], "state int, complex_id string, route_id string, wait double, access double")
    near = spark.createDataFrame([("a", "d", 75.0)], "a string, b string, metres double")
    assert rows(variants.transfer_edges(states, near, published)) == [(0, 1, 5.5), (0, 2, 6.5), (2, 0, 7.5), (2, 1, 7.0)]
    access = spark.createDataFrame([(1, 7, 75.0), (2, 8, 75.0)], "cell int, station int, metres double")
    assert rows(variants.capped_times(access, spark.createDataFrame([(7, 10.0)], "station int, minutes double"))) == [(1, 11.0), (2, 180.0)]
    probe = spark.createDataFrame([("a", "b", 3000.0, 60.0), ("a", "c", 9000.0, 10.0), ("a", "d", 1000.0, None), ("a", "e", 1000.0, 5.0)], "from_id string, to_id string, metres double, minutes double")
    assert [r.flag for r in variants.trip_sanity(probe).orderBy("to_id").collect()] == ["slow", "fast", "unreachable", "ok"]
    open_ = variants.open_routes(spark.createDataFrame([("1", "712", "x", None), ("2", "3", "night", None), ("3", "3", None, "A")], "route_id string, route_type string, route_short_name string, agency_id string"), names=["night"])
    assert rows(open_.select("route_id")) == [("3",)]
    kept = variants.trips_inside(times.withColumnRenamed("trip", "trip_id"), members.filter("stop_id in ('a', 'b')"))
    assert kept.count() == 2


def make_zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)


FILES = {
    "agency.txt": "agency_id\n1\n", "stops.txt": "\ufeffstop_id, stop_name ,stop_lat,stop_lon\r\nS1,\"A, b\",41.6,-4.7\r\n , , ,\r\nS2, B ,41.7,-4.7\r\n", "routes.txt": "route_id,route_type\nR,3\n",
    "trips.txt": "route_id,service_id,trip_id\nR,W,T\n", "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,8:00:00,8:00:00,S1,1\nT,8:05:00,8:05:00,S2,2\n",
    "calendar.txt": "service_id,start_date,end_date\n", "calendar_dates.txt": "service_id,date,exception_type\nW,20261007,1\nW,20261227,1\nW,20270101,2\n",
}


def test_feed_source(spark, tmp_path):
    good = str(tmp_path / "f.zip")
    make_zip(good, FILES)
    feed = gtfs.read_feed(spark, good)
    assert rows(feed["stops"].select("stop_id", "stop_name", "row_no")) == [("S1", "A, b", 0), ("S2", "B", 1)]
    checks.validate_feed(feed)
    assert checks.validity(feed) == (date(2026, 10, 7), date(2026, 12, 27))
    assert checks.check_expiry(date(2026, 12, 27), date(2026, 12, 27)) is False and checks.check_expiry(date(2026, 1, 1), date(2026, 2, 1), True) is True
    with pytest.raises(checks.ExpiredFeed):
        checks.check_expiry(date(2026, 1, 1), date(2026, 2, 1))
    for change, words in (({"stop_times.txt": FILES["stop_times.txt"] + "T,,,S9,3\n"}, ("stop_times", "stop_id", "S9")), ({"routes.txt": "route_id\nR\n"}, ("routes", "route_type")), ({"trips.txt": "route_id,service_id,trip_id\nR,W\n"}, ("trips", "trip_id")), ({"calendar_dates.txt": "service_id,date,exception_type\n"}, ("calendar",))):
        bad = str(tmp_path / "b.zip")
        make_zip(bad, FILES | change)
        with pytest.raises(checks.FeedError) as e:
            checks.validate_feed(gtfs.read_feed(spark, bad))
        assert all(w in str(e.value) for w in words)


@pytest.mark.parametrize("name", ["../x.txt", "/x.txt", "a\\x.txt", "C:/x.txt"])
def test_unsafe_zips(tmp_path, name):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("stops.txt", "a")
        z.writestr(zipfile.ZipInfo("placeholder-name"), "b")
    raw = body.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        z.infolist()[1].orig_filename = name
        with pytest.raises(checks.FeedError):
            gtfs.safe_members(z)
    with zipfile.ZipFile(io.BytesIO(raw)) as z, pytest.raises(checks.FeedError):
        gtfs.safe_members(z, max_bytes=1)


def test_encodings_and_offers():
    with pytest.raises(checks.FeedError):
        list(gtfs.parse_table(b"a\n\xff", "x.txt"))
    assert list(gtfs.parse_table(b"a,b\n1\n1,2,3\n", "x")) == [({"a": "1"}, ["b"]), ({"a": "1", "b": "2"}, [])]
    today, old, new = date(2026, 6, 1), (date(2025, 1, 1), date(2025, 2, 1)), (date(2026, 1, 1), date(2026, 12, 1))
    offers = [checks.Offer("a", old), checks.Offer("b", error="down"), checks.Offer("c", new)]
    assert checks.choose_offer(offers, today).source == "c" and checks.choose_offer(offers[:2], today, True).source == "a"
    with pytest.raises(checks.ExpiredFeed):
        checks.choose_offer(offers[:1], today)
    with pytest.raises(checks.FeedError, match="down"):
        checks.choose_offer(offers[:2], today)


def test_release_gate(spark):
    metas = spark.createDataFrame([("a", "2026-12-01", False), ("b", "2026-01-01", False), ("c", "soon", None), ("d", "2026-12-01", True)], "city string, valid_to string, expired boolean")
    cities = spark.createDataFrame([(c,) for c in "abcde"], "city string")
    assert rows(checks.release_problems(metas, cities, date(2026, 6, 1))) == [("b", "expired"), ("c", "valid_to is no date"), ("d", "marked expired"), ("e", "no metadata")]


def test_map_source(spark):
    way = lambda i, nodes, **tags: {"type": "way", "id": i, "tags": tags, "nodes": nodes, "geometry": [{"lat": 41.6 + n / 1000, "lon": -4.7} for n in nodes]}
    tile1 = {"elements": [way(1, [1, 2], highway="footway"), way(2, [2, 3], highway="motorway"), way(3, [3, 4], highway="service", access="private"), way(4, [3, 4], highway="path", access="no", foot="yes")]}
    tile2 = {"elements": [way(1, [1, 2, 9], highway="primary"), way(5, [5], highway="path"), way(6, [4, 5], highway="service", service="driveway")]}
    found = osm.elements(spark, [tile1, tile2])
    nodes, ways = osm.street_ways(found)
    assert {r.way: (len(r.nodes), r.cls) for r in ways.collect()} == {1: (2, 0), 4: (2, 0)} and nodes.count() == 4
    assert found.filter(osm.walkable(F.col("tags"), live=True)).filter("id = 4").count() == 0
    ring = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    pieces = [[(0, 0), (0, 1)], [(1, 1), (0, 1)], [(1, 1), (1, 0), (0, 0)]]
    assert len(osm.join_rings(pieces)) == 1 and osm.join_rings([[(0, 0), (0, 1)]]) == []
    geo = lambda pts: [{"lat": float(a), "lon": float(b)} for a, b in pts]
    hole = [(0.2, 0.2), (0.2, 0.4), (0.4, 0.4), (0.4, 0.2), (0.2, 0.2)]
    relation = {"type": "relation", "id": 7, "tags": {"natural": "water", "leisure": "park"}, "members": [{"type": "way", "role": "outer", "geometry": geo(p)} for p in pieces] + [{"type": "way", "role": "inner", "geometry": geo(hole)}]}
    park = {"type": "way", "id": 8, "tags": {"leisure": "park"}, "nodes": [1], "geometry": geo(ring)}
    polygons = osm.element_polygons(osm.elements(spark, [{"elements": [relation, park]}]))
    assert {r.id: [len(p) for p in r.polygons] for r in polygons.collect()} == {7: [2], 8: [1]}
    assert rows(osm.basemap(polygons).select("layer", "id")) == [("parks", 8), ("water", 7)]
    with pytest.raises(osm.OsmError):
        osm.boundary(osm.elements(spark, [{"elements": [way(1, [1, 2])]}]), 5)
    assert osm.tiles(0, 0, 0.25, 0.1)[1] == (0, 0.1, 0.1, 0.2) and len(osm.tiles(0, 0, 0.25, 0.1)) == 3


def test_map_servers():
    answers = iter([b'{"remark": "runtime error: timeout", "elements": [1]}', b'{"elements": []}', b'{"elements": [{"type": "way"}]}'])
    pauses = []
    got = osm.ask("q", ["http://a", "http://b"], post=lambda url, data: next(answers), sleep=pauses.append)
    assert got["elements"] and pauses == [5.0]
    with pytest.raises(osm.OsmError):
        osm.ask("q", ["http://a"], rounds=1, post=lambda url, data: b"no json")


def test_assets_and_cache(tmp_path):
    target = tmp_path / "city"
    assets.write_assets({n: {"b": 1, "a": [2]} for n in assets.REQUIRED}, str(target))
    assets.write_assets({n: {"b": 1, "a": [2]} for n in assets.REQUIRED}, str(target))
    assert (target / "meta.json").read_text() == '{"a":[2],"b":1}\n' and set(assets.load_assets(str(target))) == set(assets.REQUIRED)
    with pytest.raises(FileNotFoundError):
        assets.load_assets(str(target), streets=True)
    osm.save_cache({"boundary": {}, "basemap": {"x": 1}}, str(tmp_path / "cache"))
    assert osm.load_cache(str(tmp_path / "cache"))["basemap"] == {"x": 1}
    with pytest.raises(osm.OsmError):
        osm.choose_context(None, str(tmp_path), skip=True, streets=True)
    assert assets.undelta(assets.deltas([5, 3, 9])) == [5, 3, 9]


def test_city_configuration():
    good = {"id": "vll", "bbox": [-5, 41, -4, 42], "center": [41.6, -4.7], "modes": {"walk": {"kind": "walk"}, "bus": {"kind": "transit", "route_types": [3, 11]}, "a": {"kind": "transit", "route_types": [3], "wait": {"max": 9}}}}
    city = parse_city(good, "vll")
    assert city.mode_of_route_type() == {"3": "a", "11": "bus"} and city.modes[0].wait.max == 9 and city.walk.speed_m_per_min == 75
    with pytest.raises(ConfigError) as e:
        parse_city(good | {"id": "x", "bbox": [1], "typo": 1, "modes": {"z": {"kind": "fly"}}}, "vll")
    assert [w in str(e.value) for w in ("bbox", "id", "modes.z.kind", "typo")] == [True] * 4


def test_streams(spark, tmp_path):
    from isotrek.streaming.departures import read_stream, running_headways, windowed_departures

    df = spark.createDataFrame([(f"2026-01-01 08:{m:02}:00", "L") for m in (0, 10, 20, 50)] + [("2026-01-01 12:00:00", "L"), ("2026-01-01 08:05:00", "M")], "ts string, line string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("w", lambda s: windowed_departures(s, "ts", "line"), "append"), ("r", lambda s: running_headways(s, "ts", "line"), "update")):
        q = make(read_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r.departures, r.headway_minutes) for r in spark.sql("select * from w where line = 'L'").collect()] == [(4, 15.0)]
    assert spark.sql("select max(departures) from r where line = 'L'").first()[0] == 5
