import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from isotrek import build, commands
from isotrek.operators import published
from isotrek.operators.checks import release_problems
from isotrek.operators.rankings import city_rankings
from isotrek.params import parse_city
from isotrek.sources import assets, osm
from tests.conftest import rows
from tests.feeds import at
from tests.test_more import make_zip
from tests.test_spatial import box, zone

CITY = {"id": "mini", "bbox": [-5, 41, -4, 42], "center": [41.6, -4.7], "window": {"start": "07:00", "end": "20:00"}, "modes": {"walk": {"kind": "walk"}, "bus": {"kind": "transit", "route_types": [3]}}}
FILES = {
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nS1,One,41.6,-4.7\nS2,Two,41.65,-4.7\nS3,Three,41.7,-4.7\nS4,Four,41.75,-4.7\n",
    "routes.txt": "route_id,route_short_name,route_type\nA,1,3\nB,2,3\nC,3,3\n",
    "trips.txt": "route_id,service_id,trip_id\nA,W,t1\nB,W,t2\nC,W,t3\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,8:00:00,8:00:00,S1,1\nt1,8:05:00,8:05:00,S2,2\nt2,9:00:00,9:00:00,S2,1\nt2,9:10:00,9:10:00,S3,2\nt3,10:00:00,10:00:00,S3,1\nt3,10:07:00,10:07:00,S4,2\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,1,1,1,1,0,0,20260101,20271231\n",
}


def test_build(spark, tmp_path, capsys):
    feed, city, out = tmp_path / "f.zip", tmp_path / "mini.json", tmp_path / "out"
    make_zip(str(feed), FILES)
    city.write_text(json.dumps(CITY))
    run = lambda *a: build.main([str(city), "--gtfs", str(feed), "--out", str(out), *a], spark)
    assert run("--today", "2026-03-02") == 0
    first = {p.name: p.read_bytes() for p in (out / "mini").iterdir()}
    graph, meta, stats = (json.loads(first[f"{n}.json"]) for n in ("graph", "meta", "stats"))
    assert graph["rides"] == [[0, 0, 1, 5.0], [1, 1, 2, 10.0], [2, 2, 3, 7.0]] and graph["waits"] == [[0, 0, 15], [1, 1, 15], [2, 2, 15]] and graph["neighbors"] == [[], [], [], []]
    assert graph["stops"][0] == {"id": "S1", "lat": 41.6, "lon": -4.7, "name": "One"} and graph["lines"][0] == {"direction": "0", "id": "A:0", "long_name": "", "mode": "bus", "name": "1", "route_id": "A"}
    assert graph["modes"] == {"bus": {"enabled_default": True, "kind": "transit", "route_types": [3], "transfer_min": 1.5, "wait": {"factor": 0.5, "max": 15, "min": 1}}}
    assert graph["walk"] == {"detour_factor": 1.0, "kind": "walk", "max_access_m": 1000, "max_transfer_walk_m": 400, "speed_m_per_min": 75} and graph["reference_date"] == "2026-03-03"
    assert meta["reference_date"] == "2026-03-03" and stats["stops"] == 4 and stats["headway"]["typical_min"] == 780 and stats["feed"] == meta["feed"]
    assert meta["feed"] == {"expired": False, "source": "f.zip", "valid_from": "2026-01-01", "valid_to": "2027-12-31"} and meta["city"] == {"id": "mini", "name": "mini"} and meta["osm"] == {"source": "skipped"}
    assert json.loads(first["walk.json"])["n"] == 0 and json.loads(first["basemap.json"]) == {"parks": [], "water": []} and json.loads(first["boundary.json"]) == {"id": None, "polygons": []}
    metas = spark.createDataFrame([(meta["city"]["id"], meta["feed"]["valid_to"], meta["feed"]["expired"])], "city string, valid_to string, expired boolean")
    assert release_problems(metas, metas.select("city"), date(2026, 3, 2)).collect() == [] and release_problems(metas, metas.select("city"), date(2028, 3, 2)).count() == 1
    assert run("--today", "2026-03-02") == 0
    again = {p.name: p.read_bytes() for p in (out / "mini").iterdir()}
    assert {k: v for k, v in first.items() if k != "meta.json"} == {k: v for k, v in again.items() if k != "meta.json"}
    assert run("--today", "2030-01-01") == 2 and "expired" in capsys.readouterr().err
    assert run("--today", "2030-01-01", "--allow-expired") == 0 and "warning" in capsys.readouterr().err
    city.write_text(json.dumps(CITY | {"bbox": []}))
    assert run("--today", "2026-03-02") == 1


STREET_STOPS = {"S1": (0, 0), "S2": (300, 0), "S3": (0, 200), "S4": (5000, 0)}
STREET_FILES = FILES | {
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"{s},{s},{at(*p)[0]},{at(*p)[1]}\n" for s, p in STREET_STOPS.items()),
    "routes.txt": "route_id,route_short_name,route_type\nA,1,3\nB,2,3\n",
    "trips.txt": "route_id,service_id,trip_id,shape_id\nA,W,t1,sh\nB,W,t2,\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,8:00:00,8:00:00,S1,1\nt1,8:10:00,8:10:00,S4,2\nt2,9:00:00,9:00:00,S2,1\nt2,9:10:00,9:10:00,S3,2\n",
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nsh,41.6,-4.64,10\nsh,41.6,-4.7,2\nsh,41.61,-4.66,9\n",
}


def test_build_along_streets(spark, tmp_path, capsys):
    feed, city, cache = tmp_path / "f.zip", tmp_path / "mini.json", str(tmp_path / "cache")
    make_zip(str(feed), STREET_FILES)
    city.write_text(json.dumps(CITY | {"center": list(at(0, 0)), "modes": CITY["modes"] | {"walk": {"kind": "walk", "network": "streets"}}}))
    run = lambda out: build.main([str(city), "--gtfs", str(feed), "--out", str(tmp_path / out), "--osm-cache", cache, "--today", "2026-03-02"], spark)
    places = [at(*p) for p in ((0, 0), (0, 500), (300, 500), (300, 0))]
    packed = {"lat": assets.deltas([round(p[0] * 1e5) for p in places]), "lon": assets.deltas([round(p[1] * 1e5) for p in places]), "ways": [[0, 1, 1, 1]], "cls": [1]}
    west = [[list(at(*p)) for p in ((-50, -50), (100, -50), (100, 550), (-50, 550), (-50, -50))]]
    osm.save_cache({"boundary": {"id": None, "polygons": []}, "basemap": {}}, cache)
    assert run("none") == 1 and "street map" in capsys.readouterr().err and not (tmp_path / "none" / "mini").exists()
    osm.save_cache({"streets": packed}, cache)
    assert run("open") == 0 and "line B:0: straight stop segments" in capsys.readouterr().err
    got = assets.load_assets(str(tmp_path / "open" / "mini"), streets=True)
    near = got["graph"]["neighbors"]  # four edges of 56 m from the corner and a snap of 22 m
    assert [[b for b, _ in n] for n in near] == [[2], [], [0], []] and all(abs(n[0][1] - (4 * 56 + 22.5) / 75) < 0.02 for n in near if n)
    assert got["stats"]["reach"]["scope"] == "streets" and got["stats"]["reach"]["percent_stops"] == 50.0 and 70 < got["stats"]["reach"]["percent_nodes"] < 85
    assert got["walk"]["stops"]["node"][3] == -1 and min(got["walk"]["stops"]["node"][:3]) >= 0 and 1290 <= sum(got["walk"]["m"]) <= 1310
    assert got["lines"]["lines"][0] == {"id": "A:0", "mode": "bus", "source": "shapes", "points": [[41.6, -4.7], [41.61, -4.66], [41.6, -4.64]]}
    assert got["lines"]["lines"][1]["source"] == "stops" and len(got["lines"]["lines"][1]["points"]) == 2
    way = {"type": "way", "id": 7, "tags": {"highway": "residential"}, "nodes": [1, 2, 3, 4], "geometry": [{"lat": a, "lon": b} for a, b in places]}
    osm.save_cache({"streets": {"elements": [way]}, "boundary": {"id": 1, "polygons": [west]}}, cache)
    assert run("west") == 0
    west_got = assets.load_assets(str(tmp_path / "west" / "mini"), streets=True)
    assert west_got["walk"] == got["walk"] and west_got["stats"]["reach"]["percent_stops"] == 100.0 and west_got["stats"]["reach"]["percent_nodes"] == 100.0
    far = [[list(at(*p)) for p in ((9000, 0), (9100, 0), (9100, 100), (9000, 0))]]
    with pytest.raises(build.FeedError, match="none of the stops"):
        build.confined(spark.createDataFrame([at(0, 0)], "lat double, lon double"), [far], "stops")


def test_build_inside_a_boundary(spark, tmp_path):
    feed, city, cache = tmp_path / "f.zip", tmp_path / "mini.json", str(tmp_path / "cache")
    make_zip(str(feed), STREET_FILES)
    city.write_text(json.dumps(CITY | {"center": list(at(0, 0))}))
    ring = [{"lat": at(*p)[0], "lon": at(*p)[1]} for p in ((-50, -50), (6000, -50), (6000, 100), (-50, 100), (-50, -50))]
    relation = {"type": "relation", "id": 5, "members": [{"type": "way", "role": "outer", "geometry": ring}]}
    osm.save_cache({"boundary": {"elements": [relation]}, "basemap": {}}, cache)
    assert build.main([str(city), "--gtfs", str(feed), "--out", str(tmp_path), "--osm-cache", cache, "--today", "2026-03-02"], spark) == 0
    got = assets.load_assets(str(tmp_path / "mini"))
    assert got["boundary"]["id"] == 5 and len(got["boundary"]["polygons"][0][0]) == 5
    assert got["stats"]["reach"] == {"threshold_min": 30, "origins": 1, "scope": "boundary", "percent_stops": 100.0}


def test_commands(spark, tmp_path, capsys):
    feed, cities, data = tmp_path / "f.zip", tmp_path / "cities", tmp_path / "data"
    make_zip(str(feed), FILES)
    cities.mkdir()
    (cities / "mini.json").write_text(json.dumps(CITY))
    run = lambda *a: commands.main(["--today", "2026-03-02", *map(str, a)], spark, ask=lambda q: {"elements": []})
    assert run("fetch", cities / "mini.json", "--gtfs", feed, "--out", tmp_path / "got") == 0
    note = json.loads((tmp_path / "got" / "mini.manifest.json").read_text())
    assert note["valid_to"] == "2027-12-31" and note["bytes"] == feed.stat().st_size and len(note["sha256"]) == 64 and not note["expired"]
    assert commands.main(["--today", "2030-01-01", "fetch", str(cities / "mini.json"), "--gtfs", str(feed), "--out", str(tmp_path / "got")], spark) == 2
    assert run("lint", cities) == 0 and run("release", data, cities) == 1 and "mini: no metadata" in capsys.readouterr().err
    (data / "mini").mkdir(parents=True)
    (data / "mini" / "meta.json").write_text(json.dumps({"feed": {"valid_to": "2027-12-31", "expired": False}}))
    assert run("release", data, cities) == 0
    assert run("map", cities / "mini.json", "--out", tmp_path / "map") == 0 and json.loads((tmp_path / "map" / "basemap.json").read_text()) == {"parks": [], "water": []}
    (cities / "bad.json").write_text("{}")
    assert run("lint", cities) == 1


def test_city_rankings(spark):
    rows_ = [("t1", "L", "0", 1, "A", "a", 28_900, 28_900, "0"), ("t1", "L", "0", 2, "B", "b", 29_500, 29_500, "0"), ("t1", "L", "0", 3, "C", "c", 30_100, 30_100, "0"), ("t2", "L", "0", 1, "A", "a", 90_000, 90_000, None), ("t2", "L", "0", 2, "B", "b", 90_600, 90_600, None)]
    day = spark.createDataFrame(rows_, "trip_id string, route_id string, direction string, seq int, stop_id string, name string, arr int, dep int, pickup_type string")
    found = city_rankings(day, day.limit(0), day.limit(0), spark.createDataFrame([("a",)], "name string"))
    assert tuple(found["busiest"].first()) == ("a", [], 2) and found["trips"].first()[0] == 2
    line = found["lines"].first()
    assert (line.route_id, line.peak_passages, line.peak_headway, line.minutes, line.first_stop, line.last_stop) == ("L", 1, 60.0, 20, "A", "C")
    centre = found["centre"].first()
    assert (centre.first_time, centre.last_time) == ("08:01", "01:00 (+1)")


def test_street_asset_in_the_published_form(spark):
    asset = {
        "schema": 1, "scale": 100000, "n": 3, "lat": [4160000, 100, 0], "lon": [-470000, 100, 100], "deg": [2, 1, 0], "to": [1, 2, 1], "m": [100, 300, 50], "cls": [1, 2, 0],
        "geo": [0, 0, 1], "glat": [5], "glon": [-3], "stops": {"node": [1, -1], "snap_m": [7, 0]},
    }
    nodes, edges = assets.decode_street_asset(spark, asset)
    assert [(r.lat, r.lon) for r in nodes.orderBy("node_ix").collect()] == [(41.6, -4.7), (41.601, -4.699), (41.601, -4.698)]
    got = [(r.a, r.b, r.metres, r.cls, [tuple(p) for p in r.shape]) for r in edges.orderBy("a", "b").collect()]
    assert got == [(0, 1, 100, 1, []), (0, 2, 300, 2, []), (1, 2, 50, 0, [(41.60105, -4.69903)])]
    assert assets.street_asset([(41.6, -4.7), (41.601, -4.699), (41.601, -4.698)], got, [(1, 7.2), None]) == asset


def test_map_from_servers(spark, tmp_path):
    way = lambda i, hw, *pts: {"type": "way", "id": i, "tags": {"highway": hw}, "nodes": [n for n, _, _ in pts], "geometry": [{"lat": a, "lon": b} for _, a, b in pts]}
    ring = [{"lat": a, "lon": b} for a, b in ((41.5, -4.8), (41.5, -4.6), (41.8, -4.6), (41.5, -4.8))]
    asked = []

    def answer(query):
        asked.append(query)
        if "relation" in query:
            return {"elements": [{"type": "relation", "id": 7, "members": [{"type": "way", "role": "outer", "geometry": ring}]}]}
        if "natural=water" in query:
            return {"elements": [{"type": "way", "id": 3, "tags": {"natural": "water", "leisure": "park"}, "geometry": ring}, {"type": "way", "id": 4, "tags": {"leisure": "garden"}, "geometry": ring}]}
        return {"elements": [way(1, "residential", (10, 41.6, -4.7), (11, 41.601, -4.7)), way(2, "motorway", (10, 41.6, -4.7), (12, 41.7, -4.7))]}

    raw = CITY | {"boundary": {"osm_relation_id": 7}, "bbox": [-4.8, 41.55, -4.65, 41.65], "modes": CITY["modes"] | {"walk": {"kind": "walk", "network": "streets"}}}
    parts = osm.fetch_live(spark, parse_city(raw), answer)
    assert len(asked) == 4 and len(osm.tiles(*raw["bbox"])) == 2 and len(parts["basemap"]["water"]) == 1 and parts["basemap"]["parks"] == [] and parts["boundary"]["id"] == 7
    assert parts["streets"] == {"lat": [4160000, 100], "lon": [-470000, 0], "ways": [[0, 1]], "cls": [1]}
    folder = str(tmp_path / "c")
    live = lambda: osm.fetch_live(spark, parse_city(raw), answer)
    assert osm.choose_context(live, folder, streets=True)[1:] == ("live", None)
    osm.save_cache({k: v for k, v in parts.items() if k != "streets"}, folder)
    assert osm.choose_context(live, folder, streets=True)[1] == "live" and osm.choose_context(live, folder)[1] == "cache"
    osm.save_cache(parts, folder)

    def down():
        raise osm.OsmError("down")

    assert osm.choose_context(down, folder, refresh=True, streets=True)[1] == "cache" and "down" in osm.choose_context(down, folder, refresh=True)[2]
    with pytest.raises(osm.OsmError):
        osm.choose_context(down, str(tmp_path / "empty"))


def test_published(spark):
    pts = "array<struct<lat:double,lon:double>>"
    line, other = [(0.0, 0.0), (0.0, 0.01)], [(0.0, 0.0), (0.0, 0.02)]
    shapes = spark.createDataFrame([("s1", line), ("s2", line), ("s3", other), ("s4", [(0.0, 0.0)])], f"shape_id string, points {pts}")
    uses = spark.createDataFrame([("s1", "R"), ("s2", "R"), ("s3", "R"), ("s1", "Q"), ("s4", "Q")], "shape_id string, route_id string")
    assert rows(published.rail_shapes(shapes, uses).select("route_id", "shape_id")) == [("Q", "s1"), ("R", "s1"), ("R", "s3")]
    relations = spark.createDataFrame([(2, "T1", [(7, "", line), (8, "platform", line)]), (1, "tram 1", [(7, None, other)])], f"id long, ref string, members array<struct<ref:bigint,role:string,geometry:{pts}>>")
    got = published.rail_relations(relations, spark.createDataFrame([("T1", "R")], "name string, route_id string"), {"tram 1": "T1"})
    assert [(r.way, r.points[-1].lon) for r in got.collect()] == [(7, 0.02)]
    body = json.dumps({"features": [{"properties": {"name": "N", "name:fr": "F"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]]]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]})
    found = published.geojson_polygons(spark.createDataFrame([(body,)], "body string")).collect()
    assert len(found) == 1 and len(found[0].polygons[0][0]) == 4
    assert spark.range(1).select(published.commune_names(F.create_map(F.lit("name"), F.lit("N"), F.lit("name:fr"), F.lit("F")))).first()[0] == "F"
    areas = spark.createDataFrame([(1, zone([box(0, 0, 1, 1)])), (2, zone([box(5, 5, 6, 6)]))], "id int, polygons array<array<array<struct<lat:double,lon:double>>>>")
    assert rows(published.overlapping(areas, (0.5, 0.5, 2, 2)).select("id")) == [(1,)] and tuple(published.view_box(areas, 1.0).first()) == (-1.0, -1.0, 7.0, 7.0)
    cells = spark.createDataFrame([("a", 0.5, 0.5), ("b", 5.5, 5.5), ("c", 9.0, 9.0)], "key string, lat double, lon double")
    land, water = areas.select(F.col("id").cast("string").alias("zone_id"), "polygons"), areas.filter("id = 2").select(F.lit("w").alias("zone_id"), "polygons")
    assert rows(published.on_land(cells, land, water).select("key")) == [("a",)]
    cities = spark.createDataFrame([("x", "fr", None), ("y", "fr", "http://y"), ("z", "be", None)], "city string, country string, external_url string")
    built = published.built_cities(cities, cities.filter("city <> 'y'"), cities.filter("city <> 'z'"))
    assert rows(built.select("city")) == [("x",)] and rows(published.ranked_cities(cities, built).select("city")) == [("x",), ("y",)]
    assert rows(published.cities_by_country(cities)) == [("be", 1), ("fr", 2)]
    lines = spark.createDataFrame([("x", "2", 5.0), ("x", "1", 5.0), ("x", "3", 9.0)], "city string, name string, headway double")
    assert rows(published.fastest_lines(lines)) == [("x", "1", 5.0)]
    feeds = published.feed_list(spark.createDataFrame([("x", "u", "l")], "city string, url string, licence string"), spark.createDataFrame([("x", "e", "v", "l")], "city string, feed string, url string, licence string"))
    assert [r.feed for r in feeds.collect()] == ["main", "e"]
    manifests = spark.createDataFrame([("s", "t", 1, "h")], "source string, fetched_at string, bytes int, sha256 string")
    row = published.provenance("x", F.lit("2026-01-01"), manifests, spark.createDataFrame([("bus",), ("bus",), ("tram",)], "mode string"), cities).first()
    assert row.lines_by_mode == {"bus": 2, "tram": 1} and row.stations == 3
    stats = spark.createDataFrame([("x", "2026-01-01", 9, 50, "Far", [("1", 5.0)])], "city string, reference_date string, stations int, within_30 int, farthest string, lines array<struct<name:string,headway:double>>")
    assert "30 min: 50 %" in published.control_rows(stats).first().line and "1:5" in published.control_rows(stats).first().line


