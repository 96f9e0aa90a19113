"""OpenStreetMap answers (Overpass JSON) to ways, streets and polygons."""

from __future__ import annotations

import json
import re
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise, product
from pathlib import Path
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotrek.functions.geo import thin_ring
from isotrek.functions.numbers import round_half_even
from isotrek.operators.streets import SCALE, hilbert_numbers
from isotrek.params import City
from isotrek.session import cut, ship

# The ways people walk on, by the class they are drawn in (0 path, 1 minor, 2 main).
ROAD_CLASSES = {
    0: ["footway", "path", "steps", "track", "cycleway"],
    1: ["pedestrian", "living_street", "residential", "service", "unclassified", "road"],
    2: ["tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link"],
}
SHUT_SERVICES = ["parking_aisle", "driveway", "drive-through"]
FOOT_ALLOWED = ["yes", "designated", "permissive"]
TILE_DEG = 0.1
# Public map servers.
ENDPOINTS = ("https://overpass-api.de/api/interpreter", "https://overpass.private.coffee/api/interpreter")
USER_AGENT, ANSWER_SECONDS = "isotrek (transit reach on Spark)", 200
POINT = "struct<lat:double,lon:double>"
ELEMENTS = f"tile int, type string, id long, tags map<string,string>, nodes array<long>, geometry array<{POINT}>, members array<struct<type:string,role:string,geometry:array<{POINT}>>>"


class OsmError(RuntimeError):
    """No usable answer from the map servers or the cache."""


def walkable(tags: Column, live: bool = False) -> Column:
    """Ways a pedestrian may use. The live query is stricter: private access counts as shut whatever foot says."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    allowed = t("highway").isin([h for c in ROAD_CLASSES.values() for h in c]) & F.coalesce(t("foot") != "no", F.lit(True))
    shut = F.coalesce(t("access").isin("no", "private"), F.lit(False))
    if not live:
        shut = shut & ~F.coalesce(t("foot").isin(FOOT_ALLOWED), F.lit(False))
    return F.coalesce(allowed & ~shut & ~F.coalesce(t("service").isin(SHUT_SERVICES), F.lit(False)), F.lit(False))


def road_class(highway: Column) -> Column:
    return F.coalesce(*(F.when(highway.isin(kinds), c) for c, kinds in ROAD_CLASSES.items())).cast("tinyint")


def tiles(west: float, south: float, east: float, north: float, step: float = TILE_DEG) -> list[tuple[float, float, float, float]]:
    """(south, west, north, east) of the tiles of a box, row by row from the south-west."""
    def cuts(low: float, high: float) -> list[float]:
        inner = low + step * np.arange(1, int((high - low) / step) + 1)
        return np.round([low, *inner[inner < high - 1e-9 * step], high], 6).tolist()

    return [(s, w, n, e) for (s, n), (w, e) in product(pairwise(cuts(south, north)), pairwise(cuts(west, east)))]


def street_query(box: tuple[float, float, float, float]) -> str:
    kinds = "|".join(h for c in ROAD_CLASSES.values() for h in c)
    return f'[out:json][timeout:180];way[highway~"^({kinds})$"][foot!~"^no$"][access!~"^(private|no)$"][service!~"^({"|".join(SHUT_SERVICES)})$"]({",".join(map(str, box))});out geom;'


def boundary_query(relation_id: int) -> str:
    return f"[out:json][timeout:120];relation({relation_id});out geom;"


def basemap_query(box: tuple[float, float, float, float]) -> str:
    """Water and parks of a box (south, west, north, east)."""
    at = ",".join(map(str, box))
    return f"[out:json][timeout:180];(nwr[natural=water]({at});nwr[leisure=park]({at}););out geom;"


def _box(box: list[float]) -> str:
    return ",".join(map(str, box))


def _names(values: list[str]) -> str:
    return "|".join(map(re.escape, values))


# Fixed forms: the questions of the second rule set; boxes are (south, west, north, east).
def rail_query(box: list[float], bus_refs: list[str] = (), bus_network: str = "") -> str:
    """Rail relations of a box, and bus lines of one network that are run like a tram."""
    buses = f'relation["route"="bus"]["network"="{bus_network}"]["ref"~"^({_names(bus_refs)})$"]({_box(box)});' if bus_refs else ""
    return f'[out:json][timeout:110];(relation["route"~"^(tram|subway|light_rail|funicular)$"]({_box(box)});{buses});out geom;'


def river_query(box: list[float], names: list[str]) -> str:
    """Rivers by name, with their branches, without tunnels."""
    return f'[out:json][timeout:110];way["waterway"="river"]["name"~"^({_names(names)})( - .*)?$"]["tunnel"!~"."]({_box(box)});out geom;'


def bridge_query(box: list[float]) -> str:
    """Bridges open to pedestrians."""
    return f'[out:json][timeout:110];way["bridge"]["highway"]["highway"!~"^(motorway|motorway_link|trunk|trunk_link|construction|proposed)$"]["foot"!="no"]({_box(box)});out geom;'


def land_query(relations: list[int]) -> str:
    """Neighbouring land by relation."""
    return f"[out:json][timeout:110];({''.join(f'relation({r});' for r in relations)});out geom;"


def _post(url: str, data: bytes) -> bytes:
    with urlopen(Request(url, data, {"User-Agent": USER_AGENT}), timeout=ANSWER_SECONDS) as answer:
        return answer.read()


def ask(query: str, endpoints: Iterable[str] = ENDPOINTS, rounds: int = 3, pause: float = 5.0, post: Callable[[str, bytes], bytes] | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The first good answer of the endpoints, tried in turn with growing pauses; runtime errors inside an answer and answers without elements are no good."""
    post = post or _post
    faults = []
    for turn in range(rounds):
        for endpoint in endpoints:
            try:
                answer = json.loads(post(endpoint, urlencode({"data": query}).encode()))
                if answer.get("elements") and "runtime error" not in str(answer.get("remark", "")):
                    return answer
                faults.append(f"{endpoint}: {answer.get('remark') or 'no elements'}")
            except (URLError, OSError, ValueError) as e:
                faults.append(f"{endpoint}: {e}")
        if turn + 1 < rounds:
            sleep(pause * 2**turn)
    raise OsmError("; ".join(faults))


def elements(spark: SparkSession, answers: list[dict]) -> DataFrame:
    """The elements of answers, one per tile in order, with a fixed schema."""
    lines = [json.dumps(e | {"tile": i}) for i, a in enumerate(answers) for e in a.get("elements", [])]
    return spark.createDataFrame([(x,) for x in lines], "line string").select(F.from_json("line", ELEMENTS).alias("e")).select("e.*")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of saved answers (files of JSON objects with an ``elements`` array), the files in name order as tiles."""
    element = T.StructType([f for f in T._parse_datatype_string(ELEMENTS).fields if f.name != "tile"])
    raw = spark.read.schema(T.StructType([T.StructField("elements", T.ArrayType(element))])).option("multiLine", True).json(path)
    named = raw.select(F.input_file_name().alias("file"), F.explode("elements").alias("e"))
    order = named.select("file").distinct().orderBy("file")
    numbered = order.select("file", F.dense_rank().over(Window.orderBy("file")).alias("tile"))
    return named.join(F.broadcast(numbered), "file").select("tile", "e.*")


def street_ways(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, lat, lon), ways (way, nodes, cls)): walkable ways, the first tile's copy of each, nodes renumbered along a Hilbert curve.

    Ways whose node and position counts differ, or with fewer than two nodes, or with a node of unknown
    position, are dropped. Coordinates are rounded to 5 decimals.
    """
    ways = found.filter((F.col("type") == "way") & walkable(F.col("tags")) & (F.size("nodes") == F.size("geometry")) & (F.size("nodes") >= 2))
    first = ways.groupBy("id").agg(F.min_by(F.struct("nodes", "geometry", "tags"), "tile").alias("w")).select("id", "w.*")
    placed = first.select(F.explode(F.arrays_zip("nodes", "geometry")).alias("p")).filter("p.geometry is not null").groupBy(F.col("p.nodes").alias("osm")).agg(F.first("p.geometry").alias("g"))
    nodes = placed.select("osm", round_half_even(F.col("g.lat"), 5).alias("lat"), round_half_even(F.col("g.lon"), 5).alias("lon"))
    steps = first.select("id", F.posexplode("nodes").alias("pos", "osm"))
    lost = steps.join(nodes, "osm", "left_anti").select("id").distinct()
    kept = steps.join(lost, "id", "left_anti")
    used = nodes.join(kept.select("osm").distinct(), "osm", "left_semi")
    numbers = hilbert_numbers(used.withColumnRenamed("osm", "node"))
    renamed = kept.join(numbers.withColumnRenamed("node", "osm"), "osm").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_ix"))).alias("n"))
    classes = first.select("id", road_class(F.try_element_at("tags", F.lit("highway"))).alias("cls"))
    ways_out = renamed.join(classes, "id").select(F.col("id").alias("way"), F.col("n.node_ix").alias("nodes"), "cls")
    return used.join(numbers.withColumnRenamed("node", "osm"), "osm").select(F.col("node_ix").alias("node"), "lat", "lon"), ways_out


def cached_streets(spark: SparkSession, part: dict) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, lat, lon), ways (way, nodes, cls)) of a cached street map: a saved answer, or packed as delta-coded positions in 1e-5 degrees, ways and classes."""
    if "elements" in part:
        nodes, ways = street_ways(elements(spark, [part]))
    else:
        running = lambda values: np.cumsum(values, dtype="int64").tolist()
        places = [(i, a / SCALE, b / SCALE) for i, (a, b) in enumerate(zip(running(part["lat"]), running(part["lon"])))]
        nodes = spark.createDataFrame(places, "node int, lat double, lon double")
        ways = spark.createDataFrame([(i, running(w), c) for i, (w, c) in enumerate(zip(part["ways"], part["cls"]))], "way long, nodes array<int>, cls tinyint")
    if ways.isEmpty():
        raise OsmError("the street map has no walkable way")
    return nodes, ways


def cached_boundary(spark: SparkSession, part: dict) -> dict:
    """(id, polygons) of a cached boundary, as it is published: rings of [lat, lon], the outer one first."""
    if "elements" not in part:
        return part
    ids = [e["id"] for e in part["elements"] if e.get("type") == "relation"]
    if not ids:
        raise OsmError("the boundary's answer holds no relation")
    found = boundary(elements(spark, [part]), ids[0]).orderBy("id").collect()
    return {"id": ids[0], "polygons": [[[[v.lat, v.lon] for v in ring] for ring in polygon] for row in found for polygon in row.polygons]}


def join_rings(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from open ways joined end to end, whichever way they run; drops what does not close or has under four points.

    An index of end points tells which ways meet, so the work grows with the points. A ring begins with
    the last way that is left and takes the first way that touches one of its ends, its far end first.
    """
    left = {i: way for i, way in enumerate(ways) if len(way) > 1}
    touching: dict[tuple[float, float], list[int]] = defaultdict(list)
    for i in reversed(left):
        for end in {left[i][0], left[i][-1]}:
            touching[end].append(i)  # the first way lies on top

    def first_at(point: tuple[float, float]) -> int | None:
        stack = touching[point]
        while stack and stack[-1] not in left:
            stack.pop()
        return stack[-1] if stack else None

    rings = []
    while left:
        ring = deque(left.popitem()[1])
        while ring[0] != ring[-1]:
            meeting = [i for i in (first_at(ring[-1]), first_at(ring[0])) if i is not None]
            if not meeting:
                break
            way = left.pop(min(meeting))
            if ring[-1] in (way[0], way[-1]):
                ring.extend(way[1:] if way[0] == ring[-1] else reversed(way[:-1]))
            else:
                ring.extendleft(way[1:] if way[0] == ring[0] else reversed(way[:-1]))
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(list(ring))
    return rings


def _holds(ring: list[tuple[float, float]], point: tuple[float, float]) -> bool:
    lat, lon = point
    inside = False
    for (a, p), (b, q) in zip(ring, ring[1:]):
        inside ^= (a > lat) != (b > lat) and lon < p + (lat - a) / ((b - a) or 1) * (q - p)
    return inside


def element_polygons(found: DataFrame, min_distance_m: float = 15.0) -> DataFrame:
    """(id, tags, polygons): polygons of closed ways and of relations; inner rings go to each outer one that holds their first point. Rings are thinned and rounded to 5 decimals."""
    ship(found.sparkSession)
    rings = f"id long, tags map<string,string>, polygons array<array<array<{POINT}>>>"

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = lambda g: [(p["lat"], p["lon"]) for p in (g if g is not None else ()) if p is not None]
        for batch in batches:
            out = []
            for kind, id_, tags, geometry, members in zip(*(batch[c] for c in ("type", "id", "tags", "geometry", "members"))):
                if kind == "way":
                    line = points(geometry)
                    polygons = [[line]] if len(line) > 3 and line[0] == line[-1] else []
                else:
                    parts = [m for m in (members if members is not None else ()) if m["type"] == "way" and m["geometry"] is not None and len(m["geometry"])]
                    of = lambda inner: join_rings([points(m["geometry"]) for m in parts if (m["role"] == "inner") == inner])
                    inners = of(True)
                    polygons = [[outer, *(r for r in inners if _holds(outer, r[0]))] for outer in of(False)]
                if polygons:
                    out.append((id_, tags, [[[{"lat": a, "lon": b} for a, b in r] for r in p] for p in polygons]))
            yield pd.DataFrame(out, columns=["id", "tags", "polygons"])

    whole = found.select("type", "id", F.to_json("tags").alias("tags"), "geometry", "members").filter("type in ('way', 'relation')")
    raw = whole.mapInPandas(assemble, rings.replace("tags map<string,string>", "tags string"))
    thin = lambda r: F.transform(thin_ring(r, min_distance_m), lambda p: F.struct(round_half_even(p["lat"], 5).alias("lat"), round_half_even(p["lon"], 5).alias("lon")))
    return raw.select("id", F.from_json("tags", "map<string,string>").alias("tags"), F.transform("polygons", lambda p: F.transform(p, thin)).alias("polygons"))


def boundary(found: DataFrame, relation_id: int, min_distance_m: float = 15.0) -> DataFrame:
    """(id, polygons) of a boundary relation; an error if no ring of it closes."""
    polygons = element_polygons(found.filter(F.col("type") == "relation"), min_distance_m).select("id", "polygons")
    if polygons.isEmpty():
        raise OsmError(f"relation {relation_id}: no closed ring")
    return polygons


def basemap(polygons: DataFrame) -> DataFrame:
    """(layer, id, polygons): water, parks or neither by tags; water wins where both are tagged."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    layer = F.when(t("natural") == "water", "water").when(t("leisure") == "park", "parks")
    return polygons.select(layer.alias("layer"), "id", "polygons").filter("layer is not null")


CACHE_PARTS = ("boundary", "basemap", "streets")
NO_BOUNDARY, NO_BASEMAP = {"id": None, "polygons": []}, {"parks": [], "water": []}


def cached_basemap(spark: SparkSession, part: dict) -> dict:
    """(water, parks) of a cached basemap, as it is published: polygons of rings of [lat, lon]."""
    if "elements" not in part:
        return NO_BASEMAP | part
    layers: dict[str, list] = {"parks": [], "water": []}
    for row in basemap(element_polygons(elements(spark, [part]))).orderBy("layer", "id").collect():
        layers[row.layer] += [[[[v.lat, v.lon] for v in ring] for ring in polygon] for polygon in row.polygons]
    return layers


def pack_streets(nodes: DataFrame, ways: DataFrame) -> dict:
    """street_ways in the form that is cached: positions in 1e-5 degrees and node numbers, both as differences; one city's map fits a driver."""
    places, rows = nodes.orderBy("node").collect(), ways.orderBy("way").collect()
    steps = lambda values: np.diff(np.asarray([0, *values], "int64")).tolist()
    fixed = lambda c: steps([round(p[c] * SCALE) for p in places])
    return {"lat": fixed("lat"), "lon": fixed("lon"), "ways": [steps(r.nodes) for r in rows], "cls": [r["cls"] for r in rows]}


def fetch_streets(spark: SparkSession, bbox: tuple[float, float, float, float], fetch: Callable[[str], dict] = ask) -> dict:
    """The walkable ways of a box (west, south, east, north), asked for tile by tile, in the cached form."""
    nodes, ways = street_ways(elements(spark, [fetch(street_query(tile)) for tile in tiles(*bbox)]))
    packed = pack_streets(cut(nodes), cut(ways))
    if not packed["ways"]:
        raise OsmError("no walkable way in the box of the city")
    return packed


def fetch_live(spark: SparkSession, city: City, fetch: Callable[[str], dict] = ask) -> dict[str, dict]:
    """All parts of a city's map from the map servers; streets only for a city that walks along them."""
    west, south, east, north = city.bbox
    relation = (city.other.get("boundary") or {}).get("osm_relation_id")
    parts = {
        "boundary": cached_boundary(spark, fetch(boundary_query(relation))) if relation else NO_BOUNDARY,
        "basemap": cached_basemap(spark, fetch(basemap_query((south, west, north, east)))),
    }
    return parts | ({"streets": fetch_streets(spark, city.bbox, fetch)} if city.walk.streets else {})


def save_cache(parts: dict[str, dict], folder: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, value in parts.items():
        Path(folder, f"{name}.json").write_text(json.dumps(value, sort_keys=True, separators=(",", ":")) + "\n", encoding="utf-8")


def load_cache(folder: str) -> dict[str, dict]:
    """The saved parts; streets may be absent."""
    parts = {}
    for name in CACHE_PARTS:
        path = Path(folder, f"{name}.json")
        if path.exists():
            parts[name] = json.loads(path.read_text(encoding="utf-8"))
        elif name != "streets":
            raise OsmError(f"{path}: not cached")
    return parts


def choose_context(live: Callable[[], dict] | None, folder: str, refresh: bool = False, skip: bool = False, streets: bool = False) -> tuple[dict, str, str | None]:
    """(parts, source, warning): the cache if it has what the city needs and no refresh is asked for, else live, else the cache after all.

    Skipping is refused for a city that walks along streets. Without ``live`` only the cache can serve.
    """
    if skip:
        if streets:
            raise OsmError("a city that walks along streets needs the street map")
        return {}, "skipped", None
    fault = None
    try:
        parts = load_cache(folder)
        if streets and "streets" not in parts:
            parts, fault = None, OsmError(f"{folder}: the cache has no street map, which a city that walks along streets needs")
    except OsmError as e:
        parts, fault = None, e
    if parts is not None and not (refresh and live):
        return parts, "cache", None
    if live is None:
        raise fault
    try:
        return live(), "live", None
    except OsmError as e:
        if parts is None:
            raise OsmError(f"{e}; {fault}") from None
        return parts, "cache", f"map servers failed, using the cache: {e}"
