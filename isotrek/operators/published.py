"""What is published beside the network: provenance, feed lists, rail geometry, districts, figures for pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.functions.geo import polygon_bounds, thin_line, thin_ring
from isotrek.functions.numbers import round_half_even
from isotrek.functions.text import ordinal_label

LINE_M, RING_M = 25.0, 45.0
GEOJSON = "struct<features:array<struct<properties:map<string,string>,geometry:string>>>"
POINT = "struct<lat:double,lon:double>"


def rail_shapes(shapes: DataFrame, uses: DataFrame) -> DataFrame:
    """(route_id, shape_id, points): one line per distinct course of a route: shapes (shape_id, points) of uses (shape_id, route_id), thinned, those with the same sampled set of points kept once (the first by id)."""
    thin = shapes.select("shape_id", thin_line(F.col("points"), LINE_M).alias("points")).filter(F.size("points") >= 2)
    step = F.greatest(F.lit(1), F.floor(F.size("points") / 20).cast("int"))
    coarse = lambda p: F.struct(round_half_even(p["lat"], 4).alias("lat"), round_half_even(p["lon"], 4).alias("lon"))
    course = F.array_sort(F.array_distinct(F.transform(F.filter("points", lambda p, i: i % step == 0), coarse)))
    keyed = thin.join(uses.distinct(), "shape_id").withColumn("course", course)
    first = Window.partitionBy("route_id", "course").orderBy("shape_id")
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("route_id", "shape_id", "points")


def rail_relations(relations: DataFrame, names: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(route_id, way, points): map ways of line relations (id, ref, members array<struct<ref:bigint,role:string,geometry:array<point>>>) for routes (name, route_id) by their (aliased) ref, each way once a route, from the relation of the smallest id; ways with a role are left out."""
    alias = F.lit(None).cast("string")
    for ref, name in (aliases or {}).items():
        alias = F.when(F.col("ref") == ref, name).otherwise(alias)
    named = relations.withColumn("name", F.coalesce(alias, "ref")).join(names, "name")
    ways = named.select("route_id", "id", F.explode("members").alias("m")).filter("coalesce(m.role, '') = '' and size(m.geometry) >= 2")
    first = ways.groupBy("route_id", F.col("m.ref").alias("way")).agg(F.min_by("m.geometry", "id").alias("g"))
    return first.select("route_id", "way", thin_line(F.col("g"), LINE_M).alias("points"))


def geojson_polygons(files: DataFrame, min_distance_m: float = RING_M) -> DataFrame:
    """(properties, polygons) of feature collections (body): polygons and multipolygons as closed thinned rings; rings of fewer than four points are dropped."""
    each = files.select(F.explode(F.from_json("body", GEOJSON)["features"]).alias("f")).select("f.properties", F.get_json_object("f.geometry", "$.type").alias("type"), F.get_json_object("f.geometry", "$.coordinates").alias("c"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", one))).when(F.col("type") == "MultiPolygon", F.from_json("c", many))
    point = lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon"))
    ring = lambda r: thin_ring(F.transform(r, point), min_distance_m)
    shaped = F.transform(polygons, lambda p: F.filter(F.transform(p, ring), lambda r: F.size(r) >= 4))
    return each.select("properties", F.filter(shaped, lambda p: F.size(p) > 0).alias("polygons")).filter("size(polygons) > 0")


def commune_names(properties: Column) -> Column:
    """The French name of a place, else its plain one, else its official one."""
    at = lambda k: F.nullif(F.trim(F.try_element_at(properties, F.lit(k))), F.lit(""))
    return F.coalesce(at("name:fr"), at("nom"), at("name"), at("official_name"))


def district_labels(features: DataFrame) -> DataFrame:
    """(label, polygons): numbered districts from (number, polygons)."""
    return features.select(ordinal_label(F.col("number").cast("string")).alias("label"), "polygons")


def overlapping(areas: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Areas (.., polygons) whose box overlaps (west, south, east, north)."""
    west, south, east, north = box
    b = polygon_bounds(F.col("polygons"))
    return areas.filter((b["west"] <= east) & (b["east"] >= west) & (b["south"] <= north) & (b["north"] >= south))


def view_box(areas: DataFrame, pad: float = 0.0) -> DataFrame:
    """(west, south, east, north), one row: the padded box around all areas."""
    b = polygon_bounds(F.col("polygons"), pad)
    return areas.select(b.alias("b")).agg(F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"))


def on_land(cells: DataFrame, land: DataFrame, water: DataFrame) -> DataFrame:
    """Cells (key, lat, lon) inside a commune and not in masked water; both (zone_id, polygons)."""
    from isotrek.operators.proximity import points_in_zones

    inside = points_in_zones(cells, land).select("key").distinct()
    wet = points_in_zones(cells, water).select("key").distinct()
    return cells.join(inside, "key", "left_semi").join(wet, "key", "left_anti")


def built_cities(cities: DataFrame, provenance: DataFrame, data: DataFrame) -> DataFrame:
    """Cities that have both provenance and data."""
    return cities.join(provenance.select("city"), "city", "left_semi").join(data.select("city"), "city", "left_semi")


def ranked_cities(cities: DataFrame, built: DataFrame) -> DataFrame:
    """Cities published here or with a map elsewhere."""
    here = built.select("city").withColumn("_here", F.lit(True))
    return cities.join(here, "city", "left").filter("_here or external_url is not null").drop("_here")


def feed_list(main: DataFrame, extra: DataFrame) -> DataFrame:
    """(city, feed, url, licence): every feed of every city, the main one first."""
    a = main.select("city", F.lit(0).alias("n"), F.lit("main").alias("feed"), "url", "licence")
    return a.unionByName(extra.select("city", F.lit(1).alias("n"), "feed", "url", "licence")).orderBy("city", "n", "feed").drop("n")


def provenance(city: str, reference_date: Column, manifests: DataFrame, lines: DataFrame, stations: DataFrame) -> DataFrame:
    """One row: what a city's data was made of (manifests), its reference day, lines by mode and number of stations."""
    modes = lines.groupBy("mode").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("lines_by_mode"))
    sources = manifests.agg(F.array_sort(F.collect_list(F.struct("source", "fetched_at", "bytes", "sha256"))).alias("sources"))
    counted = stations.agg(F.count("*").alias("stations"))
    return sources.join(modes).join(counted).select(F.lit(city).alias("city"), reference_date.alias("reference_date"), "sources", "lines_by_mode", "stations")


def control_rows(stats: DataFrame) -> DataFrame:
    """(city, line): one line of figures per city, to spot anomalies. stats (city, reference_date, stations, within_30, farthest, lines array<struct<name,headway>>)."""
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x["name"], F.lit(":"), F.regexp_replace(x["headway"].cast("string"), r"\.0$", ""))), " ")
    return stats.select("city", F.concat_ws(" | ", F.rpad("city", 16, " "), F.col("reference_date").cast("string"), F.concat(F.col("stations").cast("string"), F.lit(" stations")), F.concat(F.lit("30 min: "), F.col("within_30").cast("string"), F.lit(" %")), "farthest", lines).alias("line"))


def fastest_lines(lines: DataFrame) -> DataFrame:
    """(city, name, headway): each city's line of the smallest headway, the smaller name of equal ones."""
    return lines.groupBy("city").agg(F.min(F.struct("headway", "name")).alias("f")).select("city", "f.name", "f.headway")


def cities_by_country(cities: DataFrame) -> DataFrame:
    return cities.groupBy("country").agg(F.count("*").alias("cities"))


def fetched_at(manifest_time: Column, file_time: Column) -> Column:
    """When a timetable was fetched: as the manifest says, else the file's own date."""
    return F.coalesce(manifest_time, file_time)
