"""Places: nearest stop names, districts of points, served districts, geocoder replies, water and parks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrek.functions.geo import in_box, planar, ring_area
from isotrek.functions.text import address_label, has_all_words
from isotrek.operators.proximity import near_join, points_in_zones

RAIL_NAME_M, SEARCH_RADIUS_M = 400.0, 50_000.0
LEAST_STOPS, RAIL_WITHIN_M = 3, 12_000.0
WATER_M2, WATER_MASK_M2, PARK_M2 = 15_000.0, 1_000_000.0, 20_000.0
PHOTON = "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>>>"


def nearest_stop_names(points: DataFrame, stops: DataFrame, radius_m: float = SEARCH_RADIUS_M) -> DataFrame:
    """(key, name): the nearest rail station within 400 m, else the nearest stop within the radius; none gives no row.

    points (key, lat, lon), stops (key, name, rail, lat, lon).
    """
    near = near_join(points, stops, radius_m).join(stops.select(F.col("key").alias("key_b"), "name", "rail"), "key_b")
    close_rail = F.when(F.col("rail") & (F.col("metres") <= RAIL_NAME_M), F.struct("metres", "name"))
    best = near.groupBy(F.col("key_a").alias("key")).agg(F.min(close_rail).alias("r"), F.min(F.struct("metres", "name")).alias("a"))
    return best.select("key", F.coalesce("r.name", "a.name").alias("name"))


def districts(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(key, zone_id): the district of each point; of several the one of the lowest priority number, then the smallest id.

    zones (zone_id, priority, polygons).
    """
    held = points_in_zones(points, zones).join(zones.select("zone_id", "priority"), "zone_id")
    return held.groupBy("key").agg(F.min(F.struct("priority", "zone_id")).alias("z")).select("key", "z.zone_id")


def describe_places(points: DataFrame, stops: DataFrame, zones: DataFrame, zone_names: DataFrame, city: str) -> DataFrame:
    """(key, text): 'near stop', with the district's name (zone_id, zone_name) unless it is the city's own."""
    named = nearest_stop_names(points, stops).join(districts(points, zones).join(zone_names, "zone_id"), "key", "left")
    other = F.when(F.col("zone_name") != city, F.concat(F.lit(" ("), "zone_name", F.lit(")")))
    return named.select("key", F.concat(F.lit("near "), "name", F.coalesce(other, F.lit(""))).alias("text"))


def served_districts(stops: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, stops): districts with at least three stops inside, one of them within 12 km of a rail station.

    stops (key, rail, lat, lon).
    """
    inside = points_in_zones(stops, zones)
    near_rail = near_join(stops, stops.filter("rail"), RAIL_WITHIN_M).select(F.col("key_a").alias("key")).distinct().withColumn("close", F.lit(True))
    counted = inside.join(near_rail, "key", "left").groupBy("zone_id").agg(F.countDistinct("key").alias("stops"), F.max("close").alias("close"))
    return counted.filter((F.col("stops") >= LEAST_STOPS) & F.col("close")).select("zone_id", "stops")


def find_stops(stops: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """(name): the first stop names that hold every word of a query, accents and case aside."""
    return stops.filter(has_all_words(F.col("name"), F.lit(query))).select("name").distinct().orderBy("name").limit(limit)


def polygon_area(polygon: Column, lat0: float, lon0: float) -> Column:
    """Square metres of a polygon of struct<lat,lon> rings: the outer ring less its holes."""
    def area(ring: Column) -> Column:
        def move(p: Column) -> Column:
            x, y = planar(p["lat"], p["lon"], lat0, lon0)
            return F.struct(x.alias("x"), y.alias("y"))

        return F.abs(ring_area(F.transform(ring, move)))

    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(1)))
    return area(F.element_at(polygon, 1)) - F.aggregate(holes, F.lit(0.0), lambda s, r: s + area(r))


def kept_areas(areas: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """(layer, id, polygon, area, masked): water of at least 15,000 m2 and parks of at least 20,000 m2; lagoons and water of 1 km2 are masked.

    areas (layer, id, polygons, lagoon boolean).
    """
    each = areas.select("layer", "id", "lagoon", F.explode("polygons").alias("polygon")).withColumn("area", polygon_area(F.col("polygon"), lat0, lon0))
    keep = ((F.col("layer") == "water") & (F.col("area") >= WATER_M2)) | ((F.col("layer") == "parks") & (F.col("area") >= PARK_M2))
    masked = (F.col("layer") == "water") & (F.coalesce("lagoon", F.lit(False)) | (F.col("area") >= WATER_MASK_M2))
    return each.filter(keep).select("layer", "id", "polygon", "area", masked.alias("masked"))


def geocoder_places(replies: DataFrame, box: tuple[float, float, float, float], limit: int = 8) -> DataFrame:
    """(query, results array<struct<label,lat,lon>>, outside): parsed search replies (query, body): malformed features and repeated places left out, places outside the box counted, the first ones kept."""
    parsed = replies.select("query", F.posexplode(F.from_json("body", PHOTON)["features"]).alias("pos", "f"))
    p = lambda k: F.coalesce(F.try_element_at("f.properties", F.lit(k)), F.lit(""))
    town = F.coalesce(*(F.nullif(p(k), F.lit("")) for k in ("city", "town", "village")), F.lit(""))
    label = address_label(p("name"), F.concat_ws(" ", F.nullif(p("street"), F.lit("")), F.nullif(p("housenumber"), F.lit(""))), F.concat_ws(" ", F.nullif(p("postcode"), F.lit("")), F.nullif(town, F.lit(""))))
    at = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    places = parsed.select("query", "pos", label.alias("label"), at(1).alias("lat"), at(0).alias("lon")).filter("label <> '' and lat is not null and lon is not null")
    once = places.groupBy("query", "label", "lat", "lon").agg(F.min("pos").alias("pos")).withColumn("inside", in_box(F.col("lat"), F.col("lon"), *box))
    listed = once.groupBy("query").agg(F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("pos", "label", "lat", "lon")))).alias("r"), F.count_if(~F.col("inside")).alias("outside"))
    return listed.select("query", F.transform(F.slice("r", 1, limit), lambda x: F.struct(x["label"].alias("label"), x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("results"), "outside")


# How far from a marker, in pixels, a click still meets it.
HIT_RADIUS = {"mouse": 10.0, "touch": 22.0}


def marker_at(markers: DataFrame, clicks: DataFrame, kind: str = "mouse") -> DataFrame:
    """(click, ix): the marker (ix, x, y) nearest to each click (click, x, y) within the radius (inclusive), the highest ix of equally near ones; null if none.

    Both are put into squares as wide as the radius and meet only in neighbouring ones.
    """
    r = HIT_RADIUS[kind]
    square = lambda c, r: F.floor(F.col(c) / r)
    around = markers.select("ix", F.col("x").alias("mx"), F.col("y").alias("my")).withColumn("cx", F.explode(F.sequence(square("mx", r) - 1, square("mx", r) + 1))).withColumn("cy", F.explode(F.sequence(square("my", r) - 1, square("my", r) + 1)))
    away = F.sqrt(F.pow(F.col("mx") - F.col("x"), 2) + F.pow(F.col("my") - F.col("y"), 2))
    met = clicks.withColumn("cx", square("x", r)).withColumn("cy", square("y", r)).join(around, ["cx", "cy"]).withColumn("away", away).filter(F.col("away") <= r)
    best = met.groupBy("click").agg(F.min(F.struct("away", (-F.col("ix")).alias("last"))).alias("m")).select("click", (-F.col("m.last")).alias("ix"))
    return clicks.select("click").distinct().join(best, "click", "left")
