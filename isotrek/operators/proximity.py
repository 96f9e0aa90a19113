"""Points near other points or inside regions, by hashing to grid cells and exact verification."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.session import cut

EARTH_M = 6_371_000.0
ZONE_BAND_DEG, ZONE_CELL_DEG = 0.05, 0.5


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two positions in degrees."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _band_height_deg(radius_m: float) -> float:
    return math.degrees(radius_m / EARTH_M) * (1 + 1e-9)


def _lon_reach(band: Column, height_deg: float, radius_m: float) -> Column:
    """How many degrees of longitude two points of a latitude band, or of it and a band beside, can differ within the radius."""
    edge = F.greatest(F.abs((band - 1) * height_deg - 90), F.abs((band + 2) * height_deg - 90))
    narrowest = F.cos(F.radians(F.least(F.lit(90.0), edge)))
    ratio = math.sin(radius_m / (2 * EARTH_M)) / narrowest
    return F.when(narrowest <= 1e-12, 360.0).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * (1 + 1e-9))


def _cells_of_band(band: Column, radius_m: float) -> Column:
    """How many cells a latitude band is cut into, so that points within the radius lie in the same or in neighbouring cells, also in the bands beside."""
    return F.greatest(F.lit(1), F.floor(360.0 / _lon_reach(band, _band_height_deg(radius_m), radius_m))).cast("long")


def _own_cell(points: DataFrame, radius_m: float) -> DataFrame:
    h = _band_height_deg(radius_m)
    own = points.withColumn("band", F.floor((F.col("lat") + 90) / h))
    own = own.withColumn("cells", _cells_of_band(F.col("band"), radius_m))
    return own.withColumn("cell", F.pmod(_cell_at(F.col("lon"), F.col("cells")), F.col("cells"))).drop("cells")


def _cell_at(lon: Column, cells: Column) -> Column:
    return F.least(F.floor((lon + 180) / (F.lit(360.0) / cells)), cells - 1)


def _cells_around(points: DataFrame, radius_m: float) -> DataFrame:
    h = _band_height_deg(radius_m)
    beside = points.withColumn("band", F.floor((F.col("lat") + 90) / h)).withColumn("band", F.explode(F.expr("array(band - 1, band, band + 1)")))
    beside = beside.withColumn("cells", _cells_of_band(F.col("band"), radius_m)).withColumn("cell", _cell_at(F.col("lon"), F.col("cells")))
    return beside.withColumn("cell", F.explode(F.expr("array_distinct(array(pmod(cell - 1, cells), pmod(cell, cells), pmod(cell + 1, cells)))"))).drop("cells")


def near_join(left: DataFrame, right: DataFrame, radius_m: float, keep: str = "true") -> DataFrame:
    """(key_a, lat_a, lon_a, key_b, lat_b, lon_b, metres): positions of ``left`` and ``right`` at most ``radius_m`` apart (inclusive).

    Both have key, lat, lon (valid degrees); rows with a null give nothing, repeated rows count once.
    ``keep`` is a condition on key_a and key_b that is tested before the distance. The 180th meridian
    and the poles need no care: cells wrap around, and a band at a pole has one cell.
    """
    named = lambda df, x: df.select("band", "cell", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "lat", "lon")))
    a = named(_own_cell(left.select("key", "lat", "lon").dropna().distinct(), radius_m), "a")
    b = named(_cells_around(right.select("key", "lat", "lon").dropna().distinct(), radius_m), "b")
    metres = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return (
        a.join(b, ["band", "cell"])
        .filter(f"({keep}) and abs(lat_a - lat_b) <= {_band_height_deg(radius_m)!r}")
        .withColumn("metres", metres)
        .filter(F.col("metres") <= radius_m)
        .drop("band", "cell")
    )


def _half_around(points: DataFrame, radius_m: float) -> DataFrame:
    """Each point in its own cell (home) and in those to the east and north that its radius touches.

    Cells are twice as wide as the radius, so that most points touch few others; of two neighbouring cells
    one looks into the other.
    """
    wide = 2 * radius_m
    h, reach = _band_height_deg(wide), _band_height_deg(radius_m)
    ahead = points.withColumn("own", F.floor((F.col("lat") + 90) / h))
    to_north = (F.col("own") + 1) * h - 90 - F.col("lat")
    ahead = ahead.withColumn("band", F.explode(F.when(to_north <= reach, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))))
    ahead = ahead.withColumn("cells", _cells_of_band(F.col("band"), wide)).withColumn("far", _lon_reach(F.col("band"), h, radius_m)).withColumn("at", _cell_at(F.col("lon"), F.col("cells")))
    touched = lambda lon: F.floor((lon + 180) / (F.lit(360.0) / F.col("cells")))
    east, west = touched(F.col("lon") + F.col("far")), touched(F.col("lon") - F.col("far"))
    beside = F.when(F.col("band") == F.col("own"), F.array("at", east)).otherwise(F.array(west, "at", east))
    ahead = ahead.withColumn("cell", F.explode(F.array_distinct(F.transform(beside, lambda x: F.pmod(x, F.col("cells"))))))
    return ahead.withColumn("home", (F.col("band") == F.col("own")) & (F.col("cell") == F.pmod(F.col("at"), F.col("cells")))).drop("own", "cells", "far", "at")


def near_pairs(points: DataFrame, radius_m: float, repeated: bool = True) -> DataFrame:
    """(key_a, key_b, metres) of all pairs of different keys with positions at most ``radius_m`` apart, key_a < key_b.

    A key with several positions is near whatever one of them is near; metres is the smallest distance.
    Rows with a null give nothing and repeated rows count once. Each pair of cells is compared once.
    ``repeated``: whether there may be repeated rows or nulls; without, they need not be looked for.
    """
    placed = points.select("key", "lat", "lon").dropna().distinct() if repeated else points
    named = lambda df, x, *more: df.select("band", "cell", *more, *(F.col(c).alias(f"{c}_{x}") for c in ("key", "lat", "lon")))
    metres = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    met = (
        named(_own_cell(placed, 2 * radius_m), "a")
        .join(named(_half_around(placed, radius_m), "b", "home"), ["band", "cell"])
        .filter(f"key_a <> key_b and (not home or key_a < key_b) and abs(lat_a - lat_b) <= {_band_height_deg(radius_m)!r}")
        .select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), metres.alias("metres"))
    )
    return met.filter(F.col("metres") <= radius_m).groupBy("key_a", "key_b").agg(F.min("metres").alias("metres"))


def nearest(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """(key, nearest, metres) for every key of ``left``: the nearest key of ``right`` within the radius, ties to the smaller key; nulls if none."""
    best = near_join(left, right, radius_m).groupBy("key_a").agg(F.min(F.struct("metres", "key_b")).alias("best"))
    return left.select("key").distinct().join(best.select(F.col("key_a").alias("key"), F.col("best.key_b").alias("nearest"), F.col("best.metres").alias("metres")), "key", "left")


def k_nearest(left: DataFrame, right: DataFrame, radius_m: float, k: int) -> DataFrame:
    """(key, nearest, metres, rank): up to ``k`` nearest of ``right`` within the radius, ranked by distance, then key.

    Of the keys of ``right`` at one position only the ``k`` smallest can be among the nearest, whatever
    is asked for. Searched in rounds of growing radius, the last one ``radius_m``: who has ``k`` within a
    smaller radius is done, so that dense regions never list all that lies within the whole one.
    """
    order = Window.partitionBy("key_a").orderBy("metres", "key_b")
    asked, rest = left.select("key", "lat", "lon").dropna().distinct(), right.select("key", "lat", "lon").dropna().distinct()
    smallest = Window.partitionBy("lat", "lon").orderBy("key")
    offered = cut(rest.withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= k).drop("_n"))
    done = []
    for metres in _growing(offered, radius_m, k):
        ranked = near_join(asked, offered, metres).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = ranked.select(F.col("key_a").alias("key"), F.col("key_b").alias("nearest"), "metres", "rank")
        if metres < radius_m:
            found = cut(found)
            whole = found.filter(F.col("rank") == k).select("key")
            found, asked = found.join(whole, "key", "left_semi"), cut(asked.join(whole, "key", "left_anti"))
        done.append(found)
        if asked.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _growing(points: DataFrame, radius_m: float, k: int) -> list[float]:
    """Radii up to ``radius_m``: the first one holds some 4 ``k`` of the points where they lie as densely as on average over the cells of ``radius_m`` that have any."""
    cells = _own_cell(points, radius_m).groupBy("band", "cell").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    in_reach = (cells[0] or 0) / max(1, cells[1]) * math.pi
    first = radius_m * math.sqrt(min(1.0, 4 * k / in_reach)) if in_reach else radius_m
    radii = []
    while first < radius_m / 1.5:
        radii.append(first)
        first *= 3
    return [*radii, radius_m]


def _zone_spans(zones: DataFrame) -> DataFrame:
    """The edges of zones(zone_id, polygons array<array<array<struct<lat,lon>>>>), with the first and last band and cell in which a ray to the east can meet them."""
    rings = (
        zones.select("zone_id", F.posexplode("polygons").alias("polygon", "rings"))
        .withColumn("west", F.expr("array_min(transform(flatten(rings), v -> v.lon))"))
        .withColumn("east", F.expr("array_max(transform(flatten(rings), v -> v.lon))"))
        .select("zone_id", "polygon", "west", "east", F.explode("rings").alias("ring"))
    )
    edges = rings.select(
        "zone_id", "polygon", "west", "east",
        F.explode(F.expr("filter(transform(ring, (v, i) -> struct(v.lat as lat1, v.lon as lon1, ring[(i + 1) % size(ring)].lat as lat2, ring[(i + 1) % size(ring)].lon as lon2)), e -> e.lat1 != e.lat2)")).alias("e"),
    ).select("zone_id", "polygon", "west", "east", "e.*")
    band = lambda c: f"cast(floor((least(90D, greatest(-90D, {c})) + 90) / {ZONE_BAND_DEG}) as int)"
    cell = lambda c: f"cast(floor(({c} + 180) / {ZONE_CELL_DEG}) as int)"
    return edges.selectExpr("*", f"{band('least(lat1, lat2)')} as band1", f"{band('greatest(lat1, lat2)')} as band2", f"{cell('west')} as cell1", f"{cell('greatest(lon1, lon2)')} as cell2")


def zone_edges(zones: DataFrame) -> DataFrame:
    """The edges of zones, a row for each cell in which a ray to the east can meet them."""
    spans = _zone_spans(zones)
    return (
        spans.withColumn("band", F.explode(F.sequence("band1", "band2"))).withColumn("cell", F.explode(F.sequence("cell1", "cell2")))
        .drop("band1", "band2", "cell1", "cell2")
    )


def points_in_zones(points: DataFrame, zones: DataFrame, broadcast_rows: int = 200_000, repeated: bool = True) -> DataFrame:
    """(key, zone_id): the zones of which a polygon holds the point: inside its outer ring, in none of its holes.

    Even-odd rule over all rings of a polygon, edges straight in longitude and latitude, a ray going
    east meets an edge at lower latitude <= lat < upper latitude. Points and edges meet in grid cells;
    what a ray crosses is counted per point and polygon. Null positions, null or empty polygons give
    no row. Edges are broadcast only if counting finds at most ``broadcast_rows`` of them. ``repeated``
    as in near_pairs.
    """
    edges = zone_edges(zones)
    place = points.select("key", "lat", "lon").dropna().distinct() if repeated else points
    place = place.withColumn("band", F.floor((F.col("lat") + 90) / ZONE_BAND_DEG).cast("int")).withColumn("cell", F.floor((F.col("lon") + 180) / ZONE_CELL_DEG).cast("int"))
    rows = _zone_spans(zones).agg(F.sum(F.expr("(band2 - band1 + 1L) * (cell2 - cell1 + 1L)"))).first()[0]  # counted without making them
    small = (rows or 0) <= broadcast_rows
    crossing = (
        "(lat1 <= lat) != (lat2 <= lat) and lon >= west and lon <= east "
        "and lon < lon1 + (lat - lat1) / (lat2 - lat1) * (lon2 - lon1)"
    )
    return (
        place.join(F.broadcast(edges) if small else edges, ["band", "cell"])
        .filter(crossing)
        .groupBy("key", "lat", "lon", "zone_id", "polygon")
        .agg(F.count("*").alias("crossings"))
        .filter("crossings % 2 = 1")
        .select("key", "zone_id")
        .distinct()
    )
