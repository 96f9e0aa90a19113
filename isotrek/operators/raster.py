"""Travel-time rasters over a grid: stamping, coverage, smoothing, gap filling, contours, colours."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrek.functions.geo import inside_polygons
from isotrek.operators.proximity import EARTH_M, haversine_m

METRES_PER_DEGREE_LAT = math.pi * EARTH_M / 180
TIME_CAP = 70.0
NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(h))


@dataclass(frozen=True)
class Grid:
    """Cells of about ``cell_m`` metres over a box; row 0 is the south edge, cell = row * cols + col."""

    west: float
    south: float
    east: float
    north: float
    cell_m: float

    def __post_init__(self):
        if not (self.east > self.west and self.north > self.south):
            raise ValueError(f"empty box {(self.west, self.south, self.east, self.north)}")
        if not self.cell_m > 0:
            raise ValueError(f"cell size {self.cell_m} is not positive")

    @property
    def cols(self) -> int:
        middle = (self.south + self.north) / 2
        return math.ceil(_metres((middle, self.west), (middle, self.east)) / self.cell_m)

    @property
    def rows(self) -> int:
        return math.ceil(_metres((self.south, self.west), (self.north, self.west)) / self.cell_m)

    @property
    def d_lat(self) -> float:
        return (self.north - self.south) / self.rows

    @property
    def d_lon(self) -> float:
        return (self.east - self.west) / self.cols

    def lat(self, row: Column) -> Column:
        return F.lit(self.south) + (row + 0.5) * F.lit(self.d_lat)

    def lon(self, col: Column) -> Column:
        return F.lit(self.west) + (col + 0.5) * F.lit(self.d_lon)

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, row, col, lat, lon) of every cell."""
        base = spark.range(self.rows * self.cols).select(F.col("id").alias("cell"), F.floor(F.col("id") / self.cols).cast("int").alias("row"), (F.col("id") % self.cols).cast("int").alias("col"))
        return base.withColumn("lat", self.lat(F.col("row"))).withColumn("lon", self.lon(F.col("col")))


def cells_near(grid: Grid, anchors: DataFrame, radius_m: float) -> DataFrame:
    """``anchors`` (lat, lon, ..) with (cell, metres) of each cell whose centre is within the radius; anchors outside the box reach in."""
    r_lat = radius_m / METRES_PER_DEGREE_LAT * 1.01
    r_lon = F.lit(r_lat) / F.cos(F.radians("lat"))
    between = lambda low, high, n: F.when(F.greatest(F.lit(0), low) <= F.least(F.lit(n - 1), high), F.sequence(F.greatest(F.lit(0), low), F.least(F.lit(n - 1), high)))
    index = lambda c: c.cast("int")
    rows = between(index(F.floor((F.col("lat") - r_lat - grid.south) / grid.d_lat)), index(F.ceil((F.col("lat") + r_lat - grid.south) / grid.d_lat)), grid.rows)
    cols = between(index(F.floor((F.col("lon") - r_lon - grid.west) / grid.d_lon)), index(F.ceil((F.col("lon") + r_lon - grid.west) / grid.d_lon)), grid.cols)
    spread = anchors.dropna(subset=["lat", "lon"]).withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols))
    metres = haversine_m(F.col("lat"), F.col("lon"), grid.lat(F.col("_row")), grid.lon(F.col("_col")))
    near = spread.withColumn("metres", metres).filter(F.col("metres") <= radius_m)
    return near.withColumn("cell", F.col("_row").cast("long") * grid.cols + F.col("_col")).drop("_row", "_col")


def time_raster(grid: Grid, origins: DataFrame, at_stops: DataFrame, stops: DataFrame, minutes_per_metre: float, max_access_m: float, direct_m: float) -> DataFrame:
    """(origin, cell, minutes float): least of walking from the origin and of riding to a stop and walking on; unreached cells give no row.

    The minimum is taken in double precision and stored as float.
    """
    on_foot = cells_near(grid, origins.select("origin", "lat", "lon"), direct_m).select("origin", "cell", (F.col("metres") * minutes_per_metre).alias("minutes"))
    discs = cells_near(grid, stops.select("stop_ix", "lat", "lon"), max_access_m).select("stop_ix", "cell", "metres")
    ridden = at_stops.join(discs, "stop_ix").select("origin", "cell", (F.col("minutes") + F.col("metres") * minutes_per_metre).alias("minutes"))
    return on_foot.unionByName(ridden).groupBy("origin", "cell").agg(F.min("minutes").cast("float").alias("minutes"))


def street_raster(grid: Grid, node_minutes: DataFrame, nodes: DataFrame, minutes_per_metre: float, max_snap_m: float, cap: float = TIME_CAP) -> DataFrame:
    """(origin, cell, minutes float) from street nodes (node, lat, lon) with a time of at most ``cap``: each spreads to the cells within the snap radius."""
    spread = cells_near(grid, nodes.select("node", "lat", "lon"), max_snap_m).select("node", "cell", "metres")
    timed = node_minutes.filter(F.col("minutes") <= cap).join(spread, "node").select("origin", "cell", (F.col("minutes") + F.col("metres") * minutes_per_metre).alias("minutes"))
    return timed.groupBy("origin", "cell").agg(F.min("minutes").cast("float").alias("minutes"))


def coverage(grid: Grid, stops: DataFrame, max_access_m: float, polygons: Column | None = None) -> DataFrame:
    """(cell): cells inside the boundary if there is one, else within walking access of a stop."""
    if polygons is not None:
        cells = grid.cells(stops.sparkSession)
        return cells.filter(inside_polygons(polygons, F.col("lat"), F.col("lon"))).select("cell")
    return cells_near(grid, stops, max_access_m).select("cell").distinct()


def reach_percent(raster: DataFrame, covered: DataFrame, max_minutes: float) -> DataFrame:
    """(percent), one row: share of covered cells reached in time; 0 if nothing is covered."""
    share = covered.join(raster.select("cell", "minutes"), "cell", "left").agg(F.count("*").alias("n"), F.count_if(F.col("minutes") <= max_minutes).alias("hit"))
    return share.select(F.when(F.col("n") == 0, 0.0).otherwise(100.0 * F.col("hit") / F.col("n")).alias("percent"))


def _offsets(raster: DataFrame, cols: int, rows: int, steps: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """Each value sent to the cells beside it: (keys.., cell, dy, dx, value)."""
    spread = raster.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))))
    row, col = F.floor(F.col("cell") / cols) + F.col("_s.dy"), F.col("cell") % cols + F.col("_s.dx")
    inside = (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
    return spread.filter(inside).select(*keys, (row * cols + col).cast("long").alias("cell"), F.col("_s.dy").alias("dy"), F.col("_s.dx").alias("dx"), F.col("minutes").cast("double").alias("value"))


def smooth(raster: DataFrame, cols: int, rows: int, keys: list[str] = ()) -> DataFrame:
    """3x3 mean, the centre twice, over reached cells; unreached cells stay unreached."""
    keys = list(keys)
    spread = _offsets(raster, cols, rows, NEIGHBOURS, keys).withColumn("w", F.when((F.col("dy") == 0) & (F.col("dx") == 0), 2).otherwise(1))
    means = spread.groupBy(*keys, "cell").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("minutes"), F.max(F.col("w") == 2).alias("own"))
    return means.filter("own").select(*keys, "cell", F.col("minutes").cast("float").alias("minutes"))


def fill_gaps(raster: DataFrame, cols: int, rows: int, passes: int = 1, keys: list[str] = ()) -> DataFrame:
    """Unreached cells take the mean of their reached neighbours on four sides, pass after pass from the pass before."""
    keys = list(keys)
    for _ in range(passes):
        around = _offsets(raster, cols, rows, [(-1, 0), (1, 0), (0, -1), (0, 1)], keys).groupBy(*keys, "cell").agg(F.avg("value").alias("filled"))
        raster = raster.join(around, [*keys, "cell"], "full_outer").select(*keys, "cell", F.coalesce("minutes", F.col("filled").cast("float")).alias("minutes"))
    return raster


def contours(grid: Grid, smoothed: DataFrame, thresholds: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys.., threshold, row, col, segment, lat1, lon1, lat2, lon2): marching squares on cell centres.

    An unreached corner lies outside and its crossings at the middle of the edge; four crossings of a
    square pair first with second and third with fourth, going round from its south-west corner.
    """
    keys = list(keys)
    corners = {"sw": (0, 0), "se": (0, 1), "ne": (1, 1), "nw": (1, 0)}
    steps = [(-dy, -dx) for dy, dx in corners.values()]
    squares = _offsets(smoothed, grid.cols, grid.rows, steps, keys)
    picked = [F.max(F.when((F.col("dy") == -dy) & (F.col("dx") == -dx), F.col("value"))).alias(c) for c, (dy, dx) in corners.items()]
    squares = squares.groupBy(*keys, "cell").agg(*picked).withColumn("row", F.floor(F.col("cell") / grid.cols).cast("int")).withColumn("col", (F.col("cell") % grid.cols).cast("int"))
    squares = squares.filter((F.col("row") < grid.rows - 1) & (F.col("col") < grid.cols - 1)).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    order = list(corners)

    def crossing(a: str, b: str) -> Column:
        va, vb, t = F.col(a), F.col(b), F.col("threshold")
        inside = lambda v: F.coalesce(v <= t, F.lit(False))
        part = F.when(va.isNull() | vb.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - va) / F.nullif(vb - va, F.lit(0.0)))))
        (ya, xa), (yb, xb) = corners[a], corners[b]
        lat = grid.lat(F.col("row") + ya + (yb - ya) * part)
        lon = grid.lon(F.col("col") + xa + (xb - xa) * part)
        return F.when(inside(va) != inside(vb), F.struct(lat.alias("lat"), lon.alias("lon")))

    met = F.filter(F.array(*(crossing(order[k], order[(k + 1) % 4]) for k in range(4))), lambda c: c.isNotNull())
    found = squares.withColumn("met", met).filter(F.size("met") > 0).withColumn("segment", F.explode(F.sequence(F.lit(0), (F.size("met") / 2).cast("int") - 1)))
    end = lambda i: F.get("met", F.col("segment") * 2 + i)
    return found.select(*keys, "threshold", "row", "col", "segment", end(0)["lat"].alias("lat1"), end(0)["lon"].alias("lon1"), end(1)["lat"].alias("lat2"), end(1)["lon"].alias("lon2"))


def bilinear(raster: DataFrame, samples: DataFrame, cols: int, rows: int, least_weight: float = 0.25) -> DataFrame:
    """(sample, minutes) at fractional positions (sample, y, x) in cell units: weighted mean of the reached ones of four cells; too little weight gives no row."""
    spread = samples.withColumn("_c", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
    row, col = F.floor("y") + F.col("_c.i"), F.floor("x") + F.col("_c.j")
    wy, wx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    weight = F.when(F.col("_c.i") == 1, wy).otherwise(1 - wy) * F.when(F.col("_c.j") == 1, wx).otherwise(1 - wx)
    inside = (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
    placed = spread.filter(inside).select("sample", (row * cols + col).cast("long").alias("cell"), weight.alias("w"))
    mean = placed.join(raster.select("cell", "minutes"), "cell").groupBy("sample").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("minutes")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("minutes"))
    return mean.filter(F.col("w") >= least_weight).select("sample", "minutes")


def heat_samples(raster: DataFrame, cols: int, rows: int, upsample: int = 3, passes: int = 2) -> DataFrame:
    """(sample, minutes): the gap-filled raster sampled ``upsample`` times finer in both directions, row by row from the south."""
    filled = fill_gaps(raster.select("cell", "minutes"), cols, rows, passes)
    wide = cols * upsample
    samples = raster.sparkSession.range(wide * rows * upsample).select(
        F.col("id").alias("sample"), ((F.floor(F.col("id") / wide) + 0.5) / upsample - 0.5).alias("y"), ((F.col("id") % wide + 0.5) / upsample - 0.5).alias("x")
    )
    return bilinear(filled, samples, cols, rows)


def edge_buckets(edges: DataFrame, node_minutes: DataFrame, max_minutes: float, buckets: int = 48) -> DataFrame:
    """(a, b, bucket): colour bucket of a street from the mean time of its ends; -1 if an end is unreached or the mean is off the scale."""
    at = lambda c: node_minutes.select(F.col("node").alias(c), F.col("minutes").alias(f"m_{c}"))
    timed = edges.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").withColumn("mean", (F.col("m_a") + F.col("m_b")) / 2)
    bucket = F.when(F.col("mean").isNull() | (F.col("mean") >= max_minutes), -1).otherwise(F.least(F.lit(buckets - 1), F.floor(F.col("mean") / max_minutes * buckets).cast("int")))
    return timed.select("a", "b", bucket.cast("int").alias("bucket"))


def label_spots(segments: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """(threshold, lat, lon): for each contour the northernmost segment middle inside the box, the westernmost of equal ones."""
    middle = segments.select("threshold", ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"))
    inside = middle.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return inside.groupBy("threshold").agg(F.min(F.struct((-F.col("lat")).alias("n"), F.col("lon").alias("lon"))).alias("p")).select("threshold", (-F.col("p.n")).alias("lat"), F.col("p.lon").alias("lon"))
