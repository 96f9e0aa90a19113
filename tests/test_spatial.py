import pytest
import math
import random

import numpy as np
from pyspark.sql import functions as F

from isotrek.functions.geo import closed_ring, hilbert_positions, in_box, inside_polygons, polygon_bounds, ring_area, ring_centroid, segments_cross, simplify_indices, thin_line, thin_ring
from isotrek.operators import proximity
from isotrek.operators.proximity import k_nearest, near_pairs, nearest, points_in_zones
from tests.conftest import rows


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def cloud(seed):
    r = random.Random(seed)
    centres = [(0, 0), (48.5, -3), (-14, 179.9995), (-14, -179.9995), (89.9995, 10), (-89.9999, 0), (60, 180), (60, -180), (71.3, 55.2)]
    points = [(f"P{i:03}", max(-90.0, min(90.0, c[0] + r.uniform(-0.003, 0.003))), (c[1] + r.uniform(-0.003, 0.003) * (30 if abs(c[0]) > 89 else 1) + 540) % 360 - 180) for i, c in enumerate(centres * 25)]
    return points + points[:5] + [("P000", 10.0, 10.0), ("Q", 10.0, 10.0005), (None, 0.0, 0.0), ("X", None, 1.0)]


def test_near_pairs_equal_brute_force(spark):
    points = cloud(1)
    good = [p for p in points if None not in p]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and metres(a[1:], b[1:]) <= 150}
    df = spark.createDataFrame(points, "key string, lat double, lon double").withColumn("band", F.lit(1)).withColumn("cell", F.lit("clash"))
    got = rows(near_pairs(df, 150.0).select("key_a", "key_b"))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert near_pairs(df.limit(0), 150.0).collect() == []


@pytest.mark.parametrize("radius", [150.0, 60_000.0, 900_000.0])
def test_near_pairs_everywhere(spark, radius):
    """Around the poles and the 180th meridian and in between, for small and for wide cells."""
    r = random.Random(int(radius))
    spread = radius / 111_000 * 2
    centres = [(90.0, 0.0), (-90.0, 50.0), (89.9, 170.0), (0.0, 180.0), (10.0, -180.0), (60.0, 179.9), (-45.0, -179.99), (33.0, 7.0)]
    data = []
    for lat, lon in centres:
        for _ in range(18):
            y = max(-90.0, min(90.0, lat + r.uniform(-spread, spread)))
            x = lon + r.uniform(-spread, spread) / max(0.02, math.cos(math.radians(y)))
            data.append((f"k{len(data):03}", y, (x + 180) % 360 - 180))
    data += [("e1", 0.0, 180.0), ("e2", 0.0, -180.0), ("n1", 90.0, 10.0), ("n2", 90.0, -120.0)]

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))

    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and metres(a, b) <= radius}
    got = near_pairs(spark.createDataFrame(data, "key string, lat double, lon double"), radius).select("key_a", "key_b").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 50


def test_nearest_and_k_nearest(spark):
    points = [p for p in cloud(2) if None not in p]
    left = [(f"L{i}", p[1] + 0.0004 if p[1] < 89 else p[1], p[2]) for i, p in enumerate(points[:60])]
    a, b = (spark.createDataFrame(x, "key string, lat double, lon double") for x in (left, points))
    def near(p):
        return sorted((metres(p[1:], q[1:]), q[0]) for q in points if metres(p[1:], q[1:]) <= 300)
    assert {r.key: r.nearest for r in nearest(a, b, 300).collect()} == {p[0]: (near(p)[0][1] if near(p) else None) for p in left}
    got = {}
    for r in k_nearest(a, b.dropDuplicates(["key"]), 300, 3).collect():
        got.setdefault(r.key, []).append((r["rank"], r.nearest))
    assert max(map(len, got.values())) == 3


def test_k_nearest_of_many_at_few_positions(spark):
    """many keys share a position and most points lie far within the radius; edges, ties and poor regions too."""
    right = [(i, 41.5 + i % 40 / 400, (i * 7) % 31 / 400) for i in range(4000)] + [(9000, 41.95, 0.02), (9001, 41.955, 0.02)]
    left = [(i, 41.5 + (i * 53) % 97 / 970, (i * 29) % 91 / 1170) for i in range(30)] + [(100, 41.952, 0.02), (101, 50.0, 9.0)]
    a, b = (spark.createDataFrame(x, "key long, lat double, lon double") for x in (left, right))
    assert len(proximity._growing(b, 5000.0, 3)) > 1
    got, listed = proximity.k_nearest(a, b, 5000.0, 3), []
    want = [(key, n, i + 1) for key, y, x in left for i, (m, n) in enumerate(sorted((metres((y, x), q[1:]), q[0]) for q in right)[:3]) if m <= 5000]
    assert sorted((r.key, r.nearest, r["rank"]) for r in got.collect()) == sorted(want)
    near_join = proximity.near_join
    proximity.near_join = lambda *x: listed.append(near_join(*x)) or listed[-1]
    try:
        proximity.k_nearest(a, b, 5000.0, 3)
    finally:
        proximity.near_join = near_join
    assert sum(df.count() for df in listed) < near_join(a, b, 5000.0).count() / 20


def zone(*polygons):
    return [[[{"lat": float(y), "lon": float(x)} for y, x in r] for r in p] for p in polygons]


def box(s, w, n, e):
    return [(s, w), (s, e), (n, e), (n, w), (s, w)]


def test_points_in_zones(spark):
    zones = [("A", zone([box(0, 0, 2, 2), box(0.5, 0.5, 1, 1)])), ("B", zone([box(0.2, 0.2, 1.8, 1.8)], [box(10, 10, 11, 11)])), ("C", zone([box(-1, 179, 1, 180)], [box(-1, -180, 1, -179)])), ("D", None), ("E", [])]
    schema = "zone_id string, polygons array<array<array<struct<lat:double,lon:double>>>>"
    df = spark.createDataFrame(zones, schema)
    places = [("in both", 1.5, 1.5), ("in hole", 0.7, 0.7), ("only A", 0.1, 0.1), ("far", 50.0, 50.0), ("second", 10.5, 10.5), ("east", 0.0, 179.5), ("west", 0.0, -179.5), ("none", None, 0.0), ("in both", 1.5, 1.5)]
    points = spark.createDataFrame(places, "key string, lat double, lon double").withColumn("zone_id", F.lit("clash"))
    want = [("east", "C"), ("in both", "A"), ("in both", "B"), ("in hole", "B"), ("only A", "A"), ("second", "B"), ("west", "C")]
    assert rows(points_in_zones(points, df)) == want == rows(points_in_zones(points, df, broadcast_rows=1))
    assert points_in_zones(points, df.limit(0)).collect() == [] == points_in_zones(points.limit(0), df).collect()
    exact = df.filter("polygons is not null").crossJoin(points.drop("zone_id").dropna().distinct()).filter(inside_polygons(F.col("polygons"), F.col("lat"), F.col("lon"))).select("key", "zone_id")
    assert rows(exact) == want


def test_geometry_columns(spark):
    def one(expr, **values):
        return spark.range(1).select(expr).first()[0]

    line = lambda pts: F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in pts))
    plane = lambda pts: F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in pts))
    assert len(one(thin_line(line([(0, 0), (0, 0.00005), (0, 0.001), (0, 0.00101)]), 50))) == 3
    assert len(one(thin_ring(line(box(0, 0, 0.0001, 0.0001)), 5000))) == 5
    assert len(one(closed_ring(line([(0, 0), (0, 1), (1, 1)])))) == 4
    assert one(ring_area(plane([(0, 0), (2, 0), (2, 1), (0, 1)]))) == 2.0
    assert tuple(one(ring_centroid(plane([(0, 0), (2, 0), (2, 1), (0, 1)])))) == (1.0, 0.5)
    assert tuple(one(polygon_bounds(F.array(F.array(line(box(1, 2, 3, 4)))), 1.0))) == (1.0, 0.0, 5.0, 4.0)
    assert one(in_box(F.lit(1.0), F.lit(2.0), 2, 1, 3, 3)) is True
    cross = [F.lit(float(x)) for x in (0, 0, 2, 2, 0, 2, 2, 0)]
    assert one(segments_cross(*cross)) is True
    assert one(segments_cross(*[F.lit(float(x)) for x in (0, 0, 2, 2, 2, 2, 3, 0)])) is False


def test_hilbert_curve_visits_every_cell_once_by_neighbours():
    n = 16
    x, y = np.meshgrid(np.arange(n), np.arange(n))
    order = np.argsort(hilbert_positions(x.ravel(), y.ravel(), 4))
    px, py = x.ravel()[order], y.ravel()[order]
    assert set(hilbert_positions(x.ravel(), y.ravel(), 4)) == set(range(n * n))
    assert (abs(np.diff(px)) + abs(np.diff(py)) == 1).all()


def test_douglas_peucker_is_strict():
    assert simplify_indices(np.array([0.0, 1, 2]), np.array([0.0, 4, 0]), 4.0).tolist() == [0, 2]
    assert simplify_indices(np.array([0.0, 1, 2]), np.array([0.0, 4.1, 0]), 4.0).tolist() == [0, 1, 2]
