"""Queries that SQL cannot express, against plain second readings of the same rules on the smallest test tables."""

import os
from collections import defaultdict

import numpy as np
import pytest

from isotrek.operators import raster
from isotrek.plans import catalog, reference, tables
from isotrek.plans.reference import CITY

DATA = os.environ.get("ISOTREK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SPEED, DETOUR = CITY.walk.speed_m_per_min, CITY.walk.detour_factor
PENALTY = {m.id: m.transfer_min for m in CITY.modes}


def metres(a, b):
    p, q = np.radians(a[0]), np.radians(b[0])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2
    return float(2 * 6_371_000 * np.arcsin(min(1.0, np.sqrt(h))))


@pytest.fixture(scope="module")
def town(spark):
    """Stops, boarding waits, rides and neighbours as dictionaries."""
    found = reference._timetable(spark, DATA)
    stops = {r.stop_id: (r.lat, r.lon) for r in found.stops.collect()}
    waits, rides, modes = defaultdict(dict), defaultdict(dict), {}
    for r in found.waits.collect():
        if r.stop_id in stops:
            waits[r.stop_id][r.route_id, r.direction] = r.wait
    for r in found.rides.collect():
        modes[r.route_id, r.direction] = r["mode"]
        if r.a in stops and r.b in stops:
            rides[(r.route_id, r.direction), r.a][r.b] = r.minutes
    near = {a: {b: m * DETOUR / SPEED for b, q in stops.items() if b != a and (m := metres(p, q)) <= CITY.walk.max_transfer_walk_m} for a, p in stops.items()}
    origins = {r.origin: (r.lat, r.lon) for r in reference._origins(spark, DATA).collect()}
    return stops, waits, rides, near, modes, origins


def ridden(town, origin):
    """Least minutes at which each stop can be left after riding: the rules applied to everything until nothing improves."""
    stops, waits, rides, near, modes, _ = town
    boarded, arrived = {}, {}

    def better(table, key, value):
        if value < table.get(key, np.inf) - 1e-12:
            table[key] = value
            return True
        return False

    for s, p in stops.items():
        if (m := metres(origin, p)) <= CITY.walk.max_access_m:
            for line, wait in waits[s].items():
                better(boarded, (s, line), m * DETOUR / SPEED + wait)
    moved = bool(boarded)
    while moved:
        moved = False
        for (s, line), t in [*boarded.items(), *arrived.items()]:
            for b, minutes in rides.get((line, s), {}).items():
                moved |= better(arrived, (b, line), t + minutes)
        for (s, line), t in list(arrived.items()):
            for b, walk in {s: 0.0, **near[s]}.items():
                for other, wait in waits[b].items():
                    if other != line:
                        moved |= better(boarded, (b, other), t + PENALTY[modes[other]] + walk + wait)
    out = {}
    for (s, _), t in arrived.items():
        out[s] = min(out.get(s, np.inf), t)
    return out


def test_transit_and_point_times_and_trips(spark, town):
    stops, *_, origins = town
    got, points = defaultdict(dict), defaultdict(dict)
    for r in catalog.queries()["transit_times"](spark, DATA).collect():
        got[r.origin][r.stop_id] = r.minutes
    for r in catalog.queries()["point_times"](spark, DATA).collect():
        points[r.origin][r.point] = r.minutes
    trips = {r.trip: r for r in catalog.queries()["trips_between_zones"](spark, DATA).collect()}
    zone = lambda o: f"{o[0]}{int(o[1:]) + 1:0{len(o) - 1}}"
    for o, place in origins.items():
        want = ridden(town, place)
        assert got[o].keys() == want.keys() and all(abs(got[o][s] - want[s]) < 1e-6 for s in want)
        walk = {s: m * DETOUR / SPEED for s, p in stops.items() if (m := metres(place, p)) <= CITY.walk.max_access_m}
        for s, t in want.items():
            for p in stops:
                if (m := metres(stops[s], stops[p])) <= CITY.walk.max_access_m:
                    walk[p] = min(walk.get(p, np.inf), t + m * DETOUR / SPEED)
        assert points[o].keys() == walk.keys() and all(abs(points[o][p] - walk[p]) < 1e-6 for p in walk)
        end = origins.get(zone(o))
        if end is not None:
            direct = metres(place, end)
            best = min([t + m * DETOUR / SPEED for s, t in want.items() if (m := metres(stops[s], end)) <= CITY.walk.max_access_m] + [direct * DETOUR / SPEED] * (direct <= 10_000), default=None)
            assert (best is None) == (o not in trips) and (best is None or abs(trips[o].total - best) < 1e-6)
    assert sum(map(len, got.values())) > 20 and trips


def test_hilbert_order(spark):
    """The curve by its definition: four quadrants, the first turned, the last turned the other way."""
    got = {r.node: r.node_ix for r in catalog.queries()["hilbert_order"](spark, DATA).collect()}
    cells = {r.key: (round(r.lat * 100_000), round(r.lon * 100_000)) for r in reference.suppliers(spark, DATA).collect()}
    x0, y0 = (min(c[i] for c in cells.values()) for i in (0, 1))
    bits = max(max(c[i] for c in cells.values()) - o for i, o in ((0, x0), (1, y0))).bit_length()

    def place(x, y, n):
        if n == 0:
            return 0
        half = 1 << (n - 1)
        right, upper = x >= half, y >= half
        x, y = x % half, y % half
        quadrant = {(False, False): 0, (False, True): 1, (True, True): 2, (True, False): 3}[right, upper]
        if quadrant == 0:
            x, y = y, x
        elif quadrant == 3:
            x, y = half - 1 - y, half - 1 - x
        return quadrant * half * half + place(x, y, n - 1)

    order = sorted(cells, key=lambda k: (place(cells[k][0] - x0, cells[k][1] - y0, bits), cells[k], k))
    assert [got[k] for k in order] == list(range(len(order)))


def test_contours(spark):
    """Crossings of every square of four cell centres; a missing cell lies outside, a crossing beside it in the middle."""
    grid = reference.GRID
    values = {r.cell: float(int(r.minutes)) for r in reference._raster(spark, DATA).collect()}
    got = {(r.threshold, r.row, r.col): (r.segments, r.lat_sum, r.lon_sum) for r in catalog.queries()["raster_contours"](spark, DATA).collect()}
    want = {}
    at = lambda r, c: (grid.south + (r + 0.5) * grid.d_lat, grid.west + (c + 0.5) * grid.d_lon)
    for threshold in (10.5, 20.5):
        for r in range(grid.rows - 1):
            for c in range(grid.cols - 1):
                corners = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]
                v = [values.get(i * grid.cols + j, np.inf) for i, j in corners]
                crossings = []
                for k in range(4):
                    a, b = v[k], v[(k + 1) % 4]
                    if (a <= threshold) != (b <= threshold):
                        f = (threshold - a) / (b - a) if np.isfinite(a) and np.isfinite(b) else 0.5
                        p, q = at(*corners[k]), at(*corners[(k + 1) % 4])
                        crossings.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
                if crossings:
                    want[threshold, r, c] = (len(crossings) // 2, sum(x[0] for x in crossings), sum(x[1] for x in crossings))
    assert got.keys() == want.keys() and len(want) > 50
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 and abs(got[k][2] - want[k][2]) < 1e-5, k
    assert raster.TIME_CAP > 0 and tables.QUERIES


def test_branch_waits(spark):
    """Waits where lines split, hop by hop."""
    rows = reference.timed_rows(spark, DATA).filter("arr is not null").join(reference.trip_lines(spark, DATA), "trip_id").collect()
    known = {r.stop_id for r in reference.table(spark, DATA, "stops").select(reference.key("stop_id").alias("stop_id")).collect()}
    trips = defaultdict(list)
    for r in rows:
        if r.stop_id in known:
            trips[r.trip_id, r.route_id].append((r.seq, r.stop_id, r.arr, r.dep if r.dep is not None else -1, r.dep))
    towards, ride, came = defaultdict(int), defaultdict(list), set()
    for (_, route), calls in trips.items():
        before = None
        calls.sort(key=lambda c: c[:4])
        for x, y in zip(calls, calls[1:]):
            if x[1] == y[1]:
                continue
            if before is not None:
                came.add((x[1], y[1], route, before))
            before = x[1]
            if x[4] is not None and 25_200 <= x[4] < 72_000:
                towards[x[1], y[1], route] += 1
                ride[x[1], y[1], route].append(max(0, y[2] - x[4]) / 60)
    got = {(r.a, r.b, r.route_id): (r.minutes, r.extra) for r in catalog.queries()["branch_waits"](spark, DATA).collect()}
    half = lambda n: min(15.0, max(1.0, 780 / n / 2))
    assert got.keys() == towards.keys() and len(got) > 100
    for (a, b, route), n in towards.items():
        onward = sum(m for (x, y, other), m in towards.items() if x == a and other == route and (a, b, route, y) not in came)
        gain = half(n) - half(onward) if onward else 0.0
        extra = 0.0 if n >= 0.9 * onward or gain < 0.1 else gain
        minutes, mine = got[a, b, route]
        assert abs(mine - extra) <= 0.0051 and abs(minutes - max(0.4, float(np.median(ride[a, b, route])))) < 1e-9


def test_located_faults(spark):
    """The faults of raw_lines with their places: the same records as p3_found, and the text before a quoting fault has none."""
    from isotrek.operators.records import parse_line

    lines = {r.line_id: r.line for r in reference.table(spark, DATA, "raw_lines").collect()}
    located = catalog.queries()["p3_located"](spark, DATA).collect()
    found = {(int(r.rec_key), r.reason) for r in catalog.queries()["p3_found"](spark, DATA).collect() if r.src == "raw_lines"}
    assert {(r.line_id, r.reason) for r in located} == found and found
    for r in located:
        assert 0 <= r.at_offset <= len(lines[r.line_id])
        if r.reason == "quoting" and r.detail != "quote left open":
            assert parse_line(lines[r.line_id][: r.at_offset])[1] is None or r.detail == "line break outside quotes", r
