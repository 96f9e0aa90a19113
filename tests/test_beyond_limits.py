import pickle
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from isotrek.operators import search, service_days
from isotrek.operators.network import build_network
from isotrek.plans import reference
from tests.conftest import rows
from tests.feeds import at, feed, six_an_hour
from tests.test_transit import CITY


def test_networks_too_large_to_send(spark):
    tables = feed(spark, {"a": (0, 0), "b": (3000, 0), "c": (3200, 0), "d": (6000, 0)}, six_an_hour("R", [("a", 0), ("b", 6)]) + six_an_hour("Q", [("c", 3), ("d", 9)]))
    net = build_network(tables, spark.createDataFrame([("W",)], "service_id string"), CITY)
    origins = spark.createDataFrame([("o", *at(100, 0)), ("p", *at(6100, 50))], "origin string, lat double, lon double")
    for reverse in (False, True):
        sent, joined = ({(r.origin, r.stop_ix): r.minutes for r in search.network_stop_times(net, CITY, origins, None, reverse, limit=n).collect()} for n in (search.MAX_SENT_EDGES, 1))
        assert sent.keys() == joined.keys() and len(sent) >= 2 and np.allclose([sent[k] for k in sent], [joined[k] for k in sent])
    edges = spark.createDataFrame([(0, 1, 100), (0, 2, 300), (1, 2, 50)], "a long, b long, metres int")
    sources = spark.createDataFrame([("0", 0, 10.0), ("1", 2, 200.0), ("2", 9, 5.0)], "source string, node long, metres0 double")
    assert rows(search.street_reach(edges, sources, 160.0, 2)) == rows(search.street_reach(edges, sources, 160.0)) == [("0", 0, 10.0), ("0", 1, 110.0), ("0", 2, 160.0), ("2", 9, 5.0)]


def hub(lines):
    """A network without Spark: ``lines`` lines through one stop, each from a stop of its own to another, far apart."""
    n = 2 * lines + 1
    rides = np.array(sorted((i, a, b, 1.0 + i % 7) for i in range(lines) for a, b in ((1 + i, 0), (0, 1 + lines + i))), [("line_ix", "i4"), ("a", "i4"), ("b", "i4"), ("minutes", "f8")])
    waits = np.array(sorted((a, i, 1.0 + i % 5) for i in range(lines) for a in (1 + i, 0)), [("stop_ix", "i4"), ("line_ix", "i4"), ("wait", "f8")])
    none = np.array([], [("a", "i4"), ("b", "i4"), ("minutes", "f8")])
    return search.NetArrays(np.arange(n) / 10, np.zeros(n), ["bus"] * lines, rides, waits, none, {"bus": 2.0}, CITY.walk, [f"S{i}" for i in range(n)], [f"L{i}" for i in range(lines)])


def test_changes_of_line_are_no_edges():
    """300 lines at a stop are 89,700 changes of line; a worker needs only the 600 boardings."""
    lines = 300
    net = pickle.loads(pickle.dumps(hub(lines).fitting(1000)))
    for reverse in (False, True):
        states = net.states(None, reverse)
        stops, minutes, chosen = states.stop_minutes(states.search(states.entries([(1 if not reverse else 1 + lines, 0.0)])))
        got = dict(zip(stops.tolist(), minutes.tolist()))
        if not reverse:  # wait, ride, penalty, wait, ride; line 0 goes on without a change
            want = {0: 2.0} | {1 + lines + i: 2.0 + (0.0 if i == 0 else 2.0 + 1 + i % 5) + 1 + i % 7 for i in range(lines)}
        else:
            want = {0: 2.0} | {1 + i: 1.0 + i % 5 + 1 + i % 7 + (0.0 if i == 0 else 2.0 + 1.0) + 1.0 for i in range(lines)}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want])


def test_itineraries_of_networks_too_large_to_collect_by_ids(spark, monkeypatch):
    """the tables are numbered first, with the same itineraries."""
    d = "/root/testdata/sf0.001"
    small = rows(reference.trips_between_zones(spark, d))
    monkeypatch.setattr(search, "MAX_SENT_EDGES", 1)
    assert rows(reference.trips_between_zones(spark, d)) == small and small


def test_near_arrays_equal_brute_force():
    """what a worker finds around each point, over the 180th meridian and at the poles too."""
    r = np.random.default_rng(5)
    lat, lon = np.r_[r.uniform(41, 41.2, 300), r.uniform(89.9, 90, 40), r.uniform(-0.05, 0.05, 60), np.nan, -90.0], np.r_[r.uniform(0, 0.2, 300), r.uniform(-180, 180, 40), (r.uniform(179.95, 180.05, 60) + 180) % 360 - 180, 0.0, 7.0]
    for radius in (900.0, 4000.0):
        got = search.near_arrays(lat[::2], lon[::2], lat, lon, radius)
        metres = np.array([search.distances_m(y, x, lat, lon) for y, x in zip(lat[::2], lon[::2])])
        want = {(i, int(j)) for i, j in zip(*np.nonzero(metres <= radius))}
        pairs = list(zip(np.repeat(np.arange(got.size), np.diff(got.start)).tolist(), got.targets.tolist()))
        assert set(pairs) == want and all(abs(metres[p] - m) < 1e-6 for p, m in zip(pairs, got.costs))


def test_point_times_in_workers_equal_joins(spark):
    d = "/root/testdata/sf0.001"
    found, origins = reference._timetable(spark, d), reference._origins(spark, d)
    points = found.stops.select(F.col("stop_id").alias("point"), "lat", "lon")
    sent, joined = ({(r.origin, r.point): r.minutes for r in df.collect()} for df in (
        search.timetable_point_times(found, reference.CITY, origins, points, 2000.0),
        search.point_times(search.timetable_stop_times(found, reference.CITY, origins), found.stops, origins, points, reference.CITY.walk, 2000.0, "stop_id")))
    assert sent.keys() == joined.keys() and sent and np.allclose([sent[k] for k in sent], [joined[k] for k in sent], rtol=0, atol=1e-9)


def test_days_are_kept_as_bits(spark):
    """a service's days are one row for eight weeks until they are needed; across Mondays, block ends and days before 1970."""
    flags = {"A": (1, 1, 0, 0, 0, 0, 1), "B": (0, 0, 0, 0, 1, 0, 0)}
    spans = [("A", "20251201", "20260630"), ("A", "20260615", "20260705"), ("B", "19691220", "19700110"), ("B", "20260301", "20260201")]
    cal = spark.createDataFrame([(s, *map(str, flags[s]), a, b) for s, a, b in spans], ["service_id", *service_days.WEEKDAYS, "start_date", "end_date"])
    dates = spark.createDataFrame([("A", "20260107", "1", 1), ("A", "20260105", "2", 2), ("A", "20260105", "1", 1), ("C", "20260228", "1", 3)], ["service_id", "date", "exception_type", "n"])
    day = lambda t: datetime.strptime(t, "%Y%m%d").date()
    want = {(s, x) for s, a, b in spans for i in range((day(b) - day(a)).days + 1) for x in [day(a) + timedelta(i)] if flags[s][x.weekday()]}
    want = want - {("A", day("20260105"))} | {("A", day("20260107")), ("C", day("20260228"))}
    blocks = service_days.service_blocks(cal, dates, "n")
    assert {tuple(r) for r in service_days.days_of_blocks(blocks).collect()} == want and blocks.count() < len(want) / 5
    trips = spark.createDataFrame([("t1", "A"), ("t2", "A"), ("t3", "C")], ["trip_id", "service_id"])
    days = service_days.service_days(cal, dates, "n")
    for f in (service_days.reference_day, lambda d, t, since: service_days.typical_day(d, t, since=since)):
        assert rows(f(blocks, trips, F.to_date(F.lit("2026-01-06")))) == rows(f(days, trips, F.to_date(F.lit("2026-01-06")))) != []
