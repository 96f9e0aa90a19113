"""Networks too large to send are searched in mapped files, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrek.functions.numbers import round_half_even
from isotrek.operators import mapped, search
from isotrek.operators.itinerary import itineraries
from isotrek.plans import reference

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return reference._timetable(spark, D)


def same(got, want):
    assert got.keys() == want.keys() and got and np.allclose([got[k] for k in want], [want[k] for k in want], rtol=0, atol=1e-8)


@pytest.mark.parametrize("shared", [True, False])
def test_itineraries_of_networks_too_large_to_send(spark, found, monkeypatch, shared):
    """beyond the limit they ended with an error. Without a shared folder that is a local path, the arrays are made in the executor's own."""
    if not shared:
        monkeypatch.setattr(mapped, "shared_folder", lambda *_: None)
    monkeypatch.setattr(mapped, "ROWS_AT_ONCE", 37)
    corners = reference._origins(spark, D)
    ends = corners.select(F.col("origin").alias("to"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    trips = corners.crossJoin(ends).filter("abs(lat - to_lat) < 0.3").select(F.concat_ws("-", "origin", "to").alias("trip"), "lat", "lon", "to_lat", "to_lon")
    small, large = ({r.trip: r for r in itineraries(search.network_arrays(found, reference.CITY, limit), trips).collect()} for limit in (search.MAX_NUMBERED_EDGES, 1))
    same({k: r.total for k, r in large.items()}, {k: r.total for k, r in small.items()})
    way = lambda r: [(leg.type, leg.line, leg.from_stop, leg.to_stop, leg.stops) for leg in r.legs]
    assert {k: way(r) for k, r in large.items()} == {k: way(r) for k, r in small.items()} and any(len(r.legs) > 2 for r in large.values())


def test_waits_round_as_in_spark(spark):
    n = spark.range(1, 3000).select(F.col("id").cast("double").alias("n"))
    want = [r[0] for r in n.select(round_half_even(F.lit(900.0) / F.col("n") * F.lit(0.5), 2)).collect()]
    assert mapped._rounded(900.0 / np.arange(1, 3000) * 0.5).tolist() == want


def test_point_times_of_networks_too_large_to_send(spark, found, monkeypatch):
    """beyond the limit all changes of line were joined. Repeated points and origins count once, at their best; without a position they do not count."""
    monkeypatch.setattr(search, "joined_stop_times", lambda *_: pytest.fail("searched as joins"))
    monkeypatch.setattr(mapped, "ROWS_AT_ONCE", 41)
    monkeypatch.setattr(search, "POINTS_AT_ONCE", 23)
    stops = found.stops.dropna(subset=["lat", "lon"])
    near = stops.select(F.col("stop_id").alias("point"), "lat", "lon")
    points = near.union(near.select("point", F.col("lat") + 0.002, "lon")).union(near.limit(1).select(F.lit("lost"), F.lit(None).cast("double"), "lon"))
    corners = reference._origins(spark, D)
    origins = corners.union(corners.select("origin", F.col("lat") + 0.001, "lon")).union(corners.limit(1).select(F.lit("lost"), F.lit(None).cast("double"), "lon"))
    small, large = ([(r.origin, r.point, r.minutes) for r in search.timetable_point_times(found, reference.CITY, origins, points, 2000.0, limit).collect()] for limit in (search.MAX_NUMBERED_EDGES, 1))
    assert len(large) == len(small) > len({o for o, *_ in small})
    same({r[:2]: r[2] for r in large}, {r[:2]: r[2] for r in small})


def test_stop_times_of_networks_too_large_to_send(spark, found, monkeypatch):
    """beyond the limit all changes of line were joined. Modes that are not in use are not boarded; a repeated origin is searched again, one without a position not at all."""
    corners = reference._origins(spark, D)
    origins = corners.union(corners).union(corners.limit(1).select(F.lit("lost"), F.lit(None).cast("double"), "lon"))
    times = lambda limit, **k: [(r.origin, r.stop_id, r.minutes) for r in search.timetable_stop_times(found, reference.CITY, origins, limit=limit, **k).collect()]
    choices = (None, ("bus", "rail"), ("bus",), ("rail",), ())
    small = [times(search.MAX_NUMBERED_EDGES, modes=modes) for modes in choices]
    with monkeypatch.context() as m:
        m.setattr(search, "joined_stop_times", lambda *_: pytest.fail("searched as joins"))
        m.setattr(mapped, "ROWS_AT_ONCE", 29)
        large = [times(1, modes=modes) for modes in choices]
    for got, want in zip(large, small):
        assert len(got) == len(want) == 2 * len({r[:2] for r in want})
        if want:
            same({r[:2]: r[2] for r in got}, {r[:2]: r[2] for r in want})
    assert large[0] and large[-1] == [] and min(map(len, large[1:-1])) < len(large[0])
