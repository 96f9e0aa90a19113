"""Small feeds made in code: a point is so many metres east and north of a base."""

import math

BASE = (41.6, -4.7)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def at(east, north):
    return BASE[0] + north / 111_194.9, BASE[1] + east / (111_194.9 * math.cos(math.radians(BASE[0])))


def feed(spark, stops, trips, route_types=None):
    """stops {id: (east, north)}; trips [(route, direction, [(stop, minute, ..)])]; minutes count from 8 o'clock."""
    clock = lambda m: None if m is None else f"{8 + m // 60}:{m % 60:02}:00"
    times = [(f"t{i}", clock(m), clock(m), s, str(k + 1), "0") for i, (_, _, calls) in enumerate(trips) for k, (s, m) in enumerate(calls)]
    text = lambda rows, cols: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in cols) + ", row_no long")
    types = route_types or {}
    return {
        "stops": text([(s, f"Stop {s}", *map(repr, at(*p))) for s, p in stops.items()], ["stop_id", "stop_name", "stop_lat", "stop_lon"]),
        "routes": text([(r, types.get(r, "3"), r) for r in sorted({t[0] for t in trips})], ["route_id", "route_type", "route_short_name"]),
        "trips": text([(r, "W", f"t{i}", d) for i, (r, d, _) in enumerate(trips)], ["route_id", "service_id", "trip_id", "direction_id"]),
        "stop_times": text(times, ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type"]),
        "calendar": text([("W", *"1111100", "20260101", "20271231")], ["service_id", *WEEKDAYS, "start_date", "end_date"]),
        "calendar_dates": text([("W", "20260102", "2")], ["service_id", "date", "exception_type"]),
    }


def six_an_hour(route, calls, direction="0"):
    return [(route, direction, [(s, m + 10 * k) for s, m in calls]) for k in range(6)]
