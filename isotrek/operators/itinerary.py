"""Itineraries: the legs behind a travel time, from the chain of search states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrek.operators.search import Looked, NetArrays, StateGraph, distances_m, network_in_worker, states_in_worker, stops_walked_to, street_reach, street_routes, walkable_stops
from isotrek.params import Walk
from isotrek.session import ship, spread

LEG = "struct<type:string,minutes:double,line:int,from_stop:int,to_stop:int,stops:array<int>,walk_minutes:double,penalty_minutes:double>"
RESULT = f"trip string, total double, legs array<{LEG}>, path array<struct<lat:double,lon:double>>"


def _leg(kind: str, minutes: float, line: int | None = None, a: int | None = None, b: int | None = None, stops: list[int] | None = None, walk: float | None = None, penalty: float | None = None) -> dict:
    return {"type": kind, "minutes": minutes, "line": line, "from_stop": a, "to_stop": b, "stops": stops, "walk_minutes": walk, "penalty_minutes": penalty}


def _edge(table: Looked, key: tuple) -> float:
    if key not in table:
        raise ValueError(f"inconsistent network: no edge {key}")
    return table[key]


def legs_of(states: StateGraph, chain: list[int]) -> list[dict]:
    """Legs of a chain of states in travel order; consecutive hops of a line become one ride."""
    legs: list[dict] = []
    for a, b in zip(chain, chain[1:]):
        stop_a, stop_b, line = int(states.stop[a]), int(states.stop[b]), int(states.line[b])
        if states.kind[b] == 2:
            minutes, last = _edge(states.ride, (line, stop_a, stop_b)), legs[-1] if legs else None
            if last and last["type"] == "ride" and last["line"] == line:
                last["minutes"] += minutes
                last["to_stop"] = stop_b
                last["stops"].append(stop_b)
            else:
                legs.append(_leg("ride", minutes, line, stop_a, stop_b, [stop_a, stop_b]))
            continue
        if states.kind[a] == 2:
            walk = 0.0 if stop_a == stop_b else _edge(states.walk_between, (stop_a, stop_b))
            penalty = float(states.penalty[line])
            legs.append(_leg("transfer", penalty + walk, None, stop_a, stop_b, None, walk, penalty))
        legs.append(_leg("wait", _edge(states.wait, (stop_b, line)), line, stop_b, stop_b))
    return legs


def best_trip(net: NetArrays, states: StateGraph, anchor: tuple[float, float], point: tuple[float, float], near: list[tuple[int, float]], ends: list[tuple[int, float]], direct: float) -> tuple[float, list[dict], list[tuple[float, float]]] | None:
    """Total, legs and polyline of the best way; walking all the way wins ties, then the lower stop; None if out of reach.

    near, ends: (stop, minutes) of the walks between the anchor, or the point, and the stops; ``direct``:
    minutes of walking all the way, infinite where that is too far. The states' direction is the trip's.
    """
    reverse = states.reverse
    seeds = states.entries(near) if ends else []
    found = states.search(seeds)
    stops, at_stops, best_states = states.stop_minutes(found)
    total, via = direct, None
    for stop, minutes in ends:
        i = np.searchsorted(stops, stop)
        if i < len(stops) and stops[i] == stop and at_stops[i] + minutes < total:
            total, via = float(at_stops[i] + minutes), int(best_states[i])
    if not np.isfinite(total):
        return None
    start, end = (point, anchor) if reverse else (anchor, point)
    place = lambda s: (float(net.stop_lat[s]), float(net.stop_lon[s]))
    if via is None:
        return total, [_leg("walk", total)] if total > 0 else [], [start, end]
    chain = states.chain(found, seeds, via)
    chain = chain if reverse else chain[::-1]
    first, last = int(states.stop[chain[0]]), int(states.stop[chain[-1]])
    walks = (dict(ends), dict(near)) if reverse else (dict(near), dict(ends))
    head, tail = walks[0][first], walks[1][last]
    legs = [*([_leg("walk", head, None, None, first)] if head else []), *legs_of(states, chain), *([_leg("walk", tail, None, last, None)] if tail else [])]
    path = [start]
    for leg in legs:
        for s in leg["stops"] or ([leg["to_stop"]] if leg["to_stop"] is not None else []):
            if path[-1] != place(s):
                path.append(place(s))
    return total, legs, path if path[-1] == end else [*path, end]


def itineraries(net: NetArrays, trips: DataFrame, modes: tuple[str, ...] | None = None, reverse: bool = False, direct_walk_m: float | None = None, scale_minutes: float | None = None, walked: DataFrame | None = None) -> DataFrame:
    """(trip, total, legs, path) for trips (trip, lat, lon, to_lat, to_lon); unreachable ones give no row.

    ``reverse``: (lat, lon) is the place to be reached and the trip runs from (to_lat, to_lon).
    ``scale_minutes``: trips longer than the scale count as unreachable. Totals equal point_times.
    ``walked`` (trip, near array<struct<stop_ix,minutes>>, ends, direct double): the walks along streets between
    (lat, lon), or (to_lat, to_lon), and the stops, and all the way (street_walks); else straight lines.
    """
    ship(trips.sparkSession)
    sent, key = trips.sparkSession.sparkContext.broadcast(net), net.digest
    direct_m, straight = max(net.walk.max_access_m, direct_walk_m or 0.0), walked is None

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states, out, net = states_in_worker(key, lambda: sent.value, modes, reverse), [], network_in_worker(key, lambda: sent.value)
            for trip, lat, lon, to_lat, to_lon, near, ends, direct in zip(*(batch[c] for c in ("trip", "lat", "lon", "to_lat", "to_lon", "near", "ends", "direct"))):
                if straight:
                    near, ends = walkable_stops(net, lat, lon), walkable_stops(net, to_lat, to_lon)
                    metres = float(distances_m(lat, lon, np.array([to_lat]), np.array([to_lon]))[0])
                    direct = net.walk.minutes(metres) if metres <= direct_m else np.inf
                else:
                    near, ends = ([(int(w["stop_ix"]), float(w["minutes"])) for w in (x if x is not None else ())] for x in (near, ends))
                    direct = np.inf if direct is None or np.isnan(direct) else float(direct)
                found = best_trip(net, states, (lat, lon), (to_lat, to_lon), near, ends, direct)
                if found and (scale_minutes is None or found[0] <= scale_minutes):
                    out.append((trip, found[0], found[1], [{"lat": a, "lon": b} for a, b in found[2]]))
            yield pd.DataFrame(out, columns=["trip", "total", "legs", "path"])

    rows = trips.select(F.col("trip").cast("string").alias("trip"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "to_lat", "to_lon"))).dropna()
    if straight:
        none = F.lit(None).cast("array<struct<stop_ix:int,minutes:double>>")
        rows = rows.withColumn("near", none).withColumn("ends", none).withColumn("direct", F.lit(None).cast("double"))
    else:
        rows = rows.join(walked.select("trip", "near", "ends", "direct"), "trip", "left")
    return spread(rows).mapInPandas(search, RESULT)


def street_walks(edges: DataFrame, trips: DataFrame, stop_snaps: DataFrame, walk: Walk, direct_walk_m: float | None = None) -> DataFrame:
    """(trip, near, ends, direct) for itineraries along streets.

    trips (trip, node_a, snap_a, node_b, snap_b): the street nodes of both places, null beyond the snap limit,
    which cannot walk at all; stop_snaps (stop_ix, node, snap_m). Walks to stops are within max_access_m, the
    whole way within the larger of that and ``direct_walk_m``; all in street metres, snaps included.
    """
    minutes = lambda c: F.col(c) / walk.speed_m_per_min
    parts = []
    for side in ("a", "b"):
        ends = trips.select(F.col("trip").cast("string").alias("source"), F.col(f"node_{side}").alias("node"), F.col(f"snap_{side}").alias("metres0"))
        reached = stops_walked_to(street_reach(edges, ends, walk.max_access_m), stop_snaps, walk.max_access_m, walk.speed_m_per_min)
        parts.append(reached.groupBy(F.col("origin").alias("trip")).agg(F.array_sort(F.collect_list(F.struct("stop_ix", "minutes"))).alias("near" if side == "a" else "ends")))
    whole = street_routes(edges, trips.withColumnRenamed("trip", "route"), max(walk.max_access_m, direct_walk_m or 0.0)).select(F.col("route").alias("trip"), minutes("metres").alias("direct"))
    ids = trips.select(F.col("trip").cast("string").alias("trip")).distinct()
    return ids.join(parts[0], "trip", "left").join(parts[1], "trip", "left").join(whole, "trip", "left").select("trip", "near", "ends", "direct")


def walked_legs(found: DataFrame, places: DataFrame, edges: DataFrame, stop_snaps: DataFrame, shaped: DataFrame, limit_m: float) -> DataFrame:
    """(trip, leg, metres, points): the street polyline of every walk and transfer leg of itineraries.

    places (trip, from_node, from_snap, to_node, to_snap): street nodes of the trip's start and end in travel
    order; shaped: edges for route_line. A transfer at one stop has no way to walk and gives no row.
    """
    legs = found.select("trip", F.posexplode("legs").alias("leg", "l")).filter("l.type = 'walk' or (l.type = 'transfer' and l.from_stop <> l.to_stop)")
    legs = legs.select("trip", "leg", F.col("l.from_stop").alias("u"), F.col("l.to_stop").alias("v")).join(places, "trip")
    at = lambda c, n: stop_snaps.select(F.col("stop_ix").alias(c), F.col("node").alias(f"{n}_at"), F.col("snap_m").alias(f"{n}_away"))
    both = legs.join(at("u", "u"), "u", "left").join(at("v", "v"), "v", "left")
    pick = lambda c, n, end, w: F.when(F.col(c).isNull(), F.col(end)).otherwise(F.col(f"{n}_{w}"))
    pairs = both.select(
        F.concat_ws("#", "trip", "leg").alias("route"), "trip", "leg", pick("u", "u", "from_node", "at").alias("node_a"), pick("u", "u", "from_snap", "away").alias("snap_a"),
        pick("v", "v", "to_node", "at").alias("node_b"), pick("v", "v", "to_snap", "away").alias("snap_b"),
    )
    routes = street_routes(edges, pairs, limit_m)
    drawn = route_line(routes.select("route", "nodes"), shaped)
    return pairs.select("route", "trip", "leg").join(routes.select("route", "metres"), "route").join(drawn, "route", "left").select("trip", "leg", "metres", "points")


def describe_leg(leg: Column, stop_names: Column, line_names: Column) -> Column:
    """One line of text for a leg; stop_names and line_names are maps from index to name."""
    minutes = F.greatest(F.lit(1), F.floor(leg["minutes"] + 0.5)).cast("string")
    at = lambda i: F.coalesce(F.try_element_at(stop_names, leg[i]), F.lit("your place"))
    line = F.coalesce(F.try_element_at(line_names, leg["line"]), F.lit("?"))
    return (
        F.when(leg["type"] == "walk", F.concat(F.lit("Walk "), minutes, F.lit(" min to "), at("to_stop")))
        .when(leg["type"] == "wait", F.concat(F.lit("Wait "), minutes, F.lit(" min for "), line))
        .when(leg["type"] == "ride", F.concat(F.lit("Ride "), line, F.lit(" to "), at("to_stop"), F.lit(", "), minutes, F.lit(" min")))
        .when(leg["type"] == "transfer", F.concat(F.lit("Change at "), at("to_stop"), F.lit(", "), minutes, F.lit(" min")))
    )


def route_line(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, points): polylines of street routes (route, nodes array) along the edges' inner points.

    edges (a, b, lat_a, lon_a, lat_b, lon_b, shape array of points from a to b), each once under its lower node.
    """
    steps = nodes.select("route", F.posexplode("nodes").alias("pos", "u"), F.col("nodes").alias("_n")).withColumn("v", F.get("_n", F.col("pos") + 1)).drop("_n").filter("v is not null")
    point = lambda la, lo: F.struct(F.col(la).alias("lat"), F.col(lo).alias("lon"))
    joined = steps.join(edges, (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b")))
    ahead = F.concat(F.array(point("lat_a", "lon_a")), "shape", F.array(point("lat_b", "lon_b")))
    part = F.when(F.col("u") == F.col("a"), ahead).otherwise(F.reverse(ahead))
    ordered = joined.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    return ordered.select("route", F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["part"]).otherwise(F.slice(p["part"], 2, F.size(p["part"]))))).alias("points"))
