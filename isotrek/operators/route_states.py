"""Search by the second rule set: route states seeded from the nearest stations, platform access, itineraries with branch waits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.functions.geo import METRES_PER_DEGREE
from isotrek.operators.search import MAX_SENT_EDGES, Csr, collected, distances_m, settle
from isotrek.operators.variants import BRIDGE_LIMIT_M
from isotrek.session import ship

SEEDS, CANDIDATES, WALK_M_PER_MIN = 8, 4, 75.0
STEP = "struct<kind:string,state:int,to_state:int,wait:double,minutes:double>"


@dataclass
class RouteStates:
    """One city's route states on the driver; everything is indexed from 0."""

    station: np.ndarray  # by state
    route: list[str]
    wait: np.ndarray
    access: np.ndarray
    graph: Csr
    extra: dict[tuple[int, int], float]
    lat: np.ndarray  # by station
    lon: np.ndarray
    usable: np.ndarray  # by state: false for buses when they are off
    rivers: np.ndarray | None = None  # segments (x1, y1, x2, y2), planar metres about origin
    bridges: np.ndarray | None = None  # points (x, y)
    origin: tuple[float, float] = (0.0, 0.0)

    def walks_m(self, lat: float, lon: float, stations: np.ndarray) -> np.ndarray:
        """Metres on foot from a place to stations: straight lines, or around rivers if there are any."""
        straight = distances_m(lat, lon, self.lat[stations], self.lon[stations])
        if self.rivers is None or not len(self.rivers):
            return straight
        east = METRES_PER_DEGREE * np.cos(np.radians(self.origin[0]))
        plane = lambda la, lo: np.column_stack([(np.atleast_1d(lo) - self.origin[1]) * east, (np.atleast_1d(la) - self.origin[0]) * METRES_PER_DEGREE])
        return around_rivers(plane(lat, lon)[0], plane(self.lat[stations], self.lon[stations]), self.rivers, self.bridges if self.bridges is not None else np.zeros((0, 2)))


def over_river(a: np.ndarray, b: np.ndarray, rivers: np.ndarray) -> np.ndarray:
    """Whether each segment a[i]-b[i] strictly crosses any river segment."""
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    a, b, c, d = a[:, None], b[:, None], rivers[None, :, :2], rivers[None, :, 2:]
    return ((turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)).any(axis=1)


def around_rivers(a: np.ndarray, targets: np.ndarray, rivers: np.ndarray, bridges: np.ndarray, limit_m: float = BRIDGE_LIMIT_M) -> np.ndarray:
    """Metres from a to each target: straight where no river lies between, else over the best bridge within the limit whose legs cross none, else infinite."""
    metres = np.hypot(*(targets - a).T)
    cut_off = np.flatnonzero(over_river(np.repeat(a[None], len(targets), axis=0), targets, rivers))
    metres[cut_off] = np.inf
    if len(cut_off) and len(bridges):
        to_bridge = np.hypot(*(bridges - a).T)
        free = ~over_river(np.repeat(a[None], len(bridges), axis=0), bridges, rivers)
        for i in cut_off:
            total = to_bridge + np.hypot(*(bridges - targets[i]).T)
            ways = np.flatnonzero(free & (total <= limit_m))
            ways = ways[~over_river(bridges[ways], np.repeat(targets[i][None], len(ways), axis=0), rivers)] if len(ways) else ways
            if len(ways):
                metres[i] = total[ways].min()
    return metres


def route_states(states: DataFrame, edges: DataFrame, stations: DataFrame, rail_only: bool = False, rivers: DataFrame | None = None, bridges: DataFrame | None = None, origin: tuple[float, float] = (0.0, 0.0), limit: int = MAX_SENT_EDGES) -> RouteStates:
    """From states (state, station, route_id, wait, access, rail), edges (src, dst, weight, extra_wait), stations (station, lat, lon).

    rivers (x1, y1, x2, y2), bridges (x, y): planar metres about ``origin``. Tables are counted before they are
    collected: one of over ``limit`` rows is no city's network and raises TooManyRows.
    """
    s, e, p = (collected(df, columns, limit) for df, columns in (
        (states, ["state", "station", "route_id", "wait", "access", "rail"]), (edges, ["src", "dst", "weight", "extra_wait"]), (stations, ["station", "lat", "lon"])))
    water, over = (None if df is None else collected(df, columns, limit).to_numpy(float) for df, columns in ((rivers, ["x1", "y1", "x2", "y2"]), (bridges, ["x", "y"])))
    usable = s["rail"].to_numpy(bool) if rail_only else np.ones(len(s), bool)
    on = usable[e["src"]] & usable[e["dst"]] if len(e) else np.zeros(0, bool)
    e = e[on]
    graph = Csr.of(len(s), e["src"].to_numpy(int), e["dst"].to_numpy(int), np.asarray(e["weight"].to_numpy("float32"), float))
    extra = {(a, b): x for a, b, x in zip(e["src"], e["dst"], e["extra_wait"]) if x}
    return RouteStates(s["station"].to_numpy(int), s["route_id"].tolist(), s["wait"].to_numpy(float), s["access"].to_numpy(float), graph, extra, p["lat"].to_numpy(float), p["lon"].to_numpy(float), usable, water, over, origin)


def solve(net: RouteStates, lat: float, lon: float) -> tuple[dict[int, float], dict[int, int], dict[int, tuple[float, int]], dict[int, float]]:
    """The nearest stations, by their walk around rivers, are where a search starts. Minutes and predecessors by state, (minutes, state) by station once back in the street, and the walk to each seed state."""
    open_stations = np.unique(net.station[net.usable])
    straight = distances_m(lat, lon, net.lat[open_stations], net.lon[open_stations])
    candidates = open_stations[np.argsort(straight, kind="stable")][: SEEDS * CANDIDATES]
    metres = net.walks_m(lat, lon, candidates)
    order = np.argsort(metres, kind="stable")
    nearest = candidates[order[np.isfinite(metres[order])]][:SEEDS]
    walks = dict(zip(candidates.tolist(), (metres / WALK_M_PER_MIN).tolist()))
    seeds, walked = [], {}
    for state in np.flatnonzero(np.isin(net.station, nearest) & net.usable):
        walked[int(state)] = float(walks[int(net.station[state])] + net.access[state])
        seeds.append((walked[int(state)] + float(net.wait[state]), int(state)))
    best, before = settle(net.graph, seeds)
    stations: dict[int, tuple[float, int]] = {}
    for state in sorted(best):
        out, at = best[state] + float(net.access[state]), int(net.station[state])
        if at not in stations or out < stations[at][0]:
            stations[at] = (out, state)
    return best, before, stations, walked


def station_minutes(net: RouteStates, origins: DataFrame) -> DataFrame:
    """(origin, station, minutes) for origins (origin, lat, lon). Towards a place the same search runs from it, as this rule set has no reverse one."""
    ship(origins.sparkSession)
    sent = origins.sparkSession.sparkContext.broadcast(net)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(o, s, m) for o, la, lo in zip(batch["origin"], batch["lat"], batch["lon"]) for s, (m, _) in solve(sent.value, la, lo)[2].items()]
            yield pd.DataFrame(out, columns=["origin", "station", "minutes"])

    return origins.select(F.col("origin").cast("string").alias("origin"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna().mapInPandas(search, "origin string, station int, minutes double")


def steps_to(net: RouteStates, origin: tuple[float, float], point: tuple[float, float]) -> tuple[float, list[dict]]:
    """Minutes and steps to a point: all on foot, or through the best station; a branch's extra wait counts as waiting, leaving the platform with the last walk."""
    best, before, stations, walked = solve(net, *origin)
    total, via, on_foot = (d := float(distances_m(*origin, np.array([point[0]]), np.array([point[1]]))[0]) / WALK_M_PER_MIN), None, d
    walks = distances_m(*point, net.lat, net.lon) / WALK_M_PER_MIN
    for station, (minutes, _) in stations.items():
        if minutes + walks[station] < total:
            total, via, on_foot = minutes + float(walks[station]), station, float(walks[station])
    step = lambda kind, a, b, wait, minutes: {"kind": kind, "state": a, "to_state": b, "wait": wait, "minutes": minutes}
    if via is None:
        return total, [step("walk", None, None, 0.0, total)]
    chain, state = [], stations[via][1]
    while state != -1:
        chain.append(state)
        state = before[state]
    chain.reverse()
    steps, start, extra = [step("walk", None, chain[0], 0.0, walked[chain[0]])], chain[0], 0.0
    for a, b in zip(chain, [*chain[1:], None]):
        if b is not None and net.route[a] == net.route[b] and net.station[a] != net.station[b]:
            extra += net.extra.get((a, b), 0.0)
            continue
        steps.append(step("ride", start, a, float(net.wait[start]) + extra, best[a] - best[start] - extra))
        if b is not None:
            steps.append(step("walk", a, b, 0.0, best[b] - best[a] - float(net.wait[b])))
            start, extra = b, 0.0
    return total, [*steps, step("walk", chain[-1], None, 0.0, on_foot + float(net.access[chain[-1]]))]


def route_itineraries(net: RouteStates, trips: DataFrame) -> DataFrame:
    """(trip, total, steps) for trips (trip, lat, lon, to_lat, to_lon); walking all the way is always possible, so every trip has a row."""
    ship(trips.sparkSession)
    sent = trips.sparkSession.sparkContext.broadcast(net)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(t, *steps_to(sent.value, (a, b), (c, d))) for t, a, b, c, d in zip(*(batch[x] for x in ("trip", "lat", "lon", "to_lat", "to_lon")))]
            yield pd.DataFrame(out, columns=["trip", "total", "steps"])

    rows = trips.select(F.col("trip").cast("string").alias("trip"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "to_lat", "to_lon"))).dropna()
    return rows.mapInPandas(search, f"trip string, total double, steps array<{STEP}>")
