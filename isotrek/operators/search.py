"""Reach search: label-setting over arrays for many origins at once, and the same search as joins.

States of the transit search are S(stop): walked to and may board; B(stop, line): boarded, nothing
ridden; R(stop, line): after at least one hop. They are numbered once into a sparse matrix; a search to
a place runs on its transpose. Changes of line are no edges: whatever line one comes by, another one is
best reached from the best or, if that is the line itself, the second best line of the stop. Origins are
rows of a DataFrame; each task searches from its own. A network that is too large to send is searched as joins.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.operators import mapped
from isotrek.operators.network import Network, Timetable, numbered, walking_neighbors
from isotrek.operators.proximity import near_join
from isotrek.params import City, Walk
from isotrek.session import cut, keep, ship, spread

MAX_SENT_EDGES = 500_000  # rows of a table by ids that are sent to workers; more are numbered as tables first, or searched as joins, with the same result
MAX_NUMBERED_EDGES = 3_000_000  # rows of a numbered table that are sent: some 60 MB; more are searched as joins
EDGES_A_ROW = 6  # boardings that stops see, by their neighbours' too, for each row of that limit: 12 bytes each in a worker
POINTS_AT_ONCE = 5_000  # points whose stops are measured at once, for the same reason as below
PAIRS_AT_ONCE = 50_000  # pairs of stops whose boardings are listed at once, which bounds a worker's memory


class TooManyRows(ValueError):
    """A table that is not sent to workers."""


@dataclass
class Csr:
    """Directed weighted edges by source: those of i are targets[start[i]:start[i+1]]."""

    start: np.ndarray
    targets: np.ndarray
    costs: np.ndarray

    @staticmethod
    def of(n: int, sources: np.ndarray, targets: np.ndarray, costs: np.ndarray) -> Csr:
        order = np.argsort(sources, kind="stable")
        return Csr(np.searchsorted(sources[order], np.arange(n + 1)), targets[order], costs[order])

    @property
    def size(self) -> int:
        return len(self.start) - 1


def settle(graph: Csr, seeds: list[tuple[float, int]], limit: float = np.inf) -> tuple[dict[int, float], dict[int, int]]:
    """Least cost of every state within ``limit`` (inclusive) of the seeds, and each state's predecessor (-1 at a seed)."""
    best: dict[int, float] = {}
    before: dict[int, int] = {}
    heap: list[tuple[float, int]] = []
    for cost, state in seeds:
        if cost <= limit and cost < best.get(state, np.inf):
            best[state], before[state] = cost, -1
            heapq.heappush(heap, (cost, state))
    start, targets, costs = graph.start, graph.targets, graph.costs
    while heap:
        cost, state = heapq.heappop(heap)
        if cost > best[state]:
            continue
        a, b = start[state], start[state + 1]
        for target, step in zip(targets[a:b].tolist(), costs[a:b].tolist()):
            total = cost + step
            if total <= limit and total < best.get(target, np.inf):
                best[target], before[target] = total, state
                heapq.heappush(heap, (total, target))
    return best, before


def _least(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each run and its first place."""
    least = np.minimum.reduceat(values, starts)
    hits = np.flatnonzero(values == np.repeat(least, np.diff(np.r_[starts, len(values)])))
    return least, hits[np.searchsorted(hits, starts)]


class Looked:
    """Rows sorted by their key columns, looked up without a dictionary of them; of equal keys the last row counts."""

    def __init__(self, rows: np.ndarray, keys: tuple[str, ...], value: str):
        self.columns, self.values = [np.ascontiguousarray(rows[c]) for c in keys], rows[value]

    def _at(self, key: tuple) -> tuple[int, int]:
        a, b = 0, len(self.values)
        for column, x in zip(self.columns, key):
            a, b = a + np.searchsorted(column[a:b], x, side="left"), a + np.searchsorted(column[a:b], x, side="right")
        return a, b

    def __contains__(self, key: tuple) -> bool:
        a, b = self._at(key)
        return bool(a < b)

    def __getitem__(self, key: tuple) -> float:
        return float(self.values[self._at(key)[1] - 1])


@dataclass
class StateGraph:
    """The numbered search states of a network for one choice of modes and one direction; kind 0 S, 1 B, 2 R."""

    kind: np.ndarray
    stop: np.ndarray
    line: np.ndarray
    edges: Csr  # all but changes of line; turned around for a search towards a place
    reach: Csr  # from each stop that is ridden to, the B states of all lines at it and its neighbours, with penalty, walk and wait; never turned around
    ridden: np.ndarray  # the R states of stop i are ridden[i]:ridden[i+1]
    reverse: bool
    penalty: np.ndarray  # by line
    walk_between: Looked
    wait: Looked
    ride: Looked

    def __post_init__(self):
        wanted = np.flatnonzero(self.kind == (2 if self.reverse else 0))
        wanted = wanted[np.argsort(self.stop[wanted], kind="stable")]
        self.entry, self.entry_stop = wanted, self.stop[wanted]
        self._backward: tuple[Csr, Csr] | None = None

    def backward(self) -> tuple[Csr, Csr]:
        """The edges by what they lead to, and the stops from which a B state is reached."""
        if self._backward is None:
            n = self.edges.size
            source = np.repeat(np.arange(n, dtype="int32"), np.diff(self.edges.start))
            stop = np.repeat(np.arange(self.reach.size, dtype="int32"), np.diff(self.reach.start))
            self._backward = Csr.of(n, self.edges.targets, source, self.edges.costs), Csr.of(n, self.reach.targets, stop, self.reach.costs)
        return self._backward

    def entries(self, walked: list[tuple[int, float]]) -> list[tuple[float, int]]:
        """Seeds: S of stops walked to, or, towards a place, every R at stops one can walk on from."""
        seeds = []
        for stop, minutes in walked:
            a, b = np.searchsorted(self.entry_stop, [stop, stop + 1])
            seeds += [(minutes, int(i)) for i in self.entry[a:b]]
        return seeds

    def search(self, seeds: list[tuple[float, int]]) -> np.ndarray:
        """The least cost of every state, infinite where none leads. Each round relaxes all that the last one improved, to the fixpoint, which is that of settle on all edges."""
        found = np.full(self.edges.size, np.inf)
        for cost, state in seeds:
            found[state] = min(found[state], cost)
        ahead = np.unique(np.array([state for _, state in seeds], "int64"))
        offers = (np.full(self.reach.size, np.inf), np.full(self.reach.size, np.inf))
        while len(ahead):
            which, edge = _spread(self.edges.start, ahead)
            better = [_improve(found, self.edges.targets[edge], found[ahead][which] + self.edges.costs[edge])]
            better.append(self._change_back(found, ahead) if self.reverse else self._change(found, ahead, offers))
            ahead = np.unique(np.concatenate(better))
        return found

    def _change(self, found: np.ndarray, ahead: np.ndarray, offers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Changes of line from the stops of the R states among ``ahead``, where their best two lines (``offers``) have become better."""
        stops = np.unique(self.stop[ahead[self.kind[ahead] == 2]])
        if not len(stops):
            return stops
        first, second, line = self._best_two(found, self.ridden, stops, None)
        new = (first < offers[0][stops]) | (second < offers[1][stops])
        stops, first, second, line = stops[new], first[new], second[new], line[new]
        offers[0][stops], offers[1][stops] = first, second
        which, edge = _spread(self.reach.start, stops)
        target = self.reach.targets[edge]
        return _improve(found, target, np.where(self.line[target] != line[which], first[which], second[which]) + self.reach.costs[edge])

    def _change_back(self, found: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Changes of line towards the B states among ``ahead``: every R state that can change into them has the best line of its stop's reach, or the second best if that is its own."""
        boards = ahead[self.kind[ahead] == 1]
        stops = np.unique(self.backward()[1].targets[_spread(self.backward()[1].start, boards)[1]])
        if not len(stops):
            return stops
        first, second, line = self._best_two(found, self.reach.start, stops, self.reach)
        which = np.repeat(np.arange(len(stops)), self.ridden[stops + 1] - self.ridden[stops])
        state = _spread(self.ridden, stops)[1]
        return _improve(found, state, np.where(self.line[state] != line[which], first[which], second[which]))

    def _best_two(self, found: np.ndarray, start: np.ndarray, stops: np.ndarray, over: Csr | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By stop the least cost over its R states, or over what it reaches, the least one by another line, and the line of the first."""
        which, at = _spread(start, stops)
        states, values = (at, found[at]) if over is None else (over.targets[at], found[over.targets[at]] + over.costs[at])
        runs = np.searchsorted(which, np.arange(len(stops)))
        first, place = _least(values, runs)
        line = self.line[states[place]]
        others = np.where(self.line[states] == line[which], np.inf, values)
        return first, np.minimum.reduceat(others, runs), line

    def stop_minutes(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stop, minutes, state): the stops reached, each with its least minutes and the state that gives it: R going out, S coming in; the lower state settles ties."""
        if self.reverse:
            stops = np.flatnonzero(np.isfinite(found[: self.reach.size]))
            return stops, found[stops], stops
        stops = np.flatnonzero(np.diff(self.ridden))
        if not len(stops):
            return stops, np.zeros(0), stops
        minutes, place = _least(found[self.ridden[0] :], self.ridden[stops] - self.ridden[0])
        met = np.isfinite(minutes)
        return stops[met], minutes[met], place[met] + self.ridden[0]

    def chain(self, found: np.ndarray, seeds: list[tuple[float, int]], state: int) -> list[int]:
        """The states before ``state`` on a best way, from it back to a seed; of equally good ones the one that settle would have met first."""
        begun: dict[int, float] = {}
        for cost, s in seeds:
            begun[s] = min(begun.get(s, np.inf), cost)
        edges, reached_from = self.backward()
        out = [state]
        while begun.get(state, np.inf) != found[state]:
            a, b = edges.start[state], edges.start[state + 1]
            before, cost = [edges.targets[a:b]], [edges.costs[a:b]]
            if self.kind[state] == (2 if self.reverse else 1):
                a, b = (self.reach.start if self.reverse else reached_from.start)[[self.stop[state], self.stop[state] + 1] if self.reverse else [state, state + 1]]
                if self.reverse:
                    states, step = self.reach.targets[a:b], self.reach.costs[a:b]
                else:
                    which, states = _spread(self.ridden, reached_from.targets[a:b])
                    step = reached_from.costs[a:b][which]
                other = self.line[states] != self.line[state]
                before.append(states[other])
                cost.append(step[other])
            before, cost = np.concatenate(before), np.concatenate(cost)
            tight = before[(found[before] + cost == found[state]) & ~np.isin(before, out)]
            state = int(tight[np.lexsort((tight, found[tight]))[0]])
            out.append(state)
        return out


def _spread(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start[i]:start[i+1] of each row: (index into rows, place), flattened."""
    counts = start[rows + 1] - start[rows]
    which = np.repeat(np.arange(len(rows)), counts)
    return which, np.arange(len(which)) + np.repeat(start[rows] - np.cumsum(counts) + counts, counts)


def _improve(found: np.ndarray, states: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Lower what is found of the states to the costs; the states that became better, some of them repeated."""
    better = costs < found[states]
    states = states[better]
    np.minimum.at(found, states, costs[better])
    return states


def state_edges(net: Network, city: City, modes: list[str] | None = None) -> DataFrame:
    """(src, dst, cost): the search states' edges as joins, states written 'S:stop', 'B:stop:line', 'R:stop:line'.

    ``modes``: the transit modes in use, null for all; none leaves no edge.
    """
    spark = net.lines.sparkSession
    rows = [(m.id, float(m.transfer_min)) for m in city.modes if modes is None or m.id in modes]
    lines = net.lines.select("line_ix", "mode").join(F.broadcast(spark.createDataFrame(rows or [("", 0.0)], "mode string, penalty double")), "mode").select("line_ix", "penalty")
    name = lambda kind, *c: F.concat_ws(":", F.lit(kind), *(F.col(x).cast("string") for x in c))
    waits, rides = net.waits.select("stop_ix", "line_ix", "wait").join(lines, "line_ix"), net.rides.join(lines.select("line_ix"), "line_ix")
    board = waits.select(name("S", "stop_ix").alias("src"), name("B", "stop_ix", "line_ix").alias("dst"), F.col("wait").alias("cost"))
    ridden = rides.select(F.col("b").alias("stop_ix"), "line_ix").distinct()
    first = rides.select(name("B", "a", "line_ix").alias("src"), name("R", "b", "line_ix").alias("dst"), F.col("minutes").alias("cost"))
    on = rides.join(ridden.select(F.col("stop_ix").alias("a"), "line_ix"), ["a", "line_ix"], "left_semi").select(name("R", "a", "line_ix").alias("src"), name("R", "b", "line_ix").alias("dst"), F.col("minutes").alias("cost"))
    reach = net.neighbors.select("a", "b", "minutes").union(ridden.select("stop_ix", "stop_ix", F.lit(0.0)).distinct())
    change = (
        ridden.withColumnRenamed("line_ix", "from_line").join(reach, F.col("stop_ix") == F.col("a"))
        .select("a", "from_line", F.col("b").alias("stop_ix"), "minutes").join(waits, "stop_ix").filter("from_line <> line_ix")
        .select(name("R", "a", "from_line").alias("src"), name("B", "stop_ix", "line_ix").alias("dst"), (F.col("penalty") + F.col("minutes") + F.col("wait")).alias("cost"))
    )
    return board.union(first).union(on).union(change)


@dataclass
class NetArrays:
    """A network on the driver, in a form that is sent to workers."""

    stop_lat: np.ndarray
    stop_lon: np.ndarray
    line_mode: list[str]
    rides: np.ndarray
    waits: np.ndarray
    neighbors: np.ndarray
    penalties: dict[str, float]
    walk: Walk
    stop_ids: list[str]
    line_ids: list[str]

    def __post_init__(self):
        self.by_lat = np.argsort(self.stop_lat, kind="stable")
        self.sorted_lat = self.stop_lat[self.by_lat]
        self.digest = hashlib.sha256(b"".join(np.ascontiguousarray(x).tobytes() for x in (self.stop_lat, self.stop_lon, self.rides, self.waits, self.neighbors))).hexdigest()

    def __getstate__(self) -> dict:
        return {k: _packed(v) if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    def __setstate__(self, kept: dict) -> None:
        self.__dict__.update({k: _unpacked(*v) if isinstance(v, tuple) else v for k, v in kept.items()})

    def reached(self) -> int:
        """How many boardings the stops see, at themselves and at their neighbours: the largest part of the states' arrays, counted before they are made."""
        boards = np.bincount(self.waits["stop_ix"], minlength=len(self.stop_lat))
        return int(boards[np.unique(self.rides["b"])].sum() + boards[self.neighbors["b"]].sum())

    def fitting(self, limit: int) -> NetArrays:
        """The arrays if a worker can hold their states; TooManyRows else."""
        if self.reached() > limit * EDGES_A_ROW:
            raise TooManyRows(f"over {limit * EDGES_A_ROW} boardings beside stops are too many for a worker; use relaxed_stop_times")
        return self

    def states(self, modes: tuple[str, ...] | None, reverse: bool = False) -> StateGraph:
        on = np.array([m in self.penalties and (modes is None or m in modes) for m in self.line_mode], bool)
        rides = self.rides[on[self.rides["line_ix"]]] if len(self.rides) else self.rides
        waits = self.waits[on[self.waits["line_ix"]]] if len(self.waits) else self.waits
        n_lines = max(1, len(self.line_mode))
        code = lambda s, line: s.astype("int64") * n_lines + line
        b_codes = np.unique(np.r_[code(waits["stop_ix"], waits["line_ix"]), code(rides["a"], rides["line_ix"])])
        r_codes = np.unique(code(rides["b"], rides["line_ix"]))
        stops = np.arange(len(self.stop_lat))
        n_s, n_b = len(stops), len(b_codes)
        b_at = lambda c: n_s + np.searchsorted(b_codes, c)
        r_at = lambda c: n_s + n_b + np.searchsorted(r_codes, c)
        parts = [(waits["stop_ix"], b_at(code(waits["stop_ix"], waits["line_ix"])), waits["wait"])]
        a_code, b_code = code(rides["a"], rides["line_ix"]), code(rides["b"], rides["line_ix"])
        boarded, ridden_to = b_at(a_code), r_at(b_code)
        parts.append((boarded, ridden_to, rides["minutes"]))
        on_board = np.isin(a_code, r_codes)
        parts.append((r_at(a_code[on_board]), ridden_to[on_board], rides["minutes"][on_board]))
        penalty = np.array([self.penalties.get(m, 0.0) for m in self.line_mode] or [0.0])
        source, target = (np.concatenate([np.asarray(p[i], "int32") for p in parts]) for i in range(2))
        cost = np.concatenate([np.asarray(p[2]) for p in parts])
        n = n_s + n_b + len(r_codes)
        kind = np.r_[np.zeros(n_s, "int8"), np.ones(n_b, "int8"), np.full(len(r_codes), 2, "int8")]
        return StateGraph(
            kind, np.r_[stops, b_codes // n_lines, r_codes // n_lines].astype("int32"), np.r_[np.full(n_s, -1), b_codes % n_lines, r_codes % n_lines].astype("int32"),
            Csr.of(n, *((target, source) if reverse else (source, target)), cost), _reach(n_s, np.unique(r_codes // n_lines), self.neighbors, waits, penalty, lambda stop, line: b_at(code(stop, line))),
            n_s + n_b + np.searchsorted(r_codes, np.arange(n_s + 1) * n_lines), reverse, penalty,
            Looked(self.neighbors, ("a", "b"), "minutes"), Looked(waits, ("stop_ix", "line_ix"), "wait"), Looked(rides, ("line_ix", "a", "b"), "minutes"),
        )


def _packed(x: np.ndarray) -> tuple:
    x = np.ascontiguousarray(x)
    return x.dtype.descr if x.dtype.names else x.dtype.str, x.nbytes, pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpacked(kind, size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True) if size else b"", np.dtype(kind))


def _spans(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted key all its places in the sorted ``keys``: (index into wanted, place), flattened."""
    start = np.searchsorted(keys, wanted, side="left")
    counts = np.searchsorted(keys, wanted, side="right") - start
    which = np.repeat(np.arange(len(wanted)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start, counts)


def _reach(n_stops: int, ridden: np.ndarray, neighbors: np.ndarray, waits: np.ndarray, penalty: np.ndarray, board_state) -> Csr:
    """From every stop that is ridden to, the lines that board at it or at a neighbour of it, with penalty, walk and wait."""
    a, b = (np.r_[np.asarray(neighbors[c], "int32"), ridden.astype("int32")] for c in ("a", "b"))
    minutes = np.r_[np.asarray(neighbors["minutes"], float), np.zeros(len(ridden))]
    order = np.argsort(a, kind="stable")
    order = order[np.isin(a[order], ridden)]
    by_stop = np.argsort(waits["stop_ix"], kind="stable")
    at, other, wait = (np.asarray(waits[c])[by_stop] for c in ("stop_ix", "line_ix", "wait"))
    a, b, minutes = a[order], b[order], minutes[order]
    states, counts = np.asarray(board_state(at, other), "int32"), np.bincount(at, minlength=n_stops)[b]
    ends = np.r_[0, np.cumsum(counts)]
    targets, costs = np.empty(ends[-1], "int32"), np.empty(ends[-1])
    for i in range(0, len(a), PAIRS_AT_ONCE):
        pair, board = _spans(at, b[i : i + PAIRS_AT_ONCE])
        part = slice(ends[i], ends[min(i + PAIRS_AT_ONCE, len(a))])
        targets[part], costs[part] = states[board], penalty[other[board]] + minutes[i : i + PAIRS_AT_ONCE][pair] + wait[board]
    return Csr(np.r_[0, np.cumsum(np.bincount(a, weights=counts, minlength=n_stops))].astype("int64"), targets, costs)


def collected(df: DataFrame, columns: list[str], limit: int = MAX_SENT_EDGES) -> pd.DataFrame:
    """The rows of a table that must be small enough for the driver, sorted; TooManyRows if there are more than ``limit``."""
    rows = df.select(*columns).limit(limit + 1).toArrow().to_pandas()
    if len(rows) > limit:
        raise TooManyRows(f"over {limit} rows are too many to send to every worker; use relaxed_stop_times")
    return rows.sort_values(columns, ignore_index=True)


def _records(df: DataFrame, columns: list[str], limit: int = MAX_SENT_EDGES) -> np.ndarray:
    """collected as an array, without the copies that a data frame makes."""
    rows = df.select(*columns).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise TooManyRows(f"over {limit} rows are too many to send to every worker; use relaxed_stop_times")
    parts = [rows[c].to_numpy() for c in columns]
    del rows
    order = np.lexsort(parts[::-1])
    out = np.empty(len(order), [(c, x.dtype) for c, x in zip(columns, parts)])
    for c, x in zip(columns, parts):
        out[c] = x[order]
    return out


def counted(df: DataFrame, limit: int) -> DataFrame:
    """The table itself if it has at most ``limit`` rows; TooManyRows, before anything is collected, if it has more."""
    if df.limit(limit + 1).count() > limit:
        raise TooManyRows(f"over {limit} rows are too many to send to every worker; use relaxed_stop_times")
    return df


def net_arrays(net: Network, city: City, limit: int = MAX_SENT_EDGES) -> NetArrays:
    """Collect a network that is small enough to be sent; TooManyRows, before more than ``limit`` rows of a table are collected, if it is not."""
    stops = collected(net.stops, ["stop_ix", "lat", "lon", "stop_id"], limit)
    lines = collected(net.lines, ["line_ix", "mode", "line_id"], limit)
    return NetArrays(
        stops["lat"].to_numpy(float), stops["lon"].to_numpy(float), [str(m) for m in lines["mode"]],
        _records(net.rides, ["line_ix", "a", "b", "minutes"], limit), _records(net.waits, ["stop_ix", "line_ix", "wait"], limit), _records(net.neighbors, ["a", "b", "minutes"], limit),
        {m.id: float(m.transfer_min) for m in city.modes}, city.walk, stops["stop_id"].tolist(), lines["line_id"].tolist(),
    ).fitting(limit)


def timetable_arrays(found: Timetable, city: City, limit: int = MAX_SENT_EDGES, neighbors: DataFrame | None = None) -> NetArrays:
    """net_arrays of a timetable by ids; the numbers, those of ``numbered``, are made on the driver. ``neighbors`` (a, b, minutes): by stop_id, else straight lines."""
    counted(found.rides, limit)
    stops = collected(found.stops, ["stop_id", "lat", "lon"], limit)
    rides = collected(found.rides, ["route_id", "direction", "a", "b", "minutes", "mode"], limit)
    waits = collected(found.waits, ["route_id", "direction", "stop_id", "wait"], limit)
    near = collected(walking_neighbors(found.stops, "stop_id", city) if neighbors is None else neighbors, ["a", "b", "minutes"], limit)
    line_of = pd.MultiIndex.from_frame(rides[["route_id", "direction"]]).unique().sort_values()
    stop_of = pd.Index(stops["stop_id"])
    number = lambda ids: stop_of.get_indexer(ids).astype("int32")
    line = lambda df: line_of.get_indexer(pd.MultiIndex.from_frame(df[["route_id", "direction"]])).astype("int32")
    records = lambda order, **columns: pd.DataFrame(columns).query(" and ".join(f"{c} >= 0" for c in order)).sort_values(order).to_records(index=False)
    modes = rides.groupby(["route_id", "direction"])["mode"].first().reindex(line_of)
    return NetArrays(
        stops["lat"].to_numpy(float), stops["lon"].to_numpy(float), [str(m) for m in modes],
        records(["line_ix", "a", "b"], line_ix=line(rides), a=number(rides["a"]), b=number(rides["b"]), minutes=rides["minutes"].to_numpy(float)),
        records(["stop_ix", "line_ix"], stop_ix=number(waits["stop_id"]), line_ix=line(waits), wait=waits["wait"].to_numpy(float)),
        records(["a", "b"], a=number(near["a"]), b=number(near["b"]), minutes=near["minutes"].to_numpy(float)),
        {m.id: float(m.transfer_min) for m in city.modes}, city.walk, stops["stop_id"].tolist(), [":".join(x) for x in line_of],
    ).fitting(limit)


def network_arrays(found: Timetable, city: City, limit: int = MAX_NUMBERED_EDGES, reverse: bool = False) -> NetArrays | mapped.MappedNet:
    """timetable_arrays, or, if the tables by ids have too many rows to be collected, the network in mapped files, of any size. Both give the same numbers.

    ``reverse``: for a search towards a place, which mapped files do not have; there net_arrays of the numbered tables, or TooManyRows.
    """
    try:
        return timetable_arrays(found, city, min(limit, MAX_SENT_EDGES))
    except TooManyRows:
        if found.hops is not None and not reverse:
            return mapped.network_files(found, city)
        counted(found.rides, limit)
        return net_arrays(numbered(found, city), city, limit)


_states: dict[tuple, StateGraph] = {}
_networks: dict[str, object] = {}


def network_in_worker(key: str, net: Callable[[], NetArrays | mapped.MappedNet]) -> NetArrays | mapped.MappedNet:
    """The network of that digest as the task before has opened it."""
    if key not in _networks:
        _networks.clear()
        _networks[key] = net()
    return _networks[key]


def states_in_worker(key: str, net: Callable[[], NetArrays], modes: tuple[str, ...] | None, reverse: bool) -> StateGraph:
    """The states of the network of that digest; a worker that has numbered them for the task before takes them again."""
    if (key, modes, reverse) not in _states:
        _states.clear()
        _states[key, modes, reverse] = net().states(modes, reverse)
    return _states[key, modes, reverse]


def distances_m(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Great-circle metres from one position to many."""
    p, q = np.radians(lat), np.radians(lats)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * 6_371_000.0 * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def walkable_stops(net: NetArrays, lat: float, lon: float, limit_m: float | None = None) -> list[tuple[int, float]]:
    """(stop, minutes) of the stops within walking access, or ``limit_m``, of a position, straight lines, limit inclusive; only stops of the latitudes in question are measured."""
    limit_m = net.walk.max_access_m if limit_m is None else limit_m
    height = np.degrees(limit_m / 6_371_000.0) * (1 + 1e-9)
    a, b = np.searchsorted(net.sorted_lat, [lat - height, lat + height], side="left")
    b = np.searchsorted(net.sorted_lat, lat + height, side="right")
    beside = net.by_lat[a:b]
    metres = distances_m(lat, lon, net.stop_lat[beside], net.stop_lon[beside])
    near = metres <= limit_m
    return [(int(s), net.walk.minutes(float(m))) for s, m in sorted(zip(beside[near], metres[near]))]


def stop_times(net: NetArrays, origins: DataFrame, modes: tuple[str, ...] | None = None, reverse: bool = False, walked: DataFrame | None = None) -> DataFrame:
    """(origin, stop_ix, minutes): minutes at which each stop can be left after riding, per origin (origin, lat, lon).

    ``reverse``: minutes from boarding at each stop until the place is reached. Stops out of reach give
    no row; origins with a null position give none; a repeated origin is searched again. ``walked``
    (origin, stop_ix, minutes): the stops walked to along streets, else those in straight lines. The
    origins are spread over all cores; a worker numbers the states once for all its tasks.
    """
    ship(origins.sparkSession)
    sent, straight, key = origins.sparkSession.sparkContext.broadcast(net), walked is None, net.digest

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states = states_in_worker(key, lambda: sent.value, modes, reverse)
            for origin, lat, lon, known in zip(batch["origin"], batch["lat"], batch["lon"], batch["walked"]):
                near = walkable_stops(sent.value, lat, lon) if straight else [(int(w["stop_ix"]), float(w["minutes"])) for w in (known if known is not None else ())]
                stops, minutes, _ = states.stop_minutes(states.search(states.entries(near))) if near else ((), (), ())
                if len(stops):
                    yield pd.DataFrame({"origin": origin, "stop_ix": stops, "minutes": minutes})

    placed = origins.select(F.col("origin").cast("string").alias("origin"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna()
    if straight:
        placed = placed.withColumn("walked", F.lit(None).cast("array<struct<stop_ix:int,minutes:double>>"))
    else:
        placed = placed.join(walked.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("stop_ix", "minutes"))).alias("walked")), "origin", "left")
    return spread(placed).mapInPandas(search, "origin string, stop_ix int, minutes double")


def network_stop_times(net: Network, city: City, origins: DataFrame, modes: tuple[str, ...] | None = None, reverse: bool = False, walked: DataFrame | None = None, limit: int = MAX_NUMBERED_EDGES) -> DataFrame:
    """stop_times of a network of any size: by the array kernel, or, if it has too many rows to be sent, as joins. There a repeated origin counts once."""
    try:
        return stop_times(net_arrays(net, city, limit), origins, modes, reverse, walked)
    except TooManyRows:
        return joined_stop_times(net, city, origins, modes, reverse, walked)


def timetable_stop_times(found: Timetable, city: City, origins: DataFrame, modes: tuple[str, ...] | None = None, reverse: bool = False, limit: int = MAX_NUMBERED_EDGES) -> DataFrame:
    """(origin, stop_id, minutes): network_stop_times of a timetable by ids, which is numbered as tables only if it has too many rows to be collected by ids."""
    try:
        arrays = network_arrays(found, city, limit, reverse)
    except TooManyRows:
        net = numbered(found, city)
        return joined_stop_times(net, city, origins, modes, reverse).join(net.stops.select("stop_ix", "stop_id"), "stop_ix").select("origin", "stop_id", "minutes")
    if isinstance(arrays, mapped.MappedNet):
        return mapped.stop_times(arrays, origins, modes)
    ids = origins.sparkSession.createDataFrame(pa.table({"stop_ix": pa.array(range(len(arrays.stop_ids)), pa.int32()), "stop_id": pa.array(arrays.stop_ids, pa.string())}))
    return stop_times(arrays, origins, modes, reverse).join(F.broadcast(ids) if len(arrays.stop_ids) <= MAX_SENT_EDGES else ids, "stop_ix").select("origin", "stop_id", "minutes")


def joined_stop_times(net: Network, city: City, origins: DataFrame, modes: tuple[str, ...] | None = None, reverse: bool = False, walked: DataFrame | None = None) -> DataFrame:
    """stop_times as joins, for a network of any size. A repeated origin counts once."""
    placed = origins.select(F.col("origin").cast("string").alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna()
    if walked is None:
        near = near_join(placed, net.stops.select(F.col("stop_ix").alias("key"), "lat", "lon"), city.walk.max_access_m)
        walked = near.select(F.col("key_a").alias("origin"), F.col("key_b").alias("stop_ix"), (F.col("metres") * city.walk.minutes(1.0)).alias("minutes"))
    walked = walked.join(placed.select(F.col("key").alias("origin")).distinct(), "origin", "left_semi")
    edges = keep(state_edges(net, city, None if modes is None else list(modes)))
    stop = F.split("state", ":")[1].cast("int").alias("stop_ix")
    if reverse:
        ridden = edges.select(F.col("dst").alias("state")).filter("state like 'R:%'").distinct()
        seeds = walked.join(ridden.select("state", stop), "stop_ix")
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    else:
        seeds = walked.withColumn("state", F.concat(F.lit("S:"), F.col("stop_ix").cast("string")))
    found = relaxed_stop_times(edges, seeds.select("origin", "state", "minutes")).filter(F.col("state").startswith("S:" if reverse else "R:"))
    return found.select("origin", stop, "minutes").groupBy("origin", "stop_ix").agg(F.min("minutes").alias("minutes"))


def point_times(at_stops: DataFrame, stops: DataFrame, origins: DataFrame, points: DataFrame, walk: Walk, direct_walk_m: float | None = None, ident: str = "stop_ix") -> DataFrame:
    """(origin, point, minutes): least of walking all the way and of riding to a stop and walking on; out of reach: no row.

    at_stops: result of stop_times; stops (stop_ix, or ``ident``, lat, lon); origins (origin, lat, lon); points
    (point, lat, lon). The egress join is a grid join within max_access_m, the direct one within the
    larger of that and ``direct_walk_m``. Both directions use the same distances.
    """
    of = lambda df, c: df.select(F.col(c).cast("string").alias("key"), "lat", "lon")
    minutes = lambda m: F.col(m) * walk.detour_factor / walk.speed_m_per_min
    direct = near_join(of(origins, "origin"), of(points, "point"), max(walk.max_access_m, direct_walk_m or 0.0)).select(F.col("key_a").alias("origin"), F.col("key_b").alias("point"), minutes("metres").alias("minutes"))
    egress = near_join(of(stops, ident), of(points, "point"), walk.max_access_m).select(F.col("key_a").cast(at_stops.schema[ident].dataType).alias(ident), F.col("key_b").alias("point"), minutes("metres").alias("on_foot"))
    ridden = at_stops.join(egress, ident).select("origin", "point", (F.col("minutes") + F.col("on_foot")).alias("minutes"))
    return direct.unionByName(ridden).groupBy("origin", "point").agg(F.min("minutes").alias("minutes"))


def near_arrays(lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray, radius_m: float) -> Csr:
    """From each position the others at most ``radius_m`` away (inclusive) and their metres, straight lines. The 180th meridian and the poles count; a place without a position is near nothing."""
    counts, targets, metres = ([*x] for x in zip((np.zeros(0, int), np.zeros(0, "int32"), np.zeros(0)), *near_parts(lat, lon, to_lat, to_lon, radius_m)))
    return Csr(np.r_[0, np.cumsum(np.concatenate(counts))], np.concatenate(targets), np.concatenate(metres))


def near_parts(lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray, radius_m: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """near_arrays of POINTS_AT_ONCE positions after another: (how many each has, which, metres)."""
    height = np.degrees(radius_m / 6_371_000.0) * (1 + 1e-9)
    placed = np.flatnonzero(np.isfinite(to_lat) & np.isfinite(to_lon))
    keys = np.floor((to_lat[placed] + 90) / height) * 720 + to_lon[placed] + 180  # bands of latitude one after another, each by longitude
    order = np.argsort(keys, kind="stable")
    keys, placed = keys[order], placed[order]
    for i in range(0, len(lat), POINTS_AT_ONCE):
        y, x = lat[i : i + POINTS_AT_ONCE], lon[i : i + POINTS_AT_ONCE]
        known = np.isfinite(y) & np.isfinite(x)
        band = np.floor((np.where(known, y, 0.0) + 90) / height)
        ratio = np.sin(min(radius_m / (2 * 6_371_000.0), np.pi / 2)) / np.maximum(1e-12, np.cos(np.radians(np.minimum(90.0, np.abs(np.where(known, y, 0.0)) + 2 * height))))
        wide = np.where(ratio >= 1, 360.0, np.degrees(2 * np.arcsin(np.minimum(1.0, ratio)))) + 1e-6
        parts = []
        for beside in (-1, 0, 1):
            for turn in (-360.0, 0.0, 360.0):
                west, east = (np.clip(np.where(known, x, 0.0) + turn + side * wide + 180, -1.0, 361.0) for side in (-1, 1))
                a, b = np.searchsorted(keys, (band + beside) * 720 + west, side="left"), np.searchsorted(keys, (band + beside) * 720 + east, side="right")
                size = np.where(known, np.maximum(0, b - a), 0)
                which = np.repeat(np.arange(len(y)), size)
                parts.append((which, placed[np.arange(len(which)) + np.repeat(a - np.cumsum(size) + size, size)]))
        which, other = (np.concatenate([p[j] for p in parts]) for j in range(2))
        metres = distances_m(y[which], x[which], to_lat[other], to_lon[other])
        near = metres <= radius_m
        which, other, metres = which[near], other[near], metres[near]
        order = np.argsort(which, kind="stable")
        yield np.bincount(which, minlength=len(y)), other[order].astype("int32"), metres[order]


_walks: dict[tuple, Csr] = {}


def kernel_point_times(net: NetArrays, origins: DataFrame, points: DataFrame, direct_walk_m: float | None = None, limit: int = MAX_NUMBERED_EDGES) -> DataFrame:
    """(origin, point, minutes): point_times of a network that is sent; each task finds the points of its origins, so that no stop's minutes are joined to points.

    TooManyRows if there are more than ``limit`` points.
    """
    ship(origins.sparkSession)
    rows = collected(points.select(F.col("point").cast("string").alias("point"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna(), ["point", "lat", "lon"], limit)
    places, ids = (rows["lat"].to_numpy(float), rows["lon"].to_numpy(float)), rows["point"].tolist()
    sc = origins.sparkSession.sparkContext
    sent, sent_places, sent_ids, key = sc.broadcast(net), sc.broadcast([_packed(x) for x in places]), sc.broadcast(ids), (net.digest, hashlib.sha256(b"".join(x.tobytes() for x in places)).hexdigest())
    direct_m = max(net.walk.max_access_m, direct_walk_m or 0.0)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, names = sent.value.walk, None
        minutes_of = lambda metres: metres * walk.detour_factor / walk.speed_m_per_min
        for batch in batches:
            if names is None:
                names, (lat, lon) = np.array(sent_ids.value, object), (_unpacked(*x) for x in sent_places.value)
            states = states_in_worker(key[0], lambda: sent.value, None, False)
            if key not in _walks:
                _walks.clear()
                _walks[key] = near_arrays(lat, lon, sent.value.stop_lat, sent.value.stop_lon, walk.max_access_m)
            walks = _walks[key]
            reached_by = np.flatnonzero(np.diff(walks.start))
            for origin, o_lat, o_lon in zip(batch["origin"], batch["lat"], batch["lon"]):
                best = np.full(len(lat), np.inf)
                direct = near_arrays(np.array([o_lat]), np.array([o_lon]), lat, lon, direct_m)
                np.minimum.at(best, direct.targets, minutes_of(direct.costs))
                near = walkable_stops(sent.value, o_lat, o_lon)
                if near and len(reached_by):
                    stops, minutes, _ = states.stop_minutes(states.search(states.entries(near)))
                    at = np.full(len(sent.value.stop_lat), np.inf)
                    at[stops] = minutes
                    ridden = np.minimum.reduceat(at[walks.targets] + minutes_of(walks.costs), walks.start[reached_by])
                    best[reached_by] = np.minimum(best[reached_by], ridden)
                met = np.flatnonzero(np.isfinite(best))
                if len(met):
                    yield pd.DataFrame({"origin": origin, "point": names[met], "minutes": best[met]})

    placed = origins.select(F.col("origin").cast("string").alias("origin"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna()
    return spread(placed).mapInPandas(search, "origin string, point string, minutes double").groupBy("origin", "point").agg(F.min("minutes").alias("minutes"))


def timetable_point_times(found: Timetable, city: City, origins: DataFrame, points: DataFrame, direct_walk_m: float | None = None, limit: int = MAX_NUMBERED_EDGES) -> DataFrame:
    """point_times of a timetable by ids, of any size: by the array kernel, or, if it has too many rows to be sent, as joins."""
    try:
        arrays = network_arrays(found, city, limit)
        if isinstance(arrays, mapped.MappedNet):
            return mapped.point_times(arrays, origins, points, direct_walk_m)
        return kernel_point_times(arrays, origins, points, direct_walk_m, limit)
    except TooManyRows:
        if found.hops is not None:
            return mapped.point_times(mapped.network_files(found, city), origins, points, direct_walk_m)
        at_stops = timetable_stop_times(found, city, origins, limit=limit)
        return point_times(at_stops, found.stops, origins, points, city.walk, direct_walk_m, "stop_id")


def relaxed_stop_times(edges: DataFrame, seeds: DataFrame, limit: float | None = None) -> DataFrame:
    """(origin, state, minutes): the same search as joins, for networks too large to send and to check the other.

    edges (src, dst, cost >= 0), seeds (origin, state, minutes). Each round relaxes only what the last
    round improved; rounds are cut by checkpoints and end when nothing improves.
    """
    best = cut(seeds.groupBy("origin", "state").agg(F.min("minutes").alias("minutes")))
    frontier = best
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["state"] == edges["src"]).select("origin", F.col("dst").alias("state"), (F.col("minutes") + F.col("cost")).alias("minutes"))
        if limit is not None:
            step = step.filter(F.col("minutes") <= limit)
        step = step.groupBy("origin", "state").agg(F.min("minutes").alias("new"))
        merged = cut(best.join(step, ["origin", "state"], "full_outer").select("origin", "state", F.least("minutes", "new").alias("minutes"), F.coalesce(F.col("new") < F.col("minutes"), F.col("minutes").isNull()).alias("better")))
        frontier, best = merged.filter("better").drop("better"), merged.drop("better")
    return best


def street_reach(edges: DataFrame, sources: DataFrame, limit_m: float, most: int = MAX_SENT_EDGES) -> DataFrame:
    """(source, node, metres): street metres within ``limit_m`` of each source (source, node, metres0 already walked), by the array kernel.

    edges (a, b, metres) undirected. The edge table is counted before it is sent; one of over ``most``
    rows is searched as joins.
    """
    ship(edges.sparkSession)
    both = edges.select("a", "b", F.col("metres").cast("double").alias("metres"))
    both = both.union(both.select("b", "a", "metres"))
    rows = sources.select(F.col("source").cast("string").alias("source"), F.col("node").cast("long").alias("node"), F.col("metres0").cast("double").alias("metres0")).dropna()
    try:
        records = _records(both, ["a", "b", "metres"], most)
    except TooManyRows:
        seeds = rows.filter(F.col("metres0") <= limit_m).select(F.col("source").alias("origin"), F.col("node").alias("state"), F.col("metres0").alias("minutes"))
        found = relaxed_stop_times(both.select(F.col("a").alias("src"), F.col("b").cast("long").alias("dst"), F.col("metres").alias("cost")), seeds, limit_m)
        return found.select(F.col("origin").alias("source"), F.col("state").alias("node"), F.col("minutes").alias("metres"))
    n = int(max(records["a"].max(initial=-1), records["b"].max(initial=-1))) + 1
    graph = Csr.of(n, np.asarray(records["a"], int), np.asarray(records["b"], int), np.asarray(records["metres"], float))
    sent = edges.sparkSession.sparkContext.broadcast(graph)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, node, walked in zip(batch["source"], batch["node"], batch["metres0"]):
                if walked > limit_m:
                    continue
                best = settle(sent.value, [(float(walked), int(node))], limit_m)[0] if node < sent.value.size else {int(node): float(walked)}
                yield pd.DataFrame({"source": source, "node": list(best), "metres": list(best.values())})

    return spread(rows).mapInPandas(search, "source string, node long, metres double")


def street_routes(edges: DataFrame, pairs: DataFrame, limit_m: float, most: int = MAX_SENT_EDGES) -> DataFrame:
    """(route, metres, nodes array<long>): the shortest street way of each pair (route, node_a, snap_a, node_b, snap_b) with both snaps, at most ``limit_m`` in all; no row beyond.

    nodes run from node_a to node_b. Edges (a, b, metres) are undirected and counted before they are sent;
    TooManyRows if there are more than ``most``. Of equally long ways the one whose nodes settled first holds.
    """
    ship(edges.sparkSession)
    both = edges.select("a", "b", F.col("metres").cast("double").alias("metres"))
    records = _records(both.union(both.select("b", "a", "metres")), ["a", "b", "metres"], most)
    n = int(max(records["a"].max(initial=-1), records["b"].max(initial=-1))) + 1
    sent = edges.sparkSession.sparkContext.broadcast(Csr.of(n, np.asarray(records["a"], int), np.asarray(records["b"], int), np.asarray(records["metres"], float)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for route, a, snap_a, b, snap_b in zip(*(batch[c] for c in ("route", "node_a", "snap_a", "node_b", "snap_b"))):
                a, b, room = int(a), int(b), limit_m - snap_b
                if a >= sent.value.size or b >= sent.value.size:
                    best, before = ({a: snap_a}, {a: -1}) if snap_a <= room else ({}, {})
                else:
                    best, before = settle(sent.value, [(float(snap_a), a)], room)
                if b in best:
                    nodes = [b]
                    while (last := before[nodes[-1]]) != -1:
                        nodes.append(last)
                    out.append((route, best[b] + snap_b, nodes[::-1]))
            yield pd.DataFrame(out, columns=["route", "metres", "nodes"])

    rows = pairs.select(F.col("route").cast("string").alias("route"), *(F.col(c).cast("long").alias(c) for c in ("node_a", "node_b")), *(F.col(c).cast("double").alias(c) for c in ("snap_a", "snap_b"))).dropna()
    return spread(rows).mapInPandas(search, "route string, metres double, nodes array<long>")


def node_times(at_stops: DataFrame, stop_walks: DataFrame, origin_walks: DataFrame, speed: float) -> DataFrame:
    """(origin, node, minutes) at street nodes: from the origin on foot, or from a stop after riding.

    stop_walks (source = stop_ix, node, metres) are the same for all origins and worth keeping as a
    table; origin_walks (source = origin, node, metres).
    """
    on_foot = origin_walks.select(F.col("source").alias("origin"), "node", (F.col("metres") / speed).alias("minutes"))
    walks = stop_walks.select(F.col("source").cast("int").alias("stop_ix"), "node", "metres")
    ridden = at_stops.join(walks, "stop_ix").select("origin", "node", (F.col("minutes") + F.col("metres") / speed).alias("minutes"))
    return on_foot.unionByName(ridden).groupBy("origin", "node").agg(F.min("minutes").alias("minutes"))


def stops_walked_to(origin_walks: DataFrame, snaps: DataFrame, limit_m: float, speed: float) -> DataFrame:
    """(origin, stop_ix, minutes): stops that an origin reaches along streets: its walk to the stop's node plus the stop's snap, within the limit."""
    ends = origin_walks.join(snaps, "node").withColumn("metres", F.col("metres") + F.col("snap_m")).filter(F.col("metres") <= limit_m)
    return ends.groupBy(F.col("source").alias("origin"), "stop_ix").agg((F.min("metres") / speed).alias("minutes"))


def street_point_times(at_stops: DataFrame, stop_walks: DataFrame, origin_walks: DataFrame, snaps: DataFrame, limit_m: float, speed: float) -> DataFrame:
    """(origin, point, minutes) as point_times, along streets: node_times plus the point's own snap (point, node, snap_m), each walk within the limit."""
    ends = lambda walks, c: walks.select(F.col("source").alias(c), "node", "metres").join(snaps, "node").withColumn("metres", F.col("metres") + F.col("snap_m")).filter(F.col("metres") <= limit_m)
    on_foot = ends(origin_walks, "origin").select("origin", "point", (F.col("metres") / speed).alias("minutes"))
    egress = ends(stop_walks, "stop_ix").withColumn("stop_ix", F.col("stop_ix").cast("int"))
    ridden = at_stops.join(egress, "stop_ix").select("origin", "point", (F.col("minutes") + F.col("metres") / speed).alias("minutes"))
    return on_foot.unionByName(ridden).groupBy("origin", "point").agg(F.min("minutes").alias("minutes"))


def street_neighbors(stop_walks: DataFrame, snaps: DataFrame, limit_m: float, speed: float) -> DataFrame:
    """(a, b, minutes): stops joined along streets: snap + path + snap within the limit; both directions, never a stop with itself.

    stop_walks (source = stop_ix, node, metres with the stop's own snap), snaps (stop_ix, node, snap_m).
    """
    walks = stop_walks.select(F.col("source").cast("int").alias("a"), "node", "metres")
    pairs = walks.join(snaps.select(F.col("stop_ix").alias("b"), "node", "snap_m"), "node").filter("a <> b")
    return pairs.filter(F.col("metres") + F.col("snap_m") <= limit_m).select("a", "b", ((F.col("metres") + F.col("snap_m")) / speed).alias("minutes"))
