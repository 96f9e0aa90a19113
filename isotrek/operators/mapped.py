"""The array search over a network of any size: its arrays lie in files that workers map, so that neither the driver nor a worker holds them.

The timetable is sorted by Spark and kept as tables in the shared folder. On every host the first worker that
needs them streams the tables into plain arrays; all workers of the host map those. The arrays lie in the shared
folder if that is a local path, else in the executor's own folder. A search holds one number a state, and it lists
edges in parts. States, costs and ties are those of ``search.StateGraph``; searches run from a place, not towards it.
"""

from __future__ import annotations

import fcntl
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.operators import search
from isotrek.operators.network import Timetable
from isotrek.params import City, Walk
from isotrek.session import ship, shared_folder, spread, stored

ROWS_AT_ONCE = 250_000  # rows, states, edges or pairs that are in memory at once
ROWS_OUT = 100_000  # rows of a batch of results
LINE = ["route_id", "direction", "mode"]


def _batches(uri: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a kept table in the order of its files."""
    fs, path = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    for name in sorted(i.path for i in fs.get_file_info(pa.fs.FileSelector(path)) if i.base_name.startswith("part-")):
        with fs.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(2 * ROWS_AT_ONCE, columns=columns)


def _parts(counts: np.ndarray, most: int = ROWS_AT_ONCE) -> Iterator[slice]:
    """Consecutive items whose counts add up to at most ``most``, or one item of more."""
    ends, i = np.cumsum(counts), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield slice(i, j)
        i = j


def _between(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places low[i]:high[i] of each item: (item, place), flattened."""
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) + np.repeat(low - np.cumsum(counts) + counts, counts)


class Files:
    """Named arrays in a folder."""

    def __init__(self, folder: Path):
        self.folder = folder

    def add(self, name: str, values: np.ndarray, kind: str) -> None:
        """Append to an array."""
        with open(self.folder / f"{name}.{kind}", "ab") as file:
            np.ascontiguousarray(values, kind).tofile(file)

    def get(self, name: str, mode: str = "r") -> np.ndarray:
        path = next(self.folder.glob(f"{name}.*"))
        return np.memmap(path, path.suffix[1:], mode) if path.stat().st_size else np.zeros(0, path.suffix[1:])

    def drop(self, *names: str) -> None:
        for name in names:
            next(self.folder.glob(f"{name}.*")).unlink()

    def add_texts(self, name: str, texts: pa.Array) -> None:
        """Append to an array of texts, which is kept as bytes and their ends."""
        texts = texts.cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        path = self.folder / f"{name}_text.u1"
        before = path.stat().st_size if path.exists() else 0
        if not before and not list(self.folder.glob(f"{name}_end.*")):
            self.add(f"{name}_end", np.zeros(1), "i8")
        self.add(f"{name}_end", before + np.cumsum(sizes), "i8")
        ends = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
        self.add(f"{name}_text", np.frombuffer(texts.buffers()[2], "u1")[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, "u1"), "u1")

    def texts(self, name: str) -> pa.LargeStringArray:
        ends = self.get(f"{name}_end")
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(self.get(f"{name}_text")))

    def made(self, build: Callable[[Files], None]) -> Files:
        """These files, built by the first worker of the host that asks; one that breaks off leaves it to the next."""
        self.folder.mkdir(parents=True, exist_ok=True)
        with open(self.folder / "lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not (self.folder / "done").exists():
                for old in self.folder.iterdir():
                    if old.name != "lock":
                        old.unlink()
                build(self)
                pa.default_memory_pool().release_unused()
                (self.folder / "done").touch()
        return self


def _rounded(x: np.ndarray) -> np.ndarray:
    """numbers.round_half_even to 2 digits."""
    near, up, down = np.rint(x * 100.0) / 100.0, (np.rint(x * 100.0) + 1) / 100.0, (np.rint(x * 100.0) - 1) / 100.0
    return np.where(np.abs(x - up) < np.abs(x - near), up, np.where(np.abs(x - down) < np.abs(x - near), down, near))


def _add_near(files: Files, name: str, near: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], keep_self: bool) -> None:
    """Append what is near each place: ``name``_start, _to and _m (metres)."""
    files.add(f"{name}_start", np.zeros(1), "i8")
    at = total = 0
    for counts, to, metres in near:
        if not keep_self:
            who = at + np.repeat(np.arange(len(counts)), counts)
            other = to != who
            counts, to, metres = np.bincount(who[other] - at, minlength=len(counts)), to[other], metres[other]
        at += len(counts)
        files.add(f"{name}_start", total + np.cumsum(counts), "i8")
        files.add(f"{name}_to", to, "i4")
        files.add(f"{name}_m", metres, "f8")
        total += len(to)
    files.add(f"{name}_to", np.zeros(0), "i4")
    files.add(f"{name}_m", np.zeros(0), "f8")


def _add_places(files: Files, name: str, uri: str, ident: str) -> None:
    """Append a kept table of places in its order: ``name``_lat, _lon, ids and the order of latitudes."""
    for kind in ("lat", "lon"):
        files.add(f"{name}_{kind}", np.zeros(0), "f8")
    files.add_texts(name, pa.array([], pa.string()))
    for batch in _batches(uri, [ident, "lat", "lon"]):
        files.add_texts(name, batch[ident])
        for kind in ("lat", "lon"):
            files.add(f"{name}_{kind}", batch[kind].to_numpy(zero_copy_only=False), "f8")
    lat = files.get(f"{name}_lat")
    by_lat = np.argsort(lat, kind="stable")
    files.add(f"{name}_by_lat", by_lat, "i4")
    files.add(f"{name}_sorted_lat", lat[by_lat], "f8")


@dataclass
class MappedNet:
    """A network whose arrays are made where they are searched; it takes the place of search.NetArrays."""

    digest: str
    folder: str | None  # local path of the shared folder
    stops: str  # kept tables
    lines: str
    hops: str
    rules: dict[str, tuple[float, float, float, float]]  # by mode: factor, least and most wait, penalty
    window_minutes: float
    walk: Walk

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def place(self, name: str) -> Files:
        return Files(Path(self.folder or os.path.join(SparkFiles.getRootDirectory(), self.digest), name))

    @cached_property
    def files(self) -> Files:
        return self.place("net").made(self._build)

    stop_lat = cached_property(lambda self: self.files.get("stop_lat"))
    stop_lon = cached_property(lambda self: self.files.get("stop_lon"))
    by_lat = cached_property(lambda self: self.files.get("stop_by_lat"))
    sorted_lat = cached_property(lambda self: self.files.get("stop_sorted_lat"))
    stop_ids = cached_property(lambda self: self.files.texts("stop"))

    def states(self, modes: tuple[str, ...] | None, reverse: bool = False) -> MappedStates:
        if reverse:
            raise ValueError("a mapped network is searched from a place, not towards it")
        return MappedStates(self, modes)

    def _build(self, files: Files) -> None:
        _add_places(files, "stop", self.stops, "stop_id")
        ids, keys, modes = files.texts("stop"), [], []
        name = lambda batch: pc.binary_join_element_wise(batch["route_id"], batch["direction"], batch["mode"], "\0").cast(pa.large_string())
        for batch in _batches(self.lines, LINE):
            keys.append(name(batch))
            modes += batch["mode"].to_pylist()
        lines = pa.chunked_array(keys, pa.large_string()).combine_chunks()
        n_lines, n_stops = max(1, len(lines)), len(ids)
        rule = np.array([self.rules[m] for m in modes] or [(0.0, 0.0, 0.0, 0.0)])
        known = sorted(self.rules)
        files.add("line_mode", np.array([known.index(m) for m in modes] or [0]), "i4")
        files.add("line_penalty", rule[:, 3], "f8")
        for kept, kind in (("hop_code", "i8"), ("hop_b", "i4"), ("hop_minutes", "f8"), ("hop_n", "i8"), ("hop_to", "i4"), ("ridden_code", "i8"), ("board_hop", "i8"), ("board_line", "i4"), ("board_wait", "f8"), ("r_code", "i8"), ("r_low", "i8"), ("r_high", "i8"), ("r_line", "i4"), ("r_stop", "i4")):
            files.add(kept, np.zeros(0), kind)
        stop_number = lambda col: pc.fill_null(pc.index_in(col.cast(pa.large_string()), ids), -1).to_numpy(zero_copy_only=False)
        for batch in _batches(self.hops, [*LINE, "a", "b", "minutes", "n"]):
            line = pc.index_in(name(batch), lines).to_numpy(zero_copy_only=False).astype("i8")
            a, b = stop_number(batch["a"]), stop_number(batch["b"])
            here = a >= 0
            ends = b >= 0
            files.add("hop_code", (a * np.int64(n_lines) + line)[here], "i8")
            files.add("hop_b", b[here], "i4")
            files.add("hop_minutes", np.where(ends, batch["minutes"].to_numpy(zero_copy_only=False), np.inf)[here], "f8")
            files.add("hop_n", batch["n"].to_numpy(zero_copy_only=False)[here], "i8")
            files.add("ridden_code", (b * np.int64(n_lines) + line)[here & ends], "i8")
        code, n_hops = files.get("hop_code"), len(files.get("hop_code"))
        for i in range(0, n_hops, ROWS_AT_ONCE):  # a boarding starts where stop or line differs from the row before
            own = code[i : i + ROWS_AT_ONCE]
            files.add("board_hop", i + np.flatnonzero(np.r_[i == 0 or code[i - 1] != own[0], own[1:] != own[:-1]]), "i8")
        files.add("board_hop", np.array([n_hops]), "i8")
        first, runs = files.get("board_hop"), files.get("hop_n")
        n_boards, before = len(first) - 1, np.zeros(n_stops + 1, "i8")
        for i in range(0, n_boards, ROWS_AT_ONCE):
            at = first[i : i + ROWS_AT_ONCE + 1] if i + ROWS_AT_ONCE <= n_boards else first[i:]
            own = code[at[:-1]]
            for part in _parts(np.diff(at)):
                low = at[part.start]
                n = np.add.reduceat(runs[low : at[part.stop]], at[part] - low)
                line = own[part] % n_lines
                factor, least, most = rule[line, 0], rule[line, 1], rule[line, 2]
                files.add("board_wait", _rounded(np.minimum(most, np.maximum(least, self.window_minutes / n * factor))), "f8")
            files.add("board_line", own % n_lines, "i4")
            before[1:] += np.bincount(own // n_lines, minlength=n_stops)
        files.add("board_start", np.cumsum(before), "i8")
        if len(ridden := files.get("ridden_code", "r+")):
            ridden.sort()
        for i in range(0, len(ridden), ROWS_AT_ONCE):
            own = ridden[i : i + ROWS_AT_ONCE]
            own = own[np.r_[i == 0 or ridden[i - 1] != own[0], own[1:] != own[:-1]]]
            files.add("r_code", own, "i8")
            files.add("r_line", own % n_lines, "i4")
            files.add("r_stop", own // n_lines, "i4")
            files.add("r_low", np.searchsorted(code, own, side="left"), "i8")
            files.add("r_high", np.searchsorted(code, own, side="right"), "i8")
        r_code, to = files.get("r_code"), files.get("hop_b")
        files.add("ridden", np.searchsorted(r_code, np.arange(n_stops + 1) * np.int64(n_lines)), "i8")
        for i in range(0, n_hops, ROWS_AT_ONCE):
            b = to[i : i + ROWS_AT_ONCE].astype("i8")
            state = n_stops + n_boards + np.searchsorted(r_code, b * n_lines + code[i : i + ROWS_AT_ONCE] % n_lines)
            files.add("hop_to", np.where(b >= 0, state, 0), "i4" if n_stops + n_boards + len(r_code) < 2**31 else "i8")
        files.drop("hop_code", "hop_b", "hop_n", "ridden_code", "r_code")
        lat, lon = files.get("stop_lat"), files.get("stop_lon")
        _add_near(files, "near", search.near_parts(lat, lon, lat, lon, self.walk.max_transfer_walk_m), False)


class _View:
    """Looked up like an array."""

    def __init__(self, of: Callable):
        self.of = of

    def __getitem__(self, key):
        return self.of(key)

    def __contains__(self, key) -> bool:
        return self.of(key) is not None


class MappedStates:
    """The search of search.StateGraph over mapped arrays. States: S of every stop, then the boardings by stop and line, then what is ridden to by stop and line."""

    reverse = False

    def __init__(self, net: MappedNet, modes: tuple[str, ...] | None):
        get = net.files.get
        self.hop_to, self.hop_minutes = get("hop_to"), get("hop_minutes")
        self.board_hop, self.board_line, self.board_wait, self.board_start = (get(f"board_{x}") for x in ("hop", "line", "wait", "start"))
        self.r_low, self.r_high, self.r_line, self.r_stop, self.ridden = get("r_low"), get("r_high"), get("r_line"), get("r_stop"), get("ridden")
        self.near_start, self.near_to, self.near_m, self.walk = get("near_start"), get("near_to"), get("near_m"), net.walk
        on = np.array([modes is None or m in modes for m in sorted(net.rules)])[get("line_mode")]
        self.penalty = np.where(on, get("line_penalty"), np.inf)  # a line that is not in use is never boarded
        self.on = on
        self.b0 = len(self.board_start) - 1
        self.r0 = self.b0 + len(self.board_line)
        self.size = self.r0 + len(self.r_line)
        self.kind = _View(lambda s: 0 if s < self.b0 else 1 if s < self.r0 else 2)
        self.stop = _View(lambda s: s if s < self.b0 else int(np.searchsorted(self.board_start, s - self.b0, side="right")) - 1 if s < self.r0 else int(self.r_stop[s - self.r0]))
        self.line = _View(lambda s: -1 if s < self.b0 else int(self.board_line[s - self.b0]) if s < self.r0 else int(self.r_line[s - self.r0]))
        self.ride, self.wait, self.walk_between = _View(lambda k: self._ride(*k)), _View(lambda k: None if (i := self._board(*k)) is None else float(self.board_wait[i])), _View(lambda k: self._walk(*k))

    def _walk_minutes(self, metres: np.ndarray) -> np.ndarray:
        return metres * self.walk.detour_factor / self.walk.speed_m_per_min

    def _board(self, stop: int, line: int) -> int | None:
        a, b = self.board_start[stop], self.board_start[stop + 1]
        i = a + np.searchsorted(self.board_line[a:b], line)
        return int(i) if i < b and self.board_line[i] == line else None

    def _ridden(self, stop: int, line: int) -> int | None:
        a, b = self.ridden[stop], self.ridden[stop + 1]
        i = a + np.searchsorted(self.r_line[a:b], line)
        return int(i) if i < b and self.r_line[i] == line else None

    def _ride(self, line: int, a: int, b: int) -> float | None:
        board, to = self._board(a, line), self._ridden(b, line)
        if board is None or to is None:
            return None
        low, high = self.board_hop[board], self.board_hop[board + 1]
        hit = np.flatnonzero(self.hop_to[low:high] == to + self.r0)
        return float(self.hop_minutes[low + hit[-1]]) if len(hit) else None

    def _walk(self, a: int, b: int) -> float | None:
        low, high = self.near_start[a], self.near_start[a + 1]
        hit = np.flatnonzero(self.near_to[low:high] == b)
        return float(self._walk_minutes(self.near_m[low + hit[-1]])) if len(hit) else None

    def entries(self, walked: list[tuple[int, float]]) -> list[tuple[float, int]]:
        return [(minutes, stop) for stop, minutes in walked]

    def search(self, seeds: list[tuple[float, int]]) -> np.ndarray:
        """The least cost of every state. Each round relaxes all that was improved, ROWS_AT_ONCE states after another, to the fixpoint."""
        found, better = np.full(self.size, np.inf), np.zeros(self.size, bool)
        for cost, stop in seeds:
            found[stop] = min(found[stop], cost)
        stops = np.unique(np.array([stop for _, stop in seeds], "i8"))
        which, board = _between(self.board_start[stops], self.board_start[stops + 1])
        better[search._improve(found, self.b0 + board, found[stops][which] + np.where(self.on[self.board_line[board]], self.board_wait[board], np.inf))] = True
        offers = np.full(self.b0, np.inf), np.full(self.b0, np.inf)
        ridden = np.zeros(self.b0, bool)
        while better.any():
            for i in range(self.b0, self.size, ROWS_AT_ONCE):
                ahead = i + np.flatnonzero(better[i : i + ROWS_AT_ONCE])
                better[ahead] = False
                boards, rides = ahead[ahead < self.r0] - self.b0, ahead[ahead >= self.r0] - self.r0
                ridden[self.r_stop[rides]] = True
                for states, low, high in ((boards + self.b0, self.board_hop[boards], self.board_hop[boards + 1]), (rides + self.r0, self.r_low[rides], self.r_high[rides])):
                    for part in _parts(high - low):
                        which, edge = _between(low[part], high[part])
                        better[search._improve(found, self.hop_to[edge], found[states[part]][which] + self.hop_minutes[edge])] = True
            stops = np.flatnonzero(ridden)
            ridden[stops] = False
            self._change(found, stops, offers, better)
        return found

    def _change(self, found: np.ndarray, stops: np.ndarray, offers: tuple[np.ndarray, np.ndarray], better: np.ndarray) -> None:
        """Changes of line from stops, where their best two lines (``offers``) have become better."""
        for part in _parts(self.ridden[stops + 1] - self.ridden[stops]):
            at = stops[part]
            which, place = _between(self.ridden[at], self.ridden[at + 1])
            values, lines, runs = found[self.r0 + place], self.r_line[place], np.searchsorted(which, np.arange(len(at)))
            first, best = search._least(values, runs)
            line = lines[best]
            second = np.minimum.reduceat(np.where(lines == line[which], np.inf, values), runs)
            new = (first < offers[0][at]) | (second < offers[1][at])
            at, first, second, line = at[new], first[new], second[new], line[new]
            offers[0][at], offers[1][at] = first, second
            who, pair = _between(self.near_start[at], self.near_start[at + 1])
            who, to, minutes = np.r_[np.arange(len(at)), who], np.r_[at, self.near_to[pair]], np.r_[np.zeros(len(at)), self._walk_minutes(self.near_m[pair])]
            low, high = self.board_start[to], self.board_start[to + 1]
            for some in _parts(high - low):
                which, board = _between(low[some], high[some])
                lines, by = self.board_line[board], who[some][which]
                better[search._improve(found, self.b0 + board, np.where(lines != line[by], first[by], second[by]) + (self.penalty[lines] + minutes[some][which] + self.board_wait[board]))] = True

    def stop_minutes(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, _View]:
        """(stop, minutes, state) of the stops reached; the lower state settles ties."""
        stops = np.flatnonzero(np.diff(self.ridden))
        minutes = np.minimum.reduceat(found[self.r0 :], self.ridden[stops]) if len(stops) else np.zeros(0)
        stops, minutes = stops[met := np.isfinite(minutes)], minutes[met]
        return stops, minutes, _View(lambda i: self.r0 + int(self.ridden[stops[i]]) + int(np.argmin(found[self.r0 + self.ridden[stops[i]] : self.r0 + self.ridden[stops[i] + 1]])))

    def chain(self, found: np.ndarray, seeds: list[tuple[float, int]], state: int) -> list[int]:
        """The states before ``state`` on a best way, from it back to a seed; of equally good ones the one of the least cost, then of the lowest number."""
        begun: dict[int, float] = {}
        for cost, s in seeds:
            begun[s] = min(begun.get(s, np.inf), cost)
        out = [state]
        while begun.get(state, np.inf) != found[state]:
            before, cost = self._before(state)
            tight = before[(found[before] + cost == found[state]) & ~np.isin(before, out)]
            state = int(tight[np.lexsort((tight, found[tight]))[0]])
            out.append(state)
        return out

    def _before(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """The states that lead to a boarding or to a ride's end, and the costs from them."""
        stop, line = self.stop[state], self.line[state]
        if state >= self.r0:
            hops = np.concatenate([i + np.flatnonzero(self.hop_to[i : i + ROWS_AT_ONCE] == state) for i in range(0, len(self.hop_to), ROWS_AT_ONCE)])
            boards, states, costs = np.searchsorted(self.board_hop, hops, side="right") - 1, [], []
            for board, minutes in zip(boards.tolist(), self.hop_minutes[hops].tolist()):
                on = self._ridden(self.stop[self.b0 + board], line)
                for s in (self.b0 + board, *(() if on is None else (self.r0 + on,))):
                    states.append(s)
                    costs.append(minutes)
            return np.array(states, "i8"), np.array(costs)
        wait, low, high = float(self.board_wait[state - self.b0]), self.near_start[stop], self.near_start[stop + 1]
        from_stops, minutes = np.r_[stop, self.near_to[low:high]], np.r_[0.0, self._walk_minutes(self.near_m[low:high])]
        which, place = _between(self.ridden[from_stops], self.ridden[from_stops + 1])
        other = self.r_line[place] != line
        step = self.penalty[line] + minutes[which] + wait
        return np.r_[stop, self.r0 + place[other]], np.r_[wait if self.on[line] else np.inf, step[other]]


def network_files(found: Timetable, city: City) -> MappedNet:
    """The network of a timetable as sorted tables in the shared folder, for searches of any size. Stops are numbered by id, lines by route and direction."""
    order = lambda df, *by: stored(df.repartitionByRange(*by).sortWithinPartitions(*by))
    hops = order(found.hops.select(*LINE, "a", "b", "minutes", "n"), "a", *LINE, "b")
    spark = found.hops.sparkSession
    stops = order(found.stops.select("stop_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), "stop_id")
    start, end = city.window.seconds
    rules = {m.id: (float(m.wait.factor), float(m.wait.min), float(m.wait.max), float(m.transfer_min)) for m in city.modes}
    return MappedNet(uuid.uuid4().hex, shared_folder(spark, "mapped"), stops, order(spark.read.parquet(hops).select(*LINE).distinct(), *LINE), hops, rules, (end - start) / 60.0, city.walk)


def _placed(origins: DataFrame) -> DataFrame:
    return origins.select(F.col("origin").cast("string").alias("origin"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna()


def _rows(origin: str, name: str, ids: pa.LargeStringArray, places: np.ndarray, minutes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(places), ROWS_OUT):
        names = ids.take(pa.array(places[i : i + ROWS_OUT])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(origin, pa.string()), len(names)), names, pa.array(minutes[i : i + ROWS_OUT])], ["origin", name, "minutes"])


def stop_times(net: MappedNet, origins: DataFrame, modes: tuple[str, ...] | None = None) -> DataFrame:
    """(origin, stop_id, minutes): search.stop_times by ids."""
    ship(origins.sparkSession)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, own = search.states_in_worker(net.digest, lambda: net, modes, False), search.network_in_worker(net.digest, lambda: net)
            for row in batch.to_pylist():
                if near := search.walkable_stops(own, row["lat"], row["lon"]):
                    stops, minutes = states.stop_minutes(states.search(states.entries(near)))[:2]  # the states' costs go before the next search
                    yield from _rows(row["origin"], "stop_id", own.stop_ids, stops, minutes)

    return spread(_placed(origins)).mapInArrow(times, "origin string, stop_id string, minutes double")


def _build_points(net: MappedNet, table: str, files: Files) -> None:
    """The points, the starts of those of one id, and the stops within a walk of each."""
    _add_places(files, "point", table, "point")
    ids = files.texts("point")
    files.add("group", np.r_[0, 1 + np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))][: len(ids)], "i8")
    _add_near(files, "walk", search.near_parts(files.get("point_lat"), files.get("point_lon"), net.stop_lat, net.stop_lon, net.walk.max_access_m), True)


@dataclass
class _Points:
    """Mapped points as search.walkable_stops looks at them."""

    by_lat: np.ndarray
    sorted_lat: np.ndarray
    stop_lat: np.ndarray
    stop_lon: np.ndarray
    walk: Walk


def point_times(net: MappedNet, origins: DataFrame, points: DataFrame, direct_walk_m: float | None = None) -> DataFrame:
    """(origin, point, minutes): search.kernel_point_times; a repeated point or origin counts once, at its best."""
    ship(origins.sparkSession)
    table = stored(points.select(F.col("point").cast("string").alias("point"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna().repartitionByRange("point").sortWithinPartitions("point"))
    name, direct_m = f"points-{uuid.uuid4().hex}", max(net.walk.max_access_m, direct_walk_m or 0.0)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, own = search.states_in_worker(net.digest, lambda: net, None, False), search.network_in_worker(net.digest, lambda: net)
            files = own.place(name).made(lambda f: _build_points(own, table, f))
            ids, group, start, to, metres = files.texts("point"), files.get("group"), files.get("walk_start"), files.get("walk_to"), files.get("walk_m")
            around = _Points(files.get("point_by_lat"), files.get("point_sorted_lat"), files.get("point_lat"), files.get("point_lon"), own.walk)
            reached_by = np.flatnonzero(np.diff(start))
            for row in batch.to_pylist():
                best = np.full(len(ids), np.inf)
                for place in row["places"]:
                    for point, minutes in search.walkable_stops(around, place["lat"], place["lon"], direct_m):
                        best[point] = min(best[point], minutes)
                    if near := search.walkable_stops(own, place["lat"], place["lon"]):
                        stops, minutes = states.stop_minutes(states.search(states.entries(near)))[:2]  # the states' costs go before the next search
                        at = np.full(len(own.stop_lat), np.inf)
                        at[stops] = minutes
                        for part in _parts(start[reached_by + 1] - start[reached_by]):
                            some = reached_by[part]
                            low, high = start[some[0]], start[some[-1] + 1]
                            ridden = np.minimum.reduceat(at[to[low:high]] + metres[low:high] * own.walk.detour_factor / own.walk.speed_m_per_min, start[some] - low)
                            best[some] = np.minimum(best[some], ridden)
                if len(best):
                    best = np.minimum.reduceat(best, group)
                    met = np.flatnonzero(np.isfinite(best))
                    yield from _rows(row["origin"], "point", ids, group[met], best[met])

    placed = _placed(origins).groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("lat", "lon"))).alias("places"))
    return spread(placed).mapInArrow(times, "origin string, point string, minutes double")
