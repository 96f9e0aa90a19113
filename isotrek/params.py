"""City configuration and query parameters: plain validated dataclasses, no Spark."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

# What a mode has if its configuration leaves it out.
TRANSIT_DEFAULTS = {"wait": {"factor": 0.5, "min": 1, "max": 15}, "transfer_min": 1.5, "enabled_default": True}
WALK_DEFAULTS = {"detour_factor": 1.0, "speed_m_per_min": 75, "max_access_m": 1000, "max_transfer_walk_m": 400, "network": "straight"}
DEFAULT_MAX_SNAP_M = 150.0
MIN_RIDE_MINUTES = 0.4
NETWORKS = ("straight", "streets")
CITY_KEYS = {
    "id", "name", "country", "timezone", "bbox", "center", "modes", "window", "isochrones", "max_minutes", "grid", "feeds",
    "boundary", "gtfs", "locale", "default_language", "geocoder", "attribution", "languages", "allow_expired", "stats",
}


class ConfigError(ValueError):
    """A configuration that cannot be used; the message lists every faulty field."""


@dataclass(frozen=True)
class Wait:
    factor: float = 0.5
    min: float = 1
    max: float = 15


@dataclass(frozen=True)
class Mode:
    id: str
    route_types: tuple[str, ...]
    wait: Wait = Wait()
    transfer_min: float = 1.5
    enabled_default: bool = True


@dataclass(frozen=True)
class Walk:
    detour_factor: float = 1.0
    speed_m_per_min: float = 75
    max_access_m: float = 1000
    max_transfer_walk_m: float = 400
    network: str = "straight"
    max_snap_m: float = DEFAULT_MAX_SNAP_M

    @property
    def streets(self) -> bool:
        return self.network == "streets"

    def minutes(self, metres: float) -> float:
        return metres / self.speed_m_per_min if self.streets else metres * self.detour_factor / self.speed_m_per_min


@dataclass(frozen=True)
class Window:
    start: str = "07:00"
    end: str = "22:00"

    @property
    def seconds(self) -> tuple[int, int]:
        start, end = clock_seconds(self.start), clock_seconds(self.end)
        if end <= start:
            raise ConfigError(f"window end {self.end} is not after its start {self.start}")
        return start, end


@dataclass(frozen=True)
class City:
    id: str
    bbox: tuple[float, float, float, float]
    center: tuple[float, float]
    walk: Walk
    modes: tuple[Mode, ...]
    window: Window = Window()
    isochrones: tuple[int, ...] = (15, 30, 45)
    max_minutes: int = 60
    other: dict = field(default_factory=dict, hash=False, compare=False)

    def mode_of_route_type(self) -> dict[str, str]:
        """Route type to mode; the first mode by id claims a type."""
        claimed: dict[str, str] = {}
        for mode in sorted(self.modes, key=lambda m: m.id):
            for route_type in mode.route_types:
                claimed.setdefault(route_type, mode.id)
        return claimed


@dataclass(frozen=True)
class Query:
    """What a reach question asks; a cache of results is keyed by it."""

    origin: tuple[float, float] | None = None
    destination: tuple[float, float] | None = None
    direction: str = "from"
    modes: tuple[str, ...] | None = None
    max_minutes: int = 60
    isochrones: tuple[int, ...] = ()

    @property
    def direct_minutes(self) -> int | None:
        """Walking all the way goes on to the end of the scale only if no transit mode is on."""
        return self.max_minutes if self.modes is not None and not self.modes else None


ACTIONS = ("origin", "destination", "direction", "invert", "modes", "toggle_mode", "travel", "max_minutes", "isochrones", "clear")
LEAST_SCALE, MOST_SCALE = 5, 120


def reduce_query(query: Query, action: str, value: object = None, city: City | None = None) -> Query:
    """The query after one action; an action that changes nothing, or whose value is not usable, gives the same object back.

    With a ``city`` places outside its box and unknown modes are refused, and null modes stand for all of its
    modes, so that toggling one switches it off. The scale is rounded and clamped.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    known = tuple(m.id for m in city.modes) if city else ()
    change: dict[str, object] = {}
    if action == "clear":
        change = {"origin": None, "destination": None}
    elif action in ("origin", "destination"):
        west, south, east, north = city.bbox if city else (-180.0, -90.0, 180.0, 90.0)
        if value is None or (south <= value[0] <= north and west <= value[1] <= east):
            change = {action: None if value is None else tuple(value)}
    elif action == "invert":
        change = {"direction": "to" if query.direction == "from" else "from"}
    elif action == "travel":
        if value in ("walk", "transit") and (value == "walk") != (query.modes == ()):
            change = {"modes": () if value == "walk" else known or None}
    elif action == "toggle_mode":
        if not city or value in known:
            change = {"modes": tuple(sorted(set(known if query.modes is None else query.modes) ^ {value}))}
    elif action == "max_minutes":
        if isinstance(value, (int, float)) and math.isfinite(value):
            change = {"max_minutes": min(MOST_SCALE, max(LEAST_SCALE, math.floor(value + 0.5)))}
    elif action in ("modes", "isochrones"):
        change = {action: None if value is None else tuple(sorted(set(value)))}
    else:
        change = {action: value}
    new = replace(query, **change)
    return query if new == query else new


def stale_parts(before: Query, after: Query) -> set[str]:
    """What must be computed again: times if origin, direction or modes changed, or the scale when walking only."""
    stale = set()
    if (before.origin, before.direction, before.modes) != (after.origin, after.direction, after.modes):
        stale |= {"times", "contours", "trip"}
    if before.max_minutes != after.max_minutes:
        stale |= {"paint", "trip"} | ({"times", "contours"} if after.direct_minutes else set())
    if before.isochrones != after.isochrones:
        stale |= {"contours"}
    if before.destination != after.destination:
        stale |= {"trip"}
    return stale


def clock_seconds(text: str) -> int:
    """'HH:MM' or 'H:MM:SS' to seconds of the service day; hours may pass 24."""
    parts = [int(p) for p in text.split(":")]
    h, m, s = (*parts, 0)[:3] if len(parts) == 2 else parts
    return h * 3600 + m * 60 + s


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def parse_city(raw: dict, expected_id: str | None = None) -> City:
    """Check a raw configuration and fill in what it leaves out; every fault is reported, sorted by its path."""
    faults: list[str] = []

    def need(ok: bool, path: str, why: str) -> None:
        if not ok:
            faults.append(f"{path}: {why}")

    for name in sorted(set(raw) - CITY_KEYS):
        need(False, name, "unknown key")
    need(isinstance(raw.get("id"), str) and bool(re.fullmatch(r"[a-z0-9-]+", str(raw.get("id")))), "id", "lower-case letters, digits and hyphens expected")
    need(expected_id is None or raw.get("id") == expected_id, "id", f"must be {expected_id!r} as its file is named")
    box = raw.get("bbox")
    box_ok = isinstance(box, (list, tuple)) and len(box) == 4 and all(map(_number, box)) and box[0] < box[2] and box[1] < box[3]
    need(box_ok, "bbox", "[west, south, east, north] expected")
    centre = raw.get("center")
    need(isinstance(centre, (list, tuple)) and len(centre) == 2 and all(map(_number, centre)), "center", "[lat, lon] expected")
    modes = raw.get("modes") if isinstance(raw.get("modes"), dict) else {}
    need(bool(modes), "modes", "at least one mode expected")
    walks, transit = [], []
    for mode_id in sorted(modes):
        mode = modes[mode_id] if isinstance(modes[mode_id], dict) else {}
        kind = mode.get("kind")
        if kind == "walk":
            values = {k: mode.get(k, v) for k, v in WALK_DEFAULTS.items()} | {"max_snap_m": mode.get("max_snap_m", DEFAULT_MAX_SNAP_M)}
            for k, v in values.items():
                need(v in NETWORKS if k == "network" else _number(v) and v > 0, f"modes.{mode_id}.{k}", "not usable")
            walks.append(Walk(**values))
        elif kind == "transit":
            types = mode.get("route_types")
            need(isinstance(types, (list, tuple)) and bool(types), f"modes.{mode_id}.route_types", "a list expected")
            wait = TRANSIT_DEFAULTS["wait"] | (mode.get("wait") or {})
            need(set(wait) == {"factor", "min", "max"} and all(map(_number, wait.values())), f"modes.{mode_id}.wait", "factor, min and max expected")
            if not faults:
                transit.append(Mode(mode_id, tuple(str(t) for t in types), Wait(**wait), mode.get("transfer_min", TRANSIT_DEFAULTS["transfer_min"]), mode.get("enabled_default", True)))
        else:
            need(False, f"modes.{mode_id}.kind", "walk or transit expected")
    need(bool(walks) or not modes, "modes", "no walk mode")
    if faults:
        raise ConfigError("; ".join(sorted(faults)))
    window = Window(**raw["window"]) if "window" in raw else Window()
    city = City(raw["id"], tuple(box), tuple(centre), walks[0], tuple(transit), window, tuple(raw.get("isochrones", (15, 30, 45))), raw.get("max_minutes", 60), raw)
    city.window.seconds  # noqa: B018  raises if it is empty
    return city


def load_city(city_id: str, folder: str) -> City:
    return parse_city(json.loads(Path(folder, f"{city_id}.json").read_text(encoding="utf-8")), city_id)


def lint_cities(folder: str) -> dict[str, str]:
    """File name to fault, for every configuration of a folder that cannot be used."""
    faults = {}
    for path in sorted(Path(folder).glob("*.json")):
        try:
            parse_city(json.loads(path.read_text(encoding="utf-8")), path.stem)
        except ValueError as e:
            faults[path.name] = str(e)
    return faults


def pick_city(ids: list[str], wanted: str | None) -> str:
    """The wanted city if there is one of that id, else the first by id."""
    return wanted if wanted in ids else min(ids)


#: Half height and width in degrees of the boxes that the second rule set derives from a city's first place.
DERIVED_BOXES = {"osmBbox": (0.22, 0.32), "parksBbox": (0.06, 0.08)}


def second_defaults(raw: dict) -> dict:
    """A city configuration of the second rule set with the values that engine code needs filled in: boxes [south, west, north, east] around the first place, country, geocoder, kind and source of rail lines."""
    lat, lon = raw["defaultFrom"]["lat"], raw["defaultFrom"]["lon"]
    boxes = {name: [round(lat - h, 2), round(lon - w, 2), round(lat + h, 2), round(lon + w, 2)] for name, (h, w) in DERIVED_BOXES.items()}
    country = raw.get("country", "FR")
    derived = {"kind": "tram", "country": country, "geocoder": "ban" if country == "FR" else "photon", "railGeometry": "gtfs", "lat0": round(lat, 2), "path": f"{raw['slug']}/", **boxes}
    merged = derived | raw
    return {"osmRailBbox": merged["osmBbox"]} | merged


def load_second_city(slug: str, folder: str) -> dict:
    return second_defaults(json.loads(Path(folder, f"{slug}.json").read_text(encoding="utf-8")))
