"""Zone transition tables: per IANA zone the instants at which its clock offset changes.

The tables are read from the transition lists and rules of the installed time zone database's files and carry its version, so that
results can be traced to it; executors refuse to work with another version than the driver's.
"""

from __future__ import annotations

import re
import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import metadata, resources
from pathlib import Path

import numpy as np

LAST_YEAR = 2100  # how far a zone's rule for later years is written out
FIRST_RULE_YEAR = 1970
FIRST_INSTANT = -(1 << 59)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
DAY = 86_400

# Offsets in minutes of zone abbreviations; an agency's own zone goes first.
ABBREVIATION_MINUTES = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120, "CAT": 120, "EAT": 180, "WAT": 60,
    "IST": 330, "PKT": 300, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "PHT": 480,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "BRST": -120, "ART": -180, "CLT": -240, "CLST": -180, "TVT": 720,
}


@lru_cache(1)
def database_version() -> str:
    """Version of the time zone database in use, or 'unversioned'."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            path = Path(folder, name)
            if path.exists():
                with path.open(errors="replace") as f:
                    return re.sub(r"^#\s*version\s*", "", f.readline()).strip()
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "unversioned"


def _zone_file(name: str) -> bytes:
    """The database's binary file of a zone, from the system or else from the tzdata package."""
    zoneinfo.ZoneInfo(name)  # refuses names that are no zone
    for folder in zoneinfo.TZPATH:
        path = Path(folder, name)
        if path.is_file():
            return path.read_bytes()
    package, _, last = f"tzdata.zoneinfo.{name.replace('/', '.')}".rpartition(".")
    return resources.files(package).joinpath(last).read_bytes()


def _listed(data: bytes) -> tuple[list[tuple[int, int, str]], str]:
    """((instant, offset, abbreviation) of every listed period, the first from the beginning of time; the rule for later years)."""
    counts = lambda at: struct.unpack_from(">6l", data, at + 20)
    n_utc, n_std, n_leap, n_times, n_types, n_chars = counts(0)
    at = 44 + n_times * 5 + n_types * 6 + n_chars + n_leap * 8 + n_std + n_utc
    n_utc, n_std, n_leap, n_times, n_types, n_chars = counts(at)
    at += 44
    instants = struct.unpack_from(f">{n_times}q", data, at)
    types = data[at + n_times * 8 : at + n_times * 9]
    at += n_times * 9
    kinds = [struct.unpack_from(">lBB", data, at + 6 * i) for i in range(n_types)]
    letters = data[at + n_types * 6 : at + n_types * 6 + n_chars]
    abbreviation = lambda i: letters[i : letters.index(0, i)].decode("ascii")
    rule = data[at + n_types * 6 + n_chars + n_leap * 12 + n_std + n_utc :].strip(b"\n").decode("ascii")
    periods = [(FIRST_INSTANT, kinds[0][0], abbreviation(kinds[0][2]))]
    return periods + [(i, kinds[t][0], abbreviation(kinds[t][2])) for i, t in zip(instants, types)], rule


_NAME, _CLOCK = r"(<[^>]+>|[A-Za-z]+)", r"[+-]?\d+(?::\d+){0,2}"
_RULE = re.compile(rf"{_NAME}({_CLOCK})(?:{_NAME}({_CLOCK})?,([^,/]+)(?:/({_CLOCK}))?,([^,/]+)(?:/({_CLOCK}))?)?")


def _seconds(clock: str | None, otherwise: int) -> int:
    if not clock:
        return otherwise
    parts = [int(x) for x in clock.lstrip("+-").split(":")]
    return (-1 if clock[0] == "-" else 1) * sum(x * u for x, u in zip(parts, (3600, 60, 1)))


def _rule_day(year: int, day: str) -> int:
    """Days since 1970 of a rule's day: Mm.w.d (w 5: last), Jn without and n with 29 February."""
    first = (datetime(year, 1, 1, tzinfo=timezone.utc) - EPOCH).days
    if not day.startswith("M"):
        n = int(day.lstrip("J"))
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        return first + (n - 1 + (leap and n > 59) if day.startswith("J") else n)
    month, week, weekday = (int(x) for x in day[1:].split("."))
    begin = datetime(year, month, 1, tzinfo=timezone.utc)
    days = [d for d in range(31) if (begin + timedelta(days=d)).month == month and (begin + timedelta(days=d)).isoweekday() % 7 == weekday]
    return (begin - EPOCH).days + days[min(week, len(days)) - 1]


def _by_rule(rule: str, after: int) -> list[tuple[int, int, str]]:
    """The periods that a rule adds after an instant, up to LAST_YEAR."""
    m = _RULE.fullmatch(rule)
    if not m or not m[3]:
        return []
    standard = -_seconds(m[2], 0)
    summer = -_seconds(m[4], 0) if m[4] else standard + 3600
    first_year, found = max(FIRST_RULE_YEAR, (EPOCH + timedelta(seconds=after)).year), []
    for year in range(first_year, LAST_YEAR + 1):
        found.append((_rule_day(year, m[5]) * DAY + _seconds(m[6], 7200) - standard, summer, m[3].strip("<>")))
        found.append((_rule_day(year, m[7]) * DAY + _seconds(m[8], 7200) - summer, standard, m[1].strip("<>")))
    return sorted(x for x in found if x[0] > after)


class ZoneTable:
    """starts[i] is the first instant (UTC seconds) of period i + 1, offsets[i] the offset of period i; period 0 has no start.

    names maps the zone's abbreviations to offsets, those in use since 1970 before older ones.
    """

    def __init__(self, name: str):
        self.name, self.version = name, database_version()
        periods, rule = _listed(_zone_file(name))
        periods += _by_rule(rule, max(periods[-1][0], 0))
        starts, offsets, names = [], [periods[0][1]], {}
        for i, (instant, offset, abbreviation) in enumerate(periods):
            until = periods[i + 1][0] if i + 1 < len(periods) else None
            if until is None or until > 0:
                names.setdefault(abbreviation, offset)
            if i and offset != offsets[-1]:
                starts.append(instant)
                offsets.append(offset)
        for _, offset, abbreviation in periods:
            names.setdefault(abbreviation, offset)
        self.starts, self.offsets, self.names = np.array(starts, "int64"), np.array(offsets, "int64"), names
        self.local_ends = self.starts + self.offsets[:-1]
        self.local_starts = self.starts + self.offsets[1:]

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First instant at which the zone's clock shows ``wall``, and whether it ever does (a skipped hour never)."""
        period = np.searchsorted(self.local_ends, wall, side="right")
        if len(self.starts):
            shown = (period == 0) | (wall >= self.local_starts[np.maximum(period, 1) - 1])
        else:
            shown = np.ones(len(wall), bool)
        return wall - self.offsets[period], shown

    def change_days(self) -> list[int]:
        """Local days (since 1970-01-01) on which the clock is changed, read before or after the change."""
        return sorted({int(x) // DAY for x in self.local_ends} | {int(x) // DAY for x in self.local_starts})


@lru_cache(1024)
def zone_table(name: str) -> ZoneTable | None:
    """The table of a zone, or None if the database has no such zone."""
    try:
        return ZoneTable(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
