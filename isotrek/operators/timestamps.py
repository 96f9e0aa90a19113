"""Timestamps of mixed notation to one UTC instant.

Every value is reduced to a mask of character classes (digit, letter, the sign itself). A mask is
compiled once per worker into a parser that knows at which positions which field stands; all values
of a batch that share a mask are then converted together with numpy, through zone transition tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotrek.functions.values import WHITE_SPACE
from isotrek.functions.zones import ABBREVIATION_MINUTES, DAY, database_version, zone_table

HELD_CELLS = 4_000_000  # characters that are laid out at once; longer values go through in smaller groups
CACHED_MASK = 128  # masks up to this length are remembered with their parsers
EXACT_DIGITS = 15  # digits of an hour count whose seconds still fit 64 bits
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
PLAIN = re.compile(r"9{1,2}:99:99")

_CLASS = np.full(129, ord("U"), "uint8")
for _c in range(33, 127):
    _CLASS[_c] = ord("9") if chr(_c).isdigit() else ord("A") if chr(_c).isalpha() else _c
_CLASS[32], _CLASS[0] = 32, 0

DATE = (
    r"(?:(?P<iso>(?P<y>9999)([-/])(?P<m>99)\3(?P<d>99))|(?P<ordinal>(?P<oy>9999)-(?P<od>999))|(?P<basic>99999999)"
    r"|(?P<slash>(?P<s1>99?)/(?P<s2>99?)/(?P<sy>9999))|(?P<dot>(?P<d1>99?)\.(?P<d2>99?)\.(?P<dy>9999))"
    r"|(?P<named>(?:(?P<wd>AAA), ?)?(?P<nd>99?)[ -](?P<nm>AAA)[ -](?P<ny>9999)))"
)
TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,]9+)?)?"
ZONE = r"(?:(?P<z>A)|(?P<off> ?[+-](?:99:?99|99))(?:\[[A9_+/-]+\])?|\[(?P<bracket>[A9_+/-]+)\]| (?P<name>A[A9_+-]*(?:/[A9_+-]+)+)| (?P<abbr>A{2,5}))"
DATED = re.compile(rf"{DATE}(?P<sep>A| +)(?:{TIME}|(?P<bt>999999|9999))(?P<ap> ?AA(?!A))?{ZONE}?")
CLOCK = re.compile(rf"(?P<h>9+):(?P<mi>99)(?::(?P<s>99))?(?P<ap> ?AA)?")
NUMBER = re.compile(r"9{9,17}")
#: Unix time by magnitude: up to so many digits are seconds, milliseconds, microseconds. Fourteen digits are a calendar reading.
UNIX_DIGITS = ((11, 1), (13, 10**3), (17, 10**6))


def plan_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """What a mask is and where its fields stand; None for a mask of no known notation."""
    return _remembered(mask) if len(mask) <= CACHED_MASK else _compiled(mask)


def _compiled(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    for kind, pattern in (("number", NUMBER), ("clock", CLOCK), ("dated", DATED)):
        if m := pattern.fullmatch(mask):
            return kind, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


_remembered = lru_cache(65_536)(_compiled)


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 of a civil date, and whether there is such a date."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 0, 12)] + (leap & (month == 2))
    real = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= length)
    y = year - (month <= 2)
    era = y // 400
    of_era = y - era * 400
    of_year = (153 * (month + np.where(month > 2, -3, 9)) + 2) // 5 + day - 1
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719_468, real


class _Group:
    """The values of one mask: character codes, one row a value."""

    def __init__(self, codes: np.ndarray, spans: dict[str, tuple[int, int]]):
        self.codes, self.spans = codes, spans

    def has(self, field: str) -> bool:
        return field in self.spans

    def number(self, field: str | tuple[int, int]) -> np.ndarray:
        a, b = self.spans[field] if isinstance(field, str) else field
        out = np.zeros(len(self.codes), "int64")
        for i in range(max(a, b - EXACT_DIGITS - 3), b):
            out = out * 10 + (self.codes[:, i].astype("int64") - 48)
        return out

    def text(self, field: str) -> np.ndarray:
        a, b = self.spans[field]
        part = np.ascontiguousarray(self.codes[:, a:b])
        return part.view(f"<U{b - a}").ravel()


def _clock(group: _Group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if group.has("bt"):
        a, b = group.spans["bt"]
        h, mi = group.number((a, a + 2)), group.number((a + 2, a + 4))
        s = group.number((a + 4, b)) if b - a == 6 else np.zeros_like(h)
    else:
        h, mi = group.number("h"), group.number("mi")
        s = group.number("s") if group.has("s") else np.zeros_like(h)
    ok = (mi < 60) & (s < 60)
    if group.has("h"):
        a, b = group.spans["h"]
        ok &= (group.codes[:, a : max(a, b - EXACT_DIGITS)] == ord("0")).all(axis=1)
    if group.has("ap"):
        half = np.char.lower(np.char.strip(group.text("ap")))
        ok &= np.isin(half, ["am", "pm"]) & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (half == "pm")
    return h, mi, s, ok


def _date(group: _Group, service_day: np.ndarray, has_day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = group.number
    if group.has("iso"):
        return _days(n("y"), n("m"), n("d"))
    if group.has("ordinal"):
        first, _ = _days(year := n("oy"), np.ones_like(year), np.ones_like(year))
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        return first + n("od") - 1, (year >= 1) & (n("od") >= 1) & (n("od") <= 365 + leap)
    if group.has("basic"):
        a, _ = group.spans["basic"]
        return _days(n((a, a + 4)), n((a + 4, a + 6)), n((a + 6, a + 8)))
    if group.has("named"):
        name = np.char.lower(group.text("nm"))
        month = np.zeros(len(name), "int64")
        for i, x in enumerate(MONTHS, 1):
            month[name == x] = i
        day, real = _days(n("ny"), month, n("nd"))
        if group.has("wd"):
            real &= np.isin(np.char.lower(group.text("wd")), WEEKDAYS)
        return day, real
    first, second, year = (("s1", "s2", "sy") if group.has("slash") else ("d1", "d2", "dy"))
    by_day, day_real = _days(n(year), n(second), n(first))
    by_month, month_real = _days(n(year), n(first), n(second))
    near_day = day_real & has_day & (abs(by_day - service_day) <= 1)
    near_month = month_real & has_day & (abs(by_month - service_day) <= 1)
    sure_day = day_real & ~month_real if group.has("slash") else day_real
    sure_month = month_real & ~day_real
    take_day = near_day | (~near_month & sure_day)
    take_month = ~take_day & (near_month | sure_month)
    return np.where(take_day, by_day, by_month), take_day | take_month


def _through_zone(zone: str, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = zone_table(zone) if zone else None
    return found.to_utc(wall) if found else (wall, np.zeros(len(wall), bool))


def _by_zone(zones: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    utc, ok = np.zeros_like(wall), np.zeros(len(wall), bool)
    for zone in np.unique(zones):
        rows = zones == zone
        utc[rows], ok[rows] = _through_zone(str(zone), wall[rows])
    return utc, ok


def _abbreviated(names: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset seconds of abbreviations; the agency's zone explains its own ones first."""
    offset, ok = np.zeros(len(names), "int64"), np.zeros(len(names), bool)
    pairs = np.char.add(np.char.add(names, "\t"), zones)
    for pair in np.unique(pairs):
        name, _, zone = str(pair).partition("\t")
        own = zone_table(zone).names if zone and zone_table(zone) else {}
        minutes = ABBREVIATION_MINUTES.get(name.upper())
        found = own.get(name.upper(), None if minutes is None else minutes * 60)
        if found is not None:
            offset[pairs == pair], ok[pairs == pair] = found, True
    return offset, ok


def _convert(kind: str, group: _Group, zones: np.ndarray, service_day: np.ndarray, has_day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if kind == "number":
        width = group.codes.shape[1]
        if width != 14:
            per_second = next(unit for most, unit in UNIX_DIGITS if width <= most)
            return group.number((0, width)) // per_second, np.ones(len(group.codes), bool)
        day, real = _days(group.number((0, 4)), group.number((4, 6)), group.number((6, 8)))
        h, mi, s = (group.number(x) for x in ((8, 10), (10, 12), (12, 14)))
        utc, shown = _by_zone(zones, day * DAY + h * 3600 + mi * 60 + s)
        return utc, real & (h < 24) & (mi < 60) & (s < 60) & shown
    h, mi, s, ok = _clock(group)
    second = h * 3600 + mi * 60 + s
    if kind == "clock" and group.has("ap"):
        utc, shown = _by_zone(zones, service_day * DAY + second)
        return utc, ok & shown & has_day
    if kind == "clock":
        noon, shown = _by_zone(zones, service_day * DAY + DAY // 2)
        return noon - DAY // 2 + second, ok & shown & has_day
    day, real = _date(group, service_day, has_day)
    ok &= real & (h < 24)
    a, b = group.spans["sep"]
    if b - a == 1 and group.codes.shape[1] > a:
        ok &= np.isin(group.codes[:, a], [ord("T"), ord("t"), ord(" ")])
    wall = day * DAY + second
    if group.has("z"):
        return wall, ok & np.isin(group.text("z"), ["Z", "z"])
    if group.has("off"):
        a, b = group.spans["off"]
        a += int(group.codes[0, a] == 32)
        sign = np.where(group.codes[:, a] == ord("-"), -1, 1)
        hours = group.number((a + 1, a + 3))
        minutes = group.number((b - 2, b)) if b - a > 3 else np.zeros_like(hours)
        return wall - sign * (hours * 3600 + minutes * 60), ok & (hours <= 18) & (minutes < 60)
    if group.has("abbr"):
        offset, known = _abbreviated(np.char.upper(group.text("abbr")), zones)
        return wall - offset, ok & known
    if group.has("bracket") or group.has("name"):
        zones = group.text("bracket" if group.has("bracket") else "name")
    utc, shown = _by_zone(zones, wall)
    return utc, ok & shown


def to_instants(values: pd.Series, zones: pd.Series, service_days: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Seconds since 1970 UTC of each value, and whether it means a time at all.

    zones holds IANA names (null: zone unknown), service_days yyyyMMdd (null: none). Null, blank
    and unreadable values, unreal days and clock times, and readings that the zone's clock skips mean
    no time; so do hour counts of over fifteen digits, whose instant no 64-bit second can hold, and bare
    digits of other lengths than nine to seventeen. A value may be of any length: its mask decides.
    """
    n = len(values)
    utc, ok = np.zeros(n, "int64"), np.zeros(n, bool)
    if not n:
        return utc, ok
    text = values.fillna("").astype(str).str.strip(WHITE_SPACE)
    lengths = text.str.len().to_numpy()
    if int(lengths.max()) * n > HELD_CELLS:
        order = np.argsort(lengths, kind="stable")
        for rows in _groups_by_size(order, lengths[order]):
            utc[rows], ok[rows] = _to_instants(text.iloc[rows], zones.iloc[rows], service_days.iloc[rows])
        return utc, ok
    return _to_instants(text, zones, service_days)


def _groups_by_size(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of ``order`` (by rising length) of which each takes at most HELD_CELLS characters, or is a single value."""
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and int(lengths[end]) * (end + 1 - start) <= HELD_CELLS:
            end += 1
        yield order[start:end]
        start = end


def _to_instants(text: pd.Series, zones: pd.Series, service_days: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """to_instants of stripped values that fit into memory side by side."""
    n = len(text)
    utc, ok = np.zeros(n, "int64"), np.zeros(n, bool)
    zone = zones.fillna("").to_numpy().astype("U")
    days = service_days.fillna("").astype(str).str.strip(WHITE_SPACE)
    day_number, has_day = np.zeros(n, "int64"), days.str.fullmatch("[0-9]{8}").to_numpy(bool)
    if has_day.any():
        d = days[has_day].astype("int64").to_numpy()
        day_number[has_day], real = _days(d // 10_000, d // 100 % 100, d % 100)
        has_day[has_day] = real
    array = text.to_numpy().astype("U")
    width = max(1, array.dtype.itemsize // 4)
    codes = np.ascontiguousarray(array.astype(f"<U{width}")).view("uint32").reshape(n, width)
    classes = _CLASS[np.minimum(codes, 128)]
    masks, which = np.unique(np.ascontiguousarray(classes).view(f"S{width}").ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(masks) + 1))
    for i, raw in enumerate(masks):
        mask = raw.decode("latin-1")
        if not mask or (plan := plan_of(mask)) is None:
            continue
        rows = order[bounds[i] : bounds[i + 1]]
        group = _Group(codes[rows][:, : len(mask)], plan[1])
        utc[rows], ok[rows] = _convert(plan[0], group, zone[rows], day_number[rows], has_day[rows])
    return utc, ok


def normalise_timestamps(df: DataFrame, value: str, zone: str, service_day: str, out: str = "utc_epoch") -> DataFrame:
    """Adds ``out`` (long): the UTC instant in seconds that column ``value`` means, null where it means none.

    Rows and all other columns are kept as they are, in any number and with any names but ``out``,
    which is refused if it exists. An empty table gives an empty table with the added column.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists already")
    version = database_version()

    @F.pandas_udf(T.LongType())
    def instants(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if database_version() != version:
            raise RuntimeError(f"time zone database {database_version()} here, {version} on the driver")
        for values, zones, days in batches:
            utc, ok = to_instants(values, zones, days)
            yield pd.Series(pd.array(utc, "Int64")).mask(~ok)

    text = [F.col(f"`{c}`").cast("string") for c in (value, zone, service_day)]
    return df.withColumn(out, instants(*text))


def change_day_rows(zones: list[str]) -> list[tuple[str, str]]:
    """(zone, yyyyMMdd) of each service day on which, or on the day after which, the zone's clock changes."""
    rows = set()
    for name in zones:
        found = zone_table(name)
        for day in found.change_days() if found else ():
            for d in (day - 1, day):
                rows.add((name, str(np.datetime64(d, "D")).replace("-", "")))
    return sorted(rows)
