"""A second, plain reading of times, one value at a time, with the standard library's clocks."""

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from isotrek.functions.zones import ABBREVIATION_MINUTES

UTC = timezone.utc


def _wall(at, zone):
    tz = ZoneInfo(zone)
    instant = at.replace(tzinfo=tz, fold=0)
    utc = instant.astimezone(UTC)
    if utc.astimezone(tz).replace(tzinfo=None) != at:
        return None
    return int(utc.timestamp())


def naive_epoch(value, zone, service_day):
    v = (value or "").strip()
    day = datetime.strptime(service_day, "%Y%m%d")
    try:
        if m := re.fullmatch(r"(\d{1,3}):(\d\d)(?::(\d\d))?", v):
            h, mi, s = int(m[1]), int(m[2]), int(m[3] or 0)
            return None if mi > 59 or s > 59 else _wall(day + timedelta(hours=12), zone) - 43_200 + h * 3600 + mi * 60 + s
        if m := re.fullmatch(r"(\d{1,2}):(\d\d)(?::(\d\d))? ?([AaPp])[Mm]", v):
            h, mi, s = int(m[1]), int(m[2]), int(m[3] or 0)
            if not 1 <= h <= 12 or mi > 59 or s > 59:
                return None
            return _wall(day + timedelta(hours=h % 12 + 12 * (m[4] in "pP"), minutes=mi, seconds=s), zone)
        if re.fullmatch(r"\d{10}", v):
            return int(v)
        if re.fullmatch(r"\d{13}", v):
            return int(v) // 1000
        if re.fullmatch(r"\d{16}", v):
            return int(v) // 1_000_000
        if re.fullmatch(r"\d{14}", v):
            return _wall(datetime.strptime(v, "%Y%m%d%H%M%S"), zone)
        v = re.sub(r"(:\d\d)[.,]\d+", r"\1", v)
        rest, tail, offset = v, None, None
        if m := re.fullmatch(r"(.*\d)\[(.+)\]", v):
            rest, zone = m[1], m[2]
        elif m := re.fullmatch(r"(.*\d) ([A-Za-z]+/[A-Za-z_/]+)", v):
            rest, zone = m[1], m[2]
        elif m := re.fullmatch(r"(.*\d)[Zz]", v):
            rest, offset = m[1], 0
        elif m := re.fullmatch(r"(.*\d) ([A-Z]{3,4})", v):
            rest, offset = m[1], ABBREVIATION_MINUTES[m[2]] * 60
        elif m := re.fullmatch(r"(.*:\d\d|\d{8}T\d{6}) ?([+-])(\d\d):?(\d\d)?", v):
            rest, offset = m[1], (1 if m[2] == "+" else -1) * (int(m[3]) * 3600 + int(m[4] or 0) * 60)
        readings = []
        for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%jT%H:%M:%S", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d.%m.%Y %H:%M"):
            try:
                readings.append(datetime.strptime(rest, form))
            except ValueError:
                pass
        if len(readings) > 1 and "/" in rest:
            readings = [r for r in readings if abs((r.date() - day.date()).days) <= 1]
        if not readings:
            return None
        at = readings[0]
        return int(at.replace(tzinfo=UTC).timestamp()) - offset if offset is not None else _wall(at, zone)
    except (ValueError, KeyError, TypeError):
        return None


def changes_clocks(zone, day_text):
    """Whether the zone's offset changes on the day or the day after, by looking at every quarter of an hour."""
    day = datetime.strptime(day_text, "%Y%m%d").date()
    tz = ZoneInfo(zone)
    at = datetime(day.year, day.month, day.day, tzinfo=tz).astimezone(UTC)
    end = day + timedelta(days=2)
    last = datetime(end.year, end.month, end.day, tzinfo=tz).astimezone(UTC)
    offsets = set()
    while at < last:
        offsets.add(at.astimezone(tz).utcoffset())
        at += timedelta(minutes=15)
    return len(offsets) > 1
