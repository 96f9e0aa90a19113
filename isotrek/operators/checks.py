"""Feed validation, validity and release checks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.functions.values import key, real_day
from isotrek.operators.service_days import feed_validity

# The fields that every row of a table must have.
REQUIRED = {
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "routes": ["route_id", "route_type"],
    "trips": ["route_id", "service_id", "trip_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
}
CALENDARS = ("calendar", "calendar_dates")
FOREIGN_KEYS = [("trips", "route_id", "routes"), ("stop_times", "trip_id", "trips"), ("stop_times", "stop_id", "stops")]


class FeedError(ValueError):
    """A feed that cannot be used; the message names the file and the field or id."""


class ExpiredFeed(FeedError):
    """A feed whose validity lies in the past."""


def first_orphan(child: DataFrame, field: str, parent: DataFrame, order: str) -> DataFrame:
    """(field value, row), at most one row: the first row in file order whose reference is not in the parent."""
    lost = child.join(parent.select(field).distinct(), field, "left_anti")
    return lost.agg(F.min(F.struct(order, field)).alias("f")).filter("f is not null").select(F.col(f"f.{field}").alias("value"), F.col(f"f.{order}").alias("row"))


def validate_feed(feed: dict[str, DataFrame], missing_key: str = "_missing", order: str = "row_no") -> None:
    """Raise FeedError at the first fault: a table absent or empty, a field absent from any row, no calendar, a reference that does not resolve.

    A table of the feed reader has ``_missing``, the fields a row's line did not reach; a blank field is present.
    """
    for name, fields in REQUIRED.items():
        table = feed.get(name)
        if table is None or table.isEmpty():
            raise FeedError(f"{name}.txt: missing or empty")
        for field in fields:
            if field not in table.columns:
                raise FeedError(f"{name}.txt: no field {field}")
        if missing_key in table.columns:
            short = table.filter(F.arrays_overlap(missing_key, F.array(*(F.lit(f) for f in fields)))).agg(F.min(F.struct(order, missing_key)).alias("f")).first()
            if short and short["f"]:
                raise FeedError(f"{name}.txt: row {short['f'][0]} lacks {', '.join(f for f in fields if f in short['f'][1])}")
    if all(feed.get(name) is None or feed[name].isEmpty() for name in CALENDARS):
        raise FeedError("calendar.txt and calendar_dates.txt: both missing or empty")
    for child, field, parent in FOREIGN_KEYS:
        found = first_orphan(feed[child], field, feed[parent], order).first()
        if found:
            raise FeedError(f"{child}.txt: {field} {found['value']} is not in {parent}.txt")


def validity(feed: dict[str, DataFrame]) -> tuple[date, date]:
    """First and last day of the feed; a date that names no day is an error that names its file and column."""
    empty = next(iter(feed.values())).limit(0)
    for name, columns in (("calendar", ("start_date", "end_date")), ("calendar_dates", ("date",))):
        for column in columns:
            if name in feed and column in feed[name].columns:
                bad = feed[name].filter(real_day(F.col(column)).isNull()).select(column).first()
                if bad:
                    raise FeedError(f"{name}.txt: {column} {bad[0]!r} is no date")
    blank = lambda *c: empty.select(*(F.lit(None).cast("string").alias(x) for x in c))
    row = feed_validity(feed.get("calendar", blank("start_date", "end_date")), feed.get("calendar_dates", blank("date", "exception_type"))).first()
    if row is None or row[0] is None:
        raise FeedError("calendar.txt: no service day")
    return row[0], row[1]


def check_expiry(valid_to: date, today: date, allow_expired: bool = False) -> bool:
    """Whether the feed has expired; if that is not allowed, it is an error."""
    if valid_to >= today:
        return False
    if not allow_expired:
        raise ExpiredFeed(f"feed expired on {valid_to.isoformat()}")
    return True


@dataclass(frozen=True)
class Offer:
    """What one source of a feed gave: its validity, or the error it ended in."""

    source: str
    valid: tuple[date, date] | None = None
    error: str | None = None


def choose_offer(offers: list[Offer], today: date, allow_expired: bool = False) -> Offer:
    """The first feed that is valid today, else, if allowed, the first expired one; else an error.

    If every readable feed has expired the first expiry is the error, otherwise all errors together.
    """
    expired = []
    for offer in offers:
        if offer.valid and offer.valid[0] <= today <= offer.valid[1]:
            return offer
        if offer.valid and offer.valid[1] < today:
            expired.append(offer)
    if expired and allow_expired:
        return expired[0]
    if expired and len(expired) == len(offers):
        raise ExpiredFeed(f"{expired[0].source}: feed expired on {expired[0].valid[1].isoformat()}")
    raise FeedError("; ".join(f"{o.source}: {o.error or 'not valid today'}" for o in offers) or "no source")


def release_problems(metas: DataFrame, cities: DataFrame, today: date) -> DataFrame:
    """(city, problem): cities without metadata, with a validity that is no ISO date, marked expired, or ended before today."""
    day = F.try_to_date("valid_to", "yyyy-MM-dd")
    joined = cities.select("city").distinct().join(metas.select("city", "valid_to", "expired").withColumn("_meta", F.lit(True)), "city", "left")
    problem = (
        F.when(F.col("_meta").isNull(), "no metadata")
        .when(day.isNull() | ~F.col("valid_to").rlike(r"^\d{4}-\d{2}-\d{2}$"), "valid_to is no date")
        .when(F.coalesce("expired", F.lit(False)), "marked expired")
        .when(day < F.lit(today), "expired")
    )
    return joined.select("city", problem.alias("problem")).filter("problem is not null")


def foreign_keys_hold(feed: dict[str, DataFrame]) -> DataFrame:
    """(src, field, missing): how many rows of each reference do not resolve, for reports rather than errors."""
    parts = [feed[c].select(key(f).alias(f)).filter(f"{f} is not null").join(feed[p].select(key(f).alias(f)).distinct(), f, "left_anti").agg(F.count("*").alias("missing")).select(F.lit(c).alias("src"), F.lit(f).alias("field"), "missing") for c, f, p in FOREIGN_KEYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
