"""Terminals of the feed grammar as column expressions: trimming, numbers, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a value; none lies beyond U+3000.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
DECIMAL_PATTERN = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DIGITS_PATTERN = r"[0-9]+"
DAY_PATTERN = r"[0-9]{8}"


def strip(col: Column | str) -> Column:
    """The value without surrounding white space of any kind; null stays null."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def key(col: Column | str) -> Column:
    """A stripped key; blank becomes null."""
    return F.nullif(strip(col), F.lit(""))


def decimal_between(col: Column, low: float, high: float) -> Column:
    """The number written in ``col`` if it is a plain decimal number in [low, high], else null."""
    number = F.regexp_substr(strip(col), F.lit(f"^{DECIMAL_PATTERN}$")).try_cast("double")
    return F.when(number.between(low, high), number)


def digits_only(col: Column) -> Column:
    """True if the stripped value is ASCII digits only; null and blank give false."""
    return F.coalesce(strip(col).rlike(f"^{DIGITS_PATTERN}$"), F.lit(False))


def real_day(col: Column) -> Column:
    """The day number since 1970-01-01 of a yyyyMMdd value that names a real day, else null."""
    digits = F.regexp_substr(strip(col), F.lit(f"^(?!0000){DAY_PATTERN}$"))
    return F.unix_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def day_text(day_number: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day_number), "yyyyMMdd")
