"""Numbers: rounding as the goldens have it, weighted median, and minutes for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column, digits: int) -> Column:
    """Round the exact binary value half to even, as decimal arithmetic on its full expansion does.

    A double's exact expansion has too many digits for decimal(38), so the decision is taken on the
    scaled value: only a value that is exactly half between two results is a tie, and then the even
    neighbour is taken. Null and NaN stay what they are.
    """
    scale = F.lit(float(10**digits))
    near = F.rint(col * scale) / scale
    up, down = (F.rint(col * scale) + 1) / scale, (F.rint(col * scale) - 1) / scale
    best = F.when(F.abs(col - up) < F.abs(col - near), up).when(F.abs(col - down) < F.abs(col - near), down).otherwise(near)
    return F.when(F.abs(col) >= 1e15, col).otherwise(best)


def round_decimal(col: Column, digits: int) -> Column:
    """Round through decimal(28,12), half up: the rule that SQL engines agree on."""
    return F.round(col.cast("decimal(28,12)"), digits).cast("double")


def display_minutes(col: Column) -> Column:
    """Whole minutes for people: positive values never show 0, halves go up."""
    return F.when(col > 0, F.greatest(F.lit(1), F.floor(col + 0.5))).otherwise(F.floor(col + 0.5)).cast("int")


def display_duration(col: Column) -> Column:
    """'< 1 min', '12 min', '1 h 05'; null stays null."""
    whole = F.floor(col + 0.5).cast("int")
    hours = F.format_string("%d h %02d", F.floor(whole / 60).cast("int"), F.pmod(whole, F.lit(60)))
    return F.when(col.isNull(), None).when(col < 1, "< 1 min").when(whole < 60, F.concat(whole.cast("string"), F.lit(" min"))).otherwise(hours)


def thousands(col: Column, sign: str = "\u202f") -> Column:
    return F.replace(F.format_number(col.cast("long"), 0), F.lit(","), F.lit(sign))


def decimal_comma(col: Column) -> Column:
    """Shortest text of a number with a decimal comma, no trailing '.0'."""
    text = F.regexp_replace(col.cast("double").cast("string"), r"\.0$", "")
    return F.replace(text, F.lit("."), F.lit(","))
