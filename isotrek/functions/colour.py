"""Colours of times: interpolation along a ramp, fading beyond the scale, street widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEYOND_FADE = 0.15


def ramp_colour(position: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """struct<r,g,b> on a ramp of (position, colour) stops; positions are clamped to 0..1, channels rounded half up."""
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), position))

    def channel(i: int) -> Column:
        value = F.lit(float(stops[-1][1][i]))
        for (p, a), (q, b) in reversed(list(zip(stops, stops[1:]))):
            value = F.when(at <= q, a[i] + (b[i] - a[i]) * (at - p) / (q - p)).otherwise(value)
        return F.floor(value + 0.5).cast("int")

    return F.struct(*(channel(i).alias(n) for i, n in enumerate("rgb")))


def heat_colour(minutes: Column, max_minutes: float, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """struct<r,g,b,a>: opaque up to the scale's end, fading out over 15 % beyond it, all zero where nothing is painted."""
    t = minutes / max_minutes
    alpha = F.when(t <= 1, 255).otherwise(F.floor(F.greatest(F.lit(0.0), 1 - (t - 1) / BEYOND_FADE) * 255 + 0.5)).cast("int")
    shown = F.coalesce(alpha > 0, F.lit(False)) & ~F.isnan(F.coalesce(minutes, F.lit(0.0)))
    colour = ramp_colour(t, stops)
    return F.struct(*(F.when(shown, colour[c]).otherwise(0).alias(c) for c in "rgb"), F.when(shown, alpha).otherwise(0).alias("a"))


def street_width(cls: Column, scale: Column, base: tuple[float, ...] = (0.6, 1.0, 1.6), low: float = 0.4, high: float = 6.0) -> Column:
    """Line width of a street by its class, growing with the map's scale, clamped."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.element_at(F.array(*(F.lit(b) for b in base)), cls.cast("int") + 1) * scale))
