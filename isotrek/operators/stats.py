"""Statistics of a city network: headways, reach shares, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.functions.geo import inside_polygons
from isotrek.functions.numbers import round_half_even


def line_headways(waits: DataFrame, line: str = "line_ix", headway: str = "headway") -> DataFrame:
    """(line, median_min): exact median of a line's headways over its stops, rounded to 1."""
    return waits.groupBy(line).agg(round_half_even(F.median(headway), 1).alias("median_min"))


def weighted_median(df: DataFrame, value: str, weight: str, keys: list[str] = ()) -> DataFrame:
    """(keys.., value): the value at which half of the weight is reached; the middle to the next one if exactly half is reached there.

    Rows of equal value are combined before they are ordered, so a group costs its distinct values.
    Rows with a null or without weight do not count; a group without rows gives none.
    """
    keys = list(keys)
    distinct = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(value).alias("value")).agg(F.sum(weight).alias("w"))
    along, whole = Window.partitionBy(*keys).orderBy("value"), Window.partitionBy(*keys)
    ranked = distinct.withColumn("seen", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("value").over(along)).withColumn("half", F.sum("w").over(whole) / 2)
    exact = F.abs(F.col("seen") - F.col("half")) <= 1e-9 * F.greatest(F.abs("seen"), F.abs("half"))
    at = F.when(exact & F.col("next").isNotNull(), (F.col("value") + F.col("next")) / 2).when(F.col("seen") > F.col("half"), F.col("value")).when(F.col("next").isNull(), F.col("value"))
    picked = ranked.withColumn("at", at).filter("at is not null")
    return picked.groupBy(*keys).agg(F.min_by("at", "value").alias(value)).filter(F.col(value).isNotNull())


def headway_summary(medians: DataFrame) -> DataFrame:
    """(typical_min, best_min), one row, from (line, median_min): median weighted by departures (1/median), and the smallest rounded median; nulls if there is no line."""
    weighted = medians.withColumn("w", F.when(F.col("median_min") > 0, 1 / F.col("median_min")))
    typical = weighted_median(weighted, "median_min", "w").select(round_half_even(F.col("median_min"), 1).alias("typical_min"))
    best = medians.agg(F.min("median_min").alias("best_min"))
    return best.join(typical, F.lit(True), "left").select("typical_min", "best_min")


def reach_share(times: DataFrame, points: DataFrame, origins: DataFrame, threshold: float) -> DataFrame:
    """(percent_stops, origins), one row: percent of points reached in time, averaged over the origins, rounded to 1.

    times (origin, point, minutes) has reached points only, so counting its hits per origin is enough.
    """
    n = points.select("point").distinct().agg(F.count("*").alias("n"))
    hits = times.filter(F.col("minutes") <= threshold).join(points.select("point").distinct(), "point", "left_semi").groupBy("origin").agg(F.count("*").alias("hits"))
    per_origin = origins.select("origin").distinct().join(hits, "origin", "left").crossJoin(n)
    return per_origin.agg(round_half_even(F.avg(100.0 * F.coalesce("hits", F.lit(0)) / F.col("n")), 1).alias("percent_stops"), F.count("*").alias("origins"))


def inside_boundary(points: DataFrame, polygons: Column | None) -> DataFrame:
    """The points inside the boundary, or all if there is none."""
    return points if polygons is None else points.filter(inside_polygons(polygons, F.col("lat"), F.col("lon")))


def scope(has_streets: bool, has_boundary: bool) -> str:
    return "streets" if has_streets else "boundary" if has_boundary else "served"


def city_stats(waits: DataFrame, lines: DataFrame, stops: DataFrame, share: DataFrame, threshold: float, scope_name: str, node_share: DataFrame | None = None) -> DataFrame:
    """One row of nested statistics: counts, reach (with percent_nodes if the share of street nodes is given), headway with the list by line."""
    medians = line_headways(waits)
    by_line = medians.join(lines.select("line_ix", "line_id"), "line_ix").agg(F.array_sort(F.collect_list(F.struct("line_ix", "line_id", "median_min"))).alias("by_line"))
    counts = stops.agg(F.count("*").alias("stops")).crossJoin(lines.agg(F.count("*").alias("lines")))
    nodes = [] if node_share is None else ["percent_nodes"]
    share = share if node_share is None else share.crossJoin(node_share.select(F.col("percent_stops").alias("percent_nodes")))
    together = counts.crossJoin(share).crossJoin(headway_summary(medians)).crossJoin(by_line)
    return together.select(
        "stops", "lines",
        F.struct(F.lit(threshold).alias("threshold_min"), "origins", F.lit(scope_name).alias("scope"), "percent_stops", *nodes).alias("reach"),
        F.struct("typical_min", "best_min", F.transform("by_line", lambda x: F.struct(x["line_id"].alias("id"), x["median_min"].alias("median_min"))).alias("by_line")).alias("headway"),
    )


def usable(stats: DataFrame) -> DataFrame:
    """Only statistics with all the figures a page shows."""
    return stats.filter("stops > 0 and lines > 0 and reach.percent_stops is not null and headway.typical_min is not null")
