"""Share links: query strings to checked states and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST, LEAST_MINUTES, MOST_MINUTES = 2048, 5, 120


def parameters(query: Column) -> Column:
    """map<string,string> of a query string, percent escapes decoded, the first of equal names; over-long ones have none."""
    text = F.regexp_replace(query, r"^[^?]*\?|^\?", "")
    pairs = F.filter(F.split(text, "&"), lambda p: F.contains(p, F.lit("=")))
    decoded = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("k"), F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.lit("")).alias("v")))
    firsts = F.filter(decoded, lambda p, i: (i == 0) | ~F.exists(F.slice(decoded, F.lit(1), F.greatest(i, F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(F.length(query) <= LONGEST, F.map_from_entries(firsts)).otherwise(F.map_from_entries(F.filter(firsts, lambda p: F.lit(False))))


def coordinates(text: Column, west: float, south: float, east: float, north: float) -> Column:
    """struct<lat,lon> of 'lat,lon' inside the box, else null."""
    ok = text.rlike(r"^-?\d+(\.\d+)?,-?\d+(\.\d+)?$")
    part = lambda i: F.when(ok, F.get(F.split(text, ","), F.lit(i)).try_cast("double"))
    lat, lon = part(0), part(1)
    return F.when(lat.between(south, north) & lon.between(west, east), F.struct(lat.alias("lat"), lon.alias("lon")))


def minutes_list(text: Column) -> Column:
    """Distinct whole minutes of a comma list, clamped to 5..120, sorted; what is no number is left out."""
    numbers = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    clamped = F.transform(numbers, lambda x: F.least(F.lit(MOST_MINUTES), F.greatest(F.lit(LEAST_MINUTES), F.floor(x + 0.5).cast("int"))))
    return F.array_sort(F.array_distinct(clamped))


def parse_state(query: Column, city: str, modes: list[str], box: tuple[float, float, float, float]) -> Column:
    """struct of the state a link asks for, and ``ignored``: the parameters that were not usable, in a fixed order.

    A link of another city drops its locations; unknown modes are left out; the direction is 'from' or 'to'.
    """
    p = parameters(query)
    at = lambda k: F.try_element_at(p, F.lit(k))
    own = F.coalesce(at("city") == city, F.lit(True))
    origin, destination = (F.when(own, coordinates(at(k), *box)) for k in ("o", "d"))
    direction = F.when(at("dir").isin("from", "to"), at("dir"))
    wanted = F.split(at("modes"), ",")
    known = F.array(*(F.lit(m) for m in modes)) if modes else F.array().cast("array<string>")
    chosen = F.when(at("modes").isNotNull(), F.array_sort(F.array_intersect(wanted, known)))
    scale = at("max").try_cast("double")
    clamped = F.least(F.lit(MOST_MINUTES), F.greatest(F.lit(LEAST_MINUTES), F.floor(scale + 0.5).cast("int")))
    bad = [
        F.when(at("city").isNotNull() & ~own, F.lit("city")), F.when(at("o").isNotNull() & origin.isNull(), F.lit("o")),
        F.when(at("d").isNotNull() & destination.isNull(), F.lit("d")), F.when(at("dir").isNotNull() & direction.isNull(), F.lit("dir")),
        F.when(F.exists(F.array_except(wanted, known), lambda m: m != ""), F.lit("modes")), F.when(at("max").isNotNull() & scale.isNull(), F.lit("max")),
    ]
    return F.struct(
        origin.alias("origin"), destination.alias("destination"), F.coalesce(direction, F.lit("from")).alias("direction"), chosen.alias("modes"),
        clamped.alias("max_minutes"), F.when(at("iso").isNotNull(), minutes_list(at("iso"))).alias("isochrones"),
        F.filter(F.array(*bad), lambda b: b.isNotNull()).alias("ignored"),
    )


def serialise_state(city: Column, state: Column) -> Column:
    """The query string of a state; what is null is left out."""
    place = lambda c: F.when(c.isNotNull(), F.concat_ws(",", F.format_string("%.5f", c["lat"]), F.format_string("%.5f", c["lon"])))
    parts = {
        "city": city, "o": place(state["origin"]), "d": place(state["destination"]), "dir": state["direction"], "modes": F.array_join(state["modes"], ","),
        "max": state["max_minutes"].cast("string"), "iso": F.array_join(F.transform(state["isochrones"], lambda x: x.cast("string")), ","),
    }
    named = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v)) for k, v in parts.items()]
    return F.array_join(F.filter(F.array(*named), lambda x: x.isNotNull()), "&")


def parse_reach_link(query: Column, choices: tuple[int, ...] = (15, 30, 45, 60), default_minutes: int = 60) -> Column:
    """struct of a link of the second rule set: from, to, arrival, bus, max_minutes, isochrones.

    Places are 'lat,lon' without a box; the map runs towards the destination only if there is one; a scale
    outside 20..90 is not taken; isochrones other than the ``choices`` are left out, null if not given.
    """
    p = parameters(query)
    at = lambda k: F.try_element_at(p, F.lit(k))
    place = lambda k: coordinates(at(k), float("-inf"), float("-inf"), float("inf"), float("inf"))
    scale = at("max").try_cast("double")
    wanted = F.transform(F.split(at("iso"), ","), lambda x: F.trim(x).try_cast("int"))
    return F.struct(
        place("from").alias("from"), place("to").alias("to"), (place("to").isNotNull() & F.coalesce(at("carte") == "arrivee", F.lit(False))).alias("arrival"),
        F.coalesce(at("bus") == "1", F.lit(False)).alias("bus"), F.when(scale.between(20, 90), scale.cast("int")).otherwise(default_minutes).alias("max_minutes"),
        F.array_sort(F.array_intersect(wanted, F.array(*(F.lit(c) for c in choices)))).alias("isochrones"),
    )


def serialise_reach(state: Column, default_minutes: int = 60, default_isochrones: tuple[int, ...] = (15, 30)) -> Column:
    """The query string of a state of the second rule set; defaults are left out, no isochrone is written 0."""
    place = lambda c: F.when(c.isNotNull(), F.concat_ws(",", F.format_string("%.5f", c["lat"]), F.format_string("%.5f", c["lon"])))
    rings = F.array_join(F.array_sort(state["isochrones"]), ",")
    parts = {
        "from": place(state["from"]), "to": place(state["to"]), "carte": F.when(state["arrival"], "arrivee"), "bus": F.when(state["bus"], "1"),
        "max": F.when(state["max_minutes"] != default_minutes, state["max_minutes"].cast("string")),
        "iso": F.when(rings != ",".join(map(str, default_isochrones)), F.when(rings == "", "0").otherwise(rings)),
    }
    return F.array_join(F.filter(F.array(*(F.concat(F.lit(f"{k}="), v) for k, v in parts.items())), lambda x: x.isNotNull()), "&")
