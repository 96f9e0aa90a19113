"""The second rule set: stop complexes, waits per direction, branch waits, published transfers, rivers, k-nearest access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.functions.geo import planar, segments_cross
from isotrek.functions.numbers import round_half_even
from isotrek.functions.text import display_name, normalise_name
from isotrek.functions.values import key
from isotrek.operators.numbering import dense_index
from isotrek.operators.proximity import near_join
from isotrek.operators.streets import components

GROUP_RADIUS_M, INTER_COMPLEX_M = 350.0, 450.0
MIN_WAIT, MAX_WAIT, DEFAULT_WAIT = 1.0, 15.0, 5.0
BRANCH_SHARE, LEAST_EXTRA = 0.9, 0.1
TRANSFER_WALK_MIN, WALK_M_PER_MIN = 2.0, 75.0
TIME_CAP, BRIDGE_LIMIT_M = 180.0, 3000.0


def stop_complexes(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (stop_id, complex_id), complexes (complex_id, name, lat, lon)): stops of one normalised name joined by single links within 350 m.

    stops (stop_id, name, lat, lon). A complex is named by its smallest stop; its position is the mean
    of its stops, its display name the commonest spelling (the smallest of equally common ones). Names
    become components of a link graph, so no name is ever gathered in one task.
    """
    named = stops.select("stop_id", "name", "lat", "lon", normalise_name(F.col("name")).alias("norm")).groupBy("stop_id").agg(F.min(F.struct("lat", "lon", "name", "norm")).alias("s")).select("stop_id", "s.name", "s.lat", "s.lon", "s.norm")
    numbered = dense_index(named, ["stop_id"], "n")
    points = numbered.select(F.struct("norm", "n").alias("key"), "lat", "lon")
    links = near_join(points, points, GROUP_RADIUS_M, "key_a.norm = key_b.norm and key_a.n <= key_b.n").select(F.col("key_a.n").alias("a"), F.col("key_b.n").alias("b"))
    members = numbered.join(components(links), F.col("n") == F.col("node"), "left").withColumn("first", F.coalesce("component", "n"))
    heads = numbered.select(F.col("n").alias("first"), F.col("stop_id").alias("complex_id"))
    members = members.join(heads, "first")
    spelling = members.groupBy("complex_id", "name").agg(F.count("*").alias("k"))
    common = spelling.groupBy("complex_id").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col("name").alias("name"))).alias("s"))
    centres = members.groupBy("complex_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return members.select("stop_id", "complex_id"), common.join(centres, "complex_id").select("complex_id", display_name(F.col("s.name")).alias("name"), "lat", "lon")


def fixed_trips(trips: DataFrame) -> DataFrame:
    """Trips that run by fixed times: demand-responsive ones, which have a non-blank TAD, are dropped."""
    return trips.filter(key("TAD").isNull()) if "TAD" in trips.columns else trips


def translated_stops(stops: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """Stops under the names of a language; a name without a translation stays, the last one in file order (row_no) of several counts."""
    of = (F.col("table_name") == "stops") & (F.col("field_name") == "stop_name") & (F.col("language") == language) & (F.col("field_value") != "")
    names = translations.filter(of).groupBy(F.col("field_value").alias("stop_name")).agg(F.max_by(F.struct("translation"), "row_no").alias("t"))
    return stops.join(names, "stop_name", "left").withColumn("stop_name", F.coalesce("t.translation", "stop_name")).select(stops.columns)


def half_headway(window_minutes: float, departures: Column) -> Column:
    return F.least(F.lit(MAX_WAIT), F.greatest(F.lit(MIN_WAIT), F.lit(float(window_minutes)) / departures / 2))


def complex_hops(stop_times: DataFrame, members: DataFrame) -> DataFrame:
    """(trip, route_id, direction, before, a, b, dep, arr): hops between different complexes, with the complex ridden from before.

    stop_times (trip, route_id, direction, seq, stop_id, arr, dep). Rows without an arrival are removed
    before pairing; hops inside a complex collapse and do not become ``before``.
    """
    placed = stop_times.filter("arr is not null").join(members, "stop_id")
    along = Window.partitionBy("trip").orderBy("seq", "stop_id", "arr", "dep")
    paired = placed.select("trip", "route_id", "direction", "seq", "stop_id", F.col("complex_id").alias("a"), "dep", F.lead("complex_id").over(along).alias("b"), F.lead("arr").over(along).alias("next_arr"), F.row_number().over(along).alias("pos"))
    real = paired.filter("b is not null and a <> b")
    back = Window.partitionBy("trip").orderBy("pos")
    return real.select("trip", "route_id", "direction", F.lag("a").over(back).alias("before"), "a", "b", "dep", F.col("next_arr").alias("arr"))


def direction_waits(hops: DataFrame, window_minutes: float) -> DataFrame:
    """(complex_id, route_id, wait): half headway of the mean departures per direction, clamped, rounded to 2."""
    per_direction = hops.groupBy(F.col("a").alias("complex_id"), "route_id", "direction").agg(F.count("*").alias("n"))
    return per_direction.groupBy("complex_id", "route_id").agg(F.avg("n").alias("mean")).select("complex_id", "route_id", round_half_even(half_headway(window_minutes, F.col("mean")), 2).alias("wait"))


def route_waits(served: DataFrame, waits: DataFrame) -> DataFrame:
    """served (complex_id, route_id, ..) with the wait there; where a route is served but never boarded in the window, the default."""
    return served.join(waits, ["complex_id", "route_id"], "left").withColumn("wait", F.coalesce("wait", F.lit(DEFAULT_WAIT)))


def branch_waits(all_hops: DataFrame, in_window: DataFrame, window_minutes: float) -> DataFrame:
    """(a, b, route_id, minutes, extra): median ride, and the extra wait where a line splits.

    Onward departures of a towards b are those to complexes that b's riders did not come from; if b gets
    under 90 % of them, the difference of the half headways is added if it is at least 0.1.
    """
    towards = in_window.groupBy("a", "route_id", "b").agg(F.count("*").alias("n"), F.median(F.greatest(F.lit(0), F.col("arr") - F.col("dep")) / 60.0).alias("ride"))
    came = all_hops.filter("before is not null").select("a", "b", "route_id", F.col("before").alias("other")).distinct()
    others = towards.select("a", "route_id", F.col("b").alias("other"), F.col("n").alias("m"))
    onward = towards.join(others, ["a", "route_id"]).join(came, ["a", "b", "route_id", "other"], "left_anti").groupBy("a", "b", "route_id").agg(F.sum("m").alias("onward"))
    joined = towards.join(onward, ["a", "b", "route_id"], "left").withColumn("onward", F.coalesce("onward", F.lit(0)))
    gain = half_headway(window_minutes, F.col("n")) - half_headway(window_minutes, F.nullif(F.col("onward"), F.lit(0)))
    extra = F.when(F.col("n") >= BRANCH_SHARE * F.col("onward"), 0.0).when(gain >= LEAST_EXTRA, round_half_even(gain, 2)).otherwise(0.0)
    return joined.select("a", "b", "route_id", F.greatest(F.lit(0.4), F.col("ride")).alias("minutes"), F.coalesce(extra, F.lit(0.0)).alias("extra"))


def published_transfers(transfers: DataFrame, stop_routes: DataFrame, members: DataFrame) -> DataFrame:
    """(complex_a, route_a, complex_b, route_b, minutes): median published time per pair of station and line, rounded to 2; type 3 and blank times do not count."""
    timed = transfers.filter("min_transfer_time is not null and trim(min_transfer_time) <> '' and coalesce(transfer_type, '') <> '3'").select("from_stop_id", "to_stop_id", (F.col("min_transfer_time").cast("int") / 60.0).alias("m"))
    side = lambda x, c: stop_routes.join(members, "stop_id").select(F.col("stop_id").alias(c), F.col("route_id").alias(f"route_{x}"), F.col("complex_id").alias(f"complex_{x}"))
    pairs = timed.join(side("a", "from_stop_id"), "from_stop_id").join(side("b", "to_stop_id"), "to_stop_id").filter("route_a <> route_b")
    return pairs.groupBy("complex_a", "route_a", "complex_b", "route_b").agg(round_half_even(F.median("m"), 2).alias("minutes"))


def transfer_edges(states: DataFrame, near: DataFrame, published: DataFrame) -> DataFrame:
    """(src, dst, weight): changes between route states (state, complex_id, route_id, wait, access) inside a station and to stations nearby (a, b, metres).

    Cost: the published time if there is one, else the walk plus half of both platform accesses; then the
    wait for the next line.
    """
    walks = near.filter("a <> b").select("a", "b", (F.col("metres") / WALK_M_PER_MIN + TRANSFER_WALK_MIN).alias("walk"))
    here = states.select(F.col("complex_id").alias("a"), F.col("complex_id").alias("b"), F.lit(TRANSFER_WALK_MIN).alias("walk")).distinct()
    side = lambda x, c: states.select(F.col("state").alias(x), F.col("complex_id").alias(c), F.col("route_id").alias(f"route_{c}"), F.col("wait").alias(f"wait_{c}"), F.col("access").alias(f"access_{c}"))
    pairs = walks.unionByName(here).join(side("src", "a"), "a").join(side("dst", "b"), "b").filter("route_a <> route_b")
    known = published.select(F.col("complex_a").alias("a"), "route_a", F.col("complex_b").alias("b"), "route_b", F.col("minutes").alias("published"))
    joined = pairs.join(known, ["a", "route_a", "b", "route_b"], "left")
    weight = F.coalesce("published", F.col("walk") + (F.col("access_a") + F.col("access_b")) / 2) + F.col("wait_b")
    return joined.select("src", "dst", round_half_even(weight, 2).alias("weight"))


def route_graph(rides: DataFrame, states: DataFrame, near: DataFrame, published: DataFrame) -> DataFrame:
    """(src, dst, weight, extra_wait): ride edges with their branch wait, and all transfers."""
    at = lambda c: states.select(F.col("complex_id").alias(c), "route_id", F.col("state").alias(f"s_{c}"))
    ride = rides.join(at("a"), ["a", "route_id"]).join(at("b"), ["b", "route_id"]).select(F.col("s_a").alias("src"), F.col("s_b").alias("dst"), round_half_even(F.col("minutes") + F.col("extra"), 2).alias("weight"), F.col("extra").alias("extra_wait"))
    return ride.unionByName(transfer_edges(states, near, published).withColumn("extra_wait", F.lit(0.0)))


def crossing_rivers(walks: DataFrame, rivers: DataFrame, bucket_m: float = 500.0) -> DataFrame:
    """(walk): walks (walk, ax, ay, bx, by, planar metres) that strictly cross a river segment (x1, y1, x2, y2).

    Both are spread over the square buckets their boxes touch and meet only there.
    """
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / bucket_m), F.floor(F.greatest(a, b) / bucket_m))
    spread = lambda df, a, b, c, d: df.withColumn("bx_", F.explode(span(F.col(a), F.col(c)))).withColumn("by_", F.explode(span(F.col(b), F.col(d))))
    met = spread(walks, "ax", "ay", "bx", "by").join(spread(rivers, "x1", "y1", "x2", "y2"), ["bx_", "by_"])
    crosses = segments_cross(*(F.col(c) for c in ("ax", "ay", "bx", "by", "x1", "y1", "x2", "y2")))
    return met.filter(crosses).select("walk").distinct()


def river_walks(walks: DataFrame, rivers: DataFrame, bridges: DataFrame, limit_m: float = BRIDGE_LIMIT_M) -> DataFrame:
    """(walk, metres): straight metres, or over the best bridge (x, y) if a river lies between; neither leg may cross; no row if there is no way within the limit."""
    straight = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    cut_off = crossing_rivers(walks, rivers)
    free = walks.join(cut_off, "walk", "left_anti").select("walk", straight.alias("metres"))
    cell = lambda c: F.floor(F.col(c) / limit_m)
    around = walks.join(cut_off, "walk", "left_semi").withColumn("cx", F.explode(F.sequence(cell("ax") - 1, cell("ax") + 1))).withColumn("cy", F.explode(F.sequence(cell("ay") - 1, cell("ay") + 1)))
    near = around.join(bridges.withColumn("cx", cell("x")).withColumn("cy", cell("y")), ["cx", "cy"])
    leg = lambda p, q: F.sqrt(F.pow(F.col("x") - F.col(p), 2) + F.pow(F.col("y") - F.col(q), 2))
    over = near.withColumn("metres", leg("ax", "ay") + leg("bx", "by")).filter(F.col("metres") <= limit_m).withColumn("option", F.struct("walk", "x", "y"))
    first = over.select(F.struct("option", F.lit(1).alias("leg")).alias("walk"), "ax", "ay", F.col("x").alias("bx"), F.col("y").alias("by"))
    second = over.select(F.struct("option", F.lit(2).alias("leg")).alias("walk"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    blocked = crossing_rivers(first.unionByName(second), rivers).select(F.col("walk.option").alias("option")).distinct()
    detour = over.join(blocked, "option", "left_anti").groupBy("walk").agg(F.min("metres").alias("metres"))
    return free.unionByName(detour)


def bridges_over_rivers(bridges: DataFrame, rivers: DataFrame, bucket_m: float = 40.0) -> DataFrame:
    """(x, y): middles of the bridges (walk, ax, ay, bx, by) that cross a river, the first by number in each 40 m bucket."""
    crossing = bridges.join(crossing_rivers(bridges, rivers), "walk", "left_semi").withColumn("x", (F.col("ax") + F.col("bx")) / 2).withColumn("y", (F.col("ay") + F.col("by")) / 2)
    bucket = [F.floor(F.col(c) / bucket_m).alias(f"b{c}") for c in ("x", "y")]
    return crossing.groupBy(*bucket).agg(F.min(F.struct("walk", "x", "y")).alias("f")).select("f.x", "f.y")


def on_foot(pairs: DataFrame, rivers: DataFrame | None, bridges: DataFrame | None, origin: tuple[float, float]) -> DataFrame:
    """(walk, metres) of pairs (walk, lat_a, lon_a, lat_b, lon_b, metres): river_walks planar about ``origin``, or as they are without rivers."""
    if (rivers is None) != (bridges is None):
        raise ValueError("rivers and bridges belong together")
    if rivers is None:
        return pairs.select("walk", "metres")
    (ax, ay), (bx, by) = (planar(F.col(f"lat_{s}"), F.col(f"lon_{s}"), *origin) for s in "ab")
    return river_walks(pairs.select("walk", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")), rivers, bridges)


def near_complexes(complexes: DataFrame, rivers: DataFrame | None = None, bridges: DataFrame | None = None, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(a, b, metres): different complexes (complex_id, name, lat, lon) at most 450 m apart on foot, around rivers as for cell_access; what transfer_edges takes."""
    points = complexes.select(F.col("complex_id").alias("key"), "lat", "lon")
    pairs = near_join(points, points, INTER_COMPLEX_M, "key_a <> key_b").withColumn("walk", F.struct("key_a", "key_b"))
    return on_foot(pairs, rivers, bridges, origin).filter(F.col("metres") <= INTER_COMPLEX_M).select(F.col("walk.key_a").alias("a"), F.col("walk.key_b").alias("b"), "metres")


def cell_access(cells: DataFrame, stations: DataFrame, rail: DataFrame, radius_m: float, any_kind: int = 5, of_rail: int = 3, rivers: DataFrame | None = None, bridges: DataFrame | None = None, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(cell, station, metres): the nearest stations of any kind and the nearest rail stations of each land cell; one row a station.

    With rivers and bridges (as for river_walks, planar about ``origin``) every station within the radius
    is ranked by its walk around them, and those without a walk do not count.
    """
    kinds = [near_join(cells, df, radius_m).withColumn("k", F.lit(k)).withColumn("kind", F.lit(i)) for i, (df, k) in enumerate(((stations, any_kind), (rail, of_rail)))]
    pairs = kinds[0].unionByName(kinds[1]).withColumn("walk", F.struct("kind", "k", "key_a", "key_b", "lat_a", "lon_a", "lat_b", "lon_b"))
    best = on_foot(pairs, rivers, bridges, origin).groupBy(*(F.col(f"walk.{c}") for c in ("kind", "k", "key_a", "key_b"))).agg(F.min("metres").alias("metres"))
    nearest = best.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "key_a").orderBy("metres", "key_b"))).filter("rank <= k")
    return nearest.groupBy(F.col("key_a").alias("cell"), F.col("key_b").alias("station")).agg(F.min("metres").alias("metres"))


def capped_times(access: DataFrame, station_minutes: DataFrame) -> DataFrame:
    """(cell, minutes float): least of station time and walk, capped; cells that reach nothing take the cap."""
    timed = access.join(station_minutes, "station", "left").groupBy("cell").agg(F.min(F.col("minutes") + F.col("metres") / WALK_M_PER_MIN).alias("m"))
    return timed.select("cell", F.least(F.coalesce("m", F.lit(TIME_CAP)), F.lit(TIME_CAP)).cast("float").alias("minutes"))


def merge_feeds(main: DataFrame, extra: DataFrame, slug: str, id_columns: list[str]) -> DataFrame:
    """The extra feed's rows under the main feed's columns, ids prefixed with the slug; columns it lacks are null, others are dropped."""
    aligned = [(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{slug}:"), c)) if c in id_columns else F.col(c)).alias(c) if c in extra.columns else F.lit(None).cast("string").alias(c) for c in main.columns]
    return main.unionByName(extra.select(*aligned))


def open_routes(routes: DataFrame, types: list[str] = (), names: list[str] = (), ids: list[str] = (), agencies: list[str] = ()) -> DataFrame:
    """Routes that are open to the public: no school types 712 and 713, none that the configuration excludes."""
    shut = F.coalesce(F.col("route_type").isin("712", "713", *types), F.lit(False)) | F.coalesce(F.col("route_short_name").isin(*names) if names else F.lit(False), F.lit(False)) | F.coalesce(F.col("route_id").isin(*ids) if ids else F.lit(False), F.lit(False))
    if agencies:
        shut = shut | ~F.coalesce(F.col("agency_id").isin(*agencies), F.lit(False))
    return routes.filter(~shut)


def trips_inside(stop_times: DataFrame, inside: DataFrame, trip: str = "trip_id") -> DataFrame:
    """Rows at stops inside (stop_id), of trips that keep at least two of them; what is left pairs up."""
    kept = stop_times.join(inside, "stop_id", "left_semi")
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(trip))).filter("_n >= 2").drop("_n")


def line_stats(states: DataFrame) -> DataFrame:
    """(route_id, stations, headway): stations of each line among route states (complex_id, route_id, wait), and twice the median wait, rounded to 1."""
    return states.groupBy("route_id").agg(F.count("*").alias("stations"), round_half_even(F.median("wait") * 2, 1).alias("headway"))


def network_stats(states: DataFrame, times: DataFrame) -> DataFrame:
    """(stations, within_15, within_30, farthest, near_20, lines), one row: whole percents of rail stations (station, name, minutes) reached, the farthest and the one closest to 20 minutes, and line_stats of the rail states."""
    n = times.agg(
        F.count("*").alias("stations"), F.floor(100 * F.count_if(F.col("minutes") <= 15) / F.count("*") + 0.5).cast("int").alias("within_15"),
        F.floor(100 * F.count_if(F.col("minutes") <= 30) / F.count("*") + 0.5).cast("int").alias("within_30"),
        F.max_by("name", F.struct("minutes", "name")).alias("farthest"), F.min_by("name", F.struct(F.abs(F.col("minutes") - 20), F.col("name"))).alias("near_20"),
    )
    lines = line_stats(states).agg(F.array_sort(F.collect_list(F.struct("route_id", "stations", "headway"))).alias("lines"))
    return n.crossJoin(lines)


def trip_sanity(pairs: DataFrame) -> DataFrame:
    """(from_id, to_id, kmh, flag): door-to-door speed of probe trips (from_id, to_id, metres, minutes): 'unreachable', 'slow' under 8 km/h beyond 2 km, 'fast' over 35 km/h, else 'ok'."""
    kmh = F.col("metres") / 1000 / (F.nullif(F.col("minutes"), F.lit(0.0)) / 60)
    flag = F.when(F.col("minutes").isNull(), "unreachable").when((kmh < 8) & (F.col("metres") > 2000), "slow").when(kmh > 35, "fast").otherwise("ok")
    return pairs.select("from_id", "to_id", kmh.alias("kmh"), flag.alias("flag"))
