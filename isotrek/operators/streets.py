"""The pedestrian street graph: segments of ways, splitting, largest component, contraction, Hilbert numbering, snapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotrek.functions.geo import METRES_PER_DEGREE, hilbert_key, simplify_indices
from isotrek.functions.numbers import round_half_even
from isotrek.operators.numbering import dense_index
from isotrek.operators.proximity import haversine_m, nearest
from isotrek.session import cut, ship

SPACING_M, SIMPLIFY_M, SCALE = 60.0, 2.5, 100_000


def segments(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(a, b, way, pos, cls, metres): undirected segments between consecutive nodes of ways, the first in way order of equal ones, none of a node with itself.

    nodes (node, lat, lon), ways (way, nodes array, cls); way numbers give the order.
    """
    steps = ways.select("way", "cls", F.posexplode("nodes").alias("pos", "u"), "nodes").withColumn("v", F.get("nodes", F.col("pos") + 1)).filter("v is not null and u <> v")
    keyed = steps.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.struct("way", "pos", "u", "v", "cls").alias("s"))
    firsts = keyed.groupBy("lo", "hi").agg(F.min("s").alias("s")).select("s.*")
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    placed = firsts.join(at("u"), "u").join(at("v"), "v")
    return placed.select(F.col("u").alias("a"), F.col("v").alias("b"), "way", "pos", "cls", F.col("lat_u").alias("lat_a"), F.col("lon_u").alias("lon_a"), F.col("lat_v").alias("lat_b"), F.col("lon_v").alias("lon_b"), haversine_m(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v")).alias("metres"))


def split_long(segs: DataFrame, spacing_m: float = SPACING_M) -> tuple[DataFrame, DataFrame]:
    """(inner nodes, links): segments longer than the spacing get evenly spaced inner nodes, numbered after all others in way order.

    Inner nodes (node, lat, lon), coordinates rounded to 5 decimals; links (a, b, metres, cls).
    """
    counted = segs.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("metres") / spacing_m)).cast("int"))
    top = segs.select(F.greatest(F.max("a"), F.max("b")).alias("top"))
    top = top.first()["top"]
    inner_steps = counted.filter("parts > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    numbered = dense_index(inner_steps, ["way", "pos", "k"], "number")
    along = lambda c: round_half_even(F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * F.col("k") / F.col("parts"), 5)
    node = F.lit((top if top is not None else -1) + 1) + F.col("number")
    inner = numbered.select(node.alias("node"), along("lat").alias("lat"), along("lon").alias("lon"))
    share = F.col("metres") / F.col("parts")
    starts = numbered.select(F.when(F.col("k") == 1, F.col("a")).otherwise(node - 1).alias("a"), node.alias("b"), share.alias("metres"), "cls")
    ends = numbered.filter("k = parts - 1").select(node.alias("a"), "b", share.alias("metres"), "cls")
    whole = counted.filter("parts = 1").select("a", "b", "metres", "cls")
    return inner, whole.unionByName(starts).unionByName(ends)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of undirected edges (a, b); a component is named by its smallest node.

    Labels spread to neighbours and jump to the label of their label, so rounds grow with the logarithm
    of the longest path rather than with its length. Each round is cut by a checkpoint.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = cut(both)
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        pulled = spread.groupBy(F.col("label").alias("new")).agg(F.min("new").alias("root_label")).select("new", "root_label")
        merged = spread.join(jump, "new", "left").join(pulled.withColumnRenamed("new", "label"), "label", "left")
        state = cut(merged.select("node", F.least("new", "further", "root_label").alias("new"), "label"))
        moved = state.filter("new < label").isEmpty()
        labels = state.select("node", F.col("new").alias("label"))
        if moved:
            return labels.withColumnRenamed("label", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """(node) of the component of most nodes, the one with the smallest node of equally large ones."""
    labels = components(edges)
    best = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("component")).limit(1)
    return labels.join(F.broadcast(best.select("component")), "component", "left_semi").select("node")


def junctions(links: DataFrame) -> DataFrame:
    """(node): where other than two links meet or their class changes, and the smallest node."""
    ends = links.select(F.col("a").alias("node"), "cls").union(links.select("b", "cls"))
    met = ends.groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct("cls").alias("classes")).filter("degree <> 2 or classes > 1").select("node")
    return met.union(ends.agg(F.min("node").alias("node")).filter("node is not null")).distinct()


def chain_heads(steps: DataFrame, stops: DataFrame) -> DataFrame:
    """(u, v, su, sv, hops): for each directed step (u, v) of a graph the first step (su, sv) of its chain and how many steps lie before it.

    A chain begins where a step leaves one of ``stops`` (node); everywhere else two links meet. Every step
    points to the one before it, and in each round to what that one points to, so the rounds grow with
    the logarithm of the longest chain. Steps of a ring without a stop belong to no chain and are left out.
    """
    at_stop = stops.select(F.col("node").alias("u"))
    before = steps.select(F.col("u").alias("su"), F.col("v").alias("sv"))
    heads = steps.join(at_stop, "u", "left_semi").select("u", "v", F.col("u").alias("su"), F.col("v").alias("sv"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("done"))
    inner = steps.join(at_stop, "u", "left_anti").join(before, (F.col("u") == F.col("sv")) & (F.col("v") != F.col("su")))
    state = cut(heads.unionByName(inner.select("u", "v", "su", "sv", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done"))))
    for _ in range(state.count().bit_length() + 1):
        waiting = state.filter("not done")
        if waiting.isEmpty():
            break
        target = state.select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("su").alias("nu"), F.col("sv").alias("nv"), F.col("hops").alias("more"), F.col("done").alias("there"))
        moved = waiting.join(target, ["su", "sv"]).select("u", "v", F.col("nu").alias("su"), F.col("nv").alias("sv"), (F.col("hops") + F.col("more")).alias("hops"), F.col("there").alias("done"))
        state = cut(state.filter("done").unionByName(moved))
    return state.filter("done").drop("done")


def _pieces(batches: Iterator[pd.DataFrame], spacing_m: float, simplify_m: float) -> Iterator[pd.DataFrame]:
    """The parts into which chains fall, each from its lower end to its higher one."""
    for batch in batches:
        out = []
        for su, sv, cls, chain in zip(batch["su"], batch["sv"], batch["cls"], batch["chain"]):
            node, lat, lon = ([p[c] for p in chain] for c in ("node", "lat", "lon"))
            cuts, lengths, run = [0], [], 0.0
            for i, step in enumerate(p["metres"] for p in chain[1:]):
                if i > cuts[-1] and run + step > spacing_m:
                    cuts.append(i)
                    lengths.append(run)
                    run = 0.0
                run += step
            cuts.append(len(node) - 1)
            lengths.append(run)
            for first, last, metres in zip(cuts, cuts[1:], lengths):
                if node[first] == node[last]:
                    continue
                along = range(first, last + 1) if node[first] < node[last] else range(last, first - 1, -1)
                y, x = (np.array([values[i] for i in along]) for values in (lat, lon))
                kept = simplify_indices(x * METRES_PER_DEGREE * np.cos(np.radians(y[0])), y * METRES_PER_DEGREE, simplify_m)[1:-1]
                shape = [{"lat": round(float(y[i]), 5), "lon": round(float(x[i]), 5)} for i in kept]
                out.append((node[along[0]], node[along[-1]], metres, su, sv, first, cls, shape))
        yield pd.DataFrame(out, columns=["a", "b", "exact", "su", "sv", "first", "cls", "shape"])


def contract(nodes: DataFrame, links: DataFrame, spacing_m: float = SPACING_M, simplify_m: float = SIMPLIFY_M) -> DataFrame:
    """(a, b, metres, cls, shape array<struct<lat,lon>>): chains between junctions as edges, with a node kept about every ``spacing_m``.

    A chain runs from the lower of its junctions, one that returns to its junction towards the lower
    neighbour; a node is kept before the step that would pass the spacing. Chains come together by
    pointer jumping and are cut each by itself; a chain is one stretch of road without a crossing. Of
    parallel edges the shortest stays (of equally long ones that of the lowest chain), loops vanish,
    metres are whole and at least 1, inner points are simplified and run from a to b, a < b.
    """
    ship(links.sparkSession)
    one_way = links.select(F.col("a").alias("u"), F.col("b").alias("v"), "metres", "cls")
    half = cut(one_way.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"), "metres", "cls")))
    heads = chain_heads(half.select("u", "v"), junctions(links))
    back = heads.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("su").alias("tu"), F.col("sv").alias("tv"))
    chosen = heads.join(back, ["u", "v"]).filter("su < tu or (su = tu and sv < tv)").select("u", "v", "su", "sv", "hops").join(half, ["u", "v"])
    place = lambda c: nodes.select(F.col("node").alias(c), "lat", "lon")
    stop = F.struct(F.col("hops") + 1, F.col("v").alias("node"), "lat", "lon", "metres")
    rest = chosen.join(place("v"), "v").groupBy("su", "sv").agg(F.min("cls").cast("int").alias("cls"), F.array_sort(F.collect_list(stop)).alias("rest"))
    whole = rest.join(place("su"), "su").select("su", "sv", "cls", F.concat(
        F.array(F.struct(F.col("su").alias("node"), "lat", "lon", F.lit(0.0).alias("metres"))),
        F.transform("rest", lambda p: F.struct(p["node"].alias("node"), p["lat"].alias("lat"), p["lon"].alias("lon"), p["metres"].alias("metres"))),
    ).alias("chain"))
    shape = "array<struct<lat:double,lon:double>>"
    pieces = whole.mapInPandas(lambda batches: _pieces(batches, spacing_m, simplify_m), f"a long, b long, exact double, su long, sv long, first int, cls int, shape {shape}")
    best = pieces.groupBy("a", "b").agg(F.min_by(F.struct("cls", "shape", "exact"), F.struct("exact", "su", "sv", "first")).alias("e"))
    return best.select("a", "b", F.greatest(F.lit(1), F.rint("e.exact").cast("int")).alias("metres"), "e.cls", "e.shape")


def hilbert_numbers(nodes: DataFrame) -> DataFrame:
    """(node, node_ix): nodes numbered along a Hilbert curve over their coordinates in 1e-5 degrees, ties by position."""
    cells = nodes.select("node", F.rint(F.col("lat") * SCALE).cast("long").alias("x"), F.rint(F.col("lon") * SCALE).cast("long").alias("y"))
    box = cells.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box is None or box[0] is None:
        return cells.select("node", F.lit(0).alias("node_ix"))
    bits = max(box[2] - box[0], box[3] - box[1], 1).bit_length()
    keyed = cells.withColumn("key", hilbert_key(F.col("x") - box[0], F.col("y") - box[1], bits))
    return dense_index(keyed, ["key", "x", "y", "node"], "node_ix").select("node", F.col("node_ix").cast("int").alias("node_ix"))


def build_street_graph(nodes: DataFrame, ways: DataFrame, spacing_m: float = SPACING_M, simplify_m: float = SIMPLIFY_M) -> tuple[DataFrame, DataFrame]:
    """(nodes (node_ix, lat, lon), edges (a, b, metres, cls, shape)) of the largest component, contracted and numbered along a Hilbert curve."""
    inner, links = split_long(segments(nodes, ways), spacing_m)
    everywhere = nodes.select("node", "lat", "lon").unionByName(inner)
    inside = largest_component(links)
    kept = cut(contract(everywhere, links.join(inside.select(F.col("node").alias("a")), "a", "left_semi"), spacing_m, simplify_m))
    used = kept.select(F.col("a").alias("node")).union(kept.select("b")).distinct()
    numbers = hilbert_numbers(everywhere.join(used, "node", "left_semi"))
    renamed = kept.join(numbers.select(F.col("node").alias("a"), F.col("node_ix").alias("ia")), "a").join(numbers.select(F.col("node").alias("b"), F.col("node_ix").alias("ib")), "b")
    edges = renamed.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "metres", "cls", F.when(F.col("ia") < F.col("ib"), F.col("shape")).otherwise(F.reverse("shape")).alias("shape"))
    return everywhere.join(numbers, "node").select("node_ix", "lat", "lon"), edges


def snap(points: DataFrame, nodes: DataFrame, max_snap_m: float) -> DataFrame:
    """(key, node_ix, snap_m): nearest street node within the limit, ties to the lower number; nulls if there is none."""
    found = nearest(points, nodes.select(F.col("node_ix").alias("key"), "lat", "lon"), max_snap_m)
    return found.select("key", F.col("nearest").alias("node_ix"), F.col("metres").alias("snap_m"))


def delta_encode(df: DataFrame, value: str, order: str, keys: list[str] = ()) -> DataFrame:
    """Differences to the value before, the first to 0."""
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    return df.withColumn(value, F.col(value) - F.coalesce(F.lag(value).over(along), F.lit(0)))


def delta_decode(df: DataFrame, value: str, order: str, keys: list[str] = ()) -> DataFrame:
    """Running sums of differences."""
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.sum(value).over(along))


def running_sum(values: Column) -> Column:
    """Running sums of an array."""
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(acc, -1), F.lit(0)) + x))
    return F.aggregate(values, F.array().cast("array<bigint>"), step)
