"""Overlapping and gapped intervals per entity.

The aggregate is mergeable: its state is a sorted list of disjoint intervals, and states combine by a
linear merge (they are sorted runs, which the stable merge sort joins run by run). Each partition
reduces its rows to states, a salted round merges these per entity and salt, a last round, in the order
of entities, per entity. A state holds at most one interval for every second day between the first and
the last representable day, however many rows an entity has; the first two rounds hand on what they
hold when it grows large, so a task keeps no more than that and one entity's state.

All entities of a partition are merged together: days are moved by a large stride per entity, so that
intervals of different entities never touch, and one vectorised merge serves them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
STRIDE = 1 << 34  # days are 32-bit integers; between entities lies more than all of them
HELD_ROWS = 500_000  # rows that a task takes in before it merges them into its state
STATE = "entity string, kind string, first int, last int"
Lists = tuple[np.ndarray, np.ndarray]


def union(firsts: np.ndarray, lasts: np.ndarray) -> Lists:
    """Sorted disjoint intervals (inclusive integer ends, none adjacent) that cover what the given ones cover."""
    if not len(firsts):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    order = np.argsort(firsts, kind="stable")
    firsts, lasts = np.asarray(firsts, "int64")[order], np.maximum.accumulate(np.asarray(lasts, "int64")[order])
    starts = np.flatnonzero(np.r_[True, firsts[1:] > lasts[:-1] + 1])
    return firsts[starts], lasts[np.r_[starts[1:] - 1, len(lasts) - 1]]


def intersect(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> Lists:
    """What two sorted lists of disjoint intervals share, by one linear merge."""
    first = np.searchsorted(b2, a1, side="left")
    after = np.searchsorted(b1, a2, side="right")
    counts = np.maximum(after - first, 0)
    which = np.repeat(np.arange(len(a1)), counts)
    other = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return np.maximum(a1[which], b1[other]), np.minimum(a2[which], b2[other])


def subtract(firsts: np.ndarray, lasts: np.ndarray, cut_firsts: np.ndarray, cut_lasts: np.ndarray) -> Lists:
    """Disjoint intervals less other disjoint intervals; all sorted."""
    if not len(firsts) or not len(cut_firsts):
        return firsts, lasts
    open_firsts = np.r_[min(firsts[0], cut_firsts[0]), cut_lasts + 1]
    open_lasts = np.r_[cut_firsts - 1, max(lasts[-1], cut_lasts[-1])]
    keep = open_firsts <= open_lasts
    return intersect(firsts, lasts, open_firsts[keep], open_lasts[keep])


def _moved(codes: np.ndarray, days: np.ndarray) -> np.ndarray:
    return codes.astype("int64") * STRIDE + days.astype("int64") + STRIDE // 2


def _back(moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return moved // STRIDE, (moved % STRIDE - STRIDE // 2).astype("int32")


def _merged(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """One state per entity and kind of rows or states."""
    rows = pd.concat(frames) if len(frames) > 1 else frames[0]
    codes, keys = pd.factorize(pd.MultiIndex.from_frame(rows[["entity", "kind"]]))
    firsts, lasts = union(_moved(codes, rows["first"].to_numpy()), _moved(codes, rows["last"].to_numpy()))
    code, first = _back(firsts)
    return pd.DataFrame({"entity": keys.get_level_values(0)[code], "kind": keys.get_level_values(1)[code], "first": first, "last": _back(lasts)[1]})


def _merge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state: list[pd.DataFrame] = []
    fresh = 0
    for batch in batches:
        state.append(batch[["entity", "kind", "first", "last"]])
        fresh += len(batch)
        if fresh > HELD_ROWS:
            merged = _merged(state)
            if len(merged) > HELD_ROWS:  # too many entities to hold: a later round goes on merging
                yield merged
                state, fresh = [], 0
            else:
                state, fresh = [merged], 0
    if sum(map(len, state)):
        yield _merged(state)


def _whole_entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come in the order of entities, regrouped so that no entity is divided."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        inside = (batch["entity"] != batch["entity"].iloc[-1]).to_numpy()
        if inside.any() or (held and held[-1]["entity"].iloc[-1] != batch["entity"].iloc[-1]):
            yield pd.concat([*held, batch[inside]])
            held = [batch[~inside]]
        else:
            held.append(batch)
            if sum(map(len, held)) > HELD_ROWS:
                held = [_merged(held)]
    if held:
        yield pd.concat(held)


def _periods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for state in _whole_entities(batches):
        codes, entities = pd.factorize(state["entity"])
        lists = {}
        for kind in ("add", "cut"):
            rows = (state["kind"] == kind).to_numpy()
            lists[kind] = union(_moved(codes[rows], state["first"].to_numpy()[rows]), _moved(codes[rows], state["last"].to_numpy()[rows]))
        firsts, lasts = subtract(*lists["add"], *lists["cut"])
        code, first = _back(firsts)
        last = _back(lasts)[1]
        same = code[1:] == code[:-1]
        yield pd.DataFrame({"entity": entities[code], "kind": "period", "first": first, "last": last})
        yield pd.DataFrame({"entity": entities[code[1:][same]], "kind": "gap", "first": last[:-1][same] + 1, "last": first[1:][same] - 1})


def interval_states(intervals: DataFrame, salts: int = SALTS) -> DataFrame:
    """The states after the salted round: rows (entity, kind, first, last), disjoint within an entity, kind and salt.

    Rows with a null or with last < first cover nothing.
    """
    rows = intervals.select("entity", "kind", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")).dropna().filter("first <= last")
    partial = rows.mapInPandas(_merge_batches, STATE).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return partial.repartition("entity", "salt").mapInPandas(_merge_batches, STATE)


def periods_and_gaps(intervals: DataFrame, salts: int = SALTS) -> DataFrame:
    """(entity, kind, first, last): the continuous periods of each entity and the gaps between them.

    ``intervals``: (entity, kind, first, last) with kind 'add' or 'cut', inclusive integer days. An
    entity's days are those of its adds less those of its cuts; an entity without a day gives no row,
    and neither does an empty table. Repeated rows change nothing, other columns are ignored.
    """
    return interval_states(intervals, salts).repartition("entity").sortWithinPartitions("entity").mapInPandas(_periods, STATE)
