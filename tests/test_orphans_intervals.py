import random
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from isotrek.operators import intervals
from isotrek.operators.intervals import periods_and_gaps
from isotrek.operators.orphans import Reference, direct_orphans, longest_chain, orphan_cascade, orphan_report
from tests.conftest import rows

T = [datetime(2026, 1, d) for d in range(1, 10)]
REFS = [Reference("trips", "route_id", "trip_id", "routes", "route_id", "feed_day"), Reference("times", "trip_id", "st_id", "trips", "trip_id", "feed_day")]


def tables(spark):
    routes = [("R1", T[0], None), ("R2", T[0], T[2]), ("R2", T[0], T[1]), ("R3", T[6], None), (" R4 ", T[0], None), ("R5", T[0], T[2]), ("R5", T[5], None), (None, T[0], None)]
    trips = [("T1", "R1"), ("T2", "R2"), ("T3", "R3"), ("T4", "R4\t"), ("T5", "R5"), ("T6", "R9"), ("T7", None), ("T8", "  "), ("T6", "R9")]
    times = [(1, "T1"), (2, "T2"), (3, "T6"), (4, "T0"), (5, None)]
    return {
        "routes": spark.createDataFrame(routes, "route_id string, received_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("kind", F.lit("clash")),
        "trips": spark.createDataFrame([(t, r, "20260315", T[4], None) for t, r in trips], "trip_id string, route_id string, feed_day string, received_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("ref", F.lit(1)),
        "times": spark.createDataFrame([(s, t, "20260401", T[4]) for s, t in times], "st_id long, trip_id string, feed_day string, received_at timestamp_ntz"),
    }


def test_kinds(spark):
    t = tables(spark)
    got = rows(direct_orphans(t["trips"], t["routes"], REFS[0]).select("rec_key", "ref_month", "kind"))
    assert got == [("T2", "2026-03", "deleted"), ("T3", "2026-03", "late"), ("T6", "2026-03", "missing")]  # T5: one row withdrawn, one later: neither holds for all


def test_cascade(spark):
    t = tables(spark)
    got = rows(orphan_cascade(t, REFS).select("src", "rec_key", "kind", "level"))
    assert ("times", "2", "inherited", 1) in got and ("times", "3", "inherited", 1) in got and ("times", "4", "missing", 0) in got and len(got) == 6
    assert sum(r.orphans for r in orphan_report(orphan_cascade(t, REFS)).collect()) == 6
    assert longest_chain(REFS) == 1 and longest_chain([*REFS, Reference("routes", "route_id", "route_id", "times", "st_id")]) is None


def test_a_key_with_a_sound_row_is_not_lost(spark):
    t = tables(spark)
    day = lambda rows: spark.createDataFrame([(*r, "20260315", T[4], None) for r in rows], "trip_id string, route_id string, feed_day string, received_at timestamp_ntz, deleted_at timestamp_ntz")
    t["trips"] = day([("T1", "R1"), ("T1", "R9"), ("T1", "R9"), ("T2", "R9"), ("T2", "R8"), ("T3", None)])
    t["times"] = spark.createDataFrame([(1, "T1", "S", "20260401", T[4]), (2, "T2", "X", "20260401", T[4]), (3, "T2", "X", "20260401", T[4]), (4, "T3", None, "20260401", T[4])], "st_id long, trip_id string, stop_id string, feed_day string, received_at timestamp_ntz")
    t["stops"] = spark.createDataFrame([("S", T[0], None)], "stop_id string, received_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = [*REFS, Reference("times", "stop_id", "st_id", "stops", "stop_id", "feed_day")]
    got = rows(orphan_cascade(t, refs).filter("src = 'times'").select("field", "rec_key", "kind", "level"))
    assert got == [("stop_id", "2", "missing", 0), ("stop_id", "3", "missing", 0), ("trip_id", "2", "inherited", 1), ("trip_id", "3", "inherited", 1)]


def test_cycles_and_longer_chains_end(spark):
    at = "received_at timestamp_ntz"
    t = {
        "a": spark.createDataFrame([("a1", "c9", T[0]), ("a2", "c1", T[0])], f"id string, c string, {at}"), "b": spark.createDataFrame([("b1", "a1", T[0]), ("b2", "a2", T[0])], f"id string, a string, {at}"),
        "c": spark.createDataFrame([("c1", "b1", T[0]), ("c2", "b2", T[0])], f"id string, b string, {at}"),
    }
    refs = [Reference("a", "c", "id", "c", "id"), Reference("b", "a", "id", "a", "id"), Reference("c", "b", "id", "b", "id")]
    got = rows(orphan_cascade(t, refs).select("rec_key", "level"))
    assert got == [("a1", 0), ("a2", 3), ("b1", 1), ("b2", 4), ("c1", 2), ("c2", 5)]


def test_empty_tables(spark):
    t = {k: v.limit(0) for k, v in tables(spark).items()}
    assert orphan_cascade(t, REFS).collect() == []


def test_periods_equal_days_one_by_one(spark):
    r = random.Random(5)
    data = [(f"s{r.randrange(12)}" if r.random() < 0.6 else "hot", r.choice(["add", "add", "cut"]), a := r.randrange(200), a + r.randrange(-2, 15)) for _ in range(900)]
    data += data[:40] + [(None, "add", 1, 2), ("n", "add", None, 2), ("far", "add", 0, 2_900_000), ("only cut", "cut", 1, 2), ("swallowed", "add", 3, 4), ("swallowed", "cut", 1, 9)]
    want = []
    for entity in {d[0] for d in data if d[0]}:
        days = set()
        for kind, change in (("add", days.update), ("cut", days.difference_update)):
            for e, k, a, b in data:
                if e == entity and k == kind and a is not None and a <= b:
                    change(range(a, b + 1))
        runs = []
        for day in sorted(days):
            if runs and runs[-1][1] == day - 1:
                runs[-1][1] = day
            else:
                runs.append([day, day])
        want += [(entity, "period", a, b) for a, b in runs] + [(entity, "gap", b + 1, c - 1) for (_, b), (c, _) in zip(runs, runs[1:])]
    df = spark.createDataFrame(data, "entity string, kind string, first int, last int").withColumn("salt", F.lit("clash")).repartition(7)
    assert rows(periods_and_gaps(df)) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert periods_and_gaps(df.limit(0)).collect() == []
    held = intervals.HELD_ROWS
    frames = [f.assign(first=f["first"], last=f["last"]) for f in [g.iloc[i : i + 23] for g in [df.dropna().filter("first <= last").select("entity", "kind", "first", "last").toPandas().sort_values("entity")] for i in range(0, len(g), 23)]]
    try:
        intervals.HELD_ROWS = 7  # whatever a task may hold, the result is the same
        small = pd.concat(list(intervals._periods(intervals._whole_entities(iter([*frames, frames[0][:0]])))))
        parts = pd.concat(list(intervals._merge_batches(iter(frames)))).sort_values("entity")
        again = pd.concat(list(intervals._periods(iter([parts.iloc[i : i + 50] for i in range(0, len(parts), 50)]))))
    finally:
        intervals.HELD_ROWS = held
    for found in (small, again):
        assert sorted(map(tuple, found.itertuples(index=False)), key=lambda t: tuple((x is None, str(x)) for x in t)) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
