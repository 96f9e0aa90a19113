from isotrek.operators import variants
from tests.conftest import rows
from tests.feeds import BASE, at

PLACE = "key string, lat double, lon double"
LINE = "x1 double, y1 double, x2 double, y2 double"


def test_cell_access_ranks_by_the_walk(spark):
    cells = spark.createDataFrame([("c", *at(0, 0))], PLACE)
    across = [(f"w{i}", *at(150, 10 * i)) for i in range(25)]
    stations = spark.createDataFrame([*across, ("home", *at(-400, 0)), ("far", *at(-450, 0))], PLACE)
    rail = spark.createDataFrame([across[0], ("far", *at(-450, 0))], PLACE)
    rivers = spark.createDataFrame([(100.0, -5000.0, 100.0, 5000.0)], LINE)
    bridge = lambda *y: spark.createDataFrame([(100.0, float(v)) for v in y], "x double, y double")
    access = lambda *k, **w: {r.station: round(r.metres, -1) for r in variants.cell_access(cells, stations, rail, 1000.0, *k, **w).collect()}
    assert access(5, 3, rivers=rivers, bridges=bridge(-4000), origin=BASE) == {"home": 400, "far": 450}
    over = access(2, 1, rivers=rivers, bridges=bridge(200), origin=BASE)  # to w20 over the bridge at its height 224 + 50 m, to w0 224 + 206 m
    assert over["w20"] == 270 and over["w0"] == 430 and len(over) == 3
    assert rows(variants.cell_access(cells, stations, rail, 1000.0, 2, 1).select("station")) == [("w0",), ("w1",)]


def test_steps_of_the_second_rule_set(spark):
    trips = spark.createDataFrame([("t1", None), ("t2", " "), ("t3", "1")], "trip_id string, TAD string")
    assert rows(variants.fixed_trips(trips).select("trip_id")) == [("t1",), ("t2",)] and variants.fixed_trips(trips.drop("TAD")).count() == 3
    stops = spark.createDataFrame([("a", "TRONE"), ("b", "PARC"), ("c", None)], "stop_id string, stop_name string")
    words = [("stops", "stop_name", "fr", "TRONE", "Trone", 0), ("stops", "stop_name", "fr", "TRONE", "Trône", 1), ("stops", "stop_name", "nl", "PARC", "Park", 2), ("routes", "stop_name", "fr", "PARC", "x", 3)]
    names = spark.createDataFrame(words, "table_name string, field_name string, language string, field_value string, translation string, row_no long")
    assert rows(variants.translated_stops(stops, names, "fr")) == [("a", "Trône"), ("b", "PARC"), ("c", None)]
    served = spark.createDataFrame([("a", "R"), ("b", "R"), ("b", "Q")], "complex_id string, route_id string")
    states = variants.route_waits(served, spark.createDataFrame([("a", "R", 2.0), ("b", "Q", 3.25)], "complex_id string, route_id string, wait double"))
    assert rows(states) == [("a", "R", 2.0), ("b", "Q", 3.25), ("b", "R", 5.0)]
    times = spark.createDataFrame([("a", "A", 10.0), ("b", "B", 22.0)], "station string, name string, minutes double")
    got = variants.network_stats(states, times).first()
    assert [tuple(x) for x in got.lines] == [("Q", 1, 6.5), ("R", 2, 7.0)] and got.within_15 == 50 and got.near_20 == "B"
    complexes = spark.createDataFrame([("a", *at(0, 0)), ("b", *at(400, 0)), ("c", *at(0, 440)), ("d", *at(0, 900))], "complex_id string, lat double, lon double")
    assert rows(variants.near_complexes(complexes).select("a", "b")) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
    rivers, bridges = spark.createDataFrame([(200.0, -5000.0, 200.0, 5000.0)], LINE), spark.createDataFrame([(200.0, 300.0)], "x double, y double")
    assert rows(variants.near_complexes(complexes, rivers, bridges, BASE).select("a", "b")) == [("a", "c"), ("c", "a")]
