import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from isotrek.functions.values import decimal_between, digits_only, real_day
from isotrek.operators.records import COLUMN_COUNT, INVALID_VALUE, QUOTING, _Broken, _Reader, faulty_lines, judge_line, parse_line, parse_text, readable_lines, value_is_valid
from pyspark.sql import functions as F
from tests.conftest import rows


def test_quoting():
    assert parse_line('a,"b ""c"", d",\r')[0] == ["a", 'b "c", d', ""]
    assert parse_line('﻿x,"1\n2"')[0] == ["x", "1\n2"]
    for bad, offset in (('a,"b', 2), ('a,"b"c,d', 5), ('a,b"c"', 3), ('a, "b"', 3), ('"a"" ,b', 0)):
        values, problem = parse_line(bad)
        assert values == [] and problem.reason == QUOTING and problem.offset == offset, bad


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n \'é', max_size=6), min_size=1, max_size=5))
def test_round_trip(values):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerow(values)
    assert parse_line(out.getvalue())[0] == [v.strip() for v in values]


def test_recovery_resumes_at_a_validated_record():
    text = 'stop_id,stop_name,stop_lat\nS1,"open,1.0\nS2,Plaza,2.0\nS3,"two\nlines",3.0\nS4,4.0\n\n   \nS5,Fin,5.0\r\n'
    got = list(parse_text(text))
    assert [v for _, v, p in got if p is None] == [["stop_id", "stop_name", "stop_lat"], ["S2", "Plaza", "2.0"], ["S3", "two\nlines", "3.0"], ["S5", "Fin", "5.0"]]
    assert [(p.reason, text[at : at + 2]) for at, _, p in got if p] == [(QUOTING, "S1"), (COLUMN_COUNT, "S4")]
    assert list(parse_text("")) == []


def test_judging_order():
    header = "stop_id, stop_lat"
    assert judge_line("S1,1.5", header, "f/stops.txt") is None
    assert judge_line('S1,"1.5', header, "f/stops.txt").reason == QUOTING
    assert judge_line("S1,1.5,x", header, "f/stops.txt").reason == COLUMN_COUNT
    assert judge_line("S1,95", header, "f/stops.txt").reason == INVALID_VALUE
    assert judge_line("S1,", header, "f/stops.txt").reason == INVALID_VALUE
    assert judge_line("S1", None, "f/stops.txt") is None and judge_line("S1,x", "stop_id,y", "f/stops.txt") is None


VALUES = ["1.5", "+1.5", "-90", "90.0001", "1e1", ".5", "5.", "1,5", "1.5d", "NaN", "inf", "", None, " 7 ", "٣", "0x1", "20260228", "20260229", "20240229", "00000101", "20261301", "2026-01-01", "12", "1 2"]


def test_column_checks_agree_with_the_reader(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = df.select("v", decimal_between(F.col("v"), -90, 90).isNotNull(), digits_only(F.col("v")), real_day(F.col("v")).isNotNull()).collect()
    for v, *flags in got:
        stripped = (v or "").strip()
        assert flags == [value_is_valid(c, stripped) for c in ("latitude", "digits", "day")], v


def test_tables_of_lines(spark):
    data = [
        (1, "a/stops.txt", 1, "stop_id,stop_lat"), (2, "a/stops.txt", 2, "S1,1"), (3, "a/stops.txt", 3, None), (4, "a/stops.txt", 4, "  "), (5, "a/stops.txt", 5, "S1,x"), (5, "a/stops.txt", 5, "S1,x"),
        (6, "b/stops.txt", 2, "S1,x"), (7, None, 2, 'S"1'), (8, "a/stops.txt", None, "S1,1,2"), (9, "a/stops.txt", 9, "S," + "9" * 100_000),
    ]
    df = spark.createDataFrame(data, "line_id long, feed_file string, line_no int, line string").withColumn("reason", F.lit("clash"))
    assert rows(faulty_lines(df).select("line_id", "reason")) == sorted([(5, INVALID_VALUE), (5, INVALID_VALUE), (7, QUOTING), (8, COLUMN_COUNT), (9, INVALID_VALUE)], key=str)
    assert [(r.line_id, r.stop_id, r.stop_lat, r.stop_name) for r in readable_lines(df, "stops").collect()] == [(2, "S1", 1.0, None)]
    assert faulty_lines(df.limit(0)).collect() == []


def test_records_after_a_broken_one_in_the_same_row_are_loaded(spark):
    data = [(1, "f/calendar.txt", 1, "service_id,monday,start_date"), (2, "f/calendar.txt", 2, 'W,"1,20260101\nX,0,20260301\nY,1,"20260302"\r\n'), (3, "f/calendar.txt", 3, "Z,1,20260230"), (4, "f/calendar.txt", 4, ",,")]
    df = spark.createDataFrame(data, "line_id long, feed_file string, line_no int, line string")
    assert rows(faulty_lines(df).select("line_id", "reason", "at_offset")) == [(2, QUOTING, 32), (3, INVALID_VALUE, 0), (4, INVALID_VALUE, 0)]
    assert rows(readable_lines(df, "calendar").select("line_id", "at_offset", "service_id", "monday", F.col("start_date").cast("string"), "end_date")) == [(2, 14, "X", False, "2026-03-01", None), (2, 27, "Y", True, "2026-03-02", None)]


def test_many_carriage_returns_and_records_of_several_lines():
    assert parse_line("a" + "\rb" * 5000)[0] == ["a" + "\rb" * 5000]
    assert parse_line("a,b\r\n")[0] == ["a", "b"] and parse_line("a\nb")[1].reason == QUOTING and parse_line('"a"\rb')[1].reason == QUOTING and parse_line("\na")[1].reason == QUOTING
    text = 'k,v\n1,"open\n2,"over\ntwo lines"\n3,x\n'
    assert [(v, p and p.reason) for _, v, p in parse_text(text)] == [(["k", "v"], None), ([], QUOTING), (["2", "over\ntwo lines"], None), (["3", "x"], None)]
    assert list(parse_text("1\n1,2\n", 2))[0][2].reason == COLUMN_COUNT


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab", \r\n', max_size=14))
def test_lines_split_at_commas_equal_the_descent(text):
    for at, values, problem in parse_text(text):
        if problem is None:
            try:
                assert values == [v.strip() for v in _Reader(text, at).record()]
            except _Broken:
                raise AssertionError(text) from None
