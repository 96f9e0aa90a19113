from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isotrek.functions.zones import zone_table
from isotrek.operators.timestamps import change_day_rows, normalise_timestamps, to_instants
from tests.naive_time import changes_clocks, naive_epoch

ZONES = ["Europe/Madrid", "America/Toronto", "Asia/Kolkata", "Australia/Adelaide", "America/Sao_Paulo", "Pacific/Funafuti"]
VALUES = [
    "05:26:00", "5:26:00", "25:10:00", " 08:00:00\t", "06:30", "02:42am", "12:00 AM", "12:30:00 PM", "13:10:00 PM", "0:10 AM", "2026-03-29T12:00:00", "2026-03-29 12:00",
    "2026-06-11 11:03:45 EDT", "2026-08-23 12:58:45 UTC", "2026-10-25 02:30:00 CET", "2026-10-25 02:30:00 CEST", "2026-10-25 02:30:00", "2026-10-25T02:30:00 Europe/Madrid",
    "2026-10-25T02:30:00[Europe/Madrid]", "2026-03-29 02:30:00", "2026-162T16:54:30Z", "20261222T162845", "20260810T144130+0200", "20261013191830",
    "1797952260477", "1767384840802220", "1793863425", "Thu, 18 Jun 2026 01:36:15 +0530", "2026-07-12T06:12:00.000Z", "2026-12-09T17:50:45.000001z", "2026-03-28T10:13:00,750+1030",
    "2026-05-26T13:03:30.5-05:00", "2026-08-02 09:30:15.000+12", "31.5.2026 23:06", "1.1.2026 8:05", "12.5.2026", "10/25/2026 12:15:00", "25/10/2026 12:15:00", "2026-02-31T08:10:00Z",
    "99:99:99", "08:61", "n/a", "TBD", ":", "--:--", "", "null", "2026-05-05 10:00:00 XYZ", "2026-05-05T10:00:00 Europe/Nowhere", "123", "12:00:00" + " " * 200, "7" * 5000,
]


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("day", ["20261025", "20260329", "20260105"])
def test_agrees_with_a_plain_reading(zone, day):
    utc, ok = to_instants(pd.Series(VALUES), pd.Series([zone] * len(VALUES)), pd.Series([day] * len(VALUES)))
    got = [int(u) if o else None for u, o in zip(utc, ok)]
    for value, mine in zip(VALUES, got):
        assert mine == naive_epoch(value, zone, day), (value, zone, day)


def test_date_in_doubt_is_the_one_near_the_service_day():
    values = pd.Series(["04/05/2026 10:00:00"] * 3)
    utc, ok = to_instants(values, pd.Series(["Asia/Kolkata"] * 3), pd.Series(["20260504", "20260405", "20260901"]))
    assert ok.tolist() == [True, True, False]
    assert utc[0] - utc[1] == 29 * 86_400


def test_skipped_and_repeated_hours():
    madrid = zone_table("Europe/Madrid")
    skipped, repeated = 20_541 * 86_400 + 9_000, 20_751 * 86_400 + 9_000  # 2026-03-29 and 2026-10-25, 02:30
    utc, shown = madrid.to_utc(np.array([skipped, repeated]))
    assert shown.tolist() == [False, True] and utc[1] == repeated - 7_200


@pytest.mark.parametrize("zone", ZONES)
def test_change_days(zone):
    marked = {d for _, d in change_day_rows([zone]) if d.startswith("2026")}
    assert marked == {d for d in pd.date_range("2026-01-01", "2026-12-31").strftime("%Y%m%d") if changes_clocks(zone, d)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_read_or_refused(text):
    utc, ok = to_instants(pd.Series([text]), pd.Series(["Europe/Paris"]), pd.Series(["20260601"]))
    assert len(utc) == len(ok) == 1


def test_operator_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([("06:30", "Europe/Madrid", "20260601", 1), ("06:30", "Europe/Madrid", "20260601", 1), (None, "Europe/Madrid", "20260601", 2), ("06:30", None, "20260601", 3), ("06:30", "Europe/Madrid", None, 4), ("1793863425", None, None, 5)], "v string, z string, d string, id int")
    got = normalise_timestamps(df, "v", "z", "d").orderBy("id").collect()
    assert [r.utc_epoch for r in got] == [1780288200, 1780288200, None, None, None, 1793863425]
    assert normalise_timestamps(df.limit(0), "v", "z", "d").collect() == []
    with pytest.raises(ValueError):
        normalise_timestamps(df.withColumnRenamed("id", "utc_epoch"), "v", "z", "d")


def test_what_the_library_would_take_but_names_no_day_or_digit():
    values = pd.Series(["2026-366T16:54:30Z", "1٢:00:00"])
    assert not to_instants(values, pd.Series(["Europe/Paris"] * 2), pd.Series(["20260601"] * 2))[1].any()


def test_long_values_and_many_hours():
    noon = 1780308000 - 12 * 3600  # 2026-06-01 in Madrid, noon minus 12 hours
    cases = {
        "2026-06-01T10:00:00." + "0" * 80 + "Z": 1780308000, "2026-06-01" + " " * 90 + "12:00:00": 1780308000, "1000:00:00": noon + 3_600_000, "0" * 200 + "6:30": noon + 23_400,
        "999999999": 999_999_999, "999999999123": 999_999_999, "999999999123456": 999_999_999, "9" * 16 + ":00": None, "12345678": None, "9" * 18: None, "x" * 100_000: None, "": None,
    }
    utc, ok = to_instants(pd.Series(list(cases) * 50), pd.Series(["Europe/Madrid"] * len(cases) * 50), pd.Series(["20260601"] * len(cases) * 50))
    assert [int(u) if o else None for u, o in zip(utc, ok)] == [None if v is None else v for v in cases.values()] * 50


@pytest.mark.parametrize("zone", [*ZONES, "Africa/Casablanca", "America/New_York", "Europe/Dublin", "Pacific/Apia", "Australia/Lord_Howe", "Asia/Tehran", "America/Nuuk"])
def test_zone_tables_equal_the_library(zone):
    tz, table = ZoneInfo(zone), zone_table(zone)
    at = np.random.default_rng(3).integers(-2_000_000_000, 4_000_000_000, 3_000)
    near = (table.starts[(table.starts > -2_000_000_000) & (table.starts < 4_000_000_000), None] + np.array([-1, 0, 3600])).ravel()
    for second in [*at.tolist(), *near.tolist()]:
        local = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).astimezone(tz)
        assert local.utcoffset().total_seconds() == table.offsets[np.searchsorted(table.starts, second, side="right")], second
