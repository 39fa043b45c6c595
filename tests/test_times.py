"""Clock, date and value rules on the values they must give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timekeel.functions import geodesy, sqlfuncs, times, values

L = F.lit


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("10:20:00", 37200), ("10:20", 37200), (" 10:20 ", 37200), ("", None), ("00:00", None), ("00:00:00", None),
    ("n/a", None), ("10", None), ("00:00:06", 6), ("10:xx", None), (None, None)])
def test_clock_seconds(spark, text, want):
    assert one(spark, times.clock_seconds(L(text).cast("string"))) == want


def test_full_clock_placeholders_keep_a_short_midnight(spark):
    assert one(spark, times.clock_seconds(L("00:00"), times.ABSENT_FULL_CLOCKS)) == 0


@pytest.mark.parametrize("sec,want", [(0, "00:00:00"), (86400 + 900, "00:15:00"), (-60, "23:59:00"), (None, None)])
def test_clock_text(spark, sec, want):
    assert one(spark, times.clock_text(L(sec).cast("int"))) == want


@pytest.mark.parametrize("arr,sched,want", [(81810, 78360, 3450), (60, 86340, 120), (86340, 60, -120), (None, 5, None)])
def test_delay_fold(spark, arr, sched, want):
    assert one(spark, times.delay(L(arr).cast("int"), L(sched).cast("int"))) == want


@pytest.mark.parametrize("text,want", [
    ("25 Aug 2026", dt.date(2026, 8, 25)), (" 5  AUGUST 2026 ", dt.date(2026, 8, 5)), ("25 Foo 2026", None), ("2026-08-25", None), ("", None)])
def test_feed_date(spark, text, want):
    assert one(spark, times.feed_date(L(text))) == want
    if want:
        assert one(spark, times.feed_date_text(L(want))) == want.strftime("%d %b %Y")


@pytest.mark.parametrize("stamp,day,want", [
    ("2026-08-27T10:00:00+01:00", "2026-08-27", 36000), ("2026-08-27T09:00:00Z", "2026-08-27", 36000),
    ("2026-08-27T10:00:00", "2026-08-27", 36000), ("2026-08-28T00:30:00+01:00", "2026-08-27", 88200),
    ("2026-10-25T03:00:00+00:00", "2026-10-25", 10800), ("soon", "2026-08-27", None)])
def test_service_seconds_are_wall_clock(spark, stamp, day, want):
    got = one(spark, times.service_seconds(times.local_stamp(L(stamp)), L(day).cast("date")))
    assert got == want


@pytest.mark.parametrize("sec,want", [(-1, None), (0, "0-5 min"), (299, "0-5 min"), (300, "5-15 min"), (1800, "30-60 min"), (3600, "60+ min"), (None, None)])
def test_band(spark, sec, want):
    assert one(spark, times.band(L(sec).cast("int"))) == want


def test_rebuilt_lead(spark):
    null = L(None).cast("int")
    assert one(spark, times.lead_or_rebuilt(null, L(37200), L(36000))) == 1200
    assert one(spark, times.lead_or_rebuilt(null, L(1200), L(85800))) == 1800
    assert one(spark, times.lead_or_rebuilt(L(7), L(1200), L(85800))) == 7


@pytest.mark.parametrize("kind,arr,dep,want", [
    ("O", "00:00", "17:20", "17:20"), ("D", "00:00", "00:00", "00:00"), ("S", "17:05", "17:07", "17:05"), ("S", "", "17:07", "17:07"), ("S", " ", "", "")])
def test_board_time(spark, kind, arr, dep, want):
    assert one(spark, times.board_time(L(kind), L(arr), L(dep))) == want


def test_board_scope(spark):
    assert one(spark, times.departed(L(82800), L(600))) == "departed"
    assert one(spark, times.departed(L(37000), L(36000))) == "not_yet_departed"
    assert one(spark, times.departed(L(None).cast("int"), L(36000))) == "unknown"


def test_settled_counts_from_local_midnight(spark):
    day = L("2026-08-27").cast("date")
    assert not one(spark, times.is_settled(day, L("2026-08-28 04:59:59").cast("timestamp")))
    assert one(spark, times.is_settled(day, L("2026-08-28 05:00:00").cast("timestamp")))


def test_quiet_hours(spark):
    for t, want in (("00:29:59", False), ("00:30:00", True), ("05:29:59", True), ("05:30:00", False)):
        assert one(spark, times.in_quiet_hours(L(f"2026-01-05 {t}").cast("timestamp"))) is want


@pytest.mark.parametrize("q,want", [(200, 180), (30, 0), (90, 120), (150, 120), (-30, 0)])
def test_minute_rounding_is_half_even(spark, q, want):
    assert one(spark, values.nearest_minute(L(q))) == want


def test_rival_error_across_midnight(spark):
    assert one(spark, values.rival_error(L(120), L(86340))) == 180


def test_served_range_never_crosses_the_median(spark):
    assert one(spark, values.served_low(L(-60), L(30), L(150))) == 30
    assert one(spark, values.served_high(L(120), L(30), L(-30))) == 90


def test_message_lines_and_report(spark):
    m = values.message_lines(L("A152\\\\n17:00 - Cork to Heuston\\nDeparted Thurles next stop Templemore"), L("A152"))
    assert one(spark, m) == ["17:00 - Cork to Heuston", "Departed Thurles next stop Templemore"]
    r = one(spark, values.last_report(m))
    assert (r["kind"], r["at"], r["next"]) == ("Departed", "Thurles", "Templemore")


@pytest.mark.parametrize("name,want", [("Ballinasloe", ""), ("Ballina", "ballina"), ("Enniscorthy", ""), ("CORK Kent", "cork"), ("", "")])
def test_weak_line_is_a_whole_word(spark, name, want):
    assert one(spark, values.weak_line_word(L(name))) == want


def test_names_equal_without_accents_and_hyphens(spark):
    for a, b in (("Dún Laoghaire", "dun laoghaire"), ("Carrick-on-Suir", "Carrick on Suir"), ("LittleIsland", "Little Island")):
        assert one(spark, values.tight_name_key(L(a)) == values.tight_name_key(L(b)))


def test_placeholder_position(spark):
    assert not one(spark, values.placed(L("0"), L("0")))
    assert one(spark, values.placed(L("53.3"), L("-6.2")))
    assert not one(spark, values.placed(L(""), L("x")))


def test_national_grid_at_a_published_point(spark):
    x, y = geodesy.grid_xy(L(53.34979538), L(-6.26024777))
    assert abs(one(spark, x) - 715830.0) < 5 and abs(one(spark, y) - 734697.0) < 5
    x0, y0 = geodesy.grid_xy(L(53.5), L(-8.0))
    assert abs(one(spark, x0) - 600000) < 1e-6 and abs(one(spark, y0) - 750000) < 1e-6


def test_sql_functions_agree_with_columns(spark):
    sqlfuncs.register(spark)
    row = spark.sql("SELECT tk_clock('10:20') a, tk_clock('00:00') b, tk_delay(60, 86340) c, tk_lead_band(300) d, tk_lead_band(-1) e, tk_fold(-43201) f").first()
    assert tuple(row) == (37200, None, 120, "5-15 min", None, 43199)


def test_way_reasons(spark):
    def tags(**kw):
        return F.create_map(*[L(x) for kv in kw.items() for x in kv]) if kw else F.create_map(L("a"), L("b"))
    assert one(spark, values.drop_reason(tags(service="yard"))) == "service=yard"
    assert one(spark, values.drop_reason(tags(disused="yes"))) == "disused"
    assert one(spark, values.drop_reason(tags(usage="main"))) is None
