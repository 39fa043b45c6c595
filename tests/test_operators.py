"""Windows, boards, ladder, audits and the model on small known inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timekeel.operators import audit, board, journeys, metrics, model, parity, predict
from timekeel.operators.ordered import Track

T = Track(journeys.JOURNEY, ("location_order",), "location_order div 4")
DAY = dt.date(2026, 8, 27)


def cycles(spark, **sides):
    return spark.createDataFrame([(s, int(m * 60)) for s, ms in sides.items() for m in ms], "side string, cycle_sec bigint")


def test_windows_trim_edges_and_break_after_fifteen_minutes(spark):
    c = cycles(spark, local=[0, 5, 10, 15, 30, 46, 51], cloud=[2, 7, 12, 17])
    w = {(r["side"], r["start_sec"] // 60, r["end_sec"] // 60) for r in parity.windows(c).collect()}
    assert w == {("local", 5, 15), ("cloud", 7, 12)}
    both = [(r["start_sec"] // 60, r["end_sec"] // 60) for r in parity.both_up(parity.windows(c)).collect()]
    assert both == [(7, 12)]
    assert {r["side"]: r["longest"] for r in parity.longest_run(c).collect()} == {"local": 5, "cloud": 4}


def test_nearest_cycle_within_reach(spark):
    c = cycles(spark, local=[0, 10, 100], cloud=[1, 12, 90])
    got = {(r["local_sec"] // 60, r["cloud_sec"] // 60) for r in parity.paired_cycles(c, within=150).collect()}
    assert got == {(0, 1), (10, 12)}


def test_cycle_statuses(spark):
    rows = [("l", i, s, f) for i, group in enumerate([[(0, 0), (0, 0)], [(1, 0), (0, 0)], [(0, 1), (0, 0)], [(0, 1), (0, 1)]]) for s, f in group]
    df = spark.createDataFrame([(a, b, bool(s), bool(f)) for a, b, s, f in rows], "side string, cycle_sec int, skipped boolean, failed boolean")
    got = {r["cycle_sec"]: r["status"] for r in parity.cycle_report(df).collect()}
    assert got == {0: "complete", 1: "partial", 2: "degraded", 3: "failed"}


def test_decline_ladder(spark):
    def stops(train, rows):
        return [(DAY, train, i + 1, c, s, a, "1") for i, (c, s, a) in enumerate(rows)]
    data = (stops("A1", [("AAAA", None, None), ("BBBB", 40000, 40060), ("CCCC", 41000, None), ("DDDD", 60000, None)])
            + stops("B1", [("AAAA", 36000, 36000), ("BBBB", 37000, 35000), ("CCCC", 38000, None)])
            + stops("C1", [("AAAA", 40000, 38000), ("BBBB", 41000, None)]) + stops("D1", [("AAAA", 40000, None), ("BBBB", 41000, None)]))
    prep = journeys.prepared(spark.createDataFrame(data, "service_date date, train_code string, location_order int, location_code string, sched_sec int, arr_sec int, auto_arrival string"), T)
    asked = [("A1", "CCCC", 40100, True), ("A1", "BBBB", 40100, True), ("A1", "DDDD", 40100, True), ("A1", "AAAA", 40100, True), ("A1", "ZZZZ", 40100, True),
             ("B1", "CCCC", 37000, True), ("C1", "BBBB", 40000, True), ("D1", "BBBB", 40000, True), ("X9", "BBBB", 40000, True), ("A1", "CCCC", 40101, False)]
    reqs = spark.createDataFrame([(DAY, *r) for r in asked], "service_date date, train_code string, location_code string, at_sec int, upstream_ok boolean")
    got = {(r["train_code"], r["location_code"], r["at_sec"]): (r["outcome"], r["reason"]) for r in predict.decide(reqs, prep, T).collect()}
    want = [None, "already_arrived", "lead_out_of_range", "no_scheduled_arrival", "station_not_on_route", "journey_inconsistent",
            "vantage_delay_out_of_range", "no_upstream_report", "not_in_service", "upstream_unavailable"]
    for (tr, loc, s, _), reason in zip(asked, want):
        assert got[tr, loc, s] == (("predicted" if reason is None else "declined"), reason)


def test_one_target_per_band_nearest_first(spark):
    rows = [(DAY, "A1", i + 1, f"S{i}", 36000 + off, arr) for i, (off, arr) in enumerate([(-600, 35500), (120, None), (200, None), (1000, None), (2000, None), (17 * 3600, None)])]
    prep = spark.createDataFrame(rows, "service_date date, train_code string, location_order int, location_code string, sched_abs int, a int").withColumn("delay_sec", F.col("a") - F.col("sched_abs"))
    bands = sorted(r["lead_band"] for r in predict.choose_targets(prep, F.lit(36000), 5, 1).collect())
    assert bands == sorted(["0-5 min", "15-30 min", "30-60 min"])
    assert predict.choose_targets(prep, F.lit(36000), 1, 1).first()["lead_band"] == "0-5 min"


def test_run_after_midnight(spark):
    y, t = dt.date(2026, 8, 26), DAY
    runs = spark.createDataFrame([(y, "RUN", True, False), (t, "RUN", False, False), (y, "DONE", True, True), (t, "DONE", False, False), (y, "LIVE", True, False), (t, "LIVE", True, False)],
                                 "service_date date, train_code string, started boolean, finished boolean")
    asked = spark.createDataFrame([("RUN", t, 900), ("DONE", t, 900), ("LIVE", t, 900), ("RUN", t, 4 * 3600)], "train_code string, today date, wall_sec int")
    got = {(r["train_code"], r["wall_sec"]): r["service_date"] for r in board.current_run(asked, runs).collect()}
    assert got == {("RUN", 900): y, ("DONE", 900): t, ("LIVE", 900): t, ("RUN", 14400): t}


def test_unknown_station_is_an_error(spark):
    known = spark.createDataFrame([("AAAA", "a")], "code string, name string")
    with pytest.raises(ValueError, match="ZZZZ"):
        board.station_config(spark.createDataFrame([("zzzz", "g")], "code string, station_group string"), known)


def test_registry_keeps_weekday_order(spark):
    state = spark.createDataFrame([("A", DAY, DAY, [3])], "code string, first_seen date, last_seen date, days_of_week array<int>")
    seen = spark.createDataFrame([("A", dt.date(2026, 8, 24)), ("B", dt.date(2026, 8, 29))], "code string, day date")
    got = {r["code"]: r for r in audit.merge_registry(state, seen).withColumn("names", audit.weekday_names()).collect()}
    assert got["A"]["names"] == "Mon,Thu" and not got["A"]["is_new"] and got["A"]["first_seen"] == dt.date(2026, 8, 24)
    assert got["B"]["names"] == "Sat" and got["B"]["is_new"]


def test_echo_mix_reverses_the_comparison(spark):
    cells = spark.createDataFrame([(True, "1", 1823, 18), (True, "0", 1616, 712), (False, "1", 311656, 7425), (False, "0", 4885, 1201)],
                                  "flagged boolean, auto_arrival string, comparable bigint, exact bigint")
    r = audit.standardised_echo(cells).first()
    assert (round(r["flagged_pct"], 2), round(r["other_pct"], 2), round(r["flagged_at_other_mix_pct"], 2)) == (21.23, 2.73, 1.65)


def test_boosting_beats_its_start_on_a_signal(spark):
    rows = spark.range(3000).select(
        F.lit("Mon").alias("day_of_week"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").alias("target_location"), F.lit("V").alias("vantage_location"),
        (F.col("id") % 50 * 6).alias("current_delay_sec"), F.lit(None).cast("int").alias("prev_delay_sec"), F.when(F.col("id") % 2 == 0, 5).alias("prev2_delay_sec"),
        F.lit(1).alias("horizon_route_stops"), F.lit(600).alias("horizon_sched_sec"), F.lit(9).alias("vantage_hour"), F.lit(540).alias("vantage_minute_of_day"),
        (F.col("id") % 50 * 6 + F.when(F.col("id") % 3 == 0, 300).otherwise(0) + F.col("id") % 7).alias("target_delay_sec"))
    df = model.numbers(rows).withColumn("prev_delay_sec_d", F.lit(0.0))
    enc = model.encoder(df).fit(df)
    data = enc.transform(df).select("features", model.LABEL).cache()
    m = model.fit_boosted(data, 0.5, rounds=4, rate=0.5, depth=4)
    p = m.predict(data, "p").agg(F.avg(metrics.pinball(model.LABEL, "p", 0.5)).alias("m"), F.avg(metrics.pinball(F.col(model.LABEL), F.lit(m.start), 0.5)).alias("s")).first()
    assert p["m"] < 0.5 * p["s"]


def test_artifact_with_other_features_is_refused(spark, small):
    from timekeel.queries.models import boosted
    from timekeel.session import scratch_path
    import timekeel.queries.models as mq
    mq.ROUNDS, keep = 1, mq.ROUNDS
    enc, models, _, _ = boosted(spark, small)
    mq.ROUNDS = keep
    path = scratch_path(spark, "m")
    model.save(spark, path, "v1", enc, models, ["a"], {})
    assert model.load(spark, path, ["a"])[1][0].leaves == models[0].leaves
    with pytest.raises(ValueError, match="other features"):
        model.load(spark, path, ["b"])
