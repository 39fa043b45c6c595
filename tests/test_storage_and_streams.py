"""Archive parsing, fail-closed logging, reruns, and the guards."""

import gzip
import datetime as dt

import pytest
from pyspark.sql import functions as F

from timekeel.session import scratch_path
from timekeel.sources import feeds, logs, sinks

XML = """<?xml version="1.0" encoding="utf-8"?>
<ArrayOfObjTrainMovements xmlns="http://example.org/feed/">
{rows}
</ArrayOfObjTrainMovements>"""
ROW = ("<objTrainMovements><TrainCode>A1  </TrainCode><TrainDate>25 Aug 2026</TrainDate><LocationCode>{c}</LocationCode><LocationOrder>{o}</LocationOrder>"
       "<LocationType>S</LocationType><ScheduledArrival>{s}</ScheduledArrival><ScheduledDeparture>00:00:00</ScheduledDeparture><Arrival>{a}</Arrival>"
       "<Departure></Departure><AutoArrival>1</AutoArrival><Odd>1</Odd></objTrainMovements>")


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    day = base / "2026-08-25"
    day.mkdir()
    stops = [("aaaa", 1, "00:00:00", ""), ("bbbb", 2, "23:50:00", "23:56:00"), ("cccc", 3, "23:58:00", ""), ("dddd", 4, "00:10:00", "00:10:00"), ("eeee", 5, "00:20:00", "")]
    body = XML.format(rows="\n".join(ROW.format(c=c, o=o, s=s, a=a) for c, o, s, a in stops))
    with gzip.open(day / "A1.xml.gz", "wb") as z:
        z.write(body.encode())
    (day / "B2.xml.gz.tmp").write_bytes(b"half")
    return str(base)


def test_parse_the_archive(spark, archive):
    rows = {r["LocationCode"]: r for r in feeds.parse_movements(feeds.read_movements(spark, archive + "/*/*.xml.gz")).collect()}
    assert rows["aaaa"]["null_reason"] == "structural"
    assert rows["bbbb"]["arrival_delay_sec"] == 360 and rows["bbbb"]["is_exact_match"] is False
    assert rows["cccc"]["null_reason"] == "unreported" and rows["cccc"]["is_exact_match"] is None
    assert rows["dddd"]["arrival_delay_sec"] == 0 and rows["dddd"]["is_exact_match"] is True
    assert rows["eeee"]["null_reason"] == "future"
    assert rows["bbbb"]["file_date"] == "2026-08-25" and rows["bbbb"]["service_date"] == dt.date(2026, 8, 25)


def test_drift_and_census(spark, archive):
    drift = {(r["tag"], r["drift"]) for r in feeds.tag_drift(spark, archive + "/*/*.xml.gz", "objTrainMovements", feeds.MOVEMENT_FIELDS).collect()}
    assert ("Odd", "unexpected") in drift and ("StopType", "missing") in drift
    c = logs.census(spark, archive, empty_max=10).first()
    assert (c["date"], c["files"], c["strays"], c["empty"]) == ("2026-08-25", 1, 1, 0)


def log_row(**kw):
    row = dict(outcome="predicted", predicted_at="t", model_version="v", train_date="25 Aug 2026", train_code="A1", station_code="S",
               scheduled_arrival="10:00", pred_q10_sec=1, pred_q50_sec=2, pred_q90_sec=3, reason=None)
    row.update(kw)
    return row


LOG = ("outcome string, predicted_at string, model_version string, train_date string, train_code string, station_code string, scheduled_arrival string, "
       "pred_q10_sec int, pred_q50_sec int, pred_q90_sec int, reason string")


def write_log(spark, path, *rows):
    from timekeel.functions.times import feed_date
    cols = [c.split()[0] for c in LOG.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], LOG)
    sinks.append_predictions(df, path, feed_date("train_date"))


def test_log_files_each_row_under_its_own_date(spark):
    path = scratch_path(spark, "log")
    write_log(spark, path, log_row(), log_row(train_date="26 Aug 2026"))
    assert {str(r["date"]) for r in spark.read.json(path).select("date").collect()} == {"2026-08-25", "2026-08-26"}


@pytest.mark.parametrize("bad", [dict(pred_q50_sec=None), dict(outcome="maybe"), dict(outcome="declined"), dict(train_date="soon"), dict(train_code=None)])
def test_log_fails_closed(spark, bad):
    path = scratch_path(spark, "log")
    with pytest.raises(sinks.LogWriteFailed):
        write_log(spark, path, log_row(), log_row(**bad))
    assert sinks.existing(spark, path) is None


def test_rerun_is_a_no_op_unless_forced(spark):
    path = scratch_path(spark, "parts")
    df = spark.createDataFrame([("2026-08-25", 1), ("2026-08-26", 2)], "date string, v int")
    assert sinks.pending(df, path).count() == 2
    sinks.write_partitioned(df.where("v = 1"), path)
    assert [r["v"] for r in sinks.pending(df, path).collect()] == [2]
    assert sinks.pending(df, path, force=True).count() == 2
    sinks.write_partitioned(df.withColumn("v", F.col("v") * 10).where("v = 20"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 20]


def test_code_lists_in_three_shapes(spark):
    for text in ('{"codes": {"a1": {"x": 1}, "b-2": {}}}', '{"a1": 1, "b-2": 2}', '["a1 ", "b-2", "../x"]', '{"codes": ["a1", "b-2"]}'):
        path = scratch_path(spark, "codes")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        assert sorted(r["code"] for r in logs.read_codes(spark, path).collect()) == ["A1", "B-2"]


def test_stale_archive_is_refused(spark):
    newest = spark.createDataFrame([(dt.datetime(2026, 8, 25, 0, 0),)], "newest timestamp")
    assert logs.refuse_stale(newest, F.lit("2026-08-25 20:00:00").cast("timestamp")).first()["fresh"]
    with pytest.raises(Exception, match="stale"):
        logs.refuse_stale(newest, F.lit("2026-08-27 00:00:00").cast("timestamp")).collect()


def test_published_copy_is_identical(spark):
    a, b = scratch_path(spark, "doc"), scratch_path(spark, "copy")
    sinks.publish(spark.createDataFrame([('{"n":1}',)], "value string"), a, b)
    assert spark.read.text(a).collect() == spark.read.text(b).collect()


def test_a_reader_always_finds_a_whole_document(spark):
    """Two versions in turn while a thread reads: always the one or the other, whole, and one file only."""
    import os
    import threading
    place = scratch_path(spark, "live")
    bodies = ["\n".join(f"{v}-{i}" for i in range(3000)) for v in "ab"]
    frames = [spark.createDataFrame([(line,) for line in b.split("\n")], "value string").coalesce(1) for b in bodies]
    sinks.publish(frames[0], place)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            names = sorted(n for n in os.listdir(place) if not n.startswith("."))
            with open(f"{place}/{names[-1]}") as f:
                seen.append((1 <= len(names) <= 2, f.read().strip() in bodies))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(6):
        sinks.publish(frames[(i + 1) % 2], place)
    alive = reader.is_alive()
    stop.set()
    reader.join()
    assert alive and len(seen) > 20 and {whole for _, whole in seen} == {True}
    assert sorted("\n".join(r[0] for r in sinks.published(spark, place).collect()) == b for b in bodies) == [False, True]


def test_parse_opens_new_dates_only(spark, tmp_path):
    from timekeel.plans import offline
    raw, out = tmp_path / "raw", str(tmp_path / "out")

    def day(date, body=None):
        (raw / date).mkdir(parents=True, exist_ok=True)
        with gzip.open(raw / date / "A1.xml.gz", "wb") as z:
            z.write((body or XML.format(rows=ROW.format(c="aaaa", o=1, s="10:00:00", a="10:01:00"))).encode())

    day("2026-08-25")
    day("2026-08-26")
    assert [f[-10:] for f in offline.parse(spark, str(raw), out)] == ["2026-08-25", "2026-08-26"]
    # The finished dates could not be read any more, and are not.
    for date in ("2026-08-25", "2026-08-26"):
        (raw / date / "A1.xml.gz").write_bytes(b"not a file of the archive")
    day("2026-08-27")
    assert [f[-10:] for f in offline.parse(spark, str(raw), out)] == ["2026-08-27"]
    assert offline.parse(spark, str(raw), out) == []
    assert {str(r["date"]) for r in spark.read.parquet(out).collect()} == {"2026-08-25", "2026-08-26", "2026-08-27"}
    assert len(offline.new_folders(spark, str(raw), out, force=True)) == 3


def test_census_counts_what_cannot_be_read(spark, tmp_path):
    folder = tmp_path / "2026-08-25"
    folder.mkdir()
    whole = gzip.compress(XML.format(rows="").encode())
    for name, body in (("a.xml.gz", whole), ("cut.xml.gz", whole[:-9]), ("plain.xml.gz", b"<a/>"), ("open.xml.gz", gzip.compress(b"<a><b></a>" * 30)), ("empty.xml.gz", gzip.compress(b"")), ("half.tmp", b"x")):
        (folder / name).write_bytes(body)
    c = logs.census(spark, str(tmp_path), empty_max=10).first()
    assert (c["files"], c["empty"], c["unreadable"], c["unparseable"], c["strays"]) == (5, 1, 2, 1, 1)


def test_nothing_is_published_when_the_log_refuses(spark, tmp_path):
    from timekeel.plans import serve
    rows = spark.createDataFrame([("predicted", None, dt.date(2024, 1, 2), "T1", "AAAA", 600, "5-15 min", 36000, -60, 30, 90, -60, 90)],
                                 "outcome string, reason string, service_date date, train_code string, location_code string, lead_sec int, lead_band string, target_sched_sec int, q10_sec int, q50_sec int, q90_sec int, served_q10_sec int, served_q90_sec int")
    at = F.lit("2024-01-02 10:00:00").cast("timestamp")
    bad = rows.withColumn("q50_sec", F.lit(None).cast("int"))
    with pytest.raises(sinks.LogWriteFailed):
        serve.serve(bad, "v1", at, f"{tmp_path}/log", f"{tmp_path}/out")
    assert not (tmp_path / "log").exists() and not (tmp_path / "out").exists()
    serve.serve(rows, "v1", at, f"{tmp_path}/log", f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/log").count() == spark.read.text(f"{tmp_path}/out").count() == 1


def test_training_job_reads_back_what_it_fitted(spark, small, tmp_path):
    from timekeel import views
    from timekeel.operators import journeys
    from timekeel.plans import train
    moves, t = views.movements(spark, small)
    prep = journeys.prepared(moves, t)
    ex = journeys.examples(journeys.observed(prep.where("consistent"), t), t)
    report = train.train(spark, ex, {"train": ("2024-01-01", "2024-01-19"), "test": ("2024-01-20", "2024-12-31")}, str(tmp_path), "v1", rounds=2, depth=3).collect()
    assert {r["predictor"] for r in report} == {"model", "persistence"}
    assert all(0 < r["loss50"] < 1e5 for r in report)


def test_sessions_from_pieces_equal_one_walk_and_split_a_side(spark):
    """Captures of one side over days: pieces spread over many keys, sessions equal a plain walk."""
    import random
    from timekeel.streaming import streams
    rng, at, times = random.Random(6), 1_700_000_000, []
    for _ in range(900):
        at += rng.choice([60, 60, 300, 900, 901, 1800, 5000])
        times += [at] * rng.randint(1, 3)
    rows = [("local" if i % 7 else "cloud", t, i) for i, t in enumerate(times)]
    schema = "side string, sec long, id int"
    far = 1_900_000_000

    def land(df, stamp):
        path = scratch_path(spark, "captures")
        df.write.parquet(path)
        df.limit(1).withColumn(stamp, F.timestamp_seconds(F.lit(far))).write.mode("append").parquet(path)
        return streams.follow(spark, path, df.schema)

    def drained(s):
        return spark.read.schema(s.schema).parquet(streams.drain(s, "out", scratch_path(spark, "state"))).where(F.col("start_at") < F.timestamp_seconds(F.lit(far)))

    caps = spark.createDataFrame(rows, schema).withColumn("polled_at", F.timestamp_seconds("sec"))
    pieces = drained(streams.session_pieces(land(caps, "polled_at")))
    assert pieces.count() > 200
    got = sorted((r["side"], r["a"], r["b"], r["n"]) for r in drained(streams.merged_sessions(land(pieces, "start_at"))).select(
        "side", F.unix_timestamp("start_at").alias("a"), F.unix_timestamp("end_at").alias("b"), "n").collect())
    want = []
    for side in ("cloud", "local"):
        run = None
        for t in sorted(t for s, t, _ in rows if s == side):
            if run is None or t - run[2] > 900:
                run = [side, t, t, 0]
                want.append(run)
            run[2], run[3] = t, run[3] + 1
    assert got == sorted(map(tuple, want))


def test_trains_of_a_day_share_state_and_close_one_by_one(spark):
    from timekeel.streaming import streams

    at = lambda h, m=0: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h, minutes=m)
    day, schema = dt.date(2024, 1, 1), "service_date date, train_code string, location_order int, location_code string, delay_sec int, reported_at timestamp"
    path, kept = scratch_path(spark, "vantage-in"), scratch_path(spark, "vantage-state")
    part, state_rows, seen = scratch_path(spark, "vantage-out"), [], {}

    def deliver(rows):
        spark.createDataFrame([(day, *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)
        stream = streams.latest_vantage(streams.follow(spark, path, spark.createDataFrame([], schema).schema, 1), groups=2)
        q = stream.writeStream.outputMode("append").option("checkpointLocation", kept).trigger(availableNow=True).format("parquet").option("path", part).start()
        q.awaitTermination()
        state_rows.extend(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
        closed = spark.read.schema(streams.VANTAGE_SCHEMA).parquet(part).collect()
        new = {r["train_code"]: (r["location_order"], r["location_code"], r["delay_sec"]) for r in closed if r["train_code"] not in seen}
        assert len(closed) == len(seen) + len(new)
        seen.update(new)
        return new

    # Twenty trains, the last report of train n at hour n; of two reports of a stop the later made counts.
    first = [(f"T{n}", 1, "A", n, at(0)) for n in range(20)] + [(f"T{n}", 2, "B", 60 * n, at(n)) for n in range(20)] + [(None, 3, "N", 5, at(19))]
    closed = deliver(first + [("T7", 2, "OLD", 1, at(6, 59)), ("T8", 2, "NEW", 2, at(8, 1))])
    # The watermark is at 13:00, so the trains before are closed; T13's closing time is not passed.
    assert closed == {f"T{n}": (2, "NEW", 2) if n == 8 else (2, "B", 60 * n) for n in range(13)}
    assert 0 < max(state_rows) <= 2
    # T13 goes on, T19 gets a late report of an earlier stop, and the clock moves to 19:00.
    closed = deliver([("T13", 3, "C", 9, at(18)), ("T19", 1, "LATE", 0, at(14)), ("T14", 2, "AGAIN", 3, at(25))])
    assert closed == {**{f"T{n}": (2, "B", 60 * n) for n in (15, 16, 17, 18)}, "T13": (3, "C", 9)}
    closed = deliver([("far", 1, "Z", 0, at(100))])
    assert closed == {"T14": (2, "AGAIN", 3), "T19": (2, "B", 1140), None: (3, "N", 5)}


def test_many_small_files_are_checked_in_few_tasks_and_once(spark, tmp_path):
    day = tmp_path / "2026-08-25"
    day.mkdir()
    tasks = 4 * spark.sparkContext.defaultParallelism
    for i in range(31 * tasks + 400):
        (day / f"A{i}.xml.gz").write_bytes(gzip.compress(b"<a>x</a>") if i % 5 else b"no")
    checked = logs.checked_files(spark, str(tmp_path))
    assert checked.rdd.getNumPartitions() <= tasks
    held = checked.cache()
    c = logs.census(spark, str(tmp_path), empty_max=0, checked=held)
    assert (c.first()["files"], c.first()["unreadable"]) == (held.count(), held.where("size is null").count())
    assert c.collect() == logs.census(spark, str(tmp_path), empty_max=0).collect()
    held.unpersist()
