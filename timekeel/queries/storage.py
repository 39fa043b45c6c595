"""Readers and writers, round trip: the views are written as the feed or the logs hold them
and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import times
from ..operators import calibration, journeys, metrics, rollup
from ..session import scratch_path, settle
from ..sources import feeds, logs, sinks
from .oracle_views import VIEWS
from .registry import fixed_sql, query, shown
from .scores import ACC, scored

KEYS = list(journeys.JOURNEY)


def feed_rows(spark, sf):
    """Named movements under the feed's field names, as text."""
    m = views.named_movements(views.movements(spark, sf)[0])
    clock = lambda c: F.coalesce(times.clock_text(c), F.lit(""))
    dep = F.when(F.col("location_order") % 4 != 0, F.col("arr_sec") + 60)
    return m.select(
        F.concat("train_code", F.lit("  ")).alias("TrainCode"), times.feed_date_text("service_date").alias("TrainDate"),
        F.lower("location_code").alias("LocationCode"), F.col("location_name").alias("LocationFullName"),
        F.col("location_order").cast("string").alias("LocationOrder"), F.col("location_type").alias("LocationType"),
        F.lit("A").alias("TrainOrigin"), F.lit("B").alias("TrainDestination"), clock("sched_sec").alias("ScheduledArrival"),
        clock(F.col("sched_sec") + 30).alias("ScheduledDeparture"), clock("arr_sec").alias("Arrival"), clock(dep).alias("Departure"),
        F.col("auto_arrival").alias("AutoArrival"), F.lit("1").alias("AutoDepart"), F.col("service_date").cast("string").alias("date"),
        F.concat_ws("-", "service_date", "train_code").alias("_file"))


def written_feed(spark, sf):
    path = scratch_path(spark, "feed") + "/"
    rows = feed_rows(spark, sf)
    (rows.repartition(8, "_file").drop("_file").write.format("xml").option("rowTag", "objTrainMovements")
     .option("rootTag", "ArrayOfObjTrainMovements").option("compression", "gzip").partitionBy("date").save(path))
    return path


VIEWS["feed_rows"] = """
  SELECT *, sched_sec AS s, (sched_sec + 30) % 86400 AS sd, CASE WHEN location_order % 4 <> 0 THEN (arr_sec + 60) % 86400 END AS dep_sec FROM named"""


@query("movements_from_xml_s1", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, location_code, location_name, location_type,
       CASE WHEN s <> 0 THEN s END AS sched_sec, CASE WHEN arr_sec <> 0 THEN arr_sec END AS arr_sec, auto_arrival, 'A' AS train_origin, 'B' AS train_destination FROM feed_rows""")
def movements_from_xml(spark, sf):
    raw = feeds.read_movements(spark, written_feed(spark, sf))
    return shown(feeds.as_stops(feeds.parse_movements(raw)))


@query("parsed_delays_p3_p10", """
SELECT coalesce((arr - s0 + 129600) % 86400 - 43200, -99999) AS arrival_delay_sec, arr = s0 AS is_exact_match, count(*) AS n
FROM (SELECT CASE WHEN s <> 0 THEN s END AS s0, CASE WHEN arr_sec <> 0 THEN arr_sec END AS arr FROM feed_rows) GROUP BY 1, 2""")
def parsed_delays(spark, sf):
    parsed = feeds.parse_movements(feeds.read_movements(spark, written_feed(spark, sf)))
    return parsed.groupBy(F.coalesce("arrival_delay_sec", F.lit(-99999)).alias("arrival_delay_sec"), "is_exact_match").agg(F.count(F.lit(1)).alias("n"))


@query("tag_drift_s2", """
SELECT 'Platform' AS tag, 'unexpected' AS drift, count(*) FILTER (location_order % 3 = 0) AS n FROM feed_rows
UNION ALL SELECT 'Remark', 'unexpected', count(*) FROM feed_rows
UNION ALL SELECT tag, 'missing', 0 FROM (VALUES ('ExpectedArrival'), ('ExpectedDeparture'), ('StopType')) AS v(tag) WHERE (SELECT count(*) FROM feed_rows) > 0""")
def tag_drift(spark, sf):
    """The feed with two fields more: one on every third row, one that is always empty."""
    path = scratch_path(spark, "drift")
    rows = feed_rows(spark, sf).drop("_file", "date").withColumn("Platform", F.when(F.col("LocationOrder") % 3 == 0, "1"))
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c} k='v'>" if c == "Platform" else f"<{c}>"), F.col(c).cast("string"), F.lit(f"</{c}>"))) for c in rows.columns]
    row = F.concat(F.lit("<objTrainMovements>"), F.concat_ws("", *fields), F.lit("<Remark/></objTrainMovements>"))
    head = spark.range(1).select(F.lit("<ArrayOfObjTrainMovements xmlns='x'>").alias("value"))
    head.unionByName(rows.select(row.alias("value"))).write.text(path)
    out = feeds.tag_drift(spark, path, "objTrainMovements", feeds.MOVEMENT_FIELDS)
    return out.select("tag", "drift", F.col("count").alias("n"))


@query("boards_from_xml_s3", """
SELECT station_code, upper(train_code) AS "Traincode", strftime(service_date, '%d %b %Y') AS "Traindate",
       concat(lpad(CAST(eta_sec // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST(eta_sec % 3600 // 60 AS VARCHAR), 2, '0')) AS "Exparrival", '2024-02-01 10:05:00' AS polled_at, count(*) AS n
FROM (SELECT *, location_code AS station_code FROM polls) GROUP BY 1, 2, 3, 4, 5""")
def boards_from_xml(spark, sf):
    p = views.polls(views.movements(spark, sf)[0])
    base = scratch_path(spark, "boards")
    rows = p.select(
        F.col("train_code").alias("Traincode"), times.feed_date_text("service_date").alias("Traindate"), F.col("location_code").alias("Stationcode"),
        F.substring(times.clock_text("eta_sec"), 1, 5).alias("Exparrival"), F.concat(F.lit("20240201T100500Z_"), F.col("location_code"), F.lit(".xml")).alias("file"))
    rows.write.format("xml").option("rowTag", "objStationData").option("rootTag", "ArrayOfObjStationData").partitionBy("file").save(base)
    named = feeds.read_boards(spark, base).withColumn("polled_at", F.col("polled_at").cast("string"))
    return named.groupBy("station_code", "Traincode", "Traindate", "Exparrival", "polled_at").agg(F.count(F.lit(1)).alias("n"))


@query("fleet_from_xml_s4", """
SELECT upper(trim(train)) AS train, status, count(*) AS n, count(*) FILTER (lat <> 0 OR lon <> 0) AS placed,
       CAST(sum(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS lines FROM fleet GROUP BY 1, 2""")
def fleet_from_xml(spark, sf):
    r = views.reports(spark, sf).select(
        F.col("train").alias("TrainCode"), F.col("status").alias("TrainStatus"), F.col("lat").cast("string").alias("TrainLatitude"),
        F.col("lon").cast("string").alias("TrainLongitude"), F.col("message").alias("PublicMessage"), F.lit("N").alias("Direction"))
    path = scratch_path(spark, "fleet")
    r.write.format("xml").option("rowTag", "objTrainPositions").option("rootTag", "ArrayOfObjTrainPositions").save(path)
    got = feeds.read_fleet(spark, path)
    return got.groupBy("train", "status").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("placed"), F.sum(F.size("message")).alias("lines"))


@query("stations_from_xml_s6", f"SELECT code, name, {fixed_sql('lat')} AS lat, {fixed_sql('lon')} AS lon FROM stations")
def stations_from_xml(spark, sf):
    st = views.stations(views.movements(spark, sf)[0])
    path = scratch_path(spark, "stations")
    st.select(F.col("name").alias("StationDesc"), F.col("lat").cast("string").alias("StationLatitude"), F.col("lon").cast("string").alias("StationLongitude"),
              F.concat(F.lower("code"), F.lit(" ")).alias("StationCode")).write.format("xml").option("rowTag", "objStation").option("rootTag", "ArrayOfObjStation").save(path)
    return shown(feeds.read_stations(spark, path).select("code", "name", "lat", "lon"))


def written_scores(spark, sf):
    path = scratch_path(spark, "scores")
    s = scored(spark, sf).withColumn("date", F.col("service_date").cast("string"))
    sinks.write_scores(s, path)
    return path, s.schema


@query("scores_as_json_k4_s7", """
SELECT CAST(service_date AS VARCHAR) AS date, score_state, count(*) AS n, CAST(sum(actual_delay_sec) AS BIGINT) AS total FROM scores GROUP BY 1, 2""")
def scores_as_json(spark, sf):
    path, schema = written_scores(spark, sf)
    return logs.read_jsonl(spark, path, schema).groupBy("date", "score_state").agg(F.count(F.lit(1)).alias("n"), F.sum("actual_delay_sec").alias("total")).withColumn("date", F.col("date").cast("string"))


@query("projected_rollup_read_s8", f"SELECT station_group, {ACC} FROM clean GROUP BY 1")
def projected_rollup_read(spark, sf):
    path, schema = written_scores(spark, sf)
    rows = logs.read_jsonl(spark, path, schema, fields=logs.ROLLUP_FIELDS).where("score_state = 'scored'")
    return shown(rows.groupBy("station_group").agg(*metrics.accuracy()))


@query("calibration_from_written_scores_k9", "SELECT * FROM cal")
def calibration_from_written_scores(spark, sf):
    """The scores are on storage before anything derived from them is computed."""
    path, schema = written_scores(spark, sf)
    rows = logs.read_jsonl(spark, path, schema, fields=logs.CALIBRATION_FIELDS)
    return calibration.fit(calibration.residuals(rows))


def archive(spark, sf):
    path = scratch_path(spark, "archive")
    m = journeys.with_delay(views.movements(spark, sf)[0]).withColumn("date", F.col("service_date").cast("string"))
    sinks.write_partitioned(m, path, ("date",))
    return path, m


@query("archive_filtered_s9_k1", """
SELECT train_code, location_order, delay_sec FROM prep WHERE service_date = DATE '2024-01-13' AND station_group = 'view'""")
def archive_filtered(spark, sf):
    path, _ = archive(spark, sf)
    return logs.read_archive(spark, path, ["train_code", "location_order", "delay_sec"], (F.col("date") == "2024-01-13") & (F.col("station_group") == "view"))


@query("partition_inventory_s16", "SELECT DISTINCT CAST(service_date AS VARCHAR) AS date FROM movements")
def partition_inventory(spark, sf):
    path, _ = archive(spark, sf)
    return logs.partitions(spark.read.parquet(path)).withColumn("date", F.col("date").cast("string"))


@query("pending_partitions_k3", "SELECT CAST(service_date AS VARCHAR) AS date, count(*) AS n FROM movements WHERE service_date >= DATE '2024-01-15' GROUP BY 1")
def pending_partitions(spark, sf):
    m = views.movements(spark, sf)[0].withColumn("date", F.col("service_date").cast("string"))
    path = scratch_path(spark, "half")
    sinks.write_partitioned(m.where("date < '2024-01-15'"), path, ("date",))
    return sinks.pending(m, path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("examples_by_split_k2_u4", """
SELECT split, CAST(service_date AS VARCHAR) AS date, count(*) AS n FROM (
  SELECT *, CASE WHEN service_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14' THEN 'train' WHEN service_date <= DATE '2024-01-20' THEN 'val' ELSE 'test' END AS split FROM examples) GROUP BY 1, 2""")
def examples_by_split(spark, sf):
    from .journeys import examples
    split = times.split_of("service_date", {"train": ("2024-01-01", "2024-01-14"), "val": ("2024-01-15", "2024-01-20"), "test": ("2024-01-21", "2024-01-31")})
    ex = examples(spark, sf).withColumns({"split": split, "date": F.col("service_date").cast("string")})
    path = scratch_path(spark, "examples")
    sinks.write_partitioned(ex, path, ("split", "date"))
    parts = [spark.read.parquet(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.groupBy("split", F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("published_document_k6", """
SELECT lead_band, count(*) AS n FROM clean GROUP BY 1""")
def published_document(spark, sf):
    clean = scored(spark, sf).where("score_state = 'scored'")
    doc = rollup.document(clean.groupBy("lead_band").agg(F.count(F.lit(1)).alias("n")), "lead_band")
    path = scratch_path(spark, "doc")
    sinks.publish(doc, path, path + "-copy")
    back = sinks.published(spark, path + "-copy").select(F.from_json("value", "map<string, struct<n: bigint>>").alias("m"))
    return back.select(F.explode("m").alias("lead_band", "v")).select("lead_band", F.col("v.n").alias("n"))


def log_rows(spark, sf):
    p = views.predictions(*views.movements(spark, sf))
    return p.select(
        "outcome", F.col("made_sec").cast("string").alias("predicted_at"), F.lit("v1").alias("model_version"),
        times.feed_date_text("service_date").alias("train_date"), "train_code", F.col("location_code").alias("station_code"),
        times.clock_text("lead_sec").alias("scheduled_arrival"), F.col("q10_sec").alias("pred_q10_sec"), F.col("q50_sec").alias("pred_q50_sec"),
        F.col("q90_sec").alias("pred_q90_sec"), F.when(F.col("outcome") == "declined", "no_upstream_report").alias("reason"))


@query("prediction_log_k7", """
SELECT CAST(service_date AS VARCHAR) AS date, outcome, count(*) AS n FROM predictions GROUP BY 1, 2""")
def prediction_log(spark, sf):
    path = scratch_path(spark, "log")
    rows = log_rows(spark, sf)
    sinks.append_predictions(rows, path, times.feed_date("train_date"))
    back = spark.read.schema(rows.schema.add("prediction_id", "string").add("date", "string")).json(path)
    return back.where("prediction_id IS NOT NULL").groupBy("date", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("log_violations_v1", """
SELECT missing, count(*) AS n FROM (SELECT CASE WHEN outcome = 'declined' THEN CASE WHEN location_order % 5 = 0 THEN 'reason' END
   WHEN location_order % 7 = 0 THEN CASE WHEN location_order % 11 = 0 THEN 'train_code,pred_q50_sec' ELSE 'pred_q50_sec' END WHEN location_order % 11 = 0 THEN 'train_code' END AS missing FROM predictions
   WHERE outcome = 'predicted' OR location_order % 11 <> 0) WHERE missing IS NOT NULL GROUP BY 1""")
def log_violations(spark, sf):
    p = views.predictions(*views.movements(spark, sf)).where("outcome = 'predicted' OR location_order % 11 <> 0")
    o = F.col("location_order")
    rows = p.select(
        "outcome", F.lit("t").alias("predicted_at"), F.lit("v").alias("model_version"), F.lit("d").alias("train_date"),
        F.when((o % 11 != 0), F.col("train_code")).alias("train_code"), F.col("location_code").alias("station_code"), F.lit("10:00").alias("scheduled_arrival"),
        F.col("q10_sec").alias("pred_q10_sec"), F.when(o % 7 != 0, F.col("q50_sec")).alias("pred_q50_sec"), F.col("q90_sec").alias("pred_q90_sec"),
        F.when((F.col("outcome") == "declined") & (o % 5 != 0), "r").alias("reason"))
    return sinks.violations(rows).groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("usable_polls_s10_j9", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, poll_sec, CASE WHEN eta_sec % 86400 = 0 THEN NULL ELSE eta_sec END AS eta_sec FROM polls
WHERE location_order % 12 <> 0 AND eta_sec <> 0""")
def usable_polls(spark, sf):
    p = views.polls(views.movements(spark, sf)[0])
    at = F.timestamp_seconds(F.unix_date("service_date").cast("bigint") * 86400 + F.col("poll_sec"))
    rows = p.select(
        F.concat(F.lower("train_code"), F.lit(" ")).alias("Traincode"),
        F.when(F.col("location_order") % 12 != 0, times.feed_date_text("service_date")).otherwise("soon").alias("Traindate"),
        F.col("location_code").alias("station_code"), F.substring(times.clock_text("eta_sec"), 1, 5).alias("Exparrival"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("polled_at"), F.date_format(at, "yyyy-MM-dd").alias("date"))
    path = scratch_path(spark, "live")
    rows.write.partitionBy("date").option("compression", "gzip").json(path)
    good, _ = logs.usable_polls(spark.read.schema(rows.schema).json(path))
    return shown(good.select(*KEYS, "location_code", F.col("poll_sec").cast("int").alias("poll_sec"), "eta_sec"))


@query("dead_letters_k8", """
SELECT 'good' AS part, count(*) AS n FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 10 = 0""")
def dead_letters(spark, sf):
    e = views.table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    path = scratch_path(spark, "lines")
    e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    good, bad = logs.split_corrupt(spark, path, e.select("event_id", "event_type").schema)
    sinks.dead_letter(bad, path + "-dead", "unparseable")
    kept = spark.read.schema("value string, kind string").json(path + "-dead")
    return good.agg(F.count("event_id").alias("n")).select(F.lit("good").alias("part"), "n").unionByName(
        kept.where("kind = 'unparseable'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("part"), "n"))


@query("code_list_s13", "SELECT DISTINCT concat('T', CAST(user_id AS VARCHAR)) AS code FROM events")
def code_list(spark, sf):
    s = views.table(spark, sf, "events").groupBy(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("code")).agg(F.min("ts").cast("string").alias("first_seen"))
    path = scratch_path(spark, "codes")
    entries = F.map_from_entries(F.collect_list(F.struct("code", F.struct("first_seen"))))
    s.agg(F.to_json(F.struct(entries.alias("codes"))).alias("value")).coalesce(1).write.text(path)
    return logs.read_codes(spark, path)


VIEWS["journey_files"] = """
  SELECT CAST(service_date AS VARCHAR) AS date, train_code, CAST(substr(train_code, 2) AS INT) AS u, string_agg(location_code, '' ORDER BY location_order) AS body FROM movements GROUP BY 1, 2, 3"""


@query("archive_census_s15", f"""
SELECT date, count(*) FILTER (u % 10 <> 9) AS files, count(*) FILTER (u % 10 = 1) AS empty, count(*) FILTER (u % 10 IN (2, 3)) AS unreadable,
       count(*) FILTER (u % 10 = 4) AS unparseable, count(*) FILTER (u % 10 = 9) AS strays,
       CAST(sum(CASE WHEN u % 10 = 1 THEN 0 WHEN u % 10 = 4 THEN length(body) + 3 WHEN u % 10 <> 9 AND u % 10 NOT IN (2, 3) THEN length(body) + 7 END) AS BIGINT) AS plain,
       {fixed_sql('quantile_cont(CASE WHEN u % 10 = 1 THEN 0 WHEN u % 10 = 4 THEN length(body) + 3 WHEN u % 10 <> 9 AND u % 10 NOT IN (2, 3) THEN length(body) + 7 END, 0.5)')} AS median_size
FROM journey_files GROUP BY 1""")
def archive_census(spark, sf):
    """One file a journey: whole, empty, cut off, not compressed at all, with a tag left open, or stray."""
    moves = views.movements(spark, sf)[0].select(F.col("service_date").cast("string").alias("date"), "train_code", "location_order", "location_code")
    files = moves.groupBy("date", "train_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("location_order", "location_code"))), lambda x: x["location_code"]), "").alias("body"))
    root = scratch_path(spark, "archive")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    local = fs.getScheme() == "file"

    def write(batches):
        """Local, so it travels to the workers by value."""
        import gzip
        import os

        import pyarrow as pa

        made = set()
        for b in batches:
            for date, train, body in zip(*(c.to_pylist() for c in b.columns)):
                kind = int(train[1:]) % 10
                text = b"" if kind == 1 else f"<a>{body}{'' if kind == 4 else '</a>'}".encode()
                packed = text if kind == 3 else gzip.compress(text)
                folder = f"{root.removeprefix('file://')}/{date}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(f"{folder}/{train}.xml.gz" + (".tmp" if kind == 9 else ""), "wb") as f:
                    f.write(packed[:len(packed) // 2] if kind == 2 else packed)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    if not local:
        raise ValueError("this check writes files by name, so the shared folder must be a mounted one")
    files.select("date", "train_code", "body").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    checked = settle(logs.checked_files(spark, root), "checked")  # every file is listed and opened once
    sizes = checked.where(~F.col("path").endswith(".tmp")).withColumn("date", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1)).groupBy("date").agg(F.sum("size").alias("plain"))
    c = logs.census(spark, root, empty_max=0, checked=checked).join(sizes, "date")
    return shown(c.select("date", "files", "empty", "unreadable", "unparseable", "strays", "plain", "median_size"))


VIEWS["cycle_docs"] = """
  SELECT side, cycle_sec, CASE WHEN side = 'local' AND floor(cycle_sec / 300) % 11 = 0 THEN 0 ELSE count(*) END AS records,
         CASE WHEN side = 'cloud' AND floor(cycle_sec / 300) % 13 = 0 THEN 'failed' ELSE 'complete' END AS status FROM captures GROUP BY 1, 2"""


@query("two_archives_s11", """
SELECT side, station_group, count(*) AS n, count(DISTINCT cycle_sec) AS cycles, CAST(sum(eta) AS BIGINT) AS eta FROM captures c
JOIN cycle_docs d USING (side, cycle_sec) WHERE records > 0 AND status <> 'failed' GROUP BY 1, 2""")
def two_archives(spark, sf):
    """The local archive as plain lines, the cloud's compressed and by date; some cycles are barren or failed."""
    rows = views.captures(spark, sf).withColumn("date", F.timestamp_seconds("cycle_sec").cast("date"))
    late = F.floor(F.col("cycle_sec") / 300)
    docs = rows.groupBy("side", "cycle_sec", "date").agg(F.count(F.lit(1)).alias("records")).withColumns({
        "records": F.when((F.col("side") == "local") & (late % 11 == 0), 0).otherwise(F.col("records")),
        "status": F.when((F.col("side") == "cloud") & (late % 13 == 0), "failed").otherwise("complete")})
    base = {s: scratch_path(spark, s) for s in ("local", "cloud")}
    for df, kind in ((rows, "expected"), (docs, "cycles")):
        df.where("side = 'local'").drop("side", "date").write.json(f"{base['local']}/{kind}")
        df.where("side = 'cloud'").drop("side").write.partitionBy("date").option("compression", "gzip").json(f"{base['cloud']}/{kind}")
    both = logs.two_archives(spark, base["local"], base["cloud"], rows.drop("side", "date").schema)
    return both.groupBy("side", "station_group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cycle_sec").alias("cycles"), F.sum("eta").alias("eta"))


@query("documents_read_s14", """
SELECT CAST(service_date AS VARCHAR) AS service_date, events, n FROM days""")
def documents_read(spark, sf):
    days = rollup.day_summary(scored(spark, sf)).select(F.col("service_date").cast("string").alias("service_date"), "events", "n")
    path = scratch_path(spark, "summaries")
    days.write.option("maxRecordsPerFile", 1).json(path)
    return logs.read_document(spark, path, days.schema)


@query("newest_snapshot_m11", "SELECT CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS newest, 12.0::DOUBLE AS age_hours, true AS fresh FROM events")
def newest_snapshot(spark, sf):
    """The newest stamp in the file names, and the guard that refuses an old archive."""
    r = views.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'000000'Z'").alias("stamp"))
    path = scratch_path(spark, "snapshots")
    r.select(F.col("event_id").cast("string").alias("value"), "stamp").write.partitionBy("stamp").text(path)
    newest = logs.newest_stamp(spark, path + "/*")
    now = newest.select(F.col("newest") + F.expr("INTERVAL 12 HOURS")).scalar()
    out = logs.refuse_stale(newest, now)
    return shown(out.withColumn("newest", F.col("newest").cast("date")))
