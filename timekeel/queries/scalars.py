"""Clock, date and key rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import times, values
from ..operators import journeys
from .oracle_views import band_sql
from .registry import query, shown


@query("clock_to_seconds_p1", """
SELECT event_id, CASE WHEN h = 0 AND m = 0 AND s = 0 THEN NULL WHEN k % 9 = 0 THEN NULL ELSE h * 3600 + m * 60 + CASE WHEN k % 2 = 0 THEN s ELSE 0 END END AS sec
FROM (SELECT event_id, CAST(EXTRACT(HOUR FROM ts) AS INT) AS h, CAST(EXTRACT(MINUTE FROM ts) AS INT) AS m, CAST(floor(EXTRACT(SECOND FROM ts)) AS INT) AS s,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
WHERE NOT (h = 0 AND m = 0)""")
def clock_to_seconds(spark, sf):
    e = views.table(spark, sf, "events").where("hour(ts) > 0 OR minute(ts) > 0")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    text = F.when(k % 9 == 0, "n/a").when(k % 2 == 0, F.date_format("ts", " HH:mm:ss")).otherwise(F.date_format("ts", "HH:mm"))
    return e.select("event_id", times.clock_seconds(text).alias("sec"))


@query("seconds_to_clock_p2", """
SELECT sched_abs, concat(lpad(CAST(sched_abs % 86400 // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST(sched_abs % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(sched_abs % 60 AS VARCHAR), 2, '0')) AS clock, count(*) AS n
FROM prep GROUP BY 1, 2""")
def seconds_to_clock(spark, sf):
    moves, t = views.movements(spark, sf)
    prep = journeys.unwrapped(moves, t).groupBy("sched_abs").agg(F.count(F.lit(1)).alias("n"))
    return prep.select("sched_abs", times.clock_text("sched_abs").alias("clock"), "n")


@query("feed_dates_p5", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%d %b %Y') AS feed_text, count(*) AS n FROM events GROUP BY 1, 2""")
def feed_dates(spark, sf):
    e = views.table(spark, sf, "events")
    odd = F.when(F.col("event_id") % 3 == 0, F.upper(F.date_format("ts", "d MMMM yyyy"))).otherwise(F.date_format("ts", " dd  MMM yyyy"))
    day = times.feed_date(odd)
    out = e.groupBy(day.alias("day"), times.feed_date_text(day).alias("feed_text")).agg(F.count(F.lit(1)).alias("n"))
    return shown(out)


@query("service_seconds_p6_p7", """
SELECT event_id, CAST(epoch(date_trunc('second', ts)) - epoch(CAST(CAST(ts AS DATE) - 1 AS TIMESTAMP)) AS BIGINT) AS sec FROM events""")
def service_seconds(spark, sf):
    """January: local time is UTC, so the naive text and the zoned text agree."""
    e = views.table(spark, sf, "events")
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    wall = times.local_stamp(stamp)
    day = F.date_sub(F.col("ts").cast("date"), 1)
    return e.select("event_id", times.service_seconds(wall, day).cast("bigint").alias("sec"))


@query("quiet_hours_p8", """
SELECT CAST(CAST(w AS DATE) AS VARCHAR) AS local_day, count(*) FILTER (strftime(w, '%H:%M:%S') >= '00:30:00' AND strftime(w, '%H:%M:%S') < '05:30:00') AS quiet, count(*) AS n
FROM (SELECT CAST(ts AS TIMESTAMP) + INTERVAL 180 DAY + INTERVAL 1 HOUR AS w FROM events) GROUP BY 1""")
def quiet_hours(spark, sf):
    """The same instants half a year on, when local time is an hour ahead of UTC."""
    e = views.table(spark, sf, "events")
    wall = times.local_time(F.col("ts").cast("timestamp") + F.expr("INTERVAL 180 DAYS"))
    return shown(e.select(wall.alias("w")).groupBy(F.col("w").cast("date").alias("local_day")).agg(
        F.count_if(times.in_quiet_hours("w")).alias("quiet"), F.count(F.lit(1)).alias("n")))


@query("key_normalised_p20", "SELECT upper(trim(c_mktsegment)) AS key, count(*) AS n FROM customer GROUP BY 1")
def key_normalised(spark, sf):
    c = views.table(spark, sf, "customer")
    messy = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("\t "))
    return c.groupBy(times.key(messy).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("quantiles_rearranged_p24", """
SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (a > b OR b > c) AS crossings, count(*) FILTER (q[1] > q[2] OR q[2] > q[3]) AS after FROM (
  SELECT a, b, c, list_sort([a, b, c]) AS q FROM (SELECT q10_sec + CASE WHEN location_order % 4 = 0 THEN 90 ELSE 0 END AS a, q50_sec AS b, q90_sec AS c FROM predictions WHERE q50_sec IS NOT NULL))""")
def quantiles_rearranged(spark, sf):
    p = views.predictions(*views.movements(spark, sf)).where("q50_sec IS NOT NULL")
    a = F.col("q10_sec") + F.when(F.col("location_order") % 4 == 0, 90).otherwise(0)
    r = p.select(values.crosses(a, "q50_sec", "q90_sec").alias("x"), values.rearranged(a, "q50_sec", "q90_sec").alias("q"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("x").alias("crossings"),
                 F.count_if(values.crosses(F.col("q")[0], F.col("q")[1], F.col("q")[2])).alias("after"))


@query("settled_days_m10", """
SELECT CAST(service_date AS VARCHAR) AS service_date, TIMESTAMP '2024-01-20 05:00:00' >= CAST(service_date + 1 AS TIMESTAMP) + INTERVAL 6 HOUR AS settled, count(*) AS n FROM movements GROUP BY 1, 2""")
def settled_days(spark, sf):
    moves, _ = views.movements(spark, sf)
    now = F.lit("2024-01-20 05:00:00").cast("timestamp")
    return shown(moves.groupBy("service_date", times.is_settled("service_date", now).alias("settled")).agg(F.count(F.lit(1)).alias("n")))


@query("inlined_sql_functions", f"""
SELECT location_order, tk AS delay_sec, {band_sql('lead_sec')} AS lead_band, count(*) AS n FROM (
  SELECT p.location_order, p.lead_sec, m.delay_sec AS tk FROM predictions p JOIN prep m USING (service_date, train_code, location_order)) GROUP BY 1, 2, 3""")
def inlined_sql_functions(spark, sf):
    from ..functions import sqlfuncs
    sqlfuncs.register(spark)
    moves, t = views.movements(spark, sf)
    p = views.predictions(moves, t).select(*journeys.JOURNEY, "location_order", "lead_sec")
    met = p.join(moves.select(*journeys.JOURNEY, "location_order", "arr_sec", "sched_sec"), [*journeys.JOURNEY, "location_order"])
    return met.select("location_order", F.expr("tk_delay(arr_sec, sched_sec)").alias("delay_sec"), F.expr("tk_lead_band(lead_sec)").alias("lead_band")).groupBy(
        "location_order", "delay_sec", "lead_band").agg(F.count(F.lit(1)).alias("n"))
