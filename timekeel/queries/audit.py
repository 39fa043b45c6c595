"""Label audits, live-to-archive joins, registries and work lists over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import values
from ..operators import audit, journeys
from .oracle_views import VIEWS
from .registry import fixed_sql, query, shown

NAMES = ", ".join(f"'{n}'" for n in views.STATION_NAMES)
VIEWS["named"] = f"""
  SELECT *, CASE WHEN location_order % 13 = 0 THEN '' WHEN location_order % 7 = 0 THEN upper(nm) ELSE nm END AS location_name,
         CASE WHEN location_order = 1 THEN 'O' WHEN n IN (5, 10, 15) THEN 'T' WHEN n = 19 THEN 'D' ELSE 'S' END AS location_type
  FROM (SELECT *, CAST(substr(location_code, 2) AS INT) AS n, [{NAMES}][CAST(substr(location_code, 2) AS INT) + 1] AS nm FROM movements)"""
COUNTS = """count(*) AS records, count(arr_sec) AS arrivals, count(*) FILTER (arr_sec IS NOT NULL AND sched_sec IS NOT NULL) AS comparable,
       count(*) FILTER (arr_sec = sched_sec) AS exact"""
VIEWS["locations"] = f"""
  SELECT b.*, coalesce(n.location_name, '') AS location_name, t.location_type, 100.0 * exact / nullif(comparable, 0) AS exact_pct
  FROM (SELECT location_code, {COUNTS} FROM named GROUP BY 1) b
  LEFT JOIN (SELECT location_code, location_name FROM (SELECT location_code, location_name, row_number() OVER (PARTITION BY location_code ORDER BY count(*) DESC, location_name) AS rn
             FROM named WHERE location_name <> '' GROUP BY 1, 2) WHERE rn = 1) n USING (location_code)
  LEFT JOIN (SELECT location_code, location_type FROM (SELECT location_code, location_type, row_number() OVER (PARTITION BY location_code ORDER BY count(*) DESC, location_type) AS rn
             FROM named GROUP BY 1, 2) WHERE rn = 1) t USING (location_code)"""
WORDS = "|".join(values.WEAK_LINE_WORDS)
KEYWORD = f"lower(regexp_extract(location_name, '(?i)\\b({WORDS})\\b', 1))"


def named(spark, sf):
    return views.named_movements(views.movements(spark, sf)[0])


@query("coverage_by_location_a13", f"""
SELECT location_code, records, arrivals, comparable, exact, location_name, location_type, {fixed_sql('exact_pct')} AS exact_pct FROM locations""")
def coverage_by_location(spark, sf):
    return shown(audit.by_location(named(spark, sf)))


@query("weak_line_keyword_p19", f"""
SELECT location_code, location_name, {KEYWORD} AS keyword,
       CASE WHEN location_name = '' THEN 'unnamed' WHEN {KEYWORD} <> '' THEN 'flagged' ELSE 'unflagged' END AS line FROM locations""")
def weak_line_keyword(spark, sf):
    return audit.line_class(audit.by_location(named(spark, sf))).select("location_code", "location_name", "keyword", "line")


@query("weak_line_words_in_documents_p19", f"""
SELECT lang, lower(regexp_extract(text, '(?i)\\b({WORDS})\\b', 1)) AS keyword, count(*) AS n FROM documents GROUP BY 1, 2""")
def weak_line_words_in_documents(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.groupBy("lang", values.weak_line_word("text").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


@query("flagged_lines_a14", f"""
SELECT CASE WHEN location_name = '' THEN 'unnamed' WHEN {KEYWORD} <> '' THEN 'flagged' ELSE 'unflagged' END AS line, count(*) AS locations,
       CAST(sum(records) AS BIGINT) AS records, CAST(sum(arrivals) AS BIGINT) AS arrivals, CAST(sum(comparable) AS BIGINT) AS comparable, CAST(sum(exact) AS BIGINT) AS exact
FROM locations GROUP BY 1""")
def flagged_lines(spark, sf):
    return audit.totals(audit.line_class(audit.by_location(named(spark, sf))), "line")


@query("location_types_a14", f"""
SELECT CASE WHEN location_type IN ('O', 'S', 'D') THEN 'passenger' ELSE 'timing' END AS part, location_type, {COUNTS} FROM named GROUP BY 1, 2
UNION ALL SELECT CASE WHEN location_type IN ('O', 'S', 'D') THEN 'passenger' ELSE 'timing' END, NULL, {COUNTS} FROM named GROUP BY 1""")
def location_types(spark, sf):
    return audit.by_type(named(spark, sf))


FLAGGED = f"coalesce({KEYWORD} <> '', false)"
VIEWS["cells"] = f"""
  SELECT {FLAGGED} AS flagged, auto_arrival, count(*) AS comparable, count(*) FILTER (arr_sec = sched_sec) AS exact
  FROM named WHERE arr_sec IS NOT NULL AND sched_sec IS NOT NULL GROUP BY 1, 2"""


@query("echo_cells_a15", f"""
SELECT flagged, auto_arrival, CAST(sum(comparable) AS BIGINT) AS comparable, CAST(sum(exact) AS BIGINT) AS exact FROM cells GROUP BY CUBE (flagged, auto_arrival)""")
def echo_cells(spark, sf):
    return audit.echo_cells(named(spark, sf))


@query("standardised_echo_a15", f"""
SELECT {fixed_sql('100 * sum(f_exact) / sum(f_n)')} AS flagged_pct, {fixed_sql('100 * sum(o_exact) / sum(o_n)')} AS other_pct,
       {fixed_sql('100 * sum(o_n * f_exact / f_n) / sum(o_n)')} AS flagged_at_other_mix_pct
FROM (SELECT auto_arrival, sum(comparable) FILTER (flagged) AS f_n, sum(exact) FILTER (flagged) AS f_exact,
             sum(comparable) FILTER (NOT flagged) AS o_n, sum(exact) FILTER (NOT flagged) AS o_exact FROM cells GROUP BY 1)""")
def standardised_echo(spark, sf):
    return shown(audit.standardised_echo(audit.echo_cells(named(spark, sf))))


@query("top_echo_locations_l2", f"""
SELECT location_code, comparable, exact, {fixed_sql('exact_pct')} AS exact_pct FROM locations WHERE comparable >= 30
ORDER BY exact_pct DESC NULLS LAST, location_code LIMIT 5""")
def top_echo_locations(spark, sf):
    top = audit.ranked_locations(audit.by_location(named(spark, sf)), 5)
    return shown(top.select("location_code", "comparable", "exact", "exact_pct"))


@query("held_out_locations_l2", "SELECT count(*) FILTER (comparable < 30) AS held, count(*) AS locations FROM locations")
def held_out(spark, sf):
    return audit.held_out(audit.by_location(named(spark, sf)))


VIEWS["live"] = """
  SELECT CASE WHEN location_order % 18 = 0 THEN service_date + 1 ELSE service_date END AS service_date,
         CASE WHEN location_order % 14 = 0 THEN concat('N', train_code) ELSE train_code END AS train_code,
         CASE WHEN location_order % 10 = 0 THEN 'S99' ELSE location_code END AS location_code,
         station_group, poll_sec, location_order, CASE WHEN eta_sec % 7 <> 0 THEN eta_sec END AS eta_sec FROM polls"""
VIEWS["live_events"] = """
  SELECT service_date, train_code, location_code, count(*) AS polls, bool_or(eta_sec IS NOT NULL) AS has_eta,
         max_by(station_group, CAST(poll_sec AS BIGINT) * 100000 + location_order) AS station_group FROM live GROUP BY ALL"""
VIEWS["facts"] = """
  SELECT service_date, train_code, location_code, delay_sec, auto_arrival FROM (
    SELECT *, row_number() OVER (PARTITION BY service_date, train_code, location_code ORDER BY location_order DESC) AS rn FROM prep) WHERE rn = 1"""
VIEWS["met"] = """
  SELECT e.*, f.delay_sec, f.auto_arrival, f.location_code IS NOT NULL AS hit FROM live_events e
  LEFT JOIN facts f ON e.service_date = f.service_date AND e.train_code = f.train_code AND e.location_code = f.location_code"""


def live_parts(spark, sf):
    moves, _ = views.movements(spark, sf)
    d = journeys.with_delay(moves)
    return audit.collapse_polls(views.live_rows(moves)), audit.stop_facts(d), moves


@query("collapse_polls_a21", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM live_events")
def collapse_polls(spark, sf):
    return shown(live_parts(spark, sf)[0])


@query("match_rate_j4", f"""
SELECT station_group, CAST(0 AS TINYINT) AS is_total, count(*) FILTER (hit) AS matched, count(*) AS events, {fixed_sql('100 * avg(CAST(hit AS INT))')} AS match_pct FROM met GROUP BY 1
UNION ALL SELECT NULL, CAST(1 AS TINYINT), count(*) FILTER (hit), count(*), {fixed_sql('100 * avg(CAST(hit AS INT))')} FROM met""")
def match_rate(spark, sf):
    events, facts, _ = live_parts(spark, sf)
    return shown(audit.match_rate(events, facts))


USE = """count(*) AS events, count(*) FILTER (has_eta) AS eta, count(*) FILTER (delay_sec IS NOT NULL) AS actual,
       count(*) FILTER (has_eta AND delay_sec IS NOT NULL) AS usable, count(*) FILTER (has_eta AND delay_sec IS NOT NULL AND auto_arrival = '1') AS auto"""


@query("usability_j5", f"""
SELECT station_group, CAST(0 AS TINYINT) AS is_total, {USE} FROM met GROUP BY 1 UNION ALL SELECT NULL, CAST(1 AS TINYINT), {USE} FROM met""")
def usability(spark, sf):
    events, facts, _ = live_parts(spark, sf)
    return audit.usability(events, facts)


@query("thin_groups_l6", f"SELECT station_group, auto FROM (SELECT station_group, {USE} FROM met GROUP BY 1) WHERE auto < 400")
def thin_groups(spark, sf):
    events, facts, _ = live_parts(spark, sf)
    return audit.thin_groups(audit.usability(events, facts), floor=400)


@query("missing_dates_j27", """
SELECT CAST(service_date AS VARCHAR) AS service_date FROM (SELECT service_date FROM live_events EXCEPT SELECT service_date FROM movements)""")
def missing_dates(spark, sf):
    events, _, moves = live_parts(spark, sf)
    return shown(audit.missing_dates(events, moves))


VIEWS["reasons"] = """
  SELECT e.service_date, e.train_code, e.location_code,
         CASE WHEN e.service_date NOT IN (SELECT service_date FROM movements) THEN 'date not collected'
              WHEN (e.service_date, e.train_code) IN (SELECT (service_date, train_code) FROM movements) THEN 'station not on route'
              WHEN e.train_code NOT IN (SELECT train_code FROM movements) THEN 'train code unknown'
              ELSE 'known code, no run that date' END AS reason FROM met e WHERE NOT hit"""


@query("unmatched_reasons_j6", """
SELECT reason, max(n) AS n, string_agg(concat(CAST(service_date AS VARCHAR), ' ', train_code, '@', location_code), ', ' ORDER BY service_date, train_code, location_code) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY service_date, train_code, location_code) AS rn, count(*) OVER (PARTITION BY reason) AS n FROM reasons)
WHERE rn <= 4 GROUP BY 1""")
def unmatched_reasons(spark, sf):
    events, _, moves = live_parts(spark, sf)
    return audit.unmatched_reasons(events, moves, moves)


@query("join_verdict_v2", f"""
SELECT match_pct, missing_dates, match_pct >= 95 AND missing_dates = 0 AS passes
FROM (SELECT {fixed_sql('100 * avg(CAST(hit AS INT))')} AS match_pct FROM met),
     (SELECT count(*) AS missing_dates FROM (SELECT service_date FROM live_events EXCEPT SELECT service_date FROM movements))""")
def join_verdict(spark, sf):
    events, facts, moves = live_parts(spark, sf)
    return shown(audit.join_verdict(audit.match_rate(events, facts), audit.missing_dates(events, moves)))


VIEWS["sightings"] = "SELECT concat('T', CAST(user_id AS VARCHAR)) AS code, CAST(ts AS DATE) AS day FROM events"
DAYS = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun']"
VIEWS["registry"] = f"""
  SELECT code, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen,
         array_to_string(list_transform(list_sort(list_distinct(list(isodow(day)))), lambda d: {DAYS}[d]), ',') AS days_of_week,
         min(day) >= DATE '2024-01-15' AS is_new, bool_or(isodow(day) >= 6) AS weekend FROM sightings GROUP BY 1"""


def sightings(spark, sf):
    return views.table(spark, sf, "events").select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("code"), F.col("ts").cast("date").alias("day"))


def registry(spark, sf):
    s = sightings(spark, sf)
    first = s.where("day < DATE '2024-01-15'").groupBy("code").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
        F.collect_set(F.weekday("day")).alias("days_of_week"))
    return audit.merge_registry(first, s.where("day >= DATE '2024-01-15'"))


@query("code_registry_a19_t8", "SELECT code, first_seen, last_seen, days_of_week, is_new FROM registry")
def code_registry(spark, sf):
    return shown(registry(spark, sf).withColumn("days_of_week", audit.weekday_names()))


@query("weekend_codes_a20", "SELECT count(*) FILTER (weekend) AS weekend, count(*) FILTER (NOT weekend) AS weekday_only FROM registry")
def weekend_codes(spark, sf):
    return audit.weekend_split(registry(spark, sf))


@query("work_list_j7", """
SELECT code, CAST(day AS VARCHAR) AS day FROM (
  SELECT code, CAST(d.day AS DATE) AS day FROM (SELECT DISTINCT code FROM sightings) CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-03', DATE '2024-01-20', INTERVAL 1 DAY)) AS day) d
  EXCEPT SELECT code, day FROM sightings)""")
def work_list(spark, sf):
    s = sightings(spark, sf)
    return shown(audit.work_list(s, "2024-01-03", "2024-01-20", s))


@query("retry_list_j7", """
SELECT CAST(ts AS DATE)::VARCHAR AS day, concat('T', CAST(user_id AS VARCHAR)) AS code, min(event_id) AS first_failed
FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def retry_list(spark, sf):
    e = views.table(spark, sf, "events").where("event_type = 'error'")
    f = e.select(F.col("ts").cast("date").alias("day"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("code"), F.col("event_id").alias("seq"))
    return shown(audit.retry_list(f))


VIEWS["sampled_files"] = """
  SELECT service_date, train_code FROM (SELECT *, row_number() OVER (PARTITION BY service_date ORDER BY md5(concat('7|', train_code)), train_code) AS rn
    FROM (SELECT DISTINCT service_date, train_code FROM movements)) WHERE rn <= 20"""


@query("seeded_file_sample_l4", "SELECT CAST(service_date AS VARCHAR) AS service_date, train_code FROM sampled_files")
def seeded_file_sample(spark, sf):
    files = views.movements(spark, sf)[0].select("service_date", "train_code").distinct()
    return shown(audit.seeded_sample(files, ["service_date"], "train_code", 20, 7))


@query("sampled_survey_a42", """
SELECT CAST(service_date AS VARCHAR) AS service_date, count(DISTINCT train_code) AS sampled, count(*) AS records, count(arr_sec) AS with_arrival,
       count(*) FILTER (arr_sec IS NOT NULL AND sched_sec IS NOT NULL) AS comparable, count(*) FILTER (arr_sec <> sched_sec) AS differing
FROM movements JOIN sampled_files USING (service_date, train_code) GROUP BY 1""")
def sampled_survey(spark, sf):
    moves, _ = views.movements(spark, sf)
    files = audit.seeded_sample(moves.select("service_date", "train_code").distinct(), ["service_date"], "train_code", 20, 7)
    return shown(audit.survey(moves, files))


@query("fleet_sample_l3", """
SELECT train_code, (SELECT count(DISTINCT train_code) FROM movements) AS pool_size, least((SELECT count(DISTINCT train_code) FROM movements), 10) AS sample_size
FROM (SELECT DISTINCT train_code FROM movements) ORDER BY md5(concat('3|', train_code)), train_code LIMIT 10""")
def fleet_sample(spark, sf):
    return audit.fleet_sample(views.movements(spark, sf)[0], "train_code", 10, 3)


@query("station_group_join_j26", """
SELECT m.location_code, g.event_type AS station_group, count(*) AS n FROM movements m
LEFT JOIN (SELECT concat('S', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS VARCHAR)) AS location_code, min(event_type) AS event_type
           FROM events GROUP BY 1) g USING (location_code) GROUP BY 1, 2""")
def station_group_join(spark, sf):
    moves, _ = views.movements(spark, sf)
    groups = moves.groupBy("location_code").agg(F.min("station_group").alias("station_group"))
    return moves.drop("station_group").join(groups, "location_code", "left").groupBy("location_code", "station_group").agg(
        F.count(F.lit(1)).alias("n"))
