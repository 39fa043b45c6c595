"""Complete-day scenarios, buffers, the candidate sweep and the bootstrap, over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..session import settle
from ..operators import drift, scenarios
from .oracle_views import VIEWS
from .registry import fixed_sql, query, shown

VIEWS["scen"] = """
  SELECT concat('T', CAST(user_id AS VARCHAR)) AS train_code, day, i + 1 AS stop_order, concat('S', CAST((user_id + i) % 20 AS VARCHAR)) AS location_code,
         ['O','S','T','S','D'][i + 1] AS location_type, sched_arr AS sched_arr_sec, 36060 + 600 * i AS sched_dep_sec,
         arr AS arr_sec, 36060 + 600 * i + late AS dep_sec, arr - sched_arr AS arr_delay_sec, late AS dep_delay_sec,
         CASE WHEN (k + i) % 23 = 0 THEN '0' ELSE '1' END AS auto_arr, CASE WHEN (k + 2 * i) % 23 = 0 THEN '0' ELSE '1' END AS auto_dep
  FROM (SELECT *, CASE WHEN i > 0 THEN 36000 + 600 * i END AS sched_arr,
               CASE WHEN i > 0 AND NOT (k % 31 = 0 AND i = 1) THEN 36000 + 600 * i + late - CASE WHEN k % 37 = 0 AND i = 1 THEN 3000 ELSE 0 END END AS arr
        FROM (SELECT *, 6 * (k % 11) + CASE WHEN i >= 1 THEN 6 * ((k * 4 + v) % 25) - 60 ELSE 0 END + CASE WHEN i >= 2 THEN 6 * ((k * 5 + v) % 25) - 60 ELSE 0 END
                     + CASE WHEN i >= 3 THEN 6 * ((k * 6 + v) % 25) - 60 ELSE 0 END + CASE WHEN i >= 4 THEN 6 * ((k * 7 + v) % 25) - 60 ELSE 0 END AS late
              FROM (SELECT user_id, CAST(ts AS DATE) AS day, min_by(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), event_id) AS k,
                           min_by(CAST(floor(value) AS INT), event_id) AS v FROM events GROUP BY 1, 2)
              CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS x(i) WHERE NOT (k % 29 = 0 AND i = 3)))"""
VIEWS["seg"] = """
  SELECT *, arr_sec - from_dep + CASE WHEN arr_sec - from_dep < -43200 THEN 86400 ELSE 0 END AS run_sec FROM (
    SELECT *, CAST(row_number() OVER w AS INT) AS seq, lag(location_code) OVER w AS from_code, lag(dep_sec) OVER w AS from_dep, lag(auto_dep) OVER w AS from_auto,
           lag(sched_dep_sec) OVER w AS from_sched_dep FROM scen WHERE location_type IN ('O', 'S', 'D')
    WINDOW w AS (PARTITION BY train_code, day ORDER BY stop_order))"""
VIEWS["day_facts"] = """
  SELECT c.*, coalesce(n_stops, 0) AS n_stops FROM (
    SELECT train_code, day, bool_and(coalesce(m >= p, true)) AS consistent FROM (
      SELECT train_code, day, m, lag(m IGNORE NULLS) OVER (PARTITION BY train_code, day ORDER BY stop_order) AS p
      FROM (SELECT *, sched_arr_sec + arr_delay_sec AS m FROM scen)) GROUP BY 1, 2) c
  LEFT JOIN (SELECT train_code, day, count(*) AS n_stops FROM seg GROUP BY 1, 2) USING (train_code, day)"""
VIEWS["first_day"] = "SELECT train_code, min(day) AS day FROM day_facts WHERE consistent AND n_stops >= 3 GROUP BY 1"
VIEWS["pattern"] = "SELECT train_code, day, string_agg(location_code, ',' ORDER BY seq) AS pattern, bool_and(CASE WHEN seq = 1 THEN true ELSE coalesce(run_sec > 0 AND run_sec < 7200 AND from_auto = '1' AND auto_arr = '1', false) END) AS complete FROM seg GROUP BY 1, 2"
VIEWS["days_judged"] = """
  SELECT f.train_code, f.day, f.n_stops, CASE WHEN NOT consistent THEN 'inconsistent_journey' WHEN n_stops < 3 THEN 'too_few_stops'
         WHEN p.pattern <> r.pattern THEN 'different_stopping_pattern' WHEN NOT p.complete THEN 'incomplete_or_unverified_run' END AS drop_reason
  FROM day_facts f LEFT JOIN pattern p USING (train_code, day)
  LEFT JOIN (SELECT train_code, pattern FROM pattern JOIN first_day USING (train_code, day)) r USING (train_code)"""
VIEWS["ref_runs"] = "SELECT train_code, seq, sched_arr_sec - from_sched_dep AS sched_run FROM seg JOIN first_day USING (train_code, day)"
VIEWS["good_rows"] = """
  SELECT s.*, r.sched_run FROM seg s JOIN (SELECT * FROM days_judged WHERE drop_reason IS NULL) d USING (train_code, day)
  JOIN ref_runs r USING (train_code, seq) WHERE s.seq > 1"""
VIEWS["per_seg"] = """
  SELECT *, p5 > sched_run AS infeasible, least(p5, sched_run) AS min_run, sched_run - least(p5, sched_run) AS buffer FROM (
    SELECT train_code, seq, quantile_cont(run_sec, 0.05) AS p5, count(*) AS n_days, max(sched_run) AS sched_run FROM good_rows GROUP BY 1, 2)
  WHERE n_days >= 12"""
VIEWS["inst"] = """
  SELECT g.train_code, g.day, g.seq, g.run_sec, p.p5, p.n_days, p.sched_run, p.infeasible, p.min_run, p.buffer, greatest(0.0, g.run_sec - p.min_run) AS primary_delay,
         s.start_late, max(g.seq) OVER (PARTITION BY g.train_code) AS last_seq
  FROM good_rows g JOIN per_seg p USING (train_code, seq)
  JOIN (SELECT train_code, day, coalesce(dep_delay_sec, 0) AS start_late FROM seg WHERE seq = 1) s USING (train_code, day)"""
VIEWS["held"] = """
  SELECT *, i > floor(s * 0.5) AS held_out FROM (SELECT train_code, day, row_number() OVER (PARTITION BY train_code ORDER BY day) AS i,
         count(*) OVER (PARTITION BY train_code) AS s FROM (SELECT DISTINCT train_code, day FROM inst))"""
VIEWS["costs"] = """
  SELECT train_code, day, candidate, held_out, sum(late) FILTER (seq = last_seq) AS terminus, sum(late) AS uniform FROM (
    SELECT *, s + greatest(start_late, -min(s) OVER (PARTITION BY train_code, day, candidate ORDER BY seq)) AS late FROM (
      SELECT *, sum(primary_delay - b) OVER (PARTITION BY train_code, day, candidate ORDER BY seq) AS s FROM (
        SELECT i.*, h.held_out, c.candidate, CASE c.candidate WHEN 'timetable' THEN buffer WHEN 'even' THEN sum(buffer) OVER (PARTITION BY i.train_code, i.day, c.candidate) / count(*) OVER (PARTITION BY i.train_code, i.day, c.candidate)
               WHEN 'none' THEN 0.0 END AS b
        FROM inst i JOIN held h USING (train_code, day) CROSS JOIN (VALUES ('timetable'), ('even'), ('none')) AS c(candidate)))) GROUP BY ALL"""

MIN_DAYS = 12


def _stops(spark, sf):
    stops = views.scenario_stops(spark, sf)
    return stops, scenarios.day_track(stops)


def _instances(spark, sf):
    stops, t = _stops(spark, sf)
    return settle(scenarios.instances(stops, t, MIN_DAYS), "instances")


def _with_even(inst):
    share = inst.select("train_code", "seq", "buffer").distinct().groupBy("train_code").agg(F.avg("buffer").alias("even"))
    return inst.join(share, "train_code")


def candidates():
    return {"timetable": F.col("buffer"), "even": F.col("even"), "none": F.lit(0.0)}


@query("scenario_view", "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM scen")
def scenario_view(spark, sf):
    return shown(views.scenario_stops(spark, sf))


@query("scenario_days_a27", "SELECT train_code, CAST(day AS VARCHAR) AS day, n_stops, drop_reason FROM days_judged")
def scenario_days(spark, sf):
    return shown(scenarios.classified_days(*_stops(spark, sf))[1])


@query("scenario_drop_counts_a27", "SELECT coalesce(drop_reason, 'scenario') AS drop_reason, count(*) AS n FROM days_judged GROUP BY 1")
def scenario_drop_counts(spark, sf):
    days = scenarios.classified_days(*_stops(spark, sf))[1]
    return days.groupBy(F.coalesce("drop_reason", F.lit("scenario")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("passenger_stops_p26", "SELECT train_code, CAST(day AS VARCHAR) AS day, count(*) AS n FROM scen WHERE location_type IN ('O', 'S', 'D') GROUP BY 1, 2")
def passenger_stops(spark, sf):
    s = views.scenario_stops(spark, sf).where(F.col("location_type").isin("O", "S", "D"))
    return shown(s.groupBy("train_code", "day").agg(F.count(F.lit(1)).alias("n")))


@query("segment_buffers_a26", f"""
SELECT train_code, seq, n_days, sched_run, infeasible, {fixed_sql('min_run')} AS min_run, {fixed_sql('buffer')} AS buffer FROM per_seg""")
def segment_buffers(spark, sf):
    inst = _instances(spark, sf)
    return shown(inst.select("train_code", "seq", "n_days", "sched_run", "infeasible", "min_run", "buffer").distinct())


@query("instance_summary_a26", f"""
SELECT train_code, count(*) AS segments, max(n_days) AS days, {fixed_sql('sum(buffer)', 4)} AS total_buffer, count(*) FILTER (infeasible) AS infeasible_segments FROM per_seg GROUP BY 1""")
def instance_summary(spark, sf):
    return shown(scenarios.summary(_instances(spark, sf)), 4)


@query("primary_delay_p4", f"""
SELECT train_code, CAST(day AS VARCHAR) AS day, seq, run_sec, {fixed_sql('primary_delay')} AS primary_delay, start_late FROM inst""")
def primary_delay(spark, sf):
    return shown(_instances(spark, sf).select("train_code", "day", "seq", "run_sec", "primary_delay", "start_late"))


@query("hold_out_days_w10", "SELECT train_code, CAST(day AS VARCHAR) AS day, held_out FROM held")
def hold_out_days(spark, sf):
    return shown(scenarios.with_hold_out(_instances(spark, sf)).select("train_code", "day", "held_out").distinct())


@query("lateness_replay_w9", f"""
SELECT train_code, CAST(day AS VARCHAR) AS day, candidate, held_out, {fixed_sql('terminus', 4)} AS terminus, {fixed_sql('uniform', 4)} AS uniform FROM costs""")
def lateness_replay(spark, sf):
    inst = scenarios.with_hold_out(_with_even(_instances(spark, sf)))
    return shown(scenarios.day_costs(inst, candidates()).select("train_code", "day", "candidate", "held_out", "terminus", "uniform"), 4)


VIEWS["held_long"] = """
  SELECT c.train_code, c.day, c.candidate, w.weighting, CASE w.weighting WHEN 'terminus' THEN c.terminus ELSE c.uniform END AS cost,
         CASE w.weighting WHEN 'terminus' THEN t.terminus ELSE t.uniform END AS base_cost
  FROM costs c JOIN costs t ON t.train_code = c.train_code AND t.day = c.day AND t.candidate = 'timetable' AND t.held_out
  CROSS JOIN (VALUES ('terminus'), ('uniform')) AS w(weighting) WHERE c.held_out AND c.candidate <> 'timetable'"""


def boot_sql(units: str, by: str, reps: int, seed: int) -> str:
    """Bootstrap over `units` (by…, i, s, d), numbered from 0 in groups of s, as SQL with the same md5 draws."""
    return f"""
  SELECT p.*, e.lo, e.hi, e.hi < 0 AS significant FROM (SELECT {by}, avg(d) AS point, count(*) AS n_units FROM {units} GROUP BY {by}) p
  JOIN (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
    SELECT {by}, rep, sum(d * times) / any_value(s) AS m FROM (
      SELECT s, rep, pick, count(*) AS times FROM (
        SELECT s, rep, CAST(concat('0x', substr(md5(concat('{seed}|', CAST(rep AS VARCHAR), '|', CAST(i AS VARCHAR))), 1, 8)) AS BIGINT) % s AS pick
        FROM (SELECT DISTINCT s, i FROM {units}) CROSS JOIN (SELECT unnest(range(0, {reps})) AS rep)) GROUP BY ALL)
    JOIN {units} n USING (s) WHERE n.i = pick GROUP BY {by}, rep) GROUP BY {by}) e ON {' AND '.join(f'e.{b.strip()} IS NOT DISTINCT FROM p.{b.strip()}' for b in by.split(','))}"""


VIEWS["numbered"] = """
  SELECT train_code, candidate, weighting, cost - base_cost AS d, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY train_code, candidate, weighting) AS s
  FROM held_long WINDOW w AS (PARTITION BY train_code, candidate, weighting ORDER BY day)"""


@query("candidate_sweep_b1_a28", f"""
SELECT train_code, candidate, weighting, {fixed_sql('held_out_cost', 9)} AS held_out_cost, {fixed_sql('base_cost', 9)} AS base_cost, n_units,
       {fixed_sql('point', 9)} AS point, {fixed_sql('lo', 9)} AS lo, {fixed_sql('hi', 9)} AS hi
FROM (SELECT train_code, candidate, weighting, avg(cost) AS held_out_cost, avg(base_cost) AS base_cost FROM held_long GROUP BY ALL)
JOIN ({boot_sql('numbered', 'train_code, candidate, weighting', drift.REPLICATES, 1)}) USING (train_code, candidate, weighting)""")
def candidate_sweep(spark, sf):
    out = scenarios.sweep(_with_even(_instances(spark, sf)), candidates(), "timetable", drift.REPLICATES, seed=1)
    return shown(out.drop("significant"), 9)


@query("buffer_deviation_b1", f"""
SELECT train_code, candidate, {fixed_sql('sum(abs(b - buffer))', 4)} AS shift, count(*) FILTER (b > 0.1 * min_run - 1e-6) AS caps_binding FROM (
  SELECT p.*, c.candidate, CASE c.candidate WHEN 'timetable' THEN buffer ELSE 0.0 END AS b FROM per_seg p CROSS JOIN (VALUES ('timetable'), ('none')) AS c(candidate)) GROUP BY 1, 2""")
def buffer_deviation(spark, sf):
    two = {k: candidates()[k] for k in ("timetable", "none")}
    return shown(scenarios.deviation(_instances(spark, sf), two, "timetable", 0.1 * F.col("min_run")), 4)


@query("network_slack_a43", f"""
SELECT from_code, to_code, n, {fixed_sql('sched_run')} AS sched_run, {fixed_sql('p5_run')} AS p5_run, {fixed_sql('sched_run - p5_run')} AS slack, sched_run - p5_run < 0 AS negative FROM (
  SELECT from_code, location_code AS to_code, count(*) AS n, quantile_cont(sched_arr_sec - from_sched_dep, 0.5) AS sched_run, quantile_cont(run_sec, 0.05) AS p5_run
  FROM seg WHERE seq > 1 AND run_sec > 0 AND run_sec < 7200 AND from_auto = '1' AND auto_arr = '1' GROUP BY 1, 2) WHERE n >= 30""")
def network_slack(spark, sf):
    return shown(scenarios.segment_slack(*_stops(spark, sf)))


VIEWS["gate_rows"] = """
  SELECT station_group, service_date, abs(q50_sec - 30 - actual_delay_sec) - abs(q50_sec - actual_delay_sec) AS error,
         100.0 * (CAST(actual_delay_sec BETWEEN q10_sec + 30 AND q90_sec AS INT) - CAST(interval_hit AS INT)) AS coverage
  FROM scores WHERE score_state = 'scored'"""
VIEWS["gate_units"] = """
  SELECT m.metric, g.station_group, service_date AS unit, count(*) AS n, avg(CASE m.metric WHEN 'error' THEN CAST(error AS DOUBLE) ELSE coverage END) AS d
  FROM (SELECT station_group, * EXCLUDE (station_group) FROM gate_rows UNION ALL SELECT NULL, * EXCLUDE (station_group) FROM gate_rows) g CROSS JOIN (VALUES ('error'), ('coverage')) AS m(metric) GROUP BY 1, 2, 3"""
VIEWS["gate_numbered"] = "SELECT *, row_number() OVER (PARTITION BY metric, station_group ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY metric, station_group) AS s FROM gate_units"


@query("promotion_gate_a33", f"""
SELECT b.metric, b.station_group, n_units, {fixed_sql('point', 4)} AS point, {fixed_sql('lo', 4)} AS lo, {fixed_sql('hi', 4)} AS hi, CAST(n AS BIGINT) AS n,
       CASE b.metric WHEN 'error' THEN lo > 0 ELSE hi < 0 END AS worse, b.station_group IS NULL OR n >= 1100 AS can_veto,
       CASE b.metric WHEN 'error' THEN lo > 0 ELSE hi < 0 END AND (b.station_group IS NULL OR n >= 1100) AS veto
FROM ({boot_sql('gate_numbered', 'metric, station_group', drift.REPLICATES, 2)}) b
JOIN (SELECT metric, station_group, sum(n) AS n FROM gate_units GROUP BY 1, 2) c ON c.metric = b.metric AND c.station_group IS NOT DISTINCT FROM b.station_group""")
def promotion_gate(spark, sf):
    """A challenger 30 seconds lower, with a narrower range: in error and in coverage, overall and by group, days resampled."""
    from .scores import scored
    clean = scored(spark, sf).where("score_state = 'scored'")
    a, q = F.col("actual_delay_sec"), F.col("q50_sec")
    hits = F.col("interval_hit"), a.between(F.col("q10_sec") + 30, F.col("q90_sec"))
    out = drift.promotion_gate(clean, "station_group", F.abs(q - a), F.abs(q - 30 - a), "service_date", seed=2, hits=hits)
    return shown(out.drop("significant"), 4)
