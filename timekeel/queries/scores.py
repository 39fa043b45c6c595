"""Scoring, roll-up, calibration and drift over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import times, values
from ..operators import calibration, drift, journeys, metrics, rollup, scoring
from ..operators.ordered import first_by
from ..session import settle
from .oracle_views import VIEWS, band_sql
from .registry import fixed_sql, query, shown

EVENT = list(scoring.EVENT)


def scored(spark, sf):
    moves, t = views.movements(spark, sf)
    prep = journeys.prepared(moves, t)
    return scoring.score(views.predictions(moves, t), prep, views.polls(moves))


def stored(spark, sf):
    """Scores as the later jobs find them: written, then read."""
    return settle(scored(spark, sf), "scores")


ACC = f"""count(ERR) AS n, {fixed_sql('avg(abs(ERR))')} AS mae_sec,
       CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(ERR) DESC) AS INT) AS medae_sec,
       {fixed_sql('avg(ERR)')} AS bias_sec""".replace("ERR", "model_err_rounded_sec")
BOTH = "rival_err_sec IS NOT NULL AND model_err_rounded_sec IS NOT NULL"
OP = f"avg(abs(rival_err_sec)) FILTER ({BOTH})"
MO = f"avg(abs(model_err_rounded_sec)) FILTER ({BOTH})"
H2H = f"""count(*) FILTER ({BOTH}) AS matched_events, {fixed_sql(MO)} AS model_mae_sec, {fixed_sql(OP)} AS rival_mae_sec,
       {fixed_sql(f'100 * ({OP} - {MO}) / nullif({OP}, 0)')} AS improvement_pct,
       count(*) FILTER ({BOTH} AND abs(model_err_rounded_sec) < abs(rival_err_sec)) AS model_wins,
       count(*) FILTER ({BOTH} AND abs(model_err_rounded_sec) = abs(rival_err_sec)) AS ties,
       count(*) FILTER ({BOTH} AND abs(model_err_rounded_sec) > abs(rival_err_sec)) AS rival_wins"""
COV = f"{fixed_sql('100 * avg(CAST(interval_hit AS INT))')} AS coverage_pct"
RAWCOV = f"{fixed_sql('100 * avg(CAST(coalesce(raw_interval_hit, interval_hit) AS INT))')} AS raw_coverage_pct"

VIEWS["clean"] = """SELECT * REPLACE (coalesce(station_group, '(unpolled)') AS station_group)
  FROM scores WHERE score_state = 'scored'"""
VIEWS["clean_slices"] = """SELECT s.scope, CASE s.scope WHEN 'overall' THEN '' WHEN 'station_group' THEN station_group ELSE lead_band END AS key, c.*
  FROM clean c CROSS JOIN (VALUES ('overall'), ('station_group'), ('lead_band')) AS s(scope)
  WHERE s.scope <> 'lead_band' OR lead_band IS NOT NULL"""


@query("last_in_band_w6", """SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, lead_band,
  location_order, made_sec, lead_sec, q50_sec FROM kept""")
def last_in_band(spark, sf):
    preds = views.predictions(*views.movements(spark, sf))
    return shown(scoring.last_in_band(preds).select(
        *EVENT, "lead_band", "location_order", "made_sec", "lead_sec", "q50_sec"))


@query("realised_stop_j1", """
SELECT CAST(k.service_date AS VARCHAR) AS service_date, train_code, location_code, k.lead_band, k.location_order,
       o.stop_order, o.sched_abs, o.arr_abs, o.actual_delay_sec
FROM kept k LEFT JOIN outcome o USING (service_date, train_code, location_code)""")
def realised_stop(spark, sf):
    moves, t = views.movements(spark, sf)
    kept = scoring.last_in_band(views.predictions(moves, t))
    out = scoring.realised(journeys.prepared(moves, t))
    return shown(kept.join(out, EVENT, "left").select(
        *EVENT, "lead_band", "location_order", "stop_order", "sched_abs", "arr_abs", "actual_delay_sec"))


@query("rival_last_poll_in_band_j2", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, lead_band, rival_poll_sec, rival_eta_sec, rival_group
FROM rival""")
def rival_last_poll(spark, sf):
    moves, t = views.movements(spark, sf)
    out = scoring.realised(journeys.prepared(moves, t))
    return shown(scoring.rival_statements(views.polls(moves), out))


@query("score_states_m8", "SELECT score_state, count(*) AS n FROM scores GROUP BY 1")
def score_states(spark, sf):
    return scored(spark, sf).groupBy("score_state").agg(F.count(F.lit(1)).alias("n"))


@query("scored_rows_p17_p18", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM scores")
def scored_rows(spark, sf):
    return shown(scored(spark, sf))


@query("accuracy_a1", f"SELECT station_group, {ACC} FROM clean GROUP BY 1")
def accuracy(spark, sf):
    clean = scored(spark, sf).where("score_state = 'scored'")
    return shown(clean.groupBy("station_group").agg(*metrics.accuracy()))


@query("head_to_head_a3", f"SELECT lead_band, {H2H} FROM clean GROUP BY 1")
def head_to_head(spark, sf):
    clean = scored(spark, sf).where("score_state = 'scored'")
    return shown(clean.groupBy("lead_band").agg(*metrics.head_to_head()))


@query("interval_coverage_a4", f"SELECT score_state, {COV}, {RAWCOV} FROM scores GROUP BY 1")
def interval_coverage(spark, sf):
    return shown(scored(spark, sf).groupBy("score_state").agg(metrics.coverage(), metrics.raw_coverage()))


@query("slices_a5", f"SELECT scope, key, {ACC}, {COV}, {H2H} FROM clean_slices GROUP BY 1, 2")
def slices(spark, sf):
    return shown(metrics.by_group_and_band(
        scored(spark, sf), [*metrics.accuracy(), metrics.coverage(), *metrics.head_to_head()]))


@query("state_and_outcome_counts_a6", """
SELECT score_state, outcome, count(*) AS n FROM scores GROUP BY 1, 2""")
def state_and_outcome_counts(spark, sf):
    return scored(spark, sf).groupBy("score_state", "outcome").agg(F.count(F.lit(1)).alias("n"))


VIEWS["scopes"] = """
  SELECT CASE WHEN o IS NULL OR poll_sec IS NULL THEN 'unknown'
              WHEN ((poll_sec - o) % 86400 + 86400) % 86400 < 43200 THEN 'departed' ELSE 'not_yet_departed' END AS scope
  FROM polls p LEFT JOIN (SELECT service_date, train_code, min_by(sched_sec, location_order) AS o FROM movements GROUP BY ALL) USING (service_date, train_code)"""


def board_scopes(spark, sf):
    moves, _ = views.movements(spark, sf)
    origin = first_by(moves, journeys.JOURNEY, ["location_order"]).select(
        *journeys.JOURNEY, F.col("sched_sec").alias("origin_sec"))
    met = views.polls(moves).join(origin, list(journeys.JOURNEY), "left")
    return met.select(times.departed("origin_sec", "poll_sec").alias("scope"))


@query("board_scope_p14", "SELECT scope, count(*) AS n FROM scopes GROUP BY 1")
def board_scope(spark, sf):
    return board_scopes(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("visitor_coverage_a7", f"""
SELECT board_entries, {fixed_sql('100 * gone / board_entries')} AS in_scope_pct, {fixed_sql('100 * said / total')} AS answered_given_in_scope_pct,
       {fixed_sql('100 * (gone / board_entries) * (said / total)')} AS answered_pct
FROM (SELECT count(*) FILTER (scope = 'departed') AS gone, count(*) FILTER (scope <> 'unknown') AS board_entries FROM scopes),
     (SELECT count(*) FILTER (score_state <> 'declined') AS said, count(*) AS total FROM scores)""")
def visitor_coverage(spark, sf):
    return shown(metrics.visitor_coverage(board_scopes(spark, sf), scored(spark, sf)))


@query("answered_share_a7", f"""
SELECT count(*) FILTER (score_state <> 'declined') AS answered, count(*) FILTER (score_state = 'declined') AS declined,
       {fixed_sql("100 * avg(CAST(score_state <> 'declined' AS INT))")} AS answered_pct FROM scores""")
def answered_share(spark, sf):
    return shown(metrics.answered(scored(spark, sf)))


@query("share_by_state_a41", f"""
SELECT score_state, n, {fixed_sql('100 * n / sum(n) OVER ()')} AS share_pct
FROM (SELECT score_state, count(*) AS n FROM scores GROUP BY 1)""")
def share_by_state(spark, sf):
    return shown(metrics.shares(scored(spark, sf), "score_state"))


def acc_sql(err: str, prefix: str) -> str:
    return f"""count({err}) AS {prefix}n, {fixed_sql(f'avg(abs({err}))')} AS {prefix}mae_sec,
       CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY abs({err}) DESC) AS INT) AS {prefix}medae_sec,
       {fixed_sql(f'avg({err})')} AS {prefix}bias_sec"""


DAY_H2H = H2H.replace("model_err_rounded_sec", "c").replace("rival_err_sec", "r")
VIEWS["days"] = f"""
  SELECT service_date, events, declined, inconsistent_rows, * EXCLUDE (service_date, events, declined, inconsistent_rows),
         n > 0 AND matched_events = 0 AS warn_no_matches, inconsistent_rows > 0 AS warn_inconsistent,
         n >= 50 AND matched_events = 0 AS alarm
  FROM (SELECT service_date, count(*) AS events, count(*) FILTER (score_state = 'declined') AS declined,
               count(*) FILTER (score_state = 'journey_inconsistent') AS inconsistent_rows,
               {acc_sql('c', '')}, {acc_sql('w', 'raw_')}, {acc_sql('e', 'echo_')},
               {acc_sql('model_err_rounded_sec', 'incl_echo_')},
               {fixed_sql('100 * avg(CAST(h AS INT))')} AS coverage_pct, {DAY_H2H}
        FROM (SELECT *, CASE WHEN score_state = 'scored' THEN model_err_rounded_sec END AS c,
                     CASE WHEN score_state = 'scored' THEN model_err_sec END AS w,
                     CASE WHEN score_state = 'echo_suspect' THEN model_err_rounded_sec END AS e,
                     CASE WHEN score_state = 'scored' THEN interval_hit END AS h,
                     CASE WHEN score_state = 'scored' THEN rival_err_sec END AS r FROM scores)
        GROUP BY service_date)"""


@query("day_summary_a11", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM days")
def day_summary(spark, sf):
    return shown(rollup.day_summary(scored(spark, sf)))


@query("rolling_window_a9", f"""
SELECT scope, key, {ACC}, {COV}, {RAWCOV}, {H2H} FROM clean_slices
WHERE service_date IN (SELECT DISTINCT service_date FROM scores ORDER BY service_date DESC LIMIT 3) GROUP BY 1, 2""")
def rolling_window(spark, sf):
    return shown(rollup.rolling(stored(spark, sf), days=3))


@query("last_scored_dates_w13", """
SELECT CAST(service_date AS VARCHAR) AS service_date FROM (SELECT DISTINCT service_date FROM scores ORDER BY service_date DESC LIMIT 3)""")
def last_scored_dates(spark, sf):
    return shown(calibration.recent_dates(scored(spark, sf), 3))


@query("cumulative_a10_a8", f"""
SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS n, {fixed_sql('sum(n * mae_sec) / sum(n)', 4)} AS mae_sec,
       {fixed_sql('sum(n * coverage_pct) / sum(n)', 4)} AS coverage_pct, CAST(sum(matched_events) AS BIGINT) AS matched_events,
       {fixed_sql('sum(matched_events * model_mae_sec) / sum(matched_events)', 4)} AS model_mae_sec,
       {fixed_sql('sum(matched_events * rival_mae_sec) / sum(matched_events)', 4)} AS rival_mae_sec,
       {fixed_sql('100 * (sum(matched_events * rival_mae_sec) - sum(matched_events * model_mae_sec)) / sum(matched_events * rival_mae_sec)', 4)} AS improvement_pct
FROM days""")
def cumulative(spark, sf):
    return shown(rollup.cumulative(rollup.day_summary(scored(spark, sf))), 4)


@query("daily_running_a10", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, CAST(sum(n) OVER w AS BIGINT) AS n,
       {fixed_sql('sum(n * mae_sec) OVER w / sum(n) OVER w', 4)} AS mae_sec, CAST(sum(matched_events) OVER w AS BIGINT) AS matched_events
FROM days WINDOW w AS (ORDER BY service_date)""")
def daily_running(spark, sf):
    return shown(rollup.since_start(rollup.day_summary(scored(spark, sf))), 4)


@query("charted_days_a41", """
SELECT CAST(service_date AS VARCHAR) AS service_date, matched_events FROM days WHERE matched_events >= 100""")
def charted_days(spark, sf):
    return shown(rollup.charted(rollup.day_summary(scored(spark, sf))).select("service_date", "matched_events"))


VIEWS["residuals"] = """
  SELECT service_date, coalesce(station_group, '') AS station_group, lead_band, actual_delay_sec - q10_sec AS low_res, actual_delay_sec - q90_sec AS high_res
  FROM scores WHERE score_state = 'scored' AND lead_band IS NOT NULL"""


def fit_sql(source: str, keep: str = "") -> str:
    comma = keep + ", " if keep else ""
    parts = [f"""SELECT {comma}{g} AS station_group, lead_band, count(*) AS n,
         CAST(round_even(quantile_cont(low_res, 0.1), 0) AS INT) AS lo, CAST(round_even(quantile_cont(high_res, 0.9), 0) AS INT) AS hi
         FROM {source} GROUP BY {comma}{x}lead_band HAVING count(*) >= 200"""
             for g, x in (("station_group", "station_group, "), ("CAST(NULL AS VARCHAR)", ""))]
    return " UNION ALL ".join(parts)


VIEWS["cal"] = fit_sql("residuals")


@query("calibration_fit_a12", "SELECT * FROM cal")
def calibration_fit(spark, sf):
    return calibration.fit(calibration.residuals(scored(spark, sf)))


VIEWS["served"] = """
  SELECT *, least(q10_sec + lo, q50_sec) AS served_q10_sec, greatest(q90_sec + hi, q50_sec) AS served_q90_sec
  FROM (SELECT k.*, coalesce(c.lo, b.lo, 0) AS lo, coalesce(c.hi, b.hi, 0) AS hi FROM kept k
        LEFT JOIN (SELECT * FROM cal WHERE station_group IS NOT NULL) c
             ON c.station_group = coalesce(k.station_group, '') AND c.lead_band = coalesce(k.lead_band, '0-5 min')
        LEFT JOIN (SELECT * FROM cal WHERE station_group IS NULL) b ON b.lead_band = coalesce(k.lead_band, '0-5 min'))"""


@query("calibrated_range_j11_p23", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, lead_band, lo, hi, served_q10_sec, served_q90_sec FROM served""")
def calibrated_range(spark, sf):
    moves, t = views.movements(spark, sf)
    preds = views.predictions(moves, t)
    cal = calibration.fit(calibration.residuals(scoring.score(preds, journeys.prepared(moves, t), views.polls(moves))))
    out = calibration.served(calibration.with_offsets(scoring.last_in_band(preds), cal))
    return shown(out.select(*EVENT, "lead_band", "lo", "hi", "served_q10_sec", "served_q90_sec"))


VIEWS["forward_res"] = """
  SELECT d.service_date AS for_date, r.* EXCLUDE (service_date) FROM residuals r
  JOIN (SELECT DISTINCT CAST(date_trunc('week', service_date) AS DATE) AS service_date FROM scores) d ON r.service_date < d.service_date AND r.service_date >= d.service_date - 14"""
VIEWS["forward_cal"] = fit_sql("forward_res", "for_date")


@query("walk_forward_a45", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, count(*) AS n,
       {fixed_sql('100 * avg(CAST(a BETWEEN q10_sec AND q90_sec AS INT))')} AS coverage_before_pct,
       {fixed_sql('100 * avg(CAST(a BETWEEN least(q10_sec + lo, q50_sec) AND greatest(q90_sec + hi, q50_sec) AS INT))')} AS coverage_after_pct,
       {fixed_sql('quantile_cont(q90_sec - q10_sec, 0.5)')} AS width_before_sec,
       {fixed_sql('quantile_cont(greatest(q90_sec + hi, q50_sec) - least(q10_sec + lo, q50_sec), 0.5)')} AS width_after_sec
FROM (SELECT s.*, s.actual_delay_sec AS a, coalesce(c.lo, b.lo, 0) AS lo, coalesce(c.hi, b.hi, 0) AS hi FROM scores s
      LEFT JOIN (SELECT * FROM forward_cal WHERE station_group IS NOT NULL) c ON c.for_date = CAST(date_trunc('week', s.service_date) AS DATE) AND c.station_group = s.station_group AND c.lead_band = s.lead_band
      LEFT JOIN (SELECT * FROM forward_cal WHERE station_group IS NULL) b ON b.for_date = CAST(date_trunc('week', s.service_date) AS DATE) AND b.lead_band = s.lead_band
      WHERE s.score_state = 'scored') GROUP BY 1""")
def walk_forward(spark, sf):
    return shown(calibration.walk_forward(stored(spark, sf)))


VIEWS["hits"] = """
  SELECT service_date, NULL AS station_group, count(*) FILTER (interval_hit) AS hits, count(*) AS n FROM clean GROUP BY 1
  UNION ALL SELECT service_date, station_group, count(*) FILTER (interval_hit), count(*) FROM clean GROUP BY 1, 2"""


@query("drift_trigger_a32", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, station_group, CAST(roll_hits AS BIGINT) AS roll_hits, CAST(roll_n AS BIGINT) AS roll_n,
       {fixed_sql('pct')} AS roll_coverage_pct, below,
       CAST(sum(CAST(below AS INT)) OVER (PARTITION BY station_group, island ORDER BY service_date) AS BIGINT) AS days_below,
       sum(CAST(below AS INT)) OVER (PARTITION BY station_group, island ORDER BY service_date) >= 2 AS sustained
FROM (SELECT *, sum(CAST(NOT below AS INT)) OVER (PARTITION BY station_group ORDER BY service_date) AS island
      FROM (SELECT *, CASE WHEN station_group IS NULL THEN pct < 75 ELSE pct < 70 AND roll_n >= 200 END AS below
            FROM (SELECT *, 100 * roll_hits / roll_n AS pct
                  FROM (SELECT *, sum(hits) OVER w AS roll_hits, sum(n) OVER w AS roll_n FROM hits
                        WINDOW w AS (PARTITION BY station_group ORDER BY service_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)))))""")
def drift_trigger(spark, sf):
    return shown(drift.coverage_trigger(drift.daily_hits(scored(spark, sf)), sustained=2))


@query("monthly_drift_a44", f"""
SELECT strftime(service_date, '%Y-%m') AS month, count(*) AS n,
       {fixed_sql('100 * avg(CAST(actual_delay_sec < q10_sec AS INT))')} AS early_miss_pct,
       {fixed_sql('100 * avg(CAST(actual_delay_sec > q90_sec AS INT))')} AS late_miss_pct,
       {fixed_sql('100 * avg(CAST(actual_delay_sec > 900 AS INT))')} AS over_15_min_late_pct,
       {fixed_sql('quantile_cont(actual_delay_sec - q50_sec, 0.5)')} AS median_residual_sec,
       {fixed_sql('avg(actual_delay_sec - q50_sec)')} AS mean_residual_sec
FROM clean GROUP BY 1""")
def monthly_drift(spark, sf):
    return shown(drift.monthly_drift(scored(spark, sf)))


@query("unscored_dates_j8_u2", """
SELECT CAST(service_date AS VARCHAR) AS service_date FROM
((SELECT service_date FROM predictions WHERE service_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
  EXCEPT SELECT service_date FROM scores WHERE service_date < DATE '2024-01-15'))""")
def unscored_dates(spark, sf):
    preds = views.predictions(*views.movements(spark, sf))
    done = scored(spark, sf).where("service_date < DATE '2024-01-15'")
    return shown(scoring.unscored_dates(preds, done, F.lit("2024-01-26").cast("date"), 21))


@query("tail_coverage_a34", """
SELECT count(*) AS n_all, count(*) FILTER (interval_hit) AS covered_all,
       count(*) FILTER (location_code NOT IN ('S4', 'S8')) AS n_without,
       count(*) FILTER (location_code NOT IN ('S4', 'S8') AND interval_hit) AS covered_without
FROM scores WHERE score_state = 'scored' AND actual_delay_sec > 300""")
def tail_coverage(spark, sf):
    return metrics.tail_coverage(scored(spark, sf), over_sec=300, without=("S4", "S8"))


@query("delay_density_a31", f"""
SELECT d.delay_sec, d.n, {fixed_sql('sum(o.n) / 20')} AS neighbour_mean, {fixed_sql('d.n / (sum(o.n) / 20)')} AS spike_ratio
FROM (SELECT delay_sec, count(*) AS n FROM prep WHERE delay_sec IS NOT NULL GROUP BY 1) d
LEFT JOIN (SELECT delay_sec, count(*) AS n FROM prep WHERE delay_sec IS NOT NULL GROUP BY 1) o
  ON o.delay_sec BETWEEN d.delay_sec - 60 AND d.delay_sec + 60 AND o.delay_sec <> d.delay_sec AND (o.delay_sec - d.delay_sec) % 6 = 0
GROUP BY 1, 2""")
def delay_density(spark, sf):
    return shown(metrics.delay_density(journeys.with_delay(views.movements(spark, sf)[0])))


@query("station_label_quality_a35", f"""
SELECT location_code, refusal, count(*) AS n, {fixed_sql('quantile_cont(delay_sec, 0.5)')} AS median_sec,
       {fixed_sql('quantile_cont(delay_sec, 0.9)')} AS q90_sec, max(delay_sec) AS max_sec,
       {fixed_sql('100 * avg(CAST(abs(delay_sec) <= 1800 AS INT))')} AS within_30_min_pct
FROM prep CROSS JOIN (VALUES ('before'), ('after')) AS r(refusal)
WHERE auto_arrival = '1' AND delay_sec IS NOT NULL AND (refusal = 'before' OR consistent) GROUP BY 1, 2""")
def station_label_quality(spark, sf):
    moves, t = views.movements(spark, sf)
    return shown(metrics.station_quality(journeys.prepared(moves, t)))


@query("improvement_pct_p32", f"""
SELECT location_code, {fixed_sql(f'100 * ({OP} - {MO}) / nullif({OP}, 0)')} AS improvement_pct FROM clean GROUP BY 1""")
def improvement_pct(spark, sf):
    clean = scored(spark, sf).where("score_state = 'scored'")
    return shown(clean.groupBy("location_code").agg(*metrics.head_to_head()).select("location_code", "improvement_pct"))


@query("minute_rounding_p17", """
SELECT q50_sec, CAST(round_even(q50_sec / 60.0, 0) AS BIGINT) * 60 AS rounded_sec, count(*) AS n FROM predictions GROUP BY 1, 2""")
def minute_rounding(spark, sf):
    preds = views.predictions(*views.movements(spark, sf))
    return preds.groupBy("q50_sec").agg(F.count(F.lit(1)).alias("n")).select(
        "q50_sec", values.nearest_minute("q50_sec").alias("rounded_sec"), "n")


@query("rebuilt_lead_p13", f"""
SELECT {band_sql('lead')} AS lead_band, count(*) AS n, CAST(sum(lead) AS BIGINT) AS total FROM (
  SELECT CASE WHEN gap < -43200 THEN gap + 86400 ELSE gap END AS lead FROM (
    SELECT m.sched_sec - ((p.made_sec % 86400) + 86400) % 86400 AS gap
    FROM predictions p JOIN movements m USING (service_date, train_code, location_order))) GROUP BY 1""")
def rebuilt_lead(spark, sf):
    moves, t = views.movements(spark, sf)
    preds = views.predictions(moves, t).join(
        moves.select(*journeys.JOURNEY, "location_order", "sched_sec"), [*journeys.JOURNEY, "location_order"])
    lead = times.lead_or_rebuilt(F.lit(None).cast("int"), F.col("sched_sec"), F.pmod("made_sec", F.lit(86400)))
    return preds.select(lead.alias("lead")).groupBy(times.band("lead").alias("lead_band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lead").alias("total"))


@query("zero_match_alarm_m12", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, count(model_err_rounded_sec) AS n,
       count(*) FILTER (rival_err_sec IS NOT NULL AND model_err_rounded_sec IS NOT NULL AND day(service_date) % 2 = 0) AS matched_events,
       count(model_err_rounded_sec) >= {scoring.ALARM_FLOOR} AND count(*) FILTER (rival_err_sec IS NOT NULL AND model_err_rounded_sec IS NOT NULL AND day(service_date) % 2 = 0) = 0 AS alarm
FROM scores WHERE score_state = 'scored' GROUP BY 1""")
def zero_match_alarm(spark, sf):
    """The rival's statements of odd days are lost: a day with enough scored rows and no match sets off the alarm."""
    lost = scored(spark, sf).withColumn("rival_err_sec", F.when(F.dayofmonth("service_date") % 2 == 0, F.col("rival_err_sec")))
    return shown(rollup.day_summary(lost.where("score_state = 'scored'")).select("service_date", "n", "matched_events", "alarm"))
