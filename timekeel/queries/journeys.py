"""Journey operators over the views: unwrap, consistency, reasons, ranks, examples, baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import times, values
from ..operators import journeys, metrics
from .oracle_views import band_sql
from .registry import fixed_sql, query, shown

KEYS = ["service_date", "train_code"]


def prepared(spark, sf):
    moves, t = views.movements(spark, sf)
    return journeys.prepared(moves, t), t


def observed(spark, sf):
    prep, t = prepared(spark, sf)
    return journeys.observed(prep.where("consistent"), t), t


def examples(spark, sf):
    obs, t = observed(spark, sf)
    return journeys.examples(obs, t)


@query("movements_view", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, location_code, station_group,
       sched_sec, arr_sec, auto_arrival FROM movements""")
def movements_view(spark, sf):
    return shown(views.movements(spark, sf)[0])


@query("polls_view", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM polls")
def polls_view(spark, sf):
    return shown(views.polls(views.movements(spark, sf)[0]))


@query("predictions_view", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM predictions")
def predictions_view(spark, sf):
    return shown(views.predictions(*views.movements(spark, sf)))


@query("delay_anchored_p3", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, delay_sec FROM prep""")
def delay_anchored(spark, sf):
    return shown(journeys.with_delay(views.movements(spark, sf)[0])
                 .select(*KEYS, "location_order", "delay_sec"))


@query("midnight_unwrap_w4", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, sched_abs FROM prep""")
def midnight_unwrap(spark, sf):
    moves, t = views.movements(spark, sf)
    return shown(journeys.unwrapped(moves, t).select(*KEYS, "location_order", "sched_abs"))


@query("journey_consistent_w5", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, bool_and(consistent) AS consistent, count(*) AS stops
FROM prep GROUP BY service_date, train_code""")
def journey_consistent(spark, sf):
    prep, _ = prepared(spark, sf)
    return shown(prep.groupBy(*KEYS).agg(
        F.bool_and("consistent").alias("consistent"), F.count(F.lit(1)).alias("stops")))


@query("journey_consistent_raw_schedule_w5", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, bool_and(coalesce(moment >= prev_at, true)) AS consistent
FROM (SELECT *, lag(moment) OVER (PARTITION BY service_date, train_code ORDER BY location_order) AS prev_at
      FROM (SELECT *, sched_sec + delay_sec AS moment FROM prep WHERE delay_sec IS NOT NULL))
GROUP BY service_date, train_code
UNION ALL
SELECT CAST(service_date AS VARCHAR), train_code, true FROM prep
GROUP BY service_date, train_code HAVING count(delay_sec) = 0""")
def journey_consistent_raw(spark, sf):
    moves, t = views.movements(spark, sf)
    prep = journeys.prepared(moves, t, unwrap=False)
    return shown(prep.groupBy(*KEYS).agg(F.bool_and("consistent").alias("consistent")))


@query("furthest_report_w1", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order,
       max(CASE WHEN arr_sec IS NOT NULL THEN location_order END) OVER (PARTITION BY service_date, train_code) AS furthest
FROM movements""")
def furthest_report(spark, sf):
    moves, t = views.movements(spark, sf)
    return shown(journeys.with_missing_reasons(moves, t).select(*KEYS, "location_order", "furthest"))


@query("missing_reason_p9", """
SELECT coalesce(null_reason, '') AS null_reason, count(*) AS n FROM (
  SELECT CASE WHEN arr_sec IS NOT NULL THEN NULL WHEN sched_sec IS NULL THEN 'structural'
              WHEN location_order > max(CASE WHEN arr_sec IS NOT NULL THEN location_order END)
                   OVER (PARTITION BY service_date, train_code) THEN 'future' ELSE 'unreported' END AS null_reason
  FROM movements) GROUP BY 1""")
def missing_reason(spark, sf):
    moves, t = views.movements(spark, sf)
    return (journeys.with_missing_reasons(moves, t)
            .groupBy(F.coalesce("null_reason", F.lit("")).alias("null_reason"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("exact_match_p10", """
SELECT auto_arrival, count(*) AS records, count(CASE WHEN exact IS NOT NULL THEN 1 END) AS comparable,
       count(CASE WHEN exact THEN 1 END) AS exact
FROM (SELECT auto_arrival, arr_sec = sched_sec AS exact FROM movements) GROUP BY 1""")
def exact_match(spark, sf):
    moves, _ = views.movements(spark, sf)
    comparable = F.col("arr_sec").isNotNull() & F.col("sched_sec").isNotNull()
    flagged = moves.withColumn("exact", values.exact_match("arr_sec", "sched_sec", comparable))
    return flagged.groupBy("auto_arrival").agg(
        F.count(F.lit(1)).alias("records"), F.count("exact").alias("comparable"),
        F.count_if("exact").alias("exact"))


@query("quantum_check_p11", """
SELECT count(delay_sec) AS checked, count(CASE WHEN ((delay_sec % 6) + 6) % 6 <> 0 THEN 1 END) AS violations FROM prep""")
def quantum_check(spark, sf):
    d = journeys.with_delay(views.movements(spark, sf)[0])
    return d.agg(F.count("delay_sec").alias("checked"),
                 F.count_if(values.off_quantum("delay_sec")).alias("violations"))


@query("previous_delays_w2", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, delay_sec,
       lag(delay_sec, 1) OVER w AS prev_delay_sec, lag(delay_sec, 2) OVER w AS prev2_delay_sec
FROM observed WINDOW w AS (PARTITION BY service_date, train_code ORDER BY location_order)""")
def previous_delays(spark, sf):
    obs, t = observed(spark, sf)
    return shown(journeys.with_recent_delays(obs, t).select(
        *KEYS, "location_order", "delay_sec", "prev_delay_sec", "prev2_delay_sec"))


@query("observed_rank_w3", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, obs_rank FROM observed""")
def observed_rank(spark, sf):
    obs, _ = observed(spark, sf)
    return shown(obs.select(*KEYS, "location_order", "obs_rank"))


@query("horizon_pairs_j10", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, vantage_order, target_order, horizon_observed_stops FROM examples""")
def horizon_pairs(spark, sf):
    obs, _ = observed(spark, sf)
    return shown(journeys.pair_by_join(obs).select(
        *KEYS, "vantage_order", "target_order", "horizon_observed_stops"))


@query("training_examples_m1", """
SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM examples""")
def training_examples(spark, sf):
    return shown(examples(spark, sf))


@query("calendar_features_p25", """
SELECT day_of_week, vantage_hour, count(*) AS n, min(vantage_minute_of_day) AS first_minute,
       max(vantage_minute_of_day) AS last_minute FROM examples GROUP BY 1, 2""")
def calendar_features(spark, sf):
    return examples(spark, sf).groupBy("day_of_week", "vantage_hour").agg(
        F.count(F.lit(1)).alias("n"), F.min("vantage_minute_of_day").alias("first_minute"),
        F.max("vantage_minute_of_day").alias("last_minute"))


SPLITS = {"train": ("2024-01-02", "2024-01-14"), "val": ("2024-01-15", "2024-01-20"),
          "test": ("2024-01-21", "2024-01-31")}


@query("split_by_date_p16", """
SELECT coalesce(CASE WHEN service_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-14' THEN 'train'
            WHEN service_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-20' THEN 'val'
            WHEN service_date BETWEEN DATE '2024-01-21' AND DATE '2024-01-31' AND service_date <> DATE '2024-01-25' THEN 'test' END, '') AS split,
       count(*) AS n FROM movements GROUP BY 1""")
def split_by_date(spark, sf):
    moves, _ = views.movements(spark, sf)
    split = times.split_of("service_date", SPLITS, excluded=("2024-01-25",))
    return moves.groupBy(F.coalesce(split, F.lit("")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("lead_bands_p12", f"""
SELECT coalesce(band, '') AS band, count(*) AS n FROM (
  SELECT {band_sql('horizon_sched_sec')} AS band FROM examples) GROUP BY 1""")
def lead_bands(spark, sf):
    return (examples(spark, sf)
            .groupBy(F.coalesce(times.band("horizon_sched_sec"), F.lit("")).alias("band"))
            .agg(F.count(F.lit(1)).alias("n")))


def baseline(ex):
    banded = ex.withColumns({
        "horizon": F.col("horizon_observed_stops").cast("string"),
        "band": times.band("horizon_sched_sec"),
    })
    predictors = {"zero": F.lit(0), "persistence": F.col("current_delay_sec")}
    return metrics.predictor_report(banded, predictors, ["horizon", "band"])


BASELINE_SQL = f"""
SELECT predictor, scope, key, count(*) AS n, {fixed_sql('avg(abs(err))')} AS mae_sec,
       {fixed_sql('quantile_cont(abs(err), 0.5)')} AS medae_sec, {fixed_sql('avg(err)')} AS bias_sec
FROM (SELECT p.predictor, CASE WHEN p.predictor = 'zero' THEN 0 ELSE current_delay_sec END - target_delay_sec AS err,
             s.scope, CASE s.scope WHEN 'overall' THEN '' WHEN 'horizon' THEN CAST(horizon_observed_stops AS VARCHAR)
                      ELSE {band_sql('horizon_sched_sec')} END AS key
      FROM examples CROSS JOIN (VALUES ('zero'), ('persistence')) AS p(predictor)
      CROSS JOIN (VALUES ('overall'), ('horizon'), ('band')) AS s(scope)
      WHERE TRUSTED)
WHERE key IS NOT NULL GROUP BY 1, 2, 3"""


@query("baseline_report_a16", BASELINE_SQL.replace("TRUSTED", "auto_vantage = '1' AND auto_target = '1'"))
def baseline_report(spark, sf):
    return shown(baseline(journeys.trusted(examples(spark, sf))))


@query("baseline_report_all_records_a2", BASELINE_SQL.replace("TRUSTED", "true"))
def baseline_report_all(spark, sf):
    return shown(baseline(examples(spark, sf)))


@query("drop_consecutive_duplicates_w12", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, location_code FROM (
  SELECT *, lag(location_code) OVER (PARTITION BY service_date, train_code ORDER BY location_order) AS prev FROM movements)
WHERE prev IS DISTINCT FROM location_code""")
def drop_consecutive_duplicates(spark, sf):
    moves, t = views.movements(spark, sf)
    return shown(journeys.changed_only(moves, t, "location_code").select(
        *KEYS, "location_order", "location_code"))
