"""Predict or decline, boards, targets, the offline head-to-head, over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import times
from ..operators import board, calibration, journeys, model, predict, scoring
from ..operators.asof import ranked_reports, vantage_of_any, vantage_of_consistent
from ..operators.ordered import first_by
from ..plans import serve
from .oracle_views import VIEWS, band_sql
from .registry import fixed_sql, query, shown

KEYS = list(journeys.JOURNEY)
EVENT = list(scoring.EVENT)

VIEWS["asked"] = """
  SELECT DISTINCT service_date, train_code, location_code, at_sec FROM (
    SELECT service_date, train_code, CASE WHEN location_order % 17 = 0 THEN 'S99' ELSE location_code END AS location_code, made_sec AS at_sec FROM predictions
    UNION ALL SELECT service_date, concat('N', train_code), location_code, made_sec FROM predictions WHERE location_order = 3)"""
VIEWS["route"] = """
  SELECT service_date, train_code, location_code, location_order AS target_order, sched_abs, delay_sec, auto_arrival, sched_abs + delay_sec AS arr_abs
  FROM (SELECT *, row_number() OVER (PARTITION BY service_date, train_code, location_code ORDER BY location_order) AS rn FROM prep) WHERE rn = 1"""
VIEWS["runs"] = "SELECT service_date, train_code, bool_and(consistent) AS consistent FROM prep GROUP BY ALL"
VIEWS["asked_on_route"] = """
  SELECT a.*, r.target_order, r.sched_abs, r.delay_sec, r.auto_arrival, r.arr_abs, j.consistent FROM asked a
  LEFT JOIN route r USING (service_date, train_code, location_code) LEFT JOIN runs j USING (service_date, train_code)"""
VIEWS["seen"] = """
  SELECT a.*, v.location_order AS vantage_order, v.location_code AS vantage_location, v.delay_sec AS vantage_delay_sec,
         v.auto_arrival AS vantage_auto, v.sched_abs AS vantage_sched_abs
  FROM asked_on_route a LEFT JOIN (
    SELECT a.service_date, a.train_code, a.location_code, a.at_sec, max(p.location_order) AS vo
    FROM asked_on_route a JOIN prep p ON p.service_date = a.service_date AND p.train_code = a.train_code
      AND p.delay_sec IS NOT NULL AND p.location_order < a.target_order AND p.sched_abs + p.delay_sec <= a.at_sec GROUP BY ALL) b
    ON b.service_date = a.service_date AND b.train_code = a.train_code AND b.location_code = a.location_code AND b.at_sec = a.at_sec
  LEFT JOIN prep v ON v.service_date = a.service_date AND v.train_code = a.train_code AND v.location_order = b.vo"""
VIEWS["decided"] = """
  SELECT *, CASE WHEN consistent IS NULL THEN 'not_in_service' WHEN NOT consistent THEN 'journey_inconsistent'
                 WHEN target_order IS NULL THEN 'station_not_on_route' WHEN sched_abs IS NULL THEN 'no_scheduled_arrival'
                 WHEN sched_abs - at_sec > 14400 THEN 'lead_out_of_range' WHEN arr_abs <= at_sec THEN 'already_arrived'
                 WHEN vantage_order IS NULL THEN 'no_upstream_report' WHEN vantage_delay_sec < -1800 THEN 'vantage_delay_out_of_range' END AS reason
  FROM seen"""


def asked(moves, t):
    p = views.predictions(moves, t)
    odd = p.withColumn("location_code", F.when(F.col("location_order") % 17 == 0, "S99").otherwise(F.col("location_code")))
    gone = p.where("location_order = 3").withColumn("train_code", F.concat(F.lit("N"), "train_code"))
    cols = [*EVENT, F.col("made_sec").alias("at_sec")]
    return odd.select(*cols).unionByName(gone.select(*cols)).distinct()


def decided(spark, sf):
    moves, t = views.movements(spark, sf)
    return predict.decide(asked(moves, t), journeys.prepared(moves, t), t).drop("vantage_order", "target_order")


@query("predict_or_decline_m7", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, at_sec,
       CASE WHEN reason IS NULL THEN 'predicted' ELSE 'declined' END AS outcome, reason,
       CASE WHEN consistent THEN sched_abs - at_sec END AS lead_sec, CASE WHEN consistent THEN {band_sql('(sched_abs - at_sec)')} END AS lead_band,
       CASE WHEN reason IS NULL OR reason = 'vantage_delay_out_of_range' THEN vantage_location END AS vantage_location,
       CASE WHEN reason IS NULL OR reason = 'vantage_delay_out_of_range' THEN vantage_delay_sec END AS vantage_delay_sec,
       CASE WHEN reason IS NULL THEN vantage_auto END AS vantage_auto,
       CASE WHEN reason IS NULL THEN target_order - vantage_order END AS horizon_route_stops,
       CASE WHEN reason IS NULL THEN sched_abs - vantage_sched_abs END AS horizon_sched_sec
FROM decided""")
def predict_or_decline(spark, sf):
    return shown(decided(spark, sf))


@query("decline_reasons_a6", """
SELECT coalesce(reason, 'predicted') AS reason, count(*) AS n FROM decided GROUP BY 1""")
def decline_reasons(spark, sf):
    return decided(spark, sf).groupBy(F.coalesce("reason", F.lit("predicted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("vantage_live_j3", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, at_sec, vantage_order FROM seen WHERE consistent AND target_order IS NOT NULL""")
def vantage_live(spark, sf):
    moves, t = views.movements(spark, sf)
    prep = journeys.prepared(moves, t).where("consistent")
    on_route = asked(moves, t).join(predict.targets_on_route(prep, t), EVENT)
    return shown(vantage_of_consistent(on_route, ranked_reports(prep, t), t).select(*EVENT, "at_sec", "vantage_order"))


VIEWS["strict"] = """
  SELECT a.service_date, a.train_code, a.location_code, a.at_sec, max(p.location_order) AS vantage_order
  FROM asked_on_route a LEFT JOIN prep p ON p.service_date = a.service_date AND p.train_code = a.train_code AND p.auto_arrival = '1'
    AND p.delay_sec IS NOT NULL AND p.location_order < a.target_order AND p.sched_abs + p.delay_sec < a.at_sec
  WHERE a.target_order IS NOT NULL GROUP BY ALL"""


@query("vantage_strict_any_order_j3", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM strict")
def vantage_strict(spark, sf):
    moves, t = views.movements(spark, sf)
    prep = journeys.prepared(moves, t)
    on_route = asked(moves, t).join(predict.targets_on_route(prep, t, auto_only=True), EVENT)
    named = on_route.withColumn("request_id", F.xxhash64(*EVENT, "at_sec"))
    return shown(vantage_of_any(named, ranked_reports(prep, t, auto_only=True), t).select(*EVENT, "at_sec", "vantage_order"))


VIEWS["compared"] = f"""
  SELECT *, CASE WHEN drop_reason IS NULL THEN {band_sql('lead')} END AS lead_band FROM (
    SELECT p.service_date, p.train_code, p.location_code, p.station_group, p.location_order AS poll_order, p.poll_sec AS at_sec, p.eta_sec,
           r.arr_abs, r.delay_sec, v.delay_sec AS cur, r.sched_abs - p.poll_sec AS lead,
           CASE WHEN j.consistent IS NULL THEN 'no journey' WHEN r.target_order IS NULL THEN 'station not on route'
                WHEN r.arr_abs IS NULL THEN 'no recorded arrival' WHEN r.auto_arrival <> '1' THEN 'target AutoArrival != 1'
                WHEN p.poll_sec >= r.arr_abs THEN 'poll after arrival' WHEN s.vo IS NULL THEN 'nothing observed yet'
                WHEN r.sched_abs - p.poll_sec < 0 THEN 'no usable lead time' END AS drop_reason
    FROM live_polls p LEFT JOIN route r USING (service_date, train_code, location_code) LEFT JOIN runs j USING (service_date, train_code)
    LEFT JOIN (SELECT p.service_date, p.train_code, p.location_code, p.poll_sec, max(q.location_order) AS vo
               FROM live_polls p JOIN route r USING (service_date, train_code, location_code)
               JOIN prep q ON q.service_date = p.service_date AND q.train_code = p.train_code AND q.auto_arrival = '1' AND q.delay_sec IS NOT NULL
                 AND q.location_order < r.target_order AND q.sched_abs + q.delay_sec < p.poll_sec GROUP BY ALL) s
      ON s.service_date = p.service_date AND s.train_code = p.train_code AND s.location_code = p.location_code AND s.poll_sec = p.poll_sec
    LEFT JOIN prep v ON v.service_date = p.service_date AND v.train_code = p.train_code AND v.location_order = s.vo)"""
VIEWS["live_polls"] = """
  SELECT CASE WHEN location_order % 14 = 0 THEN concat('N', train_code) ELSE train_code END AS train_code,
         CASE WHEN location_order % 10 = 0 THEN 'S99' ELSE location_code END AS location_code, * EXCLUDE (train_code, location_code) FROM polls"""


def compared(spark, sf):
    moves, t = views.movements(spark, sf)
    p = views.polls(moves)
    o = F.col("location_order")
    live = p.withColumns({
        "train_code": F.when(o % 14 == 0, F.concat(F.lit("N"), "train_code")).otherwise(F.col("train_code")),
        "location_code": F.when(o % 10 == 0, "S99").otherwise(F.col("location_code")),
        "request_id": F.xxhash64(*KEYS, "location_order", "poll_sec"),
    })
    return predict.compare_with_rival(live, journeys.prepared(moves, t), t, F.col("vantage_delay_sec"))


@query("comparison_drop_reasons_j28", """
SELECT coalesce(drop_reason, 'compared') AS drop_reason, count(*) AS n FROM compared GROUP BY 1""")
def comparison_drop_reasons(spark, sf):
    return compared(spark, sf).groupBy(F.coalesce("drop_reason", F.lit("compared")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("offline_head_to_head_j28", f"""
SELECT lead_band, count(*) AS n, {fixed_sql('avg(abs(model))')} AS model_mae_sec, {fixed_sql('avg(abs(rival))')} AS rival_mae_sec,
       {fixed_sql('quantile_cont(abs(model), 0.5)')} AS model_medae_sec, count(*) FILTER (abs(model) < abs(rival)) AS wins
FROM (SELECT lead_band, CAST(round_even(cur / 60.0, 0) AS BIGINT) * 60 - delay_sec AS model,
             eta_sec + CASE WHEN eta_sec < arr_abs - 43200 THEN 86400 ELSE 0 END - arr_abs AS rival,
             row_number() OVER (PARTITION BY service_date, train_code, location_code, lead_band ORDER BY at_sec DESC, poll_order) AS rn
      FROM compared WHERE drop_reason IS NULL) WHERE rn = 1 GROUP BY 1""")
def offline_head_to_head(spark, sf):
    last = predict.last_comparison(compared(spark, sf))
    m, r = F.abs("model_err_rounded_sec"), F.abs("rival_err_sec")
    return shown(last.groupBy("lead_band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(m).alias("model_mae_sec"), F.avg(r).alias("rival_mae_sec"),
        F.percentile(m, 0.5).alias("model_medae_sec"), F.count_if(m < r).alias("wins")))


BANDS = "['0-5 min', '5-15 min', '15-30 min', '30-60 min', '60+ min']"


@query("choose_targets_w14", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_order, lead_band, lead_sec FROM (
  SELECT *, row_number() OVER (PARTITION BY service_date, train_code ORDER BY list_position({BANDS}, lead_band)) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY service_date, train_code, lead_band
             ORDER BY md5(concat('5|', train_code, '|', CAST(service_date AS VARCHAR), '|', CAST(location_order AS VARCHAR))), location_order) AS rn
    FROM (SELECT *, sched_abs - 80000 AS lead_sec, {band_sql('(sched_abs - 80000)')} AS lead_band FROM prep
          WHERE NOT coalesce(sched_abs + delay_sec <= 80000, false) AND sched_abs - 80000 <= 14400)
    WHERE lead_band IS NOT NULL) WHERE rn = 1) WHERE k <= 3""")
def choose_targets(spark, sf):
    moves, t = views.movements(spark, sf)
    prep = journeys.unwrapped(journeys.with_delay(moves), t)
    return shown(predict.choose_targets(prep, F.lit(80000), 3, 5).select(*KEYS, "location_order", "lead_band", "lead_sec"))


VIEWS["board_rows"] = """
  SELECT p.service_date, p.location_code, CAST(floor(p.poll_sec / 3600) AS BIGINT) AS board_hour, p.train_code, p.location_order, p.poll_sec,
         CASE WHEN p.location_order % 6 = 0 THEN 999 ELSE CAST(floor((p.eta_sec % 3600) / 60) AS BIGINT) END AS due_min,
         CASE WHEN ((p.poll_sec - o) % 86400 + 86400) % 86400 < 43200 THEN 'departed' ELSE 'not_yet_departed' END AS scope
  FROM polls p JOIN (SELECT service_date, train_code, min_by(sched_sec, location_order) AS o FROM movements GROUP BY ALL) USING (service_date, train_code)"""


def board_rows(spark, sf):
    moves, _ = views.movements(spark, sf)
    origin = first_by(moves, KEYS, ["location_order"]).select(*KEYS, F.col("sched_sec").alias("o"))
    p = views.polls(moves).join(origin, KEYS)
    return p.select(
        "service_date", "location_code", F.floor(F.col("poll_sec") / 3600).alias("board_hour"), "train_code", "location_order", "poll_sec",
        F.when(F.col("location_order") % 6 != 0, F.floor(F.col("eta_sec") % 3600 / 60)).alias("due_min"),
        times.departed("o", "poll_sec").alias("scope"))


@query("board_l1", """
SELECT CAST(service_date AS VARCHAR) AS service_date, location_code, board_hour, train_code, location_order, poll_sec, due_min, scope,
       CASE WHEN scope = 'departed' AND rn <= 2 THEN rn END AS position,
       CASE WHEN scope <> 'departed' THEN 'not_yet_departed' WHEN rn > 2 THEN 'not_asked' ELSE 'predict' END AS action
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY service_date, location_code, board_hour, scope ORDER BY due_min, train_code, location_order, poll_sec) AS INT) AS rn FROM board_rows)""")
def station_board(spark, sf):
    return shown(board.board(board_rows(spark, sf), ["service_date", "location_code", "board_hour"], 2,
                             ["train_code", "location_order", "poll_sec"]))


CALLS = "CASE location_type WHEN 'O' THEN 'starts here' WHEN 'S' THEN 'stops here' WHEN 'D' THEN 'ends here' WHEN 'T' THEN 'passes through' WHEN 'C' THEN 'stops here' ELSE 'calls here' END"
HHMM = "concat(lpad(CAST((X) // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST((X) % 3600 // 60 AS VARCHAR), 2, '0'))"


@query("calling_pattern_m9_p15", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code,
       CAST(row_number() OVER (PARTITION BY service_date, train_code ORDER BY location_order) AS INT) AS position, location_code AS code,
       CASE WHEN location_name = '' THEN location_code ELSE location_name END AS name,
       {HHMM.replace('X', "CASE WHEN location_type = 'O' THEN (sched_sec + 60) % 86400 ELSE sched_sec END")} AS scheduled,
       CASE WHEN arr_sec IS NOT NULL THEN {HHMM.replace('X', 'arr_sec')} END AS arrived,
       location_code = 'S5' AS here, location_type = 'T' AS passes, {CALLS} AS calls_as
FROM named WHERE location_type <> 'T' OR location_code = 'S5'""")
def calling_pattern(spark, sf):
    moves, t = views.movements(spark, sf)
    stops = views.named_movements(moves).withColumns({
        "sched_arr_text": F.when(F.col("location_type") == "O", "00:00").otherwise(times.clock_text("sched_sec")),
        "sched_dep_text": times.clock_text(F.col("sched_sec") + 60),
    })
    return shown(board.calling_pattern(stops, t, F.col("location_code") == "S5", F.lit(False)))


VIEWS["station_rows"] = f"""
  SELECT code, [{', '.join(f"'{n}'" for n in views.STATION_NAMES)}][n + 1] AS name, n % 3 = 0 AS polled, n % 2 = 0 AS model_known
  FROM (SELECT DISTINCT location_code AS code, CAST(substr(location_code, 2) AS INT) AS n FROM movements)"""


def station_rows(moves):
    n = F.substring("code", 2, 9).cast("int")
    return views.stations(moves).select("code", "name", (n % 3 == 0).alias("polled"), (n % 2 == 0).alias("model_known"))


@query("station_picker_a39", """
SELECT code, name, polled, model_known, coalesce((SELECT string_agg(code, ',' ORDER BY rn) FROM ranked r WHERE r.name = a.name AND r.rn > 1), '') AS aliases
FROM ranked a WHERE rn = 1""")
def station_picker(spark, sf):
    return board.picker(station_rows(views.movements(spark, sf)[0])).select("code", "name", "polled", "model_known", "aliases")


VIEWS["ranked"] = "SELECT *, row_number() OVER (PARTITION BY name ORDER BY polled DESC, model_known DESC, code) AS rn FROM station_rows"


@query("alias_retry_j16", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, called_code, coalesce(called_code <> location_code, false) AS by_alias FROM (
  SELECT a.service_date, a.train_code, a.location_code, m.location_code AS called_code,
         row_number() OVER (PARTITION BY a.service_date, a.train_code, a.location_code ORDER BY m.location_code = a.location_code DESC NULLS LAST, m.location_code, m.location_order) AS rn
  FROM (SELECT DISTINCT service_date, train_code, CASE location_code WHEN 'S11' THEN 'S12' WHEN 'S5' THEN 'S6' ELSE location_code END AS location_code FROM movements) a
  LEFT JOIN station_rows n ON n.code = a.location_code
  LEFT JOIN (SELECT m.*, s.name FROM movements m JOIN station_rows s ON s.code = m.location_code) m
    ON m.service_date = a.service_date AND m.train_code = a.train_code AND m.name = n.name) WHERE rn = 1""")
def alias_retry(spark, sf):
    moves, _ = views.movements(spark, sf)
    c = F.col("location_code")
    asked_ = moves.select(*KEYS, F.when(c == "S11", "S12").when(c == "S5", "S6").otherwise(c).alias("location_code")).distinct()
    return shown(board.alias_stop(asked_, moves, views.stations(moves)))


@query("current_run_j17", """
SELECT a.train_code, CAST(a.today AS VARCHAR) AS today, a.wall_sec,
       CAST(CASE WHEN a.wall_sec < 10800 AND NOT coalesce(n.started, false) AND coalesce(y.started, false) AND NOT coalesce(y.finished, true)
            THEN a.today - 1 ELSE a.today END AS VARCHAR) AS service_date
FROM asked_runs a LEFT JOIN run_sums n ON n.train_code = a.train_code AND n.service_date = a.today
LEFT JOIN run_sums y ON y.train_code = a.train_code AND y.service_date = a.today - 1""")
def current_run(spark, sf):
    moves, _ = views.movements(spark, sf)
    runs = board.run_summary(moves)
    asked_ = moves.select("train_code", F.date_add("service_date", 1).alias("today"), (F.col("location_order") * 1200 % 86400).alias("wall_sec")).distinct()
    return shown(board.current_run(asked_, runs))


VIEWS["run_sums"] = """
  SELECT service_date, train_code, bool_or(arr_sec IS NOT NULL) AS started, max_by(arr_sec IS NOT NULL, location_order) AS finished FROM movements GROUP BY ALL"""
VIEWS["asked_runs"] = "SELECT DISTINCT train_code, service_date + 1 AS today, location_order * 1200 % 86400 AS wall_sec FROM movements"


@query("snapshot_journeys_j18", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, count(*) AS stops FROM movements
WHERE (service_date, train_code) IN (SELECT (service_date, train_code) FROM decided WHERE reason IS NULL) GROUP BY 1, 2""")
def snapshot_journeys(spark, sf):
    moves, t = views.movements(spark, sf)
    rows = predict.decide(asked(moves, t), journeys.prepared(moves, t), t)
    return shown(predict.snapshot_journeys(moves, rows).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("stops")))


@query("headline_pick_l5", """
SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, location_code, CAST(lead_sec // 60 AS BIGINT) AS ahead_min FROM predictions
WHERE outcome = 'predicted' AND lead_sec // 60 BETWEEN 10 AND 45 AND q10_sec // 60 <> q90_sec // 60
ORDER BY abs(lead_sec // 60 - 20), service_date, train_code, location_code LIMIT 1""")
def headline_pick(spark, sf):
    p = views.predictions(*views.movements(spark, sf)).where("outcome = 'predicted'")
    rows = p.withColumns({
        "ahead_min": F.floor(F.col("lead_sec") / 60), "low_text": F.floor(F.col("q10_sec") / 60), "high_text": F.floor(F.col("q90_sec") / 60)})
    return shown(predict.headline(rows).select(*EVENT, "ahead_min"))


@query("station_lookup_l7", """
SELECT q.lookup, CASE WHEN count(*) FILTER (lower(s.name) = q.lookup) = 1 THEN max(s.code) FILTER (lower(s.name) = q.lookup)
                 WHEN count(s.code) = 1 THEN max(s.code) ELSE '' END AS code
FROM (SELECT DISTINCT lower(substr(name, 1, 4)) AS lookup FROM station_rows UNION SELECT lower(name) FROM station_rows) q
LEFT JOIN station_rows s ON starts_with(lower(s.name), q.lookup) GROUP BY 1""")
def station_lookup(spark, sf):
    st = views.stations(views.movements(spark, sf)[0])
    asked_ = st.select(F.lower(F.substring("name", 1, 4)).alias("lookup")).union(st.select(F.lower("name")))
    return board.find_station(asked_, st)


@query("station_config_s12", """
SELECT code, name, min(station_group) AS station_group FROM (SELECT location_code AS code, station_group FROM movements) JOIN station_rows USING (code) GROUP BY 1, 2""")
def station_config(spark, sf):
    moves, _ = views.movements(spark, sf)
    groups = moves.select(F.lower("location_code").alias("code"), "station_group").distinct()
    return board.station_config(groups, views.stations(moves).select("code", "name")).select("code", "name", "station_group")


VIEWS["told"] = """
  SELECT d.*, v.delay_sec AS current_delay_sec, v.sched_sec AS v_sec, s.sched_sec AS target_sched_sec,
         ((s.sched_sec - v.sched_sec + 43200) % 86400 + 86400) % 86400 - 43200 AS ahead_sec
  FROM (SELECT * FROM decided WHERE reason IS NULL) d
  JOIN prep v ON v.service_date = d.service_date AND v.train_code = d.train_code AND v.location_order = d.vantage_order
  JOIN prep s ON s.service_date = d.service_date AND s.train_code = d.train_code AND s.location_order = d.target_order"""
VIEWS["told_cells"] = f"""
  SELECT t.*, current_delay_sec + coalesce(c.d10, b.d10, o.d10) AS q10, current_delay_sec + coalesce(c.d50, b.d50, o.d50) AS q50, current_delay_sec + coalesce(c.d90, b.d90, o.d90) AS q90
  FROM (SELECT *, {band_sql('ahead_sec')} AS ahead_band, {band_sql('(sched_abs - at_sec)')} AS lead_band FROM told) t LEFT JOIN (SELECT * FROM cell_model WHERE level = 0) c ON c.target_location = t.location_code AND c.band = t.ahead_band
  LEFT JOIN (SELECT * FROM cell_model WHERE level = 2) b ON b.band = t.ahead_band CROSS JOIN (SELECT * FROM cell_model WHERE level = 3) o"""
VIEWS["told_sorted"] = """
  SELECT *, list_sort([q10, q50, q90]) AS q FROM told_cells"""


@query("served_predictions_e3", """
SELECT CAST(t.service_date AS VARCHAR) AS service_date, t.train_code, t.location_code, at_sec, CAST(round_even(q[2], 0) AS INTEGER) AS q50_sec,
       least(CAST(round_even(q[1], 0) AS INTEGER) + coalesce(b.lo, 0), CAST(round_even(q[2], 0) AS INTEGER)) AS served_q10_sec,
       greatest(CAST(round_even(q[3], 0) AS INTEGER) + coalesce(b.hi, 0), CAST(round_even(q[2], 0) AS INTEGER)) AS served_q90_sec
FROM told_sorted t LEFT JOIN (SELECT * FROM cal WHERE station_group IS NULL) b ON b.lead_band = coalesce(t.lead_band, '0-5 min')""")
def served_predictions(spark, sf):
    """Cell quantiles on served features, calibrated by the bands of the scored predictions."""
    from .models import halves
    from .scores import scored
    moves, t = views.movements(spark, sf)
    cells = model.fit_cells(halves(spark, sf)[0])
    cal = calibration.fit(calibration.residuals(scored(spark, sf)))
    rows = serve.predictions(asked(moves, t), journeys.prepared(moves, t), t, lambda ex: model.apply_cells(ex, cells), cal)
    return shown(rows.where("outcome = 'predicted'").select(*EVENT, "at_sec", "q50_sec", "served_q10_sec", "served_q90_sec"))
