"""The views as SQL, written apart from the Spark code so that one checks the other."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["movements"] = """
  SELECT make_date(2024, 1, 1 + 6 * blk) AS service_date,
         concat('T', CAST(user_id AS VARCHAR(20))) AS train_code,
         CAST(row_number() OVER (PARTITION BY user_id, blk ORDER BY blk_sec, event_id) AS INT) AS location_order,
         concat('S', CAST(k % 20 AS VARCHAR(4))) AS location_code,
         event_type AS station_group,
         sched_abs % 86400 AS sched_sec,
         CASE WHEN k % 7 = 0 THEN NULL ELSE (sched_abs + d) % 86400 END AS arr_sec,
         CASE WHEN k % 7 = 0 THEN '' WHEN k % 10 = 0 THEN '0' ELSE '1' END AS auto_arrival
  FROM (SELECT *, 72000 + 6 * CAST(floor(blk_sec / 120) AS INT) AS sched_abs,
               CASE WHEN k % 20 = 0 THEN 0 ELSE 6 * (CAST(floor(value / 2) AS INT) - 10) END AS d
        FROM (SELECT event_id, user_id, event_type, value,
                     CAST(floor((EXTRACT(DAY FROM ts) - 1) / 6) AS INT) AS blk,
                     CAST((EXTRACT(DAY FROM ts) - 1) % 6 * 86400 + EXTRACT(HOUR FROM ts) * 3600
                          + EXTRACT(MINUTE FROM ts) * 60 + floor(EXTRACT(SECOND FROM ts)) AS INT) AS blk_sec,
                     CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
              FROM events))"""

VIEWS["prep"] = """
  SELECT m.*, delay_sec, sched_abs, coalesce(c.consistent, true) AS consistent
  FROM (SELECT *, (arr_sec - sched_sec + 129600) % 86400 - 43200 AS delay_sec,
               sched_sec + CASE WHEN sched_sec < 72000 THEN 86400 ELSE 0 END AS sched_abs
        FROM movements) m
  LEFT JOIN (SELECT service_date, train_code, bool_and(coalesce(moment >= prev_at, true)) AS consistent
             FROM (SELECT service_date, train_code, moment,
                          lag(moment) OVER (PARTITION BY service_date, train_code ORDER BY location_order) AS prev_at
                   FROM (SELECT *, sched_sec + CASE WHEN sched_sec < 72000 THEN 86400 ELSE 0 END
                                   + (arr_sec - sched_sec + 129600) % 86400 - 43200 AS moment
                         FROM movements WHERE arr_sec IS NOT NULL))
             GROUP BY ALL) c
  ON m.service_date = c.service_date AND m.train_code = c.train_code"""

VIEWS["observed"] = """
  SELECT *, CAST(row_number() OVER (PARTITION BY service_date, train_code ORDER BY location_order) AS INT) AS obs_rank
  FROM prep WHERE delay_sec IS NOT NULL AND consistent"""

VIEWS["examples"] = """
  SELECT v.service_date, v.train_code,
         ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(v.service_date)] AS day_of_week,
         v.location_order AS vantage_order, s.location_order AS target_order,
         v.location_code AS vantage_location, s.location_code AS target_location,
         v.sched_sec AS vantage_sched_sec, s.sched_sec AS target_sched_sec,
         v.sched_sec // 3600 AS vantage_hour, v.sched_sec // 60 AS vantage_minute_of_day,
         v.station_group,
         v.delay_sec AS current_delay_sec, p1.delay_sec AS prev_delay_sec, p2.delay_sec AS prev2_delay_sec,
         h.h AS horizon_observed_stops, s.location_order - v.location_order AS horizon_route_stops,
         s.sched_abs - v.sched_abs - CASE WHEN s.sched_abs - v.sched_abs > 43200 THEN 86400 ELSE 0 END AS horizon_sched_sec,
         v.auto_arrival AS auto_vantage, s.auto_arrival AS auto_target, s.delay_sec AS target_delay_sec
  FROM observed v CROSS JOIN (VALUES (1), (3), (5), (10)) AS h(h)
  JOIN observed s ON s.service_date = v.service_date AND s.train_code = v.train_code AND s.obs_rank = v.obs_rank + h.h
  LEFT JOIN observed p1 ON p1.service_date = v.service_date AND p1.train_code = v.train_code AND p1.obs_rank = v.obs_rank - 1
  LEFT JOIN observed p2 ON p2.service_date = v.service_date AND p2.train_code = v.train_code AND p2.obs_rank = v.obs_rank - 2"""

VIEWS["polls"] = """
  SELECT m.service_date, m.train_code, m.location_code, m.location_order, m.station_group,
         m.sched_sec + CASE WHEN m.sched_sec < 72000 THEN 86400 ELSE 0 END - l.lead AS poll_sec,
         CAST(floor((m.sched_sec + CASE WHEN m.sched_sec < 72000 THEN 86400 ELSE 0 END
              + coalesce((m.arr_sec - m.sched_sec + 129600) % 86400 - 43200, 0)
              - floor(l.lead / 10)) / 60) AS INT) * 60 % 86400 AS eta_sec
  FROM movements m CROSS JOIN (VALUES (3000), (1500), (1200), (200)) AS l(lead)
  WHERE m.location_order % 2 = 0"""

VIEWS["predictions"] = """
  SELECT v.service_date, v.train_code, v.location_code, v.location_order, v.station_group,
         v.sched_sec + CASE WHEN v.sched_sec < 72000 THEN 86400 ELSE 0 END - l.lead AS made_sec,
         l.lead AS lead_sec,
         CASE WHEN v.cur IS NULL THEN 'declined' ELSE 'predicted' END AS outcome,
         v.cur - 60 AS q10_sec, v.cur AS q50_sec, v.cur + 60 + CAST(floor(l.lead / 10) AS INT) AS q90_sec
  FROM (SELECT *, max(CASE WHEN delay IS NOT NULL THEN location_order * 100000 + delay + 50000 END)
                    OVER (PARTITION BY service_date, train_code ORDER BY location_order
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 100000 - 50000 AS cur
        FROM (SELECT *, (arr_sec - sched_sec + 129600) % 86400 - 43200 AS delay FROM movements)) v
  CROSS JOIN (VALUES (1400), (1100), (400)) AS l(lead)"""


def band_sql(x: str) -> str:
    return (f"CASE WHEN {x} < 0 THEN NULL WHEN {x} < 300 THEN '0-5 min' WHEN {x} < 900 THEN '5-15 min' "
            f"WHEN {x} < 1800 THEN '15-30 min' WHEN {x} < 3600 THEN '30-60 min' WHEN {x} < 1000000000 THEN '60+ min' END")


VIEWS["kept"] = f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY service_date, train_code, location_code, lead_band
                                 ORDER BY made_sec DESC, location_order) AS rn
    FROM (SELECT *, {band_sql('lead_sec')} AS lead_band FROM predictions)) WHERE rn = 1"""

VIEWS["outcome"] = """
  SELECT service_date, train_code, location_code, stop_order, sched_abs, sched_abs + delay_sec AS arr_abs,
         delay_sec AS actual_delay_sec, auto_arrival
  FROM (SELECT *, location_order AS stop_order,
               row_number() OVER (PARTITION BY service_date, train_code, location_code ORDER BY location_order) AS rn
        FROM prep) WHERE rn = 1"""

VIEWS["rival"] = f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY service_date, train_code, location_code, lead_band
                                 ORDER BY rival_poll_sec DESC, location_order) AS rn
    FROM (SELECT p.service_date, p.train_code, p.location_code, p.location_order,
                 {band_sql('o.sched_abs - p.poll_sec')} AS lead_band,
                 p.poll_sec AS rival_poll_sec, p.eta_sec AS rival_eta_sec, p.station_group AS rival_group
          FROM polls p JOIN outcome o USING (service_date, train_code, location_code)
          WHERE p.poll_sec < o.arr_abs)
    WHERE lead_band IS NOT NULL) WHERE rn = 1"""

VIEWS["scores"] = """
  SELECT service_date, train_code, location_code, lead_band, location_order, station_group, made_sec, lead_sec,
         outcome, q10_sec, q50_sec, q90_sec, score_state,
         CASE WHEN g THEN auto_arrival END AS auto_arrival,
         CASE WHEN g THEN actual END AS actual_delay_sec,
         CASE WHEN g THEN q50_sec - actual END AS model_err_sec,
         CASE WHEN g THEN CAST(round_even(q50_sec / 60.0, 0) AS BIGINT) * 60 - actual END AS model_err_rounded_sec,
         CASE WHEN g THEN actual BETWEEN q10_sec AND q90_sec END AS interval_hit,
         CASE WHEN g THEN actual BETWEEN q10_sec AND q90_sec END AS raw_interval_hit,
         CASE WHEN g THEN rival_eta_sec + CASE WHEN rival_eta_sec < arr_abs - 43200 THEN 86400 ELSE 0 END - arr_abs END AS rival_err_sec,
         CASE WHEN g THEN rival_poll_sec END AS rival_poll_sec,
         CASE WHEN g THEN rival_group END AS rival_group
  FROM (SELECT *, score_state IN ('scored', 'echo_suspect') AS g FROM (
    SELECT k.*, o.actual_delay_sec AS actual, o.auto_arrival, o.arr_abs, r.rival_poll_sec, r.rival_eta_sec, r.rival_group,
           CASE WHEN k.outcome = 'declined' THEN 'declined'
                WHEN j.consistent IS NULL THEN 'train_not_found'
                WHEN NOT j.consistent THEN 'journey_inconsistent'
                WHEN o.stop_order IS NULL THEN 'not_on_route'
                WHEN o.actual_delay_sec IS NULL THEN 'no_actual_arrival'
                WHEN o.auto_arrival = '1' THEN 'scored' ELSE 'echo_suspect' END AS score_state
    FROM kept k
    LEFT JOIN outcome o USING (service_date, train_code, location_code)
    LEFT JOIN rival r ON r.service_date = k.service_date AND r.train_code = k.train_code
         AND r.location_code = k.location_code AND r.lead_band = k.lead_band
    LEFT JOIN (SELECT service_date, train_code, bool_and(consistent) AS consistent FROM prep GROUP BY ALL) j
         ON j.service_date = k.service_date AND j.train_code = k.train_code))"""


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, and the ones those name, in order."""
    needed: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in VIEWS:
            if name not in trail and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name], (*trail, name))
                if name not in needed:
                    needed.append(name)

    visit(sql, ())
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    return f"WITH {ctes}\n{sql.strip()}"
