"""Two collectors of the same boards, over the capture view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import parity
from .oracle_views import VIEWS
from .registry import fixed_sql, query, shown

VIEWS["captures"] = """
  SELECT side, CAST(floor(t / 300) * 300 + c.c * 300 + lag AS BIGINT) AS cycle_sec,
         CAST(ts AS DATE) AS service_date, concat('T', CAST(user_id AS VARCHAR)) AS train_code,
         concat('S', CAST(k % 20 AS VARCHAR)) AS station_code, event_type AS station_group,
         CAST(floor((value + (c.c + CASE WHEN side = 'cloud' AND k % 3 = 0 THEN 1 ELSE 0 END) * 7) / 10) AS INT) AS eta,
         event_id, k
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, floor(epoch(ts)) AS t FROM events) e
  CROSS JOIN (VALUES ('local', 0, 11), ('cloud', 85, 13)) AS s(side, lag, miss)
  CROSS JOIN (VALUES (0), (1), (2)) AS c(c) WHERE k % miss <> 0"""
VIEWS["cycle_set"] = "SELECT DISTINCT side, cycle_sec FROM captures"
VIEWS["run_set"] = """
  SELECT *, sum(broke) OVER (PARTITION BY side ORDER BY cycle_sec) AS run
  FROM (SELECT *, CASE WHEN cycle_sec - lag(cycle_sec) OVER (PARTITION BY side ORDER BY cycle_sec) > 900 THEN 1 ELSE 0 END AS broke FROM cycle_set)"""
VIEWS["windows"] = """
  SELECT side, min(cycle_sec) AS start_sec, max(cycle_sec) AS end_sec
  FROM (SELECT *, row_number() OVER (PARTITION BY side, run ORDER BY cycle_sec) AS up,
               row_number() OVER (PARTITION BY side, run ORDER BY cycle_sec DESC) AS down FROM run_set)
  WHERE up > 1 AND down > 1 GROUP BY side, run HAVING count(*) >= 2"""
VIEWS["overlap"] = """
  SELECT DISTINCT greatest(a.start_sec, b.start_sec) AS start_sec, least(a.end_sec, b.end_sec) AS end_sec
  FROM windows a JOIN windows b ON a.side = 'local' AND b.side = 'cloud' AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec"""
VIEWS["covered"] = """
  SELECT * FROM captures c WHERE EXISTS (SELECT 1 FROM overlap o WHERE c.cycle_sec BETWEEN o.start_sec AND o.end_sec)"""
VIEWS["pairs"] = """
  SELECT local_sec, cloud_sec, gap_sec FROM (
    SELECT a.cycle_sec AS local_sec, b.cycle_sec AS cloud_sec, abs(b.cycle_sec - a.cycle_sec) AS gap_sec,
           row_number() OVER (PARTITION BY a.cycle_sec ORDER BY abs(b.cycle_sec - a.cycle_sec), b.cycle_sec) AS rn
    FROM cycle_set a JOIN cycle_set b ON a.side = 'local' AND b.side = 'cloud' AND b.cycle_sec BETWEEN a.cycle_sec - 150 AND a.cycle_sec + 150)
  WHERE rn = 1"""
VIEWS["latest"] = """
  SELECT side, cycle_sec, service_date, train_code, station_code, max_by(eta, event_id) AS eta FROM captures GROUP BY ALL"""
VIEWS["around"] = """
  SELECT cycle_sec AS local_sec, service_date, train_code, station_code, eta AS local_eta,
         lag(cycle_sec) OVER w AS prev_sec, lag(eta) OVER w AS prev_eta, lead(cycle_sec) OVER w AS next_sec, lead(eta) OVER w AS next_eta
  FROM latest WHERE side = 'local' WINDOW w AS (PARTITION BY service_date, train_code, station_code ORDER BY cycle_sec)"""
VIEWS["value_pairs"] = """
  SELECT l.*, p.gap_sec, c.eta AS cloud_eta FROM around l JOIN pairs p ON l.local_sec = p.local_sec
  JOIN latest c ON c.side = 'cloud' AND c.cycle_sec = p.cloud_sec AND c.service_date = l.service_date
       AND c.train_code = l.train_code AND c.station_code = l.station_code"""


def _windows(cap):
    return parity.windows(cap)


def _overlap(cap):
    return parity.both_up(_windows(cap))


@query("captures_view", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM captures")
def captures_view(spark, sf):
    return shown(views.captures(spark, sf))


@query("cycle_status_a23", """
SELECT side, cycle_sec, attempted, failed, skipped, attempted - failed AS records,
       CASE WHEN attempted > 0 AND failed = 0 THEN CASE WHEN skipped > 0 THEN 'partial' ELSE 'complete' END
            WHEN failed = attempted THEN 'failed' ELSE 'degraded' END AS status
FROM (SELECT side, cycle_sec, count(*) FILTER (k % 19 <> 0) AS attempted, count(*) FILTER (k % 17 = 0 AND k % 19 <> 0) AS failed,
             count(*) FILTER (k % 19 = 0) AS skipped FROM captures GROUP BY 1, 2)""")
def cycle_status(spark, sf):
    cap = views.captures(spark, sf).withColumns({"skipped": F.col("k") % 19 == 0, "failed": F.col("k") % 17 == 0})
    return parity.cycle_report(cap)


@query("productive_cycles_s11", """
SELECT side, count(*) AS cycles FROM (
  SELECT side, cycle_sec FROM captures GROUP BY 1, 2 HAVING count(*) FILTER (k % 17 <> 0 AND k % 19 <> 0) > 0) GROUP BY 1""")
def productive_cycles(spark, sf):
    cap = views.captures(spark, sf).withColumns({"skipped": F.col("k") % 19 == 0, "failed": F.col("k") % 17 == 0})
    return parity.productive(parity.cycle_report(cap)).groupBy("side").agg(F.count(F.lit(1)).alias("cycles"))


@query("uptime_windows_w7", "SELECT * FROM windows")
def uptime_windows(spark, sf):
    return _windows(views.captures(spark, sf))


@query("longest_run_w11", "SELECT side, max(n) AS longest FROM (SELECT side, run, count(*) AS n FROM run_set GROUP BY 1, 2) GROUP BY 1")
def longest_run(spark, sf):
    return parity.longest_run(views.captures(spark, sf))


@query("both_up_j12", "SELECT * FROM overlap")
def both_up(spark, sf):
    return _overlap(views.captures(spark, sf))


@query("inside_windows_j13", "SELECT side, count(*) AS n FROM covered GROUP BY 1")
def inside_windows(spark, sf):
    cap = views.captures(spark, sf)
    return parity.inside_windows(cap, _overlap(cap)).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("day_coverage_a24", f"""
SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (common > 0) AS windows, {fixed_sql('coalesce(sum(common), 0) / 3600.0')} AS covered_h,
       19.0::DOUBLE AS active_h
FROM (SELECT d.day, CASE WHEN o.start_sec IS NULL THEN 0 ELSE greatest(0, least(o.end_sec, d.day_sec + 88200) - greatest(o.start_sec, d.day_sec + 19800)) END AS common
      FROM (SELECT DISTINCT CAST(make_timestamp(cycle_sec * 1000000) AS DATE) AS day, CAST(floor(cycle_sec / 86400) * 86400 AS BIGINT) AS day_sec FROM cycle_set) d
      LEFT JOIN overlap o ON o.start_sec < d.day_sec + 88200 AND o.end_sec > d.day_sec + 19800)
GROUP BY day""")
def day_coverage(spark, sf):
    cap = views.captures(spark, sf)
    return shown(parity.day_coverage(cap, _overlap(cap)))


@query("event_agreement_j15_u1", f"""
SELECT station_group, CAST(0 AS TINYINT) AS is_total, count(*) FILTER (l AND c) AS both, count(*) FILTER (l AND NOT c) AS local_only,
       count(*) FILTER (c AND NOT l) AS cloud_only, {fixed_sql('100 * count(*) FILTER (l AND c) / count(*)')} AS overlap_pct
FROM (SELECT station_group, service_date, train_code, station_code, bool_or(side = 'local') AS l, bool_or(side = 'cloud') AS c FROM covered GROUP BY ALL) GROUP BY 1
UNION ALL
SELECT NULL, CAST(1 AS TINYINT), count(*) FILTER (l AND c), count(*) FILTER (l AND NOT c), count(*) FILTER (c AND NOT l),
       {fixed_sql('100 * count(*) FILTER (l AND c) / count(*)')}
FROM (SELECT station_group, service_date, train_code, station_code, bool_or(side = 'local') AS l, bool_or(side = 'cloud') AS c FROM covered GROUP BY ALL)""")
def event_agreement(spark, sf):
    cap = views.captures(spark, sf)
    return shown(parity.event_agreement(parity.inside_windows(cap, _overlap(cap))))


@query("set_operations_u1", """
SELECT 'both' AS part, count(*) AS n FROM (SELECT service_date, train_code, station_code FROM captures WHERE side = 'local'
  INTERSECT SELECT service_date, train_code, station_code FROM captures WHERE side = 'cloud')
UNION ALL SELECT 'local_only', count(*) FROM (SELECT service_date, train_code, station_code FROM captures WHERE side = 'local'
  EXCEPT SELECT service_date, train_code, station_code FROM captures WHERE side = 'cloud')
UNION ALL SELECT 'either', count(*) FROM (SELECT service_date, train_code, station_code FROM captures WHERE side = 'local'
  UNION SELECT service_date, train_code, station_code FROM captures WHERE side = 'cloud')""")
def set_operations(spark, sf):
    cap = views.captures(spark, sf)
    a = cap.where("side = 'local'").select(*parity.KEY)
    b = cap.where("side = 'cloud'").select(*parity.KEY)
    parts = {"both": a.intersect(b), "local_only": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("volume_parity_a22", f"""
SELECT count(*) AS station_hours, {fixed_sql('100 * avg(abs(l - c) / greatest(l, c))')} AS mean_pct, {fixed_sql('100 * max(abs(l - c) / greatest(l, c))')} AS worst_pct
FROM (SELECT station_code, floor(cycle_sec / 3600) AS h, count(*) FILTER (side = 'local') AS l, count(*) FILTER (side = 'cloud') AS c FROM covered GROUP BY ALL)
WHERE l > 0 AND c > 0""")
def volume_parity(spark, sf):
    cap = views.captures(spark, sf)
    return shown(parity.volume_parity(parity.inside_windows(cap, _overlap(cap))))


@query("paired_cycles_j14", "SELECT * FROM pairs")
def paired_cycles(spark, sf):
    return parity.paired_cycles(views.captures(spark, sf))


@query("value_agreement_j14", """
SELECT count(*) AS shared, count(*) FILTER (local_eta = cloud_eta) AS identical FROM value_pairs""")
def value_agreement(spark, sf):
    cap = views.captures(spark, sf)
    met = parity.value_pairs(parity.latest_values(cap), parity.paired_cycles(cap))
    return met.agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("local_eta") == F.col("cloud_eta")).alias("identical"))


@query("phase_offset_w15", """
SELECT CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC) AS BIGINT) AS offset_sec FROM (
  SELECT least(a.cycle_sec - (SELECT max(b.cycle_sec) FROM cycle_set b WHERE b.side = 'cloud' AND b.cycle_sec <= a.cycle_sec),
               (SELECT min(b.cycle_sec) FROM cycle_set b WHERE b.side = 'cloud' AND b.cycle_sec >= a.cycle_sec) - a.cycle_sec) AS gap
  FROM cycle_set a WHERE a.side = 'local')""")
def phase_offset(spark, sf):
    return parity.phase_offset(views.captures(spark, sf))


@query("revision_direction_a29", """
SELECT CASE WHEN local_eta = cloud_eta THEN 'agree' WHEN next_sec IS NULL OR next_sec - local_sec > 600 THEN 'unjudged'
            WHEN f AND b THEN 'both' WHEN f THEN 'next' WHEN b THEN 'previous' ELSE 'neither' END AS direction, count(*) AS n
FROM (SELECT *, next_eta = cloud_eta AS f, coalesce(prev_eta = cloud_eta AND local_sec - prev_sec <= 600, false) AS b FROM value_pairs) GROUP BY 1""")
def revision_direction(spark, sf):
    cap = views.captures(spark, sf)
    return parity.revision_direction(parity.latest_values(cap), parity.paired_cycles(cap))


@query("change_rate_a30", """
SELECT count(*) AS pairs, count(*) FILTER (local_eta <> next_eta) AS changed FROM around WHERE next_sec - local_sec BETWEEN 240 AND 360""")
def change_rate(spark, sf):
    return parity.change_rate(parity.latest_values(views.captures(spark, sf)))


@query("field_sets_a36", """
SELECT event_type, array_to_string(list_sort(json_keys(props)), ',') AS fields, count(*) AS n FROM events GROUP BY 1, 2""")
def field_sets(spark, sf):
    return parity.field_sets(views.table(spark, sf, "events"), "props", "event_type")


@query("parity_verdict_v2", f"""
SELECT overlap_pct, covered_h, CASE WHEN covered_h < 2.0 THEN 'provisional' WHEN overlap_pct >= 99.5 THEN 'meets' ELSE 'does not meet' END AS verdict
FROM (SELECT {fixed_sql('100 * count(*) FILTER (l AND c) / count(*)')} AS overlap_pct
      FROM (SELECT station_group, service_date, train_code, station_code, bool_or(side = 'local') AS l, bool_or(side = 'cloud') AS c FROM covered GROUP BY ALL)),
     (SELECT {fixed_sql('coalesce(sum(CASE WHEN o.start_sec IS NOT NULL THEN greatest(0, least(o.end_sec, d.day_sec + 88200) - greatest(o.start_sec, d.day_sec + 19800)) END), 0) / 3600.0')} AS covered_h
      FROM (SELECT DISTINCT CAST(floor(cycle_sec / 86400) * 86400 AS BIGINT) AS day_sec FROM cycle_set) d
      LEFT JOIN overlap o ON o.start_sec < d.day_sec + 88200 AND o.end_sec > d.day_sec + 19800)""")
def parity_verdict(spark, sf):
    cap = views.captures(spark, sf)
    both = _overlap(cap)
    agreement = parity.event_agreement(parity.inside_windows(cap, both))
    return shown(parity.verdict(agreement, parity.day_coverage(cap, both)))
