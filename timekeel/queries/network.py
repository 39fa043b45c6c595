"""Links, searches and spatial joins over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import geodesy, times, values
from ..operators import geo, network
from ..session import settle
from .oracle_views import VIEWS
from .registry import fixed, fixed_sql, query, shown

NAMES = ", ".join(f"'{n}'" for n in views.STATION_NAMES)
VIEWS["stations"] = f"""
  SELECT code, [{NAMES}][n + 1] AS name, n * 79 % 20 * 15000 + 500000 AS x, n * 47 % 20 * 20000 + 550000 AS y,
         CASE WHEN n = 7 THEN 0.0::DOUBLE ELSE 51.6::DOUBLE + (n * 37 % 20) * 0.18::DOUBLE END AS lat,
         CASE WHEN n = 7 THEN 0.0::DOUBLE ELSE -10.0::DOUBLE + (n * 53 % 20) * 0.2::DOUBLE END AS lon, n NOT IN (7, 13) AS placed
  FROM (SELECT DISTINCT location_code AS code, CAST(substr(location_code, 2) AS INT) AS n FROM movements)"""
VIEWS["hop_rows"] = """
  SELECT *, count(*) FILTER (placed) OVER (PARTITION BY service_date, train_code ORDER BY location_order) AS hop FROM (
    SELECT *, location_code NOT IN ('S7', 'S13') AS placed FROM movements)"""
VIEWS["steps"] = """
  SELECT service_date, train_code, hop, least(location_code, to_code) AS a, greatest(location_code, to_code) AS b FROM (
    SELECT *, lead(location_code) OVER (PARTITION BY service_date, train_code ORDER BY location_order) AS to_code FROM hop_rows WHERE placed)
  WHERE to_code <> location_code"""
VIEWS["passed"] = """
  SELECT DISTINCT a, b, r.location_code AS point FROM hop_rows r JOIN steps s ON s.service_date = r.service_date AND s.train_code = r.train_code AND s.hop = r.hop
  WHERE NOT r.placed"""
VIEWS["links"] = """
  SELECT l.*, coalesce(points, 0) AS points, coalesce(passes_unplaced, '') AS passes_unplaced
  FROM (SELECT a, b, count(DISTINCT train_code) AS services, count(*) AS runs FROM steps GROUP BY 1, 2) l
  LEFT JOIN (SELECT a, b, count(*) AS points, string_agg(point, ',' ORDER BY point) AS passes_unplaced FROM passed GROUP BY 1, 2) p USING (a, b)"""
VIEWS["measured_links"] = """
  SELECT * FROM (SELECT l.*, sqrt((CAST(p.x - q.x AS DOUBLE) * (p.x - q.x) + CAST(p.y - q.y AS DOUBLE) * (p.y - q.y))) AS metres
    FROM links l JOIN stations p ON p.code = l.a JOIN stations q ON q.code = l.b)"""


def parts(spark, sf):
    moves, t = views.movements(spark, sf)
    steps, passed = network.hops(views.placed_stops(moves), t)
    return moves, t, steps, passed


def measured_links(moves, steps, passed):
    """All links with their length, written once for the searches."""
    return settle(network.with_length(network.links(steps, passed), views.stations(moves)), "measured-links")


@query("station_hops_w8", "SELECT CAST(service_date AS VARCHAR) AS service_date, train_code, hop, a, b FROM steps")
def station_hops(spark, sf):
    return shown(parts(spark, sf)[2])


@query("points_passed_w8", "SELECT a, b, point FROM passed")
def points_passed(spark, sf):
    return parts(spark, sf)[3]


@query("link_counts_a25", "SELECT a, b, services, runs, points, passes_unplaced FROM links")
def link_counts(spark, sf):
    _, _, steps, passed = parts(spark, sf)
    return network.links(steps, passed)


@query("thin_links_l6", "SELECT a, b, services, runs FROM links WHERE services <= 30")
def thin_links(spark, sf):
    _, _, steps, passed = parts(spark, sf)
    return network.thin_links(network.links(steps, passed), 30).select("a", "b", "services", "runs")


def relaxed_sql(wanted: str, own: str, rounds: int = 17) -> str:
    """Shortest distances by `rounds` rounds of relaxation, written out step by step."""
    ctes = [f"""r0 AS MATERIALIZED (SELECT a, b, a AS node, 0.0::DOUBLE AS dist, 0 AS hops FROM {wanted})"""]
    for i in range(1, rounds + 1):
        ctes.append(f"""r{i} AS MATERIALIZED (SELECT a, b, node, min(dist) AS dist, min_by(hops, dist * 1000000 + hops) AS hops FROM (
          SELECT * FROM r{i - 1} UNION ALL
          SELECT r.a, r.b, e.n2, r.dist + e.metres, r.hops + 1 FROM r{i - 1} r JOIN both_ways e ON e.n1 = r.node
          WHERE {own}) GROUP BY 1, 2, 3)""")
    return f"""WITH both_ways AS (SELECT a AS n1, b AS n2, metres FROM measured_links UNION ALL SELECT b, a, metres FROM measured_links), {', '.join(ctes)}
      SELECT a, b, dist, hops FROM r{rounds} WHERE node = b AND a <> b"""


NOT_OWN = "NOT (least(r.node, e.n2) = least(r.a, r.b) AND greatest(r.node, e.n2) = greatest(r.a, r.b))"
VIEWS["corridors"] = """SELECT a.code AS a, b.code AS b FROM stations a JOIN stations b ON a.code = 'S2' AND b.placed AND b.code <> 'S2'"""


@query("shortest_paths_g1", f"SELECT a, b, {fixed_sql('dist', 3)} AS dist FROM ({relaxed_sql('corridors', 'true')})")
def shortest_paths(spark, sf):
    moves, _, steps, passed = parts(spark, sf)
    ends = views.stations(moves).where("placed AND code <> 'S2'").select(F.lit("S2").alias("a"), F.col("code").alias("b"))
    return shown(network.shortest(ends, measured_links(moves, steps, passed)).select("a", "b", "dist"), 3)


@query("detour_ratios_g2", f"""
SELECT d.a, d.b, {fixed_sql('d.dist', 3)} AS chain_metres, {fixed_sql('d.dist / l.metres', 6)} AS ratio FROM ({relaxed_sql('measured_links', NOT_OWN)}) d JOIN measured_links l USING (a, b)""")
def detour_ratios(spark, sf):
    moves, _, steps, passed = parts(spark, sf)
    out = network.detours(measured_links(moves, steps, passed))
    return out.select("a", "b", fixed("chain_metres", 3).alias("chain_metres"), fixed("ratio").alias("ratio"))


@query("express_skips_g3")
def express_skips(spark, sf):
    moves, _, steps, passed = parts(spark, sf)
    return shown(network.remove_skips(measured_links(moves, steps, passed), passed), 3)


def labels_sql(rounds: int = 12) -> str:
    ctes = ["l0 AS MATERIALIZED (SELECT code, code AS label FROM stations WHERE placed)"]
    for i in range(1, rounds + 1):
        ctes.append(f"l{i} AS MATERIALIZED (SELECT code, min(label) AS label FROM (SELECT * FROM l{i-1} UNION ALL SELECT e.n2, l.label FROM l{i-1} l JOIN ways e ON e.n1 = l.code) GROUP BY 1)")
    return f"WITH ways AS (SELECT a AS n1, b AS n2 FROM measured_links UNION ALL SELECT b, a FROM measured_links), {', '.join(ctes)} SELECT code, label FROM l{rounds}"


@query("connected_components_g4", f"SELECT code, label FROM ({labels_sql()})")
def connected_components(spark, sf):
    moves, _, steps, passed = parts(spark, sf)
    nodes = views.stations(moves).where("placed").select("code")
    return network.components(nodes, measured_links(moves, steps, passed))


@query("stations_over_link_g5", """
SELECT DISTINCT s.a, s.b, h.location_code AS code FROM (SELECT DISTINCT service_date, train_code, a, b FROM steps) s
JOIN hop_rows h ON h.service_date = s.service_date AND h.train_code = s.train_code AND h.placed""")
def stations_over_link(spark, sf):
    moves, t = views.movements(spark, sf)
    return network.stations_over_link(views.placed_stops(moves), t)


@query("shared_names_a38", """
SELECT lower(name) AS name, count(*) AS n, string_agg(code, ',' ORDER BY code) AS codes FROM stations GROUP BY 1 HAVING count(*) > 1""")
def shared_names(spark, sf):
    return network.shared(views.stations(views.movements(spark, sf)[0]), [F.lower("name").alias("name")])


@query("shared_positions_a38", """
SELECT CAST(round_even(y / 100000.0, 0) AS BIGINT) * 100000 AS y, count(*) AS n, string_agg(code, ',' ORDER BY code) AS codes FROM stations GROUP BY 1 HAVING count(*) > 1""")
def shared_positions(spark, sf):
    return network.shared(views.stations(views.movements(spark, sf)[0]), [values.to_grid("y", 100000).alias("y")])


@query("ranked_places_a40", """
SELECT code, name, CAST(degree AS BIGINT) AS degree, coalesce(list_position(['Galway', 'Thurles'], name), 99) AS precedence FROM (
  SELECT s.code, s.name, d.degree, row_number() OVER (PARTITION BY lower(s.name), round(s.x / 300.0), round(s.y / 300.0) ORDER BY s.code) AS rn
  FROM stations s JOIN (SELECT code, sum(services) AS degree FROM (SELECT a AS code, services FROM links UNION ALL SELECT b, services FROM links) GROUP BY 1) d USING (code)) WHERE rn = 1""")
def ranked_places(spark, sf):
    moves, _, steps, passed = parts(spark, sf)
    out = network.ranked_places(views.stations(moves), network.links(steps, passed), ("Galway", "Thurles"))
    return out.withColumn("precedence", F.col("precedence").cast("int"))


@query("list_differences_u3", """
SELECT code, feed_name, list_name, CASE WHEN list_name IS NULL THEN 'feed_only' WHEN feed_name IS NULL THEN 'list_only' ELSE 'renamed' END AS difference FROM (
  SELECT code, f.name AS feed_name, l.name AS list_name FROM stations f FULL JOIN (
    SELECT CASE WHEN code = 'S2' THEN 'X2' ELSE code END AS code, CASE WHEN code IN ('S4', 'S9') THEN upper(name) ELSE name END AS name FROM stations) l USING (code))
WHERE feed_name IS DISTINCT FROM list_name""")
def list_differences(spark, sf):
    st = views.stations(views.movements(spark, sf)[0])
    listed = st.select(F.when(F.col("code") == "S2", "X2").otherwise(F.col("code")).alias("code"),
                       F.when(F.col("code").isin("S4", "S9"), F.upper("name")).otherwise(F.col("name")).alias("name"))
    return network.compare_lists(st, listed)


# ---- fleet reports

VIEWS["fleet"] = """
  SELECT event_id AS point_id, concat('t', CAST(user_id AS VARCHAR), ' ') AS train,
         CASE event_type WHEN 'view' THEN 'R' WHEN 'error' THEN 'T' ELSE 'N' END AS status,
         CASE WHEN n = 7 THEN 0.0::DOUBLE ELSE 51.6::DOUBLE + (n * 37 % 20) * 0.18::DOUBLE + (event_id % 9 - 4) * 0.0007::DOUBLE END AS lat,
         CASE WHEN n = 7 THEN 0.0::DOUBLE ELSE -10.0::DOUBLE + (n * 53 % 20) * 0.2::DOUBLE + (k % 7 - 3) * 0.0011::DOUBLE END AS lon, k
  FROM (SELECT *, k % 20 AS n FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""


@query("null_positions_p21", """
SELECT CASE WHEN lat = 0 AND lon = 0 THEN NULL ELSE true END AS placed, count(*) AS n FROM fleet GROUP BY 1""")
def null_positions(spark, sf):
    r = views.reports(spark, sf)
    ok = values.placed(F.col("lat").cast("string"), F.col("lon").cast("string"))
    return r.groupBy(F.when(ok, True).alias("placed")).agg(F.count(F.lit(1)).alias("n"))


@query("message_lines_p22", """
SELECT point_id, CASE WHEN k % 3 = 0 THEN 'Departed S1 next stop S2' WHEN k % 3 = 1 THEN 'Arrived S3 next stop S4' ELSE 'No report' END AS first_line,
       CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS n_lines,
       CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'S2' WHEN k % 3 = 1 THEN 'S4' END AS next_stop
FROM fleet""")
def message_lines(spark, sf):
    r = views.reports(spark, sf)
    lines = values.message_lines("message", times.key("train"))
    return r.withColumn("lines", lines).select(
        "point_id", F.try_element_at("lines", F.lit(1)).alias("first_line"), F.size("lines").alias("n_lines"),
        values.last_report("lines")["next"].alias("next_stop"))


@query("running_codes_s5", """
SELECT upper(trim(train)) AS train, bool_or(status = 'R') AS running FROM fleet GROUP BY 1""")
def running_codes(spark, sf):
    r = views.reports(spark, sf)
    return r.groupBy(times.key("train").alias("train")).agg(F.bool_or(F.col("status") == "R").alias("running"))


KM = "sqrt(((f.lat - s.lat) * 111.2::DOUBLE) ** 2 + ((f.lon - s.lon) * 111.2::DOUBLE * cos(radians(f.lat))) ** 2)"


@query("nearest_station_j20", f"""
SELECT f.point_id, min_by(code, km) AS code, {fixed_sql('min(km)')} AS km FROM fleet f LEFT JOIN (
  SELECT f.point_id, s.code, {KM} AS km FROM fleet f JOIN stations s ON abs(f.lat - s.lat) < 0.01 AND abs(f.lon - s.lon) < 0.01 WHERE {KM} < 0.3) USING (point_id) GROUP BY 1""")
def nearest_station(spark, sf):
    moves, _ = views.movements(spark, sf)
    return shown(geo.nearest_station(views.reports(spark, sf).select("point_id", "lat", "lon"), views.stations(moves)))


@query("planar_distance_p29", f"""
SELECT f.point_id, {fixed_sql(KM)} AS km FROM fleet f JOIN stations s ON s.code = concat('S', CAST(f.k % 20 AS VARCHAR))""")
def planar_distance(spark, sf):
    moves, _ = views.movements(spark, sf)
    r = views.reports(spark, sf).withColumn("code", F.concat(F.lit("S"), (F.col("k") % 20).cast("string")))
    st = views.stations(moves).select("code", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    return shown(r.join(st, "code").select("point_id", geodesy.km_between("lat", "lon", "s_lat", "s_lon").alias("km")))


def grid_sql() -> tuple[str, str]:
    ecc = repr(geodesy._ecc)
    s = "sin(radians(lat))"
    t = f"sinh(atanh({s}) - {ecc}::DOUBLE * atanh({ecc}::DOUBLE * {s}))"
    lam = "radians(lon + 8.0)"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    north = " + ".join([xi] + [f"{a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(geodesy.KRUEGER, 1)])
    east = " + ".join([eta] + [f"{a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(geodesy.KRUEGER, 1)])
    size = repr(geodesy.GRID_SCALE * geodesy._radius)
    e = f"600000 + {size}::DOUBLE * ({east})"
    n = f"750000 + {size}::DOUBLE * (({north}) - {geodesy._origin_northing()!r}::DOUBLE)"
    return e, n


@query("national_grid_p30", f"""
SELECT point_id, {fixed_sql(grid_sql()[0], 3)} AS x, {fixed_sql(grid_sql()[1], 3)} AS y FROM fleet WHERE lat <> 0""")
def national_grid(spark, sf):
    x, y = geodesy.grid_xy("lat", "lon")
    return shown(views.reports(spark, sf).where("lat <> 0").select("point_id", x.alias("x"), y.alias("y")), 3)


@query("grid_rounding_p31", """
SELECT point_id, CAST(round_even(x / 10.0, 0) AS BIGINT) * 10 AS x10, CAST(round_even(y / 10.0, 0) AS BIGINT) * 10 AS y10 FROM field""")
def grid_rounding(spark, sf):
    return views.field_points(spark, sf).select("point_id", values.to_grid("x", 10).alias("x10"), values.to_grid("y", 10).alias("y10"))


VIEWS["field"] = """
  SELECT event_id AS point_id, CAST(event_id * 7919 % 24000 AS INT) AS x, CAST(event_id * 104729 % 24000 + user_id % 7 AS INT) AS y FROM events"""
VIEWS["ring_rows"] = """
  SELECT s_nationkey AS ring_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS seq,
         s_nationkey % 5 * 4000 + CAST(floor(s_acctbal) AS INT) % 5000 AS x, CAST(floor(s_nationkey / 5) AS INT) * 4000 + CAST(s_suppkey * 911 % 5000 AS INT) AS y FROM supplier"""
VIEWS["sides"] = """
  SELECT ring_id, seq, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1
  FROM ring_rows WINDOW w AS (PARTITION BY ring_id ORDER BY seq)"""


def sides(spark, sf):
    return geo.ring_edges(views.rings(spark, sf))


@query("ring_area_a37", f"""
SELECT ring_id, {fixed_sql('sum(CAST(x0 AS BIGINT) * y1 - CAST(x1 AS BIGINT) * y0) / 2.0', 1)} AS area, count(*) AS vertices FROM sides GROUP BY 1""")
def ring_area(spark, sf):
    return shown(geo.ring_area(sides(spark, sf)), 1)


@query("point_in_ring_j22", """
SELECT p.point_id, s.ring_id FROM field p JOIN sides s ON (s.y0 > p.y) <> (s.y1 > p.y) AND p.x < s.x0 + (p.y - s.y0) * (s.x1 - s.x0) / CAST(s.y1 - s.y0 AS DOUBLE)
GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_ring(spark, sf):
    return geo.inside_rings(views.field_points(spark, sf), sides(spark, sf), 1000.0)


SEG_T = "CASE WHEN l2 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / l2)) END"


@query("distance_to_ring_j23", f"""
SELECT p.point_id, {fixed_sql('min(m)', 3)} AS metres FROM field p LEFT JOIN (
  SELECT point_id, sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) AS m FROM (
    SELECT *, {SEG_T} AS t FROM (SELECT p.*, s.x0, s.y0, s.x1, s.y1, CAST((s.x1 - s.x0) * (s.x1 - s.x0) + (s.y1 - s.y0) * (s.y1 - s.y0) AS DOUBLE) AS l2 FROM field p CROSS JOIN sides s))
  ) q ON q.point_id = p.point_id GROUP BY 1""")
def distance_to_ring(spark, sf):
    return shown(geo.distance_to_rings(views.field_points(spark, sf), sides(spark, sf), 500.0), 3)


TURN = "sign((({b}.x1 - {b}.x0) * ({p}.y{e} - {b}.y0) - ({b}.y1 - {b}.y0) * ({p}.x{e} - {b}.x0))::DOUBLE)"


@query("crossing_segments_j24", f"""
SELECT DISTINCT m.ring_id, m.seq FROM sides m JOIN sides n ON (m.ring_id <> n.ring_id OR m.seq <> n.seq)
WHERE {TURN.format(b='m', p='n', e='0')} * {TURN.format(b='m', p='n', e='1')} < 0 AND {TURN.format(b='n', p='m', e='0')} * {TURN.format(b='n', p='m', e='1')} < 0""")
def crossing_segments(spark, sf):
    return geo.crossing_segments(sides(spark, sf), 500.0)


VIEWS["grid_stations"] = "SELECT code, name, x % 24000 AS x, y % 24000 AS y FROM stations"
VIEWS["node_gap"] = "SELECT s.code, p.point_id AS node, sqrt((CAST(p.x - s.x AS DOUBLE) * (p.x - s.x) + CAST(p.y - s.y AS DOUBLE) * (p.y - s.y))) AS metres FROM grid_stations s CROSS JOIN field p"


@query("nodes_within_radius_j21", f"""
SELECT code, node, {fixed_sql('metres', 3)} AS metres FROM node_gap WHERE metres <= 100
UNION ALL SELECT code, node, {fixed_sql('metres', 3)} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY metres, node) AS rn, min(metres) OVER (PARTITION BY code) AS nearest FROM node_gap)
WHERE rn = 1 AND nearest > 100 AND nearest <= 5000""")
def nodes_within_radius(spark, sf):
    st = views.stations(views.movements(spark, sf)[0]).select("code", (F.col("x") % 24000).alias("x"), (F.col("y") % 24000).alias("y"))
    nodes = views.field_points(spark, sf).withColumnRenamed("point_id", "node")
    return shown(geo.within_radius(st, nodes, radius=100.0), 3)


VIEWS["places"] = "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_size * 900 AS x, CAST(p_partkey % 97 AS INT) * 650 AS y FROM part"


def places(spark, sf):
    return views.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"),
        (F.col("p_size") * 900).alias("x"), (F.col("p_partkey") % 97).cast("int").alias("_m")).withColumn("y", F.col("_m") * 650).drop("_m")


@query("far_from_namesakes_j25", """
SELECT p.code, p.name FROM places p WHERE (SELECT count(*) FROM places q WHERE q.name = p.name) >= 3
AND NOT EXISTS (SELECT 1 FROM places q WHERE q.name = p.name AND q.code <> p.code AND sqrt((CAST(p.x - q.x AS DOUBLE) * (p.x - q.x) + CAST(p.y - q.y AS DOUBLE) * (p.y - q.y))) <= 1000)""")
def far_from_namesakes(spark, sf):
    return geo.far_from_namesakes(places(spark, sf))


VIEWS["off"] = """
  SELECT f.code, f.x, f.y, r.x AS rx, r.y AS ry, sqrt((CAST(f.x - r.x AS DOUBLE) * (f.x - r.x) + CAST(f.y - r.y AS DOUBLE) * (f.y - r.y))) AS moved_m
  FROM places f JOIN (SELECT code, x + CAST(code AS INT) % 5 * 90 AS x, y + CAST(code AS INT) % 3 * 120 AS y FROM places) r USING (code)"""


@query("moved_positions_j25", f"""
SELECT code, as_code, {fixed_sql('moved_m', 3)} AS moved_m FROM (
  SELECT f.code, o.code AS as_code, o.moved_m, row_number() OVER (PARTITION BY f.code ORDER BY o.moved_m DESC, o.code) AS rn
  FROM places f JOIN off o ON o.x = f.x AND o.y = f.y AND o.moved_m > 300) WHERE rn = 1""")
def moved_positions(spark, sf):
    p = places(spark, sf)
    n = F.col("code").cast("int")
    ref = p.select("code", (F.col("x") + n % 5 * 90).alias("x"), (F.col("y") + n % 3 * 120).alias("y"))
    return shown(geo.moved_positions(p, ref).select("code", "as_code", "moved_m"), 3)


CATS = ("CTH", "B", "ID", "ZZ", "CBA", "D")
CAT_LIST = ", ".join(f"'{c}'" for c in CATS)
PREF_LIST = ", ".join(f"'{c}'" for c in geo.PREFERRED)
VIEWS["gaz"] = f"""
  SELECT p_partkey AS place_id, CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_name, ' ', '-')) ELSE replace(p_name, 'e', 'é') END AS place_name,
         [{CAT_LIST}][CAST(p_partkey % 6 AS INT) + 1] AS category, 52.0::DOUBLE + (p_partkey % 41) * 0.03::DOUBLE AS lat, -8.0::DOUBLE + (p_partkey % 37) * 0.04::DOUBLE AS lon FROM part"""
VIEWS["asked_names"] = """
  SELECT p_partkey AS code, p_name AS name, 52.0::DOUBLE + (p_partkey % 39) * 0.03::DOUBLE AS lat, -8.0::DOUBLE + (p_partkey % 35) * 0.04::DOUBLE AS lon FROM part"""
NKM = "sqrt(((a.lat - g.lat) * 111.2::DOUBLE) ** 2 + ((a.lon - g.lon) * 111.2::DOUBLE * cos(radians(a.lat))) ** 2)"
NKEY = "replace(replace(lower(strip_accents({c})), '-', ' '), ' ', '')"


@query("best_name_match_j19_p28", f"""
SELECT code, place_id, category, rank, {fixed_sql('km')} AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY rank, km, place_id) AS rn FROM (
    SELECT a.code, g.place_id, g.category, list_position([{PREF_LIST}], g.category) AS rank, {NKM} AS km FROM asked_names a JOIN gaz g
    ON {NKEY.format(c='a.name')} = {NKEY.format(c='g.place_name')}) WHERE rank IS NOT NULL AND rank > 0 AND km <= CASE WHEN category = 'CBA' THEN 15 ELSE 6 END) WHERE rn = 1""")
def best_name_match(spark, sf):
    p = views.table(spark, sf, "part")
    k = F.col("p_partkey")
    gaz = p.select(
        k.alias("place_id"),
        F.when(k % 2 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.replace("p_name", F.lit("e"), F.lit("é"))).alias("place_name"),
        F.element_at(F.array(*[F.lit(c) for c in CATS]), (k % 6).cast("int") + 1).alias("category"),
        (52.0 + (k % 41) * 0.03).alias("lat"), (-8.0 + (k % 37) * 0.04).alias("lon"))
    asked = p.select(k.alias("code"), F.col("p_name").alias("name"), (52.0 + (k % 39) * 0.03).alias("lat"), (-8.0 + (k % 35) * 0.04).alias("lon"))
    out = geo.best_name_match(asked, gaz)
    return shown(out.withColumn("rank", F.col("rank").cast("int")))


@query("way_drop_reason_p27", """
SELECT coalesce(CASE WHEN k % 7 = 0 THEN 'service=yard' WHEN k % 7 = 1 THEN 'service=siding' WHEN k % 11 = 0 THEN 'disused' WHEN k % 13 = 0 THEN 'abandoned' END, '') AS reason, count(*) AS n
FROM fleet GROUP BY 1""")
def way_drop_reason(spark, sf):
    k = F.col("k")
    tags = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("service").alias("k"), F.when(k % 7 == 0, "yard").when(k % 7 == 1, "siding").when(k % 7 == 2, "main").alias("v")),
        F.struct(F.lit("disused").alias("k"), F.when(k % 11 == 0, "yes").alias("v")),
        F.struct(F.lit("abandoned:railway").alias("k"), F.when(k % 13 == 0, "rail").alias("v")),
    ), lambda e: e["v"].isNotNull()))
    r = views.reports(spark, sf).withColumn("tags", tags)
    return r.groupBy(F.coalesce(values.drop_reason("tags"), F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
