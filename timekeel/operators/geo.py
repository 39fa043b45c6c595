"""Spatial joins on grid cells: every pair that can match shares a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy, values
from ..session import settle
from . import cells
from .ordered import first_by

# Fixed values.
NEAR_KM = 0.3
SNAP_M, FALLBACK_M = 300.0, 5000.0
PEER_M = 1000.0
CORRECT_M = 300.0
NAME_KM, DISTRICT_KM = 6.0, 15.0
PREFERRED = ("CTH", "B", "ID", "SRB", "D", "GR", "BF", "PAR", "CBA")
DISTRICT = "CBA"
CROSS_CELL_M = 200.0
DEGREE_CELL = 0.005
NAME_DEGREE_CELL = 0.25
#: Cells in which namesakes are sought, each half of the one before; powers of two, so that they nest without rounding.
NAME_CELLS = tuple(2.0 ** -k for k in range(4, 9))
#: What rounding may take off a distance, with much to spare.
SLACK_KM = 1e-6


def cell(v: Column | str, size: float) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.floor(c / F.lit(size))


def _around(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi))


def reach_of_longitude(lat: Column, reach: float) -> Column:
    """Degrees of longitude that are as long as `reach` is at 57 degrees north, where the fixed reaches were set, or longer."""
    return F.greatest(F.lit(1.0), F.cos(F.radians(F.lit(57.0))) / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))) * reach


def spread(df: DataFrame, x: Column, y: Column, size: float, reach: float, reach_y: Column | None = None) -> DataFrame:
    """Copy each row to every cell within `reach` of it (`reach_y` along y, if another), as `_cx`, `_cy`."""
    along = reach if reach_y is None else reach_y
    return df.withColumn("_cx", _around(cell(x - reach, size), cell(x + reach, size))).withColumn(
        "_cy", _around(cell(y - along, size), cell(y + along, size)))


def nearest_station(points: DataFrame, stations: DataFrame, within_km: float = NEAR_KM) -> DataFrame:
    """The nearest station closer than `within_km`; points without one keep null.

    The few stations are copied to neighbouring cells; the many points stay where they are.
    """
    reach = DEGREE_CELL * within_km / NEAR_KM
    st = spread(stations.select("code", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")),
                F.col("s_lat"), F.col("s_lon"), DEGREE_CELL, reach, reach_of_longitude(F.col("s_lat"), reach))
    p = points.withColumns({"_cx": cell("lat", DEGREE_CELL), "_cy": cell("lon", DEGREE_CELL)})
    met = p.join(st, ["_cx", "_cy"], "left").withColumn("km", geodesy.km_between("lat", "lon", "s_lat", "s_lon"))
    hit = F.col("km") < within_km
    kept = met.withColumns({"code": F.when(hit, F.col("code")), "km": F.when(hit, F.col("km"))})
    return kept.groupBy("point_id").agg(F.min(F.when(hit, F.struct("km", "code"))).alias("_m")).select(
        "point_id", F.col("_m.code").alias("code"), F.col("_m.km").alias("km"))


def within_radius(stations: DataFrame, nodes: DataFrame, radius: float = SNAP_M, fallback: float = FALLBACK_M) -> DataFrame:
    """Every node within `radius` of a station; a station with none gets the nearest within
    `fallback`."""
    def near(size: float, asked: DataFrame) -> DataFrame:
        s = spread(asked.select("code", F.col("x").alias("sx"), F.col("y").alias("sy")), F.col("sx"), F.col("sy"), size, size)
        n = nodes.select("node", "x", "y").withColumns({"_cx": cell("x", size), "_cy": cell("y", size)})
        return s.join(n, ["_cx", "_cy"]).withColumn("metres", geodesy.metres_between("x", "y", "sx", "sy")).where(F.col("metres") <= size).select("code", "node", "metres")

    close = near(radius, stations)
    lonely = stations.join(close.select("code").distinct(), "code", "left_anti")
    far = near(fallback, lonely).groupBy("code").agg(F.min(F.struct("metres", "node")).alias("_m")).select(
        "code", F.col("_m.node").alias("node"), F.col("_m.metres").alias("metres"))
    return close.unionByName(far)


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Edges of closed rings from vertex rows (ring_id, seq from 0, x, y), by an equality
    join of each vertex with the next; the last meets the first."""
    sizes = vertices.groupBy("ring_id").agg((F.max("seq") + 1).alias("_n"))
    v = vertices.join(sizes, "ring_id").withColumn("_next", F.pmod(F.col("seq") + 1, F.col("_n")))
    to = vertices.select("ring_id", F.col("seq").alias("_next"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return v.join(to, ["ring_id", "_next"]).select("ring_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def ring_area(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ring_id").agg(
        (F.sum(F.col("x0").cast("double") * F.col("y1") - F.col("x1").cast("double") * F.col("y0")) / 2).alias("area"), F.count(F.lit(1)).alias("vertices"))


def inside_rings(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Points inside each ring, by the parity of edges crossed to the right; a point without a place is in none.

    A cell knows whether its corner is inside the rings that cross it, so a point meets only
    its own cell's edges: it is as its corner is, but for the edges between the two. In cells
    that no edge of a ring crosses, all points are as the cell is.
    """
    p = cells.placed(points, size)
    held = settle(cells.corners(edges, size), "corners")
    near = cells.walked(edges, size).select("ring_id", *cells.ENDS, "_cx", "_cy").join(held, ["ring_id", "_cx", "_cy"])
    x, y = F.col("x"), F.col("y")
    right, top = cells.border(F.col("_cx") + 1, size), cells.border(F.col("_cy") + 1, size)
    at_x, at_y = cells.x_at(y), cells.y_at(right)
    # To the right as far as the cell goes, then up to its corner.
    across = ((F.col("y0") > y) != (F.col("y1") > y)) & (x < at_x) & ~(right < at_x)
    upward = ((F.col("x0") > right) != (F.col("x1") > right)) & (y < at_y) & ~(top < at_y)
    crossed = F.when(across, 1).otherwise(0) + F.when(upward, 1).otherwise(0)
    met = p.join(near, ["_cx", "_cy"]).groupBy("point_id", "ring_id").agg((F.sum(crossed) + F.max("odd")).alias("_n"))
    within = cells.blocks_of(p).join(cells.inner_blocks(held), ["_cy", "level", "block"])
    return met.where(F.col("_n") % 2 == 1).select("point_id", "ring_id").unionByName(within.select("point_id", "ring_id"))


def distance_to_rings(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """Metres from each point to the nearest edge, however far; null if there is none or the point has no place.

    Points with an edge within `reach` meet only the cells around them; the others come down
    to their nearest cells from coarse ones.
    """
    p = cells.placed(points, reach)
    near = settle(p.join(within_reach(p, edges, reach), "point_id", "left"), "near")
    found = near.where("metres IS NOT NULL").select("point_id", "metres")
    far = cells.nearest(near.where("metres IS NULL"), edges, reach)
    return points.select("point_id").distinct().join(found.unionByName(far), "point_id", "left")


def within_reach(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """Metres from each placed point to the nearest edge, where that is no further than `reach`."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    e = cells.walked(edges, reach).withColumn("_d", around).select(
        *cells.ENDS, (F.col("_cx") + F.col("_d.dx")).alias("_cx"), (F.col("_cy") + F.col("_d.dy")).alias("_cy")).distinct()
    met = points.join(e, ["_cx", "_cy"]).withColumn("metres", geodesy.metres_to_segment("x", "y", *cells.ENDS))
    return met.where(F.col("metres") <= reach).groupBy("point_id").agg(F.min("metres").alias("metres"))


def crossing_segments(edges: DataFrame, size: float = CROSS_CELL_M) -> DataFrame:
    """Segments that properly cross another, of any ring; two meet in the cells that both cross."""
    g = cells.walked(edges, size)
    a, b = g.alias("m"), g.alias("n")
    def c(side, *names):
        return [F.col(f"{side}.{n}") for n in names]
    m0, m1, n0, n1 = c("m", "x0", "y0"), c("m", "x1", "y1"), c("n", "x0", "y0"), c("n", "x1", "y1")
    crosses = (
        (geodesy.turn(*m0, *m1, *n0) * geodesy.turn(*m0, *m1, *n1) < 0)
        & (geodesy.turn(*n0, *n1, *m0) * geodesy.turn(*n0, *n1, *m1) < 0)
    )
    first = F.struct("m.ring_id", "m.seq") < F.struct("n.ring_id", "n.seq")
    met = a.join(b, (F.col("m._cx") == F.col("n._cx")) & (F.col("m._cy") == F.col("n._cy")) & first & crosses)
    ends = met.select(F.explode(F.array(F.struct("m.ring_id", "m.seq"), F.struct("n.ring_id", "n.seq"))).alias("_s"))
    return ends.select("_s.ring_id", "_s.seq").distinct()


def far_from_namesakes(stations: DataFrame, metres: float = PEER_M) -> DataFrame:
    """Codes with at least two namesakes, none of them within `metres`.

    A near namesake shares the name and a neighbouring cell, so no pairs of the whole name
    are formed.
    """
    counts = stations.groupBy("name").agg(F.count(F.lit(1)).alias("_k"))
    s = stations.join(counts.where("_k >= 3"), "name", "left_semi").select("code", "name", "x", "y")
    around = spread(s, F.col("x"), F.col("y"), metres, metres)
    there = s.select(F.col("code").alias("o_code"), F.col("name").alias("o_name"), F.col("x").alias("ox"), F.col("y").alias("oy"),
                     cell("x", metres).alias("_ox"), cell("y", metres).alias("_oy"))
    near = around.join(
        there,
        (F.col("name") == F.col("o_name")) & (F.col("_cx") == F.col("_ox")) & (F.col("_cy") == F.col("_oy"))
        & (F.col("code") != F.col("o_code")) & (geodesy.metres_between("x", "y", "ox", "oy") <= metres),
        "left_semi",
    )
    return s.join(near.select("code").distinct(), "code", "left_anti").select("code", "name")


def moved_positions(feed: DataFrame, reference: DataFrame, metres: float = CORRECT_M) -> DataFrame:
    """Codes whose feed position is further than `metres` from the one reference position
    of that code, and the codes at the same feed position, which move with them.

    Where several codes at one position have such a reference, the largest offset moves them
    all. Positions are reduced to that one before the join, so a position that many codes
    share makes no pairs.
    """
    single = reference.groupBy("code").agg(F.count(F.lit(1)).alias("_k"), F.first("x").alias("rx"), F.first("y").alias("ry")).where("_k = 1")
    met = feed.join(single, "code")
    off = met.withColumn("moved_m", geodesy.metres_between("x", "y", "rx", "ry")).where(F.col("moved_m") > metres)
    lead = first_by(off, ["x", "y"], [F.desc("moved_m"), "code"]).select(F.col("code").alias("as_code"), "x", "y", "rx", "ry", "moved_m")
    return feed.select("code", "x", "y").join(lead, ["x", "y"]).select("code", "as_code", "moved_m", "rx", "ry")


def best_name_match(asked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """For each (code, name, lat, lon), the nearest place of the most preferred category
    whose name is equal, within 6 km, or 15 km for a district.

    Places meet on the name and on cells together. Coarse cells that hold any are halved step
    by step; a cell goes when a place of its category or a better one is sure to be nearer, so
    a name that very many places share makes no pairs of them all. Neither side is broadcast:
    both are as long as the input, however small their files are.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in PREFERRED]), F.col("category"))
    at = ["_key", "lat", "lon"]
    # The first place of a category at a position stands for the others there; a position that is no number is near nothing.
    g = settle(
        gazetteer.where(rank > 0).select("place_id", values.tight_name_key("place_name").alias("_key"), rank.alias("rank"), "category",
                                         F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
        .where(~F.isnan("g_lat") & ~F.isnan("g_lon"))
        .groupBy("_key", "rank", "category", "g_lat", "g_lon").agg(F.min(F.struct("place_id")).alias("_first"))
        .select("*", "_first.place_id").drop("_first"), "places")
    keyed = asked.withColumn("_key", values.tight_name_key("name"))
    q = settle(keyed.select(*at).distinct(), "asked")
    limit = F.when(F.col("category") == DISTRICT, DISTRICT_KM).otherwise(NAME_KM)
    kept = spread(q, F.col("lat"), F.col("lon"), NAME_CELLS[0], NAME_DEGREE_CELL, reach_of_longitude(F.col("lat"), NAME_DEGREE_CELL))
    on = ["_key", "_cx", "_cy"]
    by_rank, by_point = Window.partitionBy(*at, "rank"), Window.partitionBy(*at)
    for size in NAME_CELLS:
        held = g.select("_key", "rank", "category", cell("g_lat", size).alias("_cx"), cell("g_lon", size).alias("_cy")).distinct()
        if size != NAME_CELLS[0]:
            kept = kept.withColumnsRenamed({"_cx": "_px", "_cy": "_py"})
            held = held.withColumns({"_px": F.shiftright("_cx", 1), "_py": F.shiftright("_cy", 1)})
            on = ["_key", "rank", "category", "_px", "_py"]
        low, high = _km_to_cell(size)
        met = kept.join(held.hint("merge"), on).withColumns({"_low": low, "_high": high}).where(F.col("_low") <= limit + SLACK_KM)
        near = met.repartition(*at).withColumn("_sure", F.min("_high").over(by_rank)).where(F.col("_low") <= F.col("_sure") + SLACK_KM)
        best = F.min(F.when(F.col("_sure") <= limit - SLACK_KM, F.col("rank"))).over(by_point)
        kept = near.withColumn("_best", best).where(F.col("rank") <= F.coalesce("_best", "rank")).select(*at, "rank", "category", "_cx", "_cy")
    places = g.withColumns({"_cx": cell("g_lat", NAME_CELLS[-1]), "_cy": cell("g_lon", NAME_CELLS[-1])})
    met = kept.join(places.hint("merge"), ["_key", "rank", "category", "_cx", "_cy"]).withColumn("km", geodesy.km_between("lat", "lon", "g_lat", "g_lon"))
    found = first_by(met.where(F.col("km") <= limit), at, ["rank", "km", "place_id"])
    ok = keyed.join(found.select(*at, "rank", "km", "place_id", "category").hint("merge"), at)
    return first_by(ok, ["code"], ["rank", "km", "place_id"]).select("code", "place_id", "category", "rank", "km")


def _km_to_cell(size: float) -> tuple[Column, Column]:
    """Least and largest distance from (lat, lon) to the cell (_cx, _cy)."""
    def ends(at: str, c: str) -> tuple[Column, Column]:
        below, above = F.col(at) - F.col(c) * size, (F.col(c) + 1) * size - F.col(at)
        return F.greatest(-below, -above, F.lit(0.0)), F.greatest(below, above)

    shrunk = F.cos(F.radians(F.col("lat")))
    (y0, y1), (x0, x1) = ends("lat", "_cx"), ends("lon", "_cy")
    return tuple(F.sqrt(y * y + x * x * shrunk * shrunk) * geodesy.KM_PER_DEGREE for y, x in ((y0, x0), (y1, x1)))
