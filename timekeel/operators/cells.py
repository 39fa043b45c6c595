"""Square cells over edges: the cells an edge crosses, what a cell's corner is inside of, and the way down to the nearest.

Borders lie at an odd share of a cell, so that whole-numbered coordinates never fall on one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geodesy
from ..session import settle

SHIFT = 0.381966
#: Cells of one level that make a cell of the next, along each axis.
STEP = 4
#: Blocks of cells in a row: lengths are powers of 8, up to the fourth.
BLOCK, LEVELS = 8, 5
ENDS = ("x0", "y0", "x1", "y1")


def of(v: Column, size: float) -> Column:
    return F.floor(v / size + SHIFT)


def border(cell: Column, size: float) -> Column:
    """Where a cell begins."""
    return (cell - SHIFT) * size


def along(frm: Column, to: Column) -> Column:
    """One row for each whole number from `frm` to `to`; none if `to` is less."""
    return F.explode(F.when(frm <= to, F.sequence(frm, to)))


def x_at(y: Column) -> Column:
    x0, y0, x1, y1 = map(F.col, ENDS)
    return x0 + F.try_divide((y - y0) * (x1 - x0), y1 - y0)


def y_at(x: Column) -> Column:
    x0, y0, x1, y1 = map(F.col, ENDS)
    return y0 + F.try_divide((x - x0) * (y1 - y0), x1 - x0)


def as_doubles(edges: DataFrame) -> DataFrame:
    """Edges with both ends; one without a place is left out."""
    return edges.withColumns({c: F.col(c).cast("double") for c in ENDS}).dropna(subset=list(ENDS))


def walked(edges: DataFrame, size: float) -> DataFrame:
    """Each edge in the cells `_cx`, `_cy` that it crosses: as many as it is long, not as its box is wide and high."""
    x0, y0, x1, y1 = map(F.col, ENDS)
    low, high, slack = F.least(y0, y1), F.greatest(y0, y1), size * 1e-9
    rows = as_doubles(edges).withColumn("_cy", along(of(low, size), of(high, size)))
    enters, leaves = F.greatest(low, border(F.col("_cy"), size)), F.least(high, border(F.col("_cy") + 1, size))
    one = F.when(y0 == y1, x0).otherwise(x_at(enters))
    other = F.when(y0 == y1, x1).otherwise(x_at(leaves))
    left = F.greatest(F.least(one, other) - slack, F.least(x0, x1))
    right = F.least(F.greatest(one, other) + slack, F.greatest(x0, x1))
    return rows.withColumn("_cx", along(of(left, size), of(right, size)))


def corners(edges: DataFrame, size: float) -> DataFrame:
    """For each ring and cell that it crosses, whether the cell's upper right corner is inside it (`odd` is 1)."""
    e = as_doubles(edges)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    tops = e.withColumn("_cy", along(of(low, size), of(high, size) - 1)).withColumn("_top", border(F.col("_cy") + 1, size))
    tops = tops.where((F.col("y0") > F.col("_top")) != (F.col("y1") > F.col("_top")))
    crossings = tops.select("ring_id", "_cy", F.lit(None).cast("long").alias("_cx"), x_at(F.col("_top")).alias("_at"), F.lit(1).alias("_n"))
    held = walked(edges, size).select("ring_id", "_cy", "_cx").distinct()
    ends = held.withColumns({"_at": border(F.col("_cx") + 1, size), "_n": F.lit(0)})
    # From the right: how many times the ring crosses the row's upper border beyond the corner.
    row = Window.partitionBy("ring_id", "_cy").orderBy(F.desc("_at"), "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = ends.unionByName(crossings).withColumn("odd", F.sum("_n").over(row) % 2)
    return beyond.where(F.col("_cx").isNotNull()).select("ring_id", "_cx", "_cy", "odd")


def inner_blocks(held: DataFrame) -> DataFrame:
    """The cells inside rings that no edge crosses, as blocks of a row: (ring_id, _cy, level, block).

    Between two crossed cells of a row all is inside or all outside, as the left one's corner
    is. A run of cells is some blocks of each length, whatever its own length.
    """
    row = Window.partitionBy("ring_id", "_cy").orderBy("_cx")
    runs = held.withColumn("_to", F.lead("_cx").over(row)).where((F.col("odd") == 1) & (F.col("_to") > F.col("_cx") + 1))
    runs, spans = runs.select("ring_id", "_cy", (F.col("_cx") + 1).alias("a0"), F.col("_to").alias("b0")), []
    for level in range(LEVELS):
        a, b = F.col(f"a{level}"), F.col(f"b{level}")
        up, down = F.ceil(a / BLOCK), F.floor(b / BLOCK)
        more = up < down if level < LEVELS - 1 else F.lit(False)
        runs = runs.withColumns({f"a{level + 1}": F.when(more, up), f"b{level + 1}": F.when(more, down)})
        # What of the run lies before and after the longer blocks.
        spans += [F.struct(F.lit(level).alias("level"), a.alias("a"), F.coalesce(F.col(f"a{level + 1}") * BLOCK, b).alias("b")),
                  F.struct(F.lit(level).alias("level"), (F.col(f"b{level + 1}") * BLOCK).alias("a"), b.alias("b"))]
    cut = runs.select("ring_id", "_cy", F.explode(F.array(*spans)).alias("s"))
    return cut.select("ring_id", "_cy", "s.level", along(F.col("s.a"), F.col("s.b") - 1).alias("block"))


def blocks_of(points: DataFrame) -> DataFrame:
    """A point's block at each level."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("_cx") / BLOCK**i).alias("block")) for i in range(LEVELS)])
    return points.withColumn("_b", F.explode(levels)).select("*", "_b.*").drop("_b")


def placed(points: DataFrame, size: float) -> DataFrame:
    """Points with their cell; those without a place are left out."""
    p = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = p.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return p.withColumns({"_cx": of(F.col("x"), size), "_cy": of(F.col("y"), size)})


def _gap(v: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """From a coordinate to the nearest and to the furthest of an interval."""
    return F.greatest(low - v, v - high, F.lit(0.0)), F.greatest(F.abs(v - low), F.abs(v - high))


def nearest(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Metres from each placed point to its nearest edge, however far.

    From the coarsest cells down, a point keeps the crossed cells that may hold its nearest
    edge: no further at their nearest than the nearest of them all at its furthest. What a
    point meets depends on how edges lie about it, not on how many there are.
    """
    e = settle(walked(edges, size).select(*ENDS, "_cx", "_cy").distinct(), "cells")
    levels = [settle(e.select("_cx", "_cy").distinct(), "level")]
    while True:
        b = levels[-1].agg(F.min("_cx"), F.max("_cx"), F.min("_cy"), F.max("_cy")).head()
        if b[0] is None:
            return points.select("point_id", F.lit(None).cast("double").alias("metres")).limit(0)
        if b[1] - b[0] <= 1 and b[3] - b[2] <= 1:
            break
        levels.append(settle(levels[-1].select(*(F.floor(F.col(c) / STEP).alias(c) for c in ("_cx", "_cy"))).distinct(), "level"))
    top = [F.struct(F.lit(r["_cx"]).alias("_cx"), F.lit(r["_cy"]).alias("_cy")) for r in levels[-1].collect()]  # four cells at most
    held = points.select("point_id", "x", "y", F.explode(F.array(*top)).alias("_c")).select("point_id", "x", "y", F.col("_c._cx").alias("_px"), F.col("_c._cy").alias("_py"))
    for k in range(len(levels) - 2, -1, -1):
        child = levels[k].withColumns({"_px": F.floor(F.col("_cx") / STEP), "_py": F.floor(F.col("_cy") / STEP)})
        width = size * STEP**k
        # A coarse cell begins where its first fine cell does.
        start = lambda c: (F.col(c) * STEP**k - SHIFT) * size  # noqa: E731, B023
        near_x, far_x = _gap(F.col("x"), start("_cx"), start("_cx") + width)
        near_y, far_y = _gap(F.col("y"), start("_cy"), start("_cy") + width)
        met = held.join(child, ["_px", "_py"]).withColumns({"_near": F.sqrt(near_x * near_x + near_y * near_y), "_far": F.sqrt(far_x * far_x + far_y * far_y)})
        least = F.min("_far").over(Window.partitionBy("point_id"))
        held = met.withColumn("_least", least).where(F.col("_near") <= F.col("_least")).select("point_id", "x", "y", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
    met = held.withColumnsRenamed({"_px": "_cx", "_py": "_cy"}).join(e, ["_cx", "_cy"])
    return met.groupBy("point_id").agg(F.min(geodesy.metres_to_segment("x", "y", *ENDS)).alias("metres"))
