"""Two collectors of the same boards: uptime windows, overlap, volume and value agreement.

Cycles are distinct five-minute instants, so anything ordered per side is one row per five
minutes. Windows meet days, hours and each other by equal buckets, never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..session import settle

# Fixed values.
GAP_SEC = 15 * 60
TRIM_CYCLES = 1
PAIR_SEC = 150
ADJACENT_SEC = 600
CONTROL_SEC = (240, 360)
OVERLAP_TARGET_PCT = 99.5
MIN_HOURS = 2.0
KEY = ("service_date", "train_code", "station_code")

#: Cells of time for the search of the nearest cycle: an hour, and so many cells to a block, so
#: many times over. One block then holds two thousand years, from about the year 1020.
TIME_CELL_SEC, CELLS_OF_BLOCK, TIME_LEVELS, TIME_SHIFT = 3600, 64, 4, 30_000_000_000


def cycle_report(rows: DataFrame) -> DataFrame:
    """Attempted, failed and skipped per cycle, and the status they make."""
    c = rows.groupBy("side", "cycle_sec").agg(
        F.count_if(~F.col("skipped")).alias("attempted"),
        F.count_if(F.col("failed") & ~F.col("skipped")).alias("failed"),
        F.count_if(F.col("skipped")).alias("skipped"),
    )
    return c.withColumn("records", F.col("attempted") - F.col("failed")).withColumn(
        "status",
        F.when((F.col("attempted") > 0) & (F.col("failed") == 0),
               F.when(F.col("skipped") > 0, "partial").otherwise("complete"))
        .when(F.col("failed") == F.col("attempted"), "failed")
        .otherwise("degraded"),
    )


def productive(cycles: DataFrame) -> DataFrame:
    return cycles.where((F.col("records") > 0) & (F.col("status") != "failed"))


def runs(cycles: DataFrame, gap: int = GAP_SEC) -> DataFrame:
    """Distinct cycles with the number of the unbroken run each belongs to."""
    c = cycles.select("side", "cycle_sec").distinct()
    w = Window.partitionBy("side").orderBy("cycle_sec")
    broke = (F.col("cycle_sec") - F.lag("cycle_sec").over(w) > gap).cast("int")
    flagged = c.withColumn("_broke", F.coalesce(broke, F.lit(0)))
    return flagged.withColumn("run", F.sum("_broke").over(w)).drop("_broke")


def windows(cycles: DataFrame, gap: int = GAP_SEC, trim: int = TRIM_CYCLES) -> DataFrame:
    """Runs trimmed by `trim` cycles at each edge that still hold two: (side, start, end)."""
    r = runs(cycles, gap)
    w = Window.partitionBy("side", "run")
    kept = r.withColumns({
        "_up": F.row_number().over(w.orderBy("cycle_sec")),
        "_down": F.row_number().over(w.orderBy(F.desc("cycle_sec"))),
    }).where((F.col("_up") > trim) & (F.col("_down") > trim))
    return (
        kept.groupBy("side", "run")
        .agg(F.min("cycle_sec").alias("start_sec"), F.max("cycle_sec").alias("end_sec"), F.count(F.lit(1)).alias("_n"))
        .where("_n >= 2").select("side", "start_sec", "end_sec")
    )


def longest_run(cycles: DataFrame, gap: int = GAP_SEC) -> DataFrame:
    sizes = runs(cycles, gap).groupBy("side", "run").count()
    return sizes.groupBy("side").agg(F.max("count").alias("longest"))


def _buckets(start: str, end: str, size: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size)))


def both_up(wins: DataFrame, left: str = "local", right: str = "cloud") -> DataFrame:
    """Stretches covered by a window of each side; windows meet on the days they touch."""
    day = wins.withColumn("_day", _buckets("start_sec", "end_sec", 86400))
    a = day.where(F.col("side") == left).select("_day", F.col("start_sec").alias("a0"), F.col("end_sec").alias("a1"))
    b = day.where(F.col("side") == right).select("_day", F.col("start_sec").alias("b0"), F.col("end_sec").alias("b1"))
    met = a.join(b, "_day").where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    return met.select(
        F.greatest("a0", "b0").alias("start_sec"), F.least("a1", "b1").alias("end_sec")
    ).distinct()


def inside_windows(rows: DataFrame, wins: DataFrame, at: str = "cycle_sec") -> DataFrame:
    """Rows whose instant falls in any window, matched on the hour."""
    hours = wins.withColumn("_hour", _buckets("start_sec", "end_sec", 3600))
    keyed = rows.withColumn("_hour", F.floor(F.col(at) / 3600))
    return keyed.alias("r").join(
        hours.alias("w"),
        (F.col("r._hour") == F.col("w._hour")) & F.col(f"r.{at}").between(F.col("w.start_sec"), F.col("w.end_sec")),
        "left_semi",
    ).drop("_hour")


def active_period(day: Column) -> tuple[Column, Column]:
    """From 05:30 local time to 00:30 the next day, in epoch seconds."""
    local = day.cast("timestamp")
    start = F.to_utc_timestamp(local + F.expr("INTERVAL 330 MINUTES"), times.ZONE)
    end = F.to_utc_timestamp(local + F.expr("INTERVAL 1470 MINUTES"), times.ZONE)
    return F.unix_timestamp(start), F.unix_timestamp(end)


def day_coverage(cycles: DataFrame, overlap: DataFrame, now: Column | None = None) -> DataFrame:
    """Covered against active hours per day; the active hours of a day that isn't over end at `now` (epoch seconds)."""
    days = cycles.select(
        F.to_date(F.from_utc_timestamp(F.timestamp_seconds("cycle_sec"), times.ZONE)).alias("day")
    ).distinct()
    start, end = active_period(F.col("day"))
    if now is not None:
        end = F.greatest(start, F.least(end, now))
    days = days.withColumns({"_from": start, "_to": end})
    touched = overlap.withColumn("_d", F.explode(F.sequence(
        F.floor(F.col("start_sec") / 86400) - 1, F.floor(F.col("end_sec") / 86400) + 1)))
    met = days.join(touched, F.unix_date("day") == F.col("_d"), "left")
    # least and greatest skip nulls, so a day no window touches is set apart first.
    common = F.when(
        F.col("start_sec").isNotNull(),
        F.greatest(F.lit(0), F.least("end_sec", "_to") - F.greatest("start_sec", "_from")),
    ).otherwise(0)
    return met.groupBy("day").agg(
        F.count_if(common > 0).alias("windows"),
        (F.coalesce(F.sum(common), F.lit(0)) / 3600.0).alias("covered_h"),
        (F.max(F.col("_to") - F.col("_from")) / 3600.0).alias("active_h"),
    )


def event_agreement(rows: DataFrame) -> DataFrame:
    """Distinct events seen by both, or by one only, per group and in total.

    One aggregate per event replaces two distincts and a full outer join.
    """
    seen = rows.groupBy("station_group", *KEY).agg(
        F.bool_or(F.col("side") == "local").alias("_l"), F.bool_or(F.col("side") == "cloud").alias("_c")
    )
    both = F.count_if(F.col("_l") & F.col("_c"))
    return seen.rollup("station_group").agg(
        F.grouping("station_group").alias("is_total"),
        both.alias("both"),
        F.count_if(F.col("_l") & ~F.col("_c")).alias("local_only"),
        F.count_if(F.col("_c") & ~F.col("_l")).alias("cloud_only"),
        (100 * both / F.count(F.lit(1))).alias("overlap_pct"),
    )


def volume_parity(rows: DataFrame) -> DataFrame:
    """Mean and worst deviation of records per station-hour both sides have."""
    hours = rows.groupBy("station_code", F.floor(F.col("cycle_sec") / 3600).alias("_h")).agg(
        F.count_if(F.col("side") == "local").alias("l"), F.count_if(F.col("side") == "cloud").alias("c")
    ).where("l > 0 AND c > 0")
    dev = F.abs(F.col("l") - F.col("c")) / F.greatest("l", "c")
    return hours.agg(
        F.count(F.lit(1)).alias("station_hours"), (100 * F.avg(dev)).alias("mean_pct"), (100 * F.max(dev)).alias("worst_pct")
    )


def paired_cycles(cycles: DataFrame, within: int = PAIR_SEC) -> DataFrame:
    """Each local cycle with the nearest cloud cycle no further than `within` seconds."""
    c = cycles.select("side", "cycle_sec").distinct()
    a = c.where("side = 'local'").select(F.col("cycle_sec").alias("local_sec"))
    a = a.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("local_sec") / within) - 1, F.floor(F.col("local_sec") / within) + 1)))
    b = c.where("side = 'cloud'").select(F.col("cycle_sec").alias("cloud_sec"), F.floor(F.col("cycle_sec") / within).alias("_b"))
    gap = F.abs(F.col("cloud_sec") - F.col("local_sec"))
    met = a.join(b, "_b").withColumn("gap_sec", gap).where(F.col("gap_sec") <= within)
    best = met.groupBy("local_sec").agg(F.min(F.struct("gap_sec", "cloud_sec")).alias("_m"))
    return best.select("local_sec", F.col("_m.cloud_sec").alias("cloud_sec"), F.col("_m.gap_sec").alias("gap_sec"))


def phase_offset(cycles: DataFrame) -> DataFrame:
    """Upper median of each local cycle's distance to the nearest cloud cycle.

    Cycles lie in cells of time, cells in blocks of cells, and so on up to one block of all
    time. The nearest cloud cycle on either side is in the cycle's own cell, or else in the
    nearest cell of its block that has one, or else further up: every step looks through one
    cell or through the few cells of one block, and no step through all cycles.
    """
    c = cycles.select("side", "cycle_sec").distinct().withColumn("_b0", F.floor((F.col("cycle_sec") + TIME_SHIFT) / TIME_CELL_SEC))
    cloud = F.when(F.col("side") == "cloud", F.col("cycle_sec"))
    within = Window.partitionBy("_b0").orderBy("cycle_sec")
    near = c.withColumns({
        "_before": F.last(cloud, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first(cloud, ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing))})
    blocks = settle(c.groupBy("_b0").agg(F.min(cloud).alias("_lo"), F.max(cloud).alias("_hi")), "cells")
    levels = []
    for k in range(TIME_LEVELS):
        up = blocks.withColumn(f"_b{k + 1}", F.floor(F.col(f"_b{k}") / CELLS_OF_BLOCK))
        along = Window.partitionBy(f"_b{k + 1}").orderBy(f"_b{k}")
        levels.append(up.withColumns({
            "_prev": F.last("_hi", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
            "_next": F.first("_lo", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))}).drop("_lo", "_hi"))
        blocks = up.groupBy(f"_b{k + 1}").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    carried = levels[-1]
    for k in range(TIME_LEVELS - 2, -1, -1):
        above = carried.select(f"_b{k + 1}", F.col("_prev").alias("_p"), F.col("_next").alias("_n"))
        carried = levels[k].join(above, f"_b{k + 1}").select(f"_b{k}", F.coalesce("_prev", "_p").alias("_prev"), F.coalesce("_next", "_n").alias("_next"))
    met = near.where("side = 'local'").join(carried.select("_b0", "_prev", "_next"), "_b0")
    gap = F.least(F.col("cycle_sec") - F.coalesce("_before", "_prev"), F.coalesce("_after", "_next") - F.col("cycle_sec"))
    return met.select(gap.alias("gap")).agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC)").cast("bigint").alias("offset_sec")
    )


def latest_values(rows: DataFrame) -> DataFrame:
    """One value per side, cycle and event: the last one written."""
    return rows.groupBy("side", "cycle_sec", *KEY).agg(
        F.max(F.struct("event_id", "eta")).alias("_v")
    ).select("side", "cycle_sec", *KEY, F.col("_v.eta").alias("eta"))


def value_pairs(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Local and cloud value of each event both captured in a paired cycle."""
    l = values.where("side = 'local'").select(F.col("cycle_sec").alias("local_sec"), *KEY, F.col("eta").alias("local_eta"))
    c = values.where("side = 'cloud'").select(F.col("cycle_sec").alias("cloud_sec"), *KEY, F.col("eta").alias("cloud_eta"))
    return l.join(pairs, "local_sec").join(c, ["cloud_sec", *KEY])


def _around(values: DataFrame) -> DataFrame:
    """Local values with the same event's previous and next capture. After `latest_values`
    an event has at most one row per cycle of its day."""
    w = Window.partitionBy(*KEY).orderBy("cycle_sec")
    return values.where("side = 'local'").select(
        F.col("cycle_sec").alias("local_sec"), *KEY, F.col("eta").alias("local_eta"),
        F.lag("cycle_sec").over(w).alias("prev_sec"), F.lag("eta").over(w).alias("prev_eta"),
        F.lead("cycle_sec").over(w).alias("next_sec"), F.lead("eta").over(w).alias("next_eta"),
    )


def revision_direction(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Does a disagreement equal the local side's next value, its previous one, both, neither?

    Unjudged when the local side did not capture the event again within ten minutes.
    """
    cloud = values.where("side = 'cloud'").select(F.col("cycle_sec").alias("cloud_sec"), *KEY, F.col("eta").alias("cloud_eta"))
    met = _around(values).join(pairs, "local_sec").join(cloud, ["cloud_sec", *KEY])
    fwd = F.col("next_eta").eqNullSafe(F.col("cloud_eta"))
    bwd = F.coalesce(
        F.col("prev_eta").eqNullSafe(F.col("cloud_eta")) & (F.col("local_sec") - F.col("prev_sec") <= ADJACENT_SEC), F.lit(False)
    )
    kind = (
        F.when(F.col("local_eta").eqNullSafe(F.col("cloud_eta")), "agree")
        .when(F.coalesce(F.col("next_sec") - F.col("local_sec") > ADJACENT_SEC, F.lit(True)), "unjudged")
        .when(fwd & bwd, "both").when(fwd, "next").when(bwd, "previous").otherwise("neither")
    )
    return met.groupBy(kind.alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def change_rate(values: DataFrame) -> DataFrame:
    """Control: how often the local side's own value changes between captures 4-6 min apart."""
    near = _around(values).where((F.col("next_sec") - F.col("local_sec")).between(*CONTROL_SEC))
    changed = ~F.col("local_eta").eqNullSafe(F.col("next_eta"))
    return near.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(changed).alias("changed"))


def field_sets(rows: DataFrame, json: str, by: str) -> DataFrame:
    """Distinct sets of JSON field names per side, as sorted text."""
    names = F.array_join(F.array_sort(F.json_object_keys(json)), ",")
    return rows.groupBy(by, names.alias("fields")).agg(F.count(F.lit(1)).alias("n"))


def verdict(agreement: DataFrame, coverage: DataFrame, target: float = OVERLAP_TARGET_PCT) -> DataFrame:
    total = agreement.where("is_total = 1").select("overlap_pct")
    hours = coverage.agg(F.sum("covered_h")).scalar()
    return total.withColumn("covered_h", hours).withColumn(
        "verdict",
        F.when(F.col("covered_h") < MIN_HOURS, "provisional")
        .when(F.col("overlap_pct") >= target, "meets").otherwise("does not meet"),
    )
