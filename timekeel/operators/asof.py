"""The last stop already reported before an instant, upstream of a target stop.

Two inequalities bound it: route order before the target, time before the instant. Neither
form pairs every request with every stop of its journey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .journeys import JOURNEY
from .ordered import Track, count_of, highest_of, running, whole

ALONG_TIME = "at_sec div 3600"


def ranked_reports(prep: DataFrame, t: Track, auto_only: bool = False) -> DataFrame:
    """Reported stops numbered from 1 in route order, with their arrival on the timeline."""
    seen = prep.where(F.col("delay_sec").isNotNull() & F.col("sched_abs").isNotNull())
    if auto_only:
        seen = seen.where(F.col("auto_arrival") == "1")
    ranked = running(seen, t, {"report_rank": count_of()})
    return ranked.select(
        *JOURNEY, F.col("report_rank").cast("int").alias("report_rank"),
        F.col("location_order").alias("vantage_order"),
        F.col("location_code").alias("vantage_location"),
        F.col("sched_abs").alias("vantage_sched_abs"),
        F.col("delay_sec").alias("vantage_delay_sec"),
        F.col("auto_arrival").alias("vantage_auto"),
        (F.col("sched_abs") + F.col("delay_sec")).alias("vantage_arr_abs"),
    )


def reports_by_time(requests: DataFrame, reports: DataFrame, t: Track, strict: bool) -> DataFrame:
    """Adds `by_time`: how many of the journey's reports had arrived by `at_sec`.

    Requests and reports are merged into one time line per journey and counted in one pass.
    """
    asked = requests.withColumn("_kind", F.lit(0 if strict else 1))
    told = reports.select(
        *JOURNEY, F.col("vantage_arr_abs").alias("at_sec"), F.lit(1 if strict else 0).alias("_kind"),
        F.lit(True).alias("_report"),
    )
    line = asked.withColumn("_report", F.lit(False)).unionByName(told, allowMissingColumns=True)
    counted = running(
        line, t.ordered("at_sec", "_kind", piece=ALONG_TIME), {"by_time": count_of(F.col("_report"))}
    )
    return counted.where(~F.col("_report")).drop("_report", "_kind")


def vantage_of_consistent(requests: DataFrame, reports: DataFrame, t: Track, strict: bool = False) -> DataFrame:
    """Vantage where arrivals never go backwards: both bounds are then prefixes of the
    reports, and the last stop within both is the smaller of the two counts.

    `requests` carries `at_sec` and `reports_before`, the reports upstream of the target.
    """
    timed = reports_by_time(requests, reports, t, strict)
    wanted = timed.withColumn("report_rank", F.least("by_time", "reports_before").cast("int")).drop("by_time")
    return wanted.join(reports, [*JOURNEY, "report_rank"], "left").drop("report_rank")


def vantage_of_any(requests: DataFrame, reports: DataFrame, t: Track, strict: bool = True) -> DataFrame:
    """Vantage on any journey, arrivals in whatever order.

    The reports before a target, numbers 0 to m-1, split into at most log2(m) aligned blocks,
    one per bit of m. Within a block a running maximum along time gives the last report that
    had arrived; the best over the blocks is the vantage. `requests` carries a unique
    `request_id`, `at_sec` and `reports_before`.
    """
    sized = whole(reports, t, {"_n": F.count(F.lit(1))})
    i = F.col("report_rank") - 1
    levels = F.sequence(F.lit(0), F.floor(F.log2("_n")).cast("int"))
    in_blocks = sized.withColumn("_level", F.explode(levels)).select(
        *JOURNEY, F.col("vantage_arr_abs").alias("at_sec"), "_level",
        F.expr("shiftright(report_rank - 1, _level)").alias("_block"),
        F.lit(1 if strict else 0).alias("_kind"), i.alias("_i"),
        F.lit(None).cast("bigint").alias("request_id"),
    ).where(F.col("_block") % 2 == 0)
    m = F.col("reports_before").cast("int")
    bits = F.filter(
        F.sequence(F.lit(0), F.floor(F.log2(m)).cast("int")),
        lambda b: F.col("_m").bitwiseAND(F.pow(F.lit(2), b).cast("int")) != 0,
    )
    lookups = requests.where(m > 0).withColumn("_m", m).withColumn("_level", F.explode(bits)).select(
        *JOURNEY, "at_sec", "_level", (F.expr("shiftright(_m, _level)") - 1).alias("_block"),
        F.lit(0 if strict else 1).alias("_kind"), F.lit(None).cast("int").alias("_i"), "request_id",
    )
    line = in_blocks.unionByName(lookups)
    track = Track((*t.keys, "_level", "_block"), ("at_sec", "_kind"), ALONG_TIME, t.long)
    best = running(line, track, {"_best": highest_of(F.col("_i"))}).where(F.col("request_id").isNotNull())
    found = best.groupBy("request_id").agg((F.max("_best") + 1).cast("int").alias("report_rank"))
    return (
        requests.join(found, "request_id", "left")
        .join(reports, [*JOURNEY, "report_rank"], "left")
        .drop("report_rank")
    )
