"""Predict or decline, target choice, the head-to-head with every drop reason, the snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times, values
from .asof import ranked_reports, vantage_of_any, vantage_of_consistent
from .journeys import JOURNEY
from .ordered import Track, count_of, first_by, running
from .scoring import EVENT

REASONS = (
    "upstream_unavailable", "not_in_service", "journey_inconsistent", "station_not_on_route",
    "no_scheduled_arrival", "lead_out_of_range", "already_arrived", "no_upstream_report",
    "vantage_delay_out_of_range",
)


def targets_on_route(prep: DataFrame, t: Track, auto_only: bool = False) -> DataFrame:
    """First stop per code, with the number of reports upstream of it."""
    told = F.col("delay_sec").isNotNull() & F.col("sched_abs").isNotNull()
    if auto_only:
        told = told & (F.col("auto_arrival") == "1")
    counted = running(prep, t, {"reports_before": count_of(told, before=True)})
    return first_by(counted, EVENT, ["location_order"]).select(
        *EVENT, F.col("location_order").alias("target_order"), "sched_abs", "delay_sec", "auto_arrival",
        (F.col("sched_abs") + F.col("delay_sec")).alias("arr_abs"),
        F.coalesce("reports_before", F.lit(0)).alias("reports_before"),
        F.lit(True).alias("on_route"),
    )


def decide(requests: DataFrame, prep: DataFrame, t: Track) -> DataFrame:
    """One outcome and, for a decline, the first reason in order, per (event, `at_sec`)."""
    runs = prep.groupBy(*JOURNEY).agg(F.bool_and("consistent").alias("consistent"))
    asked = requests.join(targets_on_route(prep, t), list(EVENT), "left").join(runs, list(JOURNEY), "left")
    seen = vantage_of_consistent(asked, ranked_reports(prep, t), t)
    lead = F.col("sched_abs") - F.col("at_sec")
    up = F.col("upstream_ok") if "upstream_ok" in requests.columns else F.lit(True)
    reason = (
        F.when(~up, REASONS[0])
        .when(F.col("consistent").isNull(), REASONS[1])
        .when(~F.col("consistent"), REASONS[2])
        .when(F.col("on_route").isNull(), REASONS[3])
        .when(F.col("sched_abs").isNull(), REASONS[4])
        .when(lead > times.MAX_LEAD_SEC, REASONS[5])
        .when(F.col("arr_abs") <= F.col("at_sec"), REASONS[6])
        .when(F.col("vantage_order").isNull(), REASONS[7])
        .when(F.col("vantage_delay_sec") < times.MIN_VANTAGE_DELAY_SEC, REASONS[8])
    )
    said = F.col("reason").isNull()
    late = F.col("reason") == REASONS[8]
    return seen.withColumn("reason", reason).select(
        *requests.columns,
        F.when(said, "predicted").otherwise("declined").alias("outcome"),
        "reason",
        F.when(F.col("consistent"), lead).alias("lead_sec"),
        F.when(F.col("consistent"), times.band(lead)).alias("lead_band"),
        F.when(said, F.col("vantage_order")).alias("vantage_order"),
        F.when(said, F.col("target_order")).alias("target_order"),
        F.when(said | late, F.col("vantage_location")).alias("vantage_location"),
        F.when(said | late, F.col("vantage_delay_sec")).alias("vantage_delay_sec"),
        F.when(said, F.col("vantage_auto")).alias("vantage_auto"),
        F.when(said, F.col("target_order") - F.col("vantage_order")).alias("horizon_route_stops"),
        F.when(said, F.col("sched_abs") - F.col("vantage_sched_abs")).alias("horizon_sched_sec"),
    )


def choose_targets(prep: DataFrame, at: Column, limit: int, seed: int) -> DataFrame:
    """At most one stop ahead per train and lead band, nearest bands first, `limit` a train.

    Arrived, unscheduled and over-four-hour stops are passed over. The pick within a band
    follows a seeded hash, so a rerun chooses the same stops.
    """
    gap = F.col("sched_abs") - at
    open_ = prep.where(
        F.col("sched_abs").isNotNull() & ~F.coalesce(F.col("sched_abs") + F.col("delay_sec") <= at, F.lit(False))
        & (gap <= times.MAX_LEAD_SEC)
    ).withColumn("lead_sec", gap).withColumn("lead_band", times.band(gap)).where(F.col("lead_band").isNotNull())
    pick = F.md5(F.concat_ws("|", F.lit(str(seed)), "train_code", "service_date", "location_order"))
    one = first_by(open_.withColumn("_h", pick), [*JOURNEY, "lead_band"], ["_h", "location_order"])
    rank = F.array_position(F.array(*[F.lit(b) for b in times.BAND_NAMES]), F.col("lead_band"))
    w = Window.partitionBy(*JOURNEY).orderBy("_band")
    return (
        one.withColumn("_band", rank).withColumn("_k", F.row_number().over(w))
        .where(F.col("_k") <= limit).drop("_h", "_k", "_band")
    )


def compare_with_rival(polls: DataFrame, prep: DataFrame, t: Track, predictor: Column) -> DataFrame:
    """Every poll with its drop reason (null when compared) and both errors.

    `polls` carries a unique `request_id`. Vantages are machine-captured stops strictly
    before the poll; `predictor` is a column over the vantage. Journeys may be in any order.
    """
    runs = prep.select(*JOURNEY).distinct().withColumn("_run", F.lit(True))
    asked = (
        polls.select("request_id", *EVENT, "station_group", F.col("location_order").alias("poll_order"),
                     F.col("poll_sec").alias("at_sec"), "eta_sec")
        .join(targets_on_route(prep, t, auto_only=True), list(EVENT), "left")
        .join(runs, list(JOURNEY), "left")
    )
    seen = vantage_of_any(asked, ranked_reports(prep, t, auto_only=True), t, strict=True)
    lead = F.col("sched_abs") - F.col("at_sec")
    drop = (
        F.when(F.col("_run").isNull(), "no journey")
        .when(F.col("on_route").isNull(), "station not on route")
        .when(F.col("arr_abs").isNull(), "no recorded arrival")
        .when(F.col("auto_arrival") != "1", "target AutoArrival != 1")
        .when(F.col("at_sec") >= F.col("arr_abs"), "poll after arrival")
        .when(F.col("vantage_order").isNull(), "nothing observed yet")
        .when(lead.isNull() | (lead < 0), "no usable lead time")
    )
    return seen.withColumn("drop_reason", drop).select(
        "request_id", *EVENT, "station_group", "poll_order", "at_sec", "drop_reason",
        F.when(drop.isNull(), times.band(lead)).alias("lead_band"),
        F.when(drop.isNull(), F.col("vantage_order")).alias("vantage_order"),
        F.when(drop.isNull(), predictor - F.col("delay_sec")).alias("model_err_sec"),
        F.when(drop.isNull(), values.rounded_error(predictor, "delay_sec")).alias("model_err_rounded_sec"),
        F.when(drop.isNull(), values.rival_error("eta_sec", "arr_abs")).alias("rival_err_sec"),
    )


def last_comparison(compared: DataFrame) -> DataFrame:
    kept = compared.where(F.col("drop_reason").isNull())
    return first_by(kept, [*EVENT, "lead_band"], [F.desc("at_sec"), "poll_order"])


def snapshot_journeys(patterns: DataFrame, rows: DataFrame) -> DataFrame:
    """Calling patterns of the trains that got a prediction."""
    said = rows.where(F.col("outcome") == "predicted").select(*JOURNEY).distinct()
    return patterns.join(said, list(JOURNEY), "left_semi")


def headline(rows: DataFrame, low: int = 10, high: int = 45, aim: int = 20) -> DataFrame:
    """The prediction closest to `aim` minutes ahead whose range is more than one minute."""
    ok = rows.where(F.col("ahead_min").between(low, high) & (F.col("low_text") != F.col("high_text")))
    return ok.orderBy(F.abs(F.col("ahead_min") - aim), *JOURNEY, "location_code").limit(1)
