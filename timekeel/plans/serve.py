"""The prediction job: decide, features, model, order, calibrate; log, and only then publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, journeys, predict
from ..operators.ordered import Track
from ..session import settle
from ..sources import sinks

STOP = ("location_order", "location_code", "sched_sec", "delay_sec", "prev_delay_sec", "prev2_delay_sec")


def feature_rows(decided: DataFrame, prep: DataFrame, t: Track) -> DataFrame:
    """The training features of every request that gets a prediction."""
    recent = journeys.with_recent_delays(journeys.observed(prep.where("consistent"), t), t)
    keys = list(journeys.JOURNEY)
    speaks = recent.select(*keys, F.col("location_order").alias("vantage_order"), F.struct(*STOP).alias("_v"))
    told = prep.select(*keys, F.col("location_order").alias("target_order"), F.struct("location_order", "location_code", "sched_sec").alias("_s"))
    asked = decided.where(F.col("outcome") == "predicted").join(speaks, [*keys, "vantage_order"]).join(told, [*keys, "target_order"])
    known = [c for c in decided.columns if c not in ("vantage_order", "target_order", "vantage_location", "horizon_route_stops", "horizon_sched_sec")]
    passed = [c for c in ("station_group", "train_origin", "train_destination") if c in asked.columns and c not in known]
    return asked.select(*known, *journeys.features(lambda f: F.col(f"_v.{f}"), lambda f: F.col(f"_s.{f}"), passed))


def predictions(requests: DataFrame, prep: DataFrame, t: Track, quantiles: Callable[[DataFrame], DataFrame], cal: DataFrame) -> DataFrame:
    """Every request with its outcome; predicted ones with raw and served quantiles in order.

    `quantiles` adds q10, q50 and q90 to feature rows.
    """
    decided = settle(predict.decide(requests, prep, t), "decided")
    q = quantiles(feature_rows(decided, prep, t))
    ordered = F.array_sort(F.array("q10", "q50", "q90"))
    q = q.withColumns({f"{n}_sec": F.bround(ordered[i]).cast("int") for i, n in enumerate(("q10", "q50", "q90"))})
    if "station_group" not in q.columns:
        q = q.withColumn("station_group", F.lit(None).cast("string"))
    out = calibration.served(calibration.with_offsets(q, cal))
    ids = [*requests.columns, "outcome", "reason", "lead_sec", "lead_band"]
    declined = decided.where(F.col("outcome") == "declined").select(*ids)
    said = out.select(*ids, "target_sched_sec", "q10_sec", "q50_sec", "q90_sec", "served_q10_sec", "served_q90_sec")
    return said.unionByName(declined, allowMissingColumns=True)


def log_rows(rows: DataFrame, version: str, at: Column) -> DataFrame:
    """Rows under the prediction log's names."""
    return rows.select(
        "outcome", "reason", at.cast("string").alias("predicted_at"), F.lit(version).alias("model_version"),
        F.col("service_date").cast("string").alias("train_date"), "train_code", F.col("location_code").alias("station_code"), "lead_sec", "lead_band",
        F.col("target_sched_sec").alias("scheduled_arrival"), F.col("q10_sec").alias("raw_q10_sec"), F.col("q90_sec").alias("raw_q90_sec"),
        F.col("served_q10_sec").alias("pred_q10_sec"), F.col("q50_sec").alias("pred_q50_sec"), F.col("served_q90_sec").alias("pred_q90_sec"))


def serve(rows: DataFrame, version: str, at: Column, log: str, *published: str) -> None:
    """Append to the log, then publish the predictions. Nothing is published if the log refuses."""
    held = settle(log_rows(rows, version, at), "served")
    sinks.append_predictions(held, log, F.col("train_date").cast("date"))
    said = held.where(F.col("outcome") == "predicted").select(F.to_json(F.struct("train_date", "train_code", "station_code", "scheduled_arrival", "pred_q10_sec", "pred_q50_sec", "pred_q90_sec")).alias("value"))
    sinks.publish(said, *published)
