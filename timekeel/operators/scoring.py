"""Predictions against outcomes and against the rival forecast.

Every prediction ends in exactly one `score_state`; none is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times, values
from ..session import settle
from .journeys import JOURNEY
from .ordered import first_by

EVENT = (*JOURNEY, "location_code")
STATES = (
    "declined", "train_not_found", "journey_inconsistent", "not_on_route",
    "no_actual_arrival", "scored", "echo_suspect",
)
ALARM_FLOOR = 50


def last_in_band(preds: DataFrame) -> DataFrame:
    """The last statement per event and lead band. Equal instants keep the earlier stop."""
    banded = preds.withColumn("lead_band", times.band("lead_sec"))
    if "scored_band" in preds.columns:
        banded = banded.withColumn("lead_band", F.coalesce("scored_band", "lead_band")).drop("scored_band")
    return first_by(banded, [*EVENT, "lead_band"], [F.desc("made_sec"), "location_order"])


def realised(prep: DataFrame) -> DataFrame:
    """The first stop with each code on each journey, as an outcome row."""
    cols = [
        F.col("location_order").alias("stop_order"),
        F.col("sched_abs"),
        (F.col("sched_abs") + F.col("delay_sec")).alias("arr_abs"),
        F.col("delay_sec").alias("actual_delay_sec"),
        F.col("auto_arrival"),
        *([F.col("consistent")] if "consistent" in prep.columns else []),
        F.lit(True).alias("on_route"),
    ]
    return first_by(prep, EVENT, ["location_order"]).select(*EVENT, *cols)


def rival_statements(polls: DataFrame, outcome: DataFrame) -> DataFrame:
    """Per event and band, the rival's last statement made before the arrival.

    Polls meet their own event by equality, so this stays a hash or merge join; the band
    and the time order are checked on the joined row.
    """
    target = outcome.select(*EVENT, "sched_abs", "arr_abs")
    met = polls.join(target, list(EVENT)).where(F.col("poll_sec") < F.col("arr_abs"))
    banded = met.withColumn("lead_band", times.band(F.col("sched_abs") - F.col("poll_sec")))
    return first_by(
        banded.where(F.col("lead_band").isNotNull()),
        [*EVENT, "lead_band"],
        [F.desc("poll_sec"), "location_order"],
    ).select(
        *EVENT, "lead_band",
        F.col("poll_sec").alias("rival_poll_sec"),
        F.col("eta_sec").alias("rival_eta_sec"),
        F.col("station_group").alias("rival_group"),
    )


def state() -> Column:
    """The ladder, first match wins."""
    return (
        F.when(F.col("outcome") == "declined", "declined")
        .when(F.col("consistent").isNull(), "train_not_found")
        .when(~F.col("consistent"), "journey_inconsistent")
        .when(F.col("on_route").isNull(), "not_on_route")
        .when(F.col("actual_delay_sec").isNull(), "no_actual_arrival")
        .when(F.col("auto_arrival") == "1", "scored")
        .otherwise("echo_suspect")
    )


def score(preds: DataFrame, prep: DataFrame, polls: DataFrame) -> DataFrame:
    """Every kept prediction with its outcome, its errors and the rival's error.

    Outcomes, one row per event, are written once and read three times: by the statements,
    by the polls, and for the journeys' verdicts. Both large inputs meet them as the side
    that AQE can split when one event holds a large share of the rows.
    """
    outcome = settle(realised(prep), "outcomes")
    journeys = outcome.groupBy(*JOURNEY).agg(F.bool_and("consistent").alias("consistent"))
    joined = (
        last_in_band(preds)
        .join(outcome.drop("consistent"), list(EVENT), "left")
        .join(rival_statements(polls, outcome), [*EVENT, "lead_band"], "left")
        .join(journeys, list(JOURNEY), "left")
        .withColumn("score_state", state())
    )
    return graded(joined, preds.columns)


def graded(joined: DataFrame, said: list[str]) -> DataFrame:
    """Judged statements with their errors; `said` are the columns that the statements brought."""
    is_graded = F.col("score_state").isin("scored", "echo_suspect")
    raw_low = F.coalesce("raw_q10_sec", "q10_sec") if "raw_q10_sec" in said else F.col("q10_sec")
    raw_high = F.coalesce("raw_q90_sec", "q90_sec") if "raw_q90_sec" in said else F.col("q90_sec")
    actual = F.col("actual_delay_sec")

    def only_graded(c: Column) -> Column:
        return F.when(is_graded, c)

    return joined.select(
        *EVENT, "lead_band",
        *[c for c in said if c not in (*EVENT, "lead_band", "scored_band")],
        "score_state",
        only_graded(F.col("auto_arrival")).alias("auto_arrival"),
        only_graded(actual).alias("actual_delay_sec"),
        only_graded(F.col("q50_sec") - actual).alias("model_err_sec"),
        only_graded(values.rounded_error("q50_sec", actual)).alias("model_err_rounded_sec"),
        only_graded(values.inside(actual, "q10_sec", "q90_sec")).alias("interval_hit"),
        only_graded(values.inside(actual, raw_low, raw_high)).alias("raw_interval_hit"),
        only_graded(values.rival_error("rival_eta_sec", "arr_abs")).alias("rival_err_sec"),
        only_graded(F.col("rival_poll_sec")).alias("rival_poll_sec"),
        only_graded(F.col("rival_group")).alias("rival_group"),
    )


def unscored_dates(preds: DataFrame, scores: DataFrame, today: Column, back: int) -> DataFrame:
    """Dates with predictions, inside the look-back window, that have no scores yet."""
    wanted = preds.select("service_date").distinct().where(
        F.col("service_date").between(F.date_sub(today, back), F.date_sub(today, 1))
    )
    return wanted.join(scores.select("service_date").distinct(), "service_date", "left_anti")
