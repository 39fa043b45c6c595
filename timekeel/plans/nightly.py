"""The nightly jobs: score what is missing, then derive everything from the written scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import calibration, drift, journeys, rollup, scoring
from ..sources import sinks


class NoMatches(Exception):
    """A well-scored day met no rival statement at all; its scores are kept."""


def missing_dates(preds: DataFrame, path: str, now: Column, back: int = 7) -> DataFrame:
    """Settled dates with predictions but no scores, within the look-back window."""
    today = F.to_date(times.local_time(now))
    settled = preds.where(times.is_settled("service_date", now))
    done = sinks.existing(preds.sparkSession, path)
    if done is None:
        done = preds.sparkSession.createDataFrame([], "date string")
    return scoring.unscored_dates(settled, done.select(F.col("date").cast("date").alias("service_date")), today, back)


def score_dates(preds: DataFrame, stops: DataFrame, polls: DataFrame, dates: DataFrame, out: str) -> None:
    """Score the given dates and write them, one partition a date.

    Rows are matched by their own service date: a poll after midnight still belongs to the
    day its train left.
    """
    def on(df: DataFrame) -> DataFrame:
        return df.join(dates, "service_date", "left_semi")

    stops = on(stops)
    t = journeys.journey_track(stops)
    scores = scoring.score(on(preds), journeys.prepared(stops, t), on(polls))
    sinks.write_scores(scores.withColumn("date", F.col("service_date").cast("string")), out)


def derive(spark: SparkSession, scores: str, schema, out: str) -> None:
    """Roll-up, calibration and drift from the scores on storage; then the alarm.

    The figures are written before a day without any match fails the job.
    """
    rows = spark.read.schema(schema).json(scores)
    days = rollup.day_summary(rows)
    days.write.mode("overwrite").parquet(f"{out}/days")
    # The latest dates are known from the folders, so older ones are not read.
    dates = sinks.partition_values(spark, scores) or []
    last = rows.where(F.col("date") >= F.lit(min(dates[-rollup.ROLLING_DAYS:], default="")))
    fitted = rows.where(F.col("date") >= F.lit(min(dates[-calibration.WINDOW_DAYS:], default="")))
    rollup.rolling(last).write.mode("overwrite").parquet(f"{out}/rolling")
    written = spark.read.parquet(f"{out}/days")
    rollup.cumulative(written).write.mode("overwrite").parquet(f"{out}/cumulative")
    recent = fitted.join(calibration.recent_dates(fitted, calibration.WINDOW_DAYS), "service_date", "left_semi")
    calibration.fit(calibration.residuals(recent)).write.mode("overwrite").parquet(f"{out}/calibration")
    drift.coverage_trigger(drift.daily_hits(rows)).write.mode("overwrite").parquet(f"{out}/drift")
    quiet = written.where("alarm").select("service_date").limit(5).collect()
    if quiet:
        raise NoMatches("no rival matches on " + ", ".join(str(r["service_date"]) for r in quiet))
