"""Archive to examples to baseline: each stage is a table, skipped where already written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import journeys, metrics
from ..sources import feeds, sinks


def new_folders(spark: SparkSession, raw: str, out: str, force: bool = False) -> list[str]:
    """The archive's date folders that `out` has no partition of; one name a date is looked at."""
    done = set() if force else set(sinks.partition_values(spark, out) or ())
    return [folder for date, folder in sinks.date_folders(spark, raw).items() if date not in done]


def parse(spark: SparkSession, raw: str, out: str, force: bool = False) -> list[str]:
    """Feed XML to typed stop rows by date. Only folders of dates not written yet are handed
    to the reader, so finished dates are never opened; the folders read are returned."""
    folders = new_folders(spark, raw, out, force)
    if folders:
        rows = feeds.parse_movements(feeds.read_movements(spark, folders))
        sinks.write_partitioned(rows.withColumn("date", F.col("file_date")), out, ("date",))
    return folders


def cut_examples(stops: DataFrame, out: str, ranges: dict[str, tuple[str, str]], excluded: tuple[str, ...] = (),
                 unwrap: bool = True) -> None:
    """Examples of consistent journeys by split and date."""
    dated = stops.where(times.split_of("service_date", ranges, excluded).isNotNull())
    t = journeys.journey_track(dated)
    prep = journeys.prepared(dated, t, unwrap)
    ex = journeys.examples(journeys.observed(prep.where("consistent"), t), t)
    named = ex.withColumns({"split": times.split_of("service_date", ranges, excluded), "date": F.col("service_date").cast("string")})
    sinks.write_partitioned(named, out, ("split", "date"))


def baseline(ex: DataFrame) -> DataFrame:
    """Zero and persistence by horizon and by scheduled time, on machine-captured examples."""
    banded = journeys.trusted(ex).withColumns({
        "horizon": F.col("horizon_observed_stops").cast("string"), "band": times.band("horizon_sched_sec")})
    predictors = {"zero": F.lit(0), "persistence": F.col("current_delay_sec")}
    return metrics.predictor_report(banded, predictors, ["horizon", "band"])
