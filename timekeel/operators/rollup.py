"""Day summaries, the rolling window, and figures since the start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from . import metrics
from .calibration import recent_dates
from .scoring import ALARM_FLOOR

# Fixed values.
ROLLING_DAYS = 7
CHART_MIN_MATCHED = 100
NOMINAL_COVERAGE_PCT = 80


def day_summary(scored: DataFrame) -> DataFrame:
    """One row per service date: clean, echo and combined figures, head-to-head, warnings."""
    d = scored.withColumns({
        "_clean": F.when(F.col("score_state") == "scored", F.col("model_err_rounded_sec")),
        "_raw": F.when(F.col("score_state") == "scored", F.col("model_err_sec")),
        "_echo": F.when(F.col("score_state") == "echo_suspect", F.col("model_err_rounded_sec")),
        "_hit": F.when(F.col("score_state") == "scored", F.col("interval_hit")),
        "_rival": F.when(F.col("score_state") == "scored", F.col("rival_err_sec")),
    })
    inconsistent = F.count_if(F.col("score_state") == "journey_inconsistent")
    out = d.groupBy("service_date").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("score_state") == "declined").alias("declined"),
        inconsistent.alias("inconsistent_rows"),
        *metrics.accuracy("_clean"),
        *metrics.accuracy("_raw", "raw_"),
        *metrics.accuracy("_echo", "echo_"),
        *metrics.accuracy("model_err_rounded_sec", "incl_echo_"),
        metrics.coverage("_hit"),
        *metrics.head_to_head("_clean", "_rival"),
    )
    return out.withColumns({
        "warn_no_matches": (F.col("n") > 0) & (F.col("matched_events") == 0),
        "warn_inconsistent": F.col("inconsistent_rows") > 0,
        "alarm": (F.col("n") >= ALARM_FLOOR) & (F.col("matched_events") == 0),
    })


def rolling(scored: DataFrame, days: int = ROLLING_DAYS) -> DataFrame:
    """The last `days` scored dates, recomputed from rows so that it can carry a median."""
    recent = scored.join(recent_dates(scored, days), "service_date", "left_semi")
    return metrics.by_group_and_band(
        recent,
        [*metrics.accuracy(), metrics.coverage(), metrics.raw_coverage(), *metrics.head_to_head()],
    )


def pooled(n: str, x: str, alias: str) -> Column:
    """Mean of day means weighted by each day's n; days without rows do not count."""
    ok = (F.col(n) > 0) & F.col(x).isNotNull()
    return F.try_divide(F.sum(F.when(ok, F.col(n) * F.col(x))), F.sum(F.when(ok, F.col(n)))).alias(alias)


def cumulative(days: DataFrame) -> DataFrame:
    """Since the start, pooled from day summaries; means only, medians do not pool."""
    out = days.agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("n").alias("n"),
        pooled("n", "mae_sec", "mae_sec"),
        pooled("n", "coverage_pct", "coverage_pct"),
        F.sum("matched_events").alias("matched_events"),
        pooled("matched_events", "model_mae_sec", "model_mae_sec"),
        pooled("matched_events", "rival_mae_sec", "rival_mae_sec"),
    )
    return out.withColumn("improvement_pct", values.improvement_pct("model_mae_sec", "rival_mae_sec"))


def since_start(days: DataFrame) -> DataFrame:
    """The running form: one row per date, pooled over it and all earlier dates."""
    w = Window.orderBy("service_date").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("n").over(w)
    return days.select(
        "service_date",
        n.alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("mae_sec")).over(w), n).alias("mae_sec"),
        F.sum("matched_events").over(w).alias("matched_events"),
    )


def charted(days: DataFrame) -> DataFrame:
    return days.where(F.col("matched_events") >= CHART_MIN_MATCHED)


def document(rows: DataFrame, key: str, alias: str = "doc") -> DataFrame:
    """A small table as one JSON object keyed by `key`; one row per group at most."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.struct(*[c for c in rows.columns if c != key]))))
    return rows.agg(F.to_json(F.map_from_entries(entries)).alias(alias))
