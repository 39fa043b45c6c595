"""Recalibration of the interval on recent outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

# Fixed values.
WINDOW_DAYS = 14
MIN_ROWS = 200
OVERDUE_BAND = "0-5 min"


def _raw(df: DataFrame, side: str) -> Column:
    served = F.col(f"q{side}_sec")
    return F.coalesce(F.col(f"raw_q{side}_sec"), served) if f"raw_q{side}_sec" in df.columns else served


def recent_dates(df: DataFrame, days: int, date: str = "service_date") -> DataFrame:
    """The last `days` distinct dates present. One row per date is ordered, never the rows."""
    dates = df.select(date).distinct()
    ranked = dates.withColumn("_rank", F.dense_rank().over(Window.orderBy(F.col(date).desc())))
    return ranked.where(F.col("_rank") <= days).select(date)


def residuals(scored: DataFrame) -> DataFrame:
    """Actual minus the raw quantiles, of cleanly scored rows that have a band."""
    usable = scored.where(
        (F.col("score_state") == "scored") & F.col("actual_delay_sec").isNotNull()
        & (F.coalesce("lead_band", F.lit("")) != "")
    )
    return usable.select(
        *[c for c in ("service_date",) if c in scored.columns],
        F.coalesce("station_group", F.lit("")).alias("station_group"),
        "lead_band",
        (F.col("actual_delay_sec") - _raw(scored, "10")).alias("low_res"),
        (F.col("actual_delay_sec") - _raw(scored, "90")).alias("high_res"),
    ).where(F.col("low_res").isNotNull() & F.col("high_res").isNotNull())


def residual_counts(res: DataFrame, keep: tuple[str, ...] = ("service_date",)) -> DataFrame:
    """How often each residual occurs, by side (`low`, `high`), group and band.

    Residuals are whole seconds, so a day's table is as long as its residuals are spread, not
    as it has rows; tables of several days are added up, and fits of any window read them.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_res").alias("res")) for s in ("low", "high"))))
    return res.select(*keep, "station_group", "lead_band", sides.alias("_s")).select(
        *keep, "station_group", "lead_band", "_s.*").groupBy(*keep, "station_group", "lead_band", "side", "res").agg(F.count(F.lit(1)).alias("n"))


def fit_counts(counts: DataFrame, keep: tuple[str, ...] = (), min_rows: int = MIN_ROWS) -> DataFrame:
    """Offsets per (group, band) and per band from counted residuals, in one grouping-sets pass.

    Columns: `station_group` (null in a band row), `lead_band`, `n`, `lo`, `hi`.
    """
    sets = [[*keep, "station_group", "lead_band"], [*keep, "lead_band"]]

    def end(side: str, share: float) -> Column:
        return F.bround(F.percentile(F.when(F.col("side") == side, F.col("res")), share, F.col("n"))).cast("int")

    return (
        counts.groupingSets(sets, *keep, "station_group", "lead_band")
        .agg(F.sum(F.when(F.col("side") == "low", F.col("n"))).alias("n"), end("low", 0.1).alias("lo"), end("high", 0.9).alias("hi"))
        .where(F.col("n") >= min_rows)
    )


def fit(res: DataFrame, keep: tuple[str, ...] = (), min_rows: int = MIN_ROWS) -> DataFrame:
    """`fit_counts` of residual rows."""
    return fit_counts(residual_counts(res, keep), keep, min_rows)


def with_offsets(preds: DataFrame, cal: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds `lo` and `hi`: the cell's, else its band's, else zero. No band means overdue,
    which takes the shortest band.

    A calibration has one row per group and band, far below the broadcast threshold, so
    both lookups broadcast by Spark's own size check.
    """
    cells = cal.where(F.col("station_group").isNotNull()).select(
        *keep, F.col("station_group").alias("_g"), F.col("lead_band").alias("_b"),
        F.col("lo").alias("_clo"), F.col("hi").alias("_chi"))
    bands = cal.where(F.col("station_group").isNull()).select(
        *keep, F.col("lead_band").alias("_b"), F.col("lo").alias("_blo"), F.col("hi").alias("_bhi"))
    keyed = preds.withColumns({
        "_b": F.coalesce("lead_band", F.lit(OVERDUE_BAND)),
        "_g": F.coalesce("station_group", F.lit("")),
    })
    return (
        keyed.join(cells, [*keep, "_g", "_b"], "left").join(bands, [*keep, "_b"], "left")
        .withColumns({
            "lo": F.coalesce("_clo", "_blo", F.lit(0)),
            "hi": F.coalesce("_chi", "_bhi", F.lit(0)),
        })
        .drop("_b", "_g", "_clo", "_chi", "_blo", "_bhi")
    )


def served(preds: DataFrame) -> DataFrame:
    """The calibrated range, held either side of the median."""
    return preds.withColumns({
        "served_q10_sec": values.served_low("q10_sec", "q50_sec", "lo"),
        "served_q90_sec": values.served_high("q90_sec", "q50_sec", "hi"),
    })


def walk_forward(scored: DataFrame, days: int = WINDOW_DAYS, min_rows: int = MIN_ROWS) -> DataFrame:
    """Each week, from Monday, served with a calibration fitted on the `days` before it only.

    Residuals are counted by date once; a day's counts, not its rows, go to each week that
    begins within `days` after it.
    """
    week = F.date_trunc("week", "service_date").cast("date")
    weeks = scored.select(week.alias("for_date")).distinct()
    begins = F.sequence(F.next_day("service_date", "MON"), F.date_add(F.next_day("service_date", "MON"), days), F.expr("INTERVAL 7 DAYS"))
    begins = F.filter(begins, lambda w: w <= F.date_add("service_date", days))
    counts = residual_counts(residuals(scored)).withColumn("for_date", F.explode(begins)).join(weeks, "for_date", "left_semi")
    cal = fit_counts(counts, keep=("for_date",), min_rows=min_rows)
    clean = scored.where(F.col("score_state") == "scored").withColumn("for_date", week)
    out = served(with_offsets(clean, cal, keep=("for_date",)))
    a = F.col("actual_delay_sec")
    return out.groupBy("service_date").agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg(a.between(F.col("q10_sec"), F.col("q90_sec")).cast("int"))).alias("coverage_before_pct"),
        (100 * F.avg(a.between(F.col("served_q10_sec"), F.col("served_q90_sec")).cast("int"))).alias("coverage_after_pct"),
        F.percentile(F.col("q90_sec") - F.col("q10_sec"), 0.5).alias("width_before_sec"),
        F.percentile(F.col("served_q90_sec") - F.col("served_q10_sec"), 0.5).alias("width_after_sec"),
    )
