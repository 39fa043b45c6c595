"""Error, head-to-head and coverage figures, by slice.

Each figure is a list of aggregate columns, so several of them and all slices come out of
one grouping-sets pass. Percentile buffers hold distinct values (delays in whole seconds),
not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

UNPOLLED = "(unpolled)"


def upper_median(c: str) -> Column:
    """The element at index n // 2 of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def accuracy(err: str = "model_err_rounded_sec", prefix: str = "") -> list[Column]:
    return [
        F.count(err).alias(f"{prefix}n"),
        F.avg(F.abs(err)).alias(f"{prefix}mae_sec"),
        upper_median(f"abs({err})").cast("int").alias(f"{prefix}medae_sec"),
        F.avg(err).alias(f"{prefix}bias_sec"),
    ]


def spread(err: str, prefix: str = "") -> list[Column]:
    """As `accuracy`, with the interpolated median."""
    return [
        F.count(err).alias(f"{prefix}n"),
        F.avg(F.abs(err)).alias(f"{prefix}mae_sec"),
        F.percentile(F.abs(err), 0.5).alias(f"{prefix}medae_sec"),
        F.avg(err).alias(f"{prefix}bias_sec"),
    ]


def head_to_head(ours: str = "model_err_rounded_sec", theirs: str = "rival_err_sec") -> list[Column]:
    """On events both sides spoke about: n, both errors, improvement, wins, ties, losses."""
    both = F.col(theirs).isNotNull() & F.col(ours).isNotNull()
    a, b = F.abs(ours), F.abs(theirs)
    mo, op = F.avg(F.when(both, a)), F.avg(F.when(both, b))
    return [
        F.count_if(both).alias("matched_events"),
        mo.alias("model_mae_sec"),
        op.alias("rival_mae_sec"),
        values.improvement_pct(mo, op).alias("improvement_pct"),
        F.count_if(both & (a < b)).alias("model_wins"),
        F.count_if(both & (a == b)).alias("ties"),
        F.count_if(both & (a > b)).alias("rival_wins"),
    ]


def coverage(hit: str = "interval_hit", alias: str = "coverage_pct") -> Column:
    return (100 * F.avg(F.col(hit).cast("int"))).alias(alias)


def raw_coverage(alias: str = "raw_coverage_pct") -> Column:
    return (100 * F.avg(F.coalesce("raw_interval_hit", "interval_hit").cast("int"))).alias(alias)


def sliced(df: DataFrame, dims: list[str], aggs: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Overall and by each dimension on its own: columns `scope`, `key` and the figures."""
    cols = [*keep, *dims]
    sets = [list(keep)] + [[*keep, d] for d in dims]
    out = df.groupingSets(sets, *cols).agg(*aggs, F.grouping_id().alias("_gid"))
    full = (1 << len(dims)) - 1
    scope, key = F.lit("overall"), F.lit("")
    for i, d in enumerate(dims):
        mine = F.col("_gid") == (full & ~(1 << (len(dims) - 1 - i)))
        scope = F.when(mine, d).otherwise(scope)
        key = F.when(mine, F.col(d).cast("string")).otherwise(key)
    figures = [c for c in out.columns if c not in (*cols, "_gid")]
    return out.select(*keep, scope.alias("scope"), key.alias("key"), *figures)


def by_group_and_band(scored: DataFrame, aggs: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    clean = scored.where(F.col("score_state") == "scored")
    named = clean.withColumn("station_group", F.coalesce("station_group", F.lit(UNPOLLED)))
    return sliced(named, ["station_group", "lead_band"], aggs, keep).where(
        (F.col("scope") != "lead_band") | F.col("key").isNotNull()
    )


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and share of the total per value."""
    counts = df.groupBy(by).count().withColumnRenamed("count", "n")
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(by, "n", (100 * F.col("n") / total).alias("share_pct"))


def answered(scored: DataFrame) -> DataFrame:
    """How many predictions were an answer rather than a decline."""
    said = F.col("score_state") != "declined"
    return scored.agg(
        F.count_if(said).alias("answered"),
        F.count_if(~said).alias("declined"),
        (100 * F.avg(said.cast("int"))).alias("answered_pct"),
    )


def visitor_coverage(scopes: DataFrame, scored: DataFrame) -> DataFrame:
    """Answer rate as a board's reader meets it: P(in scope) times P(answered | in scope).

    Null when either denominator is zero.
    """
    said = scored.agg(F.avg((F.col("score_state") != "declined").cast("int"))).scalar()
    gone, here = F.col("scope") == "departed", F.col("scope") == "not_yet_departed"
    board = scopes.agg(F.count_if(gone).alias("_gone"), F.count_if(gone | here).alias("board_entries"))
    in_scope = F.try_divide(F.col("_gone"), F.col("board_entries"))
    return board.withColumn("_rate", said).select(
        "board_entries",
        (100 * in_scope).alias("in_scope_pct"),
        (100 * F.col("_rate")).alias("answered_given_in_scope_pct"),
        (100 * in_scope * F.col("_rate")).alias("answered_pct"),
    )


def predictor_report(ex: DataFrame, predictors: dict[str, Column], dims: list[str],
                     label: str = "target_delay_sec") -> DataFrame:
    """Figures of several predictors side by side, overall and by each dimension."""
    stacked = ex.withColumn(
        "_p", F.explode(F.array(*[
            F.struct(F.lit(n).alias("predictor"), (p - F.col(label)).alias("err"))
            for n, p in predictors.items()
        ]))
    ).select(*dims, "_p.*")
    return sliced(stacked, dims, spread("err"), keep=("predictor",)).where(
        (F.col("scope") == "overall") | F.col("key").isNotNull()
    )


def interval_report(df: DataFrame, dims: list[str], actual: str, low: str, high: str) -> DataFrame:
    """Coverage, median width and the share missed on each side."""
    a, lo, hi = F.col(actual), F.col(low), F.col(high)
    return sliced(df, dims, [
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg(a.between(lo, hi).cast("int"))).alias("coverage_pct"),
        F.percentile(hi - lo, 0.5).alias("median_width_sec"),
        (100 * F.avg((a < lo).cast("int"))).alias("below_pct"),
        (100 * F.avg((a > hi).cast("int"))).alias("above_pct"),
    ])


def pinball(actual: str | Column, predicted: str | Column, q: float) -> Column:
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.greatest(q * (a - p), (q - 1) * (a - p))


def tail_coverage(scored: DataFrame, over_sec: int = 3600, without: tuple[str, ...] = ()) -> DataFrame:
    """Coverage of the delays beyond `over_sec`, with and without some stations."""
    late = scored.where(
        F.col("score_state").isin("scored") & (F.col("actual_delay_sec") > over_sec)
    )
    outside = ~F.col("location_code").isin(*without) if without else F.lit(True)
    return late.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("interval_hit")).alias("covered_all"),
        F.count_if(outside).alias("n_without"),
        F.count_if(outside & F.col("interval_hit")).alias("covered_without"),
    )


def delay_density(stops: DataFrame, reach: int = 60, quantum: int = 6) -> DataFrame:
    """Count at each delay against the mean of its reachable neighbours within `reach`.

    Works on one row per distinct delay, so its window is over at most a day of values.
    """
    counts = stops.where(F.col("delay_sec").isNotNull()).groupBy("delay_sec").count()
    offsets = [o for o in range(-reach, reach + 1, quantum) if o]
    near = counts.select(
        F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"), "delay_sec", "count"
    ).select((F.col("delay_sec") + F.col("_o")).alias("delay_sec"), F.col("count").alias("_c"))
    base = near.groupBy("delay_sec").agg((F.sum("_c") / len(offsets)).alias("neighbour_mean"))
    return counts.join(base, "delay_sec", "left").select(
        "delay_sec", F.col("count").alias("n"), "neighbour_mean",
        F.try_divide(F.col("count"), F.col("neighbour_mean")).alias("spike_ratio"),
    )


def station_quality(stops: DataFrame) -> DataFrame:
    """Label quality per station on machine-captured arrivals, before and after refusal of
    inconsistent journeys."""
    d = stops.where((F.col("auto_arrival") == "1") & F.col("delay_sec").isNotNull())
    both = d.withColumn("_part", F.explode(F.when(
        F.col("consistent"), F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))))
    return both.groupBy("location_code", F.col("_part").alias("refusal")).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("delay_sec", 0.5).alias("median_sec"),
        F.percentile("delay_sec", 0.9).alias("q90_sec"),
        F.max("delay_sec").alias("max_sec"),
        (100 * F.avg((F.abs("delay_sec") <= 1800).cast("int"))).alias("within_30_min_pct"),
    )
