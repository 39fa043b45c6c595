"""Drift watch, champion against challenger, and the paired bootstrap behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
OVERALL_FLOOR_PCT, GROUP_FLOOR_PCT = 75.0, 70.0
GROUP_MIN_EVENTS = 200
SUSTAINED_DAYS = 7
VETO_MIN_ROWS = 1100
REPLICATES = 10_000


def daily_hits(scored: DataFrame) -> DataFrame:
    """Hits and rows per date, overall (`station_group` null) and per group."""
    clean = scored.where((F.col("score_state") == "scored") & F.col("interval_hit").isNotNull())
    named = clean.withColumn("station_group", F.coalesce("station_group", F.lit("(unpolled)")))
    return named.groupingSets(
        [["service_date"], ["service_date", "station_group"]], "service_date", "station_group"
    ).agg(F.count_if("interval_hit").alias("hits"), F.count(F.lit(1)).alias("n"))


def coverage_trigger(daily: DataFrame, days: int = 7, sustained: int = SUSTAINED_DAYS,
                     group_min: int = GROUP_MIN_EVENTS) -> DataFrame:
    """Rolling coverage per scope and date, whether it is below its floor, and whether it
    has been for `sustained` consecutive dates. Runs on one row per scope and date."""
    d = daily.withColumn("_day", F.unix_date("service_date"))
    w = Window.partitionBy("station_group").orderBy("_day").rangeBetween(-(days - 1), 0)
    roll = d.withColumns({"roll_hits": F.sum("hits").over(w), "roll_n": F.sum("n").over(w)})
    pct = 100 * F.col("roll_hits") / F.col("roll_n")
    below = F.when(F.col("station_group").isNull(), pct < OVERALL_FLOOR_PCT).otherwise(
        (pct < GROUP_FLOOR_PCT) & (F.col("roll_n") >= group_min)
    )
    roll = roll.withColumns({"roll_coverage_pct": pct, "below": below})
    seq = Window.partitionBy("station_group").orderBy("_day")
    marked = roll.withColumn("_island", F.sum((~F.col("below")).cast("int")).over(seq))
    run = Window.partitionBy("station_group", "_island").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    streak = marked.withColumn("days_below", F.sum(F.col("below").cast("int")).over(run))
    return streak.select(
        "service_date", "station_group", "roll_hits", "roll_n", "roll_coverage_pct", "below",
        "days_below", (F.col("days_below") >= sustained).alias("sustained"),
    )


def bootstrap(units: DataFrame, diff: str, reps: int = REPLICATES, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Paired bootstrap of the mean of `diff`, resampling whole units with replacement.

    `units` has one row per unit (a day), already aggregated, so a group is an array of its
    days. Which days a replicate draws depends on the seed, the replicate and the number of
    days alone: how often each is drawn is worked out once per group size in a task, and a
    group's replicate means are that table times its array. One exchange, whatever `reps`.

    Draw `i` of replicate `r` is the first 32 bits of md5("seed|r|i") modulo the size, so any
    engine can repeat them.
    """
    days = units.where(F.col(diff).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("unit", F.col(diff).cast("double").alias("d")))).alias("u"))
    rows = days.where(F.size("u") > 0).select(*by, F.transform("u", lambda x: x["d"]).alias("u"))
    kept = [rows.schema[c] for c in by]
    schema = T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in ("point", "lo", "hi")), T.StructField("n_units", T.LongType())])

    def resampled(batches):
        """Local, so it travels to the workers by value."""
        import hashlib

        import numpy as np
        import pyarrow as pa

        most, drawn, times_drawn = 4_000_000, {}, {}

        def numbers(i: int) -> np.ndarray:
            if i not in drawn:
                drawn[i] = np.fromiter((int.from_bytes(hashlib.md5(f"{seed}|{r}|{i}".encode()).digest()[:4]) for r in range(reps)), dtype=np.int64, count=reps)
            return drawn[i]

        def weights(size: int, lo: int, hi: int) -> np.ndarray:
            picks = np.stack([numbers(i)[lo:hi] % size for i in range(size)], axis=1)
            flat = (np.arange(hi - lo)[:, None] * size + picks).ravel()
            return np.bincount(flat, minlength=(hi - lo) * size).reshape(hi - lo, size)

        def means(d: np.ndarray) -> np.ndarray:
            size, step = len(d), max(1, most // len(d))
            if step < reps:
                return np.concatenate([weights(size, lo, min(reps, lo + step)) @ d / size for lo in range(0, reps, step)])
            if size not in times_drawn:
                if sum(w.size for w in times_drawn.values()) > 4 * most:
                    times_drawn.clear()
                times_drawn[size] = weights(size, 0, reps).astype(float)
            return times_drawn[size] @ d / size

        def percentile(ranked: np.ndarray, share: float) -> float:
            """As numpy's, of values that stand in their places."""
            place = (reps - 1) * share
            low, high = ranked[int(place)], ranked[min(int(place) + 1, reps - 1)]
            t = place - int(place)
            return float(high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t)

        # Only the ranks beside the two percentiles are put in place, which is several times faster than `np.percentile`.
        ranks = sorted({min(int((reps - 1) * share) + k, reps - 1) for share in (0.025, 0.975) for k in (0, 1)})

        for b in batches:
            out = []
            for u in b.column(b.num_columns - 1):
                d = np.array(u.as_py(), dtype=float)
                m = np.partition(means(d), ranks)
                lo, hi = percentile(m, 0.025), percentile(m, 0.975)
                out.append((float(d.mean()), float(lo), float(hi), len(d)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, [pa.float64()] * 3 + [pa.int64()]))], names=[*by, "point", "lo", "hi", "n_units"])

    return rows.mapInArrow(resampled, schema).withColumn("significant", F.col("hi") < 0)


def promotion_gate(rows: DataFrame, by: str, champion: Column, challenger: Column, unit: str,
                   reps: int = REPLICATES, seed: int = 0, min_rows: int = VETO_MIN_ROWS,
                   hits: tuple[Column, Column] | None = None) -> DataFrame:
    """Overall (`by` null) and per group: challenger minus champion, in error (`metric` is
    `error`) and, with the two sides' `hits`, in points of coverage. May it veto, and does it?

    A side is worse only when its whole interval is: more error, or less coverage. The whole
    can always veto, a group only with enough rows. `unit` is what is resampled, a day.
    """
    measures = {"error": (challenger - champion, 1)}
    if hits is not None:
        measures["coverage"] = (100 * (hits[1].cast("int") - hits[0].cast("int")), -1)
    named = rows.select(F.col(by).alias(by), F.col(unit).alias("unit"), *(c.cast("double").alias(f"m_{n}") for n, (c, _) in measures.items()))
    named = named.withColumn(by, F.coalesce(F.col(by), F.lit("(none)")))
    daily = named.groupingSets([["unit"], ["unit", by]], "unit", by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"m_{n}").alias(n) for n in measures))
    tall = daily.unpivot(["unit", by, "n"], list(measures), "metric", "diff")
    counts = daily.groupBy(by).agg(F.sum("n").alias("n")).withColumnRenamed(by, "_by")
    ci = bootstrap(tall, "diff", reps, seed, by=("metric", by))
    worse = F.when(F.col("metric") == "coverage", F.col("hi") < 0).otherwise(F.col("lo") > 0)
    able = F.col(by).isNull() | (F.col("n") >= min_rows)
    return ci.join(counts, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumns({"worse": worse, "can_veto": able, "veto": worse & able})


def monthly_drift(scored: DataFrame) -> DataFrame:
    """Late and early miss shares, share over 15 minutes late, median and mean residual."""
    clean = scored.where(F.col("score_state") == "scored")
    a, res = F.col("actual_delay_sec"), F.col("actual_delay_sec") - F.col("q50_sec")
    return clean.groupBy(F.date_format("service_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg((a < F.col("q10_sec")).cast("int"))).alias("early_miss_pct"),
        (100 * F.avg((a > F.col("q90_sec")).cast("int"))).alias("late_miss_pct"),
        (100 * F.avg((a > 900).cast("int"))).alias("over_15_min_late_pct"),
        F.percentile(res, 0.5).alias("median_residual_sec"),
        F.avg(res).alias("mean_residual_sec"),
    )
