"""Complete-day scenarios per train, their buffers, and the evaluation of given buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times, values
from ..session import settle
from .drift import bootstrap
from .journeys import lateness
from .ordered import Track, count_of, latest_before, neighbours, running, track

# Fixed values.
MIN_DAYS = 15
MIN_STOPS = 3
MAX_RUN_SEC = 7200
RUN_PERCENTILE = 0.05
HOLDOUT = 0.5
MIN_SEGMENT_ROWS = 30
DAY = ("train_code", "day")


def day_track(stops: DataFrame) -> Track:
    """The track of (train, day) runs, after a check of the longest."""
    return track(stops, DAY, ("stop_order",), "stop_order div 1024")


def _pairs(stops: DataFrame, t: Track) -> DataFrame:
    """Passenger stops in order, each with the stop before it."""
    seq = running(stops.where(F.col("location_type").isin(*values.PASSENGER_TYPES)), t, {"seq": count_of()})
    return neighbours(seq.withColumn("seq", F.col("seq").cast("int")), t, "seq", {
        "from_code": ("location_code", -1), "from_dep": ("dep_sec", -1),
        "from_auto": ("auto_dep", -1), "from_sched_dep": ("sched_dep_sec", -1),
    })


def classified_days(stops: DataFrame, t: Track) -> tuple[DataFrame, DataFrame]:
    """(segments, days): each (train, day) with why it is not a scenario, null when it is.

    The stopping pattern is compared with the first eligible day's stop by stop, by an
    equality join on (train, position), and combined per day with partial aggregation. The
    segments and the days, read by each of these steps, are written once.
    """
    at = stops.withColumn("_at", F.col("sched_arr_sec") + F.col("arr_delay_sec"))
    back = running(at, t, {"_prev": latest_before(F.col("_at"))})
    sound = back.groupBy(*DAY).agg(
        F.bool_and(F.coalesce(F.col("_at") >= F.col("_prev"), F.lit(True))).alias("consistent"))
    seg = settle(_pairs(stops, t), "segments")
    sizes = seg.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n_stops"))
    days = settle(sound.join(sizes, list(DAY), "left").withColumn("n_stops", F.coalesce("n_stops", F.lit(0))), "days")
    first = days.where(F.col("consistent") & (F.col("n_stops") >= MIN_STOPS)).groupBy("train_code").agg(
        F.min(F.struct("day", "n_stops")).alias("_f")
    ).select("train_code", F.col("_f.day").alias("day"), F.col("_f.n_stops").alias("ref_stops"))
    ref = seg.join(first, list(DAY)).select(
        "train_code", "seq", F.col("location_code").alias("ref_code"),
        times.forward_gap("from_sched_dep", "sched_arr_sec").alias("sched_run"))
    run = times.forward_gap("from_dep", "arr_sec")
    usable = (run > 0) & (run < MAX_RUN_SEC) & (F.col("from_auto") == "1") & (F.col("auto_arr") == "1")
    judged = seg.join(ref, ["train_code", "seq"], "left").withColumns({
        "run_sec": run,
        "_same": F.coalesce(F.col("location_code") == F.col("ref_code"), F.lit(False)),
        "_ok": F.when(F.col("seq") == 1, True).otherwise(F.coalesce(usable, F.lit(False))),
    })
    shape = judged.groupBy(*DAY).agg(F.bool_and("_same").alias("same"), F.bool_and("_ok").alias("complete"))
    out = (
        days.join(shape, list(DAY), "left").join(first.select("train_code", "ref_stops"), "train_code", "left")
        .withColumn(
            "drop_reason",
            F.when(~F.col("consistent"), "inconsistent_journey")
            .when(F.col("n_stops") < MIN_STOPS, "too_few_stops")
            .when(~F.col("same") | (F.col("n_stops") != F.col("ref_stops")), "different_stopping_pattern")
            .when(~F.col("complete"), "incomplete_or_unverified_run"),
        )
    )
    return judged, out.select(*DAY, "n_stops", "drop_reason")


def instances(stops: DataFrame, t: Track, min_days: int = MIN_DAYS) -> DataFrame:
    """Segments of the complete days of trains with at least `min_days` of them.

    Per (train, segment): scheduled run, minimum run, existing buffer; per day: primary delay
    and the lateness the train started with. Trains with a segment scheduled at no time go.
    The segments of complete days, read twice, are written once.
    """
    judged, days = classified_days(stops, t)
    good = days.where(F.col("drop_reason").isNull()).select(*DAY)
    start = judged.where("seq = 1").select(*DAY, F.coalesce("dep_delay_sec", F.lit(0)).alias("start_late"))
    rows = settle(judged.where("seq > 1").join(good, list(DAY), "left_semi").select(
        *DAY, "seq", "from_code", "location_code", "run_sec", "sched_run"), "runs")
    per = rows.groupBy("train_code", "seq").agg(
        F.percentile("run_sec", RUN_PERCENTILE).alias("p5"), F.count(F.lit(1)).alias("n_days"),
        F.max("sched_run").alias("sched_run"),
    )
    fit = per.groupBy("train_code").agg(
        F.min("n_days").alias("_d"), F.min(F.coalesce("sched_run", F.lit(-1))).alias("_r"), F.max("seq").alias("last_seq"))
    per = per.join(fit.where((F.col("_d") >= min_days) & (F.col("_r") > 0)), "train_code").withColumns({
        "infeasible": F.col("p5") > F.col("sched_run"),
        "min_run": F.least("p5", "sched_run"),
    }).withColumn("buffer", F.col("sched_run") - F.col("min_run")).drop("_d", "_r")
    return (
        rows.drop("sched_run").join(per, ["train_code", "seq"])
        .withColumn("primary_delay", F.greatest(F.lit(0.0), F.col("run_sec") - F.col("min_run")))
        .join(start, list(DAY))
    )


def summary(inst: DataFrame) -> DataFrame:
    per = inst.groupBy("train_code", "seq").agg(
        F.first("infeasible").alias("infeasible"), F.first("buffer").alias("buffer"), F.first("n_days").alias("n_days"))
    return per.groupBy("train_code").agg(
        F.count(F.lit(1)).alias("segments"), F.max("n_days").alias("days"), F.sum("buffer").alias("total_buffer"),
        F.count_if("infeasible").alias("infeasible_segments"))


def with_hold_out(inst: DataFrame, holdout: float = HOLDOUT) -> DataFrame:
    """Marks the later days of each train as held out, by day rank over distinct days."""
    days = inst.select(*DAY).distinct()
    w = Window.partitionBy("train_code")
    ranked = days.withColumns({
        "_i": F.row_number().over(w.orderBy("day")), "_s": F.count(F.lit(1)).over(w)})
    cut = F.floor(F.col("_s") * (1 - holdout))
    return inst.join(ranked.select(*DAY, (F.col("_i") > cut).alias("held_out")), list(DAY))


def day_costs(inst: DataFrame, candidates: dict[str, Column], long: bool = False) -> DataFrame:
    """Lateness replayed under each candidate buffer: cost at the terminus and in total.

    Candidates are columns over the segment; they are stacked on its row, not cross-joined.
    `long` is the day track's verdict.
    """
    stacked = inst.withColumn("_c", F.explode(F.array(*[
        F.struct(F.lit(n).alias("candidate"), c.cast("double").alias("b")) for n, c in candidates.items()
    ]))).select("*", "_c.candidate", "_c.b").drop("_c")
    t = Track((*DAY, "candidate"), ("seq",), "seq div 1024", long)
    late = lateness(stacked, t, F.col("primary_delay"), F.col("b"), F.col("start_late").cast("double"))
    keys = [*DAY, "candidate"] + (["held_out"] if "held_out" in inst.columns else [])
    return late.groupBy(*keys).agg(
        F.sum(F.when(F.col("seq") == F.col("last_seq"), F.col("late_sec"))).alias("terminus"),
        F.sum("late_sec").alias("uniform"),
    )


def sweep(inst: DataFrame, candidates: dict[str, Column], base: str, reps: int, seed: int = 0,
          long: bool = False) -> DataFrame:
    """Held-out mean cost of each candidate against the timetable's own, by weighting, with a
    paired bootstrap over days.

    Day costs, one row per (train, day, candidate), are written once: the comparison and
    the bootstrap read them several times.
    """
    costs = settle(day_costs(with_hold_out(inst), candidates, long).where("held_out"), "costs")
    tall = costs.unpivot([*DAY, "candidate"], ["terminus", "uniform"], "weighting", "cost")
    ours = tall.where(F.col("candidate") != base)
    own = tall.where(F.col("candidate") == base).select(*DAY, "weighting", F.col("cost").alias("base_cost"))
    met = ours.join(own, [*DAY, "weighting"])
    by = ("train_code", "candidate", "weighting")
    means = met.groupBy(*by).agg(F.avg("cost").alias("held_out_cost"), F.avg("base_cost").alias("base_cost"))
    units = met.select(*by, F.col("day").alias("unit"), (F.col("cost") - F.col("base_cost")).alias("diff"))
    return means.join(bootstrap(units, "diff", reps, seed, by=by), list(by))


def deviation(inst: DataFrame, candidates: dict[str, Column], base: str, cap: Column) -> DataFrame:
    """Per train and candidate: total shift from the timetable's buffers, caps that bind."""
    per = inst.groupBy("train_code", "seq").agg(*[
        F.first(c).alias(c) for c in ("buffer", "min_run", "sched_run", "last_seq")])
    stacked = per.withColumn("_c", F.explode(F.array(*[
        F.struct(F.lit(n).alias("candidate"), c.cast("double").alias("b"), candidates[base].cast("double").alias("b0"))
        for n, c in candidates.items()])))
    return stacked.groupBy("train_code", F.col("_c.candidate").alias("candidate")).agg(
        F.sum(F.abs(F.col("_c.b") - F.col("_c.b0"))).alias("shift"),
        F.count_if(F.col("_c.b") > cap - 1e-6).alias("caps_binding"),
    )


def segment_slack(stops: DataFrame, t: Track, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """Scheduled minus 5th-percentile observed run per (from, to) with enough observations."""
    seg = _pairs(stops, t).where("seq > 1")
    run = times.forward_gap("from_dep", "arr_sec")
    ok = seg.where((run > 0) & (run < MAX_RUN_SEC) & (F.col("from_auto") == "1") & (F.col("auto_arr") == "1"))
    per = ok.groupBy("from_code", F.col("location_code").alias("to_code")).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(times.forward_gap("from_sched_dep", "sched_arr_sec"), 0.5).alias("sched_run"),
        F.percentile(run, RUN_PERCENTILE).alias("p5_run"),
    ).where(F.col("n") >= min_rows)
    return per.withColumn("slack", F.col("sched_run") - F.col("p5_run")).withColumn("negative", F.col("slack") < 0)
