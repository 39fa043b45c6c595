"""The schedule-adherence tables as views over the given `events` table.

A journey is one user over a six-day block, its clock compressed so that every block starts
at 20:00 and its later part crosses midnight. Every row of `events` becomes one stop record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import times
from .operators.journeys import JOURNEY, PIECE
from .operators.ordered import Track, count_of, latest_before, running, track

POLL_LEADS = (3000, 1500, 1200, 200)
PREDICTION_LEADS = (1400, 1100, 400)

_TRACKS: dict[tuple, Track] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts") - 1
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    blk = F.floor(day / 6).cast("int")
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select(
        "event_id", "event_type",
        F.date_add(F.lit("2024-01-01").cast("date"), (6 * blk).cast("int")).alias("service_date"),
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("train_code"),
        (day % 6 * 86400 + clock).cast("int").alias("blk_sec"),
        k.alias("k"),
        F.when(k % 20 == 0, 0).otherwise(6 * (F.floor(F.col("value") / 2).cast("int") - 10)).alias("d"),
    )


def event_track(spark: SparkSession, sf_dir: str) -> Track:
    """The journey track of these tables; the longest journey is counted once per session."""
    limit = spark.conf.get("timekeel.maxGroupRows", "")
    memo = (spark.sparkContext.applicationId, sf_dir, limit)
    if memo not in _TRACKS:
        rows = _stop_rows(spark, sf_dir)
        _TRACKS[memo] = track(rows, JOURNEY, ("location_order",), PIECE)
    return _TRACKS[memo]


def movements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Track]:
    t = event_track(spark, sf_dir)
    rows = running(
        _stop_rows(spark, sf_dir),
        t.ordered("blk_sec", "event_id", piece="blk_sec div 3600"),
        {"location_order": count_of()},
    )
    sched = F.lit(72000) + 6 * F.floor(F.col("blk_sec") / 120).cast("int")
    k = F.col("k")
    return rows.select(
        "service_date", "train_code",
        F.col("location_order").cast("int").alias("location_order"),
        F.concat(F.lit("S"), (k % 20).cast("string")).alias("location_code"),
        F.col("event_type").alias("station_group"),
        (sched % 86400).alias("sched_sec"),
        F.when(k % 7 != 0, (sched + F.col("d")) % 86400).alias("arr_sec"),
        F.when(k % 7 == 0, "").when(k % 10 == 0, "0").otherwise("1").alias("auto_arrival"),
    ), t


def _late_clock(c: str):
    """The views' own unwrap: blocks start at 20:00, so earlier clocks are the next day."""
    return F.col(c) + F.when(F.col(c) < 72000, 86400).otherwise(0)


def polls(moves: DataFrame) -> DataFrame:
    even = moves.where(F.col("location_order") % 2 == 0)
    each = even.withColumn("lead", F.explode(F.array(*[F.lit(x) for x in POLL_LEADS])))
    gap = F.coalesce(times.delay("arr_sec", "sched_sec"), F.lit(0))
    eta = _late_clock("sched_sec") + gap - F.floor(F.col("lead") / 10)
    return each.select(
        *JOURNEY, "location_code", "location_order", "station_group",
        (_late_clock("sched_sec") - F.col("lead")).alias("poll_sec"),
        (F.floor(eta / 60).cast("int") * 60 % 86400).alias("eta_sec"),
    )


def predictions(moves: DataFrame, t: Track) -> DataFrame:
    d = moves.withColumn("delay", times.delay("arr_sec", "sched_sec"))
    cur = running(d, t, {"cur": latest_before(F.col("delay"))})
    each = cur.withColumn("lead_sec", F.explode(F.array(*[F.lit(x) for x in PREDICTION_LEADS])))
    c = F.col("cur")
    return each.select(
        *JOURNEY, "location_code", "location_order", "station_group",
        (_late_clock("sched_sec") - F.col("lead_sec")).alias("made_sec"),
        "lead_sec",
        F.when(c.isNull(), "declined").otherwise("predicted").alias("outcome"),
        (c - 60).alias("q10_sec"),
        c.alias("q50_sec"),
        (c + 60 + F.floor(F.col("lead_sec") / 10).cast("int")).alias("q90_sec"),
    )


SIDES = (("local", 0, 11), ("cloud", 85, 13))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collectors' board captures: each event is on three boards running, five minutes
    apart, and each collector misses some."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    side = F.array(*[
        F.struct(F.lit(n).alias("side"), F.lit(lag).alias("lag"), F.lit(miss).alias("miss"))
        for n, lag, miss in SIDES
    ])
    rows = e.select(
        "event_id", "user_id", "event_type", "value", k.alias("k"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        F.explode(side).alias("s"),
    ).where(F.col("k") % F.col("s.miss") != 0)
    seen = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    early = F.when((F.col("s.side") == "cloud") & (F.col("k") % 3 == 0), 1).otherwise(0)
    return seen.select(
        F.col("s.side").alias("side"),
        (F.floor(F.col("t") / 300) * 300 + F.col("c") * 300 + F.col("s.lag")).alias("cycle_sec"),
        F.timestamp_seconds("t").cast("date").alias("service_date"),
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("train_code"),
        F.concat(F.lit("S"), (F.col("k") % 20).cast("string")).alias("station_code"),
        F.col("event_type").alias("station_group"),
        F.floor((F.col("value") + (F.col("c") + early) * 7) / 10).cast("int").alias("eta"),
        "event_id", "k",
    )


# Names of the views' stations, by number; several numbers share one name.
STATION_NAMES = (
    "Cork Kent", "Ballinasloe", "Ennis", "Enniscorthy", "Westport", "Dublin Heuston", "Dublin Heuston",
    "Carrick-on-Suir", "Dún Laoghaire", "Athlone", "Ballina", "Bray", "Bray", "Bray", "Mallow",
    "Thurles", "Rosslare Strand", "Galway", "Tralee", "Maynooth",
)


def stations(moves: DataFrame) -> DataFrame:
    """The stations the journeys call at, with a name, a grid position and a place."""
    n = F.substring("location_code", 2, 9).cast("int")
    names = F.array(*[F.lit(x) for x in STATION_NAMES])
    return moves.select("location_code").distinct().select(
        F.col("location_code").alias("code"),
        F.element_at(names, n + 1).alias("name"),
        (n * 79 % 20 * 15000 + 500000).alias("x"),
        (n * 47 % 20 * 20000 + 550000).alias("y"),
        F.when(n == 7, 0.0).otherwise(51.6 + (n * 37 % 20) * 0.18).alias("lat"),
        F.when(n == 7, 0.0).otherwise(-10.0 + (n * 53 % 20) * 0.2).alias("lon"),
        (~n.isin(7, 13)).alias("placed"),
    )


def named_movements(moves: DataFrame) -> DataFrame:
    """Movements with a name and a type, some names blank or spelled another way."""
    n = F.substring("location_code", 2, 9).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in STATION_NAMES]), n + 1)
    o = F.col("location_order")
    return moves.withColumns({
        "location_name": F.when(o % 13 == 0, "").when(o % 7 == 0, F.upper(name)).otherwise(name),
        "location_type": F.when(o == 1, "O").when(n.isin(5, 10, 15), "T").when(n == 19, "D").otherwise("S"),
    })


def live_rows(moves: DataFrame) -> DataFrame:
    """Polls as a live log holds them: some about other stations, trains or dates."""
    p = polls(moves)
    o = F.col("location_order")
    return p.select(
        F.when(o % 18 == 0, F.date_add("service_date", 1)).otherwise(F.col("service_date")).alias("service_date"),
        F.when(o % 14 == 0, F.concat(F.lit("N"), F.col("train_code"))).otherwise(F.col("train_code")).alias("train_code"),
        F.when(o % 10 == 0, "S99").otherwise(F.col("location_code")).alias("location_code"),
        "station_group", "poll_sec", "location_order",
        F.when(F.col("eta_sec") % 7 != 0, F.col("eta_sec")).alias("eta_sec"),
    )


def scenario_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user and day over five stops, its times set by that day's first event.

    Some days miss a stop, a time or a machine-captured flag, or go back in time.
    """
    e = table(spark, sf_dir, "events")
    k0 = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    first = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.min(F.struct("event_id", k0.alias("k"), F.floor("value").cast("int").alias("v"))).alias("f"))
    base = first.select("user_id", "day", F.col("f.k").alias("k"), F.col("f.v").alias("v"))
    stop = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    i, k, v = F.col("i"), F.col("k"), F.col("v")
    stop = stop.where(~((k % 29 == 0) & (i == 3)))

    def lag_of(n):
        return 6 * ((k * (n + 3) + v) % 25) - 60

    late = 6 * (k % 11) + sum(F.when(i >= n, lag_of(F.lit(n))).otherwise(0) for n in range(1, 5))
    sched_arr = F.when(i > 0, 36000 + 600 * i)
    arr = F.when((i > 0) & ~((k % 31 == 0) & (i == 1)),
                 36000 + 600 * i + late - F.when((k % 37 == 0) & (i == 1), 3000).otherwise(0))
    return stop.select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("train_code"), "day",
        (i + 1).alias("stop_order"),
        F.concat(F.lit("S"), ((F.col("user_id") + i) % 20).cast("string")).alias("location_code"),
        F.element_at(F.array(*[F.lit(x) for x in "OSTSD"]), i + 1).alias("location_type"),
        sched_arr.alias("sched_arr_sec"), (36060 + 600 * i).alias("sched_dep_sec"),
        arr.alias("arr_sec"), (36060 + 600 * i + late).alias("dep_sec"),
        (arr - sched_arr).alias("arr_delay_sec"), late.alias("dep_delay_sec"),
        F.when((k + i) % 23 == 0, "0").otherwise("1").alias("auto_arr"),
        F.when((k + 2 * i) % 23 == 0, "0").otherwise("1").alias("auto_dep"),
    )


def placed_stops(moves: DataFrame) -> DataFrame:
    """Movements marked with whether their station has a usable place."""
    n = F.substring("location_code", 2, 9).cast("int")
    return moves.withColumn("placed", ~n.isin(7, 13))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet's last reports: one per event, near a station, some without a position."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    n = k % 20
    return e.select(
        F.col("event_id").alias("point_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit(" ")).alias("train"),
        F.when(F.col("event_type") == "view", "R").when(F.col("event_type") == "error", "T").otherwise("N").alias("status"),
        F.when(n == 7, 0.0).otherwise(51.6 + (n * 37 % 20) * 0.18 + (F.col("event_id") % 9 - 4) * 0.0007).alias("lat"),
        F.when(n == 7, 0.0).otherwise(-10.0 + (n * 53 % 20) * 0.2 + (k % 7 - 3) * 0.0011).alias("lon"),
        F.concat(
            F.when(k % 4 != 0, F.concat(F.upper(F.concat(F.lit("t"), F.col("user_id").cast("string"))), F.lit("\\\\n"))).otherwise(""),
            F.when(k % 3 == 0, "Departed S1 next stop S2").when(k % 3 == 1, "Arrived S3 next stop S4").otherwise("No report"),
            F.when(k % 5 == 0, F.lit("\\nlate")).otherwise(""),
        ).alias("message"),
        k.alias("k"),
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed ring per supplier nation, its suppliers as vertices."""
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_nationkey")
    x = n % 5 * 4000 + F.floor(F.col("s_acctbal")).cast("int") % 5000
    y = F.floor(n / 5).cast("int") * 4000 + (F.col("s_suppkey") * 911 % 5000).cast("int")
    v = s.select(n.alias("ring_id"), "s_suppkey", x.alias("x"), y.alias("y"))
    t = Track(("ring_id",), ("s_suppkey",), "s_suppkey div 100000")
    return running(v, t, {"n": count_of()}).select("ring_id", (F.col("n") - 1).alias("seq"), "x", "y")


def field_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("point_id"),
        (F.col("event_id") * 7919 % 24000).cast("int").alias("x"), (F.col("event_id") * 104729 % 24000 + F.col("user_id") % 7).cast("int").alias("y"))
