"""Station boards, calling patterns, station names and which day's run is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times, values
from .journeys import JOURNEY
from .ordered import Track, count_of, first_by, running

NOT_DUE = 999


def board(entries: DataFrame, keys: list[str], limit: int, tie: list[str]) -> DataFrame:
    """What to do with each entry: predict the first `limit` departed trains by minutes due,
    leave the other departed ones, list the rest.

    The chosen rows are found first (at most `limit` per board leave each map task), so a
    crowded board is never ranked whole in one task.
    """
    due = entries.withColumn("due_min", F.coalesce("due_min", F.lit(NOT_DUE)))
    gone = due.where(F.col("scope") == "departed")
    w = Window.partitionBy(*keys).orderBy("due_min", *tie)
    chosen = gone.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    flags = chosen.select(*keys, *tie, F.col("_n").alias("position"))
    return due.join(flags, [*keys, *tie], "left").withColumn(
        "action",
        F.when(F.col("scope") != "departed", "not_yet_departed")
        .when(F.col("position").isNull(), "not_asked").otherwise("predict"),
    )


def calling_pattern(stops: DataFrame, t: Track, here: Column, vantage: Column) -> DataFrame:
    """A journey as its passengers see it: timing points go, unless asked about or the
    vantage. One row per stop; the position counts the stops kept."""
    kept = stops.where((F.col("location_type") != "T") | here | vantage)
    placed = running(kept, t, {"position": count_of()})
    calls = F.coalesce(*[
        F.when(F.col("location_type") == k, v) for k, v in values.CALLS_AS.items()
    ], F.lit("calls here"))
    return placed.select(
        *JOURNEY, F.col("position").cast("int").alias("position"), F.col("location_code").alias("code"),
        F.coalesce(F.nullif("location_name", F.lit("")), "location_code").alias("name"),
        F.substring(times.board_time("location_type", "sched_arr_text", "sched_dep_text"), 1, 5).alias("scheduled"),
        F.when(F.col("arr_sec").isNotNull(), F.substring(times.clock_text("arr_sec"), 1, 5)).alias("arrived"),
        here.alias("here"), (F.col("location_type") == "T").alias("passes"), calls.alias("calls_as"),
    )


def picker(stations: DataFrame) -> DataFrame:
    """One entry per station name, the rest as aliases; polled and known codes first."""
    w = Window.partitionBy("name").orderBy(F.desc("polled"), F.desc("model_known"), "code")
    ranked = stations.withColumn("_n", F.row_number().over(w))
    first = ranked.where("_n = 1").drop("_n")
    rest = ranked.where("_n > 1").groupBy("name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "code"))), lambda x: x["code"]), ",").alias("aliases"))
    return first.join(rest, "name", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


def alias_stop(requests: DataFrame, stops: DataFrame, stations: DataFrame) -> DataFrame:
    """The stop to answer for: the code asked about, else another code of the same name.

    Codes meet through the name they share, so no table of code pairs is built.
    """
    names = stations.select("code", "name")
    asked = requests.join(names.withColumnsRenamed({"code": "location_code"}), "location_code", "left")
    called = stops.select(*JOURNEY, F.col("location_code").alias("called_code"), "location_order").join(
        names.withColumnsRenamed({"code": "called_code"}), "called_code")
    met = asked.join(called, [*JOURNEY, "name"], "left")
    own = F.col("called_code") == F.col("location_code")
    return first_by(met, [*JOURNEY, "location_code"], [F.desc_nulls_last(own), "called_code", "location_order"]).select(
        *JOURNEY, "location_code", "called_code", F.coalesce(~own, F.lit(False)).alias("by_alias"))


def run_summary(stops: DataFrame) -> DataFrame:
    """Per run: has it reported anywhere, has it reached its last stop."""
    return stops.groupBy(*JOURNEY).agg(
        F.bool_or(F.col("arr_sec").isNotNull()).alias("started"),
        F.max_by(F.col("arr_sec").isNotNull(), "location_order").alias("finished"),
    )


def current_run(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """Today's run, or yesterday's still under way: only shortly after midnight, only when
    today's has reported nothing, yesterday's has, and it has not reached its last stop.

    `asked` carries train_code, today (date) and wall_sec.
    """
    now = runs.select(F.col("service_date").alias("today"), "train_code", F.col("started").alias("today_started"))
    then = runs.select(
        F.date_add("service_date", 1).alias("today"), "train_code",
        F.col("started").alias("then_started"), F.col("finished").alias("then_finished"))
    met = asked.join(now, ["today", "train_code"], "left").join(then, ["today", "train_code"], "left")
    back = (
        (F.col("wall_sec") < times.ROLLOVER_SEC) & ~F.coalesce("today_started", F.lit(False))
        & F.coalesce("then_started", F.lit(False)) & ~F.coalesce("then_finished", F.lit(True))
    )
    return met.select(*asked.columns, F.when(back, F.date_sub("today", 1)).otherwise(F.col("today")).alias("service_date"))


def find_station(lookups: DataFrame, stations: DataFrame) -> DataFrame:
    """The code whose name equals the text, if only one does; else the only one it begins.

    Names are indexed by their prefixes, so both tests are equalities.
    """
    names = stations.select("code", F.lower("name").alias("_name"))
    heads = names.withColumn("_head", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("_name")), lambda i: F.substring(F.col("_name"), F.lit(1), i))))
    q = lookups.select("lookup").distinct().withColumn("_q", F.lower(times.trimmed("lookup")))
    met = q.join(heads, q["_q"] == heads["_head"], "left")
    exact = F.col("_name") == F.col("_q")
    return met.groupBy("lookup").agg(
        F.count_if(exact).alias("n_exact"), F.count("code").alias("n_prefix"),
        F.max(F.when(exact, F.col("code"))).alias("_e"), F.max("code").alias("_p"),
    ).select("lookup", F.when(F.col("n_exact") == 1, F.col("_e")).when(F.col("n_prefix") == 1, F.col("_p")).otherwise("").alias("code"))


def station_config(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Configured stations with their group. A code the station list lacks is an error."""
    keyed = groups.withColumn("code", times.key("code"))
    unknown = keyed.join(known.select("code"), "code", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError("unknown station codes: " + ", ".join(f"{r['code']} (in {r['station_group']})" for r in unknown))
    return first_by(keyed, ["code"], ["station_group"]).join(known, "code")
