"""Label and join audits: echo rates, match rates, usability, reasons, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times, values
from .ordered import first_by

# Fixed values.
MIN_COMPARABLE = 30
THIN_EVENTS = 200
MATCH_THRESHOLD_PCT = 95.0
LIVE_EVENT = ("service_date", "train_code", "location_code")


def echo_counts(stops: DataFrame, keys: list[str]) -> DataFrame:
    """Records, arrivals, comparable arrivals and exact matches."""
    a, s = F.col("arr_sec"), F.col("sched_sec")
    return stops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.count("arr_sec").alias("arrivals"),
        F.count_if(a.isNotNull() & s.isNotNull()).alias("comparable"),
        F.count_if(a == s).alias("exact"),
    )


def most_common(rows: DataFrame, key: str, value: str, skip_blank: bool = False) -> DataFrame:
    """The commonest value per key; equal counts take the smaller value.

    Counted per (key, value) first, so the choice is among distinct values only.
    """
    src = rows.where(F.col(value) != "") if skip_blank else rows
    counts = src.groupBy(key, value).count()
    return first_by(counts, [key], [F.desc("count"), value]).select(key, value)


def by_location(stops: DataFrame) -> DataFrame:
    """Per location: counts, echo rate, its commonest name and type."""
    base = echo_counts(stops, ["location_code"])
    names = most_common(stops, "location_code", "location_name", skip_blank=True)
    types = most_common(stops, "location_code", "location_type")
    out = base.join(names, "location_code", "left").join(types, "location_code", "left")
    return out.withColumns({
        "location_name": F.coalesce("location_name", F.lit("")),
        "exact_pct": F.try_divide(100.0 * F.col("exact"), F.col("comparable")),
    })


def line_class(locations: DataFrame) -> DataFrame:
    return locations.withColumns({
        "line": F.when(F.col("location_name") == "", "unnamed")
        .when(values.on_weak_line("location_name"), "flagged").otherwise("unflagged"),
        "keyword": values.weak_line_word("location_name"),
    })


def totals(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("locations"),
        *[F.sum(c).alias(c) for c in ("records", "arrivals", "comparable", "exact")],
    )


def by_type(stops: DataFrame) -> DataFrame:
    """Counts per location type, with passenger and timing subtotals."""
    t = echo_counts(stops, ["location_type"])
    part = F.when(F.col("location_type").isin(*values.PASSENGER_TYPES), "passenger").otherwise("timing")
    return t.withColumn("part", part).groupingSets(
        [["part", "location_type"], ["part"]], "part", "location_type"
    ).agg(*[F.sum(c).alias(c) for c in ("records", "arrivals", "comparable", "exact")])


def ranked_locations(locations: DataFrame, top: int, min_comparable: int = MIN_COMPARABLE) -> DataFrame:
    """The `top` locations by exact share among those with enough to compare."""
    shown = locations.where(F.col("comparable") >= min_comparable)
    return shown.orderBy(F.desc_nulls_last("exact_pct"), "location_code").limit(top)


def held_out(locations: DataFrame, min_comparable: int = MIN_COMPARABLE) -> DataFrame:
    return locations.agg(
        F.count_if(F.col("comparable") < min_comparable).alias("held"), F.count(F.lit(1)).alias("locations"))


def echo_cells(stops: DataFrame) -> DataFrame:
    """Line by capture method with both margins and the grand total."""
    cmp = stops.where(F.col("arr_sec").isNotNull() & F.col("sched_sec").isNotNull())
    flagged = cmp.withColumn("flagged", values.on_weak_line("location_name"))
    return flagged.cube("flagged", "auto_arrival").agg(
        F.count(F.lit(1)).alias("comparable"),
        F.count_if(F.col("arr_sec") == F.col("sched_sec")).alias("exact"),
    )


def standardised_echo(cells: DataFrame) -> DataFrame:
    """The flagged lines' echo rate at the other lines' mix of capture methods."""
    inner = cells.where(F.col("flagged").isNotNull() & F.col("auto_arrival").isNotNull())
    by_method = inner.groupBy("auto_arrival").agg(
        F.sum(F.when(F.col("flagged"), F.col("comparable"))).alias("f_n"),
        F.sum(F.when(F.col("flagged"), F.col("exact"))).alias("f_exact"),
        F.sum(F.when(~F.col("flagged"), F.col("comparable"))).alias("o_n"),
        F.sum(F.when(~F.col("flagged"), F.col("exact"))).alias("o_exact"),
    )
    return by_method.agg(
        (100 * F.sum("f_exact") / F.sum("f_n")).alias("flagged_pct"),
        (100 * F.sum("o_exact") / F.sum("o_n")).alias("other_pct"),
        (100 * F.sum(F.col("o_n") * F.col("f_exact") / F.col("f_n")) / F.sum("o_n")).alias("flagged_at_other_mix_pct"),
    )


def collapse_polls(live: DataFrame) -> DataFrame:
    """Polls as events: how many, whether any carried an ETA, the last group seen."""
    return live.groupBy(*LIVE_EVENT).agg(
        F.count(F.lit(1)).alias("polls"),
        F.bool_or(F.col("eta_sec").isNotNull()).alias("has_eta"),
        F.max_by("station_group", F.struct("poll_sec", "location_order")).alias("station_group"),
    )


def stop_facts(stops: DataFrame) -> DataFrame:
    """One row per (date, train, location): the last record in route order."""
    return first_by(stops, LIVE_EVENT, [F.desc("location_order")]).select(
        *LIVE_EVENT, "delay_sec", "auto_arrival", F.lit(True).alias("matched"))


def match_rate(events: DataFrame, facts: DataFrame) -> DataFrame:
    met = events.join(facts, list(LIVE_EVENT), "left")
    hit = F.coalesce("matched", F.lit(False))
    return met.rollup("station_group").agg(
        F.grouping("station_group").alias("is_total"), F.count_if(hit).alias("matched"),
        F.count(F.lit(1)).alias("events"), (100 * F.avg(hit.cast("int"))).alias("match_pct"),
    )


def usability(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Per group and in total: an ETA, an actual, both, both and machine-captured."""
    met = events.join(facts, list(LIVE_EVENT), "left")
    actual = F.col("delay_sec").isNotNull()
    both = F.col("has_eta") & actual
    return met.rollup("station_group").agg(
        F.grouping("station_group").alias("is_total"),
        F.count(F.lit(1)).alias("events"),
        F.count_if("has_eta").alias("eta"),
        F.count_if(actual).alias("actual"),
        F.count_if(both).alias("usable"),
        F.count_if(both & (F.col("auto_arrival") == "1")).alias("auto"),
    )


def thin_groups(usable: DataFrame, floor: int = THIN_EVENTS) -> DataFrame:
    return usable.where((F.col("is_total") == 0) & (F.col("auto") < floor)).select("station_group", "auto")


def missing_dates(events: DataFrame, stops: DataFrame) -> DataFrame:
    return events.select("service_date").distinct().join(
        stops.select("service_date").distinct(), "service_date", "left_anti")


def unmatched_reasons(events: DataFrame, stops: DataFrame, codes: DataFrame, examples: int = 4) -> DataFrame:
    """Why events found no record, with up to `examples` of each in key order."""
    left = events.join(stops.select(*LIVE_EVENT).distinct(), list(LIVE_EVENT), "left_anti")
    dates = stops.select("service_date").distinct().withColumn("_date", F.lit(True))
    runs = stops.select("service_date", "train_code").distinct().withColumn("_run", F.lit(True))
    known = codes.select("train_code").distinct().withColumn("_known", F.lit(True))
    why = (
        F.when(F.col("_date").isNull(), "date not collected")
        .when(F.col("_run").isNull() & F.col("_known").isNull(), "train code unknown")
        .when(F.col("_run").isNull(), "known code, no run that date")
        .otherwise("station not on route")
    )
    r = (
        left.join(dates, "service_date", "left").join(runs, ["service_date", "train_code"], "left")
        .join(known, "train_code", "left")
        .select(*LIVE_EVENT, why.alias("reason"))
    )
    counts = r.groupBy("reason").count().withColumnRenamed("count", "n")
    w = Window.partitionBy("reason").orderBy(*LIVE_EVENT)
    few = r.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples)
    text = F.concat_ws(" ", F.col("service_date").cast("string"), F.concat_ws("@", "train_code", "location_code"))
    shown = few.groupBy("reason").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))), lambda x: x["t"]), ", ").alias("examples")
    )
    return counts.join(shown, "reason")


def join_verdict(rates: DataFrame, missing: DataFrame, threshold: float = MATCH_THRESHOLD_PCT) -> DataFrame:
    total = rates.where("is_total = 1").select("match_pct")
    gaps = missing.agg(F.count(F.lit(1))).scalar()
    return total.withColumn("missing_dates", gaps).withColumn(
        "passes", (F.col("match_pct") >= threshold) & (F.col("missing_dates") == 0))


def merge_registry(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """Fold (code, day) sightings into the registry; `is_new` marks codes never seen before.

    Columns of the state: code, first_seen, last_seen, days_of_week (weekday numbers).
    """
    seen = sightings.groupBy("code").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
        F.collect_set(F.weekday("day")).alias("days_of_week"), F.lit(False).alias("_old"),
    )
    both = state.withColumn("_old", F.lit(True)).unionByName(seen)
    return both.groupBy("code").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("days_of_week")))).alias("days_of_week"),
        (~F.bool_or("_old")).alias("is_new"),
    )


def weekday_names(days: str = "days_of_week"):
    names = F.array(*[F.lit(n) for n in times.WEEKDAYS])
    return F.array_join(F.transform(F.col(days), lambda i: F.element_at(names, i + 1)), ",")


def weekend_split(registry: DataFrame) -> DataFrame:
    on = F.arrays_overlap("days_of_week", F.array(F.lit(5), F.lit(6)))
    return registry.agg(F.count_if(on).alias("weekend"), F.count_if(~on).alias("weekday_only"))


def work_list(codes: DataFrame, start: str, end: str, have: DataFrame) -> DataFrame:
    """Every code on every date of a range, minus what is already held.

    The dates are generated on each code's row; nothing is cross-joined.
    """
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    wanted = codes.select("code").distinct().withColumn("day", F.explode(span))
    return wanted.join(have.select("code", "day").distinct(), ["code", "day"], "left_anti")


def retry_list(failures: DataFrame) -> DataFrame:
    """Failed pairs once each, numbered in the order they first failed."""
    first = failures.groupBy("day", "code").agg(F.min("seq").alias("first_failed"))
    return first.where(F.col("day").isNotNull() & F.col("code").isNotNull())


def survey(stops: DataFrame, files: DataFrame) -> DataFrame:
    """Per date over sampled files: records, with arrival, comparable, differing."""
    s = stops.join(files.select("service_date", "train_code"), ["service_date", "train_code"], "left_semi")
    a, sc = F.col("arr_sec"), F.col("sched_sec")
    return s.groupBy("service_date").agg(
        F.countDistinct("train_code").alias("sampled"),
        F.count(F.lit(1)).alias("records"), F.count("arr_sec").alias("with_arrival"),
        F.count_if(a.isNotNull() & sc.isNotNull()).alias("comparable"),
        F.count_if(a != sc).alias("differing"),
    )


def seeded_sample(rows: DataFrame, within: list[str], key: str, k: int, seed: int) -> DataFrame:
    """`k` rows per group in the order of a seeded hash of the key."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(*within).orderBy(order, key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def fleet_sample(fleet: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A uniform sample of distinct codes, with the pool and sample size on every row."""
    pool = fleet.select(key).distinct()
    size = pool.agg(F.count(F.lit(1))).scalar()
    picked = pool.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), key).limit(n)
    return picked.withColumn("pool_size", size).withColumn("sample_size", F.least("pool_size", F.lit(n)))
