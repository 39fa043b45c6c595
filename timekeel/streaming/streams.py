"""The operators as streams. Inputs carry event time; every state is bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import times
from ..operators import audit
from ..session import scratch_path

# Fixed values.
SETTLE = "6 hours"
CYCLE = "5 minutes"
GAP = "15 minutes"
#: Parts that the captures of an hour are dealt over.
PIECES = 16


def drain(stream: DataFrame, label: str, checkpoint: str, mode: str = "append",
          each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over what its source holds, and return the folder it wrote to.

    A later run with the same checkpoint goes on where this one ended.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out


def follow(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def land(raw: DataFrame) -> DataFrame:
    """Every poll kept, nothing merged at ingest."""
    return raw.withColumn("landed_day", F.to_date(times.local_time("polled_at")))


def write_cycle(base: str) -> Callable[[DataFrame, int], None]:
    """One micro-batch out as three tables: records, cycles, failures, by day. A replayed
    batch replaces its own files, and the cycles of the days it touches are counted again
    over all batches, so a cycle that two batches share is one row."""
    def each(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(times.local_time("polled_at"))
        rows = batch.withColumns({"date": day, "batch": F.lit(batch_id)})
        parts = {
            "records": rows.where(~F.col("failed")),
            "failures": rows.where("failed"),
        }
        for name, df in parts.items():
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{base}/{name}")
        days = [r["date"] for r in rows.select("date").distinct().collect()]  # the days of one batch
        spark = batch.sparkSession
        polls = [spark.read.schema(rows.schema).parquet(f"{base}/{name}").where(F.col("date").isin(days)) for name in parts]
        cycles = polls[0].unionByName(polls[1]).groupBy("date", F.window("polled_at", CYCLE)["start"].alias("cycle")).agg(
            F.count(F.lit(1)).alias("attempted"), F.count_if("failed").alias("failed"))
        cycles = cycles.withColumn("status", F.when(F.col("failed") == 0, "complete").when(F.col("failed") < F.col("attempted"), "partial").otherwise("failed"))
        cycles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{base}/cycles")
    return each


def last_statement(preds: DataFrame, settle: str = SETTLE) -> DataFrame:
    """The last statement per event and band, emitted once its service day has settled."""
    banded = preds.withColumn("lead_band", times.band("lead_sec")).withWatermark("made_at", settle)
    rest = ["made_sec", "lead_sec", "q10_sec", "q50_sec", "q90_sec", "location_order"]
    picked = F.max_by(F.struct(*rest), F.struct("made_sec", (-F.col("location_order")).alias("o"))).alias("_row")
    return banded.groupBy(
        F.window("made_at", "1 day"), "service_date", "train_code", "location_code", "lead_band"
    ).agg(picked).select("service_date", "train_code", "location_code", "lead_band", "_row.*")


def rolling_coverage(scored: DataFrame, days: int = 7) -> DataFrame:
    return scored.withWatermark("scored_at", SETTLE).groupBy(F.window("scored_at", f"{days} days", "1 day")).agg(
        F.count_if("interval_hit").alias("hits"), F.count("interval_hit").alias("n")
    ).select(F.col("window.end").cast("date").alias("as_of"), "hits", "n")


def cycle_counts(captures: DataFrame, width: str = CYCLE) -> DataFrame:
    return captures.withWatermark("polled_at", SETTLE).groupBy("side", F.window("polled_at", width)).agg(
        F.count(F.lit(1)).alias("n")).select("side", F.col("window.start").alias("start"), "n")


def uptime_sessions(captures: DataFrame, gap: str = GAP) -> DataFrame:
    """Sessions of a side; ends are the last cycle, not the gap after it."""
    return captures.withWatermark("polled_at", SETTLE).groupBy("side", F.session_window("polled_at", gap)).agg(
        F.min("polled_at").alias("start_at"), F.max("polled_at").alias("end_at"), F.count(F.lit(1)).alias("n")
    ).select("side", "start_at", "end_at", "n")


def session_pieces(captures: DataFrame, gap: str = GAP, parts: int = PIECES) -> DataFrame:
    """First step of sessions: those of each hour's captures, dealt over `parts`, so that no
    side and no busy hour is one key. A piece is an interval of captures no further apart."""
    dealt = captures.withWatermark("polled_at", SETTLE).withColumns({
        "_hour": F.floor(F.unix_timestamp("polled_at") / 3600), "_part": F.pmod(F.xxhash64(*[F.col(c) for c in captures.columns]), F.lit(parts))})
    return dealt.groupBy("side", "_hour", "_part", F.session_window("polled_at", gap)).agg(
        F.min("polled_at").alias("start_at"), F.max("polled_at").alias("end_at"), F.count(F.lit(1)).alias("n")
    ).select("side", "start_at", "end_at", "n")


def merged_sessions(pieces: DataFrame, gap: str = GAP, settle: str = SETTLE) -> DataFrame:
    """Second step: pieces that touch across hours and parts become one session. A side has
    some pieces an hour, however many captures they hold."""
    seconds = (F.unix_micros("end_at") - F.unix_micros("start_at")) / 1_000_000 + pd.Timedelta(gap).total_seconds()
    reach = F.make_interval(secs=seconds.cast("decimal(18,6)"))
    return pieces.withWatermark("start_at", settle).groupBy("side", F.session_window("start_at", reach)).agg(
        F.min("start_at").alias("first_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n")
    ).select("side", F.col("first_at").alias("start_at"), "end_at", "n")


VANTAGE_SCHEMA = "service_date date, train_code string, location_order int, location_code string, delay_sec int"
VANTAGE_STATE = ("train_code array<string>, location_order array<int>, location_code array<string>, delay_sec array<int>, "
                 "reported_ms array<long>, latest_ms array<long>, closes_ms array<long>")
#: Groups that the trains of a service day are dealt over, so that one call of Python serves many trains.
VANTAGE_GROUPS = 256


def latest_vantage(stops: DataFrame, settle: str = SETTLE, groups: int = VANTAGE_GROUPS) -> DataFrame:
    """The furthest reported stop of each running train, closed when its reports have aged.

    Of two reports of a stop the one made later counts, whichever arrives first, and a late
    report never brings the closing time forward. Trains are dealt over `groups` keys a day;
    the state of a key is one small row a train, as arrays, and each train closes by itself.
    The function is local, so it travels to the workers by value and they need no package.
    """
    def keep_furthest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Holds one row per train: the furthest stop reported. Emitted when the day settles."""
        fields = ["train_code", "location_order", "location_code", "delay_sec", "reported_ms", "latest_ms", "closes_ms"]
        now = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(fields, state.getOption or [[]] * len(fields)))).assign(touched=False)
        for b in () if state.hasTimedOut else batches:
            made = b["reported_at"].astype("datetime64[us]").astype("int64") // 1000
            new = pd.DataFrame({
                "train_code": b["train_code"], "location_order": b["location_order"].astype("int64"), "location_code": b["location_code"].astype(str),
                "delay_sec": b["delay_sec"].astype("int64"), "reported_ms": made, "latest_ms": made, "closes_ms": 0, "touched": True})
            both = pd.concat([held, new], ignore_index=True) if len(held) else new
            each = both.groupby("train_code", dropna=False, sort=False)
            both = both.assign(latest_ms=each["latest_ms"].transform("max"), touched=each["touched"].transform("max"))
            held = both.sort_values(["location_order", "reported_ms"], kind="stable").drop_duplicates("train_code", keep="last")
        touched = held["touched"].astype(bool)
        held = held.assign(closes_ms=held["closes_ms"].where(~touched, (held["latest_ms"] + 1).clip(lower=now + 1)))
        aged = ~touched & (held["closes_ms"] < now)
        left = held[~aged]
        if len(left):
            state.update(tuple(left[f].tolist() for f in fields))
            state.setTimeoutTimestamp(max(int(left["closes_ms"].min()), now + 1))
        else:
            state.remove()
        if aged.any():
            done = held.loc[aged, ["train_code", "location_order", "location_code", "delay_sec"]]
            done.insert(0, "service_date", key[0])
            yield done

    dealt = stops.withColumn("_group", F.pmod(F.xxhash64("train_code"), F.lit(groups)))
    return dealt.withWatermark("reported_at", settle).groupBy("service_date", "_group").applyInPandasWithState(
        keep_furthest, VANTAGE_SCHEMA, VANTAGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def merge_registry_into(base: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch folds its sightings into the next version of the registry table."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "code string, first_seen date, last_seen date, days_of_week array<int>"
        before = spark.read.schema(schema).parquet(f"{base}/v{batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
        audit.merge_registry(before, batch.select("code", "day")).drop("is_new").write.mode("overwrite").parquet(f"{base}/v{batch_id}")
    return each


#: Groups that the events of a service day are dealt over, so that one call of Python joins many events.
JOIN_GROUPS = 256
JOIN_ROWS = "is_outcome boolean, train_code string, location_code string, prediction_id string, at_us long, low_us long, until_us long, value double"
JOIN_STATE = "next_ms long, held binary"
JOINED = "service_day int, train_code string, location_code string, prediction_id string, made_us long, q50_sec double, actual_delay_sec double"


def scored_stream(preds: DataFrame, outcomes: DataFrame, within: str = "1 day", groups: int = JOIN_GROUPS) -> DataFrame:
    """Predictions joined to outcomes as both arrive. A prediction whose outcome has not come
    by the time range's end is emitted without one.

    Rows wait until the watermark has passed the end of what they can meet, in Spark's own
    stream join each as an entry of the state. Here the events of a service day are dealt over
    `groups` keys, and the state of a key is its rows as one compressed Arrow stream, read and
    written again by each delivery that touches the key. The session should keep state in
    RocksDB, so that it needs no heap. The function is local, so it travels to the workers by
    value and they need no package.
    """
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([*((n, kinds[t]) for n, t in (f.split(" ") for f in JOIN_ROWS.split(", "))), ("met", pa.bool_())])

    def packed(rows: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False))
        return sink.getvalue().to_pybytes()

    def pairs(event: np.ndarray, rows: pd.DataFrame, said: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of predictions among `said` and of the outcomes among `came` of their event and time range."""
        came = came[np.lexsort((rows["at_us"].to_numpy()[came], event[came]))]
        at = np.sort(rows["at_us"].to_numpy()[came])
        place = event[came] * (len(at) + 1) + np.searchsorted(at, rows["at_us"].to_numpy()[came])
        base = event[said] * (len(at) + 1)
        first = np.searchsorted(place, base + np.searchsorted(at, rows["low_us"].to_numpy()[said]))
        past = np.searchsorted(place, base + np.searchsorted(at, rows["until_us"].to_numpy()[said], side="right"))
        n = past - first
        return np.repeat(said, n), came[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def meet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Joins one delivery with itself and with what is held; lets go what can meet nothing more."""
        now = state.getCurrentWatermarkMs()
        new = [b[schema.names[:-1]] for b in (() if state.hasTimedOut else batches)]
        held = [pa.ipc.open_stream(bytes(state.get[1])).read_pandas()] if state.exists else []
        old = sum(map(len, held))
        rows = pd.concat([*held, *(b.assign(met=False) for b in new)], ignore_index=True)
        rows = rows.astype({"is_outcome": bool, "met": bool, "at_us": "int64", "low_us": "int64", "until_us": "int64"})
        # A code that is missing equals none: such an event is a number that only predictions have.
        train, code = (pd.factorize(rows[c])[0] for c in ("train_code", "location_code"))
        known = (train >= 0) & (code >= 0)
        event = np.where(known, train * (code.max(initial=0) + 1) + code, -1)
        came = rows["is_outcome"].to_numpy() & known
        said, fresh = ~rows["is_outcome"].to_numpy() & known, np.arange(len(rows)) >= old
        both = [pairs(event, rows, np.flatnonzero(said & fresh), np.flatnonzero(came)), pairs(event, rows, np.flatnonzero(said & ~fresh), np.flatnonzero(came & fresh))]
        p, o = (np.concatenate(x) for x in zip(*both))
        met = rows["met"].to_numpy().copy()
        met[p] = True
        over = rows["until_us"].to_numpy() <= now * 1000
        alone = np.flatnonzero(over & ~met & ~rows["is_outcome"].to_numpy())
        given = np.concatenate([p, alone])
        if len(given):
            out = rows.iloc[given]
            value = np.concatenate([rows["value"].to_numpy()[o], np.full(len(alone), np.nan)])
            yield pd.DataFrame({
                "service_day": np.full(len(out), np.nan if pd.isna(key[0]) else key[0]), **{c: out[c].to_numpy() for c in ("train_code", "location_code", "prediction_id")},
                "made_us": out["at_us"].to_numpy(), "q50_sec": out["value"].to_numpy(), "actual_delay_sec": value})
        left = rows.assign(met=met)[~over]
        if len(left):
            until = -(-int(left["until_us"].min()) // 1000)
            state.update((until, packed(left)))
            # Let go once the watermark has come to the end.
            state.setTimeoutTimestamp(until - 1)
        elif state.exists:
            state.remove()

    day, micros = F.unix_date("service_date"), F.unix_micros
    # An outcome without a key meets nothing, and moves no watermark.
    keyed = outcomes.where(" AND ".join(f"{k} IS NOT NULL" for k in ("service_date", "train_code", "location_code")))
    p, o = preds.withWatermark("made_at", SETTLE), keyed.withWatermark("arrived_at", SETTLE)
    made, arrived, last = F.col("made_at"), F.col("arrived_at"), F.expr(f"INTERVAL {within}")
    event = [day.alias("service_day"), F.col("train_code"), F.col("location_code")]
    rows = p.select(made.alias("at"), *event, F.lit(False).alias("is_outcome"), F.col("prediction_id").cast("string").alias("prediction_id"), micros(made).alias("at_us"),
                    micros(made - F.expr("INTERVAL 1 DAY")).alias("low_us"), micros(made + last).alias("until_us"), F.col("q50_sec").cast("double").alias("value"))
    # The last prediction that may meet an outcome is made a day later, by the clock: 25 hours at most.
    rows = rows.unionByName(o.select(arrived.alias("at"), *event, F.lit(True).alias("is_outcome"), F.lit(None).cast("string").alias("prediction_id"), micros(arrived).alias("at_us"),
                                     F.lit(0).cast("long").alias("low_us"), micros(arrived + F.expr("INTERVAL 25 HOURS")).alias("until_us"), F.col("actual_delay_sec").cast("double").alias("value")))
    # A row without a time meets nothing, and no watermark passes it.
    dealt = rows.where(F.col("at").isNotNull()).withColumn("_group", F.pmod(F.xxhash64("train_code", "location_code"), F.lit(groups)))
    out = dealt.groupBy("service_day", "_group").applyInPandasWithState(meet, JOINED, JOIN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    kind = {**{f.name: f.dataType for f in outcomes.schema}, **{f.name: f.dataType for f in preds.schema}}
    return out.select(
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("service_day")).alias("service_date"), "train_code", "location_code",
        F.col("prediction_id").cast(kind["prediction_id"]).alias("prediction_id"), F.timestamp_micros("made_us").alias("made_at"),
        F.col("q50_sec").cast(kind["q50_sec"]).alias("q50_sec"), F.col("actual_delay_sec").cast(kind["actual_delay_sec"]).alias("actual_delay_sec"),
        F.when(F.col("actual_delay_sec").isNull(), "no_actual_arrival").otherwise("scored").alias("score_state"))


def distinct_predictions(preds: DataFrame, settle: str = SETTLE) -> DataFrame:
    return preds.withWatermark("made_at", settle).dropDuplicatesWithinWatermark(["prediction_id"])
