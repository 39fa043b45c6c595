"""Feed documents: movement, board, fleet and station XML, as DataFrames.

Schemas are explicit, so a column that is empty on one date keeps its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times, values
from ..operators.ordered import Track, whole

# The fields of the feed's records.
MOVEMENT_FIELDS = (
    "TrainCode", "TrainDate", "LocationCode", "LocationFullName", "LocationOrder", "LocationType",
    "TrainOrigin", "TrainDestination", "ScheduledArrival", "ScheduledDeparture", "ExpectedArrival",
    "ExpectedDeparture", "Arrival", "Departure", "AutoArrival", "AutoDepart", "StopType",
)
BOARD_FIELDS = (
    "Traincode", "Traindate", "Stationcode", "Origin", "Destination", "Origintime", "Scharrival",
    "Schdepart", "Exparrival", "Expdepart", "Duein", "Late", "Status", "Lastlocation",
    "Locationtype", "Traintype", "Direction",
)
FLEET_FIELDS = ("TrainStatus", "TrainLatitude", "TrainLongitude", "TrainCode", "TrainDate", "PublicMessage", "Direction")
STATION_FIELDS = ("StationDesc", "StationAlias", "StationLatitude", "StationLongitude", "StationCode", "StationId")
ROW_TAGS = {
    "movements": "objTrainMovements", "boards": "objStationData",
    "fleet": "objTrainPositions", "stations": "objStation",
}
STAMP = r"(\d{8}T\d{6}Z)"
DATE_DIR = r"(\d{4}-\d{2}-\d{2})/[^/]*$"


def text_schema(fields) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def read_xml(spark: SparkSession, path: str | list[str], row_tag: str, fields) -> DataFrame:
    """Records of one tag, every field as trimmed text ('' when absent), and their file."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(text_schema(fields)).load(path)
    return raw.select(
        *[F.coalesce(times.trimmed(f), F.lit("")).alias(f) for f in fields],
        F.col("_metadata.file_path").alias("source_file"),
    )


def read_movements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = read_xml(spark, path, ROW_TAGS["movements"], MOVEMENT_FIELDS)
    return raw.withColumn("file_date", F.regexp_extract("source_file", DATE_DIR, 1))


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """Board rows with when and for which station they were read, taken from the file name
    `<stamp>_<code>.xml`."""
    raw = read_xml(spark, path, ROW_TAGS["boards"], BOARD_FIELDS)
    return raw.withColumns({
        "polled_at": F.to_timestamp(F.regexp_extract("source_file", STAMP, 1), "yyyyMMdd'T'HHmmss'Z'"),
        "station_code": F.upper(F.regexp_extract("source_file", r"_([A-Za-z0-9]+)\.xml", 1)),
    })


def read_fleet(spark: SparkSession, path: str) -> DataFrame:
    raw = read_xml(spark, path, ROW_TAGS["fleet"], FLEET_FIELDS)
    here = values.placed("TrainLatitude", "TrainLongitude")
    code = times.key("TrainCode")
    return raw.where(code != "").select(
        code.alias("train"), F.upper("TrainStatus").alias("status"), F.col("Direction").alias("direction"),
        F.when(here, F.col("TrainLatitude").try_cast("double")).alias("lat"),
        F.when(here, F.col("TrainLongitude").try_cast("double")).alias("lon"),
        values.message_lines("PublicMessage", code).alias("message"), "source_file",
    )


def codes_in(fleet: DataFrame, running_only: bool = False) -> DataFrame:
    src = fleet.where(F.col("status") == "R") if running_only else fleet
    return src.select("train").distinct()


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    raw = read_xml(spark, path, ROW_TAGS["stations"], STATION_FIELDS)
    return raw.where(F.col("StationCode") != "").select(
        times.key("StationCode").alias("code"), F.col("StationDesc").alias("name"),
        F.col("StationAlias").alias("alias"), F.col("StationId").alias("id"),
        F.coalesce(F.col("StationLatitude").try_cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col("StationLongitude").try_cast("double"), F.lit(0.0)).alias("lon"),
    )


def parse_movements(raw: DataFrame) -> DataFrame:
    """Typed stop rows: seconds, anchored delays, why an actual is missing, echo flag.

    The furthest stop that reported anything is found per source file. A file holds one
    journey and was read by one task, so the group fits one.
    """
    absent = times.ABSENT_FULL_CLOCKS

    def sec(c: str) -> Column:
        return times.clock_seconds(c, absent)

    typed = raw.withColumns({
        "LocationOrder": F.col("LocationOrder").try_cast("int"),
        "sched_arr_sec": sec("ScheduledArrival"), "sched_dep_sec": sec("ScheduledDeparture"),
        "arr_sec": sec("Arrival"), "dep_sec": sec("Departure"),
        "service_date": times.feed_date("TrainDate"),
    })
    arrived, left = values.has_clock("Arrival"), values.has_clock("Departure")
    t = Track(("source_file",), ("LocationOrder",), "LocationOrder div 1024")
    far = whole(typed, t, {"_far": F.max(F.when(arrived | left, F.col("LocationOrder")))})
    s_arr, s_dep = values.has_clock("ScheduledArrival"), values.has_clock("ScheduledDeparture")
    return far.withColumns({
        "arrival_delay_sec": times.delay("arr_sec", "sched_arr_sec"),
        "departure_delay_sec": times.delay("dep_sec", "sched_dep_sec"),
        "null_reason": values.missing_reason(arrived, s_arr, "LocationOrder", "_far"),
        "departure_null_reason": values.missing_reason(left, s_dep, "LocationOrder", "_far"),
        "is_exact_match": values.exact_match("Arrival", "ScheduledArrival", arrived & s_arr),
    }).drop("_far")


def as_stops(parsed: DataFrame) -> DataFrame:
    """Parsed rows under the operators' column names."""
    return parsed.select(
        "service_date", times.key("TrainCode").alias("train_code"), F.col("LocationOrder").alias("location_order"),
        times.key("LocationCode").alias("location_code"), F.col("LocationFullName").alias("location_name"),
        F.upper("LocationType").alias("location_type"), F.col("sched_arr_sec").alias("sched_sec"), "arr_sec",
        F.col("AutoArrival").alias("auto_arrival"), F.col("TrainOrigin").alias("train_origin"),
        F.col("TrainDestination").alias("train_destination"),
    ).where(F.col("location_order").isNotNull())


def tag_drift(spark: SparkSession, path: str, row_tag: str, fields) -> DataFrame:
    """Tags seen inside the rows of the files that the schema lacks, and fields of it never seen.

    Files are cut at the rows' end tags, so a file of any length is read row by row; tags may
    have attributes or close themselves.
    """
    rows = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    inside = rows.select(F.regexp_extract("value", rf"(?s)<{row_tag}(?:\s[^<>]*)?>(.*)$", 1).alias("row"))
    tags = inside.select(F.explode(F.regexp_extract_all("row", F.lit(r"<([A-Za-z_][\w.-]*)(?:\s[^<>]*)?/?>"), F.lit(1))).alias("tag"))
    seen = tags.groupBy("tag").count()
    expected = spark.createDataFrame([(f,) for f in fields], "tag string")
    unknown = seen.join(expected, "tag", "left_anti").select("tag", F.lit("unexpected").alias("drift"), "count")
    missing = expected.join(seen, "tag", "left_anti").select("tag", F.lit("missing").alias("drift"), F.lit(0).cast("bigint").alias("count"))
    return unknown.unionByName(missing)
