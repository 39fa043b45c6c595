"""JSON logs, code lists, documents and partition inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times

# Fixed values.
ROLLUP_FIELDS = (
    "score_state", "model_version", "model_err_rounded_sec", "rival_err_sec", "interval_hit",
    "raw_interval_hit", "station_group", "lead_band",
)
CALIBRATION_FIELDS = (
    "score_state", "station_group", "lead_band", "actual_delay_sec", "q10_sec", "q90_sec",
    "raw_q10_sec", "raw_q90_sec",
)
MAX_SNAPSHOT_AGE_HOURS = 24
#: Parts of a file listing that one task reads; Spark puts some thirty small files in a part.
PARTS_A_TASK = 16


def narrow(schema: T.StructType, fields) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name in fields])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, fields=None) -> DataFrame:
    """JSON lines, plain or gzipped. With `fields`, only those are parsed out of each line."""
    return spark.read.schema(narrow(schema, fields) if fields else schema).json(path)


def read_archive(spark: SparkSession, path: str, columns, where: Column | None = None) -> DataFrame:
    """Partitioned Parquet, filtered and projected before anything else reads it."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def split_corrupt(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, unreadable lines) of a JSON log."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("_row", F.from_json(
        "value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]),
        {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.col("_row._corrupt").isNotNull() | F.col("_row").isNull()
    names = [F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields]
    return parsed.where(~bad).select(*names), parsed.where(bad).select("value")


def usable_polls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(polls, counts of what was set aside): a poll needs a date, a train, a station, an ETA
    and the instant it was read."""
    date = times.feed_date("Traindate")
    typed = rows.withColumns({
        "service_date": date, "train_code": times.key("Traincode"), "location_code": times.key("station_code"),
        "eta_sec": times.clock_seconds("Exparrival"),
        "poll_sec": times.service_seconds(times.local_stamp("polled_at"), date),
    })
    why = (
        F.when(F.col("service_date").isNull(), "bad date")
        .when((F.coalesce("train_code", F.lit("")) == "") | (F.coalesce("location_code", F.lit("")) == ""), "no key")
        .when(F.col("eta_sec").isNull(), "no ETA").when(F.col("poll_sec").isNull(), "bad stamp")
    )
    marked = typed.withColumn("_why", why)
    good = marked.where(F.col("_why").isNull()).drop("_why")
    return good, marked.where(F.col("_why").isNotNull()).groupBy(F.col("_why").alias("reason")).count()


CYCLE_FIELDS = "cycle_sec long, records long, status string"


def productive_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Cycle documents that recorded something and did not fail; a document that is no JSON is none."""
    read = spark.read.schema(CYCLE_FIELDS).option("recursiveFileLookup", True).json(path)
    return read.where((F.col("records") > 0) & (F.coalesce("status", F.lit("")) != "failed")).select("cycle_sec").distinct()


def two_archives(spark: SparkSession, local: str, cloud: str, schema: T.StructType) -> DataFrame:
    """Rows of both collectors' productive cycles, tagged with their side.

    Each archive is a folder with `expected` (JSON lines, compressed or not, by date or not)
    and `cycles` (one document a cycle).
    """
    both = None
    for side, base in (("local", local), ("cloud", cloud)):
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{base}/expected")
        kept = rows.join(productive_cycles(spark, f"{base}/cycles"), "cycle_sec", "left_semi").withColumn("side", F.lit(side))
        both = kept if both is None else both.unionByName(kept)
    return both


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes from `{"codes": {code: …}}`, `{code: …}` or a plain list; unsafe names go."""
    doc = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.codes")
    listed = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    keys = (
        F.when(times.trimmed("value").startswith("["), listed)
        .when(inner.isNotNull() & inner.startswith("["), F.from_json(inner, "array<string>"))
        .when(inner.isNotNull(), F.json_object_keys(inner))
        .otherwise(F.json_object_keys("value"))
    )
    codes = doc.select(F.explode(keys).alias("_c")).select(times.key("_c").alias("code"))
    return codes.where(F.col("code").rlike(r"^[A-Z0-9_-]*[A-Z0-9][A-Z0-9_-]*$")).distinct()


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def checked_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under `path` opened whole: its plain size, null if it can't be unpacked, and
    whether its XML parses (null for other files). A task takes several parts of the listing,
    one after the other, so that very many small files are not as many short tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
    parts = files.rdd.getNumPartitions()
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-parts // PARTS_A_TASK)))

    def check(batches):
        """Local, so it travels to the workers by value."""
        import gzip
        import zlib
        from xml.parsers import expat

        import pyarrow as pa

        for b in batches:
            sizes, parsed = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(2)):
                body, plain, fine = content.as_buffer(), None, None
                try:
                    plain = gzip.decompress(body) if name.endswith(".gz") else bytes(body)
                except (OSError, EOFError, zlib.error):
                    pass
                if plain is not None and ".xml" in name.rsplit("/", 1)[-1]:
                    try:
                        expat.ParserCreate().Parse(plain, True)
                        fine = True
                    except expat.ExpatError:
                        fine = False
                sizes.append(None if plain is None else len(plain))
                parsed.append(fine)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(parsed, pa.bool_())], names=["path", "length", "size", "parses"])

    return files.mapInArrow(check, "path string, length long, size long, parses boolean")


def census(spark: SparkSession, path: str, empty_max: int = 200, checked: DataFrame | None = None) -> DataFrame:
    """Files per date: how many, empty, that can't be unpacked, that don't parse, stray; bytes
    as stored, and the median plain size. `checked` are the checked files of the path, where
    they are there already."""
    dated = (checked_files(spark, path) if checked is None else checked).withColumn("date", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1)).where(F.col("date") != "")
    stray = F.col("path").endswith(".tmp")
    size, full = F.when(~stray, F.col("size")), ~stray & (F.col("size") > empty_max)
    return dated.groupBy("date").agg(
        F.count_if(~stray).alias("files"), F.count_if(size <= empty_max).alias("empty"), F.count_if(~stray & F.col("size").isNull()).alias("unreadable"),
        F.count_if(full & ~F.col("parses")).alias("unparseable"), F.count_if(stray).alias("strays"),
        F.sum(F.when(~stray, F.col("length"))).alias("bytes"), F.percentile(size, 0.5).alias("median_size"))


def partitions(df: DataFrame, column: str = "date") -> DataFrame:
    """The partition values present; on a partition column this reads no data files."""
    return df.select(column).distinct()


def newest_stamp(spark: SparkSession, path: str) -> DataFrame:
    """When the newest snapshot was taken, by the stamp in its name."""
    files = spark.read.format("binaryFile").load(path).select("path")
    stamp = F.try_to_timestamp(F.regexp_extract("path", r"(\d{8}T\d{6}Z)", 1), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return files.agg(F.max(stamp).alias("newest"))


def refuse_stale(newest: DataFrame, now: Column, max_hours: int = MAX_SNAPSHOT_AGE_HOURS) -> DataFrame:
    """One row, or an error when the newest snapshot is missing or older than `max_hours`."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("newest")) / 3600
    fresh = F.coalesce(age <= max_hours, F.lit(False))
    return newest.select("newest", age.alias("age_hours"), F.when(
        fresh, F.lit(True)).otherwise(F.raise_error(F.lit("the snapshot archive is stale")).cast("boolean")).alias("fresh"))
