"""Writers. Partitioned tables are rebalanced first, so a date that holds a third of the
rows is written by many tasks and a thin date by one."""

from __future__ import annotations

import re
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

# Fixed values.
ALWAYS = ("outcome", "predicted_at", "model_version", "train_date", "train_code", "station_code")
PREDICTED = ("scheduled_arrival", "pred_q10_sec", "pred_q50_sec", "pred_q90_sec")
DECLINED = ("reason",)

VERSION = re.compile(r"version-\d{12}\.txt")


class LogWriteFailed(Exception):
    """The predictions could not be logged, so they must not be served."""


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("date",)) -> None:
    """Parquet, zstd, one directory per partition value; only those present are replaced."""
    (df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by)
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path))


def existing(spark: SparkSession, path: str, by: str = "date") -> DataFrame | None:
    """The partition values of a table, from the names of its folders; no file is read."""
    values = partition_values(spark, path, by)
    return None if values is None else spark.createDataFrame([(v,) for v in values], f"{by} string")


def partition_values(spark: SparkSession, path: str, by: str = "date") -> list[str] | None:
    """Sorted values of the first partition column; None if the table isn't there. One entry a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()]
    return sorted(n[len(by) + 1:] for n in names if n.startswith(f"{by}="))


def pending(df: DataFrame, path: str, by: str = "date", force: bool = False) -> DataFrame:
    """Rows of the partitions not written yet; all of them when forced."""
    done = None if force else existing(df.sparkSession, path, by)
    if done is None:
        return df
    return df.join(done.withColumn(by, F.col(by).cast(df.schema[by].dataType)), by, "left_anti")


def write_scores(df: DataFrame, path: str) -> None:
    (df.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date")
     .option("partitionOverwriteMode", "dynamic").option("compression", "gzip").json(path))


def publish(document: DataFrame, *paths: str) -> None:
    """A document, written beside each of its places and then put there in one step.

    A place is a folder whose newest version is the document. A version appears whole, by a
    rename to a name that was not there, and the one before it stays for those who are reading
    it; earlier ones go. `published` reads the newest, at any moment a whole one.
    """
    held = settle(document, "document").coalesce(1)
    for path in paths:
        staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
        held.write.text(staged)
        _appear(document.sparkSession, staged, path)


def _versions(spark: SparkSession, path: str) -> tuple[JavaObject, list[str]]:
    """The file system of a place, and the names of its versions in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return fs, sorted(n for n in names if VERSION.fullmatch(n))


def _appear(spark: SparkSession, staged: str, path: str) -> None:
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs, names = _versions(spark, path)
    part = next(f.getPath() for f in fs.listStatus(of(staged)) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(of(path))
    number = int(names[-1][8:20]) + 1 if names else 1
    # Where another writer took the number, the rename refuses and the next one is tried.
    while fs.exists(of(path, f"version-{number:012d}.txt")) or not fs.rename(part, of(path, f"version-{number:012d}.txt")):
        number += 1
    for old in names[:-1]:
        fs.delete(of(path, old), False)
    fs.delete(of(staged), True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the newest version of a document."""
    _, names = _versions(spark, path)
    if not names:
        raise FileNotFoundError(path)
    return spark.read.text(f"{path.rstrip('/')}/{names[-1]}")


def date_folders(spark: SparkSession, base: str) -> dict[str, str]:
    """The folders under `base` whose names end in a date, by date; no file is listed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {s.getPath().getName()[-10:]: s.getPath().toString() for s in fs.listStatus(hadoop) if s.isDirectory()}
    return {d: f for d, f in sorted(found.items()) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", d)}


def violations(rows: DataFrame) -> DataFrame:
    """Rows the log must refuse, with the fields they lack."""
    def lacking(fields) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))

    missing = (
        F.when(F.col("outcome") == "predicted", lacking(ALWAYS + PREDICTED))
        .when(F.col("outcome") == "declined", lacking(ALWAYS + DECLINED))
        .otherwise(F.array(F.lit("outcome")))
    )
    return rows.withColumn("missing", missing).where(F.size("missing") > 0)


def append_predictions(rows: DataFrame, path: str, service_date: Column) -> None:
    """Append to the prediction log, each row under its own service date.

    Fails closed: nothing is written when any row is invalid or has no date. The rows are
    staged first, so those checked are exactly those logged, ids included.
    """
    known = F.col("prediction_id") if "prediction_id" in rows.columns else F.lit(None).cast("string")
    dated = settle(rows.withColumns({"date": service_date, "prediction_id": F.coalesce(known, F.uuid())}), "log")
    if dated.isEmpty():
        raise LogWriteFailed("no rows to log")
    bad = violations(dated).select("missing").unionByName(
        dated.where(F.col("date").isNull()).select(F.array(F.lit("train_date")).alias("missing"))).limit(1).collect()
    if bad:
        raise LogWriteFailed(f"row missing required fields: {bad[0]['missing']}")
    dated.write.mode("append").partitionBy("date").json(path)


def dead_letter(bad: DataFrame, path: str, kind: str) -> None:
    bad.withColumn("kind", F.lit(kind)).write.mode("append").json(path)
