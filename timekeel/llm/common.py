"""What the operators of this subpackage share: their input, shipping of their code, small slices of Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that Python holds as words or tokens at one time (one longer text is a slice of its own).
SLICE_CHARS = 1_000_000
#: Bytes of rows that Spark hands to a Python worker at one time (one longer row is a batch of its own); both sides hold a batch whole.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers once per application, as --py-files would, and bound the batches that they get unless the session does."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_timekeel_shipped", False):
        return spark
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="timekeel-code-"), "timekeel-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "timekeel")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._timekeel_shipped = True
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` alone, so that no other column can clash with what an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes of text, and one row at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < b.num_rows:
            yield b.slice(start)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; an id that is missing counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))
