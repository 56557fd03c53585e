"""Helpers shared by the operators of this subpackage: reading the tables,
Arrow batches in small slices, and a place for intermediate tables."""
from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.session import ensure_checkpoint_dir

# Rows handed to Python code at a time; with whole texts this bounds memory.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text
    becomes empty.  Other columns, whatever their names, are not read."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds few rows and few bytes of text
    (at least one row)."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        lens = pc.binary_length(col).to_pylist()
        lo, held = 0, 0
        for i, n in enumerate(lens):
            if i > lo and (held + (n or 0) > size or i - lo >= rows):
                yield b.slice(lo, i - lo)
                lo, held = i, 0
            held += n or 0
        if lo < len(lens):
            yield b.slice(lo, len(lens) - lo)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table once into the shared checkpoint folder and read it back, so
    that several consumers neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.  Spark deletes them once the
    driver's JVM has collected the plans that made them; a driver with little to
    do may not collect for long, while the files fill the executors' disks."""
    for _ in range(2):  # Python's references reach the JVM with a delay
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def partitions_for(df: DataFrame, rows: int, per_task: int) -> int:
    """Number of shuffle partitions for so many rows (or bytes) of work."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_task))
