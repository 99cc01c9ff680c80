"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsframe.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"  # a word: a run of anything but ASCII white space
BATCH_ROWS, BATCH_BYTES = 2000, 5 << 20
MOST_TASKS = 20_000  # of one stage; beyond, a task does several units one after the other


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def return_memory() -> None:
    """For a Python worker that handles one batch after the other: give what a batch needed back to the system.

    By default the C library raises the size from which it does so with every large array that is freed.
    """
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # arrays from 4 MB on have pages of their own
        libc.mallopt(-1, 16 << 20)
    pa.default_memory_pool().release_unused()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, units: int) -> int:
    """Partitions for so many units of work of bounded size: they grow with the data, not with a default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(units, MOST_TASKS))


def n_words(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and where each row starts in it (null: empty)."""
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    starts = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of the id as text leaves remainder 0 at five (a null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def spell_out(df: DataFrame, copies: str, into: str = "nth", run: int = 10_000) -> DataFrame:
    """One row for each of `copies` equal rows, numbered from 0; a long run is spelled out piece by piece."""
    n, k = F.col(copies), F.col("run_") * run
    runs = df.withColumn("run_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / run).cast("long"))))
    return runs.withColumn(into, F.explode(F.sequence(k, F.least(n, k + run) - 1))).drop("run_")
