"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.session import ship_package

#: A word: a run of characters other than the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a few numbers that may be broadcast, once counted; more are joined by merge.
SMALL = 500_000
#: Bytes of a batch of rows on its way to Python, Spark's own bound and the setting of both.
ARROW_BATCH, DEFAULT_BATCH, BATCH_BYTES = "2097152b", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a temporary one if the master is local, as in
    tests; on a cluster its executors would not share it, so that raises ValueError."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyscope-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor
    costs a re-read, not a recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage with all it holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def give_back() -> None:
    """Return the memory that this worker has freed to the system: it lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Let a batch of rows that travels to Python hold ARROW_BATCH bytes rather than Spark's 32 times as many, which
    lie in the executor, in its worker and on the way; a session that has set another bound keeps it."""
    if spark.conf.get(BATCH_BYTES, None) == DEFAULT_BATCH:
        spark.conf.set(BATCH_BYTES, ARROW_BATCH)


def in_arrow(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """`df.mapInArrow` whose workers are sure to find this package, and give back at the end of a task what it took."""
    ship_package(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def checked(df: DataFrame, rows: int | None = None, most: int = SMALL) -> DataFrame:
    """`df` (written, of a few numbers a row) as a side of a join: broadcast if it has `most` rows or fewer, else for a
    merge join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df.hint("merge")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def text_mark(text: Column) -> Column:
    """A 64-bit hash of the text, to tell the rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` without those whose doc_id (null equals null) and text_mark are in `gone` (doc_id, mark)."""
    doc_id, mark = fresh("id"), fresh("mark")
    gone = materialize(gone.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark)).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone[doc_id]) & (text_mark(docs["text"]) == gone[mark])
    return docs.join(checked(gone), same, "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(doc_id: Column, modulus: int = 3) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
