"""Helpers that several of the operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the setting, else the context's checkpoint folder.

    Where neither is set a session in one machine's process gets a folder of its own, as in tests; on a cluster that is an error, as
    every executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"{master} needs spark.checkpoint.dir, a folder that the driver and all executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="tallymark-")]
        root = _own[0]
    return root


#: Arrow batches between the JVM and a worker may have so many bytes; Spark's own bound is 64 MB, held several times over by each task.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it holds, plans are made with Arrow batches of BATCH_BYTES at most; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if int(re.sub(r"[bB]$", "", str(before))) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """A fresh folder below the shared one, for tables that cut lineage; Hadoop removes it when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/tallymark-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(where)
        self._fs.deleteOnExit(where)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: the result no longer depends on executors' shuffle files."""
        path = f"{self.path}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` at most (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; nulls count as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def safe_id(name: str = "doc_id"):
    """A document's id as text, empty for null: stable input for hashes."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column of ``df`` has (Spark doesn't mind case)."""
    taken = {c.lower() for c in df.columns}
    number = 0
    while (found := f"{name}_{number}" if number else name).lower() in taken:
        number += 1
    return found


def distinct_rows(rows: DataFrame, work: Workspace, name: str = "repeated") -> DataFrame:
    """``rows`` (id, hash, text) without repetitions. Only rows that occur more than once are grouped, by their whole texts, a copy from each task at most."""
    again = work.write(rows.groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("id_"), F.col("hash").alias("hash_")), name)
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").groupBy("id", "hash", "text").agg(F.lit(1).alias("n")).select("id", "hash", "text"))


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
