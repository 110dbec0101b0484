"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every fifth document by checksum is held out; models learn from the others only.
FOLDS = 5
#: Tables of at most so many rows, which are narrow (keys and numbers), are sent to every task.
BROADCAST_ROWS = 500_000
#: Bytes of texts of an Arrow batch that become Python strings together.
TEXT_BYTES = 1 << 20
#: Rows of an Arrow batch between a task and its Python worker: whole texts, so fewer than the default of 10,000.
ARROW_ROWS = 1_000
#: A key of a join that more rows bear than this is not left to one task.
HEAVY_ROWS = 10_000


#: Folders that ``written`` has made in this process.
_paths: list[str] = []


def clean(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` has made in this process, when their results have been read; how many there were."""
    n = len(_paths)
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def checkpoint_root(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="maskforge-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The copy cuts the lineage, is computed once, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/maskforge-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``ARROW_ROWS``, if they are more: a batch is held whole on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that was freed to the system; workers live on from stage to stage and would keep their largest need."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in column ``at`` have about ``TEXT_BYTES`` together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    first = 0
    while first < batch.num_rows:
        upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TEXT_BYTES, side="right")))
        yield batch.slice(first, upto - first)
        first = upto
    give_back()


def hinted(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df`` to be sent to every task if it has at most ``BROADCAST_ROWS`` rows, a row counting ``weight`` (default 1); counted first, so give a written one."""
    size = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def joined_by_weight(rows: DataFrame, keyed: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join with a written table of unique keys that has in ``n`` how many of ``rows`` bear each key (n gives way).

    A small table is sent to every task. Of a larger one only the heaviest keys
    are, so that no hot key lands in one task; the others are joined by a shuffle, at most
    ``heavy`` rows a key. Keys must not be null.
    """
    if keyed.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed.drop(n)), on)
    heavy = HEAVY_ROWS
    while (top := keyed.where(F.col(n) > heavy)).count() > BROADCAST_ROWS:
        heavy *= 2
    light = rows.join(F.broadcast(top.select(*on)), on, "left_anti").join(keyed.where(F.col(n) <= heavy).drop(n), on)
    return rows.join(F.broadcast(top.drop(n)), on).unionByName(light)


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text is divisible by ``FOLDS``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, whose texts go to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
