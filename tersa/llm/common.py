"""What the operators of this subpackage share: shared-folder tables, counts, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one block of rows may hold before a worker handles it.
BLOCK_BYTES = 2 << 20


#: Keys that ``spread_join`` broadcasts at most.
HOT_KEYS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a session whose driver and executors are one process gets a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tersa-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this runs the plan a single time, and the rows outlive the
    executors that made them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tersa-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tersa_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files of a ``materialize``d table that no later plan reads."""
    path = getattr(df, "_tersa_path", None)
    if path:
        delete(df.sparkSession, path)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def carry(docs: DataFrame, keep: list[str] | None = None, **own: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` of the kept columns (default: all) beside ``own`` ones, so that no names can clash."""
    keep = docs.columns if keep is None else keep
    row = F.struct(*map(column, keep)) if keep else F.struct(F.lit(True).alias("_"))
    return docs.select(row.alias("row"), *(c.alias(name) for name, c in own.items()))


def carried(keep: list[str]) -> list[Column]:
    """The columns that ``carry`` packed, by their names."""
    return [F.col("row").getField(c).alias(c) for c in keep]


def spread_join(rows: DataFrame, small: DataFrame, key: str, n: str, total: int, how: str = "inner", least: int = 256) -> DataFrame:
    """``rows`` joined on ``key`` to ``small``, which holds a row per key and in ``n`` how many of the ``total`` rows have it.

    Keys with more than ``total / HOT_KEYS`` rows (and ``least``) are HOT_KEYS at most: they are broadcast,
    and their rows stay where they are. Both sides are read twice and should be materialized.
    """
    limit = max(least, -(-total // HOT_KEYS))
    hot, cold = small.where(F.col(n) > limit).drop(n), small.where(F.col(n) <= limit).drop(n)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    names = [c for c in small.columns if c not in (key, n)]
    return marked.where("_hot").drop("_hot").unionByName(marked.where("_hot is null").drop("_hot", *names).join(cold, key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give back what a worker no longer uses: workers live on, and several share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def blocks(batches, text_column: str, limit: int = BLOCK_BYTES):
    """Cut Arrow batches into slices of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(text_column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            pa.default_memory_pool().release_unused()
    trim()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(values, "").to_pylist()


def ragged(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from values laid end to end."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start..start+length of every pair, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)
