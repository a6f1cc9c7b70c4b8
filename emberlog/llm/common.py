"""What the operators share: spooling, word patterns, Arrow batches in slices."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import _spooled, spool

#: Words by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The operator at work in this Python worker, and what lets go of what it remembers.
_at_work: list = [None, lambda: None]


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _spooled.discard(at)


def unspool(df: DataFrame) -> None:
    """Deletes what spool() has written for df, once nothing reads it any more."""
    _delete(df.sparkSession, df.spooled)


def sweep(spark: SparkSession, *keep: DataFrame) -> None:
    """Deletes all tables that spool() has written but those of ``keep``. Results that still read the others are lost."""
    for path in sorted(_spooled - {df.spooled for df in keep}):
        _delete(spark, path)


def running(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df with ``place`` (from 1, in a total order) and, for each name of ``sums``, the sum of its column over the rows before.

    Rows are dealt by ranges and numbered inside them; only one row per range goes through a single task.
    """
    rows = spool(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    each = rows.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    earlier, zero = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    bases = each.select("_range", *[F.coalesce(F.sum(c).over(earlier), zero).alias(c) for c in ("_n", *(f"_{k}" for k in sums))])
    own = Window.partitionBy("_range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(F.broadcast(bases), "_range").withColumn("place", F.row_number().over(own) + F.col("_n"))
    return found.withColumns({k: F.coalesce(F.sum(c).over(before), zero) + F.col(f"_{k}") for k, c in sums.items()}).drop("_range", "_n", *(f"_{k}" for k in sums))


def split_join(left: DataFrame, right: DataFrame, key: str, hot: Column) -> DataFrame:
    """left joined to right by ``key``, which is unique in right. The rows of right that are ``hot`` are broadcast, so that many rows of left with
    one key stay where they are; the caller proves that hot rows are few."""
    few, many = F.broadcast(right.filter(hot)), right.filter(~hot)
    return left.join(few, key).unionByName(left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(many, key))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def at_work(name: str, forget: Callable[[], None]) -> None:
    """Called where an operator's tasks begin. A Python worker outlives its tasks and serves one operator after the other,
    so what the last one has remembered in it is let go here, and freed memory returned."""
    if _at_work[0] == name:
        return
    _at_work[1]()
    _at_work[:] = [name, forget]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_slices(fn: Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch], schema: pa.Schema, rows: int = 256) -> Callable:
    """For mapInArrow: calls fn on columns of at most ``rows`` rows, so that few texts are Python objects at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows).to_pydict())
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` rows and, but for a single long text, ``size`` bytes in the column ``text``."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            n = max(1, min(rows, int(np.searchsorted(ends, done + size, side="right")) - at))
            yield batch.slice(at, n)
            done, at = int(ends[at + n - 1]), at + n


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - (1 << 64) if x >> 63 else x
