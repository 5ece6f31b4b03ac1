"""What the text operators share: durable intermediate tables and bounded Arrow pieces."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Text that one numpy pass works on at once.
PIECE_BYTES = 1 << 20
#: Intermediate tables of this process, in order.
made: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new place in the folder that driver and executors share."""
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    made.append(path)
    return path


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate folder, wherever Spark's file systems keep it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have (names differ in more than case)."""
    have = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in have:
        out += "_"
    return out


def give_back() -> None:
    """Return freed memory to the system: a reused Python worker else keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped, and gone when freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, whose worker gives freed memory back at its task's start and end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each value begins (n + 1 offsets); null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) else pa.large_string())
    offs = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    lo, hi = int(offs[0]), int(offs[-1])
    return data[lo:hi], offs - lo


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `limit` bytes together (one row at least)."""
    if not batch.num_rows:
        return
    _, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        stop = max(start + 1, stop)
        yield batch.slice(start, stop - start)
        start = stop


def running_total(df: DataFrame, group: list[str], fine: Column, order: list[Column], amount: str, out: str) -> DataFrame:
    """Add `out`, the sum of `amount` over the rows of `group` before this one by (fine, *order).

    No group meets in one task: `fine` is a non-decreasing integer of the order that
    cuts each group into small runs; runs are summed first (with partial sums), their
    offsets are accumulated in a small table, and rows are only ordered within a run.
    """
    cut = df.withColumn("__cut", fine)
    sums = cut.groupBy(*group, "__cut").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col("__cut").alias("__c"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    on = cut["__cut"].eqNullSafe(sums["__c"])
    for c in group:
        on = on & cut[c].eqNullSafe(sums[f"__g_{c}"])
    inner = Window.partitionBy(*group, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(sums, on).drop("__c", *[f"__g_{c}" for c in group])
    return joined.withColumn(out, F.col("__before") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).drop("__before", "__cut")
