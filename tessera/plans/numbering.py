"""Dense numbers in a given order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, run: Column, order: list[Column], out: str, start: int | Column = 0) -> DataFrame:
    """Number rows start, start + 1, ... by (run, *order).

    `run` is a non-decreasing integer of the order that cuts it into pieces; pieces are
    counted, their counts accumulated in a small table, and rows numbered within theirs.
    """
    cut = df.withColumn("__run", run)
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("__run").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = Window.partitionBy("__run").orderBy(*order)
    base = start if isinstance(start, Column) else F.lit(start)
    return cut.join(counts.drop("__n"), "__run").withColumn(out, (base + F.col("__before") + F.row_number().over(own) - 1).cast("long")).drop("__run", "__before")


def dense_numbers(df: DataFrame, key: str, out: str, start: int | Column = 0, runs: int = 256) -> DataFrame:
    """`numbered` by the integer column `key` (unique), cut into `runs` ranges of equal width."""
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if span["lo"] is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    width = max(1, -(-(span["hi"] - span["lo"] + 1) // runs))
    return numbered(df, F.floor((F.col(key) - F.lit(span["lo"])) / width), [F.col(key)], out, start)
