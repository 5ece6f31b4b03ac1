"""Connected components of a link table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Links that a task joins at once before any exchange.
HELD = 1 << 20


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a piece of the table as stars around the least node of each of its components."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            while not np.array_equal(new, new[new]):
                new = new[new]
            new = new[label]
            if np.array_equal(new, label):
                break
            label = new
        out = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[out]]), pa.array(nodes[out])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= HELD:
            yield stars(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if size:
        yield stars(*(np.concatenate(x) for x in zip(*held)))


def label_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label) of every node that has a link: label is the least node it reaches.

    Each task first reduces its links to stars. Then, in rounds, every node points to
    the least of its neighbours and itself, by number in two rounds and by a new
    random order in each third (so that chains shrink by a share each time, whatever
    their numbering), and links are moved to what their ends point to, until none is
    left. Minima are partial sums, so a node with very many links is no hot key.
    """
    spark = links.sparkSession
    left = materialize(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").mapInArrow(_local_forest, "a long, b long"), "links")
    start, turns, k = left, [], 0
    while left.limit(1).count():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.col(c)) if k % 3 < 2 else (lambda c, k=k: F.xxhash64(c, F.lit(k)))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("n"))).alias("m"))
        to = best.select(F.col("a").alias("node"), F.when(F.struct(rank("a").alias("r"), F.col("a").alias("n")) < F.col("m"), F.col("a")).otherwise(F.col("m.n")).alias("up"))
        to = materialize(to, "up")
        turns.append(to)
        moved = left.join(to, left["a"] == to["node"]).select(F.col("up").alias("a"), "b")
        moved = moved.join(to, moved["b"] == to["node"]).select("a", F.col("up").alias("b")).filter("a <> b")
        left = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().mapInArrow(_local_forest, "a long, b long"), "links")
        k += 1
    nodes = start.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = nodes.withColumn("root", F.col("node"))
    for to in turns:
        up = to.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
        at = at.join(up, at["root"] == up["__n"], "left").select("node", F.coalesce("__u", "root").alias("root"))
    if len(turns) > 1:
        at = materialize(at, "roots")
    least = at.groupBy("root").agg(F.min("node").alias("label")).withColumnRenamed("root", "__r")
    return at.join(least, at["root"] == least["__r"]).select("node", "label")
