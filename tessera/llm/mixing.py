"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_total, settle

_HASH_BITS = 60


def words_in(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(squeezed) - F.length(F.translate(squeezed, "w", ""))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with `target`: budget dealt by weight, no source above `most` times its size.

    Weights repeat over the sources in order of code point, null last. The level at
    which the budget is spent is found over the sources in order of the level at which
    each is full, so what full sources leave is dealt again by weight in one pass.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    by_full = Window.orderBy("__full_at", F.col("source").isNull(), "source")
    ranked = (
        sizes.withColumn("__w", w)
        .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__full_at", F.col("__cap") / F.col("__w"))
        .withColumn("__budget", F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("__cap").over(every)))
        .withColumn("__spent", F.coalesce(F.sum("__cap").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__open", F.sum("__w").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__budget") - F.col("__spent")) / F.col("__open"))
    )
    # The first source in that order which its level does not fill, and all after it, share that level.
    level = F.min_by("__level", F.when(F.col("__level") <= F.col("__full_at"), F.col("__full_at"))).over(every)
    return ranked.withColumn("__at", level).select(
        "source",
        F.when(F.col("__at").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * F.col("__at"))).alias("target"),
    )


def mix(docs: DataFrame, size: str, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, source, `size`, ...) with source_size, target and taken, and the columns `keep`.

    Every source's documents are shuffled by a keyed hash and queued once, and again
    while the target exceeds the source. A document's virtual finish time is the
    source's words up to its end divided by the target. Documents are then taken in
    order of finish time until the total budget is spent; the document that would
    exceed it is not. Ties go by hash, doc_id, size and `keep`. Documents of size 0 are taken
    for nothing (taken 0); a null doc_id or source is a value like any other, but that
    rows of null doc_id are shuffled by their sizes; rows that repeat are documents of
    their own; an empty table gives an empty mix; other columns are left out. The same
    rows give the same mix on any cluster.

    Rows are ordered within about as many runs as a run has rows, so neither a run nor the
    table of the runs' sums is large.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.col(size).cast("string")))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, _HASH_BITS // 4), 16, 10).cast("long")
    held = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select("doc_id", "source", F.col(size).alias("size"), hashed.alias("__h"), *held)
    rows = settle(rows, "mix")
    sizes = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n")), "sizes")
    goal = settle(targets(sizes.select("source", "source_size"), weights, share, most), "targets")
    per = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select(sizes["source"].alias("__s"), "source_size", "target")
    runs = max(1, math.isqrt(rows.count()))
    fine = F.floor(F.col("__h") / F.lit(2.0**_HASH_BITS) * runs)
    queued = running_total(rows, ["source"], fine, [F.col("__h"), F.col("doc_id"), F.col("size"), *map(F.col, kept)], "size", "__start")
    queued = settle(queued.join(per, queued["source"].eqNullSafe(per["__s"])).drop("__s"), "queued")
    # One row for each time a document may be sent; F is 1 where the source has had its target.
    turns = int(-(-most // 1))
    sent = queued.withColumn("__turn", F.explode(F.array(*[F.lit(i) for i in range(turns)])))
    sent = sent.withColumn("__finish", F.try_divide(F.col("__start") + F.col("source_size") * F.col("__turn") + F.col("size"), F.col("target")))
    budget = goal.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("b")).first()["b"]
    # All that finishes by time 1 fits the budget, by the targets; later documents share what is left, in order.
    inside = sent.withColumn("__in", F.col("__finish") <= 1.0)
    spent = inside.agg(F.coalesce(F.sum(F.when(F.col("__in"), F.col("size"))), F.lit(0)).alias("x")).first()["x"]
    edge = sent.filter(F.col("__finish") > 1.0).withColumn("__slot", F.floor(F.log2("__finish") * runs * 4))
    edge = running_total(edge, [], F.col("__slot"), [F.col("__finish"), F.col("source"), F.col("__h"), F.col("doc_id"), F.col("__turn"), F.col("size"), *map(F.col, kept)], "size", "__ahead")
    late = edge.filter(F.col("__ahead") + F.col("size") <= F.lit(float(budget)) - F.lit(float(spent)))
    won = late.groupBy("source", "doc_id", "__h", "size", "__start", *kept).agg(F.count("*").alias("__late"))
    taken = F.lit(0).cast("long")
    for i in range(turns):
        finish = F.try_divide(F.col("__start") + F.col("source_size") * i + F.col("size"), F.col("target"))
        taken = taken + F.when(finish <= 1.0, F.col("size")).otherwise(0)
    q = queued.alias("q")
    v = won.select(*[F.col(c).alias(f"w_{c}") for c in ("source", "doc_id", "size", "__start", "__late", *kept)])
    on = F.col("q.source").eqNullSafe(F.col("w_source")) & F.col("q.doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("q.__start") == F.col("w___start")) & (F.col("q.size") == F.col("w_size"))
    for c in kept:
        on = on & F.col(f"q.{c}").eqNullSafe(F.col(f"w_{c}"))
    return q.join(v, on, "left").select(
        F.col("q.doc_id").alias("doc_id"), F.col("q.source").alias("source"), F.col("q.size").alias("size"), F.col("q.source_size").alias("source_size"), F.col("q.target").alias("target"),
        (taken + F.coalesce(F.col("w___late"), F.lit(0)) * F.col("q.size")).alias("taken"),
        *[F.col(f"q.{a}").alias(c) for a, c in zip(kept, keep)],
    )
