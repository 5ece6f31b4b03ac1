"""Schemas of the graph tables, always given to readers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WORK, TAG, AUTHOR = 0, 1, 2
#: Exploration states in ascending order.
STATES = ("unexplored", "partial", "complete")

META = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("language", "rating", "completionStatus")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("archiveWarnings", "fandoms", "categories")]
)
NODE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("kind", T.IntegerType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("wordCount", T.LongType()),
    T.StructField("estimatedFreq", T.DoubleType()),
    T.StructField("calibratedFreq", T.DoubleType()),
    T.StructField("explorationStatus", T.StringType()),
    T.StructField("exploredAt", T.LongType()),
    T.StructField("listingNextPage", T.IntegerType()),
    T.StructField("listingPagesFetched", T.IntegerType()),
    T.StructField("explored", T.BooleanType()),
    T.StructField("meta", META),
])
EDGE = T.StructType([T.StructField("workNodeId", T.LongType(), False), T.StructField("tagNodeId", T.LongType(), False)])
AUTHOR_EDGE = T.StructType([T.StructField("workNodeId", T.LongType(), False), T.StructField("authorNodeId", T.LongType(), False)])
STATS_TAG = T.StructType([
    T.StructField("tag_id", T.LongType(), False),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("canonical", T.BooleanType()),
    T.StructField("cached_count", T.LongType()),
    T.StructField("merger_id", T.LongType()),
])


@dataclass
class Graph:
    """Works, tags and authors with their links; every operator takes and gives these three tables."""

    nodes: DataFrame
    edges: DataFrame
    author_edges: DataFrame
