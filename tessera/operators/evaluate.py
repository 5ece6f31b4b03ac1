"""Ranking quality and partial observability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Graph
from ..session import materialize


def ndcg(predicted: DataFrame, gains: DataFrame, ks: list[int], group: list[str] | None = None) -> DataFrame:
    """(group.., k, ndcg) of predicted (group.., key, rank from 1) against gains (group.., key, gain); 0 where all gains are 0."""
    group = group or []
    most = max(ks)
    got = predicted.filter(F.col("rank") <= most).join(gains.filter("gain > 0"), [*group, "key"]).select(*group, "rank", "gain")
    order = Window.partitionBy(*group).orderBy(F.desc("gain"), "key")
    best = gains.filter("gain > 0")
    best = (best.orderBy(F.desc("gain"), "key").limit(most) if not group else best).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    discounted = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"k{k}")
    a, b = (x.groupBy(*group).agg(*[discounted(k) for k in ks]) for x in (got, best))
    a, b = a.withColumnsRenamed({f"k{k}": f"a{k}" for k in ks}), b.withColumnsRenamed({f"k{k}": f"b{k}" for k in ks})
    if group:
        both = b.join(a, group, "left")
    else:
        both = b.withColumn("__one", F.lit(1)).join(a.withColumn("__one", F.lit(1)), "__one", "left")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(f"b{k}") > 0, F.coalesce(f"a{k}", F.lit(0.0)) / F.col(f"b{k}")).otherwise(0.0).alias("ndcg")) for k in ks]))
    return both.select(*group, cells.alias("c")).select(*group, "c.k", "c.ndcg")


def report(cells: DataFrame) -> DataFrame:
    """Means over cells (seed, depth, ndcg) by depth, and over all cells (depth null)."""
    return cells.groupBy("depth").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("cells")).unionByName(cells.agg(F.lit(None).cast("int").alias("depth"), F.avg("ndcg").alias("ndcg"), F.count("*").alias("cells")))


def bfs_distances(adj: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(id, distance) of all nodes that links reach from start (id), up to `most` hops."""
    links = adj.select("src", "dst")
    reached = materialize(start.select("id").distinct().withColumn("distance", F.lit(0)), "bfs")
    edge, d = reached, 0
    while most is None or d < most:
        d += 1
        near = links.join(edge.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        edge = materialize(near.join(reached, "id", "left_anti").withColumn("distance", F.lit(d)), "bfs")
        if not edge.limit(1).count():
            break
        reached = materialize(reached.unionByName(edge), "bfs")
    return reached


def visible_subgraph(graph: Graph, visible: DataFrame, explored: DataFrame) -> Graph:
    """What an observer sees: nodes of visible (id), links with both ends among them, status by explored (id)."""
    ids = visible.select("id").distinct()
    seen = explored.select(F.col("id").alias("__e")).distinct()
    nodes = graph.nodes.join(ids, "id", "left_semi").join(seen, F.col("id") == F.col("__e"), "left")
    done = F.col("__e").isNotNull()
    nodes = nodes.withColumn("explorationStatus", F.when(done, "complete").otherwise("unexplored")).withColumn("explored", done).withColumn("exploredAt", F.when(done, F.coalesce("exploredAt", F.lit(1)))).drop("__e")

    def both(edges: DataFrame, hub: str) -> DataFrame:
        return edges.join(ids.withColumnRenamed("id", "workNodeId"), "workNodeId", "left_semi").join(ids.withColumnRenamed("id", hub), hub, "left_semi").select("workNodeId", hub)

    return Graph(nodes, both(graph.edges, "tagNodeId"), both(graph.author_edges, "authorNodeId"))


def depth_ball(graph: Graph, adj: DataFrame, start: DataFrame, radius: int) -> Graph:
    """The graph within `radius` hops of start; nodes nearer than that are explored."""
    d = bfs_distances(adj, start, radius)
    return visible_subgraph(graph, d.select("id"), d.filter(F.col("distance") < radius).select("id"))


def warm_pairs(seeds: DataFrame) -> DataFrame:
    """(position, id, next): each seed with the one after it, the last with the first."""
    order = Window.orderBy("position")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return seeds.withColumn("next", F.coalesce(F.lead("id").over(order), F.first("id").over(whole)))
