"""From links to a weighted, row-normalised transition table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import hub_frequency, row_out_fraction, tag_weight
from ..schema import AUTHOR, TAG, WORK, Graph
from ..session import bucketed, discard, materialize


def _side(nodes: DataFrame, links: DataFrame, hub: str, kind: int) -> DataFrame:
    """(work, hub, down, up): weight from work to hub by the hub's frequency, back by its number of links.

    Links are counted before dangling ones go, and repeated links add weight. They are
    summed where the join with the works has them, so a link is dealt out twice and never
    again in each of its directions.
    """
    many = links.groupBy(F.col(hub).alias("__hub")).agg(F.count("*").alias("n"))  # partial sums: a hub's links never meet in one task
    hubs = nodes.filter(F.col("kind") == kind).select(F.col("id").alias(hub), tag_weight(hub_frequency(F.col("calibratedFreq"), F.col("estimatedFreq"))).alias("down"))
    works = nodes.filter(F.col("kind") == WORK).select(F.col("id").alias("workNodeId"))
    hubs = hubs.join(many, F.col(hub) == F.col("__hub")).select(hub, "down", "n")
    both = links.join(hubs, hub).join(works, "workNodeId").groupBy("workNodeId", hub).agg(F.sum("down").alias("down"), F.sum(1.0 / F.col("n")).alias("up"))
    return both.select(F.col("workNodeId").alias("work"), F.col(hub).alias("hub"), "down", "up")


def _sides(graph: Graph) -> list[DataFrame]:
    """Tags' and authors' links; a tag is no author, so no pair is on both sides."""
    return [_side(graph.nodes, graph.edges, "tagNodeId", TAG), _side(graph.nodes, graph.author_edges, "authorNodeId", AUTHOR)]


def _both_ways(links: DataFrame) -> DataFrame:
    """Both directions of a link come from one row, so the links are joined once."""
    ways = F.explode(F.array(F.struct(F.col("work").alias("src"), F.col("hub").alias("dst"), F.col("down").alias("weight")), F.struct(F.col("hub").alias("src"), F.col("work").alias("dst"), F.col("up").alias("weight"))))
    return links.select(ways.alias("e")).select("e.*")


def adjacency(graph: Graph) -> DataFrame:
    """(src, dst, weight), both directions, parallel links summed."""
    tags, authors = _sides(graph)
    return _both_ways(tags.unionByName(authors))


def stored_adjacency(graph: Graph, large: int) -> tuple[DataFrame, int]:
    """`adjacency` written to the shared folder, and its number of rows.

    A link is written once with both its weights, tags' and authors' one after the other.
    Beyond `large` rows one direction after the other is then dealt out by src into one
    table of buckets, and the links are deleted, so that all joins by src leave it in place.
    """
    sides = [materialize(s, "adj") for s in _sides(graph)]
    links = sides[0].unionByName(sides[1])
    rows = 2 * links.count()
    if rows <= large:
        return _both_ways(links), rows
    down, up = (links.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(w).alias("weight")) for a, b, w in (("work", "hub", "down"), ("hub", "work", "up")))
    adj = bucketed([down, up], "src", "adj")
    for s in sides:
        discard(s)
    return adj, rows


def link_counts(graph: Graph) -> DataFrame:
    """(id, links): how many links each tag and author has."""
    hubs = graph.edges.select(F.col("tagNodeId").alias("id")).unionByName(graph.author_edges.select(F.col("authorNodeId").alias("id")))
    return hubs.groupBy("id").agg(F.count("*").alias("links"))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def with_out_fraction(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """nodes with degree (distinct neighbours) and rho."""
    d = degrees(adj).withColumnRenamed("id", "__id")
    joined = nodes.join(d, nodes["id"] == d["__id"], "left").drop("__id").withColumn("degree", F.coalesce("degree", F.lit(0)))
    freq = hub_frequency(F.col("calibratedFreq"), F.col("estimatedFreq"))
    return joined.withColumn("rho", row_out_fraction(F.col("kind"), F.col("explorationStatus"), freq, F.col("degree")))


def sign_for_negatives(adj: DataFrame, negative: list[int]) -> DataFrame:
    """Weights of links that touch a negative seed, negated."""
    touched = F.col("src").isin(negative) | F.col("dst").isin(negative)
    return adj.withColumn("weight", F.when(touched, -F.col("weight")).otherwise(F.col("weight"))) if negative else adj


def row_factors(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(src, f): what a row's weights are multiplied with, rho over their sum of sizes."""
    per = adj.groupBy("src").agg(F.count("*").alias("degree"), F.sum(F.abs("weight")).alias("total"))
    freq = hub_frequency(F.col("calibratedFreq"), F.col("estimatedFreq"))
    rho = row_out_fraction(F.col("kind"), F.col("explorationStatus"), freq, F.col("degree"))
    return nodes.join(per, F.col("id") == F.col("src")).select("src", F.when(F.col("total") > 0, rho / F.when(F.col("total") > 0, F.col("total"))).otherwise(1.0).alias("f"))


def transitions(nodes: DataFrame, adj: DataFrame, negative: list[int] | None = None, mu: DataFrame | None = None) -> DataFrame:
    """(src, dst, p): weights over their row's sum of sizes, times rho, then times both ends' permeability.

    Permeability (id, mu; absent is 1) comes after normalisation and is not made up for.
    """
    signed = sign_for_negatives(adj, negative or [])
    per = row_factors(nodes, signed).withColumnRenamed("src", "__id")
    p = signed.join(per, signed["src"] == per["__id"]).select("src", "dst", (F.col("weight") * F.col("f")).alias("p"))
    if mu is None:
        return p
    m = mu.filter("mu <> 1")
    for end in ("src", "dst"):
        side = m.select(F.col("id").alias("__m"), F.col("mu").alias("__mu"))
        p = p.join(side, p[end] == side["__m"], "left").select("src", "dst", (F.col("p") * F.coalesce("__mu", F.lit(1.0))).alias("p"))
    return p


def resolve_seeds(nodes: DataFrame, seeds: list[tuple[int, str]]) -> DataFrame:
    """(position, id) of the seeds (kind, key) that exist: works, then tags, then authors; repeats stay."""
    if not seeds:
        return nodes.select(F.lit(0).alias("position"), "id").limit(0)
    spark = nodes.sparkSession
    rows = [(i, k, v) for i, (k, v) in enumerate(sorted(seeds, key=lambda s: s[0]))]
    s = spark.createDataFrame(rows, "position int, skind int, skey string")
    return nodes.join(F.broadcast(s), (F.col("kind") == F.col("skind")) & (F.col("key") == F.col("skey"))).select("position", "id")


def seed_teleport(resolved: DataFrame) -> DataFrame:
    """(id, value): an equal share to each seed, more to one that is named more often."""
    n = resolved.count()
    return resolved.groupBy("id").agg((F.count("*") / F.lit(float(max(n, 1)))).alias("value"))


