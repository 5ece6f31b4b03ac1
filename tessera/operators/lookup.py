"""Keyed reads and updates of the graph tables, in bulk: each is one join or filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import dense_numbers
from ..schema import META, STATES, TAG, WORK, Graph
from ..session import spread
from .store import alias_roots, merge_tags


def nodes_by_key(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes of the pairs (kind, key), each once."""
    wanted = keys.select(F.col("kind").alias("__kind"), F.col("key").alias("__key"))
    return nodes.join(wanted, (F.col("kind") == F.col("__kind")) & (F.col("key") == F.col("__key")), "left_semi")


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_semi")


def links_of(edges: DataFrame, hubs: DataFrame, hub: str = "tagNodeId") -> DataFrame:
    """The links of the hubs (id)."""
    return edges.join(hubs.select(F.col("id").alias(hub)), hub, "left_semi")


def key_ids(nodes: DataFrame, kind: int) -> DataFrame:
    """(key, id) of the nodes of a kind."""
    return nodes.filter(F.col("kind") == kind).select("key", "id")


def stats_by_id(stats: DataFrame, ids: DataFrame) -> DataFrame:
    return stats.join(ids.select("tag_id"), "tag_id", "left_semi")


def stats_by_name(stats: DataFrame, names: DataFrame) -> DataFrame:
    """The statistics' row of each name (name): of several, that of the largest tag_id, which a dump writes last."""
    index = stats.join(names.select("name"), "name", "left_semi").groupBy("name").agg(F.max("tag_id").alias("tag_id"))
    return stats.join(index.select("tag_id"), "tag_id", "left_semi")


def stored_stats(stats: DataFrame, new: DataFrame, graph_names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The statistics with new rows put by tag_id, and the index (name, tag_id), of graph names only if those are given."""
    put = stats.join(spread(new.select("tag_id")), "tag_id", "left_anti").unionByName(new)
    indexed = put.filter("name <> ''")
    if graph_names is not None:
        indexed = indexed.join(spread(graph_names.select(F.col("key").alias("name"))), "name", "left_semi")
    return put, indexed.groupBy("name").agg(F.max("tag_id").alias("tag_id"))


def put_meta(meta: DataFrame, puts: DataFrame) -> DataFrame:
    """Key-value pairs (key, value) after puts (seq, key, value): the last put of a key stays."""
    last = puts.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return meta.join(last.select("key"), "key", "left_anti").select("key", "value").unionByName(last)


def allocated(rows: DataFrame, order: str, next_id: int) -> tuple[DataFrame, int]:
    """rows with dense ids from next_id on, in the order of a unique integer column, and the next free id."""
    n = rows.count()
    return dense_numbers(rows, order, "id", next_id), next_id + n


def explored_by(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """nodes after updates (id, explorationStatus, exploredAt, listingNextPage, listingPagesFetched, calibratedFreq).

    All five fields are set, but a null calibratedFreq leaves the one there was; updates
    of ids that are none of the nodes' change nothing.
    """
    fields = ("explorationStatus", "exploredAt", "listingNextPage", "listingPagesFetched", "calibratedFreq")
    u = updates.select(F.col("id").alias("__id"), F.struct(*fields).alias("__u"))
    joined = nodes.join(u, nodes["id"] == u["__id"], "left")
    hit = F.col("__u").isNotNull()
    new = {c: F.when(hit, F.col(f"__u.{c}")).otherwise(F.col(c)) for c in fields[:-1]}
    new["calibratedFreq"] = F.coalesce(F.col("__u.calibratedFreq"), F.col("calibratedFreq"))
    new["explored"] = F.when(hit, F.col("__u.explorationStatus") == STATES[2]).otherwise(F.col("explored"))
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns])


def marked_explored(nodes: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """nodes of which those of ids (id) are complete since now, with one page fetched."""
    done = ids.select("id", F.lit(STATES[2]).alias("explorationStatus"), F.lit(now).cast("long").alias("exploredAt"), F.lit(None).cast("int").alias("listingNextPage"), F.lit(1).alias("listingPagesFetched"), F.lit(None).cast("double").alias("calibratedFreq"))
    return explored_by(nodes, done.dropDuplicates(["id"]))


def renamed_tags(graph: Graph, names: DataFrame) -> Graph:
    """The graph after tags `name` are called `canonical`: a tag that has that name already takes them in.

    With a column cached_count the tag's calibrated frequency grows to it.
    """
    count = F.col("cached_count") if "cached_count" in names.columns else F.lit(None)
    return merge_tags(graph, names.select("name", "canonical", count.cast("long").alias("cached_count")))[0]


def with_stats_tags(nodes: DataFrame, stats: DataFrame, wanted: DataFrame, next_id: int) -> DataFrame:
    """nodes with a tag for the canonical name of each wanted (tag_id): the one there is takes the count, else a new one."""
    ends = alias_roots(stats).join(spread(wanted.select("tag_id")), "tag_id", "left_semi").select(F.col("root").alias("tag_id")).distinct()
    named = stats.join(spread(ends), "tag_id").groupBy(F.col("name").alias("__n")).agg(F.max("cached_count").cast("double").alias("__c"), F.min("tag_id").alias("__t"))
    is_tag = F.col("kind") == TAG
    kept = nodes.join(spread(named), is_tag & (F.col("key") == F.col("__n")), "left").withColumn("calibratedFreq", F.when(F.col("__n").isNotNull(), F.greatest("calibratedFreq", "__c")).otherwise(F.col("calibratedFreq"))).drop("__n", "__c", "__t")
    fresh = named.join(spread(nodes.filter(is_tag).select(F.col("key").alias("__n"))), "__n", "left_anti").filter(F.col("__n") != "")
    fresh = dense_numbers(fresh, "__t", "id", next_id)
    none = {"title": "string", "wordCount": "long", "exploredAt": "long", "listingNextPage": "int"}
    values = {"kind": F.lit(TAG), "key": F.col("__n"), "estimatedFreq": F.lit(1.0), "calibratedFreq": F.col("__c"), "explorationStatus": F.lit(STATES[0]), "listingPagesFetched": F.lit(0), "explored": F.lit(False), "meta": F.lit(None).cast(META)}
    return kept.unionByName(fresh.select("id", *[v.alias(c) for c, v in values.items()], *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).select(nodes.columns))


def emptied(graph: Graph) -> Graph:
    """The tables without rows."""
    return Graph(graph.nodes.limit(0), graph.edges.limit(0), graph.author_edges.limit(0))


def stored_fields(nodes: DataFrame) -> DataFrame:
    """Nodes as the store keeps them: a missing state by the old flag, missing counters 0, metadata for works only."""
    status = F.coalesce("explorationStatus", F.when(F.col("explored"), STATES[2]).otherwise(STATES[0]))
    new = {"explorationStatus": status, "explored": status == STATES[2], "listingPagesFetched": F.coalesce("listingPagesFetched", F.lit(0)), "meta": F.when(F.col("kind") == WORK, F.col("meta"))}
    return nodes.select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns])


def graph_fields(nodes: DataFrame, page_given: Column | None = None) -> DataFrame:
    """Nodes as the ranking takes them: complete ones without a time have time 1, partial ones whose page was never
    given (`page_given` false) have page 1, and all but unexplored ones have one page fetched at least if none is told."""
    status = F.coalesce("explorationStatus", F.when(F.col("explored"), STATES[2]).otherwise(STATES[0]))
    given = page_given if page_given is not None else F.col("listingNextPage").isNotNull()
    new = {
        "explorationStatus": status, "explored": status == STATES[2],
        "exploredAt": F.coalesce("exploredAt", F.when(status == STATES[2], F.lit(1).cast("long"))),
        "listingNextPage": F.when(given, F.col("listingNextPage")).when(status == STATES[1], 1),
        "listingPagesFetched": F.coalesce("listingPagesFetched", F.when(status == STATES[0], 0).otherwise(1)),
    }
    return nodes.select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns])


def result_titles(works: DataFrame, seeds: DataFrame) -> DataFrame:
    """works (key, title) with the title shown: the graph's unless it only repeats the key, else the seed's (key, title), else whatever there is."""
    s = seeds.groupBy(F.col("key").alias("__k")).agg(F.max("title").alias("__s"))
    bare = F.concat(F.lit("Work "), F.col("key"))
    real = lambda c: F.when((c != "") & (c != bare), c)
    joined = works.join(s, F.col("key") == F.col("__k"), "left")
    return joined.withColumn("title", F.coalesce(real(F.col("title")), real(F.col("__s")), F.col("title"), bare)).drop("__k", "__s")


def displayed(results: DataFrame, suppressed: DataFrame, most: int) -> DataFrame:
    """The first `most` of ranked results (rank, key, ...) whose keys are not suppressed (key)."""
    return results.join(suppressed.select("key"), "key", "left_anti").orderBy("rank").limit(most)
