"""Keyed merges: listing states, tag aliases, statistics, graph imports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import merge_status
from ..functions.text import is_redacted, trimmed
from ..plans.numbering import dense_numbers
from ..schema import TAG, WORK, Graph
from ..session import materialize, spread

#: Mergers that a tag's chain is followed through.
LONGEST_CHAIN = 32


def listing_transition(status: Column, known: Column, fetched: Column, count: Column, page: Column, next_page: Column) -> dict[str, Column]:
    """A hub's state after one of its listing pages.

    More works than were known: page 1 again, whatever comes next (a complete hub is
    demoted). Else a next page makes it partial, none complete.
    """
    grew = F.coalesce(count > known, F.lit(False))
    more = next_page.isNotNull()
    return {
        "explorationStatus": F.when(grew | more, "partial").otherwise("complete"),
        "listingNextPage": F.when(grew, 1).otherwise(next_page),
        "listingPagesFetched": F.greatest(fetched, page),
        "calibratedFreq": F.greatest(known, count),
        "demoted": grew & (status == "complete"),
    }


def fold_listings(events: DataFrame) -> DataFrame:
    """Hub states after each of its pages, in order: events (hub, seq, count, page, next_page), hubs unknown before.

    The fold needs no state machine: the count known before a page is the greatest of
    the pages before it, and so is the number of pages; only the last page tells the rest.
    """
    before = Window.partitionBy("hub").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known, fetched = F.max("count").over(before), F.coalesce(F.max("page").over(before), F.lit(0))
    rows = events.withColumns({"known": known, "fetched": fetched})
    status = lambda: F.when(F.coalesce(F.col("count") > F.col("known"), F.lit(False)) | F.col("next_page").isNotNull(), "partial").otherwise("complete")
    rows = rows.withColumn("__status", status())
    rows = rows.withColumn("previous", F.coalesce(F.lag("__status").over(Window.partitionBy("hub").orderBy("seq")), F.lit("unexplored")))
    made = listing_transition(F.col("previous"), F.col("known"), F.col("fetched"), F.col("count"), F.col("page"), F.col("next_page"))
    return rows.select("hub", "seq", *[v.alias(k) for k, v in made.items()])


def alias_roots(tags: DataFrame, chain: int = LONGEST_CHAIN) -> DataFrame:
    """(tag_id, root, hops): where each tag's mergers lead.

    A chain stops before a redacted or missing tag, at a tag it has met, and after
    `chain` mergers. Hops are doubled (1, 2, 4, ... at a time) as far as `chain`, so 32
    take six joins however long the chains are. The least tag of a cycle is the least of
    the tags it leads to; only tags that lead into a cycle are walked step by step.
    """
    good = tags.select("tag_id", "merger_id", is_redacted(F.col("name")).alias("gone"))
    parents = good.filter("not gone").select(F.col("tag_id").alias("p"))
    step = good.filter("not gone and merger_id <> tag_id").join(spread(parents), F.col("merger_id") == F.col("p")).select("tag_id", F.col("p").alias("up"), F.col("p").alias("least"))
    power, rounds = [], (max(1, chain) - 1).bit_length()
    for k in range(rounds + 1):
        step = materialize(step, "alias")
        if not step.limit(1).count():
            break
        power.append(step)
        up = step.select(F.col("tag_id").alias("__t"), F.col("up").alias("__u"), F.col("least").alias("__l"))
        step = step.join(spread(up), step["up"] == up["__t"]).select("tag_id", F.col("__u").alias("up"), F.least("least", "__l").alias("least"))
    ends = tags.select("tag_id", F.col("tag_id").alias("root"), F.lit(0).alias("hops"))
    for k in reversed(range(chain.bit_length())):
        if k < len(power):
            up = power[k].select(F.col("tag_id").alias("__t"), F.col("up").alias("__u"))
            ok = F.col("__u").isNotNull() & (F.col("hops") + (1 << k) <= chain)
            ends = ends.join(spread(up), ends["root"] == up["__t"], "left").select("tag_id", F.when(ok, F.col("__u")).otherwise(F.col("root")).alias("root"), F.when(ok, F.col("hops") + (1 << k)).otherwise(F.col("hops")).alias("hops"))
    if len(power) <= rounds:
        return ends
    into = materialize(power[rounds].filter("least = tag_id").select("tag_id"), "cycles")
    if not into.limit(1).count():
        return ends
    for links in (power[0], *power[:-1]):
        met = into.select(F.col("tag_id").alias("__t"))
        into = materialize(links.join(spread(met), F.col("up") == F.col("__t")).select("tag_id").unionByName(into).distinct(), "cycles")
    walk = into.select("tag_id", F.col("tag_id").alias("root"), F.lit(0).alias("hops"), F.array("tag_id").alias("seen"))
    up = power[0].select(F.col("tag_id").alias("__t"), F.col("up").alias("__u"))
    for _ in range(chain):
        ok = F.col("__u").isNotNull() & ~F.array_contains("seen", F.col("__u"))
        walk = materialize(walk.join(spread(up), walk["root"] == up["__t"], "left").select("tag_id", F.when(ok, F.col("__u")).otherwise(F.col("root")).alias("root"), F.when(ok, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"), F.when(ok, F.array_append("seen", F.col("__u"))).otherwise(F.col("seen")).alias("seen")), "alias")
    return ends.join(spread(walk.select("tag_id")), "tag_id", "left_anti").unionByName(walk.drop("seen"))


def canonical_names(tags: DataFrame) -> DataFrame:
    """(name, canonical, cached_count) of every tag by its chain; a redacted or empty end leaves the name."""
    roots = alias_roots(tags)
    own = tags.select("tag_id", "name")
    ends = tags.select(F.col("tag_id").alias("root"), F.col("name").alias("root_name"), F.col("cached_count").alias("root_count"))
    bad = is_redacted(F.col("root_name")) | (F.col("root_name") == "")
    return own.join(spread(roots), "tag_id").join(spread(ends), "root").select("name", F.when(bad, F.col("name")).otherwise(F.col("root_name")).alias("canonical"), F.col("root_count").alias("cached_count"))


def resolve_names(names: DataFrame, column: str, canonical: DataFrame) -> DataFrame:
    """names with `resolved`: the canonical name of the trimmed one, or that itself; blank names stay as they are."""
    t = trimmed(F.col(column))
    c = canonical.select(F.col("name").alias("__n"), F.col("canonical").alias("__c")).dropDuplicates(["__n"])
    return names.withColumn("__t", t).join(spread(c), F.col("__t") == F.col("__n"), "left").withColumn("resolved", F.when(F.col("__t") == "", F.col(column)).otherwise(F.coalesce("__c", "__t"))).drop("__t", "__n", "__c")


def calibrate(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """nodes whose tags take the greatest count that the statistics have under their name."""
    best = stats.groupBy(F.col("name").alias("__n")).agg(F.max("cached_count").cast("double").alias("__c"))
    is_tag = F.col("kind") == TAG
    return nodes.join(spread(best), is_tag & (F.col("key") == F.col("__n")), "left").withColumn("calibratedFreq", F.when(is_tag, F.greatest("calibratedFreq", "__c")).otherwise(F.col("calibratedFreq"))).drop("__n", "__c")


def _furthest(group: str) -> list[Column]:
    rank = F.array_position(F.array(F.lit("unexplored"), F.lit("partial"), F.lit("complete")), F.col("explorationStatus"))
    return [
        F.max("estimatedFreq").alias("estimatedFreq"), F.max("calibratedFreq").alias("calibratedFreq"), F.max(F.struct(rank.alias("r"), F.col("explorationStatus").alias("s"))).alias("__s"),
        F.max(F.when(F.col("exploredAt") != 0, F.col("exploredAt"))).alias("exploredAt"), F.max("listingPagesFetched").alias("listingPagesFetched"),
    ]


def merge_tags(graph: Graph, canonical: DataFrame) -> tuple[Graph, DataFrame]:
    """Tags that share a canonical name become one; their links move. Also gives (merged), the number of tags changed.

    The tag that already has the name keeps its id (else the least id of the group);
    the greatest frequencies, furthest state and latest time win.
    """
    c = canonical.select(F.col("name").alias("__n"), F.col("canonical").alias("__c"), F.col("cached_count").cast("double").alias("__count")).dropDuplicates(["__n"])
    tags = graph.nodes.filter(F.col("kind") == TAG).join(spread(c), F.col("key") == F.col("__n"), "left").withColumn("__to", F.coalesce("__c", "key")).withColumn("__moved", F.col("__to") != F.col("key"))
    tags = materialize(tags, "tags")
    groups = tags.groupBy("__to").agg(F.min(F.struct(F.col("__moved"), F.col("id"))).alias("__first"), F.max(F.when(F.col("__moved"), F.col("__count"))).alias("__count"), *_furthest("__to"), F.max(F.struct((~F.col("__moved")).alias("a"), F.col("listingNextPage").alias("p"))).alias("__own"), F.max(F.when(F.col("__moved"), F.col("listingNextPage"))).alias("__other"))
    status = F.col("__s.s")
    page = F.when(status == "partial", F.coalesce("__other", F.col("__own.p"))).when(status == "unexplored", F.col("__own.p"))
    keep = groups.select(F.col("__first.id").alias("id"), F.col("__to").alias("key"), "estimatedFreq", F.greatest("calibratedFreq", "__count").alias("calibratedFreq"), status.alias("explorationStatus"), "exploredAt", page.cast("int").alias("listingNextPage"), "listingPagesFetched", (status == "complete").alias("explored"))
    rest = tags.select("id", "kind", "title", "wordCount", "meta")  # from the written table: the nodes are not made, named and dealt out once more
    nodes = graph.nodes.filter(F.col("kind") != TAG).unionByName(keep.join(spread(rest), "id").select(graph.nodes.columns))
    to = tags.join(spread(groups.select("__to", F.col("__first.id").alias("__id"))), "__to").select(F.col("id").alias("tagNodeId"), F.col("__id"))
    edges = graph.edges.join(spread(to), "tagNodeId", "left").select("workNodeId", F.coalesce("__id", "tagNodeId").alias("tagNodeId")).distinct()
    return Graph(nodes, edges, graph.author_edges), tags.agg(F.sum(F.col("__moved").cast("long")).alias("merged"))


@dataclass
class Import:
    """The graph after an import, where each imported node went, and the next free id."""

    graph: Graph
    ids: DataFrame
    next_id: int


def merge_nodes(a: dict[str, Column], b: dict[str, Column], kind: Column) -> dict[str, Column]:
    """Fields of a stored node (a) and an imported one (b) with its key."""
    status = merge_status(a["explorationStatus"], b["explorationStatus"])
    placeholder = b["title"] == F.concat(F.lit("Work "), b["key"])
    real = F.when(~placeholder & (b["title"] != ""), b["title"])
    at = F.greatest(F.coalesce(a["exploredAt"], F.lit(0)), F.coalesce(b["exploredAt"], F.lit(0)))

    def list_of(name: str) -> Column:
        return F.when(F.size(b["meta"][name]) > 0, b["meta"][name]).otherwise(a["meta"][name])

    meta = F.struct(*[F.coalesce(b["meta"][c], a["meta"][c]).alias(c) for c in ("language", "rating", "completionStatus")], *[list_of(c).alias(c) for c in ("archiveWarnings", "fandoms", "categories")])
    both = F.when(a["meta"].isNull(), b["meta"]).when(b["meta"].isNull(), a["meta"]).otherwise(meta)
    return {
        "title": F.when(kind == WORK, F.coalesce(real, a["title"], b["title"])).otherwise(F.coalesce(b["title"], a["title"])),
        "wordCount": F.coalesce(b["wordCount"], a["wordCount"]),
        "estimatedFreq": F.greatest(a["estimatedFreq"], b["estimatedFreq"]),
        "calibratedFreq": F.greatest(a["calibratedFreq"], b["calibratedFreq"]),
        "explorationStatus": status,
        "exploredAt": F.when(at != 0, at),
        "listingNextPage": F.when(status == "partial", F.coalesce(b["listingNextPage"], a["listingNextPage"])).when(status == "unexplored", a["listingNextPage"]),
        "listingPagesFetched": F.greatest(a["listingPagesFetched"], b["listingPagesFetched"]),
        "explored": status == "complete",
        "meta": F.when(kind == WORK, both),
    }


def import_merge(local: Graph, incoming: Graph, next_id: int) -> Import:
    """Incoming nodes join those of their (kind, key) or get new ids in order of their own; links follow."""
    columns = [c for c in local.nodes.columns if c not in ("id", "kind", "key")]
    a = local.nodes.select(F.col("id"), F.col("kind"), F.col("key"), F.struct(*columns).alias("a"))
    b = incoming.nodes.select(F.col("id").alias("other"), F.col("kind").alias("bkind"), F.col("key").alias("bkey"), F.struct("key", *columns).alias("b"))
    both = a.join(b, (a["kind"] == b["bkind"]) & (a["key"] == b["bkey"]), "full_outer")
    both = materialize(both.select("id", "other", F.coalesce("kind", "bkind").alias("kind"), F.coalesce("key", "bkey").alias("key"), "a", "b"), "import")
    fields = lambda s: {c: F.col(f"{s}.{c}") for c in ["key", *columns] if not (s == "a" and c == "key")}
    merged = merge_nodes(fields("a"), fields("b"), F.col("kind"))
    pick = [F.when(F.col("b").isNull(), F.col(f"a.{c}")).when(F.col("a").isNull(), F.col(f"b.{c}")).otherwise(merged.get(c, F.col(f"a.{c}"))).alias(c) for c in columns]
    old = both.filter("id is not null").select("id", "other", "kind", "key", *pick)
    new = dense_numbers(both.filter("id is null").select("other", "kind", "key", *pick), "other", "id", next_id)
    nodes = materialize(old.unionByName(new.select(old.columns)), "import")
    ids = nodes.filter("other is not null").select(F.col("other").alias("old"), F.col("id").alias("new"))

    def moved(edges: DataFrame, hub: str) -> DataFrame:
        w, h = ids.select(F.col("old").alias("ow"), F.col("new").alias("nw")), ids.select(F.col("old").alias("oh"), F.col("new").alias("nh"))
        return edges.join(w, F.col("workNodeId") == F.col("ow")).join(h, F.col(hub) == F.col("oh")).select(F.col("nw").alias("workNodeId"), F.col("nh").alias(hub))

    edges = local.edges.unionByName(moved(incoming.edges, "tagNodeId")).distinct()
    author_edges = local.author_edges.unionByName(moved(incoming.author_edges, "authorNodeId")).distinct()
    top = nodes.agg(F.max("id")).first()[0]
    above = incoming.nodes.agg(F.max("id")).first()[0]
    return Import(Graph(nodes.select(local.nodes.columns), edges, author_edges), ids, max(next_id, (top if top is not None else -1) + 1, (above if above is not None else -1) + 1))


def changed_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id): nodes whose exploredAt is another than before, or that are new."""
    b = before.select("id", F.col("exploredAt").alias("was"), F.lit(True).alias("had"))
    return after.join(b, "id", "left").filter(F.col("had").isNull() | ~F.col("exploredAt").eqNullSafe(F.col("was"))).select("id")
