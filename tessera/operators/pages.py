"""Parsed pages merged into the graph: the same result as one page after another, in set operations.

Every page becomes events on works, tags and authors, numbered by (seq, place). A field's
value is that of the last event that sets it; counters start again at the last reset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import dense_numbers
from ..schema import AUTHOR, TAG, WORK, Graph
from ..session import materialize
from .store import fold_listings, merge_nodes, resolve_names


def _order(*place: Column | str) -> Column:
    """Place of an event: page, then position within the page."""
    return F.struct("seq", *[F.col(p).alias(f"p{i}") if isinstance(p, str) else p.alias(f"p{i}") for i, p in enumerate(place)])


def _last(value: Column, at: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), at))


def page_events(parsed: DataFrame, known_complete: DataFrame) -> dict[str, DataFrame]:
    """works, hubs and links that parsed pages (seq, ...) bring; known_complete (key) are works explored before.

    A listing never takes back what a complete work's own page said, and adds no tags or
    authors to it; whether a work is complete counts from the page before.
    """
    own = parsed.filter("kind = 'work'").select("seq", F.lit(-1).alias("pos"), F.col("workId").alias("key"), "title", "wordCount", "meta", "tags", "authors", F.lit(True).alias("page"), F.lit(None).cast("string").alias("hub"), F.lit(None).cast("int").alias("hubKind"))
    hub = F.when(F.col("kind") == "tag", F.col("tagName")).when(F.col("kind") == "author", F.col("authorKey"))
    kind = F.when(F.col("kind") == "tag", TAG).when(F.col("kind") == "author", AUTHOR)
    listed = parsed.filter("kind <> 'work'").select("seq", hub.alias("hub"), kind.alias("hubKind"), F.posexplode("works").alias("pos", "w")).select("seq", "pos", F.col("w.workId").alias("key"), "w.title", "w.wordCount", "w.meta", "w.tags", "w.authors", F.lit(False).alias("page"), "hub", "hubKind")
    done = known_complete.select(F.col("key").alias("__k")).distinct()
    works = own.unionByName(listed.select(own.columns)).join(done, F.col("key") == F.col("__k"), "left")
    before = Window.partitionBy("key").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, -1)
    works = works.withColumn("frozen", ~F.col("page") & (F.col("__k").isNotNull() | F.coalesce(F.max(F.col("page").cast("int")).over(before) == 1, F.lit(False)))).drop("__k")
    return {"works": works, "hubs": parsed.filter("kind in ('tag', 'author')").select("seq", hub.alias("key"), kind.alias("kind"), F.col("workCount").alias("count"), "page", F.col("nextPage").alias("next_page"), F.col("displayName").alias("title"))}


def merge_pages(graph: Graph, parsed: DataFrame, next_id: int, now: int, canonical: DataFrame | None = None) -> tuple[Graph, int]:
    """The graph after parsed pages in order of `seq`, and the next free id.

    Works, tags and authors are upserted by (kind, key), tags under their canonical
    names; new ones are numbered in order of appearance. A work page completes its work
    and sets its word count even to null; a tag's or author's estimate is 1 after a
    listing and 2 after a work page, and an author page adds 1 for each work it lists.
    """
    old = graph.nodes
    ev = page_events(parsed, old.filter((F.col("kind") == WORK) & (F.col("explorationStatus") == "complete")).select("key"))
    works = materialize(ev["works"], "works")
    at = _order("pos")
    w = works.groupBy("key").agg(
        F.min(at).alias("first"), _last(F.when(~F.col("title").eqNullSafe(F.concat(F.lit("Work "), F.col("key"))), F.col("title")), at).alias("title"), F.max("page").alias("done"),
        _last(F.when(F.col("page") | F.col("wordCount").isNotNull(), F.struct("wordCount")), at).alias("words"), _last(F.col("meta"), at).alias("meta"),
    ).withColumn("kind", F.lit(WORK))

    def touched(column: str, key: Column, title: Column, kind: int) -> DataFrame:
        rows = works.filter("not frozen").select("seq", "pos", F.col("key").alias("work"), "page", F.posexplode(column).alias("place", "x"))
        return rows.select("seq", "pos", "place", "work", key.alias("key"), title.alias("title"), F.lit(kind).alias("kind"), F.lit(True).alias("reset"), F.when(F.col("page"), 2).otherwise(1).alias("value"))

    tags = touched("tags", F.col("x"), F.lit(None).cast("string"), TAG)
    authors = touched("authors", F.col("x.key"), F.col("x.displayName"), AUTHOR)
    bumps = works.filter(F.col("hubKind") == AUTHOR).select("seq", "pos", F.lit(1 << 20).alias("place"), F.lit(None).cast("string").alias("work"), F.col("hub").alias("key"), F.lit(None).cast("string").alias("title"), F.lit(AUTHOR).alias("kind"), F.lit(False).alias("reset"), F.lit(1).alias("value"))
    heads = ev["hubs"].select("seq", F.lit(-1).alias("pos"), F.lit(-1).alias("place"), F.lit(None).cast("string").alias("work"), "key", "title", "kind", F.lit(False).alias("reset"), F.lit(0).alias("value"))
    hub_links = works.filter("hub is not null").select("key", "hub", "hubKind")
    events = tags.unionByName(authors).unionByName(bumps).unionByName(heads)
    if canonical is not None:
        is_tag = F.col("kind") == TAG
        events = resolve_names(events, "key", canonical).withColumn("key", F.when(is_tag, F.col("resolved")).otherwise(F.col("key"))).drop("resolved")
        hub_links = resolve_names(hub_links, "hub", canonical).withColumn("hub", F.when(F.col("hubKind") == TAG, F.col("resolved")).otherwise(F.col("hub"))).drop("resolved")
    events = materialize(events, "events")
    at = _order("pos", "place")
    last_reset = events.filter("reset").groupBy("kind", "key").agg(F.max(F.struct(at.alias("at"), "value")).alias("r"))
    since = events.join(last_reset.select(F.col("kind").alias("lk"), F.col("key").alias("lkey"), "r"), (F.col("kind") == F.col("lk")) & (F.col("key") == F.col("lkey")), "left")
    counted = since.groupBy("kind", "key").agg(F.min(at).alias("first"), F.first("r.value", ignorenulls=True).alias("base"), F.sum(F.when(~F.col("reset") & (F.col("r").isNull() | (at > F.col("r.at"))), F.col("value")).otherwise(0)).alias("more"), _last(F.col("title"), at).alias("title"))

    hubs = ev["hubs"]
    states = old.filter(F.col("kind") != WORK).select(F.col("kind").alias("sk"), F.col("key").alias("skey"), "calibratedFreq", "listingPagesFetched", "explorationStatus")
    start = hubs.select("kind", "key").distinct().join(states, (F.col("kind") == F.col("sk")) & (F.col("key") == F.col("skey"))).select("kind", "key", F.lit(-1).cast("long").alias("seq"), F.col("calibratedFreq").cast("long").alias("count"), F.col("listingPagesFetched").alias("page"), F.lit(None).cast("int").alias("next_page"))
    named = lambda d: d.select(F.concat_ws("\x1f", F.col("kind").cast("string"), "key").alias("hub"), F.col("seq").cast("long").alias("seq"), F.col("count").cast("long").alias("count"), F.col("page").cast("int").alias("page"), F.col("next_page").cast("int").alias("next_page"))
    folded = fold_listings(named(hubs).unionByName(named(start)))
    final = folded.filter("seq >= 0").groupBy("hub").agg(F.max(F.struct("seq", *[F.col(c) for c in ("explorationStatus", "listingNextPage", "listingPagesFetched", "calibratedFreq")])).alias("f")).select(F.split("hub", "\x1f").getItem(0).cast("int").alias("fk"), F.split("hub", "\x1f").getItem(1).alias("fkey"), "f.*")

    change = w.select("kind", "key", "first", "title", "done", "words", "meta", F.lit(None).cast("int").alias("base"), F.lit(None).cast("long").alias("more")).withColumn("first", F.struct(F.col("first.seq").alias("seq"), F.col("first.p0").alias("p0"), F.lit(-1).alias("p1")))
    change = change.unionByName(counted.select("kind", "key", "first", "title", F.lit(False).alias("done"), F.lit(None).cast(change.schema["words"].dataType).alias("words"), F.lit(None).cast(change.schema["meta"].dataType).alias("meta"), "base", "more"))
    both = old.join(change.withColumnsRenamed({c: f"c_{c}" for c in change.columns}), (F.col("kind") == F.col("c_kind")) & (F.col("key") == F.col("c_key")), "full_outer")
    both = both.join(final.withColumnsRenamed({c: f"f_{c}" for c in ("explorationStatus", "listingNextPage", "listingPagesFetched", "calibratedFreq")}), (F.coalesce("kind", "c_kind") == F.col("fk")) & (F.coalesce("key", "c_key") == F.col("fkey")), "left")
    done, is_new, listed = F.coalesce("c_done", F.lit(False)), F.col("id").isNull(), F.col("fk").isNotNull()
    kind = F.coalesce("kind", "c_kind")
    merged = merge_nodes({"meta": F.col("meta"), "title": F.col("title"), **dict.fromkeys(("wordCount", "estimatedFreq", "calibratedFreq", "exploredAt", "listingNextPage", "listingPagesFetched"), F.lit(None)), "explorationStatus": F.lit("partial")}, {"meta": F.col("c_meta"), "title": F.col("c_title"), "key": F.col("c_key"), **dict.fromkeys(("wordCount", "estimatedFreq", "calibratedFreq", "exploredAt", "listingNextPage", "listingPagesFetched"), F.lit(None)), "explorationStatus": F.lit("partial")}, kind)
    status = F.when(done, "complete").when(listed, F.col("f_explorationStatus")).otherwise(F.coalesce("explorationStatus", F.lit("unexplored")))
    fallback = F.when(kind == WORK, F.concat(F.lit("Work "), F.coalesce("key", "c_key")))
    out = both.select(
        "id", kind.alias("kind"), F.coalesce("key", "c_key").alias("key"), F.coalesce("c_title", "title", fallback).alias("title"),
        F.when(F.col("c_words").isNotNull(), F.col("c_words.wordCount")).otherwise(F.col("wordCount")).alias("wordCount"),
        (F.coalesce(F.col("c_base").cast("double"), "estimatedFreq", F.lit(1.0)) + F.coalesce("c_more", F.lit(0))).alias("estimatedFreq"),
        F.when(listed, F.col("f_calibratedFreq").cast("double")).otherwise(F.col("calibratedFreq")).alias("calibratedFreq"), status.alias("explorationStatus"),
        F.when(done | listed, F.lit(now).cast("long")).otherwise(F.col("exploredAt")).alias("exploredAt"), F.when(done, F.lit(None).cast("int")).when(listed, F.col("f_listingNextPage")).otherwise(F.col("listingNextPage")).alias("listingNextPage"),
        F.when(done, 0).when(listed, F.col("f_listingPagesFetched")).otherwise(F.coalesce("listingPagesFetched", F.lit(0))).alias("listingPagesFetched"), (status == "complete").alias("explored"), merged["meta"].alias("meta"), "c_first",
    )
    out = materialize(out, "merged")
    fresh = out.filter("id is null").drop("id")
    order = Window.partitionBy("c_first.seq").orderBy("c_first.p0", "c_first.p1", "kind", "key")
    fresh = fresh.withColumn("__n", F.col("c_first.seq").cast("long") * (1 << 32) + F.row_number().over(order))
    fresh = dense_numbers(fresh, "__n", "id", next_id, 4096).drop("__n")
    nodes = materialize(out.filter("id is not null").unionByName(fresh.select(out.columns)).select(old.columns), "nodes")
    ids = nodes.select("id", "kind", "key")

    def linked(rows: DataFrame, hub_kind: int, name: str) -> DataFrame:
        a = ids.filter(F.col("kind") == WORK).select(F.col("key").alias("work"), F.col("id").alias("workNodeId"))
        b = ids.filter(F.col("kind") == hub_kind).select(F.col("key").alias("hub"), F.col("id").alias(name))
        return rows.join(a, "work").join(b, "hub").select("workNodeId", name)

    def all_links(hub_kind: int, name: str) -> DataFrame:
        own = events.filter((F.col("kind") == hub_kind) & F.col("work").isNotNull()).select("work", F.col("key").alias("hub"))
        shown = hub_links.filter(F.col("hubKind") == hub_kind).select(F.col("key").alias("work"), "hub")
        return linked(own.unionByName(shown).distinct(), hub_kind, name)

    edges = graph.edges.unionByName(all_links(TAG, "tagNodeId")).distinct()
    author_edges = graph.author_edges.unionByName(all_links(AUTHOR, "authorNodeId")).distinct()
    return Graph(nodes, edges, author_edges), next_id + fresh.count()
