"""Pages merged in one go; and a search over a small world; and the stream."""

import pandas as pd

from tessera.operators.pages import merge_pages
from tessera.plans.corpus import Mulberry, Shape, community_graph
from tessera.plans.discovery import POLICIES, Fog, fog_search, run_search
from tessera.plans.query_search import Candidates, State, leaf_score, search
from tessera.operators.adjacency import resolve_seeds
from tessera.operators.propagation import Params
from tessera.schema import Graph
from tessera.sources.html import PAGE_DDL
from tessera.streaming.ingest import fold
from tests.test_graph import graph, node


def blurb(i, tags=(), authors=(), words=None):
    return {"workId": str(i), "title": f"T{i}", "tags": list(tags), "authors": [{"key": a, "displayName": a.upper()} for a in authors], "wordCount": words, "meta": None}


def test_merge_pages(spark):
    g = graph(spark, [node(0, 0, "1", words=9, status="complete"), node(1, 1, "x", est=7.0)], [(0, 1)])
    pages = [
        {"seq": 0, "kind": "tag", "tagName": "x", "workCount": 30, "page": 1, "nextPage": 2, "works": [blurb(1, ["no"], ["no"], 5), blurb(2, ["y"], ["ann"], 50)]},
        {"seq": 1, "kind": "work", "workId": "2", "title": "Two", "tags": ["y", "z"], "authors": [{"key": "ann", "displayName": "Ann"}], "wordCount": None},
        {"seq": 2, "kind": "author", "authorKey": "bob", "displayName": "Bob", "workCount": 2, "page": 1, "nextPage": None, "works": [blurb(2, ["late"]), blurb(3, ["y"], ["bob"])]},
    ]
    parsed = spark.createDataFrame(pages, f"seq long, {PAGE_DDL}")
    out, next_id = merge_pages(g, parsed, 2, 99)
    n = {(r["kind"], r["key"]): r for r in out.nodes.collect()}
    assert sorted(n) == [(0, "1"), (0, "2"), (0, "3"), (1, "x"), (1, "y"), (1, "z"), (2, "ann"), (2, "bob")] and next_id == 8 and sorted(r["id"] for r in n.values()) == list(range(8))
    assert n[0, "1"]["wordCount"] == 5 and n[0, "1"]["explorationStatus"] == "complete" and n[0, "2"]["wordCount"] is None and n[0, "2"]["title"] == "T2"
    assert n[0, "2"]["explorationStatus"] == "complete" and n[0, "3"]["explorationStatus"] == "unexplored"
    assert (n[1, "x"]["estimatedFreq"], n[1, "x"]["calibratedFreq"], n[1, "x"]["explorationStatus"], n[1, "x"]["listingNextPage"]) == (7, 30, "partial", 2)
    assert n[1, "y"]["estimatedFreq"] == 1 and n[1, "z"]["estimatedFreq"] == 2 and n[2, "ann"]["estimatedFreq"] == 2 and n[2, "ann"]["title"] == "Ann"
    assert n[2, "bob"]["estimatedFreq"] == 2 and n[2, "bob"]["explorationStatus"] == "complete" and n[2, "bob"]["calibratedFreq"] == 2
    key = {r["id"]: r["key"] for r in n.values()}
    assert sorted((key[r[0]], key[r[1]]) for r in out.edges.collect()) == [("1", "x"), ("2", "x"), ("2", "y"), ("2", "z"), ("3", "y")]
    assert sorted((key[r[0]], key[r[1]]) for r in out.author_edges.collect()) == [("2", "ann"), ("2", "bob"), ("3", "bob")]


def test_best_first_search():
    nodes = {i: {"id": i, "kind": k, "key": f"n{i}", "explorationStatus": "partial", "listingNextPage": 3} for i, k in ((1, 0), (4, 1), (6, 1), (7, 2))}
    c = Candidates([7, 1], [4, 6], [4, 6], {1: 1.0, 4: 9.0, 6: 3.0, 7: 2.0}, nodes)
    assert leaf_score(State(include=(4, 6)), c.fragility) == 6 and leaf_score(State(bound=4, include=(6,)), c.fragility) == 9
    got = search(c, {"n4": "Fandom"})
    assert got.plan["type"] == "worksSearch" and got.plan["params"].fandom_names == ["n4"] and got.score == 9
    assert search(c, max_nodes=0).plan == {"type": "authorListing", "key": "n7", "page": 1, "marks": 7}
    assert search(Candidates([], [], [], {}, {})).plan is None


def test_search_over_fog(spark):
    world = community_graph(spark, Shape(2, 8, 4, 2, 2, 2))
    assert world.nodes.filter("kind = 0").count() == 18
    assert [Mulberry(42)() for _ in range(2)] == [Mulberry(42)() for _ in range(2)]
    start = resolve_seeds(world.nodes, [(0, "0")])
    fog = [Fog.around(world, start)]

    def fetch(g: Graph, plan: dict) -> Graph:
        fog[0] = fog[0].expand(world.nodes.filter(world.nodes["id"] == plan.get("marks", -1)).select("id"))
        return fog[0].view()

    sizes = fog[0].visible.count()
    for policy in POLICIES:
        steps = list(run_search(fog[0].view(), [(0, "0")], [], fetch, policy, budget=1, params=Params(0.15, 5, 1e-6), force=True))
        assert [s.phase for s in steps] == ["expanding", "done"] and all(r["key"] != "0" for r in steps[-1].results)
    assert fog[0].visible.count() > sizes
    steps = list(run_search(world, [(0, "none")], [], fetch, "expected-info", budget=2))
    assert [s.phase for s in steps] == ["error", "done"] and len(steps[-1].results) == 18
    ranked, made = fog_search(world, (0, "0"), 1, params=Params(0.15, 5, 1e-6))
    assert made == 0 and ranked.count() > 0


def test_stream_matches_fold(spark, tmp_path):
    from tessera.operators.store import fold_listings
    from tessera.streaming.ingest import LISTING_EVENT, hub_states, ingest, page_stream

    rows = [(h, s, c, p, n) for h in (1, 2) for s, (c, p, n) in enumerate([(10, 1, 2), (10, 2, None), (12, 1, None), (5, 3, 4)])]
    for k in (0, 1):
        pd.DataFrame([r for r in rows if r[1] // 2 == k], columns=["hub", "seq", "count", "page", "next_page"]).astype({"page": "int32", "next_page": "Int32"}).to_parquet(tmp_path / f"in{k}.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(LISTING_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*.parquet"))
    hub_states(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("select hub, seq, explorationStatus, listingNextPage, listingPagesFetched, calibratedFreq, demoted from states").collect())
    want = sorted(tuple(r) for r in fold_listings(spark.createDataFrame(rows, LISTING_EVENT)).collect())
    assert got == want and [w[2] for w in want[:4]] == ["partial", "complete", "partial", "partial"] and want[2][6] is True
    assert fold(("unexplored", None, 0), None, 1, None) == (("complete", None, 1), None, False)
    seen = []
    pages = tmp_path / "pages"
    spark.createDataFrame([(1, "https://x.org/works/5", "<h2 class=title>T</h2>")], "page_id long, url string, html string").write.parquet(str(pages))
    ingest(page_stream(spark, str(pages)), lambda d, n: seen.extend(d.select("workId", "title").collect()), str(tmp_path / "cp2")).awaitTermination()
    assert [tuple(r) for r in seen] == [("5", "T")]


def test_plain_pages_are_cut_without_the_library_into_the_same_tree():
    from tessera.sources import html as H

    def library(text):
        b = H._Builder()
        b.feed(text)
        b.close()
        return b.root

    def shape(n):
        parts = []
        for c in n.children:
            if isinstance(c, str) and parts and isinstance(parts[-1], str):
                parts[-1] += c
            else:
                parts.append(c if isinstance(c, str) else shape(c))
        return n.tag, n.attrs, parts

    plain = ['<!DOCTYPE html><title>a &amp; b</title><ol class="work index group"><li class="work blurb"><p>x<p>y<br/>z</li><li CLASS="A b">&lt;é</li></ol></b>tail', '<dl><dt>a<dd class="words">1<dd>2</dl><!-- no --><script>x&amp;</script><a href="?a=1&amp;b=2&copy=3">t</a>']
    other = ["<a href=x>t</a>", "<script>if (a<b) c()</script><p>d", "a < b", "<p", "<!-- a -- b --><i>c</i>", '<aİ b="1">c']
    for text in plain + other:
        assert shape(H.tree(text)) == shape(library(text))
    assert all(H.plain_tree(t) is not None for t in plain) and all(H.plain_tree(t) is None for t in other)


def test_listings_of_one_small_file_are_parsed_in_many_tasks(spark, tmp_path):
    from tessera.catalog_store import QUERIES

    spark.createDataFrame([(i, f"n{i}", "Brand#1", "T", 3) for i in range(200)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["html_listings"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.count() == 200
