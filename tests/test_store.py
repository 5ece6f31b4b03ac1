"""Merges, aliases, sources and scalars on small rows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from tessera.functions import text as TX
from tessera.functions import urls as U
from tessera.operators import store as S
from tessera.schema import Graph
from tessera.session import materialize
from tessera.sources import graph_json as J
from tessera.sources import html as H
from tessera.sources.stats_csv import content_tags, parse_lines
from tests.test_graph import graph, node


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("known,count,following,status,want", [(None, 18, None, "unexplored", ("complete", None, False)), (None, 100, 2, "unexplored", ("partial", 2, False)), (40, 55, None, "complete", ("partial", 1, True)), (40, 40, None, "complete", ("complete", None, False)), (40, 55, 3, "partial", ("partial", 1, False))])
def test_listing_transition(spark, known, count, following, status, want):
    d = spark.createDataFrame([(status, known, 1, count, 2, following)], "s string, k long, f int, c long, p int, n int")
    t = S.listing_transition(*[F.col(c) for c in "skfcpn"])
    r = d.select(t["explorationStatus"].alias("a"), t["listingNextPage"].alias("b"), t["demoted"].alias("c")).first()
    assert tuple(r) == want


def test_alias_chains(spark):
    rows = [(i, f"t{i}", i - 1 if i else None) for i in range(60)] + [(100, "a", 101), (101, "b", 100), (102, "c", 100), (110, "d", 111), (111, "Redacted", None), (112, "e", 999), (113, "f", 113)]
    tags = spark.createDataFrame(rows, "tag_id long, name string, merger_id long")
    got = {r["tag_id"]: (r["root"], r["hops"]) for r in S.alias_roots(tags).collect()}
    assert got[0] == (0, 0) and got[31] == (0, 31) and got[32] == (0, 32) and got[45] == (13, 32) and got[59] == (27, 32)
    assert got[100] == (101, 1) and got[101] == (100, 1) and got[102] == (101, 2)  # cycles end where they would repeat
    assert got[110] == (110, 0) and got[112] == (112, 0) and got[113] == (113, 0)


def test_long_alias_chains_take_few_joins_and_no_broadcast(spark, monkeypatch):
    written = []
    monkeypatch.setattr(S, "materialize", lambda df, what="step": written.append(what) or materialize(df, what))
    n = 5000
    tags = spark.range(n).select(F.col("id").alias("tag_id"), F.concat(F.lit("t"), "id").alias("name"), F.when(F.col("id") > 0, F.col("id") - 1).alias("merger_id"))
    ring = spark.range(10_000, 10_040).select(F.col("id").alias("tag_id"), F.concat(F.lit("r"), "id").alias("name"), (10_000 + (F.col("id") - 9_999) % 40).alias("merger_id"))
    loop = spark.createDataFrame([(20_000 + i, f"l{i}", 20_000 + (i + 1 if i < 34 else 30)) for i in range(35)], "tag_id long, name string, merger_id long")
    roots = S.alias_roots(tags.unionByName(ring))
    assert len(written) <= 7 and "Broadcast" not in roots._jdf.queryExecution().executedPlan().toString()
    got = {r["tag_id"]: (r["root"], r["hops"]) for r in roots.collect()}
    assert all(got[i] == (max(0, i - 32), min(i, 32)) for i in range(n)) and got[10_000] == (10_032, 32) and got[10_020] == (10_012, 32)
    got = {r["tag_id"]: (r["root"], r["hops"]) for r in S.alias_roots(tags.unionByName(loop)).collect()}
    assert got[20_000] == (20_032, 32) and got[20_002] == (20_034, 32) and got[20_003] == (20_034, 31) and got[20_030] == (20_034, 4) and got[20_032] == (20_031, 4) and got[4_999] == (4_967, 32)


def test_tag_merge_keeps_the_canonical_node(spark):
    g = graph(spark, [node(1, 0), node(2, 0), node(3, 1, "Synonym", est=4.0, status="complete", at=5), node(4, 1, "Canonical", est=2.0), node(5, 1, "Other")], [(1, 3), (2, 4), (1, 4), (2, 5)])
    canonical = spark.createDataFrame([("Synonym", "Canonical", 9)], "name string, canonical string, cached_count long")
    merged, n = S.merge_tags(g, canonical)
    assert n.first()["merged"] == 1
    tags = {r["id"]: r for r in merged.nodes.filter("kind = 1").collect()}
    assert sorted(tags) == [4, 5] and tags[4]["estimatedFreq"] == 4 and tags[4]["calibratedFreq"] == 9 and tags[4]["explorationStatus"] == "complete"
    assert sorted(map(tuple, merged.edges.collect())) == [(1, 4), (2, 4), (2, 5)]


def test_import_merge(spark):
    local = graph(spark, [node(0, 0, "100", words=5), node(1, 1, "fluff"), node(2, 1, "local-only")], [(0, 1), (0, 2)])
    other = graph(spark, [node(7, 0, "100", est=3.0, status="partial", at=9), node(8, 1, "fluff"), node(9, 2, "ann")], [(7, 8)], [(7, 9)])
    out = S.import_merge(local, other, 3)
    rows = {(r["kind"], r["key"]): r for r in out.graph.nodes.collect()}
    assert {k: r["id"] for k, r in rows.items()} == {(0, "100"): 0, (1, "fluff"): 1, (1, "local-only"): 2, (2, "ann"): 3}
    assert rows[0, "100"]["wordCount"] == 5 and rows[0, "100"]["estimatedFreq"] == 3 and rows[0, "100"]["explorationStatus"] == "partial" and rows[0, "100"]["exploredAt"] == 9
    assert out.graph.edges.count() == 2 and [tuple(r) for r in out.graph.author_edges.collect()] == [(0, 3)] and out.next_id == 10


def test_json_round_trip_and_faults(spark):
    g = graph(spark, [node(0, 0, "1"), node(1, 1, "t"), node(2, 2, "a")], [(0, 1)], [(0, 2)])
    text = J.export_graph(g, 3, "2024-01-01T00:00:00Z").first()["value"]
    back, next_id = J.parse_graph(spark, text)
    assert next_id == 3 and back.nodes.count() == 3 and [tuple(r) for r in back.edges.collect()] == [(0, 1)]
    doc = json.loads(text)
    for change in ({"version": 99}, {"nextNodeId": 2}, {"edges": [{"workNodeId": 0, "tagNodeId": 77}]}, {"nodes": doc["nodes"] + doc["nodes"][:1]}):
        with pytest.raises(J.BadDocument):
            J.parse_graph(spark, json.dumps(doc | change))
    assert J.import_graph(spark, g, 3, text, "merge").graph.nodes.count() == 3


def test_json_document_in_files(spark, tmp_path):
    import gzip

    n = 300
    g = graph(spark, [node(0, 0, 'a\n],"edges":[\u2028"'), *[node(i, 1, f"t{i}") for i in range(1, n)]], [(0, i) for i in range(1, n)] + [(0, 1)], [])
    g = Graph(g.nodes.repartition(7), g.edges.repartition(5), g.author_edges)
    whole = J.export_graph(g, n, "now").first()["value"]
    J.write_document(g, n, "now", str(tmp_path / "doc"))
    files = sorted((tmp_path / "doc").glob("part-*"))
    lines = "".join(gzip.open(f, "rt", encoding="utf-8", newline="").read() for f in files)
    assert max(map(len, lines.split("\n"))) < 400  # no line holds the document
    got, want = json.loads(lines), json.loads(whole)
    for d in (got, want):
        for t in ("nodes", "edges", "authorEdges"):
            d[t] = sorted(map(json.dumps, d[t]))
    assert got == want
    back, next_id = J.read_document(spark, str(tmp_path / "doc"))
    assert next_id == n and sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect())) and not back.author_edges.count()
    assert {r["id"]: r for r in back.nodes.collect()} == {r["id"]: r for r in g.nodes.collect()}
    assert J.import_document(spark, g, n, str(tmp_path / "doc"), "merge").graph.nodes.count() == n
    empty = Graph(*(t.limit(0) for t in (g.nodes, g.edges, g.author_edges)))
    J.write_document(empty, 0, "now", str(tmp_path / "empty"))
    assert J.read_document(spark, str(tmp_path / "empty"))[0].nodes.count() == 0
    text = lines.rstrip("\n").split("\n")
    for i, bad in enumerate((text[:-1], [*text, "x"], [text[0].replace('"version":2', '"version":9'), *text[1:]], [text[0].replace(f":{n},", ":2,"), *text[1:]], [t.replace('"tagNodeId":7}', '"tagNodeId":7777}') for t in text], [t.replace('"id":9,', '"id":8,') for t in text], [t.replace('"kind":1,', '"kind":7,') for t in text])):
        spark.createDataFrame([(t,) for t in bad], "value string").coalesce(1).write.text(str(tmp_path / f"bad{i}"))
        with pytest.raises(J.BadDocument):
            J.read_document(spark, str(tmp_path / f"bad{i}"))


def test_csv_lines(spark):
    lines = ['1,Freeform,"a ""b"", c",true,12,', "2,Fandom, X ,false,3,1", "3,Rating,r,TRUE,0,7x", "-1,a,b,true,1,", "4,a,Redacted,true,1,", "5,a,b", "", "6,a,b,true,x,"]
    rows = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("tag_id").collect()
    assert [tuple(r) for r in rows] == [(1, "Freeform", 'a "b", c', True, 12, None), (2, "Fandom", " X ", False, 3, 1), (3, "Rating", "r", True, 0, 7)]
    assert content_tags(spark.createDataFrame(rows)).count() == 2


def test_urls(spark):
    for name, part in (("M/M", "M*s*M"), ("A & B", "A%20*a*%20B"), ("Dr. Who", "Dr*d*%20Who"), ("a?#!'()*~é", "a*q**h*!'()*~%C3%A9")):
        assert one(spark, name, U.encode_tag) == part == U.encode_tag_text(name)
        assert one(spark, part, U.decode_tag) == name == U.decode_tag_text(part)
    kinds = {"https://x.org/works/12": "work", "https://x.org/works/search?page=2": "search", "https://x.org/tags/a/works": "tag", "https://x.org/users/u/works": "author", "https://x.org/users/login": "unknown", "https://x.org/": "unknown"}
    assert {u: one(spark, u, U.page_kind) for u in kinds} == kinds
    assert one(spark, "/users/x/gifts", lambda c: U.author_key(c, True)) is None and one(spark, "/users/x/pseuds/y", lambda c: U.author_key(c, True)) == "x/pseuds/y"
    assert one(spark, "https://x.org/a?b=1&page=3", U.page_number) == 3 and one(spark, "https://x.org/a?page=0", U.page_number) == 1
    assert U.WorkSearch(page=2, fandom_names=["A", "B c"], word_count=U.Count(min=5), complete=True, rating_ids=[1, 2]).url("") == "/works/search?page=2&work_search%5Bcomplete%5D=T&work_search%5Bword_count%5D=%3E5&work_search%5Bfandom_names%5D=A%2CB+c&work_search%5Brating_ids%5D%5B%5D=1&work_search%5Brating_ids%5D%5B%5D=2"


def test_fuzzy(spark):
    score = lambda q, c: one(spark, c, lambda x: TX.fuzzy_score(q, x))
    assert score("fluff", "Fluff") == 1000 and score("flu", "fluff") == pytest.approx(900 + 3 / 5 * 80) and score("uff", "fluff") == 798
    assert score("xyz", "fluff") is None and score(" ", "fluff") is None
    # a, then b after a blank: 10 + 6 at the start, 10 + 12 - 4 at the word
    assert score("ab", "axx b") == 16 + 18


def test_chapters_and_counts(spark):
    assert [one(spark, x, TX.completion_of_chapters) for x in ("3/3", " 3/?", "1/5", "x", None, "5/0", "1,000/1,000")] == ["Complete", "Incomplete", "Incomplete", None, None, None, "Complete"]
    assert one(spark, "1 - 20 of 1,234 Works in X", TX.work_count) == 1234 and one(spark, "55 Found", TX.found_count) == 55 and one(spark, " 1,2 x", TX.blurb_words) == 12
    assert one(spark, "WIP", TX.completion_of_label) == "Incomplete" and one(spark, " a, b,,a ", TX.split_commas) == ["a", "b"]
    assert one(spark, "Works by Ann - Works", TX.display_name) == "Ann"


WORK = '<dl class="work meta group"><dt>R</dt><dd class="rating tags"><a class="tag">Teen</a></dd><dd class="fandom tags"><ul><li><a class="tag">F &amp; G</a></li></ul></dd><dd class="freeform tags"><a class="tag">Fluff</a><dd class="language">English</dd><dd class="users"><a href="/users/ann/pseuds/ann">Ann</a></dd><dd class="chapters">2/2</dd><dd class="words">1,234 Words</dd></dl><h2 class="title heading"> A \n Title </h2>'
LIST = '<h2 class="heading">1 - 2 of 1,002 Works in M/M</h2><ol class="pagination"><li class="current">2</li><li class="next"><a href="?page=3">Next</a></li></ol><ol class="work index group">' + "".join(
    f'<li class="work blurb"><h4 class="heading"><a href="/works/{i}">T{i}</a> by <a rel="author" href="/users/bob">bob</a></h4><h5 class="fandoms heading"><a class="tag">F</a></h5><ul class="required-tags"><li><span class="rating" title="Teen"></span></li><li><span class="iswip"><span class="text">Complete Work</span></span></li></ul><ul class="tags commas"><li class="warnings"><a class="tag">W</a></li></ul><dl class="stats"><dd class="words">{i}0</dd><dd class="chapters">1/?</dd></dl></li>' for i in (5, 6, 5)
) + "</ol>"


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "https://x.org/works/9", WORK), (2, "https://x.org/tags/M*s*M/works?page=2", LIST), (3, "https://x.org/users/bob/works", LIST), (4, "https://x.org/works/search", "<h2 class=heading>7 Found</h2>"), (5, "https://x.org/", "x"), (6, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in H.parse_pages(pages).collect()}
    w = got[1]
    assert (w["kind"], w["workId"], w["title"], w["tags"], w["wordCount"]) == ("work", "9", "A Title", ["F & G", "Fluff"], 1234)
    assert w["authors"] == [Row(key="ann/pseuds/ann", displayName="Ann")] and w["meta"]["rating"] == "Teen" and w["meta"]["completionStatus"] == "Complete" and w["meta"]["fandoms"] == ["F & G"]
    t = got[2]
    assert (t["kind"], t["tagName"], t["workCount"], t["page"], t["nextPage"], len(t["works"])) == ("tag", "M/M", 1002, 2, 3, 2)
    assert t["works"][0]["meta"]["completionStatus"] == "Incomplete" and t["works"][0]["meta"]["archiveWarnings"] == ["W"] and t["works"][0]["wordCount"] == 50
    assert got[3]["kind"] == "author" and got[3]["authorKey"] == "bob" and got[4]["workCount"] == 7 and got[5]["kind"] is None and got[6]["kind"] is None
    assert H.listed_works(H.parse_pages(pages)).count() == 4


def test_changed_between(spark):
    before = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, exploredAt long")
    after = spark.createDataFrame([(1, 5), (2, 4), (3, 8), (4, None)], "id long, exploredAt long")
    assert sorted(r["id"] for r in S.changed_between(before, after).collect()) == [2, 3, 4]


def test_empty_graph(spark):
    g = graph(spark, [])
    assert S.import_merge(g, Graph(g.nodes, g.edges, g.author_edges), 0).graph.nodes.count() == 0


def test_statistics_are_dealt_out_and_never_broadcast(spark):
    from tessera.operators import lookup as L

    g = graph(spark, [node(1, 0), node(3, 1, "Synonym"), node(4, 1, "Canonical")], [(1, 3)])
    stats = spark.createDataFrame([(1, "Canonical", 9, None), (2, "Synonym", 3, 1)], "tag_id long, name string, cached_count long, merger_id long")
    broadcasts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    names = S.canonical_names(stats)
    merged, changed = S.merge_tags(g, names)
    put, index = L.stored_stats(stats, stats, g.nodes.filter("kind = 1").select("key"))
    for df in (names, S.calibrate(g.nodes, stats), merged.nodes, merged.edges, put, index):
        assert not broadcasts(df)
    assert broadcasts(L.with_stats_tags(g.nodes, stats, stats, 10)) <= 1  # that of the counted runs, 256 rows at most
    assert changed.first()["merged"] == 1 and sorted(r["id"] for r in merged.nodes.collect()) == [1, 4]


def test_merged_tags_take_their_names_without_a_broadcast(spark):
    from tessera.catalog import tag_merge_nodes

    joins = [x for x in tag_merge_nodes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert any("SortMergeJoin" in x for x in joins) and not [x for x in joins if "Broadcast" in x and any(c in x for c in ("__k#", "__n#", "__to#"))]


def test_merged_tags_are_made_once_and_counted_without_a_broadcast(spark):
    from tessera.catalog import tag_merge_nodes
    from tessera.sources.tables import load_graph

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey" not in plan(tag_merge_nodes(spark, "/root/testdata/sf0.001"))  # all comes from the written tags
    joins = [x for x in plan(load_graph(spark, "/root/testdata/sf0.001").nodes.filter("kind = 1")).splitlines() if "Join [p_partkey#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_settings_are_parsed_once_a_row(spark):
    from tessera.functions import settings as ST

    raw = spark.createDataFrame([('{"topResults": "999", "theme": "dark", "permeability": {"rating": {"values": [" Mature ", "x"]}}}',), ("no JSON",)], "raw string")
    both = raw.select(ST.normalized(F.col("raw")).alias("n"), ST.parsed(F.col("raw")).alias("s")).select("n", ST.bounded(F.col("s")).alias("m"))
    assert all(r["n"] == r["m"] for r in both.collect())
    n = raw.select(ST.normalized(F.col("raw")).alias("n")).select("n.topResults", "n.theme", "n.permeability.rating.values", "n.negativeRelevanceLambda")
    assert n._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in n.collect()] == [(200, "dark", ["Mature"], 3.0), (25, "system", [], 3.0)]
