"""Fetches, retries, seeds and keyed updates."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.settings import normalized
from tessera.operators import lookup as L
from tessera.plans import executor as X
from tessera.schema import AUTHOR, AUTHOR_EDGE, EDGE, NODE, TAG, WORK, Graph
from tessera.sources import stats_csv as C

WORK_PAGE = '<h2 class="title">One</h2><dl class="work meta group"><dd class="fandom tags"><a class="tag">F</a></dd><dd class="words">12 Words</dd><dd><a></a></dd></dl>'
TAG_PAGE = '<h2 class="heading">1 - 1 of 40 Works in F</h2><ol class="pagination"><li class="next"><a href="?page=2">n</a></li></ol><ol class="work index group"><li class="work blurb"><h4 class="heading"><a href="/works/9">Nine</a></h4></li></ol>'


def empty(spark):
    return Graph(*(spark.createDataFrame([], t) for t in (NODE, EDGE, AUTHOR_EDGE)))


class Clock:
    def __init__(self):
        self.now, self.slept = 10_000.0, []

    def limit(self):
        return X.RateLimit(random.Random(1), lambda: self.now, self.sleep)

    def sleep(self, ms):
        self.slept.append(ms)
        self.now += ms


def test_requests_keep_their_distance():
    c = Clock()
    limit = c.limit()
    limit.wait()
    assert c.slept == []
    limit.wait()
    limit.wait()
    assert len(c.slept) == 2 and all(X.INTERVAL_MS <= x < X.INTERVAL_MS + X.JITTER_MS for x in c.slept)


def test_retries():
    c, answers, asked = Clock(), [(503, ""), (429, ""), (200, "ok")], []
    get = lambda url: asked.append(url) or answers[len(asked) - 1]
    assert X.with_retries(get, "u", c.limit()) == "ok" and asked == ["u"] * 3
    assert [x for x in c.slept if x % X.INTERVAL_MS == 0] == [2 * X.INTERVAL_MS, 3 * X.INTERVAL_MS]
    with pytest.raises(X.HttpError, match="404"):
        X.with_retries(lambda url: (404, ""), "u", Clock().limit())

    def broken(url):
        raise OSError("no network")

    with pytest.raises(OSError):
        X.with_retries(broken, "u", Clock().limit())


def test_fetches_and_seeds(spark):
    asked = []

    def get(url):
        asked.append(url)
        return 200, TAG_PAGE if "/tags/" in url else WORK_PAGE

    c = Clock()
    run = X.Executor(spark, get, c.limit(), clock=lambda: 5)
    g, above = run.ensure(empty(spark), [(WORK, "7"), (TAG, "F"), (WORK, "7")], 0)
    nodes = {(r["kind"], r["key"]): r for r in g.nodes.collect()}
    assert [u.split("example.org")[1] for u in asked] == ["/works/7", "/tags/F/works"]  # what is complete is not fetched again
    assert nodes[WORK, "7"]["explorationStatus"] == "complete" and nodes[TAG, "F"]["listingNextPage"] == 2 and (WORK, "9") in nodes
    plans = X.seed_plans(g.nodes, [(WORK, "7"), (TAG, "F"), (AUTHOR, "new")])
    assert {(r["type"], r["page"], r["marks"] == -1) for r in plans.collect()} == {("tagListing", 2, False), ("authorListing", 1, True)}
    out = run.run(g, {"type": "tagListing", "key": "F", "page": 2, "marks": -1}, above)
    assert (out.status, out.next_page, out.count, out.marks) == ("partial", 2, 40, nodes[TAG, "F"]["id"])
    with pytest.raises(ValueError, match="no author page"):
        X.Executor(spark, lambda u: (200, ""), c.limit(), origin="https://x/works/1?u=").run(g, {"type": "authorListing", "key": "a"}, above)


def test_seeds_are_on_one_side():
    s = X.Seeds(2, 1)
    assert [s.add(TAG, " a "), s.add(TAG, "a"), s.add(TAG, "a", False), s.add(WORK, "a", False), s.add(WORK, "b", False), s.add(TAG, "  "), s.add(AUTHOR, "c"), s.add(AUTHOR, "d")] == [True, False, False, True, False, False, True, False]
    assert s.positive == [(TAG, "a"), (AUTHOR, "c")] and s.negative == [(WORK, "a")]
    assert X.search_proxy(["x", "y"], "c", {"y"}, set(), {"x"}) == (TAG, "y") and X.search_proxy(["x"], "c", set(), {"c"}, {"x"}) == (AUTHOR, "c")
    assert X.search_proxy(["x"], None, set(), set(), {"x"}) == (TAG, "x") and X.search_proxy([], None, set(), set(), set()) is None


def test_settings_of_bad_texts(spark):
    rows = ['{"topResults": 1e99, "maxSeeds": "", "queryAStarMaxThinkMs": -4, "negativeRelevanceLambda": "2.5"}', "no json", "{}", None, '{"topResults": "2.5", "maxSeeds": true}']
    got = [r["n"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", normalized(F.col("x")).alias("n")).orderBy("i").collect()]
    assert (got[0]["topResults"], got[0]["maxSeeds"], got[0]["queryAStarMaxThinkMs"], got[0]["negativeRelevanceLambda"]) == (200, 1, 0, 2.5)
    for g in got[1:4]:
        assert (g["topResults"], g["theme"], g["expansionPolicy"], g["permeability"]["fandoms"]["values"]) == (25, "system", "topological", [])
    assert got[4]["topResults"] == 3 and got[4]["maxSeeds"] == 20


def test_dump_import_and_stream(spark, tmp_path):
    lines = ["id,type,name,canonical,cached_count,merger_id", "1,Freeform,F,true,9,", "2,Freeform,G,false,3,1", "3,Rating,R,true,5,", "x"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "tags-20240101.csv").write_text("\r\n".join(lines))
    row = lambda i, key: (i, TAG, key, None, None, 1.0, None, "unexplored", None, None, 0, False, None)
    g = Graph(spark.createDataFrame([row(0, "F"), row(1, "G"), row(2, "H")], NODE), spark.createDataFrame([(5, 1)], EDGE), spark.createDataFrame([], AUTHOR_EDGE))
    told = []
    out = C.import_dump(spark, f"file://{tmp_path}/d", g, lambda phase, n: told.append((phase, n)))
    assert (out.stored, out.calibrated, out.merged) == (3, 2, 1) and told == [("tags", 3), ("done", 3)]
    assert {(r["key"], r["calibratedFreq"]) for r in out.graph.nodes.collect()} == {("F", 9.0), ("H", None)} and out.graph.edges.first()["tagNodeId"] == 0
    assert {r["name"] for r in out.names.collect()} == {"F", "G"}
    none = C.import_stats(g, C.read_dump(spark, f"file://{tmp_path}/d"), store=False, apply=False)
    assert (none.stored, none.calibrated, none.merged) == (0, 0, 0)
    batches, done = [], []
    C.dump_stream(spark, f"file://{tmp_path}/d", lambda df, n: batches.append(df.count()), f"file://{tmp_path}/c", progress=done.append).awaitTermination()
    assert sum(batches) == 3 and done[-1] == 3
    assert L.emptied(g).nodes.count() == 0
