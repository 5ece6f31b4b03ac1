"""The engine as a user meets it."""

import pytest

from tessera.engine import Engine
from tessera.operators.adjacency import adjacency, resolve_seeds, transitions
from tessera.operators.propagation import Params, Transitions, run_signals
from tessera.plans.corpus import Shape, community_graph
from tessera.plans.executor import Executor, RateLimit
from tessera.schema import AUTHOR, AUTHOR_EDGE, EDGE, NODE, TAG, WORK, Graph

PAGE = '<h2 class="title">Page {k}</h2><dl class="work meta group"><dd class="freeform tags"><a class="tag">T</a></dd><dd class="words">90 Words</dd><dd class="users"><a href="/users/u">U</a></dd></dl>'


def test_ranks_and_hides(spark):
    e = Engine(spark, community_graph(spark, Shape(2, 6, 3, 1, 2, 2)))
    assert e.add_seed(WORK, "0") and not e.add_seed(WORK, "0", positive=False) and e.add_seed(WORK, "1", title="Seeded")
    e.remove_seed(WORK, "1")
    e.settings["topResults"] = 3
    first = list(e.search())[-1].results
    assert len(first) == 3 and "0" not in [r["key"] for r in first]
    e.suppress(first[0]["key"])
    again = list(e.search())[-1].results
    assert [r["key"] for r in again][:2] == [r["key"] for r in first][1:]
    e.unsuppress(first[0]["key"])
    assert e.search_tags("bridge") == ["bridge0"] and e.search_tags("  ") == []
    s = e.stats()
    text = e.export("now").first()[0]
    e.clear()
    assert e.stats()["works"] == 0
    e.load(text, "overwrite")
    assert e.stats() == s


def test_fetches_pages(spark):
    empty = Graph(*(spark.createDataFrame([], t) for t in (NODE, EDGE, AUTHOR_EDGE)))
    calm = RateLimit(sleep=lambda ms: None)
    e = Engine(spark, empty, Executor(spark, lambda url: (200, PAGE.format(k=url.rpartition("/")[2])), calm), policy="expected-info")
    e.add_seed(WORK, "5")
    steps = e.search(budget=0)
    assert [s.phase for s in steps] == ["done"] and e.stats() == {"works": 1, "tags": 1, "authors": 1, "edges": 1, "authorEdges": 1}
    e.add_pages(spark.createDataFrame([(0, "https://example.org/works/6", PAGE.format(k=6)), (1, "https://example.org/about", "x")], "seq long, url string, html string"), 7)
    assert e.stats()["works"] == 2 and e.stats()["tags"] == 1
    stats = spark.createDataFrame([(1, "Freeform", "T", True, 40, None)], "tag_id long, type string, name string, canonical boolean, cached_count long, merger_id long")
    assert e.add_stats(stats).calibrated == 1


def test_signals_by_name(spark):
    g = community_graph(spark, Shape(2, 4, 2, 1, 1, 0))
    t = Transitions(transitions(g.nodes, adjacency(g)), g.nodes, "local")
    seeds = resolve_seeds(g.nodes, [(WORK, "0"), (TAG, "c0t0"), (AUTHOR, "c0a0")])
    rows = run_signals(t, ["relevance"], seeds, Params(0.15, 5, 0.0)).collect()
    assert {r["signal"] for r in rows} == {"relevance"} and sum(r["value"] for r in rows) == pytest.approx(1)
    with pytest.raises(ValueError, match="heat"):
        run_signals(t, ["heat"], seeds, Params())
