"""Small graphs with known answers, and both strategies of propagation against each other."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as C
from tessera.operators import adjacency as A
from tessera.operators import evaluate as E
from tessera.operators import ranking as R
from tessera.operators import topology as T
from tessera.operators.components import label_components
from tessera.operators.propagation import Params, Transitions, iterate
from tessera.schema import AUTHOR_EDGE, EDGE, NODE, Graph


def node(i, kind, key=None, words=None, est=1.0, cal=None, status="unexplored", meta=None, at=None, nxt=None):
    return (i, kind, key or str(i), None, words, est, cal, status, at, nxt, 0, status == "complete", meta)


def graph(spark, nodes, edges=(), authors=()):
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(list(edges), EDGE), spark.createDataFrame(list(authors), AUTHOR_EDGE))


@pytest.fixture(scope="module")
def four(spark):
    return graph(spark, [node(100, 0, status="complete"), node(200, 0), node(300, 1, "rare", est=2.0), node(400, 1, "popular", cal=5000.0)], [(100, 300), (200, 300), (100, 400)])


def test_weights_and_out_fraction(four):
    adj = {(r["src"], r["dst"]): r["weight"] for r in A.adjacency(four).collect()}
    assert adj[100, 300] == pytest.approx(1 / math.log(3)) and adj[300, 100] == 0.5 and adj[400, 100] == 1
    assert adj[100, 400] < adj[100, 300]
    rho = {r["id"]: r["rho"] for r in A.with_out_fraction(four.nodes, A.adjacency(four)).collect()}
    assert rho == {100: 1.0, 200: 0.5, 300: 1.0, 400: pytest.approx(1 / 5000)}


def test_permeability_after_normalisation(spark):
    g = graph(spark, [node(0, 0, status="complete"), node(1, 1, status="complete")], [(0, 1)])
    adj = spark.createDataFrame([(0, 1, 2.0), (1, 0, 8.0)], "src long, dst long, weight double")
    mu = spark.createDataFrame([(0, 0.5), (1, 0.2)], "id long, mu double")
    assert [r["p"] for r in A.transitions(g.nodes, adj, mu=mu).collect()] == [pytest.approx(0.1)] * 2


def test_category_filters(spark):
    meta = ("English", "Explicit", "Complete", ["Major Character Death"], ["A", "B"], ["M/M", "Gen"])
    nodes = spark.createDataFrame([node(1, 0, meta=meta), node(2, 0), node(3, 1)], NODE)
    f = {"rating": R.CategoryFilter("blacklist", 0.5, ("Explicit",)), "fandoms": R.CategoryFilter("whitelist", 0.2, ("A",)), "language": R.CategoryFilter("blacklist", 0.1, ())}
    assert {r["id"]: r["mu"] for r in R.permeability(nodes, f).collect()} == {1: pytest.approx(0.1), 2: 1.0, 3: 1.0}


def test_priors(spark):
    g = graph(spark, [node(0, 0, words=2500), node(1, 0, words=5000), node(2, 0), node(3, 2), node(4, 1)], [], [(1, 3)])
    a = {r["id"]: r["a"] for r in R.prior_logs(g).collect()}
    assert a[0] == 0 and a[1] == pytest.approx(math.log(2)) and a[2] == 0 and a[3] == pytest.approx(math.log(3)) and a[4] == 0
    assert sum(r["value"] for r in R.teleport_from(R.prior_logs(g)).collect()) == pytest.approx(1)


def test_strategies_agree(spark, four):
    adj = A.adjacency(four)
    p = A.transitions(four.nodes, adj)
    seeds = A.resolve_seeds(four.nodes, [(0, "100"), (1, "rare"), (0, "100")])
    tele = A.seed_teleport(seeds)
    recv = R.teleport_from(R.prior_logs(four))
    for receiver in (None, recv):
        out = []
        for engine in ("local", "distributed"):
            v, rounds = Transitions(p, four.nodes, engine).run(tele, Params(0.15, 6, 0.0), receiver)
            out.append(({r["id"]: round(r["value"], 12) for r in v.collect()}, rounds))
        assert out[0] == out[1] and sum(abs(x) for x in out[0][0].values()) == pytest.approx(1)


def test_first_round_is_teleport_and_closed_graphs_stop():
    src, dst, p = np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.array([1, 0.5, 0.5, 1])
    t = np.array([1.0, 0, 0])
    v, n = iterate(src, dst, p, t, Params(0.5, 1, 1e-8))
    assert n == 1 and v.tolist() == [1, 0, 0]
    v, n = iterate(src, dst, p, t, Params(0.5, 200, 1e-8))
    assert n < 200 and v[0] > v[1] > v[2] > 0 and v.sum() == pytest.approx(1)
    assert iterate(src, dst, p * 0.5, t, Params(0.5, 50, 1e-8))[1] == 50  # a leaky graph uses all rounds
    assert iterate(src, dst, p, t, Params(0.5, 1, 1e-8), np.array([1.0, 2, 1]))[0].sum() == pytest.approx(1)


def test_contrast_and_no_seeds(spark, four):
    a, b = (spark.createDataFrame(x, "id long, value double") for x in ([(1, 0.5), (2, 0.5)], [(2, 0.5), (3, 0.5)]))
    assert {r["id"]: r["value"] for r in R.contrast(a, b).collect()} == {1: 0.5, 2: -1.0, 3: -1.5}
    none = A.resolve_seeds(four.nodes, [(0, "x")])
    assert R.run_query(four, none).agg(F.sum(F.abs("expected_info"))).first()[0] == 0


def test_seed_ranks_near_works_first(spark, four):
    out = {r["id"]: r for r in R.run_query(four, A.resolve_seeds(four.nodes, [(0, "100")]), params=Params(0.15, 20, 1e-9)).collect()}
    assert out[100]["relevance"] > out[200]["relevance"] > 0 and all(r["precision"] > 1 for r in out.values())


def test_rank_works_with_suppressed(spark):
    works = spark.createDataFrame([(i, float(10 - i // 2)) for i in range(10)], "id long, s double")
    hidden = spark.createDataFrame([(0,), (2,)], "id long")
    out = R.rank_works(works, "s", 3, spark.createDataFrame([(4,)], "id long"), hidden).orderBy("rank").collect()
    assert [(r["id"], r["suppressed"]) for r in out] == [(0, True), (1, False), (2, True), (3, False), (5, False)]


def test_expandable(spark):
    week = C.STALE_MS
    rows = [(0, "partial", None), (0, "complete", 1), (1, "complete", week), (1, "complete", 1), (1, "complete", None)]
    d = spark.createDataFrame(rows, "kind int, s string, at long")
    assert [r[0] for r in d.select(C.is_expandable(F.col("kind"), F.col("s"), F.col("at"), week + 1)).collect()] == [True, False, False, True, True]


def test_thresholds_round_half_up(spark):
    phi = spark.createDataFrame([(i, 10.0**-i) for i in range(5)] + [(9, 0.0), (10, 1.0)], "id long, phi double")
    assert [r["value"] for r in T.thresholds(phi, 3).orderBy("level").collect()] == [pytest.approx(x) for x in (1, 0.01, 0.0001)]


def test_order_of_sets(spark):
    chain = spark.createDataFrame([(0, [0]), (1, [0, 1]), (2, [0, 1, 2])], "hid int, nodes array<int>")
    pairs = T.inclusions(chain)
    assert sorted(map(tuple, T.covers(pairs).collect())) == [(0, 1), (1, 2)] and tuple(T.order_shape(chain, pairs).first()) == (2, 1)
    diamond = spark.createDataFrame([(0, [0]), (1, [0, 1]), (2, [0, 2]), (3, [0, 1, 2])], "hid int, nodes array<int>")
    cover = T.covers(T.inclusions(diamond))
    assert tuple(T.betti(diamond, cover).first()) == (1, 1, 4, 4)
    assert sorted(r[0] for r in T.h1_sets(diamond, cover).collect()) == [0, 1, 2, 3]


def test_superlevel_components_and_fragility(spark):
    adj = spark.createDataFrame([(a, b, 1.0) for x, y in ((0, 1), (1, 2), (2, 3), (3, 4)) for a, b in ((x, y), (y, x))], "src long, dst long, weight double")
    phi = spark.createDataFrame([(0, 2.0), (1, 2.0), (2, 0.5), (3, 2.0), (4, 1.0)], "id long, phi double")
    assert {r["id"]: r["component"] for r in T.superlevel_components(adj, phi, 1.0).collect()} == {0: 0, 1: 0, 3: 3, 4: 3}
    sets = spark.createDataFrame([(0, [0, 1]), (3, [3, 4])], "hid long, nodes array<long>")
    edge = T.boundary_nodes(adj, sets.select("hid", F.explode("nodes").alias("id")), 5)
    assert sorted(r[0] for r in edge.collect()) == [1, 3]
    rho = spark.createDataFrame([(i, 1.0 if i == 0 else 0.5) for i in range(5)], "id long, rho double")
    f = {r["id"]: r["fragility"] for r in T.fragility(rho, T.conductance(adj, phi), phi, edge).collect()}
    assert f[0] == 0 and f[2] == pytest.approx(0.5 * (1 + 1) * 0.5 * (1 + 2)) and f[1] == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    links = [tuple(map(int, x)) for x in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in label_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert label_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ndcg(spark):
    gains = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("z", 0.0)], "key string, gain double")
    best = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, rank int")
    worst = spark.createDataFrame([("z", 1), ("c", 2)], "key string, rank int")
    assert {r["k"]: r["ndcg"] for r in E.ndcg(best, gains, [1, 3]).collect()} == {1: 1.0, 3: 1.0}
    assert E.ndcg(worst, gains, [2]).first()["ndcg"] == pytest.approx((1 / math.log2(3)) / (3 + 2 / math.log2(3)))


def test_bfs_and_ball(spark):
    g = graph(spark, [node(0, 0), node(1, 1), node(2, 0), node(3, 2), node(4, 0)], [(0, 1), (2, 1)], [(2, 3), (4, 3)])
    adj = A.adjacency(g)
    start = spark.createDataFrame([(0,)], "id long")
    assert {r["id"]: r["distance"] for r in E.bfs_distances(adj, start).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    ball = E.depth_ball(g, adj, start, 2)
    assert ball.nodes.count() == 3 and ball.edges.count() == 2 and ball.author_edges.count() == 0
    assert {r["id"]: r["explored"] for r in ball.nodes.collect()} == {0: True, 1: True, 2: False}


def test_large_transitions_are_written_once_and_links_dealt_by_work(spark, monkeypatch):
    from tessera.operators import adjacency as A
    from tessera.operators import propagation as P

    g = graph(spark, [node(0, 0), node(1, 1, "t"), node(2, 2, "a"), node(3, 0)], [(0, 1), (0, 1), (3, 1)], [(0, 2)])
    plan = A.adjacency(g)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" not in plan
    assert sum(r["weight"] for r in A.adjacency(g).filter("src = 1 and dst = 0").collect()) == pytest.approx(2 / 3) and A.adjacency(g).count() == 6
    written = []
    monkeypatch.setattr(P, "materialize", lambda df, what="step": written.append(what))
    t = P.Transitions(A.transitions(g.nodes, A.adjacency(g)), g.nodes, rows=P.LOCAL_EDGES + 1)
    assert t.engine == "distributed" and not written and t.table.count() == 6
    files = [f.removeprefix("file://") for f in t.table.inputFiles()]
    t.release()
    assert files and not [f for f in files if os.path.exists(f)]


def test_large_adjacency_lies_in_buckets_and_is_iterated_in_place(spark):
    from tessera.session import drop

    rng = np.random.default_rng(5)
    nodes = [node(i, 0, status=("complete", "unexplored")[i % 2]) for i in range(40)] + [node(40 + i, 1 + i % 2, f"h{i}", est=float(i)) for i in range(12)] + [node(60, 0)]
    edges = [(int(w), 40 + 2 * int(h)) for w, h in zip(rng.integers(0, 40, 90), rng.integers(0, 6, 90))] + [(0, 99), (77, 40)]
    authors = [(int(w), 41 + 2 * int(h)) for w, h in zip(rng.integers(0, 40, 30), rng.integers(0, 6, 30))]
    g = graph(spark, nodes, edges, authors)
    rows = lambda d: sorted((r["src"], r["dst"], round(r["weight"], 12)) for r in d.collect())
    expected = rows(A.adjacency(g))
    small, n = A.stored_adjacency(g, 10_000)
    large, m = A.stored_adjacency(g, 0)
    assert n == m == len(expected) and rows(small) == rows(large) == expected
    plan = large.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # rows of a node lie together already
    tele = A.seed_teleport(A.resolve_seeds(g.nodes, [(0, "1"), (1, "h2")]))
    receiver = g.nodes.select("id", F.lit(0.5).alias("value"))
    t = Transitions(large, g.nodes, factors=A.row_factors(g.nodes, large))
    for r in (None, receiver):
        v = {x["id"]: x["value"] for x in t.run(tele, Params(0.15, 6, 0.0), r)[0].collect()}
        w = {x["id"]: x["value"] for x in Transitions(A.transitions(g.nodes, A.adjacency(g)), g.nodes, "local").run(tele, Params(0.15, 6, 0.0), r)[0].collect()}
        assert v.keys() == w.keys() and all(v[i] == pytest.approx(w[i]) for i in v)
    files = [f.removeprefix("file://") for f in large.inputFiles()]
    drop(large)
    assert files and not [f for f in files if os.path.exists(f)]


def test_query_search_of_a_large_graph_writes_no_transitions(spark, monkeypatch):
    from tessera import catalog, session
    from tessera.operators import propagation as P

    small = catalog.query_astar(spark, "/root/testdata/sf0.001").first()
    written, sweep = [], session.sweep
    monkeypatch.setattr(session, "sweep", lambda spark, path: written.append(path.split("/")[-1]) or sweep(spark, path))
    for m in (catalog, P):
        monkeypatch.setattr(m, "LOCAL_EDGES", 0)
    large = catalog.query_astar(spark, "/root/testdata/sf0.001").first()
    assert [n for n in written if n.startswith("factors")] and not [n for n in written if n.startswith("transitions")]
    assert (large["type"], large["key"], large["depth"], large["expanded"]) == (small["type"], small["key"], small["depth"], small["expanded"]) and large["score"] == pytest.approx(small["score"])


def test_boundary_looks_at_each_link_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(3):
        links = {(int(a), int(b)) for a, b in rng.integers(0, 30, (60, 2)) if a != b}
        links |= {(b, a) for a, b in links}
        sets = {f"s{k}": {int(i) for i in rng.choice(30, rng.integers(1, 25), replace=False)} for k in range(12)} | {"all": set(range(30))}
        adj = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double")
        rows = spark.createDataFrame([(h, i) for h, s in sets.items() for i in s], "hid string, id long")
        counted = []
        monkeypatch.setattr(T, "materialize", lambda df, what="step": counted.append((what, df.count())) or df.localCheckpoint())
        got = {r["id"] for r in T.boundary_nodes(adj, rows, 30).collect()}
        assert got == {a for s in sets.values() if len(s) < 30 for a, b in links if a in s and b not in s}
        assert dict(counted)["near"] <= len(links)  # not each link for each set


def test_conductance_of_nodes_with_potential(spark):
    adj = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    phi = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.0)], "id long, phi double")
    rows = lambda d: {(r["src"], r["dst"]): r["c"] for r in d.collect()}
    assert rows(T.conductance(adj, phi)) == {(0, 1): 0.125, (1, 0): 0.125, (1, 2): 0.0, (2, 1): 0.0}
    assert rows(T.conductance(adj, phi, live=True)) == {(0, 1): 0.125, (1, 0): 0.125, (1, 2): 0.0}
