"""The topology pipeline against a plain version that takes sets one by one, and the trackers around it."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import topology as T


def plain(n, links, phi, rho, levels, most, alternates):
    """Hypotheses (frozenset, birth, death, mass, kind), chosen in order; boundary; Betti numbers; fragility."""
    near = {i: sorted({b for a, b in links if a == i} | {a for a, b in links if b == i}) for i in range(n)}
    values = sorted({p for p in phi if p > 0}, reverse=True)
    m = len(values)
    k = min(levels, m)
    cuts = [values[int(i * (m - 1) / (k - 1) + 0.5) if k > 1 else 0] for i in range(k)]
    sets, order = {}, []
    for cut in cuts:
        left = {i for i in range(n) if phi[i] >= cut}
        while left:
            comp, todo = set(), [min(left)]
            while todo:
                u = todo.pop()
                if u not in comp:
                    comp.add(u)
                    todo += [v for v in near[u] if v in left and phi[u] * phi[v] > 0]
            left -= comp
            key = frozenset(comp)
            if key in sets:
                sets[key][1] = cut
            else:
                sets[key] = [cut, cut, sum(phi[i] for i in comp), "superlevel"]
                order.append(key)
    for h in list(order):
        best = {}
        for u in sorted(h):
            for w in near[u]:
                if w not in h and rho[w] < 1:
                    best[w] = max(best.get(w, (-1.0, 0)), ((1 - rho[w]) * phi[u] * phi[w] * phi[w], -u))
        added = 0
        for w in sorted(best, key=lambda w: (-best[w][0], -best[w][1], w)):
            key = h | {w}
            if added < alternates and key not in sets:
                sets[key] = [sets[h][0], sets[h][1], sets[h][2] + phi[w], "boundary-alt"]
                order.append(key)
                added += 1
    score = lambda h: max(0.0, sets[h][0] - sets[h][1]) * sets[h][2] + sets[h][2] * 1e-12
    kept = sorted(order, key=lambda h: -score(h))[:most] if len(order) > most else order
    edge = {u for h in kept if len(h) < n for u in h if any(v not in h for v in near[u])}
    pairs = {(a, b) for a in kept for b in kept if a < b}
    cover = {(a, b) for a, b in pairs if not any((a, c) in pairs and (c, b) in pairs for c in kept)}
    root = {h: h for h in kept}

    def find(h):
        while root[h] != h:
            h = root[h]
        return h

    for a, b in cover:
        root[find(a)] = find(b)
    b0 = len({find(h) for h in kept})
    b1 = max(0, len(cover) - len(kept) + b0)
    degree = {h: sum(h in c for c in cover) for h in kept}
    h1 = {i for h in kept if b1 > 0 and degree[h] >= 2 for i in h}
    fragile = []
    for u in range(n):
        c = {v: phi[u] * phi[v] for v in near[u]}
        x = max(0.0, 1 - rho[u]) * sum(c[v] for v in c if v in edge) * phi[u] * (1 + sum(c.values()))
        fragile.append(x * (1.25 if u in h1 else 1))
    return {(h, round(sets[h][0], 6), round(sets[h][1], 6), round(sets[h][2], 6), sets[h][3]) for h in kept}, edge, (b0, b1), fragile


@pytest.mark.parametrize("seed,most", [(1, 256), (2, 256), (3, 9)])
def test_pipeline_against_one_by_one(spark, seed, most):
    rng = random.Random(seed)
    n = 18
    links = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(26)})
    phi = [0.0 if i % 9 == 8 else round(rng.random() + i * 1e-6, 6) for i in range(n)]
    rho = [1.0 if rng.random() < 0.4 else round(rng.random(), 3) for _ in range(n)]
    want, edge, betti, fragile = plain(n, links, phi, rho, 6, most, T.MAX_ALTERNATES)
    adj = spark.createDataFrame([(a, b, 1.0) for x, y in links for a, b in ((x, y), (y, x))], "src long, dst long, weight double")
    nodes = spark.createDataFrame(list(enumerate(rho)), "id long, rho double")
    scores = spark.createDataFrame([(i, p, p) for i, p in enumerate(phi)], "id long, relevance double, authority double")
    got = T.topology(nodes, adj, scores, 6, most)
    members = {r["hid"]: frozenset(r["ids"]) for r in got.found.rows.groupBy("hid").agg(F.collect_list("id").alias("ids")).collect()}
    assert {(members[r["hid"]], round(r["birth"], 6), round(r["death"], 6), round(r["mass"], 6), r["kind"]) for r in got.found.sets.collect()} == want
    assert {r["id"] for r in got.boundary.collect()} == edge
    assert (got.beta0, got.beta1) == betti and got.trivial == (betti[0] <= 1 and betti[1] == 0)
    f = {r["id"]: r["fragility"] for r in got.fragility.collect()}
    assert [f[i] for i in range(n)] == pytest.approx(fragile)


def test_long_chains_have_their_height(spark):
    sets = spark.createDataFrame([(i, list(range(i + 1))) for i in range(12)], "hid long, nodes array<long>")
    assert tuple(T.order_shape(sets, T.inclusions(sets)).first()) == (11, 1)


def test_stability():
    s = T.Stability(2)
    assert [s.update(*x) for x in ((1, 0), (2, 0), (1, 0), (1, 0), (1, 0), (0, 0), (1, 1), (1, 0))] == [False, False, False, True, True, False, False, False]
