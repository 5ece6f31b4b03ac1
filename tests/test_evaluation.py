"""The evaluation's arrays against the engine's tables, and its sweeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators.adjacency import resolve_seeds
from tessera.operators.propagation import Params
from tessera.operators.ranking import run_query
from tessera.plans import evaluation as V
from tessera.plans.corpus import SHAPES, Mulberry, Shape, community_graph
from tessera.schema import WORK

TINY = Shape(3, 10, 4, 2, 3, 3)
PARAMS = Params(0.15, 20, 1e-9)


def test_world_scores_are_the_engines(spark):
    g = community_graph(spark, TINY)
    w = V.World.of(g)
    rel, info = w.scores([w.place(WORK, "0")], [w.place(WORK, "12")], np.ones(len(w.kind), bool), np.ones(len(w.kind), bool), PARAMS)
    rows = run_query(g, resolve_seeds(g.nodes, [(WORK, "0")]), resolve_seeds(g.nodes, [(WORK, "12")]), params=PARAMS).orderBy("id").collect()
    assert [r["relevance"] for r in rows] == pytest.approx(rel.tolist(), abs=1e-12)
    assert [r["expected_info"] for r in rows] == pytest.approx(info.tolist(), abs=1e-12)


def test_ndcg_as_the_engines(spark):
    rng = np.random.default_rng(3)
    gains = np.round(np.maximum(rng.normal(size=30), 0), 6)
    order = rng.permutation(30)
    p = spark.createDataFrame([(int(x), i + 1) for i, x in enumerate(order)], "key long, rank int")
    g = spark.createDataFrame([(i, float(x)) for i, x in enumerate(gains)], "key long, gain double")
    for r in E.ndcg(p, g, [3, 10]).collect():
        assert r["ndcg"] == pytest.approx(V.ndcg(order, gains, r["k"]))


def test_cold_and_warm_sweeps(spark):
    cold = V.evaluate(spark, TINY, 0.35, budgets=(0, 3, 40), params=PARAMS).orderBy("seed", "depth").collect()
    assert {(r["seed"], r["depth"]) for r in cold} >= {(s, d) for s in ("0", "10", "20") for d in (0, 3)}
    for s in ("0", "10", "20"):
        mine = [r for r in cold if r["seed"] == s]
        assert mine[0]["nodes"] < mine[-1]["nodes"] and mine[0]["ndcg"] <= mine[-1]["ndcg"] + 0.25 and all(0 <= r["ndcg"] <= 1 for r in mine)
    exact = V.evaluate(spark, TINY, 0.0, budgets=(200,), params=PARAMS)
    assert exact.count() == 0  # no seed has so much to expand
    warm = V.evaluate(spark, TINY, 0.0, warm=True, budgets=(0, 2), before=(1, 4), params=PARAMS).collect()
    assert {(r["seed"], r["first"], r["initial"], r["depth"]) for r in warm} == {(s, f, i, d) for s, f in (("0", "20"), ("10", "0"), ("20", "10")) for i in (1, 4) for d in (0, 2)}
    with pytest.raises(ValueError):
        V.sweep(spark, None, None, ["1", "1"], before=(1,))


def test_report_text(spark):
    cells = V.evaluate(spark, TINY, 0.0, budgets=(0, 2), params=PARAMS)
    text = V.text_report(cells, "title", 0.0)
    assert "Measurement noise: off" in text and "  budget 2: " in text and text.count("Seed ") == 6


def test_noise_keeps_links(spark):
    w = V.World.of(community_graph(spark, TINY))
    seen = w.observed(0.35, 1)
    assert (seen.src == w.src).all() and not np.allclose(seen.weight, w.weight) and (seen.weight > 0).all() and (seen.words >= 1)[w.kind == WORK].all()
    ratio = np.log(seen.freq / w.freq)
    assert 0.2 < ratio.std() < 0.5


def test_shapes_and_generator(spark):
    assert {k: v.communities * v.works + v.bridge_works for k, v in SHAPES.items()} == {"small": 260, "medium": 1120, "large": 3680, "xlarge": 11550, "xxlarge": 33900}
    g = community_graph(spark, SHAPES["medium"])
    assert g.nodes.filter(F.col("kind") == WORK).count() == 1120
    rng = Mulberry(42)
    assert [round(rng(), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]  # the generator's published sequence for 42
