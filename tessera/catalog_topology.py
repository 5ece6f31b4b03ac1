"""Queries of propagation at scale and of the topology pipeline, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import POSITIVE, TEN, Params, Query, _sets, listing_events, r8
from .catalog_store import s
from .operators import adjacency as A
from .operators import ranking as R
from .operators import topology as T
from .operators.propagation import SIGNALS, Transitions, l1_distance, run_signals
from .oracles import _POS, _PRIOR, _SETS, _power, _with
from .schema import TAG, WORK, Graph
from .session import materialize
from .sources.tables import load_graph, read

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _distributed(spark: SparkSession, sf: str) -> tuple[Graph, Transitions]:
    g = load_graph(spark, sf)
    g = Graph(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"), materialize(g.author_edges, "edges"))
    adj = materialize(A.adjacency(g), "adj")
    return g, Transitions(A.transitions(g.nodes, adj), g.nodes, "distributed")


@query(f"{_with(_POS, _power('rp', 'pos_t', 10))} SELECT * FROM (SELECT id, round(v, 8) AS value FROM rp) WHERE value > 0")
def ppr_distributed_k10(spark, sf):
    """Ten rounds as joins and sums, the way graphs that no machine holds are ranked."""
    g, t = _distributed(spark, sf)
    return t.run(A.seed_teleport(A.resolve_seeds(g.nodes, POSITIVE)), TEN)[0].select("id", r8("value").alias("value")).filter("value > 0")


@query(f"{_with(_PRIOR, _power('a0', 'prior_t', 10))} SELECT id, round(v, 10) AS value FROM a0")
def authority_distributed_k10(spark, sf):
    g, t = _distributed(spark, sf)
    return t.run(R.teleport_from(R.prior_logs(g)), TEN)[0].select("id", r8("value", 10).alias("value"))


@query(f"{_with(_POS, _PRIOR, _power('a0', 'prior_t', 3), _power('rp', 'pos_t', 5, 'a0'))} SELECT * FROM (SELECT id, round(v, 8) AS value FROM rp) WHERE value > 0")
def receiver_distributed_k5(spark, sf):
    """Relevance whose receivers are weighed by authority, both distributed."""
    g, t = _distributed(spark, sf)
    first, _ = t.run(R.teleport_from(R.prior_logs(g)), Params(0.15, 3, 0.0))
    return t.run(A.seed_teleport(A.resolve_seeds(g.nodes, POSITIVE)), Params(0.15, 5, 0.0), first)[0].select("id", r8("value").alias("value")).filter("value > 0")


@query(f"{_with(_POS, _power('rp', 'pos_t', 5))} SELECT * FROM (SELECT 'relevance' AS signal, id, round(v, 8) AS value FROM rp) WHERE value > 0")
def signal_values(spark, sf):
    """The registered signals from the positive seeds."""
    g, t = _distributed(spark, sf)
    return run_signals(t, sorted(SIGNALS), A.resolve_seeds(g.nodes, POSITIVE), Params(0.15, 5, 0.0)).select("signal", "id", r8("value").alias("value")).filter("value > 0")


@query(f"{_with(_POS, _power('x', 'pos_t', 4))} SELECT round(sum(abs(d)), 8) AS delta FROM (SELECT id, sum(v) AS d FROM (SELECT id, v FROM x_4 UNION ALL SELECT id, -v FROM x_3) GROUP BY id)")
def iteration_delta(spark, sf):
    """How far the fourth round's vector lies from the third's."""
    g, t = _distributed(spark, sf)
    start = A.seed_teleport(A.resolve_seeds(g.nodes, POSITIVE))
    a, b = (t.run(start, Params(0.15, n, 0.0))[0] for n in (4, 3))
    return l1_distance(a, b).select(r8("delta").alias("delta"))


_LEVELS = 12
_FIELD = f"""
fld AS MATERIALIZED (SELECT id, sqrt(CASE kind WHEN 0 THEN wc::DOUBLE WHEN 1 THEN k * 20.0 ELSE k * 30.0 END) AS phi FROM nodes),
lv AS MATERIALIZED (SELECT l AS level, phi AS value FROM (SELECT phi, row_number() OVER (ORDER BY phi DESC) - 1 AS n, count(*) OVER () AS m FROM (SELECT DISTINCT phi FROM fld WHERE phi > 0)) JOIN (SELECT unnest(range({_LEVELS})) AS l) ON n = CAST(floor(l * (m - 1) / {_LEVELS - 1}.0 + 0.5) AS BIGINT)),
mem AS MATERIALIZED (SELECT level, value, id, phi FROM fld JOIN lv ON phi >= value),
lk AS MATERIALIZED (SELECT level, src, dst FROM (SELECT src, dst, least(x.phi, y.phi) AS lo FROM adj JOIN fld x ON x.id = src JOIN fld y ON y.id = dst WHERE x.phi * y.phi > 0) JOIN lv ON lo >= value),
c0 AS MATERIALIZED (SELECT level, id, id AS label FROM mem)"""
# A label passes one link a round; components of these tables are at most so many links wide.
_ROUNDS = 24
_FIELD += "".join(
    f",\nc{i} AS MATERIALIZED (SELECT level, id, min(label) AS label FROM (SELECT * FROM c{i - 1} UNION ALL SELECT lk.level, lk.dst, label FROM c{i - 1} c JOIN lk ON lk.level = c.level AND lk.src = c.id) GROUP BY level, id)" for i in range(1, _ROUNDS + 1)
) + f",\ncc AS (SELECT * FROM c{_ROUNDS})"
_HYPOTHESES = f"{_with(_FIELD)}, hs AS (SELECT label AS least, size, max(value) AS birth, min(value) AS death, max(mass) AS mass FROM (SELECT cc.level, label, min(value) AS value, count(*) AS size, sum(phi) AS mass FROM cc JOIN mem ON mem.level = cc.level AND mem.id = cc.id GROUP BY cc.level, label) GROUP BY label, size)"


def _field(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame, DataFrame]:
    """A potential that both engines compute alike: roots of lengths and of keys."""
    g = load_graph(spark, sf)
    k = F.col("key").cast("double")
    value = F.when(F.col("kind") == WORK, F.col("wordCount").cast("double")).when(F.col("kind") == TAG, k * 20.0).otherwise(k * 30.0)
    scores = g.nodes.select("id", value.alias("relevance"), F.lit(1.0).alias("authority"))
    return g, materialize(A.adjacency(g), "adj"), materialize(T.potentials(scores), "phi")


@query(f"{_HYPOTHESES} SELECT least, size, round(birth, 6) AS birth, round(death, 6) AS death, round(mass, 4) AS mass FROM hs")
def superlevel_hypotheses(spark, sf):
    """The distinct components of twelve superlevel sets, with birth, death and mass."""
    _, adj, phi = _field(spark, sf)
    members = materialize(T.level_components(adj, phi, materialize(T.thresholds(phi, _LEVELS), "levels")), "members")
    return T.hypotheses_of_levels(members, phi).select("least", "size", r8("birth", 6).alias("birth"), r8("death", 6).alias("death"), r8("mass", 4).alias("mass"))


@query(f"{_with(_FIELD)} SELECT level, id, label AS component FROM cc WHERE level = 4")
def superlevel_components(spark, sf):
    """The components at the fifth of twelve levels."""
    _, adj, phi = _field(spark, sf)
    level = T.thresholds(phi, _LEVELS).filter("level = 4").select("value").first()
    return T.superlevel_components(adj, phi, level["value"]).select(F.lit(4).cast("long").alias("level"), "id", "component")


@query(f"{_HYPOTHESES} SELECT least, size, round(greatest(0, birth - death) * mass + mass * 1e-12, 4) AS persistence FROM hs ORDER BY greatest(0, birth - death) * mass + mass * 1e-12 DESC, least, size LIMIT 256")
def persistent_hypotheses(spark, sf):
    """The 256 most persistent components."""
    _, adj, phi = _field(spark, sf)
    members = materialize(T.level_components(adj, phi, materialize(T.thresholds(phi, _LEVELS), "levels")), "members")
    score = T.persistence(F.col("birth"), F.col("death"), F.col("mass"))
    return T.hypotheses_of_levels(members, phi).select("least", "size", score.alias("p")).orderBy(F.desc("p"), "least", "size").limit(T.MAX_HYPOTHESES).select("least", "size", r8("p", 4).alias("persistence"))


_FAMILY = """
fam AS (SELECT w.id AS id, o_orderpriority AS hid FROM w JOIN orders ON o_orderkey = w.k UNION ALL SELECT id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][p_size % 5 + 1] FROM t)"""


def _family(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame, DataFrame]:
    """Sets of works by priority, each with a fifth of the tags."""
    g = load_graph(spark, sf)
    o = read(spark, sf, "orders").select(s("o_orderkey").alias("k"), F.col("o_orderpriority").alias("hid"), F.lit(WORK).alias("of"))
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    p = read(spark, sf, "part").select(s("p_partkey").alias("k"), F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")).alias("hid"), F.lit(TAG).alias("of"))
    rows = g.nodes.join(o.unionByName(p), (F.col("kind") == F.col("of")) & (F.col("key") == F.col("k"))).select("hid", "id")
    return g, materialize(A.adjacency(g), "adj"), materialize(rows, "family")


@query(f"{_with(_FAMILY)} SELECT DISTINCT a.id FROM fam a JOIN adj ON src = a.id LEFT JOIN fam b ON b.hid = a.hid AND b.id = dst WHERE b.id IS NULL")
def boundary_of_sets(spark, sf):
    g, adj, rows = _family(spark, sf)
    return T.boundary_nodes(adj, rows, g.nodes.count())


@query(f"""{_with(_FAMILY)}, ph AS (SELECT id, sqrt(id % 97 + 1.0) AS phi FROM nodes), sc AS (SELECT a.hid, dst AS w, max(greatest(0, 1 - rho) * (x.phi * y.phi) * y.phi) AS score FROM fam a JOIN adj ON src = a.id JOIN rho ON rho.id = dst JOIN ph x ON x.id = src JOIN ph y ON y.id = dst LEFT JOIN fam b ON b.hid = a.hid AND b.id = dst WHERE b.id IS NULL AND rho < 1 GROUP BY a.hid, dst)
SELECT hid, round(score, 6) AS score, count(*) AS n FROM sc GROUP BY hid, round(score, 6)""")
def boundary_candidates(spark, sf):
    """How often each score occurs among the open neighbours that sets could take in."""
    g, adj, rows = _family(spark, sf)
    phi = g.nodes.select("id", F.sqrt(F.col("id") % 97 + 1.0).alias("phi"))
    got = T.boundary_candidates(rows, T.conductance(adj, phi), phi, A.with_out_fraction(g.nodes, adj).select("id", "rho"))
    return got.groupBy("hid", r8("score", 6).alias("score")).agg(F.count("*").alias("n"))


_COVER = "cov AS MATERIALIZED (SELECT lower, upper FROM inc WHERE NOT EXISTS (SELECT 1 FROM inc a JOIN inc b ON a.upper = b.lower WHERE a.lower = inc.lower AND b.upper = inc.upper))"


@query(f"""WITH RECURSIVE {_SETS}, {_COVER}, und AS (SELECT lower AS a, upper AS b FROM cov UNION SELECT upper, lower FROM cov), cc(h, label) USING KEY (h) AS (SELECT hid, hid FROM sets UNION SELECT b, min(cc.label) FROM cc JOIN und ON a = cc.h JOIN recurring.cc AS r ON r.h = b WHERE cc.label < r.label GROUP BY b)
SELECT beta0, greatest(0, e - v + beta0) AS beta1, v AS vertices, e AS edges FROM (SELECT (SELECT count(DISTINCT label) FROM cc) AS beta0, (SELECT count(*) FROM sets) AS v, (SELECT count(*) FROM cov) AS e)""")
def betti_numbers(spark, sf):
    """Parts and independent cycles of the cover relation of the parts' sets of sizes."""
    sets = materialize(_sets(spark, sf), "sets")
    return T.betti(sets, materialize(T.covers(T.inclusions(sets)), "covers"))


@query(f"WITH {_SETS}, {_COVER} SELECT hid, count(*) AS degree FROM (SELECT lower AS hid FROM cov UNION ALL SELECT upper FROM cov) GROUP BY hid HAVING count(*) >= 2")
def cyclic_hypotheses(spark, sf):
    """Sets of two covers or more in an order that has cycles."""
    sets = materialize(_sets(spark, sf), "sets")
    cover = materialize(T.covers(T.inclusions(sets)), "covers")
    ends = cover.select(F.explode(F.array("lower", "upper")).alias("hid"))
    return T.h1_sets(sets, cover).join(ends, "hid").groupBy("hid").agg(F.count("*").alias("degree"))


@query("""WITH ev AS (SELECT user_id AS hub, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(json_extract_string(props, '$.k') AS INT) AS page FROM events),
 b AS (SELECT hub, seq, CASE WHEN page % 5 = 0 THEN 2 WHEN page % 5 = 1 THEN 0 ELSE 1 END AS beta0, CASE WHEN page % 7 = 0 THEN 1 ELSE 0 END AS beta1 FROM ev), f AS (SELECT *, beta0 <= 1 AND beta1 = 0 AS triv, lag(beta0) OVER p AS p0, lag(beta1) OVER p AS p1 FROM b WINDOW p AS (PARTITION BY hub ORDER BY seq)),
 g AS (SELECT *, sum(CASE WHEN triv AND p0 = beta0 AND p1 = beta1 THEN 0 ELSE 1 END) OVER (PARTITION BY hub ORDER BY seq) AS run FROM f)
SELECT hub, seq, CASE WHEN triv THEN row_number() OVER (PARTITION BY hub, run ORDER BY seq) ELSE 0 END AS streak FROM g""")
def stable_streaks(spark, sf):
    """Snapshots of a topology by user: how long it has been trivial and the same."""
    page = F.col("page")
    e = listing_events(spark, sf).select("hub", "seq", F.when(page % 5 == 0, 2).when(page % 5 == 1, 0).otherwise(1).alias("beta0"), F.when(page % 7 == 0, 1).otherwise(0).alias("beta1"))
    return T.stable_streaks(e, ["hub"], ["seq"]).select("hub", "seq", "streak")


@query(None)
def topology_pipeline(spark, sf):
    """Hypotheses over 32 levels with alternates, capped; their order, homology and the fragility with its boost: one row a node."""
    g, adj, phi = _field(spark, sf)
    nodes = materialize(A.with_out_fraction(g.nodes, adj), "rho")
    shape = T.topology(nodes, adj, phi.select("id", F.col("phi").alias("relevance"), F.col("phi").alias("authority")))
    return shape.fragility.select("id", r8("fragility", 4).alias("fragility"), F.lit(shape.beta0).cast("long").alias("beta0"), F.lit(shape.beta1).cast("long").alias("beta1"))


@query("""WITH c AS (SELECT o_custkey AS seed, o_orderkey % 6 AS depth, o_totalprice / 1000000 AS ndcg FROM orders), k AS (SELECT seed, depth, avg(ndcg) AS ndcg FROM c GROUP BY seed, depth)
SELECT CAST(depth AS BIGINT) AS depth, round(avg(ndcg), 8) AS ndcg, count(*) AS cells FROM k GROUP BY depth UNION ALL SELECT NULL, round(avg(ndcg), 8), count(*) FROM k""")
def report_means(spark, sf):
    """Means over cells (seed, depth): by depth, and over all cells."""
    from .operators.evaluate import report

    o = read(spark, sf, "orders")
    cells = o.groupBy(F.col("o_custkey").alias("seed"), (F.col("o_orderkey") % 6).cast("int").alias("depth")).agg(F.avg(F.col("o_totalprice") / 1000000).alias("ndcg"))
    return report(cells).select(F.col("depth").cast("long").alias("depth"), r8("ndcg").alias("ndcg"), "cells")
