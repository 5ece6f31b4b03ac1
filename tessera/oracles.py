"""The catalog's queries in SQL, for another engine to check."""

from __future__ import annotations

from .catalog import NEGATIVE, NOW, POSITIVE
from .sources.tables import LISTED, STEP

_BASE = f"""
w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, 0 AS kind, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, CAST(floor(o_totalprice / 10) AS BIGINT) AS wc, 1.0::DOUBLE AS est, NULL::DOUBLE AS cal,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'unexplored' END AS st, CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) END AS xat, NULL::INT AS nxt, o_custkey FROM orders),
ek AS MATERIALIZED (SELECT DISTINCT l_orderkey AS wk, l_partkey AS tk FROM lineitem),
t AS MATERIALIZED (SELECT (SELECT count(*) FROM orders) + row_number() OVER (ORDER BY p_partkey) - 1 AS id, 1 AS kind, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS key, NULL::BIGINT AS wc, coalesce(f.n, 0)::DOUBLE AS est, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS cal,
  CASE p_size % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unexplored' END AS st, CASE WHEN p_size % 3 <> 2 THEN {LISTED} + p_partkey * {STEP} END AS xat, CASE WHEN p_size % 3 = 1 THEN 2 END AS nxt, p_name, p_size FROM part LEFT JOIN (SELECT tk, count(*) AS n FROM ek GROUP BY tk) f ON f.tk = p_partkey),
a AS MATERIALIZED (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + row_number() OVER (ORDER BY c_custkey) - 1 AS id, 2 AS kind, c_custkey AS k, CAST(c_custkey AS VARCHAR) AS key, NULL::BIGINT AS wc, coalesce(f.n, 0)::DOUBLE AS est, NULL::DOUBLE AS cal,
  'unexplored' AS st, NULL::BIGINT AS xat, NULL::INT AS nxt FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) f ON f.o_custkey = c_custkey),
nodes AS MATERIALIZED (SELECT id, kind, k, key, wc, est, cal, st, xat, nxt FROM w UNION ALL SELECT id, kind, k, key, wc, est, cal, st, xat, nxt FROM t UNION ALL SELECT id, kind, k, key, wc, est, cal, st, xat, nxt FROM a),
e AS MATERIALIZED (SELECT w.id AS wid, t.id AS hid FROM ek JOIN w ON w.k = wk JOIN t ON t.k = tk),
ae AS MATERIALIZED (SELECT w.id AS wid, a.id AS hid FROM w JOIN a ON a.k = w.o_custkey),
hubs AS (SELECT id, 1.0 / ln(greatest(coalesce(cal, est, 1), 1) + 1) AS down FROM nodes WHERE kind > 0),
links AS (SELECT * FROM e UNION ALL SELECT * FROM ae),
side AS (SELECT wid, hid, h.down, 1.0 / count(*) OVER (PARTITION BY hid) AS up FROM links JOIN hubs h ON h.id = hid),
adj AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT wid AS src, hid AS dst, down AS weight FROM side UNION ALL SELECT hid, wid, up FROM side) GROUP BY src, dst),
rho AS MATERIALIZED (SELECT n.id, n.kind, coalesce(d.n, 0) AS degree, CASE WHEN coalesce(d.n, 0) = 0 THEN 0.0 WHEN st = 'complete' THEN 1.0 WHEN n.kind = 0 THEN d.n / (d.n + 1.0) ELSE least(1.0, d.n / greatest(coalesce(cal, est, 1), 1)) END AS rho
  FROM nodes n LEFT JOIN (SELECT src, count(*) AS n FROM adj GROUP BY src) d ON d.src = n.id),
p AS MATERIALIZED (SELECT src, dst, weight * (r.rho / sum(weight) OVER (PARTITION BY src)) AS p FROM adj JOIN rho r ON r.id = src)
"""


def _seed_values(seeds: list[tuple[int, str]]) -> str:
    rows = sorted(seeds, key=lambda s: s[0])
    return ", ".join(f"({i}, {k}, '{v}')" for i, (k, v) in enumerate(rows))


def _seeds(name: str, seeds: list[tuple[int, str]]) -> str:
    return f"""{name} AS MATERIALIZED (SELECT v.pos AS position, n.id FROM (VALUES {_seed_values(seeds)}) v(pos, kind, key) JOIN nodes n ON n.kind = v.kind AND n.key = v.key),
{name}_t AS MATERIALIZED (SELECT id, count(*) / (SELECT count(*) FROM {name})::DOUBLE AS t FROM {name} GROUP BY id)"""


_PRIOR = """
wp AS (SELECT id, CASE WHEN wc > 0 THEN ln(wc / 2500.0) ELSE 0.0 END AS a FROM nodes WHERE kind = 0),
prior AS MATERIALIZED (SELECT id, a, 0 AS kind FROM wp UNION ALL SELECT n.id, coalesce(s.a, 0.0), 2 FROM nodes n LEFT JOIN (SELECT hid, ln(1 + sum(exp(wp.a))) AS a FROM ae JOIN wp ON wp.id = wid GROUP BY hid) s ON s.hid = n.id WHERE kind = 2
  UNION ALL SELECT id, 0.0, 1 FROM nodes WHERE kind = 1),
prior_t AS MATERIALIZED (SELECT id, exp(a) / (SELECT sum(exp(a)) FROM prior) AS t FROM prior)"""


def _power(name: str, teleport: str, rounds: int, receiver: str | None = None) -> str:
    """Unrolled rounds; the result is `name` (id, v)."""
    out = [f"{name}_1 AS MATERIALIZED (SELECT id, t / (SELECT sum(abs(t)) FROM {teleport}) AS v FROM {teleport})"]
    for i in range(2, rounds + 1):
        weigh = (f" * r.v", f" JOIN {receiver} r ON r.id = q.dst") if receiver else ("", "")
        group = ", r.v" if receiver else ""
        out.append(
            f"{name}_u{i} AS MATERIALIZED (SELECT id, sum(v) AS v FROM (SELECT q.dst AS id, 0.85 * sum(s.v * q.p){weigh[0]} AS v FROM p q JOIN {name}_{i - 1} s ON s.id = q.src{weigh[1]} GROUP BY q.dst{group} UNION ALL SELECT id, 0.15 * t FROM {teleport}) GROUP BY id)"
        )
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT id, v / (SELECT sum(abs(v)) FROM {name}_u{i}) AS v FROM {name}_u{i})")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_{rounds})")
    return ",\n".join(out)


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([_BASE, *ctes])


_POS, _NEG = _seeds("pos", POSITIVE), _seeds("neg", NEGATIVE)
_FLUX = """
fx AS MATERIALIZED (SELECT n.id, coalesce(f.b, 0.0) AS b, coalesce(f.i, 0.0) AS i FROM nodes n LEFT JOIN (SELECT dst, sum(CASE WHEN k.kind <> 1 THEN r.v * p ELSE 0 END) AS b, sum(CASE WHEN k.kind = 1 THEN r.v * p ELSE 0 END) AS i FROM p JOIN rp r ON r.id = src JOIN nodes k ON k.id = src GROUP BY dst) f ON f.dst = n.id WHERE n.kind = 1),
prior2 AS MATERIALIZED (SELECT id, a FROM prior WHERE kind <> 1 UNION ALL SELECT id, ln(b / (b + i + 1e-12) + 1e-12) FROM fx),
prior2_t AS MATERIALIZED (SELECT id, exp(a) / (SELECT sum(exp(a)) FROM prior2) AS t FROM prior2)"""
_PRECISION = """
sent AS (SELECT x.id, x.v * (1 + ln(1 + exp(q.a))) * ln(1 + exp(q.a)) AS m FROM a1 x JOIN prior2 q ON q.id = x.id),
prec AS MATERIALIZED (SELECT q.id, 1 + ln(1 + exp(q.a)) + coalesce(s.s, 0.0) AS v FROM prior2 q LEFT JOIN (SELECT dst, sum(p * m) AS s FROM p JOIN sent ON sent.id = src GROUP BY dst) s ON s.dst = q.id)"""
_PIPELINE = ",\n".join([_POS, _NEG, _PRIOR, _power("a0", "prior_t", 5), _power("rp", "pos_t", 5, "a0"), _power("rn", "neg_t", 5, "a0"), _FLUX, _power("a1", "prior2_t", 5), _PRECISION])
_PHI = ",\n".join([_POS, _PRIOR, _power("rp", "pos_t", 10), "phi AS MATERIALIZED (SELECT n.id, sqrt(coalesce(r.v, 0.0) * coalesce(x.t, 0.0)) AS phi FROM nodes n LEFT JOIN rp r ON r.id = n.id LEFT JOIN prior_t x ON x.id = n.id)"])
_META = """
lists AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS warn, list(DISTINCT p_brand) AS fan, list(DISTINCT p_type) AS cat FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
mu AS MATERIALIZED (SELECT n.id, CASE WHEN n.kind <> 0 THEN 1.0 ELSE (CASE WHEN o.o_orderpriority = '1-URGENT' THEN 0.5 ELSE 1.0 END) * (CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 1.0 ELSE 0.2 END)
  * (CASE WHEN list_has_any(coalesce(l.warn, []), ['R']) THEN 0.4 ELSE 1.0 END) * (CASE WHEN list_has_any(coalesce(l.cat, []), ['ECONOMY ANODIZED STEEL', 'PROMO']) THEN 0.25 ELSE 1.0 END) END AS mu
  FROM nodes n LEFT JOIN w ON w.id = n.id LEFT JOIN orders o ON o.o_orderkey = w.k LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lists l ON l.l_orderkey = w.k)"""
_STATS = """
s AS MATERIALIZED (SELECT p_partkey AS tag_id, p_type AS type, p_name || '#' || p_partkey AS name, CAST(p_size AS BIGINT) AS cached, lag(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS merger FROM part),
walk AS (SELECT tag_id, tag_id AS cur, 0 AS hops FROM s UNION ALL SELECT walk.tag_id, s.merger, hops + 1 FROM walk JOIN s ON s.tag_id = walk.cur WHERE s.merger IS NOT NULL AND hops < 32),
roots AS MATERIALIZED (SELECT tag_id, arg_max(cur, hops) AS root, max(hops) AS hops FROM walk GROUP BY tag_id)"""
_MERGE = """
named AS (SELECT t.id, s.name AS key, r.name AS dest, t.est, t.cal, t.st, CAST(r.cached AS DOUBLE) AS cached, r.name <> s.name AS moved FROM t JOIN s ON s.tag_id = t.k JOIN roots ON roots.tag_id = s.tag_id JOIN s r ON r.tag_id = roots.root),
groups AS MATERIALIZED (SELECT dest, arg_min(id, (CASE WHEN moved THEN 1 ELSE 0 END, id)) AS id, max(est) AS est, greatest(max(cal), max(CASE WHEN moved THEN cached END)) AS cal, max(CASE st WHEN 'complete' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS st FROM named GROUP BY dest)"""
_EVENTS = """
ev AS (SELECT user_id AS hub, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(value) AS BIGINT) AS cnt, CAST(json_extract_string(props, '$.k') AS INT) AS page FROM events),
ev2 AS (SELECT *, CASE WHEN page % 3 <> 0 THEN page + 1 END AS nxt, max(cnt) OVER (PARTITION BY hub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, coalesce(max(page) OVER (PARTITION BY hub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fetched FROM ev),
ev3 AS (SELECT *, coalesce(cnt > known, false) AS grew FROM ev2),
ev4 AS (SELECT *, CASE WHEN grew OR nxt IS NOT NULL THEN 'partial' ELSE 'complete' END AS st FROM ev3)"""
_OPEN = f"(st <> 'complete' OR (kind <> 0 AND (xat IS NULL OR {NOW} - xat >= 604800000)))"
_SETS = "sets AS MATERIALIZED (SELECT p_brand || '|' || p_type AS hid, list_sort(list(DISTINCT CAST(p_size % 12 AS BIGINT))) AS nodes FROM part GROUP BY 1), inc AS MATERIALIZED (SELECT a.hid AS lower, b.hid AS upper FROM sets a JOIN sets b ON len(a.nodes) < len(b.nodes) AND list_has_all(b.nodes, a.nodes))"
_FUZZY = """CASE WHEN lower({n}) = '{q}' THEN 1000.0 WHEN starts_with(lower({n}), '{q}') THEN 900.0 + length('{q}') * 1.0 / length({n}) * 80 WHEN instr(lower({n}), '{q}') > 0 THEN 800.0 - least(instr(lower({n}), '{q}') - 1, 40) END"""

ORACLES: dict[str, str] = {
    "graph_stats": "SELECT (SELECT count(*) FROM orders) AS works, (SELECT count(*) FROM part) AS tags, (SELECT count(*) FROM customer) AS authors, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS edges, (SELECT count(*) FROM orders) AS author_edges",
    "degree_distribution": f"{_with()} SELECT degree, count(*) AS n FROM rho WHERE degree > 0 GROUP BY degree",
    "node_table": f"{_with()} SELECT id, kind, key, wc AS wordCount, est AS estimatedFreq, cal AS calibratedFreq, st AS explorationStatus, xat AS exploredAt, nxt AS listingNextPage FROM nodes",
    "adjacency_weights": f"{_with()} SELECT src, dst, round(weight, 8) AS weight FROM adj",
    "row_out_fraction": f"{_with()} SELECT id, degree, round(rho, 8) AS rho FROM rho",
    "transition_rows": f"{_with()} SELECT src, dst, round(p, 8) AS p FROM p",
    "signed_edges": f"{_with(_NEG)} SELECT src, dst, round(CASE WHEN src IN (SELECT id FROM neg) OR dst IN (SELECT id FROM neg) THEN -p ELSE p END, 8) AS p FROM p",
    "permeability_mu": f"{_with(_META)} SELECT id, round(mu, 8) AS mu FROM mu",
    "transition_permeable": f"{_with(_META)} SELECT src, dst, round(p * x.mu * y.mu, 8) AS p FROM p JOIN mu x ON x.id = src JOIN mu y ON y.id = dst",
    "seed_resolution": f"{_with(_POS)} SELECT CAST(position AS BIGINT) AS position, id FROM pos",
    "seed_teleport": f"{_with(_POS)} SELECT id, round(t, 8) AS value FROM pos_t",
    "prior_logs": f"{_with(_PRIOR)} SELECT id, round(a, 8) AS a FROM prior",
    "teleport_prior": f"{_with(_PRIOR)} SELECT id, round(t, 10) AS value FROM prior_t",
    "ppr_relevance_k10": f"{_with(_POS, _power('rp', 'pos_t', 10))} SELECT * FROM (SELECT id, round(v, 8) AS value FROM rp) WHERE value > 0",
    "ppr_contrast_k10": f"{_with(_POS, _NEG, _power('rp', 'pos_t', 10), _power('rn', 'neg_t', 10))} SELECT * FROM (SELECT id, round(sum(v), 8) AS value FROM (SELECT id, v FROM rp UNION ALL SELECT id, -3 * v FROM rn) GROUP BY id) WHERE value <> 0",
    "authority_k10": f"{_with(_PRIOR, _power('a0', 'prior_t', 10))} SELECT id, round(v, 10) AS value FROM a0",
    "query_scores_k5": f"""{_with(_PIPELINE)} SELECT n.id, round(coalesce(x.v, 0), 9) AS positive, round(coalesce(y.v, 0), 9) AS negative, round(coalesce(x.v, 0) - 3 * coalesce(y.v, 0), 9) AS relevance, round(coalesce(z.v, 0), 9) AS authority, round(q.v, 9) AS precision,
      round((coalesce(x.v, 0) - 3 * coalesce(y.v, 0)) * coalesce(z.v, 0) / (q.v + 1e-9) * 1e6, 6) AS expected_info FROM nodes n LEFT JOIN rp x ON x.id = n.id LEFT JOIN rn y ON y.id = n.id LEFT JOIN a1 z ON z.id = n.id JOIN prec q ON q.id = n.id""",
    "expected_info_topk": f"{_with(_PIPELINE)} SELECT n.id, n.key, round(coalesce(x.v, 0) * coalesce(z.v, 0) / (q.v + 1e-9) * 1e6, 6) AS expected_info FROM nodes n LEFT JOIN rp x ON x.id = n.id LEFT JOIN a1 z ON z.id = n.id JOIN prec q ON q.id = n.id WHERE {_OPEN} ORDER BY coalesce(x.v, 0) * coalesce(z.v, 0) / (q.v + 1e-9) DESC, n.id LIMIT 25",
    "expandable_frontier": f"{_with()} SELECT id, kind, st AS explorationStatus FROM nodes WHERE {_OPEN}",
    "fetch_plans": f"{_with()} SELECT id, CASE kind WHEN 0 THEN 'work' WHEN 1 THEN 'tagListing' ELSE 'authorListing' END AS type, key, CAST(CASE WHEN kind = 0 THEN NULL WHEN st = 'complete' THEN 1 ELSE coalesce(nxt, 1) END AS BIGINT) AS page FROM nodes",
    "rank_works_suppressed": f"""{_with(_POS, _NEG)}, c AS (SELECT id, 'Work ' || key AS title, wc, k % 3 = 0 AS suppressed FROM nodes WHERE kind = 0 AND id NOT IN (SELECT id FROM pos UNION SELECT id FROM neg)),
      r AS (SELECT *, row_number() OVER (ORDER BY wc DESC, id) AS rank, coalesce(sum(CASE WHEN suppressed THEN 0 ELSE 1 END) OVER (ORDER BY wc DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM c) SELECT rank, id, title, wc AS wordCount, suppressed FROM r WHERE seen < 25""",
    "conductance_degree": f"{_with(_PHI)} SELECT src AS id, round(sum(x.phi * y.phi) * 1e6, 6) AS degree_c FROM adj JOIN phi x ON x.id = src JOIN phi y ON y.id = dst GROUP BY src",
    "threshold_schedule": "WITH d AS (SELECT phi, row_number() OVER (ORDER BY phi DESC) - 1 AS n, count(*) OVER () AS m FROM (SELECT DISTINCT sqrt(floor(o_totalprice / 10)) AS phi FROM orders) WHERE phi > 0) SELECT l AS level, round(phi, 8) AS value FROM d JOIN (SELECT unnest(range(8)) AS l) ON n = CAST(floor(l * (m - 1) / 7.0 + 0.5) AS BIGINT)",
    "fragility_scores": f"""{_with(_PHI)}, mem AS (SELECT id FROM phi WHERE phi >= 1.0 / (SELECT count(*) FROM phi)), bnd AS (SELECT DISTINCT src AS id FROM adj WHERE src IN (SELECT id FROM mem) AND dst NOT IN (SELECT id FROM mem)),
      c AS (SELECT src, dst, x.phi * y.phi AS c FROM adj JOIN phi x ON x.id = src JOIN phi y ON y.id = dst), near AS (SELECT src, sum(CASE WHEN dst IN (SELECT id FROM bnd) THEN c ELSE 0 END) AS near, sum(c) AS deg FROM c GROUP BY src)
      SELECT * FROM (SELECT r.id, round(greatest(0, 1 - rho) * near * (phi * (1 + deg)) * 1e9, 6) AS fragility FROM rho r JOIN near ON src = r.id JOIN phi ON phi.id = r.id) WHERE fragility > 0""",
    "hypothesis_inclusions": f"WITH {_SETS} SELECT lower, upper FROM inc",
    "hasse_covers": f"WITH {_SETS} SELECT lower, upper FROM inc WHERE NOT EXISTS (SELECT 1 FROM inc a JOIN inc b ON a.upper = b.lower WHERE a.lower = inc.lower AND b.upper = inc.upper)",
    "order_shape": f"WITH RECURSIVE {_SETS}, chain(h, d) AS (SELECT hid, 0 FROM sets UNION SELECT upper, d + 1 FROM chain JOIN inc ON lower = h) SELECT CAST(max(d) AS BIGINT) AS height, (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT s.hid, count(i.lower) AS r FROM sets s LEFT JOIN inc i ON i.upper = s.hid GROUP BY s.hid) GROUP BY r)) AS width FROM chain",
    "html_parse": "SELECT page_id, 'unknown' AS kind, NULL::BIGINT AS page FROM pages",
    "bfs_distances": f"{_with(_seeds('st', [(1, '5')]), 'b AS (SELECT id, 0 AS d FROM st UNION SELECT dst, d + 1 FROM b JOIN adj ON src = b.id WHERE d < 3)', recursive=True)} SELECT id, CAST(min(d) AS BIGINT) AS distance FROM b GROUP BY id",
    "depth_ball": f"{_with(_seeds('st', [(1, '5')]), 'b AS (SELECT id, 0 AS d FROM st UNION SELECT dst, d + 1 FROM b JOIN adj ON src = b.id WHERE d < 2)', recursive=True)} SELECT wid AS workNodeId, hid AS hubNodeId FROM links WHERE wid IN (SELECT id FROM b) AND hid IN (SELECT id FROM b)",
    "canonical_tags": f"WITH RECURSIVE {_STATS} SELECT tag_id, root, CAST(hops AS BIGINT) AS hops FROM roots",
    "stats_calibration": f"{_with(_STATS, recursive=True)} SELECT t.id, s.name AS key, greatest(t.cal, CAST(s.cached AS DOUBLE)) AS calibratedFreq FROM t JOIN s ON s.tag_id = t.k",
    "tag_merge_edges": f"{_with(_STATS, _MERGE, recursive=True)} SELECT DISTINCT e.wid AS workNodeId, g.id AS tagNodeId FROM e JOIN named n ON n.id = e.hid JOIN groups g ON g.dest = n.dest",
    "tag_merge_nodes": f"{_with(_STATS, _MERGE, recursive=True)} SELECT id, dest AS key, est AS estimatedFreq, cal AS calibratedFreq, CASE st WHEN 2 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unexplored' END AS explorationStatus FROM groups",
    "listing_transitions": f"WITH {_EVENTS} SELECT hub, seq, st AS explorationStatus, CAST(CASE WHEN grew THEN 1 ELSE nxt END AS BIGINT) AS listingNextPage, CAST(greatest(fetched, page) AS BIGINT) AS listingPagesFetched, greatest(known, cnt) AS calibratedFreq, grew AND coalesce(lag(st) OVER (PARTITION BY hub ORDER BY seq), 'unexplored') = 'complete' AS demoted FROM ev4",
    "snapshot_diff": f"{_with()} SELECT id FROM nodes WHERE id % 7 = 0 OR (id % 5 = 0 AND (xat IS NULL OR xat <> {NOW}))",
    "graph_merge_upsert": f"""{_with()}, i AS (SELECT id, kind, CASE WHEN k % 4 = 0 THEN 'new ' || key ELSE key END AS key, k % 4 = 0 AS fresh, est + CASE WHEN k % 2 = 0 THEN 1.0 ELSE -0.5 END AS est, CASE WHEN k % 6 = 0 THEN 3.0 ELSE cal END AS cal, CASE WHEN k % 9 = 0 THEN 'partial' ELSE st END AS st,
      CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN xat + 10 ELSE xat END AS xat FROM nodes), n AS (SELECT id, 1000000000 + row_number() OVER (ORDER BY id) - 1 AS new_id FROM i WHERE fresh), o(s, r) AS (VALUES ('unexplored', 0), ('partial', 1), ('complete', 2))
      SELECT l.id, l.kind, l.key, greatest(l.est, i.est) AS estimatedFreq, greatest(l.cal, i.cal) AS calibratedFreq, CASE WHEN i.id IS NULL OR x.r >= y.r THEN l.st ELSE i.st END AS explorationStatus, CASE WHEN i.id IS NULL THEN l.xat ELSE nullif(greatest(coalesce(l.xat, 0), coalesce(i.xat, 0)), 0) END AS exploredAt
      FROM nodes l LEFT JOIN i ON i.id = l.id AND NOT i.fresh LEFT JOIN o x ON x.s = l.st LEFT JOIN o y ON y.s = i.st UNION ALL SELECT new_id, kind, key, est, cal, st, xat FROM i JOIN n ON n.id = i.id""",
    "fuzzy_topk": f"SELECT key, freq, round(score, 8) AS score FROM (SELECT p_name AS key, count(*) AS freq, {_FUZZY.format(n='p_name', q='a')} AS score FROM part GROUP BY p_name) WHERE score IS NOT NULL ORDER BY score DESC, freq DESC, key LIMIT 10",
    "fuzzy_scores": """WITH c AS (SELECT c_custkey, lower(c_name) AS t FROM customer), p AS (SELECT *, instr(t, 'c') - 1 AS k1 FROM c), q AS (SELECT *, CASE WHEN k1 >= 0 AND instr(substr(t, k1 + 2), 'm') > 0 THEN k1 + instr(substr(t, k1 + 2), 'm') END AS k2 FROM p),
      r AS (SELECT *, CASE WHEN instr(substr(t, k2 + 2), '0') > 0 THEN k2 + instr(substr(t, k2 + 2), '0') END AS k3 FROM q), g AS (SELECT *, CASE WHEN k1 = 0 THEN 1 ELSE 0 END AS r1, CASE WHEN k2 = k1 + 1 THEN CASE WHEN k1 = 0 THEN 2 ELSE 1 END ELSE 0 END AS r2 FROM r)
      SELECT c_custkey, CASE WHEN instr(t, 'cm0') = 0 AND k3 IS NOT NULL THEN CAST(30 + CASE WHEN k1 = 0 THEN 6 ELSE CASE WHEN substr(t, k1, 1) IN (' ', '-', '(') THEN 12 ELSE 0 END - least(k1, 24) END
       + CASE WHEN k2 = k1 + 1 THEN (r1 + 1) * 6 ELSE CASE WHEN substr(t, k2, 1) IN (' ', '-', '(') THEN 12 ELSE 0 END - least(k2, 24) END + CASE WHEN k3 = k2 + 1 THEN (r2 + 1) * 6 ELSE CASE WHEN substr(t, k3, 1) IN (' ', '-', '(') THEN 12 ELSE 0 END - least(k3, 24) END AS DOUBLE) END AS score FROM g""",
    "url_scalars": r"SELECT page_id, CAST(CASE WHEN regexp_extract(url, '[?&]page=\s*([0-9]{1,9})', 1) = '' OR CAST(regexp_extract(url, '[?&]page=\s*([0-9]{1,9})', 1) AS BIGINT) = 0 THEN 1 ELSE CAST(regexp_extract(url, '[?&]page=\s*([0-9]{1,9})', 1) AS BIGINT) END AS BIGINT) AS page, CASE WHEN regexp_matches(url, '/works/[0-9]+') THEN 'work' WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]*/works/search([?#]|$)') THEN 'search' WHEN regexp_matches(url, '/tags/[^/]+/works') THEN 'tag' WHEN regexp_matches(url, '/users/[^/?#]+') THEN 'author' ELSE 'unknown' END AS kind, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages",
    "tag_urls": """SELECT p_partkey, part, true AS same, 'https://example.org/tags/' || part || '/works' || CASE WHEN p_partkey % 3 > 1 THEN '?page=2' ELSE '' END AS url FROM (SELECT p_partkey, replace(replace(p_name || '*s*' || p_brand || ' *a* Dr*d* ' || p_type || '*q**h*!', '#', '*h*'), ' ', '%20') AS part FROM part)""",
    "count_headings": "SELECT o_orderkey, o_orderkey * 7 AS works, o_orderkey AS found, o_orderkey AS words FROM orders",
    "completion_status": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'Incomplete' WHEN floor(l_quantity) <= 0 THEN NULL WHEN l_linenumber >= floor(l_quantity) THEN 'Complete' ELSE 'Incomplete' END AS status FROM lineitem",
    "ndcg_at_k": """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT l.doc_id, d.lang, CAST(l.quality AS DOUBLE) AS gain, d.rank FROM labels l JOIN d ON d.doc_id = l.doc_id WHERE l.quality > 0),
      b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, doc_id) AS best FROM g), k AS (SELECT unnest([5, 10, 20, 25, 50]) AS k)
      SELECT lang, CAST(k AS BIGINT) AS k, round(sum(CASE WHEN rank <= k THEN gain / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= k THEN gain / log2(best + 1) ELSE 0 END), 8) AS ndcg FROM b, k GROUP BY lang, k""",
    "warm_start_pairs": f"{_with(_seeds('st', [(0, str(k)) for k in (1, 4, 9, 16, 25)]))} SELECT CAST(position AS BIGINT) AS position, id, coalesce(lead(id) OVER (ORDER BY position), first_value(id) OVER (ORDER BY position)) AS next FROM st",
}
