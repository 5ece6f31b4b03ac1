"""Queries over the star-schema tables, one for each operator or a few that belong together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as TX
from .functions import urls as U
from .functions.scores import is_expandable
from .operators import adjacency as A
from .operators import evaluate as E
from .operators import ranking as R
from .operators import store as S
from .operators import topology as T
from .operators.propagation import LOCAL_EDGES, Params, Transitions
from .schema import TAG, WORK, Graph
from .session import discard, materialize, spread
from .sources.tables import load_graph, read, stats_tags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries: seeds, rounds, and a fixed now.
POSITIVE = [(0, "1"), (0, "20"), (1, "5"), (0, "1"), (0, "no such work")]
NEGATIVE = [(0, "7"), (1, "11")]
NOW = 1_735_689_600_000
FILTERS = {
    "rating": R.CategoryFilter("blacklist", 0.5, ("1-URGENT",)),
    "language": R.CategoryFilter("whitelist", 0.2, ("BUILDING", "AUTOMOBILE", "MACHINERY")),
    "archiveWarnings": R.CategoryFilter("whitelist", 0.4, ("A", "N")),
    "categories": R.CategoryFilter("blacklist", 0.25, ("ECONOMY ANODIZED STEEL", "PROMO")),
}
TEN, FIVE = Params(0.15, 10, 0.0), Params(0.15, 5, 0.0)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r8(c, n: int = 8):
    return F.round(c, n)


def _p(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame, Transitions]:
    g = load_graph(spark, sf)
    g = Graph(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"), materialize(g.author_edges, "edges"))
    adj, rows = A.stored_adjacency(g, LOCAL_EDGES)
    return g, adj, Transitions.over(g.nodes, adj, rows)


@query
def graph_stats(spark, sf):
    g = load_graph(spark, sf)
    kinds = g.nodes.groupBy().agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in enumerate(("works", "tags", "authors"))])
    counts = {"edges": g.edges.count(), "author_edges": g.author_edges.count()}
    return kinds.withColumns({k: F.lit(v).cast("long") for k, v in counts.items()})


@query
def degree_distribution(spark, sf):
    d = A.degrees(A.adjacency(load_graph(spark, sf)))
    return d.groupBy("degree").agg(F.count("*").alias("n"))


@query
def node_table(spark, sf):
    return load_graph(spark, sf).nodes.select("id", "kind", "key", "wordCount", "estimatedFreq", "calibratedFreq", "explorationStatus", "exploredAt", "listingNextPage")


@query
def adjacency_weights(spark, sf):
    return A.adjacency(load_graph(spark, sf)).select("src", "dst", r8("weight").alias("weight"))


@query
def row_out_fraction(spark, sf):
    g = load_graph(spark, sf)
    return A.with_out_fraction(g.nodes, A.adjacency(g)).select("id", F.col("degree").cast("long").alias("degree"), r8("rho").alias("rho"))


@query
def transition_rows(spark, sf):
    g = load_graph(spark, sf)
    return A.transitions(g.nodes, A.adjacency(g)).select("src", "dst", r8("p").alias("p"))


@query
def signed_edges(spark, sf):
    g = load_graph(spark, sf)
    negative = [r["id"] for r in A.resolve_seeds(g.nodes, NEGATIVE).select("id").collect()]  # as many as seeds
    return A.transitions(g.nodes, A.adjacency(g), negative).select("src", "dst", r8("p").alias("p"))


@query
def permeability_mu(spark, sf):
    return R.permeability(load_graph(spark, sf, meta=True).nodes, FILTERS).select("id", r8("mu").alias("mu"))


@query
def transition_permeable(spark, sf):
    g = load_graph(spark, sf, meta=True)
    mu = R.permeability(g.nodes, FILTERS)
    return A.transitions(g.nodes, A.adjacency(g), mu=mu).select("src", "dst", r8("p").alias("p"))


@query
def seed_resolution(spark, sf):
    return A.resolve_seeds(load_graph(spark, sf).nodes, POSITIVE).select(F.col("position").cast("long").alias("position"), "id")


@query
def seed_teleport(spark, sf):
    return A.seed_teleport(A.resolve_seeds(load_graph(spark, sf).nodes, POSITIVE)).select("id", r8("value").alias("value"))


@query
def prior_logs(spark, sf):
    return R.prior_logs(load_graph(spark, sf)).select("id", r8("a").alias("a"))


@query
def teleport_prior(spark, sf):
    return R.teleport_from(R.prior_logs(load_graph(spark, sf))).select("id", r8("value", 10).alias("value"))


@query
def ppr_relevance_k10(spark, sf):
    g, _, t = _p(spark, sf)
    v, _ = t.run(A.seed_teleport(A.resolve_seeds(g.nodes, POSITIVE)), TEN)
    return v.select("id", r8("value").alias("value")).filter("value > 0")


@query
def ppr_contrast_k10(spark, sf):
    g, _, t = _p(spark, sf)
    a, b = (t.run(A.seed_teleport(A.resolve_seeds(g.nodes, s)), TEN)[0] for s in (POSITIVE, NEGATIVE))
    return R.contrast(a, b).select("id", r8("value").alias("value")).filter("value <> 0")


@query
def authority_k10(spark, sf):
    g, _, t = _p(spark, sf)
    v, _ = t.run(R.teleport_from(R.prior_logs(g)), TEN)
    return v.select("id", r8("value", 10).alias("value"))


@query
def query_scores_k5(spark, sf):
    """The whole pipeline: authority, receiver-weighted relevance, contrast, flux, precision, expected information."""
    g, adj, _ = _p(spark, sf)
    out = R.run_query(g, A.resolve_seeds(g.nodes, POSITIVE), A.resolve_seeds(g.nodes, NEGATIVE), params=FIVE, adj=adj)
    return out.select("id", *[r8(c, 9).alias(c) for c in ("positive", "negative", "relevance", "authority", "precision")], r8(F.col("expected_info") * 1e6, 6).alias("expected_info"))


@query
def expected_info_topk(spark, sf):
    g, adj, _ = _p(spark, sf)
    scores = R.run_query(g, A.resolve_seeds(g.nodes, POSITIVE), None, params=FIVE, adj=adj)
    return R.frontier(g.nodes, scores, NOW).select("id", "key", r8(F.col("expected_info") * 1e6, 6).alias("expected_info")).limit(25)


@query
def expandable_frontier(spark, sf):
    n = load_graph(spark, sf).nodes
    return n.filter(is_expandable(F.col("kind"), F.col("explorationStatus"), F.col("exploredAt"), NOW)).select("id", "kind", "explorationStatus")


@query
def fetch_plans(spark, sf):
    return R.fetch_plans(load_graph(spark, sf).nodes).select("id", "type", "key", F.col("page").cast("long").alias("page"))


@query
def rank_works_suppressed(spark, sf):
    """Works by length; every third is suppressed, those of negative seeds are out."""
    g = load_graph(spark, sf)
    works = g.nodes.filter(F.col("kind") == WORK).select("id", "key", "wordCount", "title")
    seeds = A.resolve_seeds(g.nodes, POSITIVE + NEGATIVE).select("id")
    hidden = works.filter(F.col("key").cast("long") % 3 == 0).select("id")
    return R.rank_works(works, "wordCount", 25, seeds, hidden).select(F.col("rank").cast("long").alias("rank"), "id", "title", "wordCount", "suppressed")


def _phi(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame, DataFrame]:
    """A potential with an oracle: relevance after ten rounds, the prior teleport as authority."""
    g, adj, t = _p(spark, sf)
    rel, _ = t.run(A.seed_teleport(A.resolve_seeds(g.nodes, POSITIVE)), TEN)
    auth = R.teleport_from(materialize(R.prior_logs(g), "priors"))
    both = g.nodes.select("id").join(rel.select("id", F.col("value").alias("relevance")), "id", "left").join(auth.select("id", F.col("value").alias("authority")), "id", "left").fillna(0.0)
    phi = materialize(T.potentials(both), "phi")
    t.release()
    return g, adj, phi


@query
def conductance_degree(spark, sf):
    _, adj, phi = _phi(spark, sf)
    return T.conductance_degree(T.conductance(adj, phi)).select("id", r8(F.col("degree_c") * 1e6, 6).alias("degree_c"))


@query
def threshold_schedule(spark, sf):
    """Eight levels of the works' lengths as potential."""
    works = load_graph(spark, sf).nodes.filter(F.col("kind") == WORK)
    phi = T.potentials(works.select("id", F.col("wordCount").cast("double").alias("relevance"), F.lit(1.0).alias("authority")))
    return T.thresholds(materialize(phi, "phi"), 8).select(F.col("level").cast("long").alias("level"), r8("value").alias("value"))


@query
def fragility_scores(spark, sf):
    """Openness, boundary conductance and influence for the set of nodes of more than an even share of potential."""
    g, adj, phi = _phi(spark, sf)
    members = phi.filter(F.col("phi") >= F.lit(1.0 / phi.count())).select("id")
    rows = adj.join(members.withColumnRenamed("id", "src"), "src", "left_semi").join(members.withColumnRenamed("id", "dst"), "dst", "left_anti")
    boundary = rows.select(F.col("src").alias("id")).distinct()
    rho = A.with_out_fraction(g.nodes, adj)
    return T.fragility(rho, T.conductance(adj, phi), phi, boundary).select("id", r8(F.col("fragility") * 1e9, 6).alias("fragility")).filter("fragility > 0")


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """A family of small sets: for each brand and type the sizes of its parts, modulo 12, numbered by brand and type."""
    p = read(spark, sf, "part")
    sets = p.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set((F.col("p_size") % 12).cast("long"))).alias("nodes"))
    return sets.select(F.concat_ws("|", "p_brand", "p_type").alias("hid"), "nodes")


@query
def hypothesis_inclusions(spark, sf):
    return T.inclusions(_sets(spark, sf)).select("lower", "upper")


@query
def hasse_covers(spark, sf):
    return T.covers(T.inclusions(_sets(spark, sf))).select("lower", "upper")


@query
def order_shape(spark, sf):
    s = _sets(spark, sf)
    return T.order_shape(s, T.inclusions(s))


@query
def bfs_distances(spark, sf):
    g, adj, _ = _p(spark, sf)
    return E.bfs_distances(adj, A.resolve_seeds(g.nodes, [(1, "5")]), 3).select("id", F.col("distance").cast("long").alias("distance"))


@query
def depth_ball(spark, sf):
    g, adj, _ = _p(spark, sf)
    ball = E.depth_ball(g, adj, A.resolve_seeds(g.nodes, [(1, "5")]), 2)
    return ball.edges.select("workNodeId", F.col("tagNodeId").alias("hubNodeId")).unionByName(ball.author_edges.select("workNodeId", F.col("authorNodeId").alias("hubNodeId")))


@query
def canonical_tags(spark, sf):
    return S.alias_roots(stats_tags(spark, sf)).select("tag_id", "root", F.col("hops").cast("long").alias("hops"))


def _named(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """The graph with the statistics' names as tag keys."""
    g, s = load_graph(spark, sf), stats_tags(spark, sf)
    n = s.select(F.col("tag_id").cast("string").alias("__k"), F.col("name").alias("__n"))
    nodes = g.nodes.join(spread(n), (F.col("kind") == TAG) & (F.col("key") == F.col("__k")), "left").withColumn("key", F.coalesce("__n", "key")).drop("__k", "__n")
    return Graph(nodes, g.edges, g.author_edges), s


@query
def stats_calibration(spark, sf):
    g, s = _named(spark, sf)
    return S.calibrate(g.nodes, s).filter(F.col("kind") == TAG).select("id", "key", "calibratedFreq")


@query
def tag_merge_edges(spark, sf):
    g, s = _named(spark, sf)
    merged, _ = S.merge_tags(g, S.canonical_names(s))
    return merged.edges.select("workNodeId", "tagNodeId")


@query
def tag_merge_nodes(spark, sf):
    g, s = _named(spark, sf)
    merged, _ = S.merge_tags(g, S.canonical_names(s))
    return merged.nodes.filter(F.col("kind") == TAG).select("id", "key", "estimatedFreq", "calibratedFreq", "explorationStatus")


def listing_events(spark: SparkSession, sf: str) -> DataFrame:
    """events as listing pages: the user is the hub, `value` the work count, the JSON's k the page."""
    e = read(spark, sf, "events")
    page = F.get_json_object("props", "$.k").cast("int")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("hub"), seq.cast("long").alias("seq"), F.floor("value").cast("long").alias("count"), page.alias("page"), F.when(page % 3 != 0, page + 1).alias("next_page"))


@query
def listing_transitions(spark, sf):
    out = S.fold_listings(listing_events(spark, sf))
    return out.select("hub", "seq", "explorationStatus", F.col("listingNextPage").cast("long").alias("listingNextPage"), F.col("listingPagesFetched").cast("long").alias("listingPagesFetched"), "calibratedFreq", "demoted")


@query
def snapshot_diff(spark, sf):
    n = load_graph(spark, sf).nodes.select("id", "exploredAt")
    after = n.withColumn("exploredAt", F.when(F.col("id") % 5 == 0, F.lit(NOW)).otherwise(F.col("exploredAt")))
    return S.changed_between(n.filter(F.col("id") % 7 != 0), after)


@query
def graph_merge_upsert(spark, sf):
    """The whole graph, and a whole copy of it with other values and, for every fourth key, keys that are new."""
    g = load_graph(spark, sf)
    k = F.col("key").cast("long")
    there = g.nodes.withColumns({
        "estimatedFreq": F.col("estimatedFreq") + F.when(k % 2 == 0, 1.0).otherwise(-0.5), "calibratedFreq": F.when(k % 6 == 0, F.lit(3.0)).otherwise(F.col("calibratedFreq")),
        "explorationStatus": F.when(k % 9 == 0, "partial").otherwise(F.col("explorationStatus")), "exploredAt": F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.col("exploredAt") + 10).otherwise(F.col("exploredAt")),
    }).withColumn("key", F.when(k % 4 == 0, F.concat(F.lit("new "), "key")).otherwise(F.col("key")))
    out = S.import_merge(g, Graph(there, g.edges, g.author_edges), 1_000_000_000)
    return out.graph.nodes.select("id", "kind", "key", "estimatedFreq", "calibratedFreq", "explorationStatus", "exploredAt")


@query
def fuzzy_topk(spark, sf):
    names = read(spark, sf, "part").groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("freq"))
    best = TX.fuzzy_top(names, "a", 10)
    return best.select("key", "freq", r8("score").alias("score"))


@query
def fuzzy_scores(spark, sf):
    """Letters in order, against every customer's name."""
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return c.select("c_custkey", TX.fuzzy_score("cm0", F.col("name")).alias("score"))


@query
def url_scalars(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", U.page_number(u).cast("long").alias("page"), U.page_kind(u).alias("kind"), F.regexp_extract(u, "^[a-z]+://([^/]+)", 1).alias("host"))


@query
def tag_urls(spark, sf):
    """Encoded and decoded again: names with blanks, slashes, dots and marks."""
    name = F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit(" & Dr. "), F.col("p_type"), F.lit("?#!"))
    p = read(spark, sf, "part").select("p_partkey", name.alias("name"))
    part = U.encode_tag(F.col("name"))
    return p.select("p_partkey", part.alias("part"), (U.decode_tag(part) == F.col("name")).alias("same"), U.tag_works_url(F.col("name"), (F.col("p_partkey") % 3).cast("int")).alias("url"))


@query
def count_headings(spark, sf):
    head = F.concat(F.lit("1 - 20 of "), F.format_number(F.col("o_orderkey") * 7, 0), F.lit(" Works in X"))
    found = F.concat(F.format_number(F.col("o_orderkey"), 0), F.lit(" Found"))
    o = read(spark, sf, "orders").select("o_orderkey", head.alias("h"), found.alias("f"))
    return o.select("o_orderkey", TX.work_count(F.col("h")).alias("works"), TX.found_count(F.col("f")).alias("found"), TX.blurb_words(F.concat(F.lit(" "), F.col("f"))).alias("words"))


@query
def completion_status(spark, sf):
    chapters = F.concat((F.col("l_linenumber")).cast("string"), F.lit("/"), F.when(F.col("l_returnflag") == "N", "?").otherwise(F.floor("l_quantity").cast("int").cast("string")))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", chapters.alias("c"))
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), TX.completion_of_chapters(F.col("c")).alias("status"))


@query
def ndcg_at_k(spark, sf):
    """labels' quality as gain, longer documents ranked first, by language."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang", "n_chars")
    lab = read(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("gain"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "key"))
    predicted = d.withColumn("rank", rank)
    out = E.ndcg(predicted, lab.join(d.select("key", "lang"), "key"), [5, 10, 20, 25, 50], ["lang"])
    return out.select("lang", F.col("k").cast("long").alias("k"), r8("ndcg").alias("ndcg"))


@query
def warm_start_pairs(spark, sf):
    g = load_graph(spark, sf)
    seeds = A.resolve_seeds(g.nodes, [(0, str(k)) for k in (1, 4, 9, 16, 25)])
    return E.warm_pairs(seeds).select(F.col("position").cast("long").alias("position"), "id", "next")


@query
def html_parse(spark, sf):
    """Every page by the kind its address tells; general pages are of none."""
    from .sources.html import parse_pages

    return parse_pages(read(spark, sf, "pages")).select("page_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.col("page").cast("long").alias("page"))


@query
def query_astar(spark, sf):
    """The best-first query search over a graph's fragile tags and nodes: one row with the plan."""
    from .plans.discovery import fragile_nodes
    from .plans.query_search import collect_candidates, search

    g, adj, phi = _phi(spark, sf)
    for links in (g.edges, g.author_edges):  # all that follows is in adj
        discard(links)
    rel = A.resolve_seeds(g.nodes, POSITIVE).select("id", F.lit(0.1).alias("relevance"))
    scores = g.nodes.select("id").join(phi, "id").join(rel, "id", "left").select("id", F.coalesce("relevance", "phi").alias("relevance"), F.col("phi").alias("authority"))
    shape = fragile_nodes(g, adj, scores)
    f, edge = shape.fragility, shape.boundary
    got = search(collect_candidates(g.nodes, f.join(scores.select("id", "relevance"), "id"), A.degrees(adj), edge, NOW))
    plan = got.plan or {"type": None}
    key = plan.get("key") or (plan["params"].url("") if "params" in plan else None)
    return spark.createDataFrame([(plan["type"], key, float(got.score), got.depth, got.expanded)], "type string, key string, score double, depth long, expanded long")


@query
def fog_of_war(spark, sf):
    """Mean NDCG of cold searches over the smallest preset world at all budgets, one seed a community."""
    from .plans.corpus import SHAPES
    from .plans.evaluation import evaluate

    return evaluate(spark, SHAPES["small"]).select("seed", F.col("depth").cast("long").alias("depth"), "nodes", "works", r8("ndcg").alias("ndcg"))


@query
def warm_start(spark, sf):
    """The same after ten, twenty and forty expansions from another seed."""
    from .plans.corpus import SHAPES
    from .plans.evaluation import evaluate

    cells = evaluate(spark, SHAPES["small"], warm=True)
    return cells.select("seed", "first", F.col("initial").cast("long").alias("initial"), F.col("depth").cast("long").alias("depth"), "nodes", "works", r8("ndcg").alias("ndcg"))
