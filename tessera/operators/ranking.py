"""Priors, the query pipeline, permeability, frontiers and result lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import FLUX_EPS, NEGATIVE_LAMBDA, expected_info, is_expandable, precision_prior, work_prior
from ..schema import AUTHOR, TAG, WORK, Graph
from ..session import materialize
from .adjacency import adjacency, seed_teleport, transitions
from .propagation import Params, Transitions

#: Metadata categories with one value, and with several.
SINGLE, MULTIPLE = ("language", "rating", "completionStatus"), ("archiveWarnings", "fandoms", "categories")


@dataclass
class CategoryFilter:
    """What a category lets through: `permeability` where it blocks. No values, no effect."""

    mode: str = "blacklist"
    permeability: float = 0.0
    values: tuple[str, ...] = ()


def prior_logs(graph: Graph) -> DataFrame:
    """(id, kind, a): a work's by its length, an author's by its works' sum, a tag's 0."""
    works = graph.nodes.filter(F.col("kind") == WORK).select("id", "kind", work_prior(F.col("wordCount")).alias("a"))
    w = works.select(F.col("id").alias("workNodeId"), "a")
    sums = graph.author_edges.join(w, "workNodeId").groupBy(F.col("authorNodeId").alias("__id")).agg(F.log1p(F.sum(F.exp("a"))).alias("s"))
    authors = graph.nodes.filter(F.col("kind") == AUTHOR).join(sums, F.col("id") == F.col("__id"), "left").select("id", "kind", F.coalesce("s", F.lit(0.0)).alias("a"))
    tags = graph.nodes.filter(F.col("kind") == TAG).select("id", "kind", F.lit(0.0).alias("a"))
    return works.unionByName(authors).unionByName(tags)


def teleport_from(prior: DataFrame) -> DataFrame:
    """(id, value): exp(a) over the sum of all."""
    got = prior.agg(F.coalesce(F.sum(F.exp("a")), F.lit(0.0)).alias("total"), F.count("*").alias("n")).first()
    value = F.exp("a") / F.lit(got["total"]) if got["total"] > 0 else F.lit(1.0 / max(got["n"], 1))
    return prior.select("id", value.alias("value"))


def contrast(positive: DataFrame, negative: DataFrame | None, lam: float = NEGATIVE_LAMBDA) -> DataFrame:
    """(id, value): positive less lam times negative relevance."""
    if negative is None or lam == 0:
        return positive
    return positive.select("id", "value").unionByName(negative.select("id", (F.col("value") * -lam).alias("value"))).groupBy("id").agg(F.sum("value").alias("value"))


def tag_flux(p: DataFrame, nodes: DataFrame, relevance: DataFrame) -> DataFrame:
    """(id, a) for tags: ln of the share of their inflow that comes from other kinds."""
    kinds = nodes.select("id", "kind")
    tags = kinds.filter(F.col("kind") == TAG).select(F.col("id").alias("dst"))
    flow = p.join(relevance.select(F.col("id").alias("src"), "value"), "src").join(tags, "dst").join(kinds.select(F.col("id").alias("src"), "kind"), "src")
    f = F.col("value") * F.col("p")
    sums = flow.groupBy("dst").agg(F.sum(F.when(F.col("kind") != TAG, f).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("kind") == TAG, f).otherwise(0.0)).alias("i"))
    b, i = F.coalesce("b", F.lit(0.0)), F.coalesce("i", F.lit(0.0))
    return tags.join(sums, "dst", "left").select(F.col("dst").alias("id"), F.log(b / (b + i + FLUX_EPS) + FLUX_EPS).alias("a"))


def precision(p: DataFrame, prior: DataFrame, authority: DataFrame) -> DataFrame:
    """(id, value): the prior precision and what neighbours' authority adds."""
    tau = precision_prior(F.col("a"))
    sent = authority.join(prior.select("id", "a"), "id").select(F.col("id").alias("src"), (F.col("value") * tau * F.log1p(F.exp("a"))).alias("m"))
    spread = p.join(sent, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("m")).alias("s"))
    return prior.join(spread, "id", "left").select("id", (tau + F.coalesce("s", F.lit(0.0))).alias("value"))


def run_query(graph: Graph, positive: DataFrame, negative: DataFrame | None = None, mu: DataFrame | None = None, lam: float = NEGATIVE_LAMBDA, params: Params | None = None, engine: str = "auto", adj: DataFrame | None = None) -> DataFrame:
    """Per node: positive, negative, relevance, authority, precision, expected_info.

    Seeds are (position, id) tables; with none at all every score is 0. Authority is
    found first by priors alone, weighs what relevance receives, then is found again
    with tag priors by flux; relevance is not.
    """
    params = params or Params()
    nodes = graph.nodes.select("id", "kind")
    n_pos, n_neg = positive.count(), negative.count() if negative is not None else 0
    if not n_pos and not n_neg:
        return nodes.select("id", "kind", *[F.lit(0.0).alias(c) for c in ("positive", "negative", "relevance", "authority", "precision", "expected_info")])
    t = Transitions(transitions(graph.nodes, adj if adj is not None else adjacency(graph), mu=mu), graph.nodes, engine)
    prior = materialize(prior_logs(graph), "priors")
    first, _ = t.run(teleport_from(prior), params)
    none = nodes.select("id", F.lit(0.0).alias("value")).limit(0)
    pos = t.run(seed_teleport(positive), params, first)[0] if n_pos else none
    neg = t.run(seed_teleport(negative), params, first)[0] if n_neg else None
    rel = contrast(pos, neg, lam)
    flux = tag_flux(t.table, graph.nodes, pos).select("id", F.col("a").alias("f"))
    prior2 = materialize(prior.join(flux, "id", "left").select("id", "kind", F.coalesce("f", "a").alias("a")), "priors")
    auth, _ = t.run(teleport_from(prior2), params)
    prec = precision(t.table, prior2, auth)
    out = nodes
    for name, v in (("positive", pos), ("negative", neg if neg is not None else none), ("relevance", rel), ("authority", auth), ("precision", prec)):
        out = out.join(v.select("id", F.col("value").alias(name)), "id", "left").fillna(0.0, [name])
    return out.withColumn("expected_info", expected_info(F.col("relevance"), F.col("authority"), F.col("precision")))


def category_permeability(value: Column, f: CategoryFilter, several: bool) -> Column:
    """A category's factor for one work: a blacklist blocks by any match, a whitelist by any value outside."""
    one = F.lit(1.0)
    if not f.values:
        return one
    chosen = F.array(*[F.lit(v) for v in f.values])
    if several:
        blocked = F.arrays_overlap(value, chosen) if f.mode == "blacklist" else F.size(F.array_except(value, chosen)) > 0
        return F.when(value.isNull() | (F.size(value) == 0), one).when(blocked, f.permeability).otherwise(one)
    blocked = value.isin(*f.values) if f.mode == "blacklist" else ~value.isin(*f.values)
    return F.when(value.isNull() | (value == ""), one).when(blocked, f.permeability).otherwise(one)


def permeability(nodes: DataFrame, filters: dict[str, CategoryFilter]) -> DataFrame:
    """(id, mu): the product over the categories for works with metadata, 1 for all others."""
    mu = F.lit(1.0)
    for name, f in filters.items():
        mu = mu * category_permeability(F.col(f"meta.{name}"), f, name in MULTIPLE)
    return nodes.select("id", F.when((F.col("kind") == WORK) & F.col("meta").isNotNull(), mu).otherwise(1.0).alias("mu"))


def frontier(nodes: DataFrame, scores: DataFrame, now: int) -> DataFrame:
    """Expandable nodes by expected_info, the least id first among equals."""
    open_ = nodes.filter(is_expandable(F.col("kind"), F.col("explorationStatus"), F.col("exploredAt"), now)).select("id", "key", "explorationStatus", "listingNextPage")
    return open_.join(scores.select("id", "kind", "expected_info"), "id").orderBy(F.desc("expected_info"), "id")


def rank_works(works: DataFrame, score: str, k: int, excluded: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """Works by score until k that are not suppressed are listed; suppressed ones stay in between, flagged.

    excluded and suppressed are (id) tables. Ties go by id. The k-th work that is not
    suppressed, found by a bounded top-k, tells how far the list goes, so only rows of the
    result are sorted.
    """
    left = works.join(excluded.select("id"), "id", "left_anti") if excluded is not None else works
    if suppressed is not None:
        hidden = suppressed.select("id").distinct().withColumn("suppressed", F.lit(True))
        left = left.join(hidden, "id", "left").fillna(False, ["suppressed"])
    else:
        left = left.withColumn("suppressed", F.lit(False))
    place = F.struct(F.col(score).alias("s"), (-F.col("id")).alias("i"))
    shown = left.filter(~F.col("suppressed")).orderBy(F.desc(score), "id").limit(k).agg(F.count("*").alias("n"), F.min(place).alias("last")).first()
    if shown["n"] == k and k > 0:
        # A null score stands last, by id, in this order as in the sort.
        last = shown["last"]
        if last["s"] is None:
            left = left.filter(F.col(score).isNotNull() | (F.col("id") <= -last["i"]))
        else:
            left = left.filter((F.col(score) > last["s"]) | ((F.col(score) == last["s"]) & (F.col("id") <= -last["i"])))
    elif k <= 0:
        left = left.limit(0)
    return left.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def fetch_plans(nodes: DataFrame) -> DataFrame:
    """(id, type, key, page): what fetching each node means."""
    page = F.when(F.col("explorationStatus") == "complete", 1).otherwise(F.coalesce("listingNextPage", F.lit(1)))
    kind = F.when(F.col("kind") == WORK, "work").when(F.col("kind") == TAG, "tagListing").otherwise("authorListing")
    return nodes.select("id", kind.alias("type"), "key", F.when(F.col("kind") != WORK, page).alias("page"))
