"""Neighbourhoods of a potential on the graph: conductance, superlevel sets, their order, and fragility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import potential
from ..plans.numbering import numbered
from ..session import materialize
from .components import label_components

# Fixed values of the topology policy.
MAX_LEVELS, MAX_HYPOTHESES, MAX_ALTERNATES = 32, 256, 3
H1_BOOST = 1.25
TINY = 1e-12


def potentials(scores: DataFrame) -> DataFrame:
    """(id, phi) of (id, relevance, authority)."""
    return scores.select("id", potential(F.col("relevance"), F.col("authority")).alias("phi"))


def conductance(adj: DataFrame, phi: DataFrame, live: bool = False) -> DataFrame:
    """(src, dst, c): the product of both ends' potential on every link; `live` leaves out links from nodes without potential, whose product is 0."""
    a, b = phi.select(F.col("id").alias("src"), F.col("phi").alias("x")), phi.select(F.col("id").alias("dst"), F.col("phi").alias("y"))
    a = a.filter("x > 0") if live else a
    return adj.select("src", "dst").join(a.hint("shuffle_hash"), "src").join(b, "dst").select("src", "dst", (F.col("x") * F.col("y")).alias("c"))


def conductance_degree(c: DataFrame) -> DataFrame:
    return c.groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("degree_c"))


def thresholds(phi: DataFrame, levels: int = MAX_LEVELS) -> DataFrame:
    """(level, value): positive potentials, descending, sampled evenly by rank; halves round up."""
    values = phi.filter((F.col("phi") > 0) & ~F.isnan("phi") & (F.col("phi") < float("inf"))).select("phi").distinct()
    m = values.count()
    n = max(1, min(levels, m)) if m else 0
    places = [(i, int((i * (m - 1)) / (n - 1) + 0.5) if n > 1 else 0) for i in range(n)]
    wanted = phi.sparkSession.createDataFrame(places, "level int, place long")
    # Potentials spread over many magnitudes: runs are sixteenths of an octave.
    ranked = numbered(values, -F.floor(F.log2("phi") * 16), [F.desc("phi")], "n")
    return F.broadcast(wanted).join(ranked, F.col("place") == F.col("n")).select("level", F.col("phi").alias("value"))


def superlevel_components(adj: DataFrame, phi: DataFrame, level: float) -> DataFrame:
    """(id, component): nodes of potential level or more, by their least member reached over positive conductance."""
    return level_components(adj, phi, phi.sparkSession.createDataFrame([(0, float(level))], "level int, value double")).select("id", "component")


def level_components(adj: DataFrame, phi: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, value, id, component) for all levels (level, value) at once: one labelling of nodes of every level they are in.

    A node of a level is told by id * (number of levels) + level, so links never cross levels
    and the least name of a component is that of its least member.
    """
    n = levels.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] + 1
    inside = phi.join(F.broadcast(levels), F.col("phi") >= F.col("value")).select("level", "value", "id", "phi")  # MAX_LEVELS rows at most
    live = phi.filter("phi > 0").select("id", F.col("phi"))
    a, b = live.select(F.col("id").alias("src"), F.col("phi").alias("x")), live.select(F.col("id").alias("dst"), F.col("phi").alias("y"))
    links = adj.filter(F.col("src") < F.col("dst")).select("src", "dst").join(a.hint("shuffle_hash"), "src").join(b, "dst").filter(F.col("x") * F.col("y") > 0)
    at = links.join(F.broadcast(levels), F.least("x", "y") >= F.col("value")).select((F.col("src") * n + F.col("level")).alias("a"), (F.col("dst") * n + F.col("level")).alias("b"))
    labels = label_components(at)
    own = inside.withColumn("name", F.col("id") * n + F.col("level"))
    return own.join(labels, F.col("name") == F.col("node"), "left").select("level", "value", "id", F.when(F.col("label").isNotNull(), F.floor(F.col("label") / n)).otherwise(F.col("id")).cast("long").alias("component"))


def hypotheses_of_levels(members: DataFrame, phi: DataFrame) -> DataFrame:
    """One row for each distinct node set of rows (level, value, id, component): hid, least, size, birth, death, mass, level (of its birth).

    Superlevel sets are nested, so a least member and a size tell a set. hid is `least:size`.
    """
    sets = members.join(phi, "id").groupBy("level", "value", "component").agg(F.count("*").alias("size"), F.sum("phi").alias("mass"))
    out = sets.groupBy(F.col("component").alias("least"), "size").agg(F.max("value").alias("birth"), F.min("value").alias("death"), F.max("mass").alias("mass"), F.min("level").alias("level"))
    return out.withColumn("hid", F.concat_ws(":", "least", "size"))


def members_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(hid, id) of hypotheses_of_levels' sets."""
    at = sets.select("hid", F.col("least").alias("component"), F.col("level").alias("l"))
    return members.join(at, "component").filter(F.col("level") == F.col("l")).select("hid", "id")


def persistence(birth, death, mass):
    return F.greatest(F.lit(0.0), birth - death) * mass + mass * TINY


def _signed(rows: DataFrame) -> DataFrame:
    """(hids, n): how many nodes are in exactly the same sets; of rows (hid, node)."""
    return rows.groupBy("node").agg(F.array_sort(F.collect_set("hid")).alias("hids")).groupBy("hids").agg(F.count("*").alias("n"))


def inclusions(sets: DataFrame) -> DataFrame:
    """(lower, upper): pairs of sets (hid, nodes) of which one strictly holds the other."""
    return inclusions_of(sets.select("hid", F.explode("nodes").alias("node")))


def inclusions_of(rows: DataFrame) -> DataFrame:
    """`inclusions` of sets given as rows (hid, node).

    Nodes that are in the same sets are counted together first (there are as many such
    groups as places in the order of sets, however many nodes), and pairs are made of
    the sets of each group. A set is held by another if they share as many nodes as it has.
    """
    groups = materialize(_signed(rows), "groups")
    size = groups.select(F.explode("hids").alias("lower"), "n").groupBy("lower").agg(F.sum("n").alias("size"))
    a = groups.select("hids", "n", F.explode("hids").alias("lower"))
    shared = a.select("lower", "n", F.explode("hids").alias("upper")).filter("lower <> upper").groupBy("lower", "upper").agg(F.sum("n").alias("k"))
    upper = size.select(F.col("lower").alias("upper"), F.col("size").alias("upper_size"))
    return shared.join(size, "lower").join(upper, "upper").filter((F.col("k") == F.col("size")) & (F.col("upper_size") > F.col("size"))).select("lower", "upper")


def covers(pairs: DataFrame) -> DataFrame:
    """Inclusions without a set in between."""
    p, q = pairs.select("lower", F.col("upper").alias("mid")), pairs.select(F.col("lower").alias("mid"), "upper")
    between = p.join(q, "mid").select("lower", "upper").distinct()
    return pairs.join(between, ["lower", "upper"], "left_anti")


def betti(sets: DataFrame, cover: DataFrame) -> DataFrame:
    """(beta0, beta1, vertices, edges) of the order's undirected graph."""
    v, e = sets.count(), cover.select(F.least("lower", "upper"), F.greatest("lower", "upper")).distinct().count()
    labels = label_components(cover.select(F.xxhash64("lower").alias("a"), F.xxhash64("upper").alias("b")))
    linked = labels.agg(F.count("*").alias("n"), F.countDistinct("label").alias("c")).first()
    b0 = v - linked["n"] + linked["c"]
    return sets.sparkSession.createDataFrame([(b0, max(0, e - v + b0), v, e)], "beta0 long, beta1 long, vertices long, edges long")


def order_shape(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(height, width): the longest chain, and the most sets with equally many below them."""
    below = sets.select("hid").join(pairs.groupBy(F.col("upper").alias("hid")).agg(F.count("*").alias("rank")), "hid", "left").fillna(0, ["rank"])
    width = below.groupBy("rank").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("w")).first()["w"]
    height, level = 0, sets.select("hid")
    cover = materialize(covers(pairs), "covers")
    level = level.join(cover.select(F.col("upper").alias("hid")), "hid", "left_anti")
    while level.limit(1).count():  # as many rounds as the order is high
        height += 1
        level = materialize(level.join(cover, level["hid"] == cover["lower"]).select(F.col("upper").alias("hid")).distinct(), "level")
    return sets.sparkSession.createDataFrame([(max(0, height - 1), width)], "height long, width long")


def boundary_nodes(adj: DataFrame, rows: DataFrame, n_nodes: int) -> DataFrame:
    """(id): members with a neighbour outside, over the sets of rows (hid, id) that are smaller than the whole graph.

    Nodes in the same sets form a group, as in `inclusions_of`, so links are looked at
    once and not for each set: a member is at the boundary if it has a neighbour in a group
    that lacks one of its own group's sets.
    """
    proper = rows.groupBy("hid").agg(F.count("*").alias("size")).filter(F.col("size") < n_nodes).select("hid")
    inside = materialize(rows.join(proper, "hid", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("hid")).alias("hids")), "inside")
    groups = materialize(inside.select("hids").distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    named = materialize(inside.join(groups, "hids").select("id", "g"), "grouped")
    a, b = named.select(F.col("id").alias("src"), F.col("g").alias("a")), named.select(F.col("id").alias("dst"), F.col("g").alias("b"))
    near = adj.select("src", "dst").join(a.hint("shuffle_hash"), "src").join(b, "dst", "left").select("src", "a", F.coalesce("b", F.lit(-1)).alias("b"))
    near = materialize(near.filter("a <> b").distinct(), "near")
    met = near.select("a", "b").distinct().join(groups.select(F.col("g").alias("a"), F.col("hids").alias("own")), "a").join(groups.select(F.col("g").alias("b"), "hids"), "b", "left")
    out = met.filter(F.col("hids").isNull() | (F.size(F.array_except("own", "hids")) > 0)).select("a", "b")
    return near.join(out, ["a", "b"], "left_semi").select(F.col("src").alias("id")).distinct()


def fragility(nodes: DataFrame, c: DataFrame, phi: DataFrame, boundary: DataFrame, h1_nodes: DataFrame | None = None) -> DataFrame:
    """(id, fragility) of nodes (id, rho): openness times conductance to the boundary, times potential influence."""
    near = c.join(boundary.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("near"))
    out = nodes.select("id", "rho").join(near, "id", "left").join(phi, "id", "left").join(conductance_degree(c), "id", "left").fillna(0.0, ["near", "phi", "degree_c"])
    value = F.greatest(F.lit(0.0), 1.0 - F.col("rho")) * F.col("near") * (F.col("phi") * (1.0 + F.col("degree_c")))
    if h1_nodes is None:
        return out.select("id", value.alias("fragility"))
    marked = h1_nodes.select("id").distinct().withColumn("h1", F.lit(True))
    return out.join(marked, "id", "left").select("id", F.when(F.col("h1"), value * H1_BOOST).otherwise(value).alias("fragility"))


def h1_sets(sets: DataFrame, cover: DataFrame) -> DataFrame:
    """(hid) of two covers or more, where the order has a cycle; else none."""
    if betti(sets, cover).first()["beta1"] <= 0:
        return sets.select("hid").limit(0)
    ends = cover.select(F.explode(F.array("lower", "upper")).alias("hid"))
    return ends.groupBy("hid").count().filter("count >= 2").select("hid")


def boundary_candidates(rows: DataFrame, c: DataFrame, phi: DataFrame, rho: DataFrame) -> DataFrame:
    """(hid, w, score, r): the open outside neighbours of the sets of rows (hid, id), best first.

    A neighbour reached by several links counts by its best; ties go by the least
    member, then the least neighbour.
    """
    open_ = rho.select(F.col("id").alias("dst"), F.greatest(F.lit(0.0), 1.0 - F.col("rho")).alias("open")).filter("open > 0").join(phi.select(F.col("id").alias("dst"), "phi"), "dst")
    links = c.join(open_, "dst").select("src", "dst", (F.col("open") * F.col("c") * F.col("phi")).alias("score"))
    out = rows.join(links, rows["id"] == links["src"]).select("hid", "src", "dst", "score").join(rows.select("hid", F.col("id").alias("dst")), ["hid", "dst"], "left_anti")
    best = out.groupBy("hid", "dst").agg(F.max(F.struct("score", (-F.col("src")).alias("s"))).alias("m"))
    rank = F.row_number().over(Window.partitionBy("hid").orderBy(F.desc("m.score"), F.desc("m.s"), "dst"))
    return best.withColumn("r", rank).select("hid", F.col("dst").alias("w"), F.col("m.score").alias("score"), "r")


def boundary_alternates(sets: DataFrame, rows: DataFrame, candidates: DataFrame, most: int = MAX_ALTERNATES) -> DataFrame:
    """(hid, w): up to `most` extensions H + w of each set, none of which is a set already or an earlier set's extension.

    As if the sets chose one after another, by (level, least): every set asks for its best
    candidates, of equal extensions that of the first set stays, and the others ask on.
    What a later set is refused an earlier one never gives up, so this ends where the
    one-by-one choice would.
    """
    named = rows.groupBy("hid").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    known = named.join(sets.select("hid", "size"), "hid").select(F.col("h").alias("key"), F.col("size").alias("n"))
    made = candidates.join(named, "hid").join(sets.select("hid", "size", "level", "least"), "hid")
    made = made.select("hid", "w", "r", "level", "least", (F.col("h") + F.xxhash64("w").cast("decimal(38,0)")).cast("decimal(38,0)").alias("key"), (F.col("size") + 1).alias("n"))
    left = materialize(made.join(known, ["key", "n"], "left_anti"), "alternates")
    while True:
        asked = left.withColumn("turn", F.row_number().over(Window.partitionBy("hid").orderBy("r"))).filter(F.col("turn") <= most)
        first = F.row_number().over(Window.partitionBy("key", "n").orderBy("level", "least", "hid"))
        asked = materialize(asked.withColumn("place", first), "asked")
        refused = asked.filter("place > 1").select("hid", "w")
        if not refused.limit(1).count():
            return asked.select("hid", "w")
        left = materialize(left.join(refused, ["hid", "w"], "left_anti"), "alternates")


@dataclass
class Neighborhoods:
    """sets (hid, kind, birth, death, mass) and rows (hid, id) of the most persistent hypotheses, and the levels they come from."""

    sets: DataFrame
    rows: DataFrame
    levels: DataFrame


def neighborhoods(adj: DataFrame, phi: DataFrame, rho: DataFrame, c: DataFrame, levels: int = MAX_LEVELS, most: int = MAX_HYPOTHESES, alternates: int = MAX_ALTERNATES) -> Neighborhoods:
    """Superlevel sets of all levels, extended at their open boundaries, the `most` most persistent of them.

    Of equally persistent ones sets come before extensions, then earlier levels, then lesser members.
    """
    at = materialize(thresholds(phi, levels), "levels")
    members = materialize(level_components(adj, phi, at), "members")
    own = materialize(hypotheses_of_levels(members, phi), "sets")
    rows = materialize(members_of(members, own), "rows")
    extra = boundary_alternates(own, rows, boundary_candidates(rows, c, phi, rho), alternates)
    p = phi.select(F.col("id").alias("w"), "phi")
    grown = extra.join(own.drop("size"), "hid").join(p, "w").select(F.concat_ws("+", "hid", "w").alias("hid"), F.lit("boundary-alt").alias("kind"), "birth", "death", (F.col("mass") + F.col("phi")).alias("mass"), "level", "least", F.col("hid").alias("of"), "w")
    both = own.select("hid", F.lit("superlevel").alias("kind"), "birth", "death", "mass", "level", "least", F.col("hid").alias("of"), F.lit(None).cast("long").alias("w")).unionByName(grown)
    kept = materialize(both.orderBy(F.desc(persistence(F.col("birth"), F.col("death"), F.col("mass"))), F.desc("kind"), "level", "least", "hid").limit(most), "kept")
    base = kept.select("hid", F.col("of").alias("base")).join(rows.withColumnRenamed("hid", "base"), "base").select("hid", "id")
    return Neighborhoods(kept.select("hid", "kind", "birth", "death", "mass"), materialize(base.unionByName(kept.filter("w is not null").select("hid", F.col("w").alias("id"))), "kept_rows"), at)


@dataclass
class Topology:
    """Neighbourhoods, the cover relation of their order, its Betti numbers, their boundary, and every node's fragility."""

    found: Neighborhoods
    cover: DataFrame
    beta0: int
    beta1: int
    boundary: DataFrame
    fragility: DataFrame

    @property
    def trivial(self) -> bool:
        return self.beta0 <= 1 and self.beta1 == 0


def topology(nodes: DataFrame, adj: DataFrame, scores: DataFrame, levels: int = MAX_LEVELS, most: int = MAX_HYPOTHESES) -> Topology:
    """The whole pipeline: potential, conductance, neighbourhoods, order, homology, fragility; nodes carry rho, scores relevance and authority."""
    phi = materialize(potentials(scores), "phi")
    c = materialize(conductance(adj, phi, live=True), "conductance")
    rho = nodes.select("id", "rho")
    found = neighborhoods(adj, phi, rho, c, levels, most)
    cover = materialize(covers(materialize(inclusions_of(found.rows.withColumnRenamed("id", "node")), "pairs")), "covers")
    got = betti(found.sets, cover).first()
    edge = materialize(boundary_nodes(adj, found.rows, nodes.count()), "boundary")
    cyclic = h1_sets(found.sets, cover)
    h1 = found.rows.join(cyclic, "hid", "left_semi").select("id").distinct() if got["beta1"] > 0 else None
    return Topology(found, cover, got["beta0"], got["beta1"], edge, materialize(fragility(rho, c, phi, edge, h1), "fragility"))


class Stability:
    """Whether the last `needed` Betti numbers in a row were the same and trivial (one part, no cycle)."""

    def __init__(self, needed: int = 2):
        self.needed, self.last, self.streak = max(1, needed), None, 0

    def update(self, beta0: int, beta1: int) -> bool:
        trivial = beta0 <= 1 and beta1 == 0
        self.streak = 0 if not trivial else self.streak + 1 if self.last == (beta0, beta1) else 1
        self.last = beta0, beta1
        return self.streak >= self.needed


def stable_streaks(snapshots: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """snapshots (group.., order.., beta0, beta1) with `streak`: equal trivial ones in a row up to this one, as Stability counts them."""
    own = Window.partitionBy(*group).orderBy(*order)
    trivial = (F.col("beta0") <= 1) & (F.col("beta1") == 0)
    fresh = ~trivial | ~(F.lag("beta0").over(own).eqNullSafe(F.col("beta0")) & F.lag("beta1").over(own).eqNullSafe(F.col("beta1")))
    runs = snapshots.withColumn("__run", F.sum(F.when(fresh, 1).otherwise(0)).over(own))
    inside = Window.partitionBy(*group, "__run").orderBy(*order)
    return runs.withColumn("streak", F.when(trivial, F.row_number().over(inside)).otherwise(0).cast("long")).drop("__run")
