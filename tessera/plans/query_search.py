"""Planning the next fetch: best-first construction of queries over collected top candidates."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import is_expandable
from ..functions.urls import WorkSearch
from ..schema import AUTHOR, TAG, WORK
from ..session import discard, materialize

# Fixed values of the search.
MAX_DEPTH, MAX_NODES, BRANCH, DEPTH_COST = 3, 256, 4, 0.05
FIELD_OF_TYPE = {"Fandom": "fandom_names", "Character": "character_names", "Relationship": "relationship_names"}


@dataclass(frozen=True)
class State:
    """A query under construction: tags in and out, or a node to expand, and its page."""

    include: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    bound: int | None = None
    page: int = 1
    depth: int = 0

    def key(self) -> tuple:
        return self.include, self.exclude, self.bound, self.page


@dataclass
class Candidates:
    """What the search may use; each list is as long as all states together can need."""

    expandable: list[int]
    tags: list[int]
    hubs: list[int]
    fragility: dict[int, float]
    nodes: dict[int, dict]


@dataclass
class Result:
    plan: dict | None = None
    score: float = float("-inf")
    depth: int = 0
    expanded: int = 0
    states: list[State] = field(default_factory=list)


def collect_candidates(nodes: DataFrame, scores: DataFrame, degrees: DataFrame, boundary: DataFrame, now: int, branch: int = BRANCH, depth: int = MAX_DEPTH) -> Candidates:
    """Top candidates of each kind by bounded top-k queries; a state excludes at most `depth` of them.

    nodes are graph nodes, scores (id, fragility, relevance), degrees (id, degree), boundary (id).
    Ties go by id.
    """
    k = branch + depth
    # Only what the order needs is written; the few that are found are looked up again.
    rows = nodes.select("id", "kind", is_expandable(F.col("kind"), F.col("explorationStatus"), F.col("exploredAt"), now).alias("open")).join(scores.select("id", "fragility", "relevance"), "id", "left").join(degrees, "id", "left").fillna(0.0, ["fragility", "relevance"]).fillna(0, ["degree"])
    rows = materialize(rows.join(boundary.select("id").distinct().withColumn("edge", F.lit(True)), "id", "left"), "candidates")
    open_ = rows.filter("open").orderBy(F.desc("fragility"), "id").limit(k).collect()
    # Boundary tags come before others of the same fragility.
    tags = rows.filter((F.col("kind") == TAG) & (F.col("edge") | (F.col("fragility") > 0))).orderBy(F.desc("fragility"), F.col("edge").desc_nulls_last(), "id").limit(k).collect()
    hubs = rows.filter((F.col("kind") == TAG) & (F.col("degree") >= 2)).orderBy(F.desc(F.col("degree") / (1.0 + F.col("relevance"))), "id").limit(k).collect()
    discard(rows)
    every = {r["id"]: r.asDict() for r in [*open_, *tags, *hubs]}
    for r in nodes.filter(F.col("id").isin(list(every))).select("id", "key", "explorationStatus", "exploredAt", "listingNextPage").collect():
        every[r["id"]] |= r.asDict()
    return Candidates([r["id"] for r in open_], [r["id"] for r in tags], [r["id"] for r in hubs], {i: r["fragility"] for i, r in every.items()}, every)


def leaf_score(s: State, fragility: dict[int, float]) -> float:
    """The bound node's fragility, else the mean over the included tags."""
    if s.bound is not None:
        return fragility.get(s.bound, 0.0)
    return sum(fragility.get(i, 0.0) for i in s.include) / len(s.include) if s.include else 0.0


def expand(s: State, c: Candidates, branch: int = BRANCH) -> list[State]:
    """Children: bind a node, include a tag, exclude a hub, turn the bound hub's page."""
    out: list[State] = []
    used = {*s.include, *s.exclude}
    if s.bound is None:
        out += [State(s.include, s.exclude, i, s.page, s.depth + 1) for i in c.expandable[:branch]]
    for i in [i for i in c.tags if i not in used][:branch]:
        out.append(State(tuple(sorted((*s.include, i))), s.exclude, None, 1, s.depth + 1))
    if s.include:
        for i in [i for i in c.hubs if i not in used][:branch]:
            out.append(State(s.include, tuple(sorted((*s.exclude, i))), None, 1, s.depth + 1))
    if s.bound is not None and (n := c.nodes.get(s.bound)) and n["kind"] in (TAG, AUTHOR):
        done = n["explorationStatus"] == "complete"
        page = 1 if done else n["listingNextPage"] or 1
        if page != s.page or done:
            out.append(State(s.include, s.exclude, s.bound, s.page + 1 if page == s.page else page, s.depth + 1))
    return out


def plan_of(s: State, nodes: dict[int, dict], types: dict[str, str] | None = None) -> dict | None:
    """The fetch a finished state stands for."""
    if s.bound is not None:
        n = nodes[s.bound]
        if n["kind"] == WORK:
            return {"type": "work", "key": n["key"], "marks": n["id"]}
        return {"type": "tagListing" if n["kind"] == TAG else "authorListing", "key": n["key"], "page": s.page, "marks": n["id"]}
    if not s.include:
        return None
    search = WorkSearch(page=s.page, excluded_tag_names=[nodes[i]["key"] for i in s.exclude])
    for i in s.include:
        getattr(search, FIELD_OF_TYPE.get((types or {}).get(nodes[i]["key"], ""), "freeform_names")).append(nodes[i]["key"])
    return {"type": "worksSearch", "params": search}


def search(c: Candidates, types: dict[str, str] | None = None, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH, branch: int = BRANCH, depth_cost: float = DEPTH_COST) -> Result:
    """Deepening best-first search; the incumbent is the best node to expand until a strictly better leaf is found."""
    best = State(bound=c.expandable[0]) if c.expandable else None
    out = Result(score=leaf_score(best, c.fragility) if best else float("-inf"))
    for bound in range(1, max_depth + 1):
        order = count()
        open_ = [(0.0, next(order), State())]
        closed: set[tuple] = set()
        improved, layer = False, 0
        while open_ and out.expanded < max_nodes:
            s = heapq.heappop(open_)[2]
            if s.key() in closed:
                continue
            closed.add(s.key())
            out.expanded += 1
            layer += 1
            if s.bound is not None or s.include:
                score = leaf_score(s, c.fragility)
                if score > out.score:
                    best, out.score, improved = s, score, True
            if s.depth >= bound:
                continue
            for child in expand(s, c, branch):
                if child.key() not in closed:
                    heapq.heappush(open_, (-(leaf_score(child, c.fragility) - depth_cost * child.depth), next(order), child))
        out.depth = bound
        if not layer or not improved and out.expanded >= max_nodes:
            break
    if best is not None:
        out.plan = plan_of(best, c.nodes, types)
        out.states = [best]
    return out
