"""Fetching what plans ask for: seeds, retries, a rate limit, and the merge of what comes."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import ORIGIN, WorkSearch, encode_tag_text
from ..operators.pages import merge_pages
from ..schema import AUTHOR, STATES, TAG, WORK, Graph
from ..session import materialize
from ..sources.html import parse_pages

# Ms between requests, how much more at random, and tries of a request.
INTERVAL_MS, JITTER_MS, TRIES = 2500, 500, 3
TYPES = {WORK: "work", TAG: "tagListing", AUTHOR: "authorListing"}


class HttpError(Exception):
    def __init__(self, status: int, url: str):
        super().__init__(f"HTTP {status} for {url}")
        self.status = status


@dataclass
class RateLimit:
    """Waits until INTERVAL_MS and up to JITTER_MS more have passed since the last request."""

    rng: random.Random = field(default_factory=random.Random)
    clock: Callable[[], float] = lambda: time.time() * 1000
    sleep: Callable[[float], None] = lambda ms: time.sleep(ms / 1000)
    last: float = 0.0

    def wait(self) -> None:
        least = INTERVAL_MS + int(self.rng.random() * JITTER_MS)
        left = least - (self.clock() - self.last)
        if left > 0:
            self.sleep(left)
        self.last = self.clock()


def with_retries(get: Callable[[str], tuple[int, str]], url: str, limit: RateLimit, tries: int = TRIES) -> str:
    """What `get` (status, text) gives. Any failure is tried again after a pause that grows with the tries, longer if the server is busy."""
    error: Exception = HttpError(0, url)
    for n in range(tries):
        limit.wait()
        try:
            status, text = get(url)
        except Exception as e:  # whatever a caller's client raises
            error, pause = e, n + 1
        else:
            if 200 <= status < 300:
                return text
            error = HttpError(status, url)
            pause = n + 2 if status == 429 or status >= 500 else n + 1
        limit.sleep(INTERVAL_MS * pause)
    raise error


def plan_url(plan: dict, origin: str = ORIGIN) -> str:
    """The address of a plan (type, key, page, or the params of a works search)."""
    page = f"?page={plan['page']}" if (plan.get("page") or 1) > 1 else ""
    if plan["type"] == "work":
        return f"{origin}/works/{plan['key']}"
    if plan["type"] == "tagListing":
        return f"{origin}/tags/{encode_tag_text(plan['key'])}/works{page}"
    if plan["type"] == "authorListing":
        return f"{origin}/users/{plan['key']}/works{page}"
    return plan["params"].url(origin)


@dataclass
class Outcome:
    """After a fetch: the graph, the next free id, and the state of the node that the plan marks."""

    graph: Graph
    next_id: int
    marks: int | None
    status: str
    next_page: int | None
    pages: int
    count: int | None


@dataclass
class Executor:
    """Carries plans out one by one: fetch, parse, merge."""

    spark: SparkSession
    get: Callable[[str], tuple[int, str]]
    limit: RateLimit = field(default_factory=RateLimit)
    origin: str = ORIGIN
    clock: Callable[[], int] = lambda: int(time.time() * 1000)
    canonical: DataFrame | None = None
    requests: int = 0

    def run(self, graph: Graph, plan: dict, next_id: int) -> Outcome:
        url = plan_url(plan, self.origin)
        html = with_retries(self.get, url, self.limit)
        self.requests += 1
        pages = self.spark.createDataFrame([(0, url, html)], "seq long, url string, html string")
        parsed = materialize(parse_pages(pages, "seq", self.origin), "parsed")
        got = parsed.first()
        kind = {"work": "work", "tagListing": "tag", "authorListing": "author"}.get(plan["type"], "search")
        if got["kind"] != kind:
            raise ValueError(f"{url} is no {kind} page")
        merged, above = merge_pages(graph, parsed, next_id, self.clock(), self.canonical)
        if kind == "search":
            marks = plan.get("marks") if (plan.get("marks") or -1) >= 0 else None
            status = STATES[1] if got["nextPage"] is not None else STATES[2] if marks is not None else STATES[0]
            return Outcome(merged, above, marks, status, got["nextPage"], got["page"], got["workCount"])
        hub = {"work": (WORK, got["workId"]), "tag": (TAG, got["tagName"]), "author": (AUTHOR, got["authorKey"])}[kind]
        node = merged.nodes.filter((F.col("kind") == hub[0]) & (F.col("key") == hub[1])).first()
        marks = plan["marks"] if (plan.get("marks") if plan.get("marks") is not None else -1) >= 0 else node["id"] if node else None
        if kind == "work":
            return Outcome(merged, above, marks, STATES[2], None, 0, None)
        return Outcome(merged, above, marks, node["explorationStatus"], node["listingNextPage"], node["listingPagesFetched"], got["workCount"])

    def ensure(self, graph: Graph, seeds: list[tuple[int, str]], next_id: int) -> tuple[Graph, int]:
        """The graph after all seeds that are unknown or not complete are fetched, in their order."""
        for kind, key in seeds:
            for plan in seed_plans(graph.nodes, [(kind, key)], self.canonical).collect():
                out = self.run(graph, {"type": plan["type"], "key": plan["key"], "page": plan["page"], "marks": plan["marks"]}, next_id)
                graph, next_id = out.graph, out.next_id
        return graph, next_id


def seed_plans(nodes: DataFrame, seeds: list[tuple[int, str]], canonical: DataFrame | None = None) -> DataFrame:
    """(type, key, page, marks) for each seed (kind, key) that is unknown or not complete; tags by their canonical names, marks -1 if unknown."""
    from ..operators.store import resolve_names

    s = nodes.sparkSession.createDataFrame(sorted(set(seeds)), "skind int, skey string")
    if canonical is not None:
        s = resolve_names(s, "skey", canonical).withColumn("skey", F.when(F.col("skind") == TAG, F.col("resolved")).otherwise(F.col("skey"))).drop("resolved").distinct()
    known = nodes.select("id", "kind", "key", "explorationStatus", "listingNextPage")
    found = s.join(known, (F.col("skind") == F.col("kind")) & (F.col("skey") == F.col("key")), "left")
    kind = F.col("skind")
    named = F.when(kind == WORK, TYPES[WORK]).when(kind == TAG, TYPES[TAG]).otherwise(TYPES[AUTHOR])
    open_ = found.filter(F.coalesce(F.col("explorationStatus") != STATES[2], F.lit(True)))
    return open_.select(named.alias("type"), F.col("skey").alias("key"), F.when(kind != WORK, F.coalesce("listingNextPage", F.lit(1))).alias("page"), F.coalesce("id", F.lit(-1)).alias("marks"))


@dataclass
class Seeds:
    """Positive and negative seeds: each key once on one side only, as many as a side may have."""

    most_positive: int = 20
    most_negative: int = 20
    positive: list[tuple[int, str]] = field(default_factory=list)
    negative: list[tuple[int, str]] = field(default_factory=list)

    def add(self, kind: int, key: str, positive: bool = True) -> bool:
        key = key.strip()
        side, most = (self.positive, self.most_positive) if positive else (self.negative, self.most_negative)
        if not key or (kind, key) in self.positive or (kind, key) in self.negative or len(side) >= most:
            return False
        side.append((kind, key))
        return True


def search_proxy(names: list[str], creator: str | None, open_tags: set[str], open_authors: set[str], all_tags: set[str]) -> tuple[int, str] | None:
    """The node of a partly seen world that stands for a works search: an included tag that may be expanded, else its creator, else an included tag."""
    for name in names:
        if name in open_tags:
            return TAG, name
    if creator and creator in open_authors:
        return AUTHOR, creator
    return next(((TAG, name) for name in names if name in all_tags), None)


def names_of(search: WorkSearch) -> list[str]:
    return [*search.fandom_names, *search.character_names, *search.relationship_names, *search.freeform_names]
