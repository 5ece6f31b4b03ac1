"""Queries of keyed reads and updates, sources and scalars, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import NOW, POSITIVE, Query, listing_events, r8
from .functions import settings as ST
from .functions import text as TX
from .functions import urls as U
from .operators import adjacency as A
from .operators import lookup as L
from .operators import store as S
from .oracles import _BASE, _STATS, _with
from .schema import AUTHOR, TAG, WORK, Graph
from .session import dealt, materialize, scratch, spread
from .sources import graph_json as J
from .sources import stats_csv as C
from .sources.html import listed_works, parse_pages
from .sources.tables import load_graph, read, stats_tags

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


_URGENT = "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'"


@query(f"{_with()} SELECT id, kind, key, st AS explorationStatus FROM nodes WHERE (kind = 0 AND k IN ({_URGENT})) OR (kind = 1 AND k IN (SELECT o_orderkey FROM orders))")
def node_lookup(spark, sf):
    """Urgent orders as works, and as tags the parts that have an order's number; most keys of tags exist, some do not."""
    orders = read(spark, sf, "orders")
    works = orders.filter("o_orderpriority = '1-URGENT'").select(F.lit(WORK).alias("kind"), s("o_orderkey").alias("key"))
    keys = works.unionByName(orders.select(F.lit(TAG).alias("kind"), s("o_orderkey").alias("key")))
    return L.nodes_by_key(load_graph(spark, sf).nodes, keys).select("id", "kind", "key", "explorationStatus")


@query(f"{_with()} SELECT id, kind, key FROM nodes WHERE id IN (SELECT event_id * 3 FROM events)")
def node_by_id(spark, sf):
    ids = read(spark, sf, "events").select((F.col("event_id") * 3).alias("id"))
    return L.nodes_by_id(load_graph(spark, sf).nodes, ids).select("id", "kind", "key")


@query(f"{_with()} SELECT wid AS workNodeId, hid AS tagNodeId FROM e WHERE hid IN (SELECT id FROM t WHERE p_size = 7)")
def edges_by_tag(spark, sf):
    g = load_graph(spark, sf)
    keys = read(spark, sf, "part").filter("p_size = 7").select(F.lit(TAG).alias("kind"), s("p_partkey").alias("key"))
    return L.links_of(g.edges, L.nodes_by_key(g.nodes, keys))


@query(f"{_with()} SELECT kind, key, id FROM nodes")
def key_maps(spark, sf):
    n = load_graph(spark, sf).nodes
    maps = [L.key_ids(n, k).select(F.lit(k).alias("kind"), "key", "id") for k in (WORK, TAG, AUTHOR)]
    return maps[0].unionByName(maps[1]).unionByName(maps[2])


@query(f"WITH RECURSIVE {_STATS} SELECT tag_id, name, cached AS cached_count, merger AS merger_id, 'id' AS how FROM s WHERE tag_id IN (SELECT o_custkey FROM orders) UNION ALL SELECT max(tag_id), p_name, arg_max(cached, tag_id), arg_max(merger, tag_id), 'name' FROM s JOIN part ON p_partkey = tag_id WHERE p_name LIKE 's%' GROUP BY p_name")
def stats_lookup(spark, sf):
    """By the ids that orders' customers have, and by bare names, of which the last row stays."""
    stats = stats_tags(spark, sf)
    by_id = L.stats_by_id(stats, read(spark, sf, "orders").select(F.col("o_custkey").alias("tag_id")))
    bare = stats.withColumn("name", F.substring_index("name", "#", 1))
    by_name = L.stats_by_name(bare, read(spark, sf, "part").filter("p_name like 's%'").select(F.col("p_name").alias("name")))
    out = [d.select("tag_id", "name", "cached_count", "merger_id", F.lit(how).alias("how")) for d, how in ((by_id, "id"), (by_name, "name"))]
    return out[0].unionByName(out[1])


@query("SELECT (SELECT count(*) FROM part) AS stored, (SELECT count(DISTINCT p_name) FROM part) AS indexed, (SELECT count(DISTINCT p_name) FROM part WHERE p_size = 3) AS restricted")
def stats_store(spark, sf):
    """Rows put twice over, the second time changed; the name index of all, and of the graph's names only."""
    stats = stats_tags(spark, sf).withColumn("name", F.substring_index("name", "#", 1))
    put, names = L.stored_stats(stats, stats.filter("cached_count % 2 = 0").withColumn("cached_count", F.col("cached_count") + 1))
    graph = stats.filter("cached_count = 3").select(F.col("name").alias("key"))
    _, few = L.stored_stats(stats.limit(0), stats, graph)
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((put, "stored"), (names, "indexed"), (few, "restricted"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three single rows


@query("SELECT event_type AS key, arg_max(CAST(user_id AS VARCHAR), event_id) AS value FROM events GROUP BY event_type UNION ALL SELECT 'nextNodeId', '7'")
def meta_values(spark, sf):
    have = spark.createDataFrame([("nextNodeId", "7"), ("click", "old")], "key string, value string")
    return L.put_meta(have, read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("key"), s("user_id").alias("value")))


@query("SELECT s_suppkey, 5000 + row_number() OVER (ORDER BY s_suppkey) - 1 AS id, 5000 + (SELECT count(*) FROM supplier) AS next_id FROM supplier")
def allocated_ids(spark, sf):
    rows, above = L.allocated(read(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 5000)
    return rows.withColumn("next_id", F.lit(above).cast("long"))


@query(f"""{_with()}, u AS (SELECT max(event_id) AS e, user_id AS id, arg_max(CAST(floor(value) AS BIGINT), event_id) AS v FROM events GROUP BY user_id)
SELECT n.id, CASE WHEN u.id IS NULL THEN st WHEN e % 2 = 0 THEN 'complete' ELSE 'partial' END AS explorationStatus, CASE WHEN u.id IS NULL THEN xat ELSE {NOW} + e END AS exploredAt, CASE WHEN u.id IS NULL THEN nxt WHEN e % 2 = 1 THEN CAST(e % 5 AS INT) END AS listingNextPage,
CASE WHEN u.id IS NOT NULL AND v > 50 THEN v::DOUBLE ELSE cal END AS calibratedFreq, CASE WHEN u.id IS NULL THEN st = 'complete' ELSE e % 2 = 0 END AS explored FROM nodes n LEFT JOIN u ON u.id = n.id""")
def exploration_updates(spark, sf):
    ev = read(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("e"), F.max_by(F.floor("value"), "event_id").alias("v"))
    even = F.col("e") % 2 == 0
    updates = ev.select("id", F.when(even, "complete").otherwise("partial").alias("explorationStatus"), (F.lit(NOW) + F.col("e")).alias("exploredAt"), F.when(~even, (F.col("e") % 5).cast("int")).alias("listingNextPage"), F.lit(1).alias("listingPagesFetched"), F.when(F.col("v") > 50, F.col("v").cast("double")).alias("calibratedFreq"))
    return L.explored_by(load_graph(spark, sf).nodes, updates).select("id", "explorationStatus", "exploredAt", "listingNextPage", "calibratedFreq", "explored")


@query(f"{_with()} SELECT id, CASE WHEN hit THEN 'complete' ELSE st END AS explorationStatus, CASE WHEN hit THEN {NOW} ELSE xat END AS exploredAt, CASE WHEN hit THEN NULL ELSE nxt END AS listingNextPage, cal AS calibratedFreq FROM (SELECT *, id IN (SELECT user_id FROM events) AS hit FROM nodes)")
def explored_marks(spark, sf):
    ids = read(spark, sf, "events").select(F.col("user_id").alias("id"))
    return L.marked_explored(load_graph(spark, sf).nodes, ids, NOW).select("id", "explorationStatus", "exploredAt", "listingNextPage", "calibratedFreq")


@query(f"""{_with()}, n AS (SELECT id, CASE WHEN p_size = 1 THEN 'renamed ' || key WHEN p_size = 2 THEN 'one name' ELSE key END AS key, CASE WHEN p_size = 2 THEN 77.0 END AS cnt, cal FROM t)
SELECT min(id) AS id, key, greatest(max(cal), max(cnt)) AS calibratedFreq FROM n GROUP BY key""")
def renamed_tags(spark, sf):
    """Tags of size 1 get a name of their own; those of size 2 one together, with a count of 77."""
    g, p = load_graph(spark, sf), read(spark, sf, "part").filter("p_size <= 2")
    names = p.select(s("p_partkey").alias("name"), F.when(F.col("p_size") == 1, F.concat(F.lit("renamed "), s("p_partkey"))).otherwise("one name").alias("canonical"), F.when(F.col("p_size") == 2, 77).cast("long").alias("cached_count"))
    return L.renamed_tags(g, names).nodes.filter(F.col("kind") == TAG).select("id", "key", "calibratedFreq")


@query(f"""{_with(_STATS, recursive=True)}, want AS (SELECT DISTINCT root FROM roots WHERE tag_id % 3 = 0), ends AS (SELECT s.name, CAST(s.cached AS DOUBLE) AS c, s.tag_id FROM want JOIN s ON s.tag_id = root),
have AS (SELECT t.id, t.k, s.name AS key, t.cal FROM t JOIN s ON s.tag_id = t.k WHERE t.p_size % 2 = 0)
SELECT h.id, h.key, CASE WHEN e.name IS NULL THEN h.cal ELSE greatest(h.cal, e.c) END AS calibratedFreq FROM have h LEFT JOIN ends e ON e.name = h.key
UNION ALL SELECT 900000 + row_number() OVER (ORDER BY tag_id) - 1, name, c FROM ends WHERE name NOT IN (SELECT key FROM have)""")
def stats_tag_nodes(spark, sf):
    """A tag for the canonical name of every third row of the statistics, in a graph that has the tags of even size."""
    stats = stats_tags(spark, sf)
    names = stats.select(s("tag_id").alias("__k"), F.col("name").alias("__n"), "cached_count")
    tags = load_graph(spark, sf).nodes.filter(F.col("kind") == TAG).join(spread(names.filter("cached_count % 2 = 0")), F.col("key") == F.col("__k")).withColumn("key", F.col("__n")).drop("__k", "__n", "cached_count")
    return L.with_stats_tags(tags, stats, stats.filter("tag_id % 3 = 0"), 900_000).select("id", "key", "calibratedFreq")


@query("SELECT 0::BIGINT AS nodes, 0::BIGINT AS edges, 0::BIGINT AS author_edges")
def cleared_graph(spark, sf):
    g = L.emptied(load_graph(spark, sf))
    return spark.createDataFrame([(g.nodes.count(), g.edges.count(), g.author_edges.count())], "nodes long, edges long, author_edges long")


@query(f"{_with()} SELECT key, row_number() OVER (ORDER BY wc DESC, id) AS shown FROM w WHERE k % 3 <> 0 ORDER BY wc DESC, id LIMIT 25")
def displayed_results(spark, sf):
    """All works by length; of those not suppressed the first 25 are shown."""
    from .operators.ranking import rank_works

    works = load_graph(spark, sf).nodes.filter(F.col("kind") == WORK)
    ranked = rank_works(works.select("id", "key", "wordCount"), "wordCount", works.count())
    hidden = works.filter(F.col("key").cast("long") % 3 == 0).select("key")
    shown = L.displayed(ranked, hidden, 25)
    return shown.select("key", F.row_number().over(Window.orderBy("rank")).cast("long").alias("shown"))  # 25 rows


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'A title of ' || o_orderkey WHEN o_orderkey % 6 < 3 THEN 'Seeded ' || o_orderkey ELSE 'Work ' || o_orderkey END AS title FROM orders""")
def result_titles(spark, sf):
    """A quarter of the works has a title, the rest a bare one, an empty one or none; half of the seeds tell one."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("A title of "), s(k))).when(k % 4 == 1, F.concat(F.lit("Work "), s(k))).when(k % 4 == 2, F.lit(None))
    works = o.select(s(k).alias("key"), title.otherwise(F.concat(F.lit("Work "), s(k))).alias("title"))
    seeds = o.select(s(k).alias("key"), F.when(k % 6 < 3, F.concat(F.lit("Seeded "), s(k))).otherwise(F.concat(F.lit("Work "), s(k))).alias("title"))
    return L.result_titles(works, seeds)


_RAW_SQL = "raw AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE st END AS st0, CASE WHEN k % 4 = 0 THEN NULL ELSE xat END AS xat0, CASE WHEN k % 3 = 0 THEN NULL ELSE nxt END AS nxt0, CASE WHEN k % 2 = 0 THEN NULL ELSE 3 END AS pages0 FROM nodes), raw2 AS (SELECT *, coalesce(st0, CASE WHEN st = 'complete' THEN 'complete' ELSE 'unexplored' END) AS st1 FROM raw)"


def _raw_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes as older versions stored them: fields missing by their keys."""
    n = load_graph(spark, sf, meta=True).nodes
    k = F.col("key").cast("long")
    gone = {"explorationStatus": 5, "exploredAt": 4, "listingNextPage": 3}
    n = n.withColumns({c: F.when(k % m != 0, F.col(c)) for c, m in gone.items()})
    return n.withColumn("listingPagesFetched", F.when(k % 2 != 0, 3))


@query(f"{_with(_RAW_SQL)} SELECT id, st1 AS explorationStatus, xat0 AS exploredAt, nxt0 AS listingNextPage, coalesce(pages0, 0) AS listingPagesFetched, st1 = 'complete' AS explored, kind = 0 AS has_meta FROM raw2")
def stored_fields(spark, sf):
    n = _raw_nodes(spark, sf).withColumn("meta", F.coalesce("meta", F.struct(*[F.lit(None).cast("string").alias(c) for c in ("language", "rating", "completionStatus")], *[F.array().cast("array<string>").alias(c) for c in ("archiveWarnings", "fandoms", "categories")])))
    return L.stored_fields(n).select("id", "explorationStatus", "exploredAt", "listingNextPage", "listingPagesFetched", "explored", F.col("meta").isNotNull().alias("has_meta"))


@query(f"{_with(_RAW_SQL)} SELECT id, st1 AS explorationStatus, coalesce(xat0, CASE WHEN st1 = 'complete' THEN 1 END) AS exploredAt, CASE WHEN nxt0 IS NOT NULL THEN nxt0 WHEN st1 = 'partial' THEN 1 END AS listingNextPage, coalesce(pages0, CASE WHEN st1 = 'unexplored' THEN 0 ELSE 1 END) AS listingPagesFetched FROM raw2")
def graph_fields(spark, sf):
    return L.graph_fields(_raw_nodes(spark, sf)).select("id", "explorationStatus", "exploredAt", "listingNextPage", "listingPagesFetched")


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 25 ELSE least(200, greatest(1, CAST(floor(l_extendedprice / 100 + 0.5) AS BIGINT))) END AS top, CASE WHEN l_suppkey % 5 = 0 THEN 3.0 ELSE least(50.0, greatest(0.0, l_quantity * 1.5 - 5)) END AS lam,
CASE WHEN l_linestatus = 'F' THEN 'dark' ELSE 'system' END AS theme, CASE WHEN l_returnflag = 'R' THEN 'topo-query' ELSE 'topological' END AS policy, CASE WHEN l_returnflag = 'A' THEN 'whitelist' ELSE 'blacklist' END AS mode, least(1.0, l_quantity / 40.0) AS permeability,
CASE WHEN l_returnflag = 'N' THEN '' ELSE 'Mature' END AS ratings, 'Complete' AS done, CASE l_returnflag WHEN 'N' THEN 'N' ELSE l_returnflag || '|N' END AS fandoms FROM lineitem""")
def settings_normalized(spark, sf):
    """Settings built from line items, some out of bounds, wrong or missing."""
    li = read(spark, sf, "lineitem")
    number = F.when(F.col("l_partkey") % 7 == 0, F.lit("many")).otherwise(s(F.col("l_extendedprice") / 100))
    lam = F.when(F.col("l_suppkey") % 5 != 0, s(F.col("l_quantity") * 1.5 - 5))
    one = F.struct(F.when(F.col("l_returnflag") == "A", "whitelist").otherwise("sieve").alias("mode"), s(F.col("l_quantity") / 40.0).alias("permeability"), F.array(F.lit(" Mature "), F.lit("Mature"), F.lit("Unheard Of")).alias("values"))
    none = F.struct(F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("permeability"), F.when(F.col("l_returnflag") != "N", F.array(F.lit(" Mature "), F.lit("Mature"), F.lit("Unheard Of"))).alias("values"))
    done = F.struct(F.lit("x").alias("mode"), F.lit("2").alias("permeability"), F.array(F.lit("Complete"), F.lit("Incomplete")).alias("values"))
    fandoms = F.struct(F.lit("x").alias("mode"), F.lit("-1").alias("permeability"), F.array(F.col("l_returnflag"), F.lit(" N "), F.lit(""), F.lit("N")).alias("values"))
    raw = F.to_json(F.struct(number.alias("topResults"), lam.alias("negativeRelevanceLambda"), F.when(F.col("l_linestatus") == "F", "dark").otherwise("pink").alias("theme"), F.when(F.col("l_returnflag") == "R", "topo-query").otherwise("best").alias("expansionPolicy"), F.struct(one.alias("language"), none.alias("rating"), done.alias("completionStatus"), fandoms.alias("fandoms")).alias("permeability")))
    n = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", ST.parsed(raw).alias("s")).withColumn("n", ST.bounded(F.col("s")))
    return n.select("l_orderkey", "l_linenumber", "l_partkey", F.col("n.topResults").alias("top"), F.col("n.negativeRelevanceLambda").alias("lam"), "n.theme", F.col("n.expansionPolicy").alias("policy"), F.col("n.permeability.language.mode").alias("mode"), F.col("n.permeability.language.permeability").alias("permeability"),
        F.array_join("n.permeability.rating.values", "|").alias("ratings"), F.array_join("n.permeability.completionStatus.values", "|").alias("done"), F.array_join("n.permeability.fandoms.values", "|").alias("fandoms"))


# Addresses of every kind, built from orders.
_ADDRESS_SQL = """CASE o_orderkey % 7 WHEN 0 THEN 'https://example.org/works/' || o_orderkey || '/chapters/9' WHEN 1 THEN 'https://example.org/tags/N' || o_custkey || '%20*s*%20x*d*/works?page=' || (o_orderkey % 4) WHEN 2 THEN 'https://example.org/users/u' || o_custkey || '/works?page=3' WHEN 3 THEN 'https://example.org/works/search?page=2&work_search[query]=' || o_custkey
 WHEN 4 THEN 'https://example.org/users/login?x=' || o_custkey WHEN 5 THEN 'https://example.org/users/u' || o_custkey || '/pseuds/p' || o_orderkey ELSE 'https://example.org/about/' || o_custkey END"""


def _address() -> Column:
    k, c = F.col("o_orderkey"), s("o_custkey")
    base = "https://example.org"
    cases = [
        F.concat(U.work_url(s(k)), F.lit("/chapters/9")), F.concat(F.lit(f"{base}/tags/N"), c, F.lit("%20*s*%20x*d*/works?page="), s(k % 4)), U.author_works_url(F.concat(F.lit("u"), c), F.lit(3)),
        F.concat(F.lit(f"{base}/works/search?page=2&work_search[query]="), c), F.concat(F.lit(f"{base}/users/login?x="), c), F.concat(F.lit(f"{base}/users/u"), c, F.lit("/pseuds/p"), s(k)),
    ]
    out = F.concat(F.lit(f"{base}/about/"), c)
    for i, case in reversed(list(enumerate(cases))):
        out = F.when(k % 7 == i, case).otherwise(out)
    return out


@query(f"""SELECT o_orderkey, {_ADDRESS_SQL} AS url, ['work', 'tag', 'author', 'search', 'unknown', 'author', 'unknown'][o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS work_id, CASE WHEN o_orderkey % 7 = 1 THEN 'N' || o_custkey || ' / x.' END AS tag,
 CASE o_orderkey % 7 WHEN 2 THEN 'u' || o_custkey WHEN 5 THEN 'u' || o_custkey || '/pseuds/p' || o_orderkey END AS author, CAST(CASE o_orderkey % 7 WHEN 1 THEN greatest(o_orderkey % 4, 1) WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS page FROM orders""")
def site_addresses(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", _address().alias("url"))
    u = F.col("url")
    return o.select("o_orderkey", "url", U.page_kind(u).alias("kind"), U.work_id(u).alias("work_id"), U.tag_name(u).alias("tag"), U.author_key(u).alias("author"), U.page_number(u).cast("long").alias("page"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'u' || o_custkey || CASE WHEN o_orderkey % 5 = 1 THEN '/pseuds/p' ELSE '' END END AS author FROM orders""")
def author_links(spark, sf):
    """Links to authors' own pages count, those to their gifts or bookmarks and to the site's own pages do not."""
    k, c = F.col("o_orderkey"), s("o_custkey")
    user = F.concat(F.lit("/users/u"), c)
    href = F.when(k % 5 == 0, F.concat(user, F.lit("/works"))).when(k % 5 == 1, F.concat(user, F.lit("/pseuds/p"))).when(k % 5 == 2, F.concat(user, F.lit("/?x=1"))).when(k % 5 == 3, F.concat(user, F.lit("/gifts"))).otherwise("/users/password/new")
    return read(spark, sf, "orders").select("o_orderkey", U.author_key(href, href=True).alias("author"))


@query("""SELECT p_partkey, 'https://example.org/works/search?' || CASE WHEN p_size > 1 THEN 'page=' || p_size || '&' ELSE '' END || 'work_search%5Bquery%5D=' || replace(p_name, ' ', '+') || '&work_search%5Bcomplete%5D=' || CASE WHEN p_size % 2 = 0 THEN 'T' ELSE 'F' END || CASE WHEN p_size % 3 = 0 THEN '&work_search%5Bsingle_chapter%5D=1' ELSE '' END
 || '&work_search%5Bword_count%5D=' || CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '-' || p_size * 2 WHEN 2 THEN '%3E' || p_size ELSE '%3C' || p_size END || '&work_search%5Bfandom_names%5D=' || replace(p_brand, '#', '%23') || '%2C' || replace(p_type, ' ', '+')
 || '&work_search%5Barchive_warning_ids%5D%5B%5D=14&work_search%5Barchive_warning_ids%5D%5B%5D=' || p_size AS url FROM part""")
def works_search_urls(spark, sf):
    """Search addresses from parts: ranges of all forms, lists joined and repeated."""
    def address(name: str, brand: str, kind: str, n: int) -> str:
        count = (U.Count(exact=n), U.Count(min=n, max=2 * n), U.Count(min=n), U.Count(max=n))[n % 4]
        return U.WorkSearch(page=n, query=name, complete=n % 2 == 0, single_chapter=n % 3 == 0, word_count=count, fandom_names=[brand, kind], archive_warning_ids=[14, n]).url()

    @F.pandas_udf("string")
    def built(name: pd.Series, brand: pd.Series, kind: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([address(*row) for row in zip(name, brand, kind, size.astype(int))])

    return read(spark, sf, "part").select("p_partkey", built("p_name", "p_brand", "p_type", "p_size").alias("url"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Redacted' ELSE c_name END AS display, c_custkey % 11 = 0 AS redacted, CASE c_custkey % 4 WHEN 0 THEN 'Complete' WHEN 1 THEN 'Incomplete' WHEN 2 THEN 'Incomplete' END AS status, c_mktsegment || '|N' || (c_custkey % 2) AS parts,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey * 1000 END AS words, c_custkey * 1000 + 7 AS page_words, CASE WHEN c_custkey % 2 = 0 THEN 'tags-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.csv' END AS dump FROM customer""")
def text_scalars(spark, sf):
    """Names from headings, labels, comma lists, figures and dump names, built from customers."""
    k = F.col("c_custkey")
    head = F.when(k % 11 == 0, " Redacted ").when(k % 3 == 0, F.concat("c_name", F.lit(" - Works (12) | Site"))).when(k % 3 == 1, F.concat(F.lit("Works by  "), "c_name")).otherwise(F.concat("c_name", F.lit(" ")))
    label = F.element_at(F.array(F.lit(" Completed"), F.lit("WIP"), F.lit("work in progress "), F.lit("soon")), (k % 4 + 1).cast("int"))
    commas = F.concat(F.lit(" "), "c_mktsegment", F.lit(", ,N"), s(k % 2), F.lit(","), "c_mktsegment")
    figure = F.when(k % 5 == 0, F.lit("about 7")).otherwise(F.concat(F.lit(" "), F.format_number(k * 1000, 0), F.lit(" words")))
    name = F.when(k % 2 == 0, F.concat(F.lit("TAGS-"), F.lpad(s(k), 8, "0"), F.lit(".CSV"))).otherwise(F.concat(F.lit("tags-"), s(k), F.lit(".csv")))
    return read(spark, sf, "customer").select("c_custkey", TX.display_name(head).alias("display"), TX.is_redacted(head).alias("redacted"), TX.completion_of_label(label).alias("status"), F.array_join(TX.split_commas(commas), "|").alias("parts"),
        TX.blurb_words(figure).alias("words"), TX.page_words(F.concat(F.lit("in all "), F.format_number(k * 1000 + 7, 0), F.lit("  Words, more"))).alias("page_words"), F.when(C.is_dump_name(F.concat(F.lit("file:///x/"), name)), F.lower(name)).alias("dump"))


@query("""SELECT p_partkey AS tag_id, p_type AS type, 'a "' || p_name || '", b' AS name, p_size % 2 = 0 AS canonical, CAST(p_size AS BIGINT) AS cached_count, CASE WHEN p_size % 3 = 0 THEN p_partkey + 1 END AS merger_id FROM part WHERE p_size % 10 <> 9 AND p_size % 10 <> 8 AND p_type <> 'PROMO'""")
def stats_dump(spark, sf):
    """part as a CSV dump in files, quoted; redacted names, negative counts and system types fall out."""
    p = read(spark, sf, "part")
    name = F.when(F.col("p_size") % 10 == 9, "Redacted").otherwise(F.concat(F.lit('"a ""'), "p_name", F.lit('"", b"')))
    kind = F.when(F.col("p_type") == "PROMO", "ArchiveWarning").otherwise(F.col("p_type"))
    count = F.when(F.col("p_size") % 10 == 8, F.lit("-1")).otherwise(s("p_size"))
    line = F.concat_ws(",", s("p_partkey"), kind, name, F.when(F.col("p_size") % 2 == 0, " TRUE ").otherwise("false"), count, F.when(F.col("p_size") % 3 == 0, s(F.col("p_partkey") + 1)).otherwise(""))
    path = f"{scratch(spark)}/dump-{uuid.uuid4().hex}"
    header = spark.createDataFrame([("id,type,name,canonical,cached_count,merger_id",), ("",), ("no number,x,y,true,1,",)], "value string")
    p.select(line.alias("value")).unionByName(header).write.option("lineSep", "\r\n").text(path)
    return C.content_tags(C.read_dump(spark, path))


@query(f"""{_with(_STATS, recursive=True)} SELECT (SELECT count(*) FROM s) AS stored, (SELECT count(*) FROM t) AS calibrated, (SELECT count(*) FROM roots WHERE root <> tag_id) AS merged, (SELECT count(DISTINCT root) FROM roots) AS left_tags""")
def stats_import(spark, sf):
    """The dump's rows stored, its counts taken by graph tags, its mergers applied to the graph."""
    g = load_graph(spark, sf)
    stats = stats_tags(spark, sf)
    names = stats.select(s("tag_id").alias("__k"), F.col("name").alias("__n"))
    named = g.nodes.join(spread(names), (F.col("kind") == TAG) & (F.col("key") == F.col("__k")), "left").withColumn("key", F.coalesce("__n", "key")).drop("__k", "__n")
    got = C.import_stats(Graph(named, g.edges, g.author_edges), stats)
    tags = got.graph.nodes.filter(F.col("kind") == TAG).count()
    return spark.createDataFrame([(got.stored, got.calibrated, got.merged, tags)], "stored long, calibrated long, merged long, left_tags long")


@query("SELECT doc_id, CAST(i AS BIGINT) AS line, coalesce(lines[i + 1], '') AS value FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)) WHERE i + 1 < len(lines) OR lines[i + 1] <> ''")
def chunked_lines(spark, sf):
    """Every document cut into chunks of 100 characters, and its lines put together from them."""
    d = read(spark, sf, "documents").filter("text is not null")
    chunks = d.select("doc_id", F.posexplode(F.expr("transform(sequence(0, cast(greatest(length(text) - 1, 0) / 100 as int)), i -> substring(text, i * 100 + 1, 100))")).alias("seq", "chunk"))
    return C.lines_of_chunks(chunks, "doc_id").select("doc_id", F.col("line").cast("long").alias("line"), "value")


_JSON_COLUMNS = ("id", "kind", "key", "title", "wordCount", "estimatedFreq", "calibratedFreq", "explorationStatus", "exploredAt", "listingNextPage")


def _next(g: Graph) -> int:
    return g.nodes.agg(F.max("id")).first()[0] + 1


@query(f"{_with()} SELECT id, kind, key, est AS estimatedFreq, cal AS calibratedFreq, st AS explorationStatus, xat AS exploredAt, nxt AS listingNextPage, coalesce(c.n, 0) AS links FROM nodes LEFT JOIN (SELECT wid, count(*) AS n FROM links GROUP BY wid) c ON c.wid = id")
def graph_export(spark, sf):
    """The graph as one JSON document in files of lines, written, read, checked and imported over an empty one."""
    g = load_graph(spark, sf)
    path = f"{scratch(spark)}/export-{uuid.uuid4().hex}"
    J.write_document(g, _next(g), "2025-01-01T00:00:00Z", path)
    out = J.import_document(spark, L.emptied(g), 0, path, "overwrite").graph
    links = out.edges.select("workNodeId").unionByName(out.author_edges.select("workNodeId")).groupBy("workNodeId").agg(F.count("*").alias("links"))
    n = out.nodes.join(links, F.col("id") == F.col("workNodeId"), "left")
    return n.select("id", "kind", "key", "estimatedFreq", "calibratedFreq", "explorationStatus", "exploredAt", "listingNextPage", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query(f"{_with()} SELECT id, kind, key, est AS estimatedFreq, cal AS calibratedFreq, st AS explorationStatus, xat AS exploredAt, nxt AS listingNextPage FROM nodes")
def graph_lines(spark, sf):
    """The graph as JSON lines in many files, written and read back without a row that holds it all."""
    g = load_graph(spark, sf)
    path = f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
    J.write_lines(g, path)
    return J.read_lines(spark, path).nodes.select("id", "kind", "key", "estimatedFreq", "calibratedFreq", "explorationStatus", "exploredAt", "listingNextPage")


@query(f"""{_with()}, moved AS (SELECT id, kind, CASE WHEN k % 4 = 0 THEN 'new ' || key ELSE key END AS key, k FROM nodes), n AS (SELECT id, kind, 100000000 + row_number() OVER (ORDER BY id) - 1 AS new_id FROM moved WHERE k % 4 = 0), m AS (SELECT x.id AS old, coalesce(n.new_id, x.id) AS new FROM moved x LEFT JOIN n ON n.id = x.id)
SELECT workNodeId, hubNodeId FROM (SELECT wid AS workNodeId, hid AS hubNodeId FROM links UNION SELECT a.new, b.new FROM links JOIN m a ON a.old = wid JOIN m b ON b.old = hid)""")
def import_links(spark, sf):
    """A copy whose keys are new for every fourth node, merged into the whole graph: links follow their nodes."""
    g = load_graph(spark, sf)
    k = F.col("key").cast("long")
    copy = g.nodes.withColumn("key", F.when(k % 4 == 0, F.concat(F.lit("new "), "key")).otherwise(F.col("key")))
    out = S.import_merge(g, Graph(copy, g.edges, g.author_edges), 100_000_000).graph
    return out.edges.select("workNodeId", F.col("tagNodeId").alias("hubNodeId")).unionByName(out.author_edges.select("workNodeId", F.col("authorNodeId").alias("hubNodeId")))


# Pages of the site, written from the tables' rows.
def _tag_link(name: Column | str) -> Column:
    return F.concat(F.lit('<a class="tag" href="/tags/x/works">'), name, F.lit("</a>"))


def _work_page() -> Column:
    k = F.col("o_orderkey")
    dd = lambda c, x: F.concat(F.lit(f'<dd class="{c}">'), x, F.lit("</dd>"))
    return F.concat(
        F.lit('<html><body><h2 class="title heading"> Order \n  '), s(k), F.lit(' </h2><dl class="work meta group">'),
        dd("rating tags", _tag_link("o_orderpriority")), dd("warning tags", F.concat(_tag_link(F.lit("W1")), _tag_link(F.lit(" W1 ")))), dd("fandom tags", _tag_link(F.concat(F.lit("Fandom "), s(k % 10)))), dd("freeform tags", F.concat(_tag_link("c_mktsegment"), _tag_link(F.lit("shared")))),
        dd("language", F.concat(F.lit(" "), "c_mktsegment")), dd("stats", F.concat(F.lit("<dl>"), dd("words", F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" Words"))), dd("chapters", F.concat(s(k % 5 + 1), F.lit("/"), F.when(k % 3 == 0, "?").otherwise(F.lit("3")))), F.lit("</dl>"))),
        dd("users", F.concat(F.lit('<a href="/users/u'), s("o_custkey"), F.lit('">'), "c_name", F.lit('</a><a href="/users/u'), s("o_custkey"), F.lit('/gifts">x</a>'))), F.lit("</dl></body></html>"),
    )


@query("""SELECT o_orderkey, 'work' AS kind, CAST(o_orderkey AS VARCHAR) AS workId, 'Order ' || o_orderkey AS title, CAST(floor(o_totalprice) AS BIGINT) AS wordCount, 'Fandom ' || (o_orderkey % 10) || '|' || c_mktsegment || '|shared' AS tags, 'u' || o_custkey AS author, c_name AS name, o_orderpriority AS rating, 'W1' AS warnings, c_mktsegment AS language,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Incomplete' WHEN o_orderkey % 5 + 1 >= 3 THEN 'Complete' ELSE 'Incomplete' END AS done, 'https://example.org/works/' || o_orderkey AS url FROM orders JOIN customer ON c_custkey = o_custkey""")
def html_works(spark, sf):
    o = dealt(read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")), "o_orderkey")
    pages = o.select("o_orderkey", F.concat(F.lit("http://other.example/works/"), s("o_orderkey"), F.lit("?view=full")).alias("url"), _work_page().alias("html"))
    w = parse_pages(pages, "o_orderkey")
    return w.select("o_orderkey", "kind", "workId", "title", "wordCount", F.array_join("tags", "|").alias("tags"), F.array_join(F.col("authors.key"), "|").alias("author"), F.array_join(F.col("authors.displayName"), "|").alias("name"), "meta.rating", F.array_join("meta.archiveWarnings", "|").alias("warnings"), "meta.language", F.col("meta.completionStatus").alias("done"), "url")


def _blurb(key: Column, title: Column, words: Column, tag: Column, author: Column) -> Column:
    return F.concat(
        F.lit('<li class="work blurb group"><h4 class="heading"><a href="/works/'), key, F.lit('">'), title, F.lit('</a> by <a rel="author" href="/users/'), author, F.lit('/pseuds/p">'), author, F.lit('</a></h4><h5 class="fandoms heading"><a class="tag">F</a></h5><ul class="required-tags"><li><span class="rating-x rating" title="Mature"><span class="text">no</span></span></li>'),
        F.lit('<li><span class="iswip" title=""><span class="text">Complete Work</span></span></li></ul><ul class="tags commas"><li class="warnings"><a class="tag">W</a></li><li class="freeforms"><a class="tag">'), tag, F.lit('</a></li></ul><dl class="stats"><dd class="words">'), words, F.lit('</dd><dd class="chapters">2/2</dd></dl></li>'),
    )


def _listing(kind: str, head: Column, key: Column, blurbs: Column, page: Column, following: Column) -> Column:
    nav = F.concat(F.lit('<ol class="pagination"><li class="current">'), s(page), F.lit("</li>"), F.when(following.isNotNull(), F.concat(F.lit('<li class="next"><a href="?page='), s(following), F.lit('">n</a></li>'))).otherwise(""), F.lit("</ol>"))
    return F.concat(F.lit('<h2 class="heading">'), head, F.lit("</h2>"), nav, F.lit('<ol class="work index group">'), blurbs, F.lit("</ol>"))


_LISTED = "CAST(p_partkey * 2 AS VARCHAR)"


def _listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A tag's, an author's or a search's listing for every part, with three blurbs, the third a repeat of the first."""
    k = F.col("p_partkey")
    of = k % 3
    page, following = F.when(k % 4 == 0, 2).otherwise(1), F.when(k % 5 != 0, F.when(k % 4 == 0, 3).otherwise(2))
    a = _blurb(s(k * 2), F.col("p_name"), F.format_number(k * 1000, 0), F.col("p_type"), F.replace("p_brand", F.lit("#"), F.lit("")))
    b = _blurb(s(k * 2 + 1), F.lit(""), F.lit("none"), F.lit("T"), F.lit("login"))
    count = F.format_number(k + 1000, 0)
    head = F.when(of == 0, F.concat(F.lit("1 - 20 of "), count, F.lit(" Works in <a>T</a>"))).when(of == 1, F.concat(F.lit("Works by "), "p_brand", F.lit(" - Works"))).otherwise(F.concat(count, F.lit(" Found")))
    url = F.when(of == 0, U.tag_works_url(F.col("p_name"), page)).when(of == 1, U.author_works_url(F.concat(F.lit("a"), s(k)), page)).otherwise("https://example.org/works/search?work_search%5Bquery%5D=x")
    return dealt(read(spark, sf, "part"), "p_partkey").select("p_partkey", url.alias("url"), _listing("", head, s(k), F.concat(a, b, a), page, following).alias("html"))


@query("""SELECT p_partkey, ['tag', 'author', 'search'][p_partkey % 3 + 1] AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS tagName, CASE WHEN p_partkey % 3 = 1 THEN 'a' || p_partkey END AS authorKey, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS displayName, CASE WHEN p_partkey % 3 <> 1 THEN p_partkey + 1000 END AS workCount, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS page,
 CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 2 END END AS nextPage, p_partkey * 2 || '|' || (p_partkey * 2 + 1) AS works FROM part""")
def html_listings(spark, sf):
    out = parse_pages(_listing_pages(spark, sf), "p_partkey")
    return out.select("p_partkey", "kind", "tagName", "authorKey", "displayName", "workCount", "page", "nextPage", F.array_join(F.col("works.workId"), "|").alias("works"))


@query("""SELECT p_partkey, CAST(i AS BIGINT) AS position, CAST(p_partkey * 2 + i AS VARCHAR) AS workId, CASE WHEN i = 0 THEN p_name ELSE 'Work ' || (p_partkey * 2 + 1) END AS title, CASE WHEN i = 0 THEN p_partkey * 1000 END AS wordCount, 'F|W|' || CASE WHEN i = 0 THEN p_type ELSE 'T' END AS tags, CASE WHEN i = 0 THEN replace(p_brand, '#', '') || '/pseuds/p' ELSE '' END AS authors, 'Mature' AS rating, 'Complete' AS done, 'W' AS warnings, 'F' AS fandoms FROM part, (VALUES (0), (1)) v(i)""")
def html_blurbs(spark, sf):
    rows = listed_works(parse_pages(_listing_pages(spark, sf), "p_partkey"), "p_partkey")
    return rows.select("p_partkey", F.col("position").cast("long").alias("position"), "workId", "title", "wordCount", F.array_join("tags", "|").alias("tags"), F.array_join(F.col("authors.key"), "|").alias("authors"), "meta.rating", F.col("meta.completionStatus").alias("done"), F.array_join("meta.archiveWarnings", "|").alias("warnings"), F.array_join("meta.fandoms", "|").alias("fandoms"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, c_mktsegment AS m, c_name, floor(o_totalprice) AS words FROM orders JOIN customer ON c_custkey = o_custkey),
 tg AS (SELECT 'Fandom ' || (k % 10) AS tag, k FROM o UNION ALL SELECT m, k FROM o UNION ALL SELECT 'shared', k FROM o)
SELECT 0 AS kind, CAST(k AS VARCHAR) AS key, 'Order ' || k AS title, CAST(words AS BIGINT) AS wordCount, 1.0::DOUBLE AS estimatedFreq, 'complete' AS explorationStatus, 4::BIGINT AS links FROM o
UNION ALL SELECT 1, tag, NULL, NULL, 2.0, 'unexplored', count(*) FROM tg GROUP BY tag UNION ALL SELECT 2, 'u' || c, max(c_name), NULL, 2.0, 'unexplored', count(*) FROM o GROUP BY c""")
def merged_work_pages(spark, sf):
    """All orders' work pages, parsed and merged into an empty graph."""
    from .operators.pages import merge_pages

    o = dealt(read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")), "o_orderkey")
    pages = o.select(F.col("o_orderkey").alias("seq"), U.work_url(s("o_orderkey")).alias("url"), _work_page().alias("html"))
    parsed = materialize(parse_pages(pages, "seq"), "parsed")
    g, _ = merge_pages(L.emptied(load_graph(spark, sf)), parsed, 0, NOW)
    links = g.edges.select("workNodeId", F.col("tagNodeId").alias("hub")).unionByName(g.author_edges.select("workNodeId", F.col("authorNodeId").alias("hub")))
    ends = links.select(F.explode(F.array("workNodeId", "hub")).alias("n")).groupBy("n").agg(F.count("*").alias("links"))
    return g.nodes.join(ends, F.col("id") == F.col("n"), "left").select("kind", "key", "title", "wordCount", "estimatedFreq", "explorationStatus", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query("""WITH p AS (SELECT * FROM part WHERE p_partkey % 3 = 1), b AS (SELECT p_partkey AS k, p_type AS type, 0 AS i, p_name AS title FROM p UNION ALL SELECT p_partkey, 'T', 1, NULL FROM p),
 tg AS (SELECT 'F' AS tag FROM b UNION SELECT 'W' FROM b UNION SELECT type FROM b)
SELECT 0 AS kind, CAST(k * 2 + i AS VARCHAR) AS key, coalesce(title, 'Work ' || (k * 2 + 1)) AS title, CASE WHEN i = 0 THEN k * 1000 END AS wordCount, 1.0::DOUBLE AS estimatedFreq, 'unexplored' AS explorationStatus FROM b
UNION ALL SELECT 1, tag, NULL, NULL, 1.0, 'unexplored' FROM tg UNION ALL SELECT DISTINCT 2, replace(p_brand, '#', '') || '/pseuds/p', replace(p_brand, '#', ''), NULL::BIGINT, 1.0, 'unexplored' FROM p
UNION ALL SELECT 2, 'a' || p_partkey, p_brand, NULL, 3.0, CASE WHEN p_partkey % 5 <> 0 THEN 'partial' ELSE 'complete' END FROM p""")
def merged_author_pages(spark, sf):
    """The authors' listings merged into an empty graph: each adds two works to its author's estimate."""
    from .operators.pages import merge_pages

    pages = _listing_pages(spark, sf).filter("p_partkey % 3 = 1").withColumnRenamed("p_partkey", "seq")
    parsed = materialize(parse_pages(pages, "seq"), "parsed")
    g, _ = merge_pages(L.emptied(load_graph(spark, sf)), parsed, 0, NOW)
    return g.nodes.select("kind", "key", "title", "wordCount", "estimatedFreq", "explorationStatus")


@query("""WITH ev AS (SELECT user_id AS hub, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(value) AS BIGINT) AS cnt, CAST(json_extract_string(props, '$.k') AS INT) AS page FROM events),
 e2 AS (SELECT *, CASE WHEN page % 3 <> 0 THEN page + 1 END AS nxt, max(cnt) OVER (PARTITION BY hub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM ev)
SELECT hub, seq, CASE WHEN coalesce(cnt > known, false) OR nxt IS NOT NULL THEN 'partial' ELSE 'complete' END AS explorationStatus, CASE WHEN coalesce(cnt > known, false) THEN 1 ELSE nxt END AS listingNextPage, max(page) OVER (PARTITION BY hub ORDER BY seq) AS listingPagesFetched, greatest(known, cnt) AS calibratedFreq FROM e2""")
def streamed_listings(spark, sf):
    """The listing events as a stream through per-hub state, all its output."""
    from .streaming.ingest import hub_states

    path = f"{scratch(spark)}/listings-{uuid.uuid4().hex}"
    listing_events(spark, sf).select("hub", "seq", "count", "page", F.col("next_page").cast("int").alias("next_page")).coalesce(2).write.parquet(path)
    source = spark.readStream.schema("hub long, seq long, count long, page int, next_page int").parquet(path)
    out = hub_states(source).writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    out.awaitTermination()
    got = spark.read.parquet(f"{path}-out")
    return got.select("hub", "seq", "explorationStatus", "listingNextPage", "listingPagesFetched", "calibratedFreq")


@query("""WITH c AS (SELECT p_partkey AS k, p_name, p_size FROM part) SELECT k, CASE WHEN k % 3 = 0 THEN 'in' WHEN k % 4 = 0 THEN NULL ELSE 'old' END AS language, CASE WHEN k % 5 <> 0 THEN 'in' ELSE 'old' END AS rating, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'kept' END AS fandoms, CASE WHEN k % 7 = 0 THEN 'A title' ELSE 'Old title' END AS title FROM c""")
def merged_metadata(spark, sf):
    """Works' metadata merged field by field: values that come win, lists only if they have any, bare titles never."""
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    arr = lambda *x: F.array(*x).cast("array<string>")
    old = F.struct(F.when(k % 4 != 0, "old").alias("language"), F.lit("old").alias("rating"), F.lit("x").alias("completionStatus"), arr().alias("archiveWarnings"), arr(F.lit("kept")).alias("fandoms"), arr().alias("categories"))
    new = F.struct(F.when(k % 3 == 0, "in").alias("language"), F.when(k % 5 != 0, "in").alias("rating"), F.lit(None).cast("string").alias("completionStatus"), arr().alias("archiveWarnings"), F.when(F.col("p_size") % 2 == 0, arr("p_name")).otherwise(arr()).alias("fandoms"), arr().alias("categories"))
    title = F.when(k % 7 == 0, "A title").otherwise(F.concat(F.lit("Work "), s(k)))
    blank = dict.fromkeys(("wordCount", "estimatedFreq", "calibratedFreq", "exploredAt", "listingNextPage", "listingPagesFetched"), F.lit(None))
    both = p.select("p_partkey", old.alias("a"), new.alias("b"), title.alias("t"))
    m = S.merge_nodes({"meta": F.col("a"), "title": F.lit("Old title"), "explorationStatus": F.lit("partial"), **blank}, {"meta": F.col("b"), "title": F.col("t"), "key": s(k), "explorationStatus": F.lit("partial"), **blank}, F.lit(WORK))
    return both.select("p_partkey", m["meta"].alias("m"), m["title"].alias("title")).select(F.col("p_partkey").alias("k"), "m.language", "m.rating", F.array_join("m.fandoms", "|").alias("fandoms"), "title")


@query(f"{_with()} SELECT 'tag' AS type, n.key, 1::BIGINT AS page FROM nodes n WHERE false UNION ALL SELECT CASE v.kind WHEN 0 THEN 'work' WHEN 1 THEN 'tagListing' ELSE 'authorListing' END, v.key, CASE WHEN v.kind = 0 THEN NULL ELSE coalesce(n.nxt, 1) END FROM (SELECT DISTINCT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{v}{chr(39)})' for k, v in POSITIVE)}) v(kind, key)) v LEFT JOIN nodes n ON n.kind = v.kind AND n.key = v.key WHERE n.id IS NULL OR n.st <> 'complete'")
def seed_fetches(spark, sf):
    """What must be fetched before a search: seeds that are unknown or not complete."""
    from .plans.executor import seed_plans

    return seed_plans(load_graph(spark, sf).nodes, POSITIVE).select("type", "key", F.col("page").cast("long").alias("page"))


@query(f"{_with()} SELECT kind, count(*) AS n, round(max(est), 6) AS top_freq FROM nodes GROUP BY kind")
def local_frequencies(spark, sf):
    """How often tags, authors and works are named in the graph itself."""
    g = load_graph(spark, sf)
    d = A.link_counts(g)
    n = g.nodes.join(d.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    return n.groupBy("kind").agg(F.count("*").alias("n"), r8(F.max(F.coalesce(F.when(F.col("kind") == WORK, 1.0).otherwise(F.col("links").cast("double")), F.lit(0.0))), 6).alias("top_freq"))
