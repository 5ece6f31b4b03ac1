"""The graph that the star-schema tables stand for: orders are works, parts tags, customers authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.numbering import dense_numbers
from ..schema import AUTHOR, META, STATES, TAG, WORK, Graph
from ..session import spread

#: Listing times of tags, in ms: an origin and a step for each part.
LISTED, STEP = 1_700_000_000_000, 3_600_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _state(n: Column) -> Column:
    """0 complete, 1 partial, 2 unexplored."""
    return F.when(n == 0, STATES[2]).when(n == 1, STATES[1]).otherwise(STATES[0])


def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (work, tag), dealt out by work alone, so that a join with the works finds them in place."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("tag")).repartition("work").distinct()


def load_graph(spark: SparkSession, sf_dir: str, meta: bool = False) -> Graph:
    """Nodes numbered by kind, then key. `meta` adds the works' metadata, which needs two more joins."""
    orders, part, customer = (read(spark, sf_dir, t) for t in ("orders", "part", "customer"))
    keys = edge_keys(spark, sf_dir)
    n_works, n_tags = orders.count(), part.count()
    none = lambda t: F.lit(None).cast(t)
    status = F.when(F.col("o_orderstatus") == "F", STATES[2]).when(F.col("o_orderstatus") == "P", STATES[1]).otherwise(STATES[0])
    works = dense_numbers(orders, "o_orderkey", "id")
    if meta:
        works = with_meta(spark, sf_dir, works)
    works = works.select(
        "id", F.lit(WORK).alias("kind"), F.col("o_orderkey").cast("string").alias("key"), F.concat(F.lit("Work "), F.col("o_orderkey").cast("string")).alias("title"),
        F.floor(F.col("o_totalprice") / 10).cast("long").alias("wordCount"), F.lit(1.0).alias("estimatedFreq"), none("double").alias("calibratedFreq"), status.alias("explorationStatus"),
        F.when(F.col("o_orderstatus") != "O", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', o_orderdate)")).alias("exploredAt"), none("int").alias("listingNextPage"), F.lit(0).alias("listingPagesFetched"),
        (F.col("o_orderstatus") == "F").alias("explored"), (F.col("meta") if meta else F.lit(None).cast(META)).alias("meta"),
    )
    tag_freq = keys.groupBy("tag").agg(F.count("*").cast("double").alias("freq"))
    state = _state(F.col("p_size") % 3)
    tags = dense_numbers(part, "p_partkey", "id", n_works).join(spread(tag_freq), F.col("p_partkey") == F.col("tag"), "left").select(
        "id", F.lit(TAG).alias("kind"), F.col("p_partkey").cast("string").alias("key"), none("string").alias("title"), none("long").alias("wordCount"),
        F.coalesce("freq", F.lit(0.0)).alias("estimatedFreq"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).alias("calibratedFreq"), state.alias("explorationStatus"),
        F.when(state != STATES[0], F.lit(LISTED) + F.col("p_partkey") * STEP).alias("exploredAt"), F.when(state == STATES[1], F.lit(2)).alias("listingNextPage"),
        F.when(state == STATES[0], 0).otherwise(1).alias("listingPagesFetched"), (state == STATES[2]).alias("explored"), F.lit(None).cast(META).alias("meta"),
    )
    written = orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("freq"))
    authors = dense_numbers(customer, "c_custkey", "id", n_works + n_tags).join(written, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "id", F.lit(AUTHOR).alias("kind"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("title"), none("long").alias("wordCount"),
        F.coalesce("freq", F.lit(0.0)).alias("estimatedFreq"), none("double").alias("calibratedFreq"), F.lit(STATES[0]).alias("explorationStatus"), none("long").alias("exploredAt"),
        none("int").alias("listingNextPage"), F.lit(0).alias("listingPagesFetched"), F.lit(False).alias("explored"), F.lit(None).cast(META).alias("meta"),
    )
    nodes = works.unionByName(tags).unionByName(authors)
    ids = {k: d.select("id", F.col("key").cast("long").alias("k")) for k, d in ((WORK, works), (TAG, tags), (AUTHOR, authors))}
    w = ids[WORK].select(F.col("id").alias("workNodeId"), F.col("k").alias("wk"))
    edges = keys.join(w, F.col("work") == F.col("wk")).join(ids[TAG].select(F.col("id").alias("tagNodeId"), F.col("k").alias("tk")), F.col("tag") == F.col("tk")).select("workNodeId", "tagNodeId")
    pairs = orders.select("o_orderkey", "o_custkey")
    author_edges = pairs.join(w, F.col("o_orderkey") == F.col("wk")).join(ids[AUTHOR].select(F.col("id").alias("authorNodeId"), F.col("k").alias("ak")), F.col("o_custkey") == F.col("ak")).select("workNodeId", "authorNodeId")
    return Graph(nodes, edges, author_edges)


def with_meta(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """orders with the metadata struct of FIXTURES: rating, completion, language, fandoms, categories, warnings."""
    lines, part, customer = (read(spark, sf_dir, t) for t in ("lineitem", "part", "customer"))
    lists = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("warn"), F.array_sort(F.collect_set("p_brand")).alias("fan"), F.array_sort(F.collect_set("p_type")).alias("cat")
    )
    empty = F.array().cast("array<string>")
    joined = orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    done = F.when(F.col("o_orderstatus") == "F", "Complete").otherwise("Incomplete")
    meta = F.struct(
        F.col("c_mktsegment").alias("language"), F.col("o_orderpriority").alias("rating"), done.alias("completionStatus"),
        F.coalesce("warn", empty).alias("archiveWarnings"), F.coalesce("fan", empty).alias("fandoms"), F.coalesce("cat", empty).alias("categories"),
    )
    return joined.withColumn("meta", meta)


def stats_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the statistics dump; a tag's merger is the part of the same name before it."""
    before = F.lag("p_partkey").over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("tag_id"), F.col("p_type").alias("type"), F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("name"),
        before.isNull().alias("canonical"), F.col("p_size").cast("long").alias("cached_count"), before.alias("merger_id"),
    )
