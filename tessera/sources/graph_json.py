"""A graph as one JSON document: written, read, checked as a whole, imported."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import Import, import_merge
from ..schema import AUTHOR_EDGE, EDGE, NODE, STATES, Graph
from ..session import discard, materialize, spread

VERSION, VERSIONS = 2, (1, 2)
DOCUMENT = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("exportedAt", T.StringType()), T.StructField("nextNodeId", T.LongType()),
    T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("authorEdges", T.ArrayType(AUTHOR_EDGE)),
])


class BadDocument(ValueError):
    """A document with any fault is rejected whole."""


def export_graph(graph: Graph, next_id: int, at: str) -> DataFrame:
    """One row with the document, for graphs that fit a row; `write_document` writes the same document whatever its size."""
    gather = lambda df, name: df.agg(F.coalesce(F.collect_list(F.struct(*df.columns)), F.array().cast(df.select(F.struct(*df.columns)).schema[0].dataType.simpleString().join(("array<", ">")))).alias(name))
    parts = [gather(d, n).withColumn("one", F.lit(1)) for d, n in ((graph.nodes, "nodes"), (graph.edges, "edges"), (graph.author_edges, "authorEdges"))]
    doc = parts[0].join(parts[1], "one").join(parts[2], "one")
    return doc.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(at).alias("exportedAt"), F.lit(next_id).cast("long").alias("nextNodeId"), "nodes", "edges", "authorEdges")).alias("value"))


#: How the records of each table begin in a document's lines, and the lines between them.
RECORD = {"nodes": r'^,?\{"id":', "edges": r'^,?\{"workNodeId":-?[0-9]+,"tagNodeId":', "authorEdges": r'^,?\{"workNodeId":-?[0-9]+,"authorNodeId":'}
HEAD, BETWEEN = r'^\{"version":.*"nodes":\[$', ('],"edges":[', '],"authorEdges":[', "]}")


def _records(table: DataFrame) -> DataFrame:
    """A stored table's rows as lines: the first one alone in front, each other after a comma."""
    at = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    text = F.to_json(F.struct(*table.columns))
    first = table.select(*at).first()
    if first is None:
        return table.select(text.alias("value"))
    is_first = (at[0] == first[0]) & (at[1] == first[1])
    return table.filter(is_first).select(text.alias("value")).union(table.filter(~is_first).select(F.concat(F.lit(","), text).alias("value")))


def write_document(graph: Graph, next_id: int, at: str, path: str) -> None:
    """The document as files of lines, a record each: put together in order of their names they are the one JSON document, and no row or task holds it."""
    spark = graph.nodes.sparkSession
    line = lambda text: spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
    stored = [materialize(t, n) for n, t in zip(RECORD, (graph.nodes, graph.edges, graph.author_edges))]
    head = json.dumps({"version": VERSION, "exportedAt": at, "nextNodeId": next_id, "nodes": []}, separators=(",", ":"))
    out = line(head.removesuffix("]}"))
    for table, after in zip(stored, BETWEEN):
        out = out.union(_records(table)).union(line(after))  # partitions, and so files, keep this order
    out.write.option("lineSep", "\n").option("compression", "gzip").text(path)
    for table in stored:
        discard(table)


def read_document(spark: SparkSession, path: str) -> tuple[Graph, int]:
    """The graph and next id of a document that `write_document` wrote, parsed line by line, or BadDocument."""
    lines, v = spark.read.option("lineSep", "\n").text(path), F.col("value")
    of = {n: v.rlike(begin) for n, begin in RECORD.items()}
    none = F.lit(True)
    for c in of.values():
        none = none & ~c
    counts = [F.count_if(c).alias(n) for n, c in of.items()] + [F.count_if(c & v.startswith("{")).alias(f"{n}_first") for n, c in of.items()]
    got = lines.agg(*counts, F.count_if(none).alias("others"), F.count_if(v.rlike(HEAD)).alias("heads"), F.max(F.when(v.rlike(HEAD), v)).alias("head"), *[F.count_if(v == b).alias(f"b{i}") for i, b in enumerate(BETWEEN)]).first()
    if got["heads"] != 1 or got["others"] != 1 + len(BETWEEN) or any(got[f"b{i}"] != 1 for i in range(len(BETWEEN))):
        raise BadDocument("a line is missing or no record")
    if any(got[f"{n}_first"] != min(1, got[n]) for n in RECORD):
        raise BadDocument("each table has one first record")
    try:
        head = json.loads(got["head"] + "]}")
    except ValueError as e:
        raise BadDocument("the document's head is no JSON") from e
    if head["version"] != VERSION or type(head.get("nextNodeId")) is not int or head["nextNodeId"] < 0:
        raise BadDocument("version and nextNodeId are needed")
    record = lambda n, shape: materialize(lines.filter(of[n]).select(F.from_json(F.ltrim(v, F.lit(",")), shape).alias("r")).select("r.*"), n)
    return _checked(*(record(n, shape) for n, shape in zip(RECORD, (NODE, EDGE, AUTHOR_EDGE))), head["nextNodeId"]), head["nextNodeId"]


def write_lines(graph: Graph, path: str) -> None:
    """The tables as JSON lines, one folder each: the same records as the document's, in as many files as Spark likes."""
    for name, table in (("nodes", graph.nodes), ("edges", graph.edges), ("authorEdges", graph.author_edges)):
        table.write.option("compression", "gzip").json(f"{path}/{name}")


def read_lines(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.schema(shape).json(f"{path}/{name}") for name, shape in (("nodes", NODE), ("edges", EDGE), ("authorEdges", AUTHOR_EDGE))))


def parse_graph(spark: SparkSession, text: str | DataFrame) -> tuple[Graph, int]:
    """The document's graph and next id, or BadDocument."""
    rows = spark.createDataFrame([(text,)], "value string") if isinstance(text, str) else text.select("value")
    d = rows.select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")
    head = d.select("version", "nextNodeId", *[F.col(c).isNotNull().alias(c) for c in ("nodes", "edges", "authorEdges")]).first()
    if head is None or head["version"] not in VERSIONS or head["nextNodeId"] is None or head["nextNodeId"] < 0 or not head["nodes"] or not head["edges"]:
        raise BadDocument("version, nextNodeId, nodes and edges are needed")
    if head["version"] == 2 and not head["authorEdges"]:
        raise BadDocument("authorEdges is needed")
    nodes, edges = d.select(F.explode("nodes").alias("n")).select("n.*"), d.select(F.explode("edges").alias("e")).select("e.*")
    author_edges = d.select(F.explode("authorEdges").alias("e")).select("e.*")
    return _checked(nodes, edges, author_edges, head["nextNodeId"]), head["nextNodeId"]


def _checked(nodes: DataFrame, edges: DataFrame, author_edges: DataFrame, next_id: int) -> Graph:
    """The records as a graph, or BadDocument if any of them is at fault."""
    nodes = nodes.withColumn("explorationStatus", F.coalesce("explorationStatus", F.when(F.col("explored"), STATES[2]).otherwise(STATES[0])))
    status_bad = ~F.col("explorationStatus").isin(*STATES)
    bad = F.col("id").isNull() | (F.col("id") < 0) | F.col("kind").isNull() | ~F.col("kind").isin(0, 1, 2) | F.col("key").isNull() | F.col("estimatedFreq").isNull() | status_bad
    got = nodes.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.coalesce(F.max("id"), F.lit(-1)).alias("top")).first()
    if got["bad"]:
        raise BadDocument(f"{got['bad']} nodes have a field that is missing or wrong")
    if got["n"] != got["ids"]:
        raise BadDocument("node ids repeat")
    if next_id <= got["top"]:
        raise BadDocument("nextNodeId must be above every id")
    ends = [t.select(F.col(c).alias("end")) for t, hub in ((edges, "tagNodeId"), (author_edges, "authorNodeId")) for c in ("workNodeId", hub)]
    named = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct()
    if named.join(spread(nodes.select(F.col("id").alias("end"))), "end", "left_anti").limit(1).count():
        raise BadDocument("an edge names no node")
    return Graph(nodes, edges, author_edges)


def import_graph(spark: SparkSession, local: Graph, next_id: int, text: str | DataFrame, mode: str) -> Import:
    """Overwrite the local graph by the document's, or merge it in by (kind, key)."""
    return _import(local, next_id, *parse_graph(spark, text), mode)


def import_document(spark: SparkSession, local: Graph, next_id: int, path: str, mode: str) -> Import:
    """`import_graph` of a document in files."""
    return _import(local, next_id, *read_document(spark, path), mode)


def _import(local: Graph, next_id: int, graph: Graph, above: int, mode: str) -> Import:
    if mode == "overwrite":
        ids = graph.nodes.select(F.col("id").alias("old"), F.col("id").alias("new"))
        return Import(graph, ids, above)
    if mode != "merge":
        raise ValueError(mode)
    return import_merge(local, graph, next_id)
