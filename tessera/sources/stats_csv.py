"""The tag statistics dump: CSV lines `id,type,name,canonical,cached_count,merger_id`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import is_redacted, trimmed
from ..schema import TAG, Graph
from ..session import spread

FILE_NAME = r"(?i)tags-\d{8}\.csv$"
#: Tag types that describe works rather than what they are about.
SYSTEM_TYPES = ("Rating", "Category", "ArchiveWarning", "Media")
_FIELDS = "a string, b string, c string, d string, e string, f string"


def _leading_int(text):
    got = F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1)
    return F.when(got != "", got.cast("long"))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of lines that have five fields or more, an id and a count of 0 or more, and a name that is not redacted."""
    n_commas = F.size(F.split(F.regexp_replace(F.col(column), r'"(?:[^"]|"")*"', ""), ","))
    rows = lines.filter(trimmed(F.col(column)) != "").filter(n_commas >= 5).select(F.from_csv(F.col(column), _FIELDS, {"escape": '"', "quote": '"', "nullValue": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("r"))
    c = {k: F.coalesce(f"r.{k}", F.lit("")) for k in "abcdef"}
    out = rows.select(
        _leading_int(c["a"]).alias("tag_id"), trimmed(c["b"]).alias("type"), c["c"].alias("name"), (F.lower(trimmed(c["d"])) == "true").alias("canonical"),
        _leading_int(c["e"]).alias("cached_count"), _leading_int(c["f"]).alias("merger_id"),
    )
    return out.filter((F.col("tag_id") >= 0) & (F.col("cached_count") >= 0) & ~is_redacted(F.col("name")))


def read_dump(spark: SparkSession, path: str, header: str = "id,type,name,canonical,cached_count,merger_id") -> DataFrame:
    """All tags of a dump's files; lines that are the header (its id is no number) fall out by parse_lines."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    return parse_lines(lines.filter(F.col("value") != header))


def content_tags(stats: DataFrame) -> DataFrame:
    return stats.filter(~F.col("type").isin(*SYSTEM_TYPES))


def is_dump_name(path: Column) -> Column:
    return path.rlike(FILE_NAME)


def lines_of_chunks(chunks: DataFrame, group: str) -> DataFrame:
    """(group, line, value) of texts that come in chunks (group, seq, chunk): lines end at line breaks, wherever chunks do.

    A chunk's first part ends the line that chunks before it left open. Lines are numbered
    by the breaks before them, a chunk's own and a running sum over the chunks before, and
    put together from parts; an empty rest at the end is no line.
    """
    breaks = F.size(F.split("chunk", "\n", -1)) - 1
    before = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = chunks.select(group, "seq", breaks.alias("breaks")).withColumn("first", F.coalesce(F.sum("breaks").over(before), F.lit(0)))
    parts = chunks.join(at.drop("breaks"), [group, "seq"]).select(group, "seq", "first", F.posexplode(F.split("chunk", "\n", -1)).alias("place", "part"))
    lines = parts.groupBy(group, (F.col("first") + F.col("place")).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "").alias("value"))
    last = at.groupBy(group).agg(F.max(F.col("first") + F.col("breaks")).alias("__last"))
    return lines.join(last, group).filter((F.col("line") < F.col("__last")) | (F.col("value") != "")).select(group, "line", F.regexp_replace("value", "\r$", "").alias("value"))


@dataclass
class StatsImport:
    """What an import did: rows stored, graph tags that took a count, tags merged into others; and the graph and statistics after it."""

    stored: int
    calibrated: int
    merged: int
    graph: Graph
    stats: DataFrame
    names: DataFrame


def import_stats(graph: Graph, stats: DataFrame, known: DataFrame | None = None, store: bool = True, apply: bool = True) -> StatsImport:
    """Put statistics into the store (names of graph tags alone are indexed) and apply counts and mergers to the graph, either or both."""
    from ..operators.lookup import stored_stats
    from ..operators.store import calibrate, canonical_names, merge_tags

    tags = graph.nodes.filter(F.col("kind") == TAG).select("key")
    put, names = stored_stats(known if known is not None else stats.limit(0), stats, tags if apply else None)
    if not store:
        put, names = (known, names.limit(0)) if known is not None else (stats.limit(0), names.limit(0))
    if not apply:
        return StatsImport(stats.count() if store else 0, 0, 0, graph, put, names)
    calibrated = tags.join(spread(stats.select(F.col("name").alias("key")).distinct()), "key", "left_semi").count()
    graph = Graph(calibrate(graph.nodes, stats), graph.edges, graph.author_edges)
    graph, merged = merge_tags(graph, canonical_names(stats))
    return StatsImport(stats.count() if store else 0, calibrated, merged.first()["merged"] or 0, graph, put, names)


def import_dump(spark: SparkSession, path: str, graph: Graph, progress: Callable[[str, int], None] = lambda phase, rows: None) -> StatsImport:
    """A dump's files imported: rows are read and counted by Spark, so progress is told before and after, not by row."""
    rows = read_dump(spark, path)
    progress("tags", rows.count())
    out = import_stats(graph, rows)
    progress("done", out.stored)
    return out


def dump_stream(spark: SparkSession, folder: str, store: Callable[[DataFrame, int], None], checkpoint: str, files: int = 1, progress: Callable[[int], None] = lambda rows: None) -> StreamingQuery:
    """Dump files as they arrive, some at a time: each batch's rows go to `store`, their number so far to `progress`."""
    done = [0]

    def batch(df: DataFrame, number: int) -> None:
        rows = parse_lines(df.select(F.regexp_replace("value", "\r$", "").alias("value")))
        store(rows, number)
        done[0] += rows.count()
        progress(done[0])

    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(folder)
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
