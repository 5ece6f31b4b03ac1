"""From raw documents to a token store: five stages, each over all that the one before kept.

Every stage takes empty tables (and gives one), nulls in any column, rows and doc_ids that
repeat, very long texts, and other columns of whatever names, which it leaves out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import content_store, language_id, mixing, ngram_join
from tessera.llm.common import drop_path, made, settle
from tessera.llm.decontamination import drop_leaks
from tessera.llm.queries import table, tokenizer_path
from tessera.session import spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language text and source tell, with the lang they had; those of null, empty or letterless text go, as all do if no row has a lang."""
    model = language_id.fit(docs)
    told = language_id.identify(docs.withColumnRenamed("lang", "__lang"), model, host=F.col("source"))
    return told.filter("accepted").withColumn("lang", F.col("__lang")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link, that of the least doc_id (null last), then of the least text hash; all that are linked with nothing."""
    rows = settle(docs.select(*COLUMNS, F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row")), "rows")
    groups = settle(ngram_join.linked_rows(rows, keep=("__hash", "__row")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__hash", "__row"))["__row"]
    linked = groups.filter("label is not null").groupBy("label").agg(first.alias("__kept")).select("__kept")
    kept = linked.union(groups.filter("label is null").select("__row"))
    return rows.join(kept, rows["__row"] == kept["__kept"], "left_semi").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and wordless texts stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; texts without words are taken for nothing and go.

    Rows are told apart by their places in a written table, so null and repeated doc_ids do no harm.
    """
    rows = settle(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "rows")
    sized = rows.select("doc_id", "source", "__row", mixing.words_in(F.col("text")).alias("size"))
    taken = settle(mixing.mix(sized, "size", keep=("__row",)).filter("taken > 0").select(F.col("__row").alias("__taken"), F.floor(F.col("taken") / F.col("size")).cast("int").alias("__times")), "taken")
    mixed = rows.join(spread(taken), rows["__row"] == taken["__taken"])
    return mixed.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The store's index: doc_id, start, n_tokens, ids_crc32; a null text is its end id alone, rows that repeat stand as often."""
    path = content_store.new_store(spark)
    content_store.write_store(docs, tokenizer_path(), path)
    return content_store.read_index(spark, path)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def cleared(stage: Stage) -> Stage:
    """The stage, which first deletes what the one before it left: its rows have been written and read again by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            drop_path(spark, _left.pop())
        start = len(made)
        out = stage(spark, docs, sf_dir)
        _left.extend(made[start:])
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", cleared(keep_identified)),
    ("near_duplicates", cleared(keep_one_of_each_group)),
    ("decontamination", cleared(drop_benchmark_leaks)),
    ("mixing", cleared(mix_sources)),
    ("token_store", cleared(write_tokens)),
]

#: Language likelihoods and token ids are not SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's intermediate tables, and its rows, go once those of the next are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)
        before = made[-1]
    return docs
