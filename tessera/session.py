"""Sessions and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables of so many bytes have shuffle files worth deleting at once: those are often twenty times as large as the table, more after sums.
LARGE = 4 << 20


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with adaptive execution; what the caller's session has set stays."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where all runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='tessera-')}")


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and lost executors cost nothing."""
    path = f"{scratch(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sweep(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, path: str) -> None:
    """After a large table has been written, let Spark delete the shuffle files that made it: it does so once the driver's JVM has collected its garbage."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() >= LARGE:
        jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize wrote and that nothing reads any more."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(parts: list[DataFrame], key: str, what: str) -> DataFrame:
    """Tables of the same columns, written one after another into one table in buckets by key, so that joins and groupings by it deal out none of its rows.

    Each part is dealt out once, and its shuffle files can go before the next part is written.
    """
    spark = parts[0].sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{what}_{uuid.uuid4().hex}"
    for p in parts:
        p.repartition(ways, key).write.mode("append").bucketBy(ways, key).sortBy(key).option("path", f"{scratch(spark)}/{name}").saveAsTable(name)
        sweep(spark, f"{scratch(spark)}/{name}")
    return spark.table(name)


def drop(table: DataFrame) -> None:
    """Delete a table that bucketed wrote and that nothing reads any more."""
    files = table.inputFiles()
    discard(table)
    if files:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {files[0].split('/')[-2]}")


def spread(df: DataFrame) -> DataFrame:
    """A side of a join whose rows grow with the input, so that it is dealt out and never broadcast: a small file may hold many rows, which the driver would gather."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt over four tasks a core, before costly work of which a small file would put all in one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)
