"""Shared helpers of the corpus operators: scratch tables, null-safe text, batch iteration."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition used throughout: space, tab, line feed to carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A session on one machine (master ``local``) that sets neither gets a new folder once. On a cluster that is an error,
    since executors would not see a folder of the driver.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    import tempfile

    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"


class Scratch:
    """Parquet tables in the shared folder that cut lineage; a lost executor rereads them instead of recomputing.

    Operators take one as ``scratch``. The tables that their result still reads stay until its owner calls ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.drop(name)
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            if name in self.paths:
                path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


    def close(self) -> None:
        """Delete every table left; results that read them can't be used any more."""
        self.drop(*list(self.paths))


def free_name(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` doesn't have."""
    while name in {c.lower() for c in rows.columns}:
        name = "_" + name
    return name


def numbered(documents: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, str]:
    """``documents`` written with a unique number for each row, and the name of that column, which clashes with none."""
    column = free_name(documents, "row")
    return scratch.table(documents.withColumn(column, F.monotonically_increasing_id()), name), column


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of ``groups`` that has their ``keys``; column ``count`` is dropped.

    ``count`` says how many rows a group has. Groups with over a thousandth of all rows counted are a thousand at most,
    so they are broadcast, and their rows stay where they are; only rows of smaller groups are shuffled to meet theirs.
    Both tables are read twice and should be written ones.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot, rest = groups.filter(F.col(count) * 1000 > total).drop(count), groups.filter(F.col(count) * 1000 <= total).drop(count)
    there = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return there.unionByName(others)


def text_of(column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table. One in fewer pieces than there are cores is dealt over all of them; others are read as they lie."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def hashed_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): a document is known by 128 bits of hash over doc_id and text; equal rows are one document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", "doc_id"))
