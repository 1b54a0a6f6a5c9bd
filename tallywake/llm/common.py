"""What several operators share: tables, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session. Only on one machine, as in tests, is a temporary
    folder made and set where it is unset; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and held.isDefined():
        path = held.get()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tallywake-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_dir(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Shuffle files are deleted at the end of the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Queries that are begun here delete their shuffle files at their end, and do not
    leave them until the driver collects garbage, which with a large heap is late. Only
    for what is written and read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder once, so that a
    lost executor costs a read and not the whole history."""
    shared_dir(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own


#: Where the tables of ``stored`` lie.
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Cuts lineage like ``cut``, by a compressed table in the shared folder; for
    frames with many rows or texts. It stays until ``drop``."""
    path = work_dir(df.sparkSession, what)
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that no frame still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_stored.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """A-Z in lower case; every other character, also é or İ, as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list, as ``node, component``.

    ``edges`` has the columns ``a`` and ``b`` of one orderable type. Only nodes
    that have an edge to another node are returned; ``component`` is the
    smallest node that can be reached. The large-star and small-star steps of
    Kiveris et al. (2014) are taken in turn until the stars stand still; both
    are one grouped minimum and one equi-join, without UDFs, so that a node with
    very many neighbours is a skewed join that Spark can split, never one
    collected group. Repeated edges, loops and null ends do no harm.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        # Stars stand still once no node hangs on two others or on one that hangs itself.
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        # Large star: every larger neighbour is hung on the smallest neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours and the node are hung on the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
