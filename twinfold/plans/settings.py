"""Session settings the plans read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS = 4096  # rows per side of one comparison tile
HOT_GRAM_ROWS = 4096  # a gram found in more values than this counts as hot
VECTOR_BLOCK_ROWS = 1024
_written: list = []


def conf_int(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.twinfold.{name}", str(default)))


def block_rows(spark: SparkSession) -> int:
    return conf_int(spark, "blockRows", BLOCK_ROWS)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: the session's setting, else its cores."""
    cores = spark.sparkContext.defaultParallelism
    given = spark.conf.getAll.get("spark.sql.shuffle.partitions")
    if given is not None:
        return max(int(given), cores)
    return cores if spark.sparkContext.master.startswith("local") else max(200, cores)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal the rows out to all cores when the input has fewer splits than that.

    For work that is heavy per row. Such an input is at most one split per core,
    so the extra shuffle is small; larger inputs stay where they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *cols)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            named = tempfile.mkdtemp(prefix="twinfold-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results that several branches of a plan read: they are computed once and
    outlive any executor. As Parquet, readers take only the columns they need
    and the planner knows the true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/twinfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables :func:`cut_lineage` wrote so far; results using them end."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    count = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count
