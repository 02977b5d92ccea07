"""Parquet tables of one scale-factor directory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` under `sf_dir`; only `columns` when given, so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(df: DataFrame) -> int:
    """Partitions of the plan's largest scan. Only the scans are planned, so no shuffle of the plan is run for it."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return max((leaves.apply(i).execute().getNumPartitions() for i in range(leaves.size())), default=1)


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores.

    Small inputs come in fewer partitions than cores, which would leave a Python stage on one of them. Inputs that
    already have enough partitions are returned as they are, so at scale nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if partitions(df) >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where that is unset, as in tests, a local master gets a temporary folder; any other master gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root}/{uuid.uuid4().hex}"


def persisted(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage and survives the loss of executors.

    The files stay while results may still be read; release() or the folder's owner removes them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what persisted() has written so far; call it once the results are written. Returns the number of tables."""
    count = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count
