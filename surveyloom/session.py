"""Where intermediate tables go.

On a cluster the folder is the one named by ``spark.checkpoint.dir``, which every executor can read.
Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="surveyloom-"))
    return spark.sparkContext.getCheckpointDir()


def own_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/surveyloom-{spark.sparkContext.applicationId}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Give trainers that checkpoint their own tables a folder, so that long fits keep no long lineage."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{own_dir(spark)}/checkpoints")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the application's folder that nothing has used before."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove all that this application has stored; tables and files that it returned can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(conf).delete(path, True)


def discard(stored: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing will read any more."""
    spark = stored.sparkSession
    for file in stored.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    The lineage is cut and the rows outlive any executor; used for tables that are read several times.
    ``spread`` deals a table that fills fewer files than there are cores over all cores, for readers
    that do much work per row.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and stored.rdd.getNumPartitions() < cores:
        return stored.repartition(cores)
    return stored


def deal(stored: DataFrame, name: str) -> DataFrame:
    """A table of ``materialize`` that is read by fewer tasks than there are cores, stored again with a file per core.

    For tables that many passes read with much work per row; each pass then starts from the files, without a shuffle.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    if stored.rdd.getNumPartitions() >= cores:
        return stored
    dealt = materialize(stored.repartition(cores), name)
    discard(stored)
    return dealt
