"""Session helpers: cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession, local_only: str) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder on a master of one machine, an error on a cluster, whose machines share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix=local_only)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by key over all shuffle partitions, for kernels that take long over few bytes: by size the planner would put them into a task or two."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: Parquet files in spark.checkpoint.dir; where that is unset (tests on one machine) in a temporary folder.

    Unlike a checkpoint they are compressed, read by column and of a size that the planner knows.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark, "revlake-"))
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more, and lets Spark delete the shuffle files of what is done."""
    for table in tables:
        if folder := getattr(table, "_folder", None):
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    for table in tables[:1]:
        table.sparkSession.sparkContext._jvm.System.gc()
