"""Reliable staging of intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="veta-checkpoint-")
    sc.setCheckpointDir(folder)


def stage(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write df once to the checkpoint folder and continue from the written copy.

    ``spread`` is for rows that will be scanned many times: a table with fewer
    partitions than cores (so, a small one) is dealt out evenly before it is reused.
    """
    ensure_checkpoint_dir(df.sparkSession)
    staged = df.checkpoint(eager=True)
    if spread:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if staged.rdd.getNumPartitions() < cores:
            return staged.repartition(cores).checkpoint(eager=True)
    return staged


def stage_columns(df: DataFrame) -> DataFrame:
    """Write df once as Parquet into the checkpoint folder: later scans read only the columns they use.

    Row groups are small, so that few files are still read by many tasks.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_few_files(df: DataFrame) -> DataFrame:
    """Deal the rows of a table with fewer files than cores over all cores.

    A file is read by as many tasks as it has row groups, often one.  Tables of many
    files pass through untouched, so nothing large is ever shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
