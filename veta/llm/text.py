"""Column expressions and staging shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.functions.staging import ensure_checkpoint_dir

WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), lambda v: body(v)).getItem(0)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII white-space characters; null has none."""
    return F.array_remove(F.split(text_or_empty(text), WHITE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42) of every run of `size` words joined by one space, repeats included.

    A text of fewer words gives one hash, of all its words; a text without words gives none.
    """
    def hashes(ws: Column) -> Column:
        n = F.size(ws)
        full = F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(ws, i + k) for k in range(size)))),
        )
        whole = F.array(F.xxhash64(F.array_join(ws, " ")))
        return F.when(n >= size, full).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), hashes)


def store(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df once as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like checkpoint(), but in columns, so later scans read only what they use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
