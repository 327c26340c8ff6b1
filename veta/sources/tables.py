"""Stage tables and raw imports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import report

SAMPLE_ROWS = 10


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "csv") -> DataFrame:
    """Raw import.  Give the schema: without one a csv file is read twice to infer it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.options(header=True, inferSchema=schema is None, enforceSchema=False).csv(path)
    return reader.format(fmt).load(path)


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> str:
    """Write a stage table; a split column becomes a folder level readers can skip."""
    writer = df.write.mode("overwrite")
    partition_by = list(partition_by)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_report_csv(df: DataFrame, path: str) -> str:
    """Write a report table (a few rows) as one csv file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_metadata_json(spark: SparkSession, record: dict, path: str) -> str:
    """Write one run's metadata (nested dicts and lists) as one json record."""
    text = spark.createDataFrame([(json.dumps(record),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)
    return path


def read_metadata_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def import_summary(df: DataFrame) -> DataFrame:
    """Row count, column count and the ordered column types of an import."""
    rows = df.count()
    return report(
        df.sparkSession,
        [(i, name, dtype, rows, len(df.columns)) for i, (name, dtype) in enumerate(df.dtypes)],
        "position int, column string, type string, n_rows long, n_columns int",
    )


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type."""
    kinds: dict[str, int] = {}
    for _, dtype in df.dtypes:
        kinds[dtype] = kinds.get(dtype, 0) + 1
    return report(df.sparkSession, sorted(kinds.items()), "type string, n_columns int")


def first_rows(df: DataFrame, order: Iterable[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows by an explicit order."""
    return df.orderBy(*[F.col(c) for c in order]).limit(n)
