"""Running totals and rank lookups over value tables of any length.

A window without partitions would send the whole table through one task, so the
table is dealt out by value ranges first: totals run inside each range and the few
range totals are carried over.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage


def running_totals(df: DataFrame, order: str, values: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Add ``cum_<value>``: inclusive totals in ascending ``order`` within ``by``.

    ``df`` holds one row per (by, order), e.g. the result of a groupBy, and no null
    ``order``.  Spark's range shuffle cuts it on (by, order), whatever their types, into at most
    ``spark.sql.shuffle.partitions`` ranges, fewer where adaptive execution finds little to
    deal out; the number of a range is written with its rows.
    """
    by, values = list(by), list(values)
    # written, so that a lost task cannot draw other borders than those the carried totals saw
    ranged = stage(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    carried = ranged.groupBy(*by, "_range").agg(*[F.sum(v).alias(v) for v in values])
    carried = carried.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_range").alias("_carried"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_carry_{v}") for v in values],
    )
    on = F.col("_range") == F.col("_carried")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        ranged.withColumns({f"_run_{v}": F.sum(v).over(inside) for v in values})
        .join(carried, on)
        .select(*df.columns, *[(F.col(f"_run_{v}") + F.col(f"_carry_{v}")).alias(f"cum_{v}") for v in values])
    )


def value_ranks(df: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """Distinct non-null values with the ranks they hold.

    Returns (value, n, cum_n), the number of non-null rows and of distinct values.
    """
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    )
    ranked = stage(running_totals(counted, "value", ["n"]))  # looked up more than once
    size = ranked.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct")).first()
    return ranked, size["rows"] or 0, size["distinct"]


def lookup_ranks(
    df: DataFrame, rank: str, ranked: DataFrame, rows: int, distinct: int, prefix: str = "_"
) -> DataFrame:
    """Add to each row the value that holds its 1-based rank; a null rank finds nothing.

    Every column of ``ranked`` arrives under ``prefix``.  The rank axis is cut into
    equal blocks; a value is listed once per block it reaches into, so the match is
    an equi-join on the block, however the mass is spread over values.
    """
    blocks = max(1024, distinct // 64)
    width = max(1, -(-rows // blocks))

    def block(position):
        return F.floor((position - 1) / F.lit(width)).cast("long")

    first, last = F.col("cum_n") - F.col("n") + 1, F.col("cum_n")
    found = [f"{prefix}{c}" for c in ranked.columns]
    listed = ranked.select(
        *[F.col(c).alias(f"{prefix}{c}") for c in ranked.columns],
        F.explode(F.sequence(block(first), block(last))).alias("_value_block"),
    )
    upto, size = F.col(f"{prefix}cum_n"), F.col(f"{prefix}n")
    on = (
        (block(F.col(rank)) == F.col("_value_block"))
        & (F.col(rank) <= upto) & (F.col(rank) > upto - size)
    )
    # rows without a rank stay out of the shuffle: their keys would all be null
    asked = df.where(F.col(rank).isNotNull()).join(listed, on, "left").drop("_value_block")
    types = {f.name: f.dataType for f in asked.schema}
    others = df.where(F.col(rank).isNull()).select(
        *df.columns, *[F.lit(None).cast(types[c]).alias(c) for c in found]
    )
    return asked.select(*df.columns, *found).unionByName(others)
