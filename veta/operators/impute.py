"""Imputation of missing values and the ordered treatment recipe."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import lookup_ranks, value_ranks
from ..functions.scalars import number, portable_uniform
from .profile import column_quantiles, moments_of, numeric_view
from .schema import binarize_by_quantile, drop_null_rows, fill_null_constant, fill_null_median

ROUND_DIGITS = 4


def impute_numeric(df: DataFrame, column: str, method: str, key: str | None = None, seed: int = 123) -> DataFrame:
    """Fill null numbers with the ``mean``, the ``median`` or random observed values.

    ``random`` draws from the observed distribution; ``random_below`` uses the older
    rule that rescales the draw to (F(min), 1) and takes the largest value not above it.
    """
    x = number(df, column)
    if method in ("mean", "median"):
        numbers = numeric_view(df, [column])
        s = moments_of(numbers, [column], ["n", "mean"])[column]
        fill = s["mean"]
        if method == "median":
            fill = column_quantiles(numbers, {column: [0.5]}, "exact")[column][0.5]
        return df.withColumn(column, F.coalesce(x, F.bround(F.lit(fill).cast("double"), ROUND_DIGITS)))
    return _impute_random(df.withColumn(column, x), column, method, key, seed)


def impute_categorical(df: DataFrame, column: str, method: str, key: str | None = None, seed: int = 123) -> DataFrame:
    """Fill null categories with the most frequent one or with random observed ones."""
    if method == "mode":
        counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        top = counted.orderBy(F.desc("n"), column).limit(1).first()
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(top[0] if top else None)))
    return _impute_random(df, column, method, key, seed)


def impute_by_distribution(df: DataFrame, column: str, key: str, seed: int = 123) -> DataFrame:
    """Null categories drawn from the observed shares, repeatable by row key."""
    return impute_categorical(df, column, "random", key, seed)


def _impute_random(df: DataFrame, column: str, method: str, key: str | None, seed: int) -> DataFrame:
    if key is None:
        raise ValueError("random imputation needs the row key column")
    if method not in ("random", "random_below"):
        raise ValueError(f"unknown imputation method {method!r}")
    ranked, rows, distinct = value_ranks(df, column)
    if rows == 0:
        return df
    u = portable_uniform(key, f"impute-{column}-{seed}")
    missing = F.col(column).isNull()
    if method == "random":
        rank = F.greatest(F.ceil(u * F.lit(rows)), F.lit(1))
        drawn = lookup_ranks(df.withColumn("_rank", F.when(missing, rank)), "_rank", ranked, rows, distinct)
        value = F.col("_value")
    else:
        ranked = _with_lower_value(ranked, rows, distinct)
        lowest = ranked.orderBy("value").limit(1).first()["n"]
        least = F.lit(lowest / rows)
        reached = F.floor((least + u * (F.lit(1.0) - least)) * F.lit(rows))
        rank = F.greatest(reached, F.lit(lowest))
        drawn = lookup_ranks(df.withColumn("_rank", F.when(missing, rank)), "_rank", ranked, rows, distinct)
        value = F.when(F.col("_cum_n") == F.col("_rank"), F.col("_value")).otherwise(F.col("_lower"))
    if dict(df.dtypes)[column] == "double":
        value = F.bround(value, ROUND_DIGITS)
    return drawn.withColumn(column, F.coalesce(F.col(column), value)).select(*df.columns)


def _with_lower_value(ranked: DataFrame, rows: int, distinct: int) -> DataFrame:
    """Add the next lower distinct value to each value."""
    below = F.col("cum_n") - F.col("n")
    asked = ranked.withColumn("_below", F.when(below > 0, below))
    found = lookup_ranks(asked, "_below", ranked, rows, distinct, "_low_")
    return found.select("value", "n", "cum_n", F.col("_low_value").alias("lower"))


@dataclass(frozen=True)
class TreatmentRecipe:
    """Which columns get which treatment; steps run in the order of the fields."""

    drop_rows: list[str] = field(default_factory=list)
    unknown_label: dict[str, str] = field(default_factory=dict)
    median: list[str] = field(default_factory=list)
    binarize: dict[str, float] = field(default_factory=dict)
    draw: list[str] = field(default_factory=list)
    seed: int = 123


def treat_missing(df: DataFrame, recipe: TreatmentRecipe, key: str) -> DataFrame:
    """Drop rows, label unknowns, fill medians, binarize, then draw categories.

    Every statistic is taken after the rows were dropped.
    """
    present = [c for c in recipe.drop_rows if c in df.columns]
    if present:
        df = drop_null_rows(df, present)
    df = fill_null_constant(df, recipe.unknown_label)
    df = fill_null_median(df, recipe.median)
    for c, p in recipe.binarize.items():
        if c in df.columns:
            df = binarize_by_quantile(df, c, p)
    for c in recipe.draw:
        if c in df.columns:
            df = impute_by_distribution(df, c, key, recipe.seed)
    return df
