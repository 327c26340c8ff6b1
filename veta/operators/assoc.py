"""Quantile binning, contingency tables and Cramer's V."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import interval_index, number, nulls_from_nan
from ..functions.staging import stage
from ..functions.tables import report
from .profile import numeric_view
from .schema import split_types

QUINTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def quintile_edges(df: DataFrame, columns: Iterable[str], probabilities: list[float] | None = None):
    """Ascending distinct quantile edges per numeric column."""
    columns = list(columns)
    ps = probabilities or QUINTILES
    qs = exact_quantiles(numeric_view(df, columns), {c: ps for c in columns}).get((), {})
    return {c: sorted({v for v in qs[c].values() if v is not None}) for c in columns}


def _above_minimum(df: DataFrame, edges: dict[str, list[float]]) -> dict[str, tuple[float | None, bool]]:
    """Second smallest value of each column, and whether it is also the largest."""
    aggs = []
    for i, (c, e) in enumerate(edges.items()):
        x = number(df, c)
        low, high = (e[0], e[-1]) if e else (0.0, 0.0)
        aggs.append(F.min(F.when(x > low, x)).alias(f"m{i}"))
        aggs.append(F.count_if((x > low) & (x < high)).alias(f"k{i}"))
    row = df.agg(*aggs).first() if aggs else {}
    return {c: (row[f"m{i}"], row[f"k{i}"] == 0) for i, c in enumerate(edges)}


def bin_expression(x: Column, edges: list[float], second: float | None) -> Column | None:
    """Right-closed bin number 1..k; the minimum and null join the lowest filled bin."""
    if second is None or len(edges) < 2:
        return None
    inner = edges[1:-1]
    lowest = 1 + sum(1 for b in inner if second > b)
    return (
        F.when(x > edges[0], interval_index(x, inner, inclusive=False) + 1).otherwise(F.lit(lowest))
    ).cast("int")


def bin_quintiles(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Add ``{column}_bin``, the quintile bin number of each numeric column."""
    columns = list(columns)
    edges = quintile_edges(df, columns)
    above = _above_minimum(df, edges)
    added = {}
    for c in columns:
        b = bin_expression(number(df, c), edges[c], above[c][0])
        added[f"{c}_bin"] = F.lit(None).cast("int") if b is None else b
    return df.withColumns(added)


def level_columns(df: DataFrame, columns: Iterable[str], edges: dict[str, list[float]] | None = None) -> dict[str, Column]:
    """Text level of each column: numbers binned, two-valued numbers and text as they are.

    ``edges`` holds quantile edges that are known already.
    """
    columns, edges = list(columns), dict(edges or {})
    numbers = set(split_types(df)[0])
    numeric = [c for c in columns if c in numbers]
    searched = [c for c in numeric if c not in edges]
    edges |= quintile_edges(df, searched) if searched else {}
    edges = {c: edges[c] for c in numeric}
    above = _above_minimum(df, edges)
    levels = {}
    for c in columns:
        if c not in numeric:
            levels[c] = F.col(c).cast("string")
            continue
        second, two_valued = above[c]
        b = bin_expression(number(df, c), edges[c], second)
        if b is None:
            levels[c] = F.lit("1")  # constant column: one level
        elif two_valued:
            levels[c] = number(df, c).cast("string")
        else:
            levels[c] = b.cast("string")
    return levels


def contingency_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two columns' levels, in long form."""
    levels = level_columns(df, [a, b])
    cells = df.select(levels[a].alias("level_a"), levels[b].alias("level_b")).dropna()
    return cells.groupBy("level_a", "level_b").agg(F.count("*").alias("n"))


def row_normalized_crosstab(df: DataFrame, a: str, target: str) -> DataFrame:
    """Class counts and class shares within each category."""
    cells = (
        df.where(F.col(a).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(a).alias("category"), F.col(target).alias("class")).agg(F.count("*").alias("n"))
    )
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("category")))


def cramers_v_cells(cells: DataFrame) -> DataFrame:
    """Cramer's V per variable from cells (variable, level, target_level, n).

    Empty cells need no rows: the sum over O^2/(R C) of the filled ones gives
    chi-square.  A 2 x 2 table gets the continuity correction; a one-row or
    one-column table has no value.
    """
    cells = stage(cells)
    row = cells.groupBy("variable", "level").agg(F.sum("n").alias("r"))
    col = cells.groupBy("variable", "target_level").agg(F.sum("n").alias("c"))
    joined = cells.join(row, ["variable", "level"]).join(col, ["variable", "target_level"])
    o, r, c = (F.col(x).cast("double") for x in ("n", "r", "c"))
    sums = joined.groupBy("variable").agg(
        F.sum("n").cast("double").alias("total"),
        F.sum(o * o / (r * c)).alias("s"),
        F.sum(o / r).alias("n_rows"), F.sum(o / c).alias("n_cols"),
        F.sum(o / (r * r)).alias("inv_r"), F.sum(o / (c * c)).alias("inv_c"),
    )
    n, s = F.col("total"), F.col("s")
    n_rows, n_cols = F.round("n_rows").cast("int"), F.round("n_cols").cast("int")
    chi2 = F.greatest(n * (s - 1), F.lit(0.0))
    base = n * F.col("inv_r") * F.col("inv_c")
    distance = F.greatest(F.sqrt(chi2 / base) - 0.5, F.lit(0.0))
    corrected = F.when((n_rows == 2) & (n_cols == 2), distance * distance * base).otherwise(chi2)
    smaller = F.least(n_rows, n_cols)
    return sums.select(
        "variable", n_rows.alias("n_rows"), n_cols.alias("n_cols"), F.col("total").cast("long").alias("n"),
        F.when(smaller > 1, corrected).alias("chi2"),
        F.when(smaller > 1, F.sqrt(corrected / (n * (smaller - 1)))).alias("cramers_v"),
    )


def cramers_v_ranking(
    df: DataFrame, columns: Iterable[str], target: str, edges: dict[str, list[float]] | None = None
) -> DataFrame:
    """Cramer's V of every column with the target, all from one grouped job."""
    columns = list(columns)
    df = nulls_from_nan(df.select(*columns, target))
    levels = level_columns(df, [*columns, target], edges)
    wide = df.select(
        levels[target].alias("target_level"), *[levels[c].alias(f"_{c}") for c in columns]
    )
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"_{c}").alias("level")) for c in columns
    ])).alias("p")
    cells = (
        wide.select("target_level", pairs).select("p.variable", "p.level", "target_level").dropna()
        .groupBy("variable", "level", "target_level").agg(F.count("*").alias("n"))
    )
    return cramers_v_cells(cells).orderBy(F.desc_nulls_last("cramers_v"), "variable")


def cramers_v(df: DataFrame, column: str, target: str) -> DataFrame:
    return cramers_v_ranking(df, [column], target)


def correlation(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Pearson correlations of the listed pairs from one aggregate."""
    pairs = list(pairs)
    row = df.agg(
        *[F.corr(number(df, a), number(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    ).first()
    rows = [(a, b, row[f"r{i}"]) for i, (a, b) in enumerate(pairs)]
    return report(df.sparkSession, rows, "variable_a string, variable_b string, corr double")


def correlation_matrix(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    return correlation(df, [(a, b) for i, a in enumerate(columns) for b in columns[:i]])
