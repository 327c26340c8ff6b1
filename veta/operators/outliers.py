"""Outlier flags, summaries, winsorizing and robust removal."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import clip_upper, number
from ..functions.tables import report
from .profile import column_quantiles, moments_of, numeric_view

NORMAL_QUARTILE = 0.6744897501960817  # fixed value: 75 % point of the standard normal
ZERO_MAD = 0.01
Z_LIMIT, ROBUST_LIMIT, WIDE_IQR = 3.0, 8.0, 3.0


def _outside(x: Column, q1: float | None, q3: float | None, k: float) -> Column:
    if q1 is None:
        return F.lit(False)
    return (x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1))


def _limits(numbers: DataFrame, columns: list[str]):
    stats = moments_of(numbers, columns, ["n", "mean", "std_pop"])
    return stats, column_quantiles(numbers, {c: [0.25, 0.75] for c in columns}, "exact")


def _zscore_flag(x: Column, mean: float | None, std: float | None, limit: float) -> Column:
    if not std:
        return F.lit(False)
    return F.abs((x - mean) / std) > limit


def outliers_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows whose value lies outside Q1 - k IQR ... Q3 + k IQR."""
    numbers = numeric_view(df, [column])
    q = exact_quantiles(numbers, {column: [0.25, 0.75]})[()][column]
    return df.where(_outside(number(df, column), q[0.25], q[0.75], k))


def outliers_zscore(df: DataFrame, column: str, limit: float = Z_LIMIT) -> DataFrame:
    """Rows with |z| over the limit, z with the population deviation."""
    s = moments_of(numeric_view(df, [column]), [column], ["mean", "std_pop"])[column]
    return df.where(_zscore_flag(number(df, column), s["mean"], s["std_pop"], limit))


def outlier_summary(df: DataFrame, columns: Iterable[str], k: float = 1.5, limit: float = Z_LIMIT) -> DataFrame:
    """Both outlier counts and percentages per column: limits first, then one count pass."""
    columns = [c for c in columns if c in df.columns]
    numbers = numeric_view(df, columns)
    stats, qs = _limits(numbers, columns)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c)
        aggs.append(F.count_if(_outside(x, qs[c][0.25], qs[c][0.75], k)).alias(f"i{i}"))
        aggs.append(F.count_if(_zscore_flag(x, stats[c]["mean"], stats[c]["std_pop"], limit)).alias(f"z{i}"))
    row = numbers.agg(*aggs).first()
    rows = []
    for i, c in enumerate(columns):
        n, a, b = stats[c]["n"], row[f"i{i}"], row[f"z{i}"]
        rows.append((c, n, a, b, a / n * 100 if n else None, b / n * 100 if n else None))
    return report(
        df.sparkSession, rows,
        "variable string, n long, outliers_iqr long, outliers_zscore long, pct_iqr double, pct_zscore double",
    ).orderBy(F.desc("outliers_iqr"), F.desc("outliers_zscore"), "variable")


def winsorize_upper(
    df: DataFrame, column: str, p: float = 0.99, sentinel: float | None = None, out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sentinel to null, then a copy clipped at an upper quantile; and a summary row."""
    out = out or f"{column}_win"
    raw = number(df, column)
    value = raw if sentinel is None else F.when(raw != F.lit(float(sentinel)), raw)
    limit = exact_quantiles(df.select(value.alias("x")), {"x": [p]})[()]["x"][p]
    sentinels = F.lit(0) if sentinel is None else F.count_if(raw == F.lit(float(sentinel)))
    clipped = F.lit(0) if limit is None else F.count_if(value > limit)
    row = df.agg(sentinels.alias("sentinels"), clipped.alias("clipped")).first()
    treated = df.withColumns(
        {column: value, out: value if limit is None else clip_upper(value, limit)}
    )
    summary = report(
        df.sparkSession, [(column, p, limit, row["sentinels"], row["clipped"])],
        "variable string, p double, upper_limit double, sentinels long, clipped long",
    )
    return treated, summary


def outliers_to_null(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Null values that are outliers by two rules at once; and the count per column.

    Rule one: |z| > 3 where |skew| < 1, otherwise the distance from the median over
    8 scaled median absolute deviations.  Rule two: outside the quartiles by 3 IQR.
    """
    columns = list(columns)
    numbers = numeric_view(df, columns)
    stats = moments_of(numbers, columns, ["n", "mean", "std", "skew"])
    qs = column_quantiles(numbers, {c: [0.25, 0.5, 0.75] for c in columns}, "exact")
    skewed = [c for c in columns if stats[c]["n"] and not abs(stats[c]["skew"] or 0.0) < 1]
    away = numbers.select(*[F.abs(F.col(c) - qs[c][0.5]).alias(c) for c in skewed])
    mads = column_quantiles(away, {c: [0.5] for c in skewed}, "exact") if skewed else {}
    flags = {}
    for c in columns:
        x = number(df, c)
        s, q = stats[c], qs[c]
        if c in skewed:
            mad = mads[c][0.5] / NORMAL_QUARTILE or ZERO_MAD
            first = F.abs((x - q[0.5]) / mad) > ROBUST_LIMIT
        else:
            first = _zscore_flag(x, s["mean"], s["std"], Z_LIMIT)
        flags[c] = first & _outside(x, q[0.25], q[0.75], WIDE_IQR)
    row = df.agg(*[F.count_if(f).alias(c) for c, f in flags.items()]).first()
    treated = df.withColumns({c: F.when(~F.coalesce(f, F.lit(False)), number(df, c)) for c, f in flags.items()})
    return treated, report(df.sparkSession, [(c, row[c]) for c in columns], "variable string, outliers long")
