"""Descriptive profiles: one aggregate pass per report, whatever the column count."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import summed_arrays
from ..functions.cumulative import running_totals
from ..functions.quantiles import exact_quantiles
from ..functions.scalars import is_float, number, nulls_from_nan
from ..functions.staging import stage
from ..functions.tables import report
from .schema import split_types

STATS = {
    "n": F.count, "missing": lambda c: F.count_if(F.col(c).isNull()), "mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop,
    "min": F.min, "max": F.max, "skew": F.skewness, "kurtosis": F.kurtosis,
}
APPROX_ACCURACY = 10_000
DISTINCT_SCREEN = 1_000
EXACT_ROWS = 1 << 23  # counts up to here are exact in single precision
JOINT_BLOCK = 256  # rows of the joint null matrix that are shuffled together


def adjusted_skew(n: int, g1: float | None) -> float | None:
    """Sample-size corrected skewness from the population form."""
    if g1 is None or n < 3 or math.isnan(g1):
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurtosis(n: int, g2: float | None) -> float | None:
    """Sample-size corrected excess kurtosis from the population excess."""
    if g2 is None or n < 4 or math.isnan(g2):
        return None
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def numeric_view(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    return df.select(*keep, *[number(df, c).alias(c) for c in columns])


def moments_of(numbers: DataFrame, columns: list[str], names: Iterable[str] = STATS) -> dict[str, dict]:
    """Requested statistics of every column from one aggregate job."""
    names = list(names)
    aggs = [STATS[s](c).alias(f"{s}_{i}") for i, c in enumerate(columns) for s in names]
    row = numbers.agg(*aggs).first()
    result = {c: {s: row[f"{s}_{i}"] for s in names} for i, c in enumerate(columns)}
    for r in result.values():
        if "skew" in r:
            r["skew"] = adjusted_skew(r["n"], r["skew"])
        if "kurtosis" in r:
            r["kurtosis"] = adjusted_kurtosis(r["n"], r["kurtosis"])
    return result


def column_quantiles(numbers: DataFrame, wanted: dict[str, list[float]], method: str):
    """Quantiles of many columns, exact or from Spark's mergeable sketch."""
    if method == "exact":
        return exact_quantiles(numbers, wanted).get((), {})
    row = numbers.agg(
        *[F.percentile_approx(c, ps, APPROX_ACCURACY).alias(f"q{i}") for i, (c, ps) in enumerate(wanted.items())]
    ).first()
    return {
        c: dict(zip(ps, row[f"q{i}"] or [None] * len(ps))) for i, (c, ps) in enumerate(wanted.items())
    }


def describe_numeric(df: DataFrame, columns: Iterable[str] | None = None, quantile: str = "exact") -> DataFrame:
    """Count, mean, std, min, quartiles, max, adjusted skewness and excess kurtosis."""
    columns = list(columns) if columns is not None else split_types(df)[0]
    numbers = numeric_view(df, columns)
    stats = moments_of(numbers, columns, ["n", "mean", "std", "min", "max", "skew", "kurtosis"])
    ps = [0.25, 0.5, 0.75]
    qs = column_quantiles(numbers, {c: ps for c in columns}, quantile)
    rows = [
        (c, s["n"], s["mean"], s["std"], s["min"], *[qs[c][p] for p in ps], s["max"], s["skew"], s["kurtosis"])
        for c, s in stats.items()
    ]
    return report(
        df.sparkSession, rows,
        "variable string, n long, mean double, std double, min double, q25 double, q50 double, "
        "q75 double, max double, skew double, kurtosis double",
    )


TARGET_QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def target_profile(df: DataFrame, column: str) -> DataFrame:
    """Profile of a candidate continuous target; text is parsed leniently."""
    numbers = numeric_view(df, [column])
    s = moments_of(numbers, [column], ["n", "missing", "mean", "std", "min", "max", "skew", "kurtosis"])[column]
    q = column_quantiles(numbers, {column: TARGET_QUANTILES}, "exact")[column]
    row = (
        column, s["n"], s["missing"], s["mean"], s["std"], s["min"], s["max"], s["skew"], s["kurtosis"],
        *[q[p] for p in TARGET_QUANTILES],
    )
    return report(
        df.sparkSession, [row],
        "variable string, n long, missing long, mean double, std double, min double, max double, "
        "skew double, kurtosis double, q01 double, q05 double, q25 double, q50 double, q75 double, "
        "q95 double, q99 double",
    )


def binary_profile(df: DataFrame, column: str) -> DataFrame:
    """Valid and missing counts and class shares of a candidate binary target."""
    x = number(df, column)
    return df.agg(
        F.lit(column).alias("variable"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("missing"),
        F.avg((x == 1).cast("int")).alias("p1"), F.avg((x == 0).cast("int")).alias("p0"),
    )


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], columns, "variable", "value")


def frequency_table(df: DataFrame, columns: Iterable[str] | None = None, include_null: bool = True) -> DataFrame:
    """Value counts of all listed columns in one grouped job."""
    columns = list(columns) if columns is not None else split_types(df)[1]
    long = _long(nulls_from_nan(df), columns)
    if not include_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("variable", "value").agg(F.count("*").alias("n"))


def frequency_table_pct(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Counts and shares of the non-null values per column."""
    columns = list(columns) if columns is not None else split_types(df)[1]
    df = nulls_from_nan(df)
    totals = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    total = F.create_map(*[F.lit(x) for c in columns for x in (c, totals[c])])
    counts = frequency_table(df, columns, include_null=False)
    return counts.withColumn("pct", F.col("n") / total[F.col("variable")])


def frequency_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The same for chosen numeric columns; absent names give no rows."""
    present = [c for c in columns if c in df.columns]
    return frequency_table_pct(df, present)


def _one_value(df: DataFrame, column: str, place: int) -> Column:
    """The column's number and its value, in the one of three fields that holds its type exactly."""
    kind, value = df.schema[column].dataType, F.col(column)
    slot = "i" if isinstance(kind, T.IntegralType) else "d" if is_float(kind) else "s"
    cast = {"i": value.cast("long"), "d": value.cast("double"), "s": value.cast("string")}
    empty = {"i": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}
    return F.struct(F.lit(place).alias("c"), *[(cast if k == slot else empty)[k].alias(k) for k in empty])


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct values per numeric column, null counting as one value.

    Exact counts come from one shuffle of narrow (column, value) rows, of which each task
    sends a value once; a null is a value like the others.
    """
    columns = list(columns) if columns is not None else split_types(df)[0]
    numbers = nulls_from_nan(df.select(*columns))
    schema = "variable string, distinct_values long"
    if approx:
        aggs = [(F.approx_count_distinct(F.col(c)) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).alias(c) for c in columns]
        row = numbers.agg(*aggs).first() if columns else {}
        return report(df.sparkSession, [(c, row[c]) for c in columns], schema)
    found = {}
    if columns:
        values = numbers.select(F.inline(F.array(*[_one_value(numbers, c, i) for i, c in enumerate(columns)])))
        counted = values.groupBy("c", "i", "d", "s").agg(F.lit(1).alias("_one")).groupBy("c").count()
        found = {r["c"]: r["count"] for r in counted.collect()}  # one row per column
    return report(df.sparkSession, [(c, found.get(i, 0)) for i, c in enumerate(columns)], schema)


def null_counts(df: DataFrame) -> tuple[dict[str, int], int]:
    df = nulls_from_nan(df)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count("*").alias("__rows")).first()
    return {c: row[c] for c in df.columns}, row["__rows"]


def null_report(df: DataFrame) -> DataFrame:
    """Nulls and their percentage (3 decimals) per column, most first."""
    nulls, rows = null_counts(df)
    table = report(
        df.sparkSession, [(c, n, n / rows * 100 if rows else None) for c, n in nulls.items()],
        "variable string, nulls long, pct double",
    )
    return table.withColumn("pct", F.bround("pct", 3)).orderBy(F.desc("nulls"), "variable")


def nulls_per_row(df: DataFrame, out: str = "nulls") -> DataFrame:
    clean = nulls_from_nan(df)
    total = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return clean.withColumn(out, total)


def null_histogram(df: DataFrame) -> DataFrame:
    """How many rows have 0, 1, 2, ... nulls."""
    return nulls_per_row(df, "nulls").groupBy("nulls").agg(F.count("*").alias("n"))


def _joint_nulls(width: int):
    """Arrow batches of null flags in, the task's counts of joint nulls out, a block of rows of the matrix at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = np.zeros((width, width), np.int64)
        for batch in batches:
            flags = np.asarray(batch.column(0).flatten()).reshape(-1, width)
            some = np.flatnonzero(flags.any(axis=0))  # only columns with a null here
            for at in range(0, len(flags), EXACT_ROWS):
                part = flags[at : at + EXACT_ROWS, some].astype(np.float32)
                joint[np.ix_(some, some)] += (part.T @ part).astype(np.int64)
        for block, at in enumerate(range(0, width, JOINT_BLOCK)):
            counts = joint[at : at + JOINT_BLOCK].ravel()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts], pa.list_(pa.int64()))], ["block", "joint"])

    return run


def null_correlation(df: DataFrame) -> DataFrame:
    """Lower triangle of the correlations between null indicators.

    Only columns with nulls take part.  Joint null counts are integers, so the
    correlations are exact; a column that is always null has none.  One scan: rows are
    reduced to null flags, a bit each, whose joint counts are a matrix product per batch, so
    the plan does not grow with the pairs of columns.
    """
    clean = nulls_from_nan(df)
    flags = F.array(F.lit(True), *[F.col(c).isNull() for c in df.columns])  # the first counts rows
    width = len(df.columns) + 1
    parts = clean.select(flags.alias("flags")).mapInArrow(_joint_nulls(width), "block int, joint array<long>")
    blocks = summed_arrays(parts, ["block"], "joint")
    empty = pa.table({"variable_a": pa.array([], pa.string()), "variable_b": pa.array([], pa.string()), "corr": pa.array([], pa.float64())})
    if not blocks:
        return df.sparkSession.createDataFrame(empty)
    joint = np.concatenate([blocks[key] for key in sorted(blocks)]).reshape(width, width)
    rows, nulls = int(joint[0, 0]), joint[0]
    names = np.array([None, *df.columns], object)
    tables = [empty]
    with_nulls = [i for i in range(1, width) if nulls[i]]
    for at, i in enumerate(with_nulls[1:], 1):
        others = with_nulls[:at]
        top = [rows * int(joint[i, j]) - int(nulls[i]) * int(nulls[j]) for j in others]  # integers of any size
        spread = [math.sqrt(int(nulls[j]) * (rows - int(nulls[j]))) for j in (i, *others)]
        corr = [t / (spread[0] * s) if spread[0] * s else None for t, s in zip(top, spread[1:])]
        tables.append(pa.table({"variable_a": pa.array([names[i]] * at, pa.string()), "variable_b": pa.array(list(names[others]), pa.string()), "corr": pa.array(corr, pa.float64())}))
    return df.sparkSession.createDataFrame(pa.concat_tables(tables))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat another row in every column."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicates"),
    )


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per class, null included, in class order."""
    counted = stage(df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0]
    return counted.withColumn("pct", F.col("n") * 100.0 / F.lit(total)).orderBy("class")


def share_over_group(counts: DataFrame, by: list[str], n: str = "n", out: str = "share") -> DataFrame:
    """Share of each row's count within its group of a small count table."""
    return counts.withColumn(out, F.col(n) / F.sum(n).over(W.partitionBy(*by)))


def cumulative_frequency(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with their share and cumulative share."""
    x = number(df, column)
    counted = df.where(x.isNotNull()).groupBy(x.alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(x)).first()[0]
    return running_totals(counted, "value", ["n"]).select(
        "value", "n", "cum_n", (F.col("cum_n") / F.lit(total)).alias("cum_share")
    )


ISSUE_SCHEMA = "variable string, issue string, n long, rate double"


def continuous_issues(df: DataFrame, column: str) -> DataFrame:
    """Warnings about a continuous target: discreteness, range, extremes, missing values."""
    numbers = numeric_view(df, [column])
    x = F.col(column)
    row = numbers.agg(
        F.count("*").alias("rows"), F.count(x).alias("n"), F.approx_count_distinct(x).alias("distinct"),
        F.count_if(x < 0).alias("below"), F.count_if(x > 100).alias("above"),
    ).first()
    rows, n = row["rows"], row["n"]
    if n == 0:
        return report(df.sparkSession, [(column, "no_valid_values", 0, None)], ISSUE_SCHEMA)
    issues = []
    if row["distinct"] <= DISTINCT_SCREEN:  # far above 5 the sketch alone decides
        distinct = numbers.agg(F.count_distinct(x)).first()[0]
        if distinct <= 5:
            issues.append((column, "few_distinct_values", distinct, None))
    if row["below"]:
        issues.append((column, "below_zero", row["below"], row["below"] / n))
    if row["above"]:
        issues.append((column, "above_hundred", row["above"], row["above"] / n))
    q = column_quantiles(numbers, {column: [0.25, 0.75]}, "exact")[column]
    spread = 3 * (q[0.75] - q[0.25])
    if spread > 0:
        extreme = numbers.agg(F.count_if((x < q[0.25] - spread) | (x > q[0.75] + spread))).first()[0]
        if extreme / n > 0.02:
            issues.append((column, "extreme_outliers", extreme, extreme / n))
    if (rows - n) / rows > 0.10:
        issues.append((column, "high_missing_rate", rows - n, (rows - n) / rows))
    return report(df.sparkSession, issues, ISSUE_SCHEMA)


def binary_issues(df: DataFrame, column: str) -> DataFrame:
    """Warnings about a binary target: values outside 0/1, imbalance, missing values."""
    x = number(df, column)
    row = df.agg(
        F.count("*").alias("rows"), F.count(x).alias("n"),
        F.count_if(x == 0).alias("zeros"), F.count_if(x == 1).alias("ones"),
    ).first()
    rows, n, ones = row["rows"], row["n"], row["ones"]
    both = row["zeros"] + ones
    if n == 0:
        return report(df.sparkSession, [(column, "no_valid_values", 0, None)], ISSUE_SCHEMA)
    issues = []
    if both < n:
        issues.append((column, "outside_zero_one", n - both, (n - both) / n))
    if both == 0:
        issues.append((column, "no_binary_cases", 0, None))
    else:
        if not 0.15 <= ones / both <= 0.85:
            issues.append((column, "imbalance", ones, ones / both))
        if (rows - n) / rows > 0.10:
            issues.append((column, "high_missing_rate", rows - n, (rows - n) / rows))
    return report(df.sparkSession, issues, ISSUE_SCHEMA)
