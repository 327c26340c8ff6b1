"""Typing, recoding, row repair and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import number
from ..functions.tables import report


def split_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the other columns, in table order."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def split_types_table(df: DataFrame) -> DataFrame:
    numeric, other = split_types(df)
    rows = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in other]
    return report(df.sparkSession, rows, "variable string, kind string")


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Return df unchanged, or fail naming every absent column."""
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def cast_columns(df: DataFrame, columns: Iterable[str], to: str = "string") -> DataFrame:
    """Cast the listed columns; absent names are skipped."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).cast(to) for c in present}) if present else df


def recode_to_null(df: DataFrame, codes: dict[str, object]) -> DataFrame:
    """Replace one invalid code or numeric sentinel per column by null."""
    present = {c: v for c, v in codes.items() if c in df.columns}
    return df.withColumns(
        {c: F.when(F.col(c) != F.lit(v), F.col(c)) for c, v in present.items()}
    ) if present else df


def count_sentinels(df: DataFrame, codes: dict[str, object]) -> DataFrame:
    present = {c: v for c, v in codes.items() if c in df.columns}
    row = df.agg(*[F.count_if(F.col(c) == F.lit(v)).alias(c) for c, v in present.items()]).first()
    rows = [(c, str(v), row[c]) for c, v in present.items()]
    return report(df.sparkSession, rows, "variable string, code string, n long")


def drop_null_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def complete_cases(df: DataFrame, target: str, columns: Iterable[str]) -> DataFrame:
    """Rows where the target and every model column are present."""
    return df.dropna(subset=[target, *columns])


def fill_null_constant(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    present = {c: v for c, v in labels.items() if c in df.columns}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in present.items()}
    ) if present else df


def fill_null_median(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Null numeric values become the exact median of the column's other values."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    numbers = df.select(*[number(df, c).alias(c) for c in columns])
    medians = exact_quantiles(numbers, {c: [0.5] for c in columns}).get((), {})
    fills = {c: q[0.5] for c, q in medians.items() if q[0.5] is not None}
    return df.withColumns({c: F.coalesce(number(df, c), F.lit(v)) for c, v in fills.items()})


def binarize_by_quantile(df: DataFrame, column: str, p: float = 0.75, out: str | None = None) -> DataFrame:
    """Two-level category ``<=cut`` / ``>cut`` at a quantile; null stays null.

    The labels carry the computed cut, in the shortest text that keeps 6 digits.
    """
    out = out or f"{column}_cat"
    x = number(df, column)
    cut = exact_quantiles(df.select(x.alias("x")), {"x": [p]})[()]["x"][p]
    if cut is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    label = f"{cut:g}"
    return df.withColumn(
        out, F.when(x <= cut, f"<={label}").when(x > cut, f">{label}")
    )


def drop_columns_if_present(df: DataFrame, target: str, drop: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Remove ids, other targets and raw variants; returns the names removed."""
    require_columns(df, [target])
    dropped = [c for c in drop if c in df.columns]
    if target in dropped:
        raise ValueError(f"target {target} is listed among the columns to drop")
    return df.drop(*dropped), dropped


def to_numeric_coerce(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Unparsable text becomes null, everything else double."""
    return df.withColumns({c: number(df, c) for c in columns})


def to_binary_target(df: DataFrame, column: str) -> DataFrame:
    """Strict 0/1 integer target: any other value fails the job."""
    text = F.trim(F.col(column).cast("string"))
    value = F.expr(f"try_cast(try_cast(trim(cast(`{column}` AS string)) AS double) AS int)")
    bad = F.concat(F.lit(f"{column} must be 0 or 1, found: "), F.coalesce(text, F.lit("null")))
    ok = value.isin(0, 1) & (F.expr(f"try_cast(trim(cast(`{column}` AS string)) AS double)") == value)
    return df.withColumn(column, F.when(ok, value).otherwise(F.raise_error(bad).cast("int")))


def binary_lenient(df: DataFrame, column: str) -> Column:
    """Number behind a 0/1 column given as number or text; null when not a number."""
    return number(df, column)


def normalize_binary_lenient(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, binary_lenient(df, column))


def constant_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns with a single distinct value; null counts as a value of its own."""
    columns = list(columns)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), F.count(c).alias(f"n{i}")]
    row = df.agg(*aggs, F.count("*").alias("rows")).first()
    return [
        c for i, c in enumerate(columns)
        if row[f"n{i}"] == 0 or (row[f"l{i}"] == row[f"h{i}"] and row[f"n{i}"] == row["rows"])
    ]


def drop_constant_columns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, df.columns if columns is None else columns))


def align_on_row_id(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Put two separately held column sets side by side by row key."""
    return left.join(right, key, "inner")


def select_rows_by_id(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(*key), key, "left_semi")


def lookup_by_name(records: DataFrame, name: str, column: str = "model") -> DataFrame:
    """The metadata records of one named model; fails when there is none."""
    found = records.where(F.col(column) == F.lit(name))
    if found.isEmpty():
        raise KeyError(f"no record with {column} = {name}")
    return found


def lookup_winner(records: DataFrame, winner: DataFrame, column: str = "model") -> DataFrame:
    return records.join(winner.select(column), column, "left_semi")


def union_scores(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack score frames by column name."""
    frames = list(frames)
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    return result
