"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIFORM_HEX_DIGITS = 13  # 52 bits, so every draw is an exact double


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def nulls_from_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, so one missing-value rule holds."""
    fields = [f.name for f in df.schema if is_float(f.dataType)]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in fields}) if fields else df


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as NULL; text is parsed leniently."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return nan_to_null(F.expr(f"try_cast(trim(`{name}`) AS double)"))
    col = F.col(name).cast("double")
    return nan_to_null(col) if is_float(dtype) else col


def portable_uniform(key: str | Column, seed: int | str) -> Column:
    """Uniform draw in [0, 1) that depends on seed and row key only.

    The draw does not change with partitioning, retries or engine, so splits,
    folds and random imputation can be repeated and checked elsewhere.  Each use puts
    its own word in the seed: equal draws would tie folds to the split.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    bits = F.conv(F.substring(digest, 1, UNIFORM_HEX_DIGITS), 16, 10).cast("double")
    return bits / F.lit(float(16**UNIFORM_HEX_DIGITS))


def clip_upper(col: Column, limit: float) -> Column:
    """Upper clip that keeps nulls (``least`` would turn them into the limit)."""
    return F.when(col > F.lit(limit), F.lit(limit)).otherwise(col)


def significance_code(p: Column) -> Column:
    # The usual star marks of regression tables.
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
        .when(p < 0.1, ".").otherwise("")
    )


def interval_index(col: Column, bounds: list, inclusive: bool = True) -> Column:
    """How many of the ascending ``bounds`` are <= col (or < col).

    Written as a balanced CASE tree: log2(len) comparisons per row, no join.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        passed = col >= F.lit(bounds[mid]) if inclusive else col > F.lit(bounds[mid])
        return F.when(passed, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(col.isNotNull(), tree(0, len(bounds)))


def logistic(xb: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-xb))
