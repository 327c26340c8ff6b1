"""Linear regression from a moment matrix: fit, summary, prediction, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.scalars import number
from ..functions.tables import report
from .design import DesignSpec, ModelSpec
from .moments import Moments, moments, solve


@dataclass(frozen=True)
class OlsFit:
    design: DesignSpec
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    rank: int
    sse: float
    sst: float
    condition: float
    centre: tuple[np.ndarray, np.ndarray]  # shift and scale of the design columns

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(["const", *self.names], map(float, self.coef)))

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    @property
    def r2(self) -> float:
        return 1 - self.sse / self.sst if self.sst else float("nan")

    @property
    def llf(self) -> float:
        return log_likelihood(self.n, self.sse)

    def criterion(self, name: str) -> float:
        return information_criterion(name, self.llf, self.rank, self.n)

    def predictor(self, df: DataFrame) -> Column:
        return self.design.linear_predictor(df, self.coefficients)

    def coefficients_table(self, spark: SparkSession) -> DataFrame:
        width = dist.t_quantile(0.975, self.df_resid)
        rows = []
        for i, name in enumerate(["const", *self.names]):
            b, se = float(self.coef[i]), math.sqrt(max(self.cov[i, i], 0.0))
            t = b / se if se else None
            p = dist.t_two_sided(t, self.df_resid) if se else None
            rows.append((name, b, se, t, p, b - width * se, b + width * se))
        return report(
            spark, rows,
            "variable string, coef double, std_err double, t double, p_value double, "
            "ci_low double, ci_high double",
        )

    def stats_table(self, spark: SparkSession) -> DataFrame:
        k, n, r2 = self.rank, self.n, self.r2
        f = (r2 / (k - 1)) / ((1 - r2) / (n - k)) if k > 1 and r2 < 1 else None
        p = dist.f_upper(f, k - 1, n - k) if f is not None else None
        row = (
            n, k, n - k, r2, 1 - (1 - r2) * (n - 1) / (n - k), f, p, self.llf,
            self.criterion("AIC"), self.criterion("BIC"), self.sse, self.condition,
        )
        return report(
            spark, [row],
            "n long, n_params int, df_resid long, r2 double, r2_adj double, f double, f_p_value double, "
            "log_lik double, aic double, bic double, sse double, condition double",
        )


def log_likelihood(n: int, sse: float) -> float:
    """Gaussian log-likelihood at the least-squares optimum."""
    return -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1) if sse > 0 else math.inf


def information_criterion(name: str, llf: float, k: int, n: int) -> float:
    weight = {"AIC": 2.0, "BIC": math.log(n)}[name.upper()]
    return weight * k - 2 * llf


def _restrict(design: DesignSpec, spec: ModelSpec) -> DesignSpec:
    return DesignSpec(spec, {c: v for c, v in design.levels.items() if c in spec.raw})


def ols(m: Moments, spec: ModelSpec | None = None, gram: np.ndarray | None = None) -> OlsFit:
    """Fit a sub-model from the moments; no further Spark job."""
    spec = m.design.spec if spec is None else spec
    gram = m.total() if gram is None else gram
    names = m.design.columns_of(spec)
    cols = m.positions(names)
    beta, inverse, sse, rank = solve(gram, cols, m.y)
    n = gram[0, 0]
    scale_y = m.scale[m.y - 1]
    at = np.array([c - 1 for c in cols[1:]], dtype=int)
    # back to raw units: slopes divided by the column scale, the intercept absorbs shifts
    back = np.diag(np.concatenate([[1.0], 1.0 / m.scale[at]]))
    back[0, 1:] = -m.shift[at] / m.scale[at]
    coef = back @ beta * scale_y
    coef[0] += m.shift[m.y - 1]
    sse = float(sse * scale_y**2)
    sst = float((gram[m.y, m.y] - gram[0, m.y] ** 2 / n) * scale_y**2)
    sigma2 = sse / (n - rank) if n > rank else float("nan")
    raw = m.raw_gram(gram)[np.ix_(cols, cols)]
    eigen = np.linalg.eigvalsh(raw)
    condition = math.sqrt(eigen[-1] / eigen[0]) if eigen[0] > 0 else math.inf
    cov = back @ inverse @ back.T * sigma2
    centre = (m.shift[at], m.scale[at])
    return OlsFit(_restrict(m.design, spec), names, coef, cov, round(n), rank, sse, sst, condition, centre)


def ols_fit(df: DataFrame, spec: ModelSpec, y: str) -> OlsFit:
    return ols(moments(df, DesignSpec.fit(df, spec), y))


def r2_on(m: Moments, spec: ModelSpec, train: np.ndarray, held: np.ndarray) -> float:
    """R2 on held rows of the model fitted on the training rows, from moments alone."""
    cols = m.positions(m.design.columns_of(spec))
    beta, _, _, _ = solve(train, cols, m.y)
    a, b = held[np.ix_(cols, cols)], held[cols, m.y]
    sse = held[m.y, m.y] - 2 * beta @ b + beta @ a @ beta
    sst = held[m.y, m.y] - held[0, m.y] ** 2 / held[0, 0]
    return float(1 - sse / sst) if sst > 0 else float("nan")


def ols_predict(df: DataFrame, fit: OlsFit, y: str | None = None) -> DataFrame:
    """Add ``fitted`` and, given the target, ``residual``; a sum of columns, no UDF."""
    scored = df.withColumn("fitted", fit.predictor(df))
    return scored if y is None else scored.withColumn("residual", number(df, y) - F.col("fitted"))


def r_squared(scored: DataFrame, y: str, fitted: str = "fitted", by: Iterable[str] = ()) -> DataFrame:
    """1 - SSE / SST with the mean of the evaluated rows."""
    e = F.col(y) - F.col(fitted)
    rows = scored.where(F.col(y).isNotNull() & F.col(fitted).isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2")
    )


def regression_errors(scored: DataFrame, y: str, fitted: str = "fitted", by: Iterable[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(fitted)
    return scored.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    )


def breusch_pagan(df: DataFrame, fit: OlsFit, y: str) -> DataFrame:
    """Regress the squared residuals on the same design."""
    e = number(df, y) - fit.predictor(df)
    mean = fit.sse / fit.n or 1.0  # of the squared residuals
    centre = (np.append(fit.centre[0], mean), np.append(fit.centre[1], mean))
    squared = fit.design.complete(df, y).withColumn("_e2", e * e)
    aux = ols(moments(squared, fit.design, "_e2", centre=centre))
    k, n, r2 = aux.rank, aux.n, aux.r2
    lm = n * r2
    f = (r2 / (k - 1)) / ((1 - r2) / (n - k))
    return report(
        df.sparkSession,
        [(n, lm, dist.chi2_upper(lm, k - 1), f, dist.f_upper(f, k - 1, n - k))],
        "n long, lm double, lm_p_value double, f double, f_p_value double",
    )


def _adjacent_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over one sorted value range: squared steps, squares, first and last value."""
    steps = squares = 0.0
    rows, first, last = 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        e = batch.column(0).to_numpy(zero_copy_only=False)
        if last is not None:
            steps += (e[0] - last) ** 2
        first = float(e[0]) if first is None else first
        steps += float(np.sum(np.diff(e) ** 2))
        squares += float(e @ e)
        rows, last = rows + len(e), float(e[-1])
    if rows:
        ordinal = pa.array([_partition_number()], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [ordinal, *[pa.array([v], pa.float64()) for v in (steps, squares, first, last)]],
            names=["part", "steps", "squares", "first", "last"],
        )


def _partition_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def durbin_watson(df: DataFrame, residual: str, key: Iterable[str]) -> DataFrame:
    """Squared steps between neighbours in key order over squared residuals.

    Rows are range-partitioned and sorted by key; each range is summed on its own
    and only its first and last residual are needed to join the ranges.
    """
    key = list(key)
    ordered = (
        df.where(F.col(residual).isNotNull()).select(F.col(residual).cast("double").alias("_e"), *key)
        .repartitionByRange(*key).sortWithinPartitions(*key).select("_e")
    )
    parts = ordered.mapInArrow(
        _adjacent_kernel, "part int, steps double, squares double, first double, last double"
    )
    # one row per range: the window below sees as many rows as there are partitions
    step = F.col("first") - F.lag("last").over(W.orderBy("part"))
    joined = parts.withColumn("border", F.coalesce(step * step, F.lit(0.0)))
    return joined.agg(((F.sum("steps") + F.sum("border")) / F.sum("squares")).alias("durbin_watson"))


def _skew_z(s: float, n: int) -> float:
    """Normal score of a sample skewness."""
    y = s * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    return math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))


def _kurtosis_z(k: float, n: int) -> float:
    """Normal score of a sample kurtosis (not excess)."""
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (k - mean) / math.sqrt(var)
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta * (2 / beta + math.sqrt(1 + 4 / beta**2))
    root = math.copysign(
        (abs((1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4))))) ** (1 / 3), 1 + x * math.sqrt(2 / (a - 4))
    )
    return (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))


def residual_normality(df: DataFrame, residual: str) -> DataFrame:
    """Skewness, kurtosis, Jarque-Bera and omnibus test from one aggregate."""
    row = df.agg(
        F.count(residual).alias("n"), F.skewness(residual).alias("s"), (F.kurtosis(residual) + 3).alias("k")
    ).first()
    n, s, k = row["n"], row["s"], row["k"]
    jb = n / 6 * (s * s + (k - 3) ** 2 / 4)
    omnibus = _skew_z(s, n) ** 2 + _kurtosis_z(k, n) ** 2 if n >= 8 else None
    return report(
        df.sparkSession,
        [(n, s, k, jb, dist.chi2_upper(jb, 2), omnibus, None if omnibus is None else dist.chi2_upper(omnibus, 2))],
        "n long, skew double, kurtosis double, jarque_bera double, jarque_bera_p double, "
        "omnibus double, omnibus_p double",
    )
