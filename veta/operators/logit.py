"""Logistic regression by batched Newton steps: many candidate models per data pass."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.arrays import summed_arrays
from ..functions.scalars import logistic, number, significance_code
from ..functions.staging import stage_columns
from ..functions.tables import report
from .design import DesignSpec, ModelSpec
from .moments import centre_and_scale
from .ols import _restrict

MAX_STEPS = 60
STEP_TOLERANCE = 1e-9
LAST_STEP = 1e-5  # after a step this small the next one would be below 1e-9


@dataclass
class Candidate:
    """One model of a batch: a set of design columns, and optionally a fold left out."""

    spec: ModelSpec
    left_out: int | None = None
    start: dict[str, float] | None = None


@dataclass(frozen=True)
class LogitFit:
    design: DesignSpec
    names: list[str]
    coef: np.ndarray
    information: np.ndarray  # X'VX without penalty, raw units, intercept first
    n: int
    log_lik: float
    converged: bool
    constant: list[str] = field(default_factory=list)

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(["const", *self.names], map(float, self.coef)))

    @property
    def n_params(self) -> int:
        return len(self.names) + 1

    def criterion(self, name: str, k: str = "true") -> float:
        return criterion(name, self.log_lik, self.n_params if k == "true" else 2, self.n)

    def predictor(self, df: DataFrame) -> Column:
        return self.design.linear_predictor(df, self.coefficients)

    def probability(self, df: DataFrame) -> Column:
        return logistic(self.predictor(df))

    def coefficients_table(self, spark: SparkSession) -> DataFrame:
        """One row per design column, the intercept repeated on each."""
        const = float(self.coef[0])
        rows = [(n, const, float(c)) for n, c in zip(self.names, self.coef[1:])]
        return report(spark, rows, "variable string, intercept double, coef double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """Wald table; constant columns are left out and the penalty is ignored."""
        kept = [i for i, n in enumerate(["const", *self.names]) if n not in self.constant]
        cov = np.linalg.pinv(self.information[np.ix_(kept, kept)])
        df = self.n - len(self.names)
        rows = []
        for at, i in enumerate(kept):
            se = math.sqrt(max(cov[at, at], 0.0))
            z = float(self.coef[i]) / se if se else None
            rows.append((
                "(Intercept)" if i == 0 else self.names[i - 1], float(self.coef[i]), se, z,
                dist.t_two_sided(z, df) if se else None,
            ))
        table = report(spark, rows, "variable string, estimate double, std_err double, z double, p_value double")
        return table.withColumn("signif", significance_code(F.col("p_value")))

    def goodness(self, spark: SparkSession, k: str = "true") -> DataFrame:
        row = (self.n, self.n_params, self.log_lik, self.criterion("AIC", k), self.criterion("BIC", k))
        return report(spark, [row], "n long, n_params int, log_lik double, aic double, bic double")


def criterion(name: str, log_lik: float, k: int, n: int) -> float:
    return {"AIC": 2.0, "BIC": math.log(n)}[name.upper()] * k - 2 * log_lik


@dataclass(frozen=True)
class LogitData:
    """Complete rows, staged once for the iterations: raw variables, categories as level numbers.

    The design is expanded batch by batch inside the tasks that read them.
    """

    design: DesignSpec
    names: list[str]
    rows: DataFrame
    shift: np.ndarray
    scale: np.ndarray
    n: int
    ones: int
    fold_rows: dict[int, tuple[int, int]]
    tasks: int  # that read the staged rows

    @property
    def constant(self) -> list[str]:
        """Columns without spread."""
        return [n for n, s in zip(self.names, self.scale) if s == 0]


    def probabilities(self, fits: Iterable[LogitFit]) -> DataFrame:
        """Staged rows as (fold, y, p0, p1, ...), scored without the raw table."""
        columns = self.design.from_codes(_coded(self.design))
        scores = []
        for f in fits:
            total = F.lit(float(f.coef[0]))
            for n, c in zip(f.names, f.coef[1:]):
                if c:
                    total = total + F.lit(float(c)) * columns[n]
            scores.append(logistic(total))
        return self.rows.select(
            F.col("_fold").alias("fold"), F.col("_y").alias("y"), *[p.alias(f"p{i}") for i, p in enumerate(scores)]
        )


def _coded(design: DesignSpec) -> dict[str, Column]:
    return {v: F.col(f"_r{i}") for i, v in enumerate(design.spec.raw)}


def logit_data(
    df: DataFrame, spec: ModelSpec, y: str, fold: str | None = None, design: DesignSpec | None = None
) -> LogitData:
    design = DesignSpec.fit(df, spec) if design is None else design
    names = design.columns
    raw = [f"_r{i}" for i in range(len(design.spec.raw))]
    flat = df.select(
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold"), number(df, y).alias("_y"),
        *[c.alias(r) for c, r in zip(design.codes(df), raw)],
    )
    rows = stage_columns(flat.dropna(subset=["_y", *raw]))
    columns = [f"_x{i}" for i in range(len(names))]
    expressions = design.from_codes(_coded(design))
    shift, scale, _ = centre_and_scale(rows.select(*[expressions[c].alias(x) for c, x in zip(names, columns)]), columns)
    counts = rows.groupBy("_fold").agg(
        F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("ones"),
        F.count_if(~F.col("_y").isin(0.0, 1.0)).alias("bad"),
    ).collect()
    if any(r["bad"] for r in counts):
        raise ValueError(f"{y} holds values other than 0 and 1")
    if not counts:
        raise ValueError("no complete rows to fit on")
    return LogitData(
        design, names, rows, shift, scale, sum(r["n"] for r in counts), sum(r["ones"] for r in counts),
        {r["_fold"]: (r["n"], r["ones"]) for r in counts}, rows.rdd.getNumPartitions(),
    )


def _newton_kernel(design: DesignSpec, shift: np.ndarray, scale: np.ndarray, batch_models: list[tuple[list[int], np.ndarray, int | None]]):
    """Arrow batches in; per model the log-likelihood, gradient and information."""
    inverse = np.where(scale > 0, 1.0 / np.where(scale > 0, scale, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray | None] = [None] * len(batch_models)
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            coded = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(2, batch.num_columns)]
            z = design.expand(coded) if coded else np.ones((batch.num_rows, 1))
            z[:, 1:] = (z[:, 1:] - shift) * inverse
            for m, (cols, w, left_out) in enumerate(batch_models):
                used = slice(None) if left_out is None else fold != left_out
                x, t = z[used][:, cols], y[used]
                eta = x @ w
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                info = (x * (p * (1 - p))[:, None]).T @ x
                packed = np.concatenate([
                    [t @ eta - np.logaddexp(0, eta).sum()], x.T @ (t - p), info[np.triu_indices(len(cols))]
                ])
                sums[m] = packed if sums[m] is None else sums[m] + packed
        for m, packed in enumerate(sums):
            if packed is not None:
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array([m], pa.int32()), "packed": pa.array([packed], pa.list_(pa.float64())),
                })

    return run


def _evaluate(data: LogitData, models: list[tuple[list[int], np.ndarray, int | None]]):
    """One pass over the rows for all models: (log-likelihood, gradient, information)."""
    partial = data.rows.mapInArrow(
        _newton_kernel(data.design, data.shift, data.scale, models), "model int, packed array<double>"
    )
    summed = summed_arrays(partial, ["model"], "packed", data.tasks)
    widths = [len(cols) for cols, _, _ in models]
    result = []
    for m, p in enumerate(widths):
        v = summed.get((m,), np.zeros(1 + p + p * (p + 1) // 2))
        info = np.zeros((p, p))
        info[np.triu_indices(p)] = v[1 + p:]
        result.append((float(v[0]), v[1 : 1 + p], info + np.triu(info, 1).T))
    return result


class _Newton:
    """State of one candidate in standardised units."""

    def __init__(self, data: LogitData, candidate: Candidate, l2: float, quick: bool):
        self.quick = quick
        self.names = data.design.columns_of(candidate.spec)
        where = {n: i for i, n in enumerate(data.names)}
        self.at = np.array([where[n] for n in self.names], dtype=int)
        self.cols = [0, *[int(a) + 1 for a in self.at]]
        scale = data.scale[self.at]
        safe = np.where(scale > 0, scale, 1.0)
        self.penalty = np.concatenate([[0.0], np.where(scale > 0, l2 / safe**2, 1.0)])
        out_n, out_ones = data.fold_rows.get(candidate.left_out, (0, 0)) if candidate.left_out is not None else (0, 0)
        self.n, self.ones = data.n - out_n, data.ones - out_ones
        self.left_out = candidate.left_out
        share = min(max(self.ones / max(self.n, 1), 1e-6), 1 - 1e-6)
        self.w = np.zeros(len(self.cols))
        self.w[0] = math.log(share / (1 - share))
        if candidate.start:
            slopes = np.array([candidate.start.get(n, 0.0) for n in self.names])
            self.w[1:] = slopes * scale
            self.w[0] = candidate.start["const"] + float(
                sum(v * data.shift[where[n]] for n, v in candidate.start.items() if n != "const")
            )
        self.best = math.inf
        self.base, self.step, self.halved = self.w, np.zeros_like(self.w), 0
        self.done = self.converged = False

    def update(self, log_lik: float, gradient: np.ndarray, info: np.ndarray) -> None:
        objective = -log_lik + 0.5 * float(self.penalty @ self.w**2)
        if objective > self.best + 1e-11 * max(1.0, abs(self.best)) and self.halved < 30:
            self.halved += 1  # overshoot: go back half way
            self.w = self.base + self.step / 2**self.halved
            return
        self.best, self.log_lik, self.info, self.halved = objective, log_lik, info, 0
        slope = gradient - self.penalty * self.w
        hessian = info + np.diag(self.penalty)
        step = np.linalg.lstsq(hessian, slope, rcond=1e-13)[0]  # minimum norm if columns repeat
        size = np.max(np.abs(step))
        if self.quick and size < LAST_STEP:  # take the step, its gain known to second order
            self.log_lik += float(gradient @ step - 0.5 * step @ info @ step)
            self.w = self.w + step
        if size < (LAST_STEP if self.quick else STEP_TOLERANCE):
            self.done = self.converged = True
            return
        self.base, self.step = self.w, step
        self.w = self.w + step


def fit_many(
    data: LogitData, candidates: Iterable[Candidate], l2: float = 1.0, quick: bool = False
) -> list[LogitFit]:
    """Fit all candidates together; each pass over the rows advances every unfinished one.

    ``quick`` saves the last pass where coefficients and log-likelihood are wanted but
    standard errors are not.
    """
    candidates = list(candidates)
    states = [_Newton(data, c, l2, quick) for c in candidates]
    for _ in range(MAX_STEPS):
        active = [s for s in states if not s.done]
        if not active:
            break
        for s, r in zip(active, _evaluate(data, [(s.cols, s.w, s.left_out) for s in active])):
            s.update(*r)
    open_ = [c.spec.formula() for c, s in zip(candidates, states) if not s.done]
    if open_:
        warnings.warn(f"no convergence in {MAX_STEPS} steps: {'; '.join(open_)}", RuntimeWarning, stacklevel=2)
    return [_raw_units(data, c, s) for c, s in zip(candidates, states)]


def _raw_units(data: LogitData, candidate: Candidate, s: _Newton) -> LogitFit:
    scale, shift = data.scale[s.at], data.shift[s.at]
    safe = np.where(scale > 0, scale, 1.0)
    slopes = np.where(scale > 0, s.w[1:] / safe, 0.0)
    coef = np.concatenate([[s.w[0] - slopes @ shift], slopes])
    m = np.diag(np.concatenate([[1.0], scale]))
    m[0, 1:] = shift
    return LogitFit(
        _restrict(data.design, candidate.spec), s.names, coef, m.T @ s.info @ m, s.n, s.log_lik, s.converged,
        [n for n in data.constant if n in s.names],
    )


def logit_fit(df: DataFrame, spec: ModelSpec, y: str, l2: float = 1.0) -> LogitFit:
    """Minimum of log-loss plus l2/2 times squared slopes; the intercept is free."""
    return fit_many(logit_data(df, spec, y), [Candidate(spec)], l2)[0]


def logit_predict(df: DataFrame, fit: LogitFit, out: str = "p") -> DataFrame:
    return df.withColumn(out, fit.probability(df))


def log_lik_term(y: Column, p: Column) -> Column:
    """Logarithm of the probability given to the class; minus infinity, not null, where it is 0."""
    given = F.when(y == 1, p).otherwise(1 - p)
    return F.when(given <= 0, F.lit(float("-inf"))).otherwise(F.log(given))


def logit_loglik(scored: DataFrame, y: str, p: str = "p", by: Iterable[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(log_lik_term(F.col(y), F.col(p))).alias("log_lik")
    )


def pseudo_r2(scored: DataFrame, y: str, p: str = "p", by: Iterable[str] = ()) -> DataFrame:
    """1 - LL / LL0, the null model being the class share of the evaluated rows."""
    share = F.avg(F.col(y).cast("double"))
    grouped = scored.groupBy(*by).agg(
        F.count("*").alias("n"), share.alias("_share"), F.sum(log_lik_term(F.col(y), F.col(p))).alias("log_lik")
    )
    s = F.col("_share")
    null = F.col("n") * (s * F.log(s) + (1 - s) * F.log(1 - s))
    return grouped.withColumn("log_lik_null", null).withColumn(
        "pseudo_r2", 1 - F.try_divide(F.col("log_lik"), F.col("log_lik_null"))
    ).drop("_share")


def null_log_lik(n: int, ones: int) -> float:
    if ones in (0, n):
        return 0.0
    share = ones / n
    return n * (share * math.log(share) + (1 - share) * math.log(1 - share))
