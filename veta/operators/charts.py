"""Aggregated data behind the figures; nothing here returns raw rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.quantiles import exact_quantiles, quantile_table
from ..functions.scalars import number
from ..functions.staging import stage_columns
from ..functions.tables import report
from .assoc import row_normalized_crosstab
from .profile import numeric_view

CELL, TERMS, REACH = 0.5, 12, 9.0  # of the density: cell width in bandwidths, terms of the series, bandwidths looked out


def _bin_number(x, lo: float, width: float, bins: int):
    """0-based equal-width bin; the maximum belongs to the last bin."""
    if width == 0:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins between the minimum and the maximum, empty bins included."""
    x = number(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return report(df.sparkSession, [], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins
    counted = (
        df.where(x.isNotNull()).groupBy(_bin_number(x, lo, width, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    frame = report(
        df.sparkSession, [(i, lo + i * width, lo + (i + 1) * width, 0) for i in range(bins)],
        "bin int, lo double, hi double, zero long",
    )
    return frame.join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", "zero").alias("n"))


def box_stats(df: DataFrame, column: str, by: str | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within k IQR, and outlier count per group."""
    groups, ps, x = [by] if by else [], [0.25, 0.5, 0.75], F.col("_x")
    values = df.select(*groups, number(df, column).alias("_x")).where(x.isNotNull())
    if by:
        qs = quantile_table(values, {"_x": ps}, groups)
        limits = qs.select(F.col(by).alias("_group"), F.col("q__x_0").alias("q25"), F.col("q__x_1").alias("median"), F.col("q__x_2").alias("q75"))
        joined = values.join(limits, F.col(by).eqNullSafe(F.col("_group")))
    else:
        found = exact_quantiles(values, {"_x": ps})[()]["_x"]
        joined = values.withColumns({name: F.lit(found[p]).cast("double") for name, p in zip(("q25", "median", "q75"), ps)})
    spread = k * (F.col("q75") - F.col("q25"))
    joined = joined.withColumns({"_lo": F.col("q25") - spread, "_hi": F.col("q75") + spread})
    inside = x.between(F.col("_lo"), F.col("_hi"))
    return joined.groupBy(*groups, "q25", "median", "q75").agg(
        F.count("*").alias("n"), F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("outliers"),
    )


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients, by power, of the first probabilists' Hermite polynomials."""
    rows = [[1.0], [0.0, 1.0]]
    for k in range(1, terms - 1):
        shifted, last = [0.0, *rows[k]], rows[k - 1] + [0.0, 0.0]
        rows.append([a - k * b for a, b in zip(shifted, last)])
    return [r + [0.0] * (terms - len(r)) for r in rows[:terms]]


def density_by_group(df: DataFrame, column: str, by: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on a grid that reaches ``cut`` bandwidths out.

    Scott bandwidth.  Rows are counted into cells of CELL bandwidths with the power sums of
    their places in the cell; the sum of a cell's kernels at a distance u from its middle is
    exp(-u^2 / 2) times the Hermite series of those sums.  With TERMS terms a row adds an error
    below 1.1 (CELL / 2)^TERMS / sqrt(TERMS!) = 5e-10 of the kernel's height, and what lies beyond REACH
    bandwidths, below 3e-18, is left out.  A group without spread has no curve.
    """
    values = df.select(F.col(by).cast("string").alias("_g"), number(df, column).alias("_x")).dropna()
    sizes = values.groupBy("_g").agg(
        F.count("*").alias("n"), F.stddev_samp("_x").alias("s"), F.min("_x").alias("lo"), F.max("_x").alias("hi")
    ).where(F.col("s") > 0)
    # written, so that the planner knows its size and decides about broadcasting by it
    limits = stage_columns(sizes.select("_g", "n", "lo", "hi", (F.col("s") * F.pow("n", F.lit(-0.2))).alias("h")))

    t, place = F.col("_t"), (F.col("_x") - F.col("lo")) / F.col("h")
    placed = values.join(limits.select("_g", "lo", "hi", "h"), "_g").select("_g", "lo", "hi", "h", place.alias("_at"))
    placed = placed.withColumn("_cell", F.floor(F.col("_at") / CELL))
    placed = placed.withColumn("_t", F.col("_at") - (F.col("_cell") + 0.5) * CELL)
    powers = [F.lit(1.0), t]
    while len(powers) < TERMS:
        powers.append(powers[len(powers) // 2] * powers[(len(powers) + 1) // 2])
    cells = placed.groupBy("_g", "_cell").agg(
        *[F.sum(p).alias(f"_s{k}") for k, p in enumerate(powers)], F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("h").alias("h")
    )
    hermite = _hermite(TERMS)
    series = [
        sum((F.col(f"_s{k}") * F.lit(hermite[k][j] / math.factorial(k)) for k in range(j, TERMS, 2)), F.lit(0.0)).alias(f"_c{j}")
        for j in range(TERMS)
    ]
    # grid points in bandwidths from the group's least value
    step = ((F.col("hi") - F.col("lo")) / F.col("h") + 2 * cut) / (points - 1)
    middle = (F.col("_cell") + 0.5) * CELL
    near = cells.select("_g", *series, middle.alias("_mid"), step.alias("_step"))
    near = near.withColumns({
        "_from": F.greatest(F.ceil((F.col("_mid") + cut - REACH) / F.col("_step")), F.lit(0)),
        "_to": F.least(F.floor((F.col("_mid") + cut + REACH) / F.col("_step")), F.lit(points - 1)),
    }).where(F.col("_from") <= F.col("_to"))
    reached = near.withColumn("_pos", F.explode(F.sequence("_from", "_to"))).withColumn("_u", F.col("_pos") * F.col("_step") - cut - F.col("_mid"))
    value = F.col(f"_c{TERMS - 1}")
    for j in range(TERMS - 2, -1, -1):
        value = value * F.col("_u") + F.col(f"_c{j}")
    sums = reached.groupBy("_g", "_pos").agg(F.sum(F.exp(F.col("_u") * F.col("_u") * -0.5) * value).alias("_total"))
    frame = limits.withColumn("_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    lo, hi = F.col("lo") - F.col("h") * cut, F.col("hi") + F.col("h") * cut
    return frame.join(sums, ["_g", "_pos"], "left").select(
        F.col("_g").alias("group"), F.col("_pos").cast("int").alias("point"), (lo + F.col("_pos") * (hi - lo) / (points - 1)).alias("x"),
        F.col("h").alias("bandwidth"),
        (F.greatest(F.coalesce("_total", F.lit(0.0)), F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
    )


def qq_points(df: DataFrame, column: str, points: int = 99, standardize: bool = False) -> DataFrame:
    """Observed quantiles against normal quantiles at i / (points + 1)."""
    numbers = numeric_view(df, [column])
    x = F.col(column)
    row = numbers.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    ps = [i / (points + 1) for i in range(1, points + 1)]
    qs = exact_quantiles(numbers, {column: ps})[()][column]
    rows = []
    for p in ps:
        v = qs[p]
        if standardize and v is not None:
            v = (v - row["m"]) / (row["s"] or 1.0)
        rows.append((p, dist.normal_quantile(p), v))
    return report(df.sparkSession, rows, "p double, theoretical double, observed double")


def residual_bins(scored: DataFrame, fitted: str = "fitted", residual: str = "residual", bins: int = 20) -> DataFrame:
    """Counts of (fitted, residual) on a grid: the scatter plot without its points."""
    f, e = F.col(fitted), F.col(residual)
    rows = scored.where(f.isNotNull() & e.isNotNull())
    flo, fhi, elo, ehi = rows.agg(F.min(f), F.max(f), F.min(e), F.max(e)).first()
    if flo is None:
        return report(scored.sparkSession, [], "fitted_bin int, residual_bin int, n long")
    return rows.groupBy(
        _bin_number(f, flo, (fhi - flo) / bins, bins).alias("fitted_bin"),
        _bin_number(e, elo, (ehi - elo) / bins, bins).alias("residual_bin"),
    ).agg(F.count("*").alias("n"))


def complexity_vs_score(comparison: DataFrame, score: str = "r2_test") -> DataFrame:
    """Parameters against test score, labelled by the criterion in the model name."""
    family = F.when(F.col("model").contains("AIC"), "AIC").when(F.col("model").contains("BIC"), "BIC")
    return comparison.select("model", family.alias("criterion"), "n_params", F.col(score).alias("score"))


def class_bars(df: DataFrame, column: str) -> DataFrame:
    """Rows per class of a leniently parsed 0/1 column."""
    x = number(df, column)
    return df.where(x.isNotNull()).groupBy(x.alias("class")).agg(F.count("*").alias("n"))


def mosaic_table(df: DataFrame, column: str, target: str) -> DataFrame:
    return row_normalized_crosstab(df, column, target)


def importance_bars(table: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """Importance values in bar order, with their position."""
    ordered = table.select("variable", F.col(value).alias("value")).orderBy(F.desc("value"), "variable")
    return ordered if top is None else ordered.limit(top)


def cutoff_lines(sweep: DataFrame, chosen: DataFrame) -> DataFrame:
    """Accuracy and Youden by cut in long form, the chosen cuts marked."""
    cuts = {r["criterion"]: r["cut"] for r in chosen.select("criterion", "cut").collect()}
    long = sweep.select("cut", "accuracy", "youden").unpivot("cut", ["accuracy", "youden"], "measure", "value")
    mark = F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv])
    return long.withColumn("chosen", F.col("cut") == mark[F.col("measure")])


def score_box(scores: DataFrame, model: str = "model", score: str = "r2") -> DataFrame:
    return box_stats(scores, score, model)
