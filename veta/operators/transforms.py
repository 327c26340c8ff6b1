"""Automatic choice of a monotone transformation per column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import interpolated, ranks_around
from ..functions.scalars import number
from ..functions.tables import report
from .assoc import QUINTILES, cramers_v_ranking
from .profile import moments_of, numeric_view
from .schema import split_types

SHIFT = 1.0001  # fixed value: the minimum lands just above zero

TIE = 1e-12  # scores this close are equal up to summation order

# Result names of the candidate transformations, in order of preference.
CANDIDATES = ["x", "logx", "expx", "sqrx", "sqrtx", "cuartax", "raiz4"]


def candidate(name: str, x: Column) -> Column:
    return {
        "x": lambda: x, "logx": lambda: F.log(x), "expx": lambda: F.exp(x),
        "sqrx": lambda: x * x, "sqrtx": lambda: F.sqrt(x),
        "cuartax": lambda: F.pow(x, F.lit(4.0)), "raiz4": lambda: F.pow(x, F.lit(0.25)),
    }[name]()


def standardize_expr(x: Column, mean: float | None, std: float | None) -> Column:
    """z-score with the population deviation; a constant column is only centred."""
    return (x - F.lit(mean)) / F.lit(std or 1.0)


def standardize(df: DataFrame, columns: Iterable[str], suffix: str = "_z") -> DataFrame:
    columns = list(columns)
    stats = moments_of(numeric_view(df, columns), columns, ["mean", "std_pop"])
    return df.withColumns({
        f"{c}{suffix}": standardize_expr(number(df, c), stats[c]["mean"], stats[c]["std_pop"]) for c in columns
    })


def shifted_columns(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Standardised columns moved to positive values."""
    stats = moments_of(numeric_view(df, columns), columns, ["mean", "std_pop", "min"])
    result = {}
    for c in columns:
        s = stats[c]
        if s["mean"] is None:
            result[c] = F.lit(None).cast("double")
            continue
        lowest = (s["min"] - s["mean"]) / (s["std_pop"] or 1.0)
        z = standardize_expr(number(df, c), s["mean"], s["std_pop"])
        result[c] = z + F.lit(abs(lowest) * SHIFT)
    return result


def _choose(scores: dict[tuple[str, str], float | None], columns: list[str]) -> list[tuple]:
    rows = []
    for c in columns:
        value = {t: -1.0 if scores[(c, t)] is None else scores[(c, t)] for t in CANDIDATES}
        best = next(t for t in CANDIDATES if value[t] >= max(value.values()) - TIE)
        rows += [(c, t, scores[(c, t)], t == best) for t in CANDIDATES]
    return rows


def _candidate_edges(base: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Quantile edges of every candidate from one search per column.

    Candidates rise with a positive value, so the value at a rank of a candidate is the candidate
    of the value at that rank.  A column that is not positive throughout is left to be searched.
    """
    around = ranks_around(base, {f"_s_{i}": QUINTILES for i in range(len(columns))})
    points, slots = [], []
    for i, c in enumerate(columns):
        ends = around[f"_s_{i}"]
        if ends[0.0][0] is None or ends[0.0][0] <= 0:
            continue
        for t in CANDIDATES:
            points += [candidate(t, F.lit(v)) for p in QUINTILES for v in ends[p][:2]]
            slots += [(f"{c}|{t}", ends[p][2]) for p in QUINTILES]
    if not slots:
        return {}
    values = base.sparkSession.range(1).select(F.array(*points)).first()[0]  # the same functions as on the rows
    edges: dict[str, set[float]] = {}
    for (name, part), low, high in zip(slots, values[::2], values[1::2]):
        edges.setdefault(name, set()).add(interpolated(low, high, part))
    return {name: sorted(e) for name, e in edges.items()}


def transform_scores(df: DataFrame, columns: Iterable[str], target: str, measure: str) -> DataFrame:
    """Score of every candidate and the winner per column (first one on ties)."""
    columns = list(columns)
    shifted = shifted_columns(df, columns)
    named = {
        (c, t): candidate(t, F.col(f"_s_{i}")) for i, c in enumerate(columns) for t in CANDIDATES
    }
    base = df.select(F.col(target), *[shifted[c].alias(f"_s_{i}") for i, c in enumerate(columns)])
    if measure == "corr":
        y = number(df, target)
        row = base.agg(*[F.abs(F.corr(x, y)).alias(f"{c}|{t}") for (c, t), x in named.items()]).first()
        scores = {(c, t): row[f"{c}|{t}"] for c, t in named}
        scores = {k: None if v is None or v != v else v for k, v in scores.items()}
    else:
        wide = base.select(target, *[x.alias(f"{c}|{t}") for (c, t), x in named.items()])
        edges = _candidate_edges(base, columns)
        ranking = cramers_v_ranking(wide, [f"{c}|{t}" for c, t in named], target, edges).collect()
        scores = dict.fromkeys(named)
        scores |= {tuple(r["variable"].rsplit("|", 1)): r["cramers_v"] for r in ranking}
    return report(
        df.sparkSession, _choose(scores, columns),
        "variable string, transform string, score double, chosen boolean",
    )


def best_transform_corr(df: DataFrame, columns: Iterable[str], target: str) -> DataFrame:
    return transform_scores(df, columns, target, "corr")


def best_transform_cramer(df: DataFrame, columns: Iterable[str], target: str) -> DataFrame:
    return transform_scores(df, columns, target, "cramer")


def auto_transform(df: DataFrame, columns: Iterable[str], target: str, keep: Iterable[str] = ()) -> DataFrame:
    """Replace each column by its best transformation, named ``{transform}{column}``.

    A numeric target is matched by correlation, any other by Cramer's V.
    """
    columns = list(columns)
    measure = "corr" if target in split_types(df)[0] else "cramer"
    chosen = transform_scores(df, columns, target, measure).where("chosen").collect()
    best = {r["variable"]: r["transform"] for r in chosen}
    shifted = shifted_columns(df, columns)
    return df.select(*keep, *[candidate(best[c], shifted[c]).alias(f"{best[c]}{c}") for c in columns])
