"""Rules that pick the winning model from small comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import require_columns

TIE_R2, TIE_ACCURACY, TIE_PSEUDO_R2, MAX_GAP, MAX_CANDIDATES = 2e-4, 1e-12, 1e-4, 0.05, 4


def near_best_ols(summary: DataFrame, tol: float = TIE_R2) -> DataFrame:
    """Models whose mean score is within ``tol`` of the best."""
    best = summary.agg(F.max("mean")).first()[0]
    return summary.where(F.lit(best) - F.col("mean") <= tol)


def pick_winner_ols(summary: DataFrame, tol: float = TIE_R2) -> DataFrame:
    """Best mean score; in a technical tie the best of the models chosen by BIC."""
    near = near_best_ols(summary, tol)
    return near.orderBy(F.desc(F.col("model").contains("BIC")), F.desc("mean"), "model").limit(1)


def stable_candidates(table: DataFrame, max_gap: float = MAX_GAP, top: int = MAX_CANDIDATES) -> DataFrame:
    """Models whose accuracy hardly moves from train to test; all when none is stable."""
    require_columns(table, ["model", "pseudo_r2_test", "acc_train", "acc_test", "n_params"])
    gaps = table.withColumn("gap", F.abs(F.col("acc_train") - F.col("acc_test")))
    any_stable = not gaps.where(F.col("gap") < max_gap).isEmpty()
    kept = gaps.where(F.col("gap") < max_gap) if any_stable else gaps
    return kept.orderBy(F.desc("pseudo_r2_test"), "n_params", "model").limit(top)


def pick_winner_logit(candidates: DataFrame) -> DataFrame:
    """Best test accuracy and pseudo-R2 within tolerance, then fewest parameters, then BIC."""
    top = candidates.agg(F.max("acc_test").alias("acc"), F.max("pseudo_r2_test").alias("pr2")).first()
    if top["acc"] is None:
        raise ValueError("no candidates to choose from")
    tied = candidates.where(
        (F.col("acc_test") >= top["acc"] - TIE_ACCURACY) & (F.col("pseudo_r2_test") >= top["pr2"] - TIE_PSEUDO_R2)
    )
    pool = candidates if tied.isEmpty() else tied
    return pool.orderBy(
        "n_params", F.desc(F.col("model").contains("BIC")), F.desc("pseudo_r2_test"), "model"
    ).limit(1)


def order_report(table: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Sort by several columns, each ascending or not; the last key should be unique."""
    return table.orderBy(*[F.asc(c) if ascending else F.desc(c) for c, ascending in keys])


def head_k(table: DataFrame, keys: list[tuple[str, bool]], k: int) -> DataFrame:
    return order_report(table, keys).limit(k)
