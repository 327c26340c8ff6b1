"""Linear track: split, select, compare, cross-validate, decide, diagnose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from ..operators import charts, decide, evaluate, ols, select
from ..operators.design import DesignSpec, ModelSpec
from ..operators.moments import moments
from ..operators.split import kfold_assign, train_test_split


@dataclass(frozen=True)
class LinearResult:
    fit: ols.OlsFit
    winner: str
    selections: list[select.Selection]
    reports: dict[str, DataFrame]


def linear_track(
    df: DataFrame, key: str, y: str, spec: ModelSpec, test: float = 0.2, seed: int = 123,
    folds: int = 5, reps: int = 20, candidates: int = 4,
) -> LinearResult:
    spark = df.sparkSession
    needed = df.select(key, y, *spec.raw)
    split = train_test_split(needed, key, test, seed)
    table = stage(kfold_assign(split, key, folds, reps, seed))
    train = table.where(F.col("split") == "train")

    design = DesignSpec.fit(train, spec)
    m = moments(train, design, y)
    chosen = select.run_grid_ols(m)
    specs = {s.name: s.spec for s in chosen}
    comparison = evaluate.model_comparison_ols(table, specs, y)
    finalists = [r["model"] for r in comparison.limit(candidates).collect()]
    scores = evaluate.repeated_cv_ols(
        train, {n: specs[n] for n in finalists}, y, [f"fold_{r}" for r in range(reps)]
    )
    summary = evaluate.score_summary(scores)
    winner = decide.pick_winner_ols(summary).first()["model"]

    fit = ols.ols(m, specs[winner])
    scored = ols.ols_predict(table, fit, y)
    on_train = scored.where(F.col("split") == "train")
    reports = {
        "selections": select.selections_table(spark, chosen),
        "trace": select.selection_trace(spark, chosen),
        "comparison": comparison,
        "complexity": charts.complexity_vs_score(comparison),
        "cv_scores": scores,
        "cv_summary": summary,
        "cv_box": charts.score_box(scores),
        "coefficients": fit.coefficients_table(spark),
        "stats": fit.stats_table(spark),
        "r2": ols.r_squared(scored, y, by=["split"]),
        "errors": ols.regression_errors(scored, y, by=["split"]),
        "effect_sizes": evaluate.effect_sizes_ols(spark, m, specs[winner]),
        "breusch_pagan": ols.breusch_pagan(train, fit, y),
        "durbin_watson": ols.durbin_watson(on_train, "residual", [key]),
        "normality": ols.residual_normality(on_train, "residual"),
        "residual_bins": charts.residual_bins(on_train),
        "qq": charts.qq_points(on_train, "residual", standardize=True),
    }
    return LinearResult(fit, winner, chosen, reports)
