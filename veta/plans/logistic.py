"""Logistic track: stratified split, select, compare, decide, tune the cut, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from ..operators import decide, evaluate, logit, profile, schema, select
from ..operators.design import ModelSpec
from ..operators.split import train_test_split


@dataclass(frozen=True)
class LogisticResult:
    fit: logit.LogitFit
    winner: str
    cut: float
    selections: list[select.Selection]
    reports: dict[str, DataFrame]


def logistic_track(
    df: DataFrame, key: str, y: str, spec: ModelSpec, test: float = 0.2, seed: int = 123, l2: float = 1.0,
    criterion_k: str = "true",
) -> LogisticResult:
    spark = df.sparkSession
    binary = schema.to_binary_target(df.select(key, y, *spec.raw), y)
    table = stage(train_test_split(stage(binary), key, test, seed, stratify=y, exact=True))
    train = table.where(F.col("split") == "train")
    data = logit.logit_data(train, spec, y)
    chosen = select.run_grid_logit(data, l2=l2, k=criterion_k)
    specs = {s.name: s.spec for s in chosen}
    comparison = evaluate.model_comparison_logit(table, specs, y, l2=l2)
    candidates = decide.stable_candidates(comparison)
    winner = decide.pick_winner_logit(candidates).first()["model"]
    fit = logit.fit_many(data, [logit.Candidate(specs[winner])], l2)[0]
    scored = logit.logit_predict(table, fit)
    on_test = scored.where(F.col("split") == "test")
    sweep = evaluate.cutoff_sweep(on_test, y)
    best = evaluate.optimal_cutoff(sweep)
    cut = best.where("criterion = 'youden'").first()["cut"]
    reports = {
        "balance": profile.class_balance(binary, y),
        "selections": select.selections_table(spark, chosen),
        "comparison": comparison,
        "candidates": candidates,
        "coefficients": fit.coefficients_table(spark),
        "summary": fit.summary(spark),
        "goodness": fit.goodness(spark, criterion_k),
        "pseudo_r2": logit.pseudo_r2(scored, y, by=["split"]),
        "roc": evaluate.roc_curve(on_test, y),
        "auc": evaluate.roc_auc(on_test, y),
        "sweep": sweep,
        "best_cuts": best,
        "evaluation": evaluate.final_evaluation(on_test, y, cut, fit.n_params),
        "top": evaluate.top_coefficients(fit.coefficients_table(spark)),
        "effect_sizes": evaluate.effect_sizes_logit(data, specs[winner], l2),
    }
    return LogisticResult(fit, winner, cut, chosen, reports)
