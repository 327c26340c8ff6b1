"""Raw table to clean table, with the reports taken on the way."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.staging import stage
from ..operators.impute import TreatmentRecipe, treat_missing
from ..operators.outliers import outlier_summary, winsorize_upper
from ..operators.profile import describe_numeric, frequency_table, null_report
from ..operators.schema import cast_columns, recode_to_null


@dataclass(frozen=True)
class CleaningPlan:
    as_text: list[str] = field(default_factory=list)
    invalid: dict[str, object] = field(default_factory=dict)
    outliers: list[str] = field(default_factory=list)
    winsorize: str | None = None
    sentinel: float | None = None
    p: float = 0.99
    recipe: TreatmentRecipe = field(default_factory=TreatmentRecipe)


@dataclass(frozen=True)
class CleaningResult:
    table: DataFrame
    reports: dict[str, DataFrame]


def clean(df: DataFrame, plan: CleaningPlan, key: str) -> CleaningResult:
    """Cast, profile, recode, winsorize and treat missing values.

    The treated table is staged once, so later steps do not repeat the cleaning.
    """
    df = cast_columns(df, plan.as_text)
    reports = {"describe": describe_numeric(df), "frequencies": frequency_table(df.drop(key))}
    df = recode_to_null(df, plan.invalid)
    if plan.outliers:
        reports["outliers"] = outlier_summary(df, plan.outliers)
    if plan.winsorize:
        df, reports["winsorize"] = winsorize_upper(df, plan.winsorize, plan.p, plan.sentinel)
    reports["nulls_before"] = null_report(df)
    table = stage(treat_missing(df, plan.recipe, key))
    reports["nulls_after"] = null_report(table)
    return CleaningResult(table, reports)
