"""Fitted models as tables: coefficients, design and statistics, reloadable anywhere."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import logistic
from ..operators.design import DesignSpec, ModelSpec
from ..operators.logit import LogitFit
from ..operators.ols import OlsFit

MODEL_SCHEMA = (
    "model string, family string, spec string, levels string, n long, n_params int, log_lik double, "
    "coefficients array<struct<variable: string, coef: double>>"
)


def model_record(spark: SparkSession, fits: dict[str, OlsFit | LogitFit]) -> DataFrame:
    """One row per named model."""
    rows = []
    for name, f in fits.items():
        linear = isinstance(f, OlsFit)
        rows.append((
            name, "linear" if linear else "logistic", f.design.spec.to_json(), json.dumps(f.design.levels),
            f.n, len(f.coef), f.llf if linear else f.log_lik, list(f.coefficients.items()),
        ))
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def save_models(spark: SparkSession, fits: dict[str, OlsFit | LogitFit], path: str) -> str:
    model_record(spark, fits).coalesce(1).write.mode("overwrite").parquet(path)
    return path


class SavedModel:
    """A reloaded model: enough to score and to report coefficients."""

    def __init__(self, row):
        self.name, self.family, self.n, self.n_params = row["model"], row["family"], row["n"], row["n_params"]
        self.log_lik = row["log_lik"]
        self.coefficients = {c["variable"]: c["coef"] for c in row["coefficients"]}
        self.design = DesignSpec(ModelSpec.from_json(row["spec"]), json.loads(row["levels"]))

    def predict(self, df: DataFrame) -> Column:
        xb = self.design.linear_predictor(df, self.coefficients)
        return logistic(xb) if self.family == "logistic" else xb


def load_model(spark: SparkSession, path: str, name: str) -> SavedModel:
    """Reload one model by name; an unknown name is an error."""
    row = spark.read.schema(MODEL_SCHEMA).parquet(path).where(F.col("model") == name).first()
    if row is None:
        raise KeyError(f"no model named {name} in {path}")
    return SavedModel(row)
