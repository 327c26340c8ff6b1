"""Catalogue queries against their SQL twins, run in this process by DuckDB.

All of them with ``VETA_ALL_QUERIES=1``, otherwise one per family.
"""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.base import ORACLES, QUERIES

DATA = Path(os.environ.get("VETA_SF_DIR", "/root/testdata/sf0.001"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FEW = [
    "describe_numeric", "frequency_pct", "null_correlation", "outliers_to_null_counts", "impute_numeric_random_below",
    "treat_missing", "cramers_v", "bin_quintiles", "stratified_split", "stratified_kfold",
    "stratified_kfold_big_key", "stratified_kfold_text_key", "one_hot", "cv_logit_auc", "duplicate_rows_all_columns",
    "parquet_roundtrip_rows", "accuracy_by_split", "ols_coefficients", "select_stepwise_bic_ols",
    "repeated_cv_ols", "logit_fit", "optimal_cutoff", "roc_curve", "density_by_group",
    "design_matrix_wide", "moment_matrix_wide", "ols_wide_category",
]
NAMES = sorted(ORACLES) if os.environ.get("VETA_ALL_QUERIES") else FEW

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def test_every_query_is_named_once_and_checked():
    assert set(QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
