"""Profiling, repair, outliers and imputation on hand-made edge cases."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veta.operators import impute, outliers, profile, schema
from veta.plans.cleaning import CleaningPlan, clean
from veta.sources import tables


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_describe_edge_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, 3.0), (2.0, None, 3.0), (4.0, None, float("nan")), (9.0, None, 3.0)], "a double, b double, c double"
    )
    got = {r["variable"]: r for r in profile.describe_numeric(df).collect()}
    assert (got["a"]["n"], got["a"]["q50"], got["a"]["max"]) == (4, 3.0, 9.0)
    assert got["a"]["skew"] == pytest.approx(22.5 / 9.5**1.5 * 12**0.5 / 2)
    assert got["b"]["n"] == 0 and got["b"]["mean"] is None and got["b"]["q25"] is None
    assert got["c"]["n"] == 3 and got["c"]["std"] == 0.0 and got["c"]["skew"] is None


def test_describe_empty_and_sketch(spark):
    empty = spark.createDataFrame([], "a double")
    assert profile.describe_numeric(empty).first()["n"] == 0
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    assert profile.describe_numeric(df, quantile="approx").first()["q50"] == pytest.approx(499.5, abs=1)


def test_adjusted_shape_statistics():
    x = np.array([1.0, 2, 2, 3, 9, 14])
    n, d = len(x), x - x.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert profile.adjusted_skew(n, g1) == pytest.approx(g1 * math.sqrt(30) / 4)
    assert profile.adjusted_kurtosis(n, g2) == pytest.approx(5 / 12 * (7 * g2 + 6))
    assert profile.adjusted_skew(2, 0.0) is None and profile.adjusted_kurtosis(3, 0.0) is None


def test_null_reports(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, None, None)], "k int, t string, z double")
    assert rows(profile.null_report(df), "variable", "nulls", "pct") == [("z", 3, 100.0), ("t", 2, 66.667), ("k", 0, 0.0)]
    assert sorted(rows(profile.null_histogram(df), "nulls", "n")) == [(1, 1), (2, 2)]
    assert rows(profile.null_correlation(df), "variable_a", "variable_b", "corr") == [("z", "t", None)]
    assert profile.null_correlation(df.select("k")).count() == 0


def test_distinct_counts_null_is_a_value(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (float("nan"),)], "a double")
    assert profile.distinct_counts(df).first()["distinct_values"] == 2


def test_target_issues(spark):
    df = spark.createDataFrame([("-5",), ("200",), ("1",), ("x",), (None,)], "t string")
    assert {r["issue"] for r in profile.continuous_issues(df, "t").collect()} == {
        "few_distinct_values", "below_zero", "above_hundred", "high_missing_rate"}
    none = spark.createDataFrame([("x",), (None,)], "t string")
    assert profile.continuous_issues(none, "t").first()["issue"] == "no_valid_values"
    assert profile.binary_issues(none, "t").first()["issue"] == "no_valid_values"
    odd = spark.createDataFrame([("1.0",)] * 9 + [("2",)], "t string")
    assert {r["issue"] for r in profile.binary_issues(odd, "t").collect()} == {"outside_zero_one", "imbalance"}
    only = spark.createDataFrame([("3",)], "t string")
    assert {r["issue"] for r in profile.binary_issues(only, "t").collect()} == {"outside_zero_one", "no_binary_cases"}


def test_extreme_outliers_issue(spark):
    values = [float(v) for v in range(90)] + [5000.0] * 10
    df = spark.createDataFrame([(v,) for v in values], "t double")
    issues = {r["issue"]: r["n"] for r in profile.continuous_issues(df, "t").collect()}
    assert issues["extreme_outliers"] == 10


def test_strict_binary_target_fails_on_anything_else(spark):
    good = spark.createDataFrame([(" 1",), ("0 ",)], "y string")
    assert rows(schema.to_binary_target(good, "y"), "y") == [(1,), (0,)]
    for bad in ("2", "yes", "0.5", None):
        with pytest.raises(PySparkException):
            schema.to_binary_target(spark.createDataFrame([(bad,)], "y string"), "y").collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, "a", 5)], "y int, c string, other int")
    kept, dropped = schema.drop_columns_if_present(df, "y", ["other", "missing"])
    assert kept.columns == ["y", "c"] and dropped == ["other"]
    with pytest.raises(ValueError):
        schema.drop_columns_if_present(df, "absent", [])
    with pytest.raises(ValueError):
        schema.drop_columns_if_present(df, "y", ["y"])
    with pytest.raises(ValueError, match="missing columns"):
        schema.require_columns(df, ["y", "zz"])
    with pytest.raises(KeyError):
        schema.lookup_by_name(spark.createDataFrame([("m",)], "model string"), "other")


def test_constant_columns_count_null_as_value(spark):
    df = spark.createDataFrame([(1, 1, None), (1, None, None)], "a int, b int, c int")
    assert schema.constant_columns(df, ["a", "b", "c"]) == ["a", "c"]


def test_outliers_with_zero_mad_and_constant(spark):
    values = [1.0] * 50 + [2.0, 500.0]
    df = spark.createDataFrame([(v, 3.0, None) for v in values], "x double, c double, n double")
    treated, counts = outliers.outliers_to_null(df, ["x", "c", "n"])
    # MAD is 0, so 0.01 is used: both values off 1.0 are out by both rules
    assert rows(counts, "variable", "outliers") == [("x", 2), ("c", 0), ("n", 0)]
    assert treated.where("x is null").count() == 2 and treated.where("c is null").count() == 0
    summary = {r["variable"]: r for r in outliers.outlier_summary(df, ["x", "c", "n", "gone"]).collect()}
    assert set(summary) == {"x", "c", "n"} and summary["n"]["pct_iqr"] is None
    assert summary["c"]["outliers_zscore"] == 0


def test_winsorize_keeps_null(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)] + [(None,), (99999.0,)], "x double")
    treated, summary = outliers.winsorize_upper(df, "x", 0.9, 99999)
    row = summary.first()
    assert (row["sentinels"], row["upper_limit"], row["clipped"]) == (1, pytest.approx(89.1), 10)
    assert treated.where("x_win is null").count() == 2
    assert treated.agg(F.max("x_win")).first()[0] == pytest.approx(89.1)


@pytest.mark.parametrize("method", ["mean", "median", "random", "random_below"])
def test_numeric_imputation_fills_everything(spark, method):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("double")).alias("x"))
    got = impute.impute_numeric(df, "x", method, "id").collect()
    assert len(got) == 500 and all(r["x"] is not None for r in got)
    kept = [r for r in got if r["id"] % 5]
    assert all(r["x"] == r["id"] % 7 for r in kept)
    if method == "random_below":  # the rule never draws the largest value
        assert max(r["x"] for r in got if r["id"] % 5 == 0) < 6


def test_random_imputation_follows_the_shares(spark):
    df = spark.range(6000).select(
        "id", F.when(F.col("id") >= 3000, F.when(F.col("id") % 4 == 0, "rare").otherwise("hot")).alias("c")
    )
    got = impute.impute_categorical(df, "c", "random", "id").where("id < 3000").groupBy("c").count()
    share = dict(rows(got, "c", "count"))
    assert share["rare"] / 3000 == pytest.approx(0.25, abs=0.03)
    again = impute.impute_categorical(df.repartition(6), "c", "random", "id").where("id < 3000").groupBy("c").count()
    assert dict(rows(again, "c", "count")) == share


def test_imputing_nothing_observed(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, c string")
    assert impute.impute_categorical(df, "c", "random", "id").where("c is null").count() == 2
    assert impute.impute_categorical(df, "c", "mode").where("c is null").count() == 2
    with pytest.raises(ValueError):
        impute.impute_categorical(df, "c", "random")


def test_mode_tie_takes_the_first_label(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert sorted(r[0] for r in impute.impute_categorical(df, "c", "mode").collect()) == ["a", "a", "b"]


def test_cleaning_flow(spark, tmp_path):
    data = [(i, float(i % 40), None if i % 9 == 0 else float(i), "?" if i % 10 == 0 else "ab"[i % 2], i % 2) for i in range(400)]
    df = spark.createDataFrame(data, "id int, area double, farms double, density string, flag int")
    df = df.withColumn("farms", F.when(F.col("id") % 50 == 1, 99999.0).otherwise(F.col("farms")))
    plan = CleaningPlan(
        as_text=["flag"], invalid={"density": "?"}, outliers=["area", "farms"], winsorize="farms", sentinel=99999,
        recipe=impute.TreatmentRecipe(unknown_label={"density": "Unknown"}, binarize={"farms": 0.75}, draw=["farms_cat"]),
    )
    result = clean(df, plan, "id")
    assert result.table.count() == 400
    assert result.table.where("density = '?' or density is null or farms_cat is null").count() == 0
    assert result.reports["winsorize"].first()["sentinels"] == 8
    before = dict(rows(result.reports["nulls_before"], "variable", "nulls"))
    assert before["density"] == 40
    path = tables.write_parquet(result.table, str(tmp_path / "clean"))
    assert tables.read_parquet(spark, path, ["id"]).count() == 400


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"q', 2.5)], "id int, t string, x double")
    path = tables.write_report_csv(df, str(tmp_path / "r"))
    assert sorted(rows(tables.read_report_csv(spark, path, df.schema), "id", "t", "x"), key=str) == sorted(
        rows(df, "id", "t", "x"), key=str)
    meta = {"model": "m", "vars": {"cont": ["a", "b"]}, "splits": [{"n": 1}, {"n": 2}]}
    path = tables.write_metadata_json(spark, meta, str(tmp_path / "m"))
    back = tables.read_metadata_json(
        spark, path, "model string, vars struct<cont: array<string>>, splits array<struct<n: long>>").first()
    assert back["vars"]["cont"] == ["a", "b"] and [s["n"] for s in back["splits"]] == [1, 2]
    summary = tables.import_summary(df).collect()
    assert [(r["column"], r["type"], r["n_rows"]) for r in summary] == [("id", "int", 2), ("t", "string", 2), ("x", "double", 2)]
    assert dict(rows(tables.type_counts(df), "type", "n_columns")) == {"int": 1, "string": 1, "double": 1}


def test_null_correlation_of_two_thousand_columns(spark):
    rng = np.random.default_rng(3)
    flags = rng.random((60, 2000)) < 0.3
    schema = ", ".join(f"c{i} int" for i in range(2000))
    df = spark.createDataFrame([[None if x else 1 for x in row] for row in flags.tolist()], schema)
    got = {(r["variable_a"], r["variable_b"]): r["corr"] for r in profile.null_correlation(df).where("variable_a in ('c7', 'c1999')").collect()}
    want = np.corrcoef(flags.T.astype(float))
    assert len(got) == 7 + 1999
    assert all(abs(v - want[int(a[1:]), int(b[1:])]) < 1e-9 for (a, b), v in got.items())


def test_distinct_counts_of_all_kinds_of_numbers(spark):
    df = spark.createDataFrame(
        [(2**60, 0.0, Decimal("1.10"), 1.5), (2**60 + 1, -0.0, Decimal("1.1"), None), (None, float("nan"), Decimal("2"), 1.5)],
        "a long, b double, c decimal(10,2), d float",
    )
    counted = profile.distinct_counts(df)
    assert rows(counted, "variable", "distinct_values") == [("a", 3), ("b", 2), ("c", 2), ("d", 2)]
    assert [r[1] for r in profile.distinct_counts(df.limit(0)).collect()] == [0, 0, 0, 0]
