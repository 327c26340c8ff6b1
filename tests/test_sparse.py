"""Sparse designs against the dense ones on the same rows, and categories no dense design takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veta.operators import ols
from veta.operators.design import DesignSpec, ModelSpec
from veta.operators.moments import moment_matrix, moments
from veta.operators.sparse import SparseDesign, ols_wide, sparse_design

SPEC = ModelSpec.of(["x"], ["c", "d"], [("x", "c"), ("c", "d")])


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 50)), [None, "p", "q", "r", "s"][rng.integers(0, 5)], "uvw"[rng.integers(0, 3)], float(rng.normal() + i % 7)) for i in range(400)]
    rows += [(400, None, "p", "u", 1.0), (401, 2.0, "q", "v", None)]
    return spark.createDataFrame(rows, "id int, x double, c string, d string, y double").repartition(3)


def test_rows_hold_what_the_dense_design_holds(frame):
    dense = DesignSpec.fit(frame, SPEC)
    full = frame.where("x is not null")
    want = {r[0]: [float(v) for v in r[1:]] for r in dense.transform(full, ["id"]).collect()}
    got = SparseDesign.fit(frame, SPEC)
    assert got.begins[-1] == len(dense.columns) + 1
    rows = got.transform(full, ["id"]).collect()
    assert len(rows) == len(want)
    for r in rows:
        line = np.zeros(len(dense.columns))
        line[np.array(r["positions"]) - 1] = r["values"]
        assert line.tolist() == want[r["id"]] and r["positions"] == sorted(r["positions"])
    missing = got.transform(frame.where("x is null"), ["id"]).first()
    assert missing["positions"][0] == 1 and missing["values"][0] is None


def test_unseen_levels_and_empty_tables(spark, frame):
    design = SparseDesign.fit(frame, ModelSpec.of(["x"], ["c"]))
    other = spark.createDataFrame([(1.0, "unseen"), (2.0, None)], "x double, c string")
    assert sorted(map(tuple, design.transform(other).collect())) == [([1], [1.0]), ([1], [2.0])]
    assert sparse_design(frame.limit(0), SPEC).count() == 0


def test_cross_products(frame):
    dense = DesignSpec.fit(frame, SPEC)
    names = {n: i for i, n in enumerate(["const", *dense.columns, "y"])}
    want = {(names[r["i"]], names[r["j"]]): r["value"] for r in moment_matrix(frame, dense, "y").collect()}
    got = {(r["i"], r["j"]): r["value"] for r in SparseDesign.fit(frame, SPEC).cross_products(frame, "y").collect()}
    assert all(np.isclose(v, got.get(k, 0.0), atol=1e-6) for k, v in want.items()) and set(got) <= set(want)


def test_least_squares_with_a_category_projected_out(frame):
    spec = ModelSpec.of(["x"], ["d"])
    dense = DesignSpec.fit(frame, ModelSpec.of(["x"], ["d", "c"]))
    fit = ols.ols(moments(frame, dense, "y"), dense.spec)
    want = {r["variable"]: r["coef"] for r in fit.coefficients_table(frame.sparkSession).collect()}
    got = {r["term"] + (f"_{r['level']}" if r["level"] else ""): r["estimate"] for r in ols_wide(frame, spec, "c", "y").collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k], atol=1e-8) for k in want)
    # a term that the category determines has slope 0
    tied = frame.withColumn("z", F.length(F.coalesce("c", F.lit(""))).cast("double") + (F.col("c") == "s").cast("double"))
    slopes = {r["term"]: r["estimate"] for r in ols_wide(tied.where("c is not null"), ModelSpec.of(["z"]), "c", "y").collect()}
    assert slopes["z"] == 0


def test_a_hundred_thousand_levels(spark):
    df = spark.range(200_000).select("id", (F.col("id") % 100_000).alias("host"), (F.col("id") % 11).cast("double").alias("x"))
    df = df.withColumn("y", 3 * F.col("x") + (F.col("host") % 5))
    got = SparseDesign.fit(df, ModelSpec.of(["x"], ["host"]))
    assert got.dummies == {"host": 99_999}
    wide = ols_wide(df, ModelSpec.of(["x"]), "host", "y")
    assert np.isclose(wide.where("term = 'x'").first()["estimate"], 3)
    off = wide.where("term = 'host'").select(F.max(F.abs(F.col("estimate") - F.col("level").cast("long") % 5)), F.count("*")).first()
    assert off[0] < 1e-6 and off[1] == 99_999
