"""Quantile search, running totals, rank lookups, draws and tail probabilities."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veta.functions import cumulative, dist, quantiles, scalars, staging

PS = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]


def _frame(spark, values, groups=None):
    rows = [(float(v) if v is not None else None, g) for v, g in zip(values, groups or ["a"] * len(values))]
    return spark.createDataFrame(rows, "x double, g string").repartition(3)


def _shapes():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=5000),
        "hot": np.concatenate([np.full(3000, 7.0), rng.normal(size=2000)]),
        "few": rng.integers(0, 4, size=4000).astype(float),
        "heavy": np.exp(rng.normal(size=3000) * 8),
        "infinite": np.concatenate([rng.normal(size=500), [math.inf] * 40, [-math.inf] * 40]),
        "sorted": np.arange(6000.0),
    }


SEARCHES = {"as set": {}, "cut again": {"STEPS": 1, "PARTS": 7, "INSIDE": 40}, "one cell a sign": {"STEPS": 0}}


def _set(monkeypatch, search):
    for name, value in SEARCHES[search].items():
        monkeypatch.setattr(quantiles, name, value)


@pytest.mark.parametrize("shape, search", [*zip(_shapes(), itertools.cycle(SEARCHES)), ("heavy", "cut again"), ("hot", "cut again"), ("infinite", "cut again")])
def test_search_equals_sorting(spark, monkeypatch, shape, search):
    _set(monkeypatch, search)
    values = np.sort(_shapes()[shape])
    ranks = [0, 1, 17, len(values) // 2, len(values) // 2 + 1, len(values) - 1]
    ps = [r / (len(values) - 1) for r in ranks]
    found = quantiles.exact_quantiles(_frame(spark, values), {"x": ps})[()]["x"]
    for r, p in zip(ranks, ps):
        at = (len(values) - 1) * p  # the product may miss the rank by a rounding
        low, high = values[math.floor(at)], values[math.ceil(at)]
        assert found[p] == (low if low == high or at == math.floor(at) else low + (at - math.floor(at)) * (high - low))
        assert found[p] == values[r] or found[p] == pytest.approx(values[r], rel=1e-9, abs=1e-9)


def test_quantiles_leave_out_nulls(spark):
    values = [*_shapes()["heavy"].tolist(), None, None]
    found = quantiles.exact_quantiles(_frame(spark, values), {"x": PS})[()]["x"]
    assert list(found.values()) == pytest.approx(np.quantile(_shapes()["heavy"], PS), rel=1e-12)


def test_quantiles_of_many_rows(spark):
    df = spark.range(200_000, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    rows = np.array([tuple(r) for r in df.collect()])
    found = quantiles.exact_quantiles(df, {"x": PS, "y": PS})[()]
    assert list(found["x"].values()) == pytest.approx(np.quantile(rows[:, 0], PS), rel=1e-12)
    assert list(found["y"].values()) == np.quantile(rows[:, 1], PS).tolist()


@pytest.mark.parametrize("search", SEARCHES)
def test_quantiles_by_group_with_a_hot_group(spark, monkeypatch, search):
    _set(monkeypatch, search)
    rng = np.random.default_rng(5)
    groups = ["hot"] * 4000 + ["cold"] * 50 + [None] * 30 + ["empty"] * 2
    values = [*rng.normal(size=len(groups) - 2).tolist(), None, None]
    df = _frame(spark, values, groups)
    found = quantiles.exact_quantiles(df, {"x": PS}, ["g"])
    for g in ("hot", "cold", None):
        mine = [v for v, k in zip(values, groups) if k == g]
        assert list(found[(g,)]["x"].values()) == pytest.approx(np.quantile(mine, PS), rel=1e-12)
    assert set(found[("empty",)]["x"].values()) == {None}


def test_quantiles_of_more_groups_than_the_driver_needs(spark):
    df = spark.range(60_000).select((F.col("id") % 15_000).alias("g"), F.col("id").cast("double").alias("x"))
    table = quantiles.quantile_table(df, {"x": [0.5]}, ["g"])
    assert table.count() == 15_000
    assert table.where("q_x_0 <> g + 22500").count() == 0


def test_quantiles_of_nothing(spark):
    df = _frame(spark, [None, None])
    assert quantiles.exact_quantiles(df, {"x": [0.5]})[()]["x"] == {0.5: None}
    assert quantiles.exact_quantiles(df.where("false"), {"x": [0.5]})[()]["x"] == {0.5: None}


@pytest.mark.parametrize("kind", ["number", "text"])
def test_running_totals_in_ranges(spark, kind, many_ranges):
    keys = [i * 3 for i in range(900)]
    rows = [(k if kind == "number" else f"{k:05d}", g, k % 7 + 1) for k in keys for g in ("a", "b")]
    df = spark.createDataFrame(rows, f"v {'long' if kind == 'number' else 'string'}, g string, n long").repartition(5)
    got = {
        (r["g"], r["v"]): r["cum_n"]
        for r in cumulative.running_totals(df, "v", ["n"], ["g"]).collect()
    }
    for g in ("a", "b"):
        total = 0
        for v, k, n in sorted(rows):
            if k == g:
                total += n
                assert got[(g, v)] == total


def test_rank_lookup_covers_every_rank(spark):
    values = [1.0] * 3000 + [float(v) for v in range(2, 900)] + [5.0] * 500
    ranked, rows, distinct = cumulative.value_ranks(_frame(spark, values), "x")
    asked = spark.range(1, rows + 1).withColumn("rank", F.col("id")).union(spark.range(2).selectExpr("id", "null"))
    got = cumulative.lookup_ranks(asked, "rank", ranked, rows, distinct).collect()
    assert (rows, distinct, len(got)) == (len(values), 899, rows + 2)
    ordered = sorted(values)
    for r in got:
        assert r["_value"] == (None if r["rank"] is None else ordered[r["rank"] - 1])


def test_uniform_is_repeatable_and_even(spark):
    df = spark.range(20_000).select("id", scalars.portable_uniform("id", 9).alias("u"))
    a = {r["id"]: r["u"] for r in df.collect()}
    b = {r["id"]: r["u"] for r in df.repartition(7).collect()}
    assert a == b
    u = np.array(list(a.values()))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(bounds=st.lists(st.floats(-5, 5), min_size=1, max_size=9, unique=True), inclusive=st.booleans())
def test_interval_index_counts_bounds(spark, bounds, inclusive):
    bounds = sorted(bounds)
    values = [-6.0, *bounds, 0.1, 6.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(scalars.interval_index(F.col("x"), bounds, inclusive)).collect()]
    assert got == [sum(b <= v if inclusive else b < v for b in bounds) for v in values]


def test_clip_keeps_null_and_codes(spark):
    df = spark.createDataFrame([(5.0, 0.0005), (None, 0.07), (1.0, 0.5)], "x double, p double")
    rows = df.select(scalars.clip_upper(F.col("x"), 2.0).alias("c"), scalars.significance_code(F.col("p")).alias("s")).collect()
    assert [r["c"] for r in rows] == [2.0, None, 1.0]
    assert [r["s"] for r in rows] == ["***", ".", ""]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert scalars.nulls_from_nan(df).where("x is null").count() == 2


def test_tails_against_known_values():
    # published t, F and chi-square points
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.t_two_sided(-23.1534, 6454) == pytest.approx(5.34e-114, rel=5e-3)
    assert dist.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_upper(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25, rel=1e-12)
    assert dist.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)


def test_stage_uses_the_session_folder(spark):
    staged = staging.stage(spark.range(10), spread=True)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
    assert staged.rdd.getNumPartitions() >= 4 and staged.count() == 10


def test_split_and_folds_draw_independently(spark):
    from veta.operators.split import kfold_assign, train_test_split

    df = kfold_assign(train_test_split(spark.range(4000), "id"), "id", 5, 2)
    counts = df.where("split = 'train'").groupBy("fold_0").count().collect()
    assert len(counts) == 5 and min(r["count"] for r in counts) > 500


def test_nan_in_exact_quantiles_counts_as_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(float("nan"),), (None,)], "x double")
    assert quantiles.exact_quantiles(df, {"x": [0.5]})[()]["x"][0.5] == 5.0
