"""Fits, selection, validation and decisions against numpy and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veta.operators import charts, decide, design, evaluate, logit, moments, ols, select, split, transforms
from veta.operators.assoc import bin_quintiles, cramers_v
from veta.operators.design import DesignSpec, ModelSpec
from veta.plans.linear import linear_track
from veta.plans.logistic import logistic_track
from veta.sources import models

SPEC = ModelSpec.of(["a", "b", "noise"], ["c"], [("a", "c")])


def _data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    a, b, noise = rng.normal(1e4, 3, n), rng.normal(size=n), rng.normal(size=n)
    c = rng.choice(["x", "y", "z"], n, p=[0.6, 0.3, 0.1])
    y = 0.5 * a - 2 * b + 3 * (c == "y") + rng.normal(size=n)
    p = 1 / (1 + np.exp(-(0.4 * (a - 1e4) - b + (c == "z"))))
    return a, b, noise, c, y, (rng.random(n) < p).astype(int)


@pytest.fixture(scope="module")
def frame(spark):
    a, b, noise, c, y, t = _data()
    rows = [(i, *map(float, v), str(k), float(u), int(w)) for i, (*v, k, u, w) in enumerate(zip(a, b, noise, c, y, t))]
    df = spark.createDataFrame(rows, "id long, a double, b double, noise double, c string, y double, t int")
    return df.repartition(5).cache()


def _matrix(units):
    a, b, noise, c, _, _ = _data()
    cy, cz = (c == "y").astype(float), (c == "z").astype(float)
    parts = {"a": [a], "b": [b], "noise": [noise], "c": [cy, cz], "a_c": [a * cy, a * cz]}
    return np.column_stack([np.ones(len(a)), *[v for u in units for v in parts[u]]])


def _sse(units):
    x, y = _matrix(units), _data()[4]
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, float(((y - x @ beta) ** 2).sum()), np.linalg.matrix_rank(x)


@pytest.fixture(scope="module")
def gram(frame):
    return moments.moments(frame, DesignSpec.fit(frame, SPEC), "y")


def test_fit_equals_lstsq(spark, gram):
    fit = ols.ols(gram, ModelSpec.of(["a", "b"], ["c"]))
    beta, sse, rank = _sse(["a", "b", "c"])
    assert fit.coef == pytest.approx(beta, rel=1e-6)
    assert (fit.sse, fit.rank) == (pytest.approx(sse, rel=1e-9), rank)
    x, n = _matrix(["a", "b", "c"]), 600
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sse / (n - rank))
    table = fit.coefficients_table(spark).collect()
    assert [r["std_err"] for r in table] == pytest.approx(se, rel=1e-4)
    assert all(r["ci_low"] < r["coef"] < r["ci_high"] for r in table)
    assert fit.condition == pytest.approx(np.linalg.cond(x), rel=0.02)


def test_collinear_and_constant_columns_are_dropped(spark, frame):
    df = frame.withColumn("copy", 2 * F.col("b") + 1).withColumn("one", F.lit(3.0))
    fit = ols.ols_fit(df, ModelSpec.of(["a", "b", "copy", "one"]), "y")
    assert fit.rank == 3 and fit.coefficients["copy"] == 0 and fit.coefficients["one"] == 0
    assert fit.sse == pytest.approx(_sse(["a", "b"])[1], rel=1e-9)


def test_partitioning_does_not_matter(frame, gram):
    again = moments.moments(frame.repartition(11), gram.design, "y")
    assert again.total() == pytest.approx(gram.total(), rel=1e-9, abs=1e-9)


def test_missing_rows_and_empty_spec(spark, frame):
    holes = frame.withColumn("b", F.when(F.col("id") % 3 != 0, F.col("b")))
    assert ols.ols_fit(holes, ModelSpec.of(["b"]), "y").n == 400
    assert ols.ols_fit(frame, ModelSpec(), "y").coefficients["const"] == pytest.approx(np.mean(_data()[4]))
    with pytest.raises(ValueError):
        ols.ols_fit(frame.where("false"), ModelSpec.of(["b"]), "y")


def _brute(method, criterion, score, enter, leave_b, leave_s):
    """Plain restatement of the greedy loops over a scoring function."""
    units = SPEC.units
    chosen = list(units) if method == "backward" else []
    waiting, current = list(units), score(list(units) if method == "backward" else [])
    while waiting:
        if method == "backward":
            best = min(waiting, key=lambda u: score([v for v in chosen if v != u]))
            value = score([v for v in chosen if v != best])
            if not value - current <= leave_b:
                break
            chosen.remove(best)
            waiting.remove(best)
            current = value
            continue
        best = min(waiting, key=lambda u: score([v for v in units if v in chosen or v == u]))
        value = score([v for v in units if v in chosen or v == best])
        if not current - value > enter:
            break
        chosen.append(best)
        waiting.remove(best)
        current = value
        if method == "stepwise" and len(chosen) > 1:
            out = min([u for u in units if u in chosen], key=lambda u: score([v for v in units if v in chosen and v != u]))
            value = score([v for v in units if v in chosen and v != out])
            if value - current < leave_s:
                chosen.remove(out)
                current = value
    return [u for u in units if u in chosen]


@pytest.mark.parametrize("method,criterion", itertools.product(select.METHODS, select.CRITERIA))
def test_selection_equals_refitting(gram, method, criterion):
    def score(units):
        _, sse, rank = _sse(units)
        return ols.information_criterion(criterion, ols.log_likelihood(600, sse), rank, 600)

    got = select.select_ols(gram, method, criterion)
    assert got.spec.units == _brute(method, criterion, score, 0, 0, 0)
    assert got.value == pytest.approx(score(got.spec.units), rel=1e-8)
    assert got.trace[0][1] == "start"


def _newton(units, l2=1.0, rows=slice(None)):
    x, t = _matrix(units)[rows].copy(), _data()[5][rows]
    penalty = np.full(x.shape[1], l2)
    penalty[0] = 0
    shift = np.append(0, x[:, 1:].mean(axis=0))
    z = x - shift
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (t - p) - penalty * w)
    p = 1 / (1 + np.exp(-z @ w))
    w[0] -= w[1:] @ shift[1:]
    return w, float(np.sum(t * np.log(p) + (1 - t) * np.log(1 - p)))


@pytest.fixture(scope="module")
def data(frame):
    return logit.logit_data(frame, SPEC, "t")


@pytest.mark.parametrize("l2", [1.0, 0.0])
def test_logit_equals_newton(spark, data, l2):
    units = ["a", "b", "c"]
    fit = logit.fit_many(data, [logit.Candidate(SPEC.restrict(units))], l2)[0]
    w, ll = _newton(units, l2)
    assert fit.converged and fit.coef == pytest.approx(w, rel=1e-6)
    assert fit.log_lik == pytest.approx(ll, rel=1e-10)
    summary = fit.summary(spark).collect()
    assert [r["variable"] for r in summary] == ["(Intercept)", "a", "b", "c_y", "c_z"]
    quick = logit.fit_many(data, [logit.Candidate(SPEC.restrict(units))], l2, quick=True)[0]
    assert quick.coef == pytest.approx(w, rel=1e-6) and quick.log_lik == pytest.approx(ll, rel=1e-10)


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([(float(i), int(i >= 20), 1.0) for i in range(40)], "x double, t int, one double")
    fit = logit.logit_fit(df, ModelSpec.of(["x", "one"]), "t")
    assert fit.converged and np.isfinite(fit.coef).all() and fit.coefficients["one"] == 0
    assert [r["variable"] for r in fit.summary(spark).collect()] == ["(Intercept)", "x"]
    with pytest.raises(ValueError):
        logit.logit_fit(df.withColumn("t", F.lit(2)), ModelSpec.of(["x"]), "t")


@pytest.mark.parametrize("method", select.METHODS)
@pytest.mark.parametrize("k", ["true", "reference"])
def test_logit_selection_equals_refitting(data, method, k):
    t = _data()[5]

    def score(units):
        params = len(_matrix(units)[0]) if k == "true" else 2
        ll = _newton(units)[1] if units else logit.null_log_lik(len(t), int(t.sum()))
        return logit.criterion("BIC", ll, params, len(t))

    rules = {"forward": (3, None, None), "backward": (None, 10, None), "stepwise": (5, None, 5)}[method]
    assert select.select_logit(data, method, "BIC", k=k).spec.units == _brute(method, "BIC", score, *rules)


def test_cv_equals_refitting(frame):
    df = split.kfold_assign(frame, "id", 4, 2)
    specs = {"m": ModelSpec.of(["a", "b"], ["c"])}
    got = {(r["rep"], r["fold"]): r["r2"] for r in evaluate.repeated_cv_ols(df, specs, "y", ["fold_0", "fold_1"]).collect()}
    folds = {r["id"]: (r["fold_0"], r["fold_1"]) for r in df.collect()}
    x, y = _matrix(["a", "b", "c"]), _data()[4]
    for (rep, fold), r2 in got.items():
        held = np.array([folds[i][rep] == fold for i in range(600)])
        beta, *_ = np.linalg.lstsq(x[~held], y[~held], rcond=None)
        e, d = y[held] - x[held] @ beta, y[held] - y[held].mean()
        assert r2 == pytest.approx(1 - e @ e / (d @ d), rel=1e-7)


def _auc(p, t):
    pos, neg = p[t == 1], p[t == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_curve_and_cuts_with_ties(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(0, 2, 400)
    p = np.round(np.clip(0.3 * t + rng.random(400) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, p)], "y int, p double").repartition(3)
    assert evaluate.roc_auc(df, "y").first()["auc"] == pytest.approx(_auc(p, t))
    curve = evaluate.roc_curve(df, "y").orderBy(F.desc("threshold")).collect()
    assert (curve[0]["fpr"], curve[-1]["tpr"]) == (0.0, 1.0) and len(curve) == len(set(p)) + 1
    for inclusive in (True, False):
        for r in evaluate.cutoff_sweep(df, "y", inclusive=inclusive).collect():
            yes = p >= r["cut"] if inclusive else p > r["cut"]
            assert r["accuracy"] == pytest.approx((yes == (t == 1)).mean())
            assert r["sensitivity"] == pytest.approx(yes[t == 1].mean())
            assert r["specificity"] == pytest.approx((~yes[t == 0]).mean())
    one_class = df.where("y = 1")
    assert evaluate.roc_auc(one_class, "y").first()["auc"] is None
    assert evaluate.cutoff_sweep(one_class, "y").first()["specificity"] is None


def test_published_confusion_matrix(spark):
    # counts and rates printed in a published evaluation
    cells = spark.createDataFrame([(887, 231, 154, 350)], "tn long, fp long, fn long, tp long")
    r = evaluate.rates(cells).first()
    assert (round(r["accuracy"], 5), round(r["sensitivity"], 5), round(r["specificity"], 5), round(r["youden"], 5)) == (
        0.76264, 0.69444, 0.79338, 0.48783)


def test_durbin_watson_over_many_ranges(spark):
    e = np.random.default_rng(4).normal(size=3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "id int, e double").repartition(7)
    got = ols.durbin_watson(df, "e", ["id"]).first()[0]
    assert got == pytest.approx((np.diff(e) ** 2).sum() / (e @ e), rel=1e-12)


def test_normality_and_breusch_pagan(spark, frame, gram):
    fit = ols.ols(gram, ModelSpec.of(["a", "b"]))
    row = ols.breusch_pagan(frame, fit, "y").first()
    x, y = _matrix(["a", "b"]), _data()[4]
    e2 = (y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2
    g = x @ np.linalg.lstsq(x, e2, rcond=None)[0]
    r2 = 1 - ((e2 - g) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert row["lm"] == pytest.approx(600 * r2, rel=1e-6)
    normal = ols.residual_normality(ols.ols_predict(frame, fit, "y"), "residual").first()
    assert 0 <= normal["jarque_bera_p"] <= 1 and 0 <= normal["omnibus_p"] <= 1


def test_splits(spark, frame):
    exact = split.train_test_split(frame, "id", 0.2, exact=True).groupBy("split").count()
    assert {r["split"]: r["count"] for r in exact.collect()} == {"test": 120, "train": 480}
    classes = spark.range(30_000).selectExpr("id", "cast(id % 12000 as string) as t")  # a class of two or three rows each
    exact = split.train_test_split(classes, "id", 0.25, stratify="t", exact=True)
    assert exact.where("split = 'test'").count() == 7_500
    assert exact.groupBy("t").agg(F.count_if(F.col("split") == "test").alias("n")).agg(F.max("n")).first()[0] == 1
    twins = spark.range(100).selectExpr("id % 4 as id")  # rows of one key stay together
    assert split.train_test_split(twins, "id", 0.25, exact=True).where("split = 'test'").count() == 25
    nothing = split.train_test_split(frame.where("false"), "id", 0.2, stratify="t", exact=True)
    assert nothing.columns == [*frame.columns, "split"] and nothing.count() == 0
    folds = split.stratified_kfold(frame, "id", "t", 5).groupBy("fold", "t").count().collect()
    sizes = {}
    for r in folds:
        sizes.setdefault(r["fold"], {})[r["t"]] = r["count"]
    assert all(sum(v.values()) == 120 for v in sizes.values())
    for k in (0, 1):
        assert max(v[k] for v in sizes.values()) - min(v[k] for v in sizes.values()) <= 1


def _dealt(classes, k):
    """Brute force: class-sorted rows dealt out in turn, then blocks of those sizes by key."""
    want, start = {}, 0
    for c in sorted(classes, key=lambda c: classes[c][0]):
        keys = classes[c]
        at = 0
        for f in range(k):
            size = sum(1 for p in range(start, start + len(keys)) if p % k == f)
            for key in keys[at : at + size]:
                want[c, key] = f
            at += size
        start += len(keys)
    return want


@pytest.mark.parametrize("ranges", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_folds_on_native_keys(spark, request, kind, ranges):
    if ranges:
        request.getfixturevalue("many_ranges")
    make = (lambda i: 2**60 + i) if kind == "long" else (lambda i: f"key {i:05d}")
    classes = {c: [make(i) for i in range(1000) if (i % 3 == 0) == c] for c in (False, True)}
    rows = [(key, c) for c, keys in classes.items() for key in keys]
    df = spark.createDataFrame(rows, f"id {kind}, t boolean").repartition(4)
    got = {(r["t"], r["id"]): r["fold"] for r in split.stratified_kfold(df, "id", "t", 5).collect()}
    assert got == _dealt(classes, 5)


def test_folds_keep_rows_without_key_or_class(spark):
    rows = [(None if i < 4 else i, None if i % 2 else "a") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string")
    folds = split.stratified_kfold(df, "id", "t", 5)
    assert folds.where("fold is null").count() == 0
    assert {(r["fold"], r["t"]): r["count"] for r in folds.groupBy("fold", "t").count().collect()} == {
        (f, t): 20 for f in range(5) for t in (None, "a")
    }
    assert split.stratified_kfold(df.limit(0), "id", "t", 5).collect() == []
    assert {r["fold"] for r in split.stratified_kfold(df.withColumn("id", F.lit(None).cast("long")), "id", "t", 5).collect()} == {4}


def test_design_names_that_clash_are_refused(spark):
    df = spark.createDataFrame([("q", "c", 1.0), ("b_c", "d", 2.0), ("a", "b", 3.0)], "a string, a_b string, x double")
    twins = df.withColumn("a_b", F.when(F.col("a_b") == "b", "a").otherwise(F.col("a_b")))
    with pytest.raises(ValueError, match="two design columns"):
        design.one_hot(twins, ["a", "a_b"])
    numbers = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, a_b double")
    with pytest.raises(ValueError, match="two terms"):
        design.design_matrix(numbers, ModelSpec.of(["a_b"], (), [("a", "b")]))


def test_design_edges(spark, frame):
    assert design.design_matrix(frame, ModelSpec(), keep=["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        design.category_levels(frame.select(F.col("id").cast("string").alias("c")), ["c"], max_levels=50)
    other = spark.createDataFrame([("new", 1.0), (None, 2.0)], "c string, a double")
    rows = design.align_design_columns(frame, other, ModelSpec.of(["a"], ["c"])).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0, 0.0), (2.0, 0.0, 0.0)]
    assert ModelSpec.from_json(SPEC.to_json()) == SPEC


def test_bins_and_cramer_edges(spark):
    df = spark.createDataFrame([(float(v), 5.0, None if v % 3 else "k", v % 2) for v in range(50)], "x double, c double, t string, y int")
    bins = bin_quintiles(df, ["x", "c"]).groupBy("x_bin").count().collect()
    assert {r["x_bin"]: r["count"] for r in bins} == {1: 10, 2: 10, 3: 10, 4: 10, 5: 10}
    assert bin_quintiles(df, ["c"]).where("c_bin is not null").count() == 0
    assert cramers_v(df, "c", "t").first()["cramers_v"] is None
    # all mass on the minimum: it joins the bin of the next larger value
    lump = spark.createDataFrame([(0.0,)] * 9 + [(1.0,), (2.0,), (None,)], "x double")
    assert {r["x_bin"] for r in bin_quintiles(lump, ["x"]).where("x = 0 or x is null").collect()} == \
        {r["x_bin"] for r in bin_quintiles(lump, ["x"]).where("x = 1").collect()}


def test_auto_transform_finds_the_shape(spark):
    rng = np.random.default_rng(6)
    x = rng.random(400) * 10
    df = spark.createDataFrame([(i, float(v), float((v - 5) ** 1)) for i, v in enumerate(x)], "id int, x double, y double")
    z = (x - x.mean()) / x.std()
    s = z + abs(z.min()) * 1.0001
    curved = df.join(spark.createDataFrame([(i, float(math.log(v))) for i, v in enumerate(s)], "id int, t double"), "id")
    out = transforms.auto_transform(curved, ["x"], "t", keep=["id"])
    assert out.columns == ["id", "logxx"]
    got = {r["id"]: r["logxx"] for r in out.collect()}
    assert [got[i] for i in range(400)] == pytest.approx(np.log(s).tolist(), rel=1e-9)
    assert transforms.auto_transform(df, ["x"], "y").columns == ["xx"]


def test_charts(spark, frame):
    points = charts.qq_points(frame, "b", points=9).collect()
    assert points[4]["theoretical"] == pytest.approx(0, abs=1e-12)
    assert [r["observed"] for r in points] == pytest.approx(np.quantile(_data()[1], np.arange(1, 10) / 10))
    assert sum(r["n"] for r in charts.histogram(frame, "b").collect()) == 600
    flat = frame.withColumn("b", F.lit(1.0))
    assert sum(r["n"] for r in charts.histogram(flat, "b").collect()) == 600
    assert charts.density_by_group(flat, "b", "c").count() == 0


def test_density_of_many_uneven_groups(spark):
    rng = np.random.default_rng(11)
    data = {f"g{i}": rng.normal(i, 1 + i % 5, 40) for i in range(300)} | {"far": np.array([0.0, 1.0, 2.0] * 50 + [1e6])}
    df = spark.createDataFrame([(g, float(v)) for g, xs in data.items() for v in xs] + [("one", 1.0), (None, 2.0), ("g1", None)], "g string, v double")
    curves = {}
    for r in charts.density_by_group(df, "v", "g").collect():
        curves.setdefault(r["group"], {})[r["point"]] = r
    assert set(curves) == set(data)
    for g, xs in data.items():
        h = xs.std(ddof=1) * len(xs) ** -0.2
        for i, x in enumerate(np.linspace(xs.min() - 3 * h, xs.max() + 3 * h, 50)):
            r = curves[g][i]
            want = np.exp(-0.5 * ((xs - x) / h) ** 2).sum() / (len(xs) * h * math.sqrt(2 * math.pi))
            assert r["x"] == pytest.approx(x) and r["bandwidth"] == pytest.approx(h)
            assert abs(r["density"] - want) < 1e-9


def test_winner_rules(spark):
    summary = spark.createDataFrame(
        [("Backward AIC", 0.361507), ("Stepwise BIC", 0.35981), ("Forward BIC", 0.3614)], "model string, mean double")
    assert decide.pick_winner_ols(summary).first()["model"] == "Forward BIC"
    assert decide.pick_winner_ols(summary, 1e-6).first()["model"] == "Backward AIC"
    table = spark.createDataFrame(
        [("Forward AIC", 0.24735, 0.790, 0.795, 33), ("Stepwise BIC", 0.24731, 0.7902, 0.795, 32),
         ("Backward AIC", 0.30, 0.99, 0.70, 40)],
        "model string, pseudo_r2_test double, acc_train double, acc_test double, n_params int")
    stable = decide.stable_candidates(table)
    assert [r["model"] for r in stable.collect()] == ["Forward AIC", "Stepwise BIC"]
    assert decide.pick_winner_logit(stable).first()["model"] == "Stepwise BIC"
    assert decide.stable_candidates(table, max_gap=1e-9).count() == 3


def test_saved_models_score_the_same(spark, frame, gram, data, tmp_path):
    fits = {"lin": ols.ols(gram), "log": logit.fit_many(data, [logit.Candidate(SPEC)])[0]}
    path = models.save_models(spark, fits, str(tmp_path / "models"))
    for name, fit in fits.items():
        saved = models.load_model(spark, path, name)
        want = fit.predictor(frame) if name == "lin" else fit.probability(frame)
        gap = frame.select(F.max(F.abs(saved.predict(frame) - want))).first()[0]
        assert gap == 0
    with pytest.raises(KeyError):
        models.load_model(spark, path, "absent")


def test_linear_track(frame):
    result = linear_track(frame, "id", "y", ModelSpec.of(["a", "b", "noise"], ["c"]), reps=2)
    assert {"a", "b", "c"} <= set(result.fit.design.spec.units)
    r2 = {r["split"]: r["r2"] for r in result.reports["r2"].collect()}
    assert r2["train"] > 0.5 and r2["test"] > 0.4
    assert 1.5 < result.reports["durbin_watson"].first()[0] < 2.5
    assert result.reports["cv_scores"].count() == 10 * result.reports["cv_summary"].count()


def test_logistic_track(frame):
    result = logistic_track(frame, "id", "t", ModelSpec.of(["a", "b", "noise"], ["c"]))
    assert {"a", "b"} <= set(result.fit.design.spec.units)
    assert 0.1 <= result.cut <= 0.9
    assert result.reports["auc"].first()["auc"] > 0.6
    assert result.reports["evaluation"].first()["n_params"] == result.fit.n_params


def test_omnibus_and_jarque_bera_against_a_published_summary():
    # printed with three digits of skewness and kurtosis, hence the tolerance
    n, s, k = 6488, 0.200, 4.407
    assert ols._skew_z(s, n) ** 2 + ols._kurtosis_z(k, n) ** 2 == pytest.approx(242.255, rel=2e-3)
    assert n / 6 * (s * s + (k - 3) ** 2 / 4) == pytest.approx(578.606, rel=2e-3)


def test_sums_of_arrays_reach_the_driver_whole(spark):
    """One row per key, however many tasks and entries there are."""
    from veta.functions import arrays

    parts = spark.range(0, 900, numPartitions=90).selectExpr("id % 3 as g", "transform(sequence(0, 299), i -> double(id * i)) as a")
    for tasks in (None, 90, 10):
        found = arrays.summed_arrays(parts, ["g"], "a", tasks)
        assert set(found) == {(0,), (1,), (2,)}
        assert all((found[g,] == np.arange(300.0) * sum(range(g, 900, 3))).all() for g in range(3))
    assert arrays.summed_arrays(parts.where("false"), ["g"], "a") == {}


def test_expanded_batches_are_the_design(spark):
    """Coded variables expanded in a task against the design's own columns: null, unseen level, interactions."""
    rows = [(float(i % 7), "abc"[i % 3], ["x", "y", None][i % 3 - 1], i % 2 == 0) for i in range(40)] + [(1.5, None, "x", True), (2.5, "new", "y", None)]
    frame = spark.createDataFrame(rows, "n double, c string, d string, b boolean")
    spec = ModelSpec.of(["n"], ["c", "b"], [("n", "c"), ("c", "d"), ("n", "n"), ("d", "b")])
    spec_design = design.DesignSpec.fit(frame.where("c <> 'new' or c is null"), spec)
    coded = frame.select(*[c.alias(f"r{i}") for i, c in enumerate(spec_design.codes(frame))]).toArrow()
    got = spec_design.expand([coded.column(i).to_numpy() for i in range(coded.num_columns)])
    want = np.array([tuple(r) for r in spec_design.transform(frame).collect()], dtype=float)
    assert (got[:, 0] == 1).all() and (got[:, 1:] == want).all()
