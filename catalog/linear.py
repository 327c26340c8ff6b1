"""Linear model queries: fits, selection, cross-validation, diagnostics, decisions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from veta.functions.scalars import significance_code
from veta.operators import charts, decide, evaluate, moments, ols, schema, select, split
from veta.operators.design import DesignSpec, ModelSpec
from veta.sources import models

from . import fixtures as fx
from . import sqlgen as g
from .base import R, query, rounded, uniform_sql
from .fixtures import sql

# units of the selection queries: two numbers and a category carry signal or not
SPEC = ModelSpec.of(["price", "qty", "disc", "tax"], ["flag", "status"])
COLS = ["1.0", "price", "qty", "disc", "tax", "(flag = 'N')::INT", "(flag = 'R')::INT", "(status = 'O')::INT"]
NAMES = ["const", "price", "qty", "disc", "tax", "flag_N", "flag_R", "status_O"]
UNITS = [[1], [2], [3], [4], [5, 6], [7]]
UNIT_NAMES = ["price", "qty", "disc", "tax", "flag", "status"]
P = len(COLS)
YY = g.cell(P, P)

# a weaker model, so that selection and tests have something to decide
WEAK = ModelSpec.of(["qty", "disc", "tax"], ["flag", "status"], [("qty", "status")])
WCOLS = ["1.0", "qty", "disc", "tax", "(flag = 'N')::INT", "(flag = 'R')::INT", "(status = 'O')::INT", "qty * (status = 'O')::INT"]
WNAMES = ["const", "qty", "disc", "tax", "flag_N", "flag_R", "status_O", "qty_status_O"]
WUNITS = [[1], [2], [3], [4, 5], [6], [7]]
WUNIT_NAMES = ["qty", "disc", "tax", "flag", "status", "qty_status"]


def _fit(spark, d, spec=SPEC):
    df = fx.line_model(spark, d)
    return df, moments.moments(df, DesignSpec.fit(df, spec), "y")


def _fit_ctes(view: str = "line_model", cols=None, y: str = "y") -> str:
    cols = cols or COLS
    return g.gram("gr", view, [*cols, y]) + ",\n" + g.sweep("fit", "gr", len(cols))


def _xb(alias: str, names=range(P), cols=None) -> str:
    cols = cols or COLS
    return " + ".join(f"{alias}.{g.cell(i, len(cols))} * ({cols[i]})" for i in range(len(cols)))


@query("moment_matrix", sql("line_model", " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, {R(f'sum(CAST({x} AS DOUBLE) * ({z}))', 2)} AS value FROM line_model"
    for n, (a, x) in enumerate([*zip(NAMES, COLS), ("y", "y")])
    for b, z in [*zip(NAMES, COLS), ("y", "y")][n:])))
def moment_matrix(spark, d):
    df = fx.line_model(spark, d)
    return rounded(moments.moment_matrix(df, DesignSpec.fit(df, SPEC), "y"), 2)


def _coef_rows(names: list[str], extra) -> str:
    return " UNION ALL ".join(extra(i, n) for i, n in enumerate(names))


@query("ols_fit", sql("line_model", _coef_rows(
    NAMES, lambda i, n: f"SELECT '{n}' AS variable, {R(f'fit.{g.cell(i, P)}')} AS coef FROM fit"), _fit_ctes()))
def ols_fit(spark, d):
    fit = ols.ols_fit(fx.line_model(spark, d), SPEC, "y")
    return rounded(fit.coefficients_table(spark).select("variable", "coef"))


@query("ols_coefficients", sql("line_model", f"""
SELECT variable, {R('b')} AS coef, {R('se')} AS std_err, {R('b / se', 4)} AS t, {R(g.t_tail('b / se', 'df'))} AS p_value,
  {R(f"b - {g.t_quantile_975('df')} * se")} AS ci_low, {R(f"b + {g.t_quantile_975('df')} * se")} AS ci_high
FROM ({_coef_rows(NAMES, lambda i, n: f"""
SELECT '{n}' AS variable, fit.{g.cell(i, P)} AS b, sqrt(-fit.{g.cell(i, i)} * fit.{YY} / (gr.a_0_0 - {P})) AS se, gr.a_0_0 - {P} AS df FROM fit, gr""")})""", _fit_ctes()))
def ols_coefficients(spark, d):
    return rounded(ols.ols_fit(fx.line_model(spark, d), SPEC, "y").coefficients_table(spark), t=4)


_LL = f"(-n / 2 * (ln(2 * pi()) + ln(sse / n) + 1))"


@query("ols_summary", sql("line_model", f"""
SELECT CAST(n AS BIGINT) AS n, {P} AS n_params, CAST(n - {P} AS BIGINT) AS df_resid, {R('r2', 8)} AS r2,
  {R(f'1 - (1 - r2) * (n - 1) / (n - {P})', 8)} AS r2_adj, {R(f'(r2 / {P - 1}) / ((1 - r2) / (n - {P}))', 2)} AS f,
  {R(g.f_tail(f'((r2 / {P - 1}) / ((1 - r2) / (n - {P})))', str(P - 1), f'(n - {P})'))} AS f_p_value, {R(_LL, 4)} AS log_lik, {R(f'2 * {P} - 2 * {_LL}', 4)} AS aic, {R(f'ln(n) * {P} - 2 * {_LL}', 4)} AS bic, {R('sse', 4)} AS sse
FROM (SELECT gr.a_0_0 AS n, fit.{YY} AS sse, 1 - fit.{YY} / (gr.{YY} - pow(gr.a_0_{P}, 2) / gr.a_0_0) AS r2 FROM fit, gr)""", _fit_ctes()))
def ols_summary(spark, d):
    """The condition number, from eigenvalues, is a unit test."""
    stats = ols.ols_fit(fx.line_model(spark, d), SPEC, "y").stats_table(spark)
    return rounded(stats.drop("condition"), 4, r2=8, r2_adj=8, f=2, f_p_value=6)


_PRED = f"pred AS (SELECT key, y, flag, {_xb('fit')} AS fitted FROM line_model, fit)"


@query("ols_predict", sql("line_model", f"SELECT key, {R('fitted', 3)} AS fitted, {R('y - fitted', 3)} AS residual FROM pred",
                          _fit_ctes() + "," + _PRED))
def ols_predict(spark, d):
    df, m = _fit(spark, d)
    return rounded(ols.ols_predict(df, ols.ols(m), "y").select("key", "fitted", "residual"), 3)


_TRAIN = "tr AS (SELECT * FROM line_split WHERE split = 'train')," + _fit_ctes("tr") + f""",
pred AS (SELECT split, y, {_xb('fit')} AS fitted FROM line_split, fit)"""


def _split_scored(spark, d):
    df = split.train_test_split(fx.line_model(spark, d), "key")
    fit = ols.ols_fit(df.where("split = 'train'"), SPEC, "y")
    return ols.ols_predict(df, fit, "y")


@query("r_squared", sql("line_split", f"""
SELECT split, count(*) AS n, {R('1 - sum(pow(y - fitted, 2)) / (var_pop(y) * count(*))', 8)} AS r2 FROM pred GROUP BY split""", _TRAIN))
def r_squared(spark, d):
    return rounded(ols.r_squared(_split_scored(spark, d), "y", by=["split"]), 8)


@query("regression_errors", sql("line_split", f"""
SELECT split, count(*) AS n, {R('avg(pow(y - fitted, 2))')} AS mse, {R('sqrt(avg(pow(y - fitted, 2)))')} AS rmse,
  {R('avg(abs(y - fitted))')} AS mae FROM pred GROUP BY split""", _TRAIN))
def regression_errors(spark, d):
    return rounded(ols.regression_errors(_split_scored(spark, d), "y", by=["split"]))


@query("breusch_pagan", sql("line_model", f"""
SELECT CAST(n AS BIGINT) AS n, {R('n * r2', 3)} AS lm, {R(g.chi2_tail('n * r2', P - 1))} AS lm_p_value,
  {R(f'(r2 / {P - 1}) / ((1 - r2) / (n - {P}))', 3)} AS f, {R(g.f_tail(f'((r2 / {P - 1}) / ((1 - r2) / (n - {P})))', str(P - 1), f'(n - {P})'))} AS f_p_value
FROM (SELECT gr2.a_0_0 AS n, 1 - aux.{YY} / (gr2.{YY} - pow(gr2.a_0_{P}, 2) / gr2.a_0_0) AS r2 FROM aux, gr2)""",
    _fit_ctes() + f""",
sq AS (SELECT m.*, pow(y - ({_xb('fit')}), 2) AS e2 FROM line_model m, fit),
""" + g.gram("gr2", "sq", [*COLS, "e2"]) + ",\n" + g.sweep("aux", "gr2", P)))
def breusch_pagan(spark, d):
    df, m = _fit(spark, d)
    return rounded(ols.breusch_pagan(df, ols.ols(m), "y"), 3, lm_p_value=6, f_p_value=6)


@query("durbin_watson", sql("line_model", f"""
SELECT {R('sum(pow(e - le, 2)) / sum(e * e)')} AS durbin_watson
FROM (SELECT y - fitted AS e, lag(y - fitted) OVER (ORDER BY key) AS le FROM pred)""", _fit_ctes() + "," + _PRED))
def durbin_watson(spark, d):
    df, m = _fit(spark, d)
    return rounded(ols.durbin_watson(ols.ols_predict(df, ols.ols(m), "y"), "residual", ["key"]))


# normal scores of skewness and kurtosis, as the omnibus test defines them
_SKEW_Z = """asinh(s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2))"""
_KURTOSIS_Z = """(1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))"""


@query("residual_normality", sql("line_model", f"""
SELECT CAST(n AS BIGINT) AS n, {R('s')} AS skew, {R('k')} AS kurtosis, {R('jb', 3)} AS jarque_bera, {R('exp(-jb / 2)')} AS jarque_bera_p,
  {R('om', 3)} AS omnibus, {R('exp(-om / 2)')} AS omnibus_p
FROM (SELECT *, n / 6 * (s * s + pow(k - 3, 2) / 4) AS jb, pow({_SKEW_Z}, 2) + pow({_KURTOSIS_Z}, 2) AS om FROM (
 SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / beta * (2 / beta + sqrt(1 + 4 / (beta * beta))) AS a FROM (
  SELECT *, (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
   3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
   6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS beta FROM (
   SELECT n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) AS k FROM (
    SELECT count(*)::DOUBLE AS n, avg(pow(e - m, 2)) AS m2, avg(pow(e - m, 3)) AS m3, avg(pow(e - m, 4)) AS m4
    FROM (SELECT y - fitted AS e, avg(y - fitted) OVER () AS m FROM pred))))))""", _fit_ctes() + "," + _PRED))
def residual_normality(spark, d):
    df, m = _fit(spark, d)
    table = ols.residual_normality(ols.ols_predict(df, ols.ols(m), "y"), "residual")
    return rounded(table, jarque_bera=3, omnibus=3)


@query("residual_bins", sql("line_model", """
SELECT fitted_bin, residual_bin, count(*) AS n FROM (
 SELECT CAST(least(floor((f - flo) / ((fhi - flo) / 20)), 19) AS INTEGER) AS fitted_bin,
        CAST(least(floor((e - elo) / ((ehi - elo) / 20)), 19) AS INTEGER) AS residual_bin
 FROM (SELECT price AS f, y - price AS e, min(price) OVER () AS flo, max(price) OVER () AS fhi,
         min(y - price) OVER () AS elo, max(y - price) OVER () AS ehi FROM line_model)) GROUP BY 1, 2"""))
def residual_bins(spark, d):
    """Residuals of a fixed prediction (the list price), so bin borders are the same bits."""
    scored = fx.line_model(spark, d).select(F.col("price").alias("fitted"), (F.col("y") - F.col("price")).alias("residual"))
    return charts.residual_bins(scored)


# --- selection ------------------------------------------------------------------------

def _subset_ctes(units, view="line_model", cols=None, y="y", keys=()) -> str:
    cols = cols or WCOLS
    p = len(cols)
    yy = g.cell(p, p)
    lead = "".join(f"{k}, " for k in keys)
    return ",\n".join([
        g.gram("gr", view, [*cols, y], list(keys)), g.all_subsets("subsets", units),
        "gs AS MATERIALIZED (SELECT * FROM gr, subsets)",
        g.sweep("fits", "gs", p, [*keys, "umask", "pmask", "k"], mask="pmask"),
        f"sse AS (SELECT {lead}umask, pmask, k, fits.{yy} AS sse, gr.a_0_0 AS n, gr.{yy} - pow(gr.a_0_{p}, 2) / gr.a_0_0 AS sst "
        f"FROM fits JOIN gr {'USING (' + ', '.join(keys) + ')' if keys else 'ON true'})",
    ])


def _metric_cte(criterion: str) -> str:
    weight = "2" if criterion == "AIC" else "ln(n)"
    return f"metric AS MATERIALIZED (SELECT umask, {weight} * k - 2 * {_LL} AS value FROM sse)"


def path_cte(method: str, n_units: int, enter: float, leave: float, leave_op: str) -> str:
    """Greedy path over subsets as a recursive CTE; ``waiting`` are the units left to try."""
    full = (1 << n_units) - 1
    order = f"range({n_units}) t(u)"
    if method == "backward":
        return f"""path AS (
 SELECT 0 AS step, {full} AS umask, {full} AS waiting, true AS live
 UNION ALL
 SELECT step + 1, CASE WHEN ok THEN nxt ELSE umask END, waiting & nxt, ok FROM (
  SELECT p.step, p.umask, p.waiting, c.nxt, c.value - m0.value {leave_op} {leave} AS ok
  FROM path p JOIN metric m0 ON m0.umask = p.umask JOIN LATERAL (
    SELECT m.umask AS nxt, m.value FROM {order} JOIN metric m ON m.umask = (p.umask & ~(1 << u::INT))
    WHERE (p.waiting >> u::INT) & 1 = 1 ORDER BY m.value, u LIMIT 1) c ON true WHERE p.live AND p.waiting > 0))"""
    removal = f"""
  SELECT f.step, f.umask, f.waiting, f.ok, CASE WHEN f.ok AND bit_count(f.umask) > 1 AND r.value - f.value {leave_op} {leave}
     THEN r.nxt ELSE f.umask END AS after
  FROM fwd f LEFT JOIN LATERAL (
    SELECT m.umask AS nxt, m.value FROM {order} JOIN metric m ON m.umask = (f.umask & ~(1 << u::INT))
    WHERE (f.umask >> u::INT) & 1 = 1 ORDER BY m.value, u LIMIT 1) r ON true""" if method == "stepwise" else \
        "SELECT f.step, f.umask, f.waiting, f.ok, f.umask AS after FROM fwd f"
    return f"""path AS (
 SELECT 0 AS step, 0 AS umask, {full} AS waiting, true AS live
 UNION ALL
 (WITH fwd AS (
  SELECT p.step + 1 AS step, CASE WHEN m0.value - c.value > {enter} THEN c.nxt ELSE p.umask END AS umask,
    p.waiting & ~(c.nxt & ~p.umask) AS waiting, m0.value - c.value > {enter} AS ok,
    CASE WHEN m0.value - c.value > {enter} THEN c.value ELSE m0.value END AS value
  FROM path p JOIN metric m0 ON m0.umask = p.umask JOIN LATERAL (
    SELECT m.umask AS nxt, m.value FROM {order} JOIN metric m ON m.umask = (p.umask | (1 << u::INT))
    WHERE (p.waiting >> u::INT) & 1 = 1 ORDER BY m.value, u LIMIT 1) c ON true WHERE p.live AND p.waiting > 0)
  SELECT step, after, waiting, ok FROM ({removal})))"""


def winner_sql(names: list[str]) -> str:
    picked = ", ".join(f"CASE WHEN (umask >> {i}) & 1 = 1 THEN '{n}' END" for i, n in enumerate(names))
    return f"concat_ws(',', {picked})"


OLS_STEPS = {"forward": (0, 0, "<"), "backward": (0, 0, "<="), "stepwise": (0, 0, "<")}


def _select_sql(method: str, criterion: str) -> str:
    body = f"""
SELECT {winner_sql(WUNIT_NAMES)} AS units, {R('value', 3)} AS value
FROM (SELECT umask FROM path ORDER BY step DESC LIMIT 1) JOIN metric USING (umask)"""
    ctes = ",\n".join([_subset_ctes(WUNITS), _metric_cte(criterion), path_cte(method, len(WUNITS), *OLS_STEPS[method])])
    return sql("line_model", body, ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def _register_selection(method: str, criterion: str) -> None:
    @query(f"select_{method}_{criterion.lower()}_ols", _select_sql(method, criterion))
    def run(spark, d):
        _, m = _fit(spark, d, WEAK)
        s = select.select_ols(m, method, criterion)
        return rounded(spark.createDataFrame([(",".join(s.spec.units), s.value)], "units string, value double"), 3)


for _m in select.METHODS:
    for _c in select.CRITERIA:
        _register_selection(_m, _c)


@query("selection_trace", sql("line_model", f"""
SELECT 'Forward AIC' AS model, 1 AS step, 'add' AS phase, list_extract({WUNIT_NAMES}, u::INT + 1) AS variable, {R('m.value', 3)} AS metric
FROM range({len(WUNITS)}) t(u) JOIN metric m ON m.umask = (1 << u::INT)""", _subset_ctes(WUNITS) + "," + _metric_cte("AIC")))
def selection_trace(spark, d):
    """First step of the forward run; later steps depend on the path."""
    _, m = _fit(spark, d, WEAK)
    trace = select.selection_trace(spark, [select.select_ols(m, "forward", "AIC")])
    return rounded(trace.where("step = 1").select("model", "step", "phase", "variable", "metric"), 3)


@query("run_selection_grid_ols", sql("line_model", " UNION ALL ".join(
    f"SELECT '{_m.capitalize()} {_c}' AS model, {winner_sql(WUNIT_NAMES)} AS units FROM "
    f"(SELECT umask FROM path_{_m}_{_c} ORDER BY step DESC LIMIT 1)" for _m in select.METHODS for _c in select.CRITERIA),
    ",\n".join([_subset_ctes(WUNITS)] + [
        (_metric_cte(_c) + ",\n" + path_cte(_m, len(WUNITS), *OLS_STEPS[_m]))
        .replace("metric", f"metric_{_m}_{_c}").replace("path", f"path_{_m}_{_c}")
        for _m in select.METHODS for _c in select.CRITERIA])).replace("WITH ", "WITH RECURSIVE ", 1))
def run_selection_grid_ols(spark, d):
    """All six selections from one moment matrix."""
    _, m = _fit(spark, d, WEAK)
    rows = [(s.name, ",".join(s.spec.units)) for s in select.run_grid_ols(m)]
    return spark.createDataFrame(rows, "model string, units string")


@query("information_criterion", sql("line_model", f"""
SELECT {winner_sql(WUNIT_NAMES)} AS units, {R(f'2 * k - 2 * {_LL}', 3)} AS aic, {R(f'ln(n) * k - 2 * {_LL}', 3)} AS bic FROM sse""",
    _subset_ctes(WUNITS)))
def information_criterion(spark, d):
    """Both criteria of all 64 sub-models."""
    _, m = _fit(spark, d, WEAK)
    rows = []
    for s in range(1 << len(WUNITS)):
        fit = ols.ols(m, WEAK.restrict(u for i, u in enumerate(WEAK.units) if s >> i & 1))
        rows.append((",".join(fit.design.spec.units), fit.criterion("AIC"), fit.criterion("BIC")))
    return rounded(spark.createDataFrame(rows, "units string, aic double, bic double"), 3)


@query("effect_sizes_ols", sql("line_model", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, {R('(r.sse - f.sse) / f.sst', 8)} AS r2_loss FROM sse f, sse r "
    f"WHERE f.umask = {2 ** len(UNITS) - 1} AND r.umask = {2 ** len(UNITS) - 1 - 2 ** i}" for i, n in enumerate(UNIT_NAMES)),
    _subset_ctes(UNITS, cols=COLS)))
def effect_sizes_ols(spark, d):
    _, m = _fit(spark, d)
    return rounded(evaluate.effect_sizes_ols(spark, m), 8)


@query("importance_bars", sql("line_model", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS variable, {R('(r.sse - f.sse) / f.sst', 8)} AS value FROM sse f, sse r "
    f"WHERE f.umask = {2 ** len(UNITS) - 1} AND r.umask = {2 ** len(UNITS) - 1 - 2 ** i}" for i, n in enumerate(UNIT_NAMES))
    + ") ORDER BY value DESC, variable LIMIT 3", _subset_ctes(UNITS, cols=COLS)))
def importance_bars(spark, d):
    _, m = _fit(spark, d)
    return rounded(charts.importance_bars(evaluate.effect_sizes_ols(spark, m), "r2_loss", 3), 8)


# --- cross-validation and decisions ---------------------------------------------------

CV_SPECS = {
    "Backward AIC": ModelSpec.of(["price", "disc", "tax"]), "Forward BIC": ModelSpec.of(["price", "disc"]),
    "Stepwise BIC": ModelSpec.of(["price", "disc", "tax"], ["flag"]),
}
CV_MASKS = {"Backward AIC": 0b00111, "Forward BIC": 0b00011, "Stepwise BIC": 0b11111}
CCOLS = ["1.0", "price", "disc", "tax", "(flag = 'N')::INT", "(flag = 'R')::INT"]
REPS = 3


def _cv_ctes() -> str:
    p = len(CCOLS)
    yy = g.cell(p, p)
    reps = " UNION ALL ".join(
        f"SELECT m.*, {r} AS rep, CAST(floor({uniform_sql('key', f'fold-{123 + r}')} * 5) AS INTEGER) AS fold FROM line_model m" for r in range(REPS))
    train = ", ".join(f"t.{g.cell(i, j)} - f.{g.cell(i, j)} AS {g.cell(i, j)}" for i, j in g.cells(p + 1))
    total = ", ".join(f"sum({g.cell(i, j)}) AS {g.cell(i, j)}" for i, j in g.cells(p + 1))
    masks = ", ".join(f"('{n}', {2 * m + 1})" for n, m in CV_MASKS.items())
    beta = lambda i: f"(CASE WHEN (s.pmask >> {i}) & 1 = 1 THEN s.{g.cell(i, p)} ELSE 0 END)"
    sse = f"f.{yy} - 2 * (" + " + ".join(f"{beta(i)} * f.{g.cell(i, p)}" for i in range(p)) + ") + " + " + ".join(
        f"{beta(i)} * {beta(j)} * f.{g.cell(i, j)}" for i in range(p) for j in range(p))
    return ",\n".join([
        f"reps AS MATERIALIZED ({reps})", g.gram("fg", "reps", [*CCOLS, "y"], ["rep", "fold"]),
        f"tot AS (SELECT rep, {total} FROM fg GROUP BY rep)", f"models(model, pmask) AS (VALUES {masks})",
        f"tg AS MATERIALIZED (SELECT f.rep, f.fold, model, pmask, {train} FROM fg f JOIN tot t USING (rep), models)",
        g.sweep("tf", "tg", p, ["rep", "fold", "model", "pmask"], mask="pmask"),
        f"cv AS MATERIALIZED (SELECT s.model, s.rep, s.fold, 1 - ({sse}) / (f.{yy} - pow(f.a_0_{p}, 2) / f.a_0_0) AS r2 "
        f"FROM tf s JOIN fg f ON f.rep = s.rep AND f.fold = s.fold)",
        "summ AS MATERIALIZED (SELECT model, count(*) AS n, avg(r2) AS mean, stddev_samp(r2) AS std, quantile_cont(r2, 0.5) AS median, "
        "min(r2) AS min, max(r2) AS max FROM cv GROUP BY model)",
    ])


def _cv_scores(spark, d):
    df = split.kfold_assign(fx.line_model(spark, d), "key", 5, REPS)
    return evaluate.repeated_cv_ols(df, CV_SPECS, "y", [f"fold_{r}" for r in range(REPS)])


@query("cv_ols", sql("line_model", f"SELECT model, rep, fold, {R('r2', 8)} AS r2 FROM cv WHERE model = 'Backward AIC' AND rep = 0", _cv_ctes()))
def cv_ols(spark, d):
    df = split.kfold_assign(fx.line_model(spark, d), "key", 5, 1)
    return rounded(evaluate.cv_ols(df, CV_SPECS["Backward AIC"], "y", "fold_0", "Backward AIC"), 8)


@query("repeated_cv_ols", sql("line_model", f"SELECT model, rep, fold, {R('r2', 8)} AS r2 FROM cv", _cv_ctes()))
def repeated_cv_ols(spark, d):
    return rounded(_cv_scores(spark, d), 8)


_SUMM = ", ".join(f"{R(c, 8)} AS {c}" for c in ("mean", "std", "median", "min", "max"))


@query("score_summary", sql("line_model", f"SELECT model, n, {_SUMM} FROM summ", _cv_ctes()))
def score_summary(spark, d):
    return rounded(evaluate.score_summary(_cv_scores(spark, d)), 8)


@query("pick_winner_ols", sql("line_model", f"""
SELECT model, n, {_SUMM} FROM summ WHERE (SELECT max(mean) FROM summ) - mean <= 0.0002
ORDER BY contains(model, 'BIC') DESC, summ.mean DESC LIMIT 1""", _cv_ctes()))
def pick_winner_ols(spark, d):
    return rounded(decide.pick_winner_ols(evaluate.score_summary(_cv_scores(spark, d))), 8)


@query("union_scores", sql("line_model", f"SELECT model, rep, fold, {R('r2', 8)} AS r2 FROM cv WHERE rep = 0 AND model <> 'Forward BIC'", _cv_ctes()))
def union_scores(spark, d):
    df = split.kfold_assign(fx.line_model(spark, d), "key", 5, 1)
    names = ["Backward AIC", "Stepwise BIC"]
    return rounded(schema.union_scores([evaluate.cv_ols(df, CV_SPECS[n], "y", "fold_0", n) for n in names]), 8)


def _comparison_ctes() -> str:
    p = len(CCOLS)
    xb = " + ".join(f"(CASE WHEN (s.pmask >> {i}) & 1 = 1 THEN s.{g.cell(i, p)} ELSE 0 END) * ({CCOLS[i]})" for i in range(p))
    masks = ", ".join(
        f"('{n}', {2 * m + 1}, {len(CV_SPECS[n].cont)}, {len(CV_SPECS[n].categ)})" for n, m in CV_MASKS.items())
    return ",\n".join([
        "tr AS (SELECT * FROM line_split WHERE split = 'train')", g.gram("gr", "tr", [*CCOLS, "y"]),
        f"models(model, pmask, n_cont, n_categ) AS (VALUES {masks})", "gm AS (SELECT * FROM gr, models)",
        g.sweep("fits", "gm", p, ["model", "pmask", "n_cont", "n_categ"], mask="pmask"),
        f"scored AS (SELECT s.model, n_cont, n_categ, bit_count(pmask) AS k, split, y, {xb} AS fitted FROM line_split, fits s)",
        "r AS (SELECT model, n_cont, n_categ, k, split, 1 - sum(pow(y - fitted, 2)) / (var_pop(y) * count(*)) AS r2 FROM scored GROUP BY ALL)",
        "comparison AS (SELECT a.model, a.r2 AS r2_train, b.r2 AS r2_test, CAST(a.k AS INTEGER) AS n_params, a.n_cont, a.n_categ "
        "FROM r a JOIN r b ON a.model = b.model AND a.split = 'train' AND b.split = 'test')",
    ])


@query("model_comparison_ols", sql("line_split", f"""
SELECT model, {R('r2_train', 8)} AS r2_train, {R('r2_test', 8)} AS r2_test, n_params, n_cont, n_categ, 0 AS n_inter FROM comparison""",
    _comparison_ctes()))
def model_comparison_ols(spark, d):
    df = split.train_test_split(fx.line_model(spark, d), "key")
    return rounded(evaluate.model_comparison_ols(df, CV_SPECS, "y"), 8)


@query("complexity_vs_score", sql("line_split", f"""
SELECT model, CASE WHEN contains(model, 'AIC') THEN 'AIC' WHEN contains(model, 'BIC') THEN 'BIC' END AS criterion, n_params,
  {R('r2_test', 8)} AS score FROM comparison""", _comparison_ctes()))
def complexity_vs_score(spark, d):
    df = split.train_test_split(fx.line_model(spark, d), "key")
    return rounded(charts.complexity_vs_score(evaluate.model_comparison_ols(df, CV_SPECS, "y")), 8)


@query("order_report", sql("line_split", f"""
SELECT model, n_params, {R('r2_test', 8)} AS r2_test FROM comparison ORDER BY n_params DESC, model LIMIT 2""", _comparison_ctes()))
def order_report(spark, d):
    df = split.train_test_split(fx.line_model(spark, d), "key")
    table = evaluate.model_comparison_ols(df, CV_SPECS, "y").select("model", "n_params", "r2_test")
    return rounded(decide.head_k(table, [("n_params", False), ("model", True)], 2), 8)


@query("lookup_model_by_name", sql("line_split", "SELECT model, n_params FROM comparison WHERE model = 'Stepwise BIC'", _comparison_ctes()))
def lookup_model_by_name(spark, d):
    df = split.train_test_split(fx.line_model(spark, d), "key")
    return schema.lookup_by_name(evaluate.model_comparison_ols(df, CV_SPECS, "y"), "Stepwise BIC").select("model", "n_params")


@query("lookup_winner", sql("line_split", """
SELECT model, n_params FROM comparison ORDER BY r2_test DESC, n_params, model LIMIT 1""", _comparison_ctes()))
def lookup_winner(spark, d):
    df = split.train_test_split(fx.line_model(spark, d), "key")
    table = evaluate.model_comparison_ols(df, CV_SPECS, "y")
    return schema.lookup_winner(table, table.limit(1)).select("model", "n_params")


@query("box_stats_scores", sql("line_model", f"""
SELECT model, {R('q1', 8)} AS q25, {R('q2', 8)} AS median, {R('q3', 8)} AS q75, count(*) AS n,
  {R('min(r2) FILTER (r2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 8)} AS whisker_low,
  {R('max(r2) FILTER (r2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 8)} AS whisker_high,
  count(*) FILTER (r2 NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM cv JOIN (SELECT model, quantile_cont(r2, 0.25) AS q1, quantile_cont(r2, 0.5) AS q2, quantile_cont(r2, 0.75) AS q3
  FROM cv GROUP BY model) USING (model) GROUP BY model, q1, q2, q3""", _cv_ctes()))
def box_stats_scores(spark, d):
    return rounded(charts.score_box(_cv_scores(spark, d)), 8)


@query("coef_subset", sql("line_model", f"""
SELECT 'price' AS variable, {R(f'{g.cell(1, P)}')} AS coef, 'continuous' AS kind FROM fit UNION ALL
SELECT 'flag_R', {R(f'{g.cell(6, P)}')}, 'categorical' FROM fit""", _fit_ctes()))
def coef_subset(spark, d):
    table = ols.ols_fit(fx.line_model(spark, d), SPEC, "y").coefficients_table(spark).select("variable", "coef")
    return rounded(evaluate.coef_subset(table, {"continuous": ["price"], "categorical": ["flag_R"]}))


@query("top_coefficients", sql("line_model", "SELECT variable, " + R("coef") + " AS coef, " + R("abs(coef)") + " AS abs_coef FROM (" + _coef_rows(
    NAMES[1:], lambda i, n: f"SELECT '{n}' AS variable, fit.{g.cell(i + 1, P)} AS coef FROM fit") + ") ORDER BY abs(coef) DESC, variable LIMIT 3",
    _fit_ctes()))
def top_coefficients(spark, d):
    table = ols.ols_fit(fx.line_model(spark, d), SPEC, "y").coefficients_table(spark)
    return rounded(evaluate.top_coefficients(table, 3))


@query("significance_code", sql("event_model", """
SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS code
FROM (SELECT event_id, value / 1000 AS p FROM event_model)"""))
def significance(spark, d):
    return fx.event_model(spark, d).select("event_id", significance_code(F.col("value") / 1000).alias("code"))


@query("model_roundtrip", sql("line_model", f"SELECT key, {R('fitted', 3)} AS fitted FROM pred", _fit_ctes() + "," + _PRED))
def model_roundtrip(spark, d):
    """Fit, save, reload by name, score."""
    df, m = _fit(spark, d)
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = tempfile.mkdtemp(prefix="veta-out-") if base is None else f"{base}/veta-{uuid.uuid4().hex}"
    models.save_models(spark, {"full": ols.ols(m)}, path)
    return rounded(df.select("key", models.load_model(spark, path, "full").predict(df).alias("fitted")), 3)
