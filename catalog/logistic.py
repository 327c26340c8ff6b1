"""Logistic model queries: fits, selection, ROC, cuts and the choice of a winner."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.operators import charts, decide, evaluate, logit, select, split
from veta.operators.design import ModelSpec

from . import fixtures as fx
from . import sqlgen as g
from .assoc import STRAT_FOLDS
from .base import R, query, rounded, uniform_sql
from .fixtures import sql
from .linear import path_cte, winner_sql

SPEC = ModelSpec.of(["letters", "punct", "digits"], ["lang"])
COLS = ["1.0", "letters", "punct", "digits", "(lang = 'en')::INT", "(lang = 'es')::INT", "(lang = 'fr')::INT"]
NAMES = ["const", "letters", "punct", "digits", "lang_en", "lang_es", "lang_fr"]
UNITS = [[1], [2], [3], [4, 5, 6]]
UNIT_NAMES = ["letters", "punct", "digits", "lang"]
P = len(COLS)
FULL = (1 << P) - 1
STEPS = 14


def _eta(alias: str = "w") -> str:
    return " + ".join(f"{alias}.w_{i} * ({COLS[i]})" for i in range(P))


def _newton(view: str = "doc_model", y: str = "quality", l2: float = 1.0) -> str:
    return g.newton("nw", view, COLS, y, STEPS, l2, "(SELECT 0 AS model, -1 AS pmask)")


_PRED = f"pred AS (SELECT d.*, 1.0 / (1.0 + exp(-({_eta('nw')}))) AS p FROM doc_model d, nw)"
_LL = "sum(quality * ln(p) + (1 - quality) * ln(1 - p))"


def _fit(spark, d):
    df = fx.doc_table(spark, d)
    return df, logit.logit_fit(df, SPEC, "quality")


@query("logit_fit", sql("doc_model", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, {R(f'w_{i}')} AS coef FROM nw" for i, n in enumerate(NAMES)), _newton()))
def logit_fit(spark, d):
    _, fit = _fit(spark, d)
    return rounded(spark.createDataFrame(list(fit.coefficients.items()), "variable string, coef double"))


@query("logit_fit_scaled", sql("line_model", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, {R(f'w_{i}', 5)} AS coef FROM nw" for i, n in enumerate(["const", "price", "disc", "flag_N", "flag_R"])),
    "noisy AS (SELECT *, round(price + 15 * sin(lineno * 7.0 + qty), 3) AS px FROM line_model),"
    + g.newton("nw", "noisy", ["1.0", "px", "disc", "(flag = 'N')::INT", "(flag = 'R')::INT"], "yb", 12, 1.0)))
def logit_fit_scaled(spark, d):
    """All line items, with the price blurred so that the classes overlap."""
    blurred = F.round(F.col("price") + 15 * F.sin(F.col("lineno") * 7.0 + F.col("qty")), 3)
    df = fx.line_model(spark, d).withColumn("price", blurred)
    fit = logit.logit_fit(df, ModelSpec.of(["price", "disc"], ["flag"]), "yb")
    return rounded(spark.createDataFrame(list(fit.coefficients.items()), "variable string, coef double"), 5)


@query("logit_predict", sql("doc_model", f"SELECT doc_id, {R('p')} AS p FROM pred", _newton() + "," + _PRED))
def logit_predict(spark, d):
    df, fit = _fit(spark, d)
    return rounded(logit.logit_predict(df, fit).select("doc_id", "p"))


@query("logit_loglik", sql("doc_model", f"SELECT count(*) AS n, {R(_LL)} AS log_lik FROM pred", _newton() + "," + _PRED))
def logit_loglik(spark, d):
    df, fit = _fit(spark, d)
    return rounded(logit.logit_loglik(logit.logit_predict(df, fit), "quality"))


_NULL = "count(*) * (avg(quality) * ln(avg(quality)) + (1 - avg(quality)) * ln(1 - avg(quality)))"


@query("pseudo_r2", sql("doc_model", f"""
SELECT lang, count(*) AS n, {R(_LL)} AS log_lik, {R(_NULL)} AS log_lik_null, {R(f'1 - {_LL} / ({_NULL})')} AS pseudo_r2
FROM pred GROUP BY lang""", _newton() + "," + _PRED))
def pseudo_r2(spark, d):
    df, fit = _fit(spark, d)
    return rounded(logit.pseudo_r2(logit.logit_predict(df, fit), "quality", by=["lang"]))


@query("logit_summary", sql("doc_model", f"""
SELECT variable, {R('w')} AS estimate, {R('se')} AS std_err, {R('w / se')} AS z, {R('p_value')} AS p_value, {g.stars('p_value')} AS signif
FROM (SELECT *, {g.t_tail('w / se', 'df')} AS p_value FROM ({" UNION ALL ".join(
    f"SELECT '{'(Intercept)' if i == 0 else n}' AS variable, w_{i} AS w, sqrt(-inv.{g.cell(i, i)}) AS se, (SELECT count(*)::DOUBLE - {P - 1} FROM doc_model) AS df "
    f"FROM nw, inv" for i, n in enumerate(NAMES))}))""",
    _newton() + "," + _PRED + ", weighted AS (SELECT *, sqrt(p * (1 - p)) AS v FROM pred),"
    + g.gram("info", "weighted", [*[f"v * ({c})" for c in COLS], "0.0"]) + "," + g.sweep("inv", "info", P)))
def logit_summary(spark, d):
    _, fit = _fit(spark, d)
    return rounded(fit.summary(spark))


@query("logit_goodness_reference", sql("doc_model", f"""
SELECT count(*) AS n, {P} AS n_params, {R(_LL)} AS log_lik, {R(f'2 * 2 - 2 * {_LL}')} AS aic, {R(f'ln(count(*)) * 2 - 2 * {_LL}')} AS bic FROM pred""",
    _newton() + "," + _PRED))
def logit_goodness_reference(spark, d):
    """Criteria that count two parameters for every model."""
    _, fit = _fit(spark, d)
    return rounded(fit.goodness(spark, "reference"))


@query("logit_goodness", sql("doc_model", f"""
SELECT count(*) AS n, {P} AS n_params, {R(_LL)} AS log_lik, {R(f'2 * {P} - 2 * {_LL}')} AS aic,
  {R(f'ln(count(*)) * {P} - 2 * {_LL}')} AS bic FROM pred""", _newton() + "," + _PRED))
def logit_goodness(spark, d):
    _, fit = _fit(spark, d)
    return rounded(fit.goodness(spark))


@query("logit_coefficients", sql("doc_model", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, {R('w_0')} AS intercept, {R(f'w_{i}')} AS coef FROM nw" for i, n in enumerate(NAMES) if i), _newton()))
def logit_coefficients(spark, d):
    _, fit = _fit(spark, d)
    return rounded(fit.coefficients_table(spark))


# --- selection ------------------------------------------------------------------------

def _subset_ctes() -> str:
    """Penalised fits of all 16 sub-models, side by side."""
    return ",\n".join([
        g.all_subsets("subsets", UNITS),
        g.newton("nw", "doc_model", COLS, "quality", STEPS, 1.0, "(SELECT umask AS model, pmask FROM subsets)", mask="pmask"),
        f"ll AS MATERIALIZED (SELECT w.model AS umask, w.pmask, count(*) AS n, sum(quality * ({_eta()}) - ln(1 + exp({_eta()}))) AS ll, "
        f"avg(quality) AS share FROM doc_model, nw w GROUP BY 1, 2)",
    ])


def _metric(criterion: str) -> str:
    weight = "2" if criterion == "AIC" else "ln(n)"
    return (
        f"metric AS MATERIALIZED (SELECT umask, {weight} * bit_count(pmask) - 2 * CASE WHEN umask = 0 THEN "
        f"n * (share * ln(share) + (1 - share) * ln(1 - share)) ELSE ll END AS value FROM ll)"
    )


_RULES = {"forward": (3, 0, "<"), "backward": (0, 10, "<="), "stepwise": (5, 5, "<")}


def _select_sql(method: str, criterion: str) -> str:
    body = f"""
SELECT {winner_sql(UNIT_NAMES)} AS units, {R('value', 4)} AS value
FROM (SELECT umask FROM path ORDER BY step DESC LIMIT 1) JOIN metric USING (umask)"""
    ctes = ",\n".join([_subset_ctes(), _metric(criterion), path_cte(method, len(UNITS), *_RULES[method])])
    return sql("doc_model", body, ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def _register_selection(method: str, criterion: str) -> None:
    @query(f"select_{method}_{criterion.lower()}_logit", _select_sql(method, criterion))
    def run(spark, d):
        data = logit.logit_data(fx.doc_model(spark, d), SPEC, "quality")
        s = select.select_logit(data, method, criterion)
        return rounded(spark.createDataFrame([(",".join(s.spec.units), s.value)], "units string, value double"), 4)


for _m in select.METHODS:
    for _c in select.CRITERIA:
        _register_selection(_m, _c)


@query("run_selection_grid_logit", sql("doc_model", " UNION ALL ".join(
    f"SELECT '{_m.capitalize()} {_c}' AS model, {winner_sql(UNIT_NAMES)} AS units FROM "
    f"(SELECT umask FROM path_{_m}_{_c} ORDER BY step DESC LIMIT 1)" for _m in select.METHODS for _c in select.CRITERIA),
    ",\n".join([_subset_ctes()] + [
        (_metric(_c) + ",\n" + path_cte(_m, len(UNITS), *_RULES[_m]))
        .replace("metric", f"metric_{_m}_{_c}").replace("path", f"path_{_m}_{_c}")
        for _m in select.METHODS for _c in select.CRITERIA])).replace("WITH ", "WITH RECURSIVE ", 1))
def run_selection_grid_logit(spark, d):
    """All six selections on one staged design; a model visited twice is fitted once."""
    data = logit.logit_data(fx.doc_model(spark, d), SPEC, "quality")
    rows = [(s.name, ",".join(s.spec.units)) for s in select.run_grid_logit(data)]
    return spark.createDataFrame(rows, "model string, units string")


_FULL_UNITS = (1 << len(UNITS)) - 1


@query("effect_sizes_logit", sql("doc_model", " UNION ALL ".join(
    f"SELECT '{n}' AS variable, {R('(r.ll - f.ll) / (f.n * (f.share * ln(f.share) + (1 - f.share) * ln(1 - f.share)))')} AS r2_loss "
    f"FROM ll f, ll r WHERE f.umask = {_FULL_UNITS} AND r.umask = {_FULL_UNITS - (1 << i)}" for i, n in enumerate(UNIT_NAMES)),
    _subset_ctes()))
def effect_sizes_logit(spark, d):
    data = logit.logit_data(fx.doc_model(spark, d), SPEC, "quality")
    return rounded(evaluate.effect_sizes_logit(data))


# --- validation -----------------------------------------------------------------------

_AUC_SQL = "(sum(rk * t) - sum(t) * (sum(t) + 1) / 2) / (sum(t) * sum(1 - t))"


def _avg_rank(partition: str, score: str = "p") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return (
        f"rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {partition + ', ' if partition else ''}{score}) - 1) / 2.0"
    )


@query("cv_logit_auc", sql("doc_model", f"""
SELECT fold, CAST(sum(t) AS BIGINT) AS positives, CAST(sum(1 - t) AS BIGINT) AS negatives, {R(_AUC_SQL)} AS auc FROM (
  SELECT fold, quality AS t, {_avg_rank('fold')} AS rk FROM (
    SELECT d.fold, d.quality, {_eta('nw')} AS p FROM dm d JOIN nw ON nw.model = d.fold)) GROUP BY fold""",
    STRAT_FOLDS + ", dm AS MATERIALIZED (SELECT doc_model.*, folded.fold FROM doc_model JOIN folded USING (doc_id)),"
    + g.newton("nw", "dm", COLS, "quality", STEPS, 1.0, "(SELECT f::INT AS model, -1 AS pmask FROM range(5) t(f))",
               where="s.fold <> w.model")))
def cv_logit_auc(spark, d):
    df = split.stratified_kfold(fx.doc_table(spark, d), "doc_id", "quality")
    return rounded(evaluate.cv_logit_auc(df, SPEC, "quality", "fold"))


@query("roc_curve", sql("doc_scored", f"""
SELECT 'Infinity'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL
SELECT p, {R('sum(sum(1 - y)) OVER (ORDER BY p DESC) / (SELECT sum(1 - y) FROM doc_scored)')},
  {R('sum(sum(y)) OVER (ORDER BY p DESC) / (SELECT sum(y) FROM doc_scored)')} FROM doc_scored GROUP BY p"""))
def roc_curve(spark, d):
    return rounded(evaluate.roc_curve(fx.doc_scored(spark, d), "y"))


@query("roc_auc", sql("doc_scored", f"""
SELECT CAST(sum(t) AS BIGINT) AS positives, CAST(sum(1 - t) AS BIGINT) AS negatives, {R(_AUC_SQL)} AS auc
FROM (SELECT y AS t, {_avg_rank('')} AS rk FROM doc_scored)"""))
def roc_auc(spark, d):
    return rounded(evaluate.roc_auc(fx.doc_scored(spark, d), "y"))


@query("confusion_matrix", sql("doc_scored", """
SELECT count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp FROM doc_scored"""))
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(fx.doc_scored(spark, d), "y")


def _rates(extra: str = "") -> str:
    return f"""{R('(tp + tn) / (tn + fp + fn + tp)')} AS accuracy, {R('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END')} AS sensitivity,
  {R('CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END')} AS specificity"""


_YOUDEN = "tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1"


@query("cutoff_metrics", sql("doc_scored", f"""
SELECT 0.65::DOUBLE AS cut, {_rates()}, {R('tp / nullif(tp + fp, 0)')} AS ppv, {R('tn / nullif(tn + fn, 0)')} AS npv FROM (
SELECT count(*) FILTER (y = 0 AND p <= 0.65) AS tn, count(*) FILTER (y = 0 AND p > 0.65) AS fp,
  count(*) FILTER (y = 1 AND p <= 0.65) AS fn, count(*) FILTER (y = 1 AND p > 0.65) AS tp FROM doc_scored)"""))
def cutoff_metrics(spark, d):
    return rounded(evaluate.cutoff_metrics(fx.doc_scored(spark, d), "y", 0.65))


_SWEEP = """
cuts AS (SELECT round(0.1 + i * (0.9 - 0.1) / 80, 10) AS cut FROM range(81) t(i)),
cells AS (SELECT cut, count(*) FILTER (y = 0 AND p < cut) AS tn, count(*) FILTER (y = 0 AND p >= cut) AS fp,
  count(*) FILTER (y = 1 AND p < cut) AS fn, count(*) FILTER (y = 1 AND p >= cut) AS tp FROM doc_scored, cuts GROUP BY cut)"""


@query("cutoff_sweep", sql("doc_scored", f"SELECT cut, {_rates()}, {R(_YOUDEN)} AS youden FROM cells", _SWEEP))
def cutoff_sweep(spark, d):
    return rounded(evaluate.cutoff_sweep(fx.doc_scored(spark, d), "y"), cut=10)


_BEST = f"""(SELECT 'accuracy' AS criterion, cut, {_rates()}, {R(_YOUDEN)} AS youden FROM cells
   ORDER BY (tp + tn) / (tn + fp + fn + tp) DESC, cut LIMIT 1)
UNION ALL (SELECT 'youden', cut, {_rates()}, {R(_YOUDEN)} FROM cells ORDER BY {_YOUDEN} DESC, cut LIMIT 1)"""


@query("optimal_cutoff", sql("doc_scored", _BEST, _SWEEP))
def optimal_cutoff(spark, d):
    return rounded(evaluate.optimal_cutoff(evaluate.cutoff_sweep(fx.doc_scored(spark, d), "y")), cut=10)


@query("arg_max_row", sql("doc_scored", f"SELECT cut, {R(_YOUDEN)} AS youden FROM cells ORDER BY {_YOUDEN} DESC, cut LIMIT 1", _SWEEP))
def arg_max_row(spark, d):
    sweep = evaluate.cutoff_sweep(fx.doc_scored(spark, d), "y")
    return rounded(evaluate.arg_max_row(sweep, "youden", "cut").select("cut", "youden"), cut=10)


@query("final_evaluation", sql("doc_scored", f"""
SELECT cut, {_rates()}, {R(_YOUDEN)} AS youden, tn, fp, fn, tp, 3 AS n_params FROM cells WHERE cut = 0.5""", _SWEEP))
def final_evaluation(spark, d):
    return rounded(evaluate.final_evaluation(fx.doc_scored(spark, d), "y", 0.5, 3), cut=10)


@query("cutoff_lines", sql("doc_scored", f"""
SELECT cells.cut, 'accuracy' AS measure, {R('(tp + tn) / (tn + fp + fn + tp)')} AS value, cells.cut = best.cut AS chosen
FROM cells, (SELECT cut FROM best WHERE criterion = 'accuracy') best
UNION ALL SELECT cells.cut, 'youden', {R(_YOUDEN)}, cells.cut = best.cut FROM cells, (SELECT cut FROM best WHERE criterion = 'youden') best""",
    _SWEEP + f", best AS ({_BEST})"))
def cutoff_lines(spark, d):
    sweep = evaluate.cutoff_sweep(fx.doc_scored(spark, d), "y")
    return rounded(charts.cutoff_lines(sweep, evaluate.optimal_cutoff(sweep)), cut=10)


@query("accuracy_train_test", sql("doc_scored", f"""
SELECT lang, count(*) AS n, {R('avg(CAST((p >= 0.5) = (y = 1) AS INTEGER))')} AS accuracy FROM doc_scored GROUP BY lang"""))
def accuracy_train_test(spark, d):
    return rounded(evaluate.accuracy_by(fx.doc_scored(spark, d), "y", by="lang"))


@query("accuracy_by_split", sql("doc_scored", f"""
SELECT CASE WHEN {uniform_sql("doc_id", "split-123")} < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
  {R('avg(CAST((p >= 0.5) = (y = 1) AS INTEGER))')} AS accuracy FROM doc_scored GROUP BY 1"""))
def accuracy_by_split(spark, d):
    """Accuracy on the train and on the test part."""
    return rounded(evaluate.accuracy_by(split.train_test_split(fx.doc_scored(spark, d), "doc_id"), "y", by="split"))


# --- comparison and winner ------------------------------------------------------------

MODELS = {
    "Backward AIC": ModelSpec.of(["letters", "punct", "digits"], ["lang"]), "Forward BIC": ModelSpec.of(["letters", "punct"]),
    "Stepwise BIC": ModelSpec.of(["letters"]), "Forward AIC": ModelSpec.of(["punct"], ["lang"]),
}
_MASKS = {"Backward AIC": 0b1111111, "Forward BIC": 0b0000111, "Stepwise BIC": 0b0000011, "Forward AIC": 0b1110101}

_PART_LL = "sum(quality * ln(p) + (1 - quality) * ln(1 - p))"
_COMPARISON = ",\n".join([
    f"""ds AS MATERIALIZED (SELECT *, CASE WHEN {fx.uniform_sql('doc_id', 'split-123')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM doc_model)""",
    "tr AS MATERIALIZED (SELECT * FROM ds WHERE split = 'train')",
    "models(model, pmask, n_cont, n_categ) AS (VALUES " + ", ".join(
        f"('{n}', {_MASKS[n]}, {len(s.cont)}, {len(s.categ)})" for n, s in MODELS.items()) + ")",
    g.newton("nw", "tr", COLS, "quality", STEPS, 1.0, "models", mask="pmask"),
    f"""parts AS MATERIALIZED (SELECT model, split, pmask, 1 - {_PART_LL} / ({_NULL}) AS pr2,
      avg(CAST((p >= 0.5) = (quality = 1) AS INTEGER)) AS acc
   FROM (SELECT ds.*, w.model, w.pmask, 1.0 / (1.0 + exp(-({_eta()}))) AS p FROM ds, nw w) GROUP BY model, split, pmask)""",
    """comparison AS MATERIALIZED (SELECT a.model, a.pr2 AS pseudo_r2_train, b.pr2 AS pseudo_r2_test, a.acc AS acc_train, b.acc AS acc_test,
     CAST(bit_count(a.pmask) AS INTEGER) AS n_params, n_cont, n_categ
   FROM parts a JOIN parts b ON a.model = b.model AND a.split = 'train' AND b.split = 'test' JOIN models ON models.model = a.model)""",
    """gaps AS (SELECT *, abs(acc_train - acc_test) AS gap FROM comparison),
candidates AS MATERIALIZED (SELECT * FROM gaps WHERE gap < 0.05 OR NOT EXISTS (SELECT 1 FROM gaps WHERE gap < 0.05)
  ORDER BY pseudo_r2_test DESC, n_params, model LIMIT 4)""",
])
_CMP_COLS = ", ".join(f"{R(c)} AS {c}" for c in ("pseudo_r2_train", "pseudo_r2_test", "acc_train", "acc_test")) + ", n_params, n_cont, n_categ"


def _comparison(spark, d):
    df = split.train_test_split(fx.doc_table(spark, d), "doc_id")
    return evaluate.model_comparison_logit(df, MODELS, "quality")


@query("model_comparison_logit", sql("doc_model", f"SELECT model, {_CMP_COLS} FROM comparison", _COMPARISON))
def model_comparison_logit(spark, d):
    return rounded(_comparison(spark, d))


@query("stable_candidates", sql("doc_model", f"SELECT model, {_CMP_COLS}, {R('gap')} AS gap FROM candidates", _COMPARISON))
def stable_candidates(spark, d):
    return rounded(decide.stable_candidates(_comparison(spark, d)))


@query("pick_winner_logit", sql("doc_model", f"""
SELECT model, {_CMP_COLS}, {R('gap')} AS gap FROM pool ORDER BY pool.n_params, contains(model, 'BIC') DESC, pool.pseudo_r2_test DESC, model LIMIT 1""",
    _COMPARISON + """, top AS (SELECT max(acc_test) AS acc, max(pseudo_r2_test) AS pr2 FROM candidates),
tied AS (SELECT c.* FROM candidates c, top WHERE c.acc_test >= top.acc - 1e-12 AND c.pseudo_r2_test >= top.pr2 - 1e-4),
pool AS (SELECT * FROM tied UNION ALL SELECT * FROM candidates WHERE NOT EXISTS (SELECT 1 FROM tied))"""))
def pick_winner_logit(spark, d):
    return rounded(decide.pick_winner_logit(decide.stable_candidates(_comparison(spark, d))))
