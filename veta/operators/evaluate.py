"""Validation, thresholds, comparison tables and effect sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cumulative import running_totals
from ..functions.scalars import interval_index
from ..functions.tables import report
from .design import DesignSpec, ModelSpec
from .logit import Candidate, LogitData, fit_many, log_lik_term, logit_data, null_log_lik
from .moments import Moments, moments, solve
from .ols import r2_on

SCORE_SCHEMA = "model string, rep int, fold int, r2 double"


def union_spec(specs: Iterable[ModelSpec]) -> ModelSpec:
    """The smallest spec that holds every unit of the given ones."""
    cont, categ, inter = {}, {}, {}
    for s in specs:
        cont |= dict.fromkeys(s.cont)
        categ |= dict.fromkeys(s.categ)
        inter |= dict.fromkeys(s.inter)
    return ModelSpec.of(cont, categ, inter)


def repeated_cv_ols(df: DataFrame, specs: dict[str, ModelSpec], y: str, folds: Iterable[str]) -> DataFrame:
    """Test R2 per model, repetition and fold from one pass over the rows.

    Each fold has its own moment matrix; its training matrix is the total minus it.
    """
    folds = list(folds)
    m = moments(df, DesignSpec.fit(df, union_spec(specs.values())), y, folds)
    total = m.total(folds[0])
    rows = []
    for name, spec in specs.items():
        for rep, f in enumerate(folds):
            for cell in m.cells(f):
                held = m.grams[(f, cell)]
                rows.append((name, rep, int(cell), r2_on(m, spec, total - held, held)))
    return report(df.sparkSession, rows, SCORE_SCHEMA)


def cv_ols(df: DataFrame, spec: ModelSpec, y: str, fold: str, name: str = "model") -> DataFrame:
    return repeated_cv_ols(df, {name: spec}, y, [fold])


def score_summary(scores: DataFrame, model: str = "model", score: str = "r2") -> DataFrame:
    """Per model: count, mean, std, median, min, max, best mean first."""
    return (
        scores.groupBy(F.col(model).alias("model")).agg(
            F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
            F.median(score).alias("median"), F.min(score).alias("min"), F.max(score).alias("max"),
        ).orderBy(F.desc("mean"), "model")
    )


def cv_logit_auc(df: DataFrame, spec: ModelSpec, y: str, fold: str, l2: float = 1.0) -> DataFrame:
    """ROC AUC of every fold; all fold models are fitted in the same passes."""
    data = logit_data(df, spec, y, fold)
    folds = sorted(data.fold_rows)
    fits = fit_many(data, [Candidate(spec, left_out=f) for f in folds], l2, quick=True)
    each = data.probabilities(fits)
    p = None
    for i, f in enumerate(folds):
        mine = F.col("fold") == f
        p = F.when(mine, F.col(f"p{i}")) if p is None else p.when(mine, F.col(f"p{i}"))
    return roc_auc(each.select("fold", "y", p.alias("p")), "y", "p", ["fold"])


def _score_counts(scored: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    # no filter on the score: pushed below its projection, it would compute scores twice
    known = F.col(p).isNotNull()
    return scored.groupBy(*by, (-F.col(p)).alias("_down")).agg(
        F.count_if(known & (F.col(y) == 1)).alias("pos"), F.count_if(known & (F.col(y) == 0)).alias("neg")
    ).where(F.col("pos") + F.col("neg") > 0)


def _score_groups(counted: DataFrame, by: list[str]) -> DataFrame:
    """Counts per score, accumulated from the highest down."""
    return running_totals(counted, "_down", ["pos", "neg"], by)


def roc_curve(scored: DataFrame, y: str, p: str = "p") -> DataFrame:
    """False and true positive rates at every distinct score, plus the origin."""
    groups = _score_groups(_score_counts(scored, y, p, []), [])
    row = groups.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    curve = groups.select(
        (-F.col("_down")).alias("threshold"),
        (F.col("cum_neg") / F.lit(float(row["neg"] or 0) or None)).alias("fpr"),
        (F.col("cum_pos") / F.lit(float(row["pos"] or 0) or None)).alias("tpr"),
    )
    origin = report(scored.sparkSession, [(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(curve)


def roc_auc(scored: DataFrame, y: str, p: str = "p", by: Iterable[str] = ()) -> DataFrame:
    """Share of positive-negative pairs ranked right, ties counting half."""
    by = list(by)
    groups = _score_groups(_score_counts(scored, y, p, by), by)
    pairs = F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") * 0.5)
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return groups.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.try_divide(F.sum(pairs), pos * neg).alias("auc"),
    )


def _positive(p: Column, cut: float, inclusive: bool) -> Column:
    return p >= F.lit(cut) if inclusive else p > F.lit(cut)


def confusion_matrix(
    scored: DataFrame, y: str, p: str = "p", cut: float = 0.5, inclusive: bool = True, by: Iterable[str] = ()
) -> DataFrame:
    yes, one = _positive(F.col(p), cut, inclusive), F.col(y) == 1
    return scored.groupBy(*by).agg(
        F.count_if(~one & ~yes).alias("tn"), F.count_if(~one & yes).alias("fp"),
        F.count_if(one & ~yes).alias("fn"), F.count_if(one & yes).alias("tp"),
    )


def rates(cells: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, specificity, predictive values and Youden from tn fp fn tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return cells.withColumns({
        "accuracy": F.try_divide(tp + tn, tn + fp + fn + tp), "sensitivity": sens, "specificity": spec,
        "ppv": F.try_divide(tp, tp + fp), "npv": F.try_divide(tn, tn + fn), "youden": sens + spec - 1,
    })


def cutoff_metrics(scored: DataFrame, y: str, cut: float, p: str = "p", inclusive: bool = False) -> DataFrame:
    """Quality measures at one cut; by default a score must exceed the cut."""
    cells = rates(confusion_matrix(scored, y, p, cut, inclusive))
    return cells.select(F.lit(cut).alias("cut"), "accuracy", "sensitivity", "specificity", "ppv", "npv")


def cut_grid(lo: float = 0.10, hi: float = 0.90, n: int = 81) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [round(lo + i * step, 10) for i in range(n)]


def cutoff_sweep(
    scored: DataFrame, y: str, p: str = "p", cuts: Iterable[float] | None = None, inclusive: bool = True
) -> DataFrame:
    """Accuracy, sensitivity, specificity and Youden at every cut from one pass.

    Each row adds to the one interval between cuts its score falls in; totals from
    the top down over the few intervals give the counts of every cut.
    """
    cuts = sorted(cuts if cuts is not None else cut_grid())
    spark = scored.sparkSession
    known = F.col(p).isNotNull()
    index = F.coalesce(interval_index(F.col(p), cuts, inclusive), F.lit(0))
    counted = scored.groupBy(index.alias("i")).agg(
        F.count_if(known & (F.col(y) == 1)).alias("pos"), F.count_if(known & (F.col(y) == 0)).alias("neg")
    )
    every = report(spark, [(i, 0, 0) for i in range(len(cuts) + 1)], "i int, pos long, neg long")
    filled = every.unionByName(counted).groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    cells = filled.select(
        "i", tp.alias("tp"), fp.alias("fp"),
        (F.sum("pos").over(everything) - tp).alias("fn"), (F.sum("neg").over(everything) - fp).alias("tn"),
    ).where("i > 0")
    labels = F.array(*[F.lit(c) for c in cuts])
    return rates(cells).select(
        F.element_at(labels, F.col("i")).alias("cut"), "accuracy", "sensitivity", "specificity", "youden",
    ).orderBy("cut")


def arg_max_row(df: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the largest metric; the first by ``order`` on ties."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(metric), -F.col(order))).alias("r")
    return df.where(F.col(metric).isNotNull()).agg(best).select("r.*")


def optimal_cutoff(sweep: DataFrame) -> DataFrame:
    """First cut of best accuracy and first cut of best Youden."""
    return arg_max_row(sweep, "accuracy", "cut").select(F.lit("accuracy").alias("criterion"), "*").unionByName(
        arg_max_row(sweep, "youden", "cut").select(F.lit("youden").alias("criterion"), "*")
    )


def final_evaluation(scored: DataFrame, y: str, cut: float, n_params: int, p: str = "p") -> DataFrame:
    cells = rates(confusion_matrix(scored, y, p, cut, inclusive=True))
    return cells.select(
        F.lit(cut).alias("cut"), "accuracy", "sensitivity", "specificity", "youden",
        "tn", "fp", "fn", "tp", F.lit(n_params).alias("n_params"),
    )


def accuracy_by(scored: DataFrame, y: str, by: str = "split", p: str = "p", cut: float = 0.5) -> DataFrame:
    """Accuracy per part at one cut."""
    right = (F.col(p) >= F.lit(cut)) == (F.col(y) == 1)
    return scored.groupBy(by).agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"))


def model_comparison_ols(
    df: DataFrame, specs: dict[str, ModelSpec], y: str, split: str = "split"
) -> DataFrame:
    """R2 on train and test with sizes per model; one pass for all models."""
    design = DesignSpec.fit(df.where(F.col(split) == "train"), union_spec(specs.values()))
    m = moments(df, design, y, [split])
    train, test = m.grams[(split, "train")], m.grams[(split, "test")]
    rows = []
    for name, s in specs.items():
        cols = m.positions(design.columns_of(s))
        rank = solve(train, cols, m.y)[3]
        rows.append((
            name, r2_on(m, s, train, train), r2_on(m, s, train, test), rank, len(s.cont), len(s.categ), len(s.inter),
        ))
    return report(
        df.sparkSession, rows,
        "model string, r2_train double, r2_test double, n_params int, n_cont int, n_categ int, n_inter int",
    ).orderBy(F.desc("r2_test"), "n_params", "model")


def model_comparison_logit(
    df: DataFrame, specs: dict[str, ModelSpec], y: str, split: str = "split", l2: float = 1.0, cut: float = 0.5
) -> DataFrame:
    """Pseudo-R2 and accuracy on train and test per model; one scoring pass for all."""
    spec = union_spec(specs.values())
    design = DesignSpec.fit(df.where(F.col(split) == "train"), spec)
    part = df.withColumn("_part", (F.col(split) == "test").cast("int"))
    data = logit_data(part, spec, y, "_part", design)  # fitted without part 1, scored on both
    fits = dict(zip(specs, fit_many(data, [Candidate(s, left_out=1) for s in specs.values()], l2, quick=True)))
    scored = data.probabilities(fits.values())
    aggs = [F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("ones")]
    for i in range(len(fits)):
        right = (F.col(f"p{i}") >= F.lit(cut)) == (F.col("y") == 1)
        aggs += [
            F.sum(log_lik_term(F.col("y"), F.col(f"p{i}"))).alias(f"ll{i}"),
            F.avg(right.cast("int")).alias(f"acc{i}"),
        ]
    parts = {r["fold"]: r for r in scored.groupBy("fold").agg(*aggs).collect()}
    table = []
    for i, (name, s) in enumerate(specs.items()):
        def pr2(part):
            null = null_log_lik(part["n"], part["ones"])
            return 1 - part[f"ll{i}"] / null if null else None

        a, b = parts[0], parts[1]
        table.append((
            name, pr2(a), pr2(b), a[f"acc{i}"], b[f"acc{i}"], fits[name].n_params, len(s.cont), len(s.categ),
        ))
    return report(
        df.sparkSession, table,
        "model string, pseudo_r2_train double, pseudo_r2_test double, acc_train double, acc_test double, "
        "n_params int, n_cont int, n_categ int",
    ).orderBy(F.desc("pseudo_r2_test"), "n_params", "model")


def _without(spec: ModelSpec) -> dict[str, ModelSpec]:
    return {u: spec.restrict(x for x in spec.units if x != u) for u in spec.units}


def effect_sizes_ols(spark: SparkSession, m: Moments, spec: ModelSpec | None = None) -> DataFrame:
    """R2 lost when each unit leaves the model, from the one moment matrix."""
    spec = m.design.spec if spec is None else spec
    total = m.total()
    full = r2_on(m, spec, total, total)
    rows = [(u, full - r2_on(m, s, total, total)) for u, s in _without(spec).items()]
    return report(spark, rows, "variable string, r2_loss double").orderBy("r2_loss", "variable")


def effect_sizes_logit(data: LogitData, spec: ModelSpec | None = None, l2: float = 1.0) -> DataFrame:
    """Pseudo-R2 lost when each unit leaves; all reduced models share the passes."""
    spec = data.design.spec if spec is None else spec
    reduced = _without(spec)
    fits = fit_many(data, [Candidate(s) for s in (spec, *reduced.values())], l2, quick=True)
    null = null_log_lik(data.n, data.ones)
    full = fits[0].log_lik
    rows = [(u, (f.log_lik - full) / null) for u, f in zip(reduced, fits[1:])]
    return report(data.rows.sparkSession, rows, "variable string, r2_loss double").orderBy("r2_loss", "variable")


def coef_subset(coefficients: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Rows of the named coefficients with a label saying which kind they are."""
    wanted = [c for names in groups.values() for c in names]
    kind = None
    for label, names in groups.items():
        cond = F.col("variable").isin(names)
        kind = F.when(cond, label) if kind is None else kind.when(cond, label)
    return coefficients.where(F.col("variable").isin(wanted)).withColumn("kind", kind)


def top_coefficients(coefficients: DataFrame, k: int = 30) -> DataFrame:
    return (
        coefficients.where(F.col("variable") != "const")
        .select("variable", "coef", F.abs("coef").alias("abs_coef"))
        .orderBy(F.desc("abs_coef"), "variable").limit(k)
    )
