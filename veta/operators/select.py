"""Forward, backward and stepwise selection under AIC or BIC.

One greedy driver serves both model families.  Linear models are scored from the
moment matrix without touching the data; the logistic candidates of a step share
every pass over the staged rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import report
from .design import ModelSpec
from .logit import Candidate, LogitData, LogitFit, criterion, fit_many, null_log_lik
from .moments import Moments, solve
from .ols import information_criterion, log_likelihood

METHODS = ("forward", "backward", "stepwise")
CRITERIA = ("AIC", "BIC")


@dataclass(frozen=True)
class Rules:
    """When a move is accepted, given the change of the criterion."""

    enter: Callable[[float], bool]  # drop of the criterion
    leave_backward: Callable[[float], bool]  # rise of the criterion
    leave_stepwise: Callable[[float], bool]


OLS_RULES = Rules(lambda d: d > 0, lambda r: r <= 0, lambda r: r < 0)


def logit_rules(method: str, enter: float | None = None, leave: float | None = None) -> Rules:
    # Thresholds a move must beat, per method.
    enter = {"stepwise": 5.0}.get(method, 3.0) if enter is None else enter
    leave = {"stepwise": 5.0}.get(method, 10.0) if leave is None else leave
    return Rules(lambda d: d > enter, lambda r: r <= leave, lambda r: r < leave)


@dataclass(frozen=True)
class Selection:
    method: str
    criterion: str
    spec: ModelSpec
    value: float
    trace: list[tuple]

    @property
    def name(self) -> str:
        return f"{self.method.capitalize()} {self.criterion}"

    def trace_table(self, spark: SparkSession) -> DataFrame:
        return report(
            spark, self.trace,
            "step int, phase string, variable string, metric double, chosen boolean, accepted boolean, formula string",
        )


Score = Callable[[list[list[str]], list[str]], list[float]]


def greedy(spec: ModelSpec, method: str, score: Score, rules: Rules, criterion_name: str) -> Selection:
    """Add or drop one unit per step; on equal scores the first unit in model order wins.

    ``score`` takes unit lists to rate and the unit list they start from.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    order = spec.units
    chosen = list(order) if method == "backward" else []
    waiting = list(order)
    current = score([chosen], chosen)[0]
    trace: list[tuple] = [(0, "start", None, current, True, True, spec.restrict(chosen).formula())]
    step = 0

    def move(phase: str, options: dict[str, list[str]], accept) -> str | None:
        nonlocal current, chosen
        values = dict(zip(options, score(list(options.values()), chosen)))
        best = min(values, key=values.get)
        accepted = accept(values[best])
        after = options[best] if accepted else chosen
        for u, v in values.items():
            trace.append((step, phase, u, v, u == best, u == best and accepted, spec.restrict(after).formula()))
        if not accepted:
            return None
        current, chosen = values[best], options[best]
        return best

    while waiting:
        step += 1
        if method == "backward":
            options = {u: [x for x in chosen if x != u] for u in waiting}
            gone = move("drop", options, lambda v: rules.leave_backward(v - current))
            if gone is None:
                break
            waiting.remove(gone)
            continue
        options = {u: [x for x in order if x in chosen or x == u] for u in waiting}
        added = move("add", options, lambda v: rules.enter(current - v))
        if added is None:
            break
        waiting.remove(added)
        if method == "stepwise" and len(chosen) > 1:  # what leaves does not come back
            options = {u: [x for x in chosen if x != u] for u in chosen}
            move("drop", options, lambda v: rules.leave_stepwise(v - current))
    return Selection(method, criterion_name, spec.restrict(chosen), current, trace)


def select_ols(m: Moments, method: str, criterion_name: str, grouping_cell: tuple[str, str] | None = None) -> Selection:
    """Selection over the moment matrix; no Spark job at all."""
    gram = m.total() if grouping_cell is None else m.grams[grouping_cell]
    spec = m.design.spec
    by_unit = m.design.by_unit
    n = round(gram[0, 0])
    scale2 = m.scale[m.y - 1] ** 2

    def score(options: list[list[str]], _: list[str]) -> list[float]:
        values = []
        for units in options:
            cols = m.positions([c for u in units for c in by_unit[u]])
            _, _, sse, rank = solve(gram, cols, m.y)
            values.append(information_criterion(criterion_name, log_likelihood(n, sse * scale2), rank, n))
        return values

    return greedy(spec, method, score, OLS_RULES, criterion_name)


def select_logit(
    data: LogitData, method: str, criterion_name: str, l2: float = 1.0, k: str = "true",
    enter: float | None = None, leave: float | None = None,
    cache: dict[tuple[str, ...], LogitFit] | None = None,
) -> Selection:
    """Selection of a logistic model; fitted models are remembered across runs."""
    spec = data.design.spec
    cache = {} if cache is None else cache

    def score(options: list[list[str]], base: list[str]) -> list[float]:
        start = cache.get(tuple(base))
        fresh = [o for o in options if o and tuple(o) not in cache]
        fits = fit_many(data, [
            Candidate(spec.restrict(o), start=start.coefficients if start else None) for o in fresh
        ], l2, quick=True) if fresh else []
        cache.update({tuple(o): f for o, f in zip(fresh, fits)})
        values = []
        for o in options:
            if o:
                values.append(cache[tuple(o)].criterion(criterion_name, k))
            else:
                params = 1 if k == "true" else 2
                values.append(criterion(criterion_name, null_log_lik(data.n, data.ones), params, data.n))
        return values

    return greedy(spec, method, score, logit_rules(method, enter, leave), criterion_name)


def run_grid_ols(m: Moments, **kwargs) -> list[Selection]:
    """All six method and criterion combinations from one moment matrix."""
    return [select_ols(m, a, b, **kwargs) for a in METHODS for b in CRITERIA]


def run_grid_logit(data: LogitData, **kwargs) -> list[Selection]:
    """All six combinations; a model that several runs visit is fitted once."""
    cache: dict[tuple[str, ...], LogitFit] = {}
    return [select_logit(data, a, b, cache=cache, **kwargs) for a in METHODS for b in CRITERIA]


def selections_table(spark: SparkSession, selections: Iterable[Selection]) -> DataFrame:
    rows = [
        (s.name, s.criterion, s.value, s.spec.formula(), len(s.spec.cont), len(s.spec.categ), len(s.spec.inter))
        for s in selections
    ]
    return report(
        spark, rows,
        "model string, criterion string, value double, formula string, n_cont int, n_categ int, n_inter int",
    )


def selection_trace(spark: SparkSession, selections: Iterable[Selection]) -> DataFrame:
    rows = [(s.name, *t) for s in selections for t in s.trace]
    return report(
        spark, rows,
        "model string, step int, phase string, variable string, metric double, chosen boolean, "
        "accepted boolean, formula string",
    )
