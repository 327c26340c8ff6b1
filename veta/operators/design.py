"""Model specifications and the design columns they expand to."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import number
from ..functions.tables import report

MAX_LEVELS = 500
MAX_COLUMNS = 2_000


@dataclass(frozen=True)
class ModelSpec:
    """Raw variables of a model: continuous, categorical and interaction pairs."""

    cont: tuple[str, ...] = ()
    categ: tuple[str, ...] = ()
    inter: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(cont: Iterable[str] = (), categ: Iterable[str] = (), inter: Iterable[tuple[str, str]] = ()) -> ModelSpec:
        return ModelSpec(tuple(cont), tuple(categ), tuple((a, b) for a, b in inter))

    @property
    def units(self) -> list[str]:
        """What selection adds and drops: a category moves with all its dummies."""
        return [*self.cont, *self.categ, *[f"{a}_{b}" for a, b in self.inter]]

    @property
    def raw(self) -> list[str]:
        names = [*self.cont, *self.categ, *[x for pair in self.inter for x in pair]]
        return list(dict.fromkeys(names))

    def restrict(self, units: Iterable[str]) -> ModelSpec:
        keep = set(units)
        return ModelSpec(
            tuple(c for c in self.cont if c in keep), tuple(c for c in self.categ if c in keep),
            tuple(p for p in self.inter if f"{p[0]}_{p[1]}" in keep),
        )

    def formula(self) -> str:
        terms = [*self.cont, *self.categ, *[f"{a}*{b}" for a, b in self.inter]]
        return "y ~ " + (" + ".join(terms) if terms else "1")

    def to_json(self) -> str:
        return json.dumps({"cont": self.cont, "categ": self.categ, "inter": self.inter})

    @staticmethod
    def from_json(text: str) -> ModelSpec:
        d = json.loads(text)
        return ModelSpec.of(d["cont"], d["categ"], d["inter"])


def _text_columns(df: DataFrame) -> set[str]:
    return {name for name, kind in df.dtypes if kind in ("string", "boolean")}


def category_levels(df: DataFrame, columns: Iterable[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels per category from one grouped job; too many levels is an error."""
    columns = list(columns)
    if not columns:
        return {}
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    found = (
        text.unpivot([], columns, "variable", "value").where(F.col("value").isNotNull()).distinct()
        .limit(max_levels * len(columns) + 1).collect()
    )
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in found:
        levels[r["variable"]].append(r["value"])
    wide = [c for c, v in levels.items() if len(v) > max_levels]
    if wide or len(found) > max_levels * len(columns):
        raise ValueError(f"more than {max_levels} levels in {wide or columns}: group levels before modelling")
    return {c: sorted(v) for c, v in levels.items()}


@dataclass(frozen=True)
class DesignSpec:
    """Design columns fixed on the training rows and applied unchanged elsewhere.

    A level that training never saw gets zeros in every dummy, like null.
    """

    spec: ModelSpec
    levels: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, spec: ModelSpec, max_levels: int = MAX_LEVELS) -> DesignSpec:
        text = _text_columns(df)
        wanted = [c for c in spec.raw if c in spec.categ or c in text]
        design = DesignSpec(spec, category_levels(df, wanted, max_levels))
        design._refuse_clashes()
        if len(design.columns) > MAX_COLUMNS:
            raise ValueError(f"{len(design.columns)} design columns, at most {MAX_COLUMNS} are supported")
        return design

    def _refuse_clashes(self) -> None:
        """One name must not stand for two different units or two different columns."""
        units: dict[str, tuple] = {}
        columns: dict[str, tuple] = {}
        named = [(c, ((c, level),), n) for c in (*self.spec.cont, *self.spec.categ) for n, level in self._parts(c)]
        for a, b in self.spec.inter:
            named += [
                (f"{a}_{b}", ((a, i), (b, j)), f"{x}_{y}") for x, i in self._parts(a) for y, j in self._parts(b)
            ]
        for unit, parts, name in named:
            variables = tuple(v for v, _ in parts)
            if units.setdefault(unit, variables) != variables:
                raise ValueError(f"{unit} names two terms, {units[unit]} and {variables}: rename a variable")
            if columns.setdefault(name, parts) != parts:
                raise ValueError(f"{name} names two design columns, {columns[name]} and {parts}: rename a variable or level")

    def _parts(self, variable: str) -> list[tuple[str, str | None]]:
        if variable in self.levels:
            return [(f"{variable}_{v}", v) for v in self.levels[variable][1:]]
        return [(variable, None)]

    @property
    def by_unit(self) -> dict[str, list[str]]:
        """Design column names of every unit, in unit order."""
        result = {c: [n for n, _ in self._parts(c)] for c in (*self.spec.cont, *self.spec.categ)}
        for a, b in self.spec.inter:
            result[f"{a}_{b}"] = [f"{x}_{y}" for x, _ in self._parts(a) for y, _ in self._parts(b)]
        return result

    @property
    def columns(self) -> list[str]:
        return [c for names in self.by_unit.values() for c in names]

    @property
    def continuous(self) -> list[str]:
        return [c for c in self.spec.raw if c not in self.levels]

    def columns_of(self, spec: ModelSpec) -> list[str]:
        by_unit = self.by_unit
        return [c for u in spec.units for c in by_unit[u]]

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        """Column expressions of the design; missing numbers stay null."""

        def part(variable: str, level: str | None) -> Column:
            if level is None:
                return number(df, variable)
            return F.col(variable).cast("string").eqNullSafe(F.lit(level)).cast("double")

        result = {}
        for c in (*self.spec.cont, *self.spec.categ):
            for name, level in self._parts(c):
                result[name] = part(c, level)
        for a, b in self.spec.inter:
            for x, level_x in self._parts(a):
                for y, level_y in self._parts(b):
                    result[f"{x}_{y}"] = part(a, level_x) * part(b, level_y)
        return result

    def codes(self, df: DataFrame) -> list[Column]:
        """The raw variables: numbers as they are, categories as the number of their level.

        The first level, null and levels that training never saw are 0: zeros in every dummy.
        """
        def coded(variable: str) -> Column:
            if variable not in self.levels:
                return number(df, variable)
            levels = self.levels[variable] or [""]
            place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(variable).cast("string"))
            return F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)).cast("int")

        return [coded(v) for v in self.spec.raw]

    def from_codes(self, codes: dict[str, Column]) -> dict[str, Column]:
        """Column expressions of the design over coded variables."""
        def part(variable: str, i: int) -> Column:
            return codes[variable] if variable not in self.levels else (codes[variable] == i + 1).cast("double")

        result = {}
        for c in (*self.spec.cont, *self.spec.categ):
            for i, (name, _) in enumerate(self._parts(c)):
                result[name] = part(c, i)
        for a, b in self.spec.inter:
            for i, (x, _) in enumerate(self._parts(a)):
                for j, (y, _) in enumerate(self._parts(b)):
                    result[f"{x}_{y}"] = part(a, i) * part(b, j)
        return result

    def expand(self, coded: list[np.ndarray]) -> np.ndarray:
        """A constant and the design columns of a batch of coded variables."""
        of = dict(zip(self.spec.raw, coded))
        n = len(coded[0])
        width = {v: len(self._parts(v)) for v in self.spec.raw}
        terms = [(c,) for c in (*self.spec.cont, *self.spec.categ)] + [tuple(p) for p in self.spec.inter]
        out = np.zeros((n, 1 + sum(int(np.prod([width[v] for v in t])) for t in terms)))
        out[:, 0] = 1.0
        first = 1
        for t in terms:
            # the one column of the term that a row can fill, and what it holds there
            at, value, filled = np.zeros(n, np.int64), np.ones(n), np.ones(n, bool)
            for v in t:
                at *= width[v]
                if v in self.levels:
                    at += np.maximum(of[v].astype(np.int64) - 1, 0)
                    filled &= of[v] > 0
                else:
                    value = value * of[v]
            rows = np.flatnonzero(filled)
            out[rows, first + at[rows]] = value[rows]
            first += int(np.prod([width[v] for v in t]))
        return out

    def transform(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """Key columns plus the design columns, in training order."""
        return df.select(*keep, *[e.alias(n) for n, e in self.expressions(df).items()])

    def complete(self, df: DataFrame, target: str) -> DataFrame:
        """Rows usable for fitting: target and every continuous variable present."""
        present = [number(df, c).isNotNull() for c in (target, *self.continuous)]
        return df.where(reduce(lambda a, b: a & b, present))

    def linear_predictor(self, df: DataFrame, coefficients: dict[str, float]) -> Column:
        """Intercept plus coefficient times design column, as one expression."""
        total = F.lit(float(coefficients["const"]))
        for name, e in self.expressions(df).items():
            if coefficients.get(name):
                total = total + F.lit(float(coefficients[name])) * e
        return total

    def table(self, spark) -> DataFrame:
        rows = [(u, c) for u, names in self.by_unit.items() for c in names]
        return report(spark, rows, "unit string, column string")


def one_hot(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Dummies ``{variable}_{level}``: levels sorted, the first one dropped, null all zeros."""
    return DesignSpec.fit(df, ModelSpec.of(categ=columns)).transform(df, keep)


def interactions(df: DataFrame, pairs: Iterable[tuple[str, str]], keep: Iterable[str] = ()) -> DataFrame:
    """Products of every expansion column of one variable with every one of the other."""
    return DesignSpec.fit(df, ModelSpec.of(inter=pairs)).transform(df, keep)


def design_matrix(df: DataFrame, spec: ModelSpec, keep: Iterable[str] = ()) -> DataFrame:
    return DesignSpec.fit(df, spec).transform(df, keep)


def align_design_columns(train: DataFrame, other: DataFrame, spec: ModelSpec, keep: Iterable[str] = ()) -> DataFrame:
    """Design of ``other`` with exactly the training columns, absent levels as zeros."""
    return DesignSpec.fit(train, spec).transform(other, keep)
