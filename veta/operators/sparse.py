"""Designs with wide categories: sparse rows, their cross products, and least squares with one wide category.

Levels live in a table instead of in the plan, so a category may have millions of them. A row
holds only its non-zero columns. Levels are looked up by an equi-join on their text; adaptive
execution splits a level, or the null, that holds a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import summed_arrays
from ..functions.cumulative import running_totals
from ..functions.scalars import number
from ..functions.staging import stage
from .design import DesignSpec, ModelSpec, _text_columns
from .moments import moments, solve

ENTRY = "array<struct<position:bigint,value:double>>"


@dataclass(frozen=True)
class SparseDesign:
    """Design columns by position: 0 is the constant, then the units of the spec in their order.

    ``levels`` (variable, level, place) numbers the sorted levels of every category from 0; the
    first one has no column. ``dummies`` is the number of columns of every category.
    """

    spec: ModelSpec
    levels: DataFrame
    dummies: dict[str, int]

    @staticmethod
    def fit(df: DataFrame, spec: ModelSpec) -> SparseDesign:
        """Levels of the training rows; null is no level, as in the dense design."""
        text = _text_columns(df)
        names = [c for c in spec.raw if c in spec.categ or c in text]
        if not names:
            empty = df.sparkSession.createDataFrame([], "variable string, level string, place bigint")
            return SparseDesign(spec, empty, {})
        long = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "variable", "level")
        found = long.where(F.col("level").isNotNull()).distinct().withColumn("one", F.lit(1).cast("bigint"))
        ranked = running_totals(found, "level", ["one"], by=["variable"])
        levels = stage(ranked.select("variable", "level", (F.col("cum_one") - 1).alias("place")))
        counts = {r["variable"]: r["n"] for r in levels.groupBy("variable").agg(F.count("*").alias("n")).collect()}
        return SparseDesign(spec, levels, {c: max(0, counts.get(c, 0) - 1) for c in names})

    def _width(self, variable: str) -> int:
        return self.dummies.get(variable, 1)

    @property
    def terms(self) -> list[tuple[str, ...]]:
        return [(c,) for c in (*self.spec.cont, *self.spec.categ)] + [tuple(p) for p in self.spec.inter]

    @property
    def begins(self) -> list[int]:
        """First position of every term, and one behind the last column."""
        out = [1]
        for t in self.terms:
            out.append(out[-1] + int(np.prod([self._width(v) for v in t], dtype=object)))
        return out

    def coded(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """df with looked-up places, and every raw variable as number or place.

        Null, the first level and levels that training never saw are 0.
        """
        out = df.withColumns({f"_raw_{i}": number(df, v) if v not in self.dummies else F.col(v).cast("string") for i, v in enumerate(self.spec.raw)})
        values = {}
        for i, v in enumerate(self.spec.raw):
            values[v] = F.col(f"_raw_{i}")
            if v in self.dummies:
                found = self.levels.where(F.col("variable") == v).select(F.col("level").alias(f"_level_{i}"), F.col("place").alias(f"_place_{i}"))
                out = out.join(found, F.col(f"_raw_{i}") == F.col(f"_level_{i}"), "left")
                values[v] = F.coalesce(F.col(f"_place_{i}"), F.lit(0))
        return out, values

    def entries(self, values: dict[str, Column]) -> Column:
        """The non-zero columns of a row by position, without the constant; a missing number is null at its column."""
        out = []
        for term, begin in zip(self.terms, self.begins, strict=False):
            at, value, filled = F.lit(0).cast("bigint"), F.lit(1.0), F.lit(True)
            for v in term:
                at = at * self._width(v)
                if v in self.dummies:
                    at = at + values[v] - 1
                    filled = filled & (values[v] > 0)
                else:
                    value = value * values[v]
            out.append(F.when(filled, F.struct((at + begin).alias("position"), value.alias("value"))))
        return F.filter(F.array(*out).cast(ENTRY), lambda e: e.isNotNull())

    def transform(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """Key columns, ``positions`` and ``values`` of the non-zero columns in ascending order."""
        rows, values = self.coded(df)
        rows = rows.select(*keep, self.entries(values).alias("_entries"))
        return rows.select(*keep, F.col("_entries.position").alias("positions"), F.col("_entries.value").alias("values"))

    def complete(self, df: DataFrame, target: str) -> DataFrame:
        present = [number(df, c).isNotNull() for c in (target, *[v for v in self.spec.raw if v not in self.dummies])]
        return df.where(reduce(lambda a, b: a & b, present))

    def cross_products(self, df: DataFrame, target: str) -> DataFrame:
        """(i, j, value), i <= j: unshifted cross products of the complete rows where any are met.

        The target stands behind the last column. Pairs are made of the non-zero columns of one
        row, at most one a term, and added up in the scan tasks first.
        """
        rows, values = self.coded(self.complete(df, target))
        ends = [F.struct(F.lit(p).cast("bigint").alias("position"), v.alias("value")) for p, v in ((0, F.lit(1.0)), (self.begins[-1], number(rows, target)))]
        every = F.concat(F.array(ends[0]).cast(ENTRY), self.entries(values), F.array(ends[1]).cast(ENTRY))
        pairs = F.flatten(F.transform(F.col("_e"), lambda a, n: F.transform(
            F.slice(F.col("_e"), n + 1, F.size("_e")),
            lambda b: F.struct(a.position.alias("i"), b.position.alias("j"), (a.value * b.value).alias("value")),
        )))
        met = rows.select(every.alias("_e")).select(F.explode(pairs).alias("p"))
        return met.groupBy(F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("p.value").alias("value"))


def sparse_design(df: DataFrame, spec: ModelSpec, keep: Iterable[str] = ()) -> DataFrame:
    return SparseDesign.fit(df, spec).transform(df, keep)


def ols_wide(df: DataFrame, spec: ModelSpec, wide: str, target: str) -> DataFrame:
    """(term, level, estimate): least squares with the dummies of one wide category, any number of levels.

    The category is projected out: cross products within its levels give the slopes of all other
    terms, whose columns are few; the mean residuals of the levels give its own. Null and the
    first level are the base, as in the dense design, and ``const`` is theirs; if no complete row
    has one of them, the next level present is the base. Slopes that the category or earlier
    terms determine are 0. Terms of the spec must not contain the category. A table without
    complete rows is an error.
    """
    if wide in spec.raw:
        raise ValueError(f"{wide} is already a term of the model")
    dense = DesignSpec.fit(df, spec)
    rows = dense.complete(df, target)
    # all sums are about the overall means, which steadies them and moves only the constant
    m = moments(rows, dense, target)
    k = len(m.names) + 1
    category = SparseDesign.fit(df, ModelSpec.of(categ=[wide]))
    coded, values = category.coded(rows)
    expressions = dense.expressions(coded)
    columns = [*[expressions[c] for c in m.names], number(coded, target)]
    centred = [((c - F.lit(float(s))) / F.lit(float(d))).alias(f"_x{i}") for i, (c, s, d) in enumerate(zip(columns, m.shift, m.scale, strict=True))]
    sums = coded.select(values[wide].alias("place"), *centred).groupBy("place").agg(
        F.count("*").alias("n"), F.array(*[F.sum(f"_x{i}") for i in range(k)]).alias("sums"))
    sums = stage(sums)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            s = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += (s / n[:, None]).T @ s
        yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([total.ravel()], pa.list_(pa.float64()))], ["cell", "gram"])

    part = summed_arrays(sums.mapInArrow(between, "cell string, gram array<double>"), ["cell"], "gram")
    # a column that only varies between levels leaves rounding errors: its own total decides
    within = m.total()[1:, 1:] - next(iter(part.values())).reshape(k, k)
    own = np.diag(m.total())[1:]
    still = np.flatnonzero(np.diag(within)[: k - 1] > 1e-10 * np.maximum(own[: k - 1], np.finfo(float).tiny)).tolist()
    beta = np.zeros(k - 1)
    if still:
        beta[still] = solve(within, still, k - 1)[0]

    means = F.transform("sums", lambda s: s / F.col("n"))
    fitted = sum((F.get(F.col("_m"), F.lit(i)) * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
    effect = (F.get(F.col("_m"), F.lit(k - 1)) - fitted) * F.lit(float(m.scale[-1]))
    effects = sums.withColumn("_m", means).select("place", effect.alias("effect"))
    base = effects.agg(F.min_by("effect", "place").alias("effect"), F.min("place").alias("place")).first()
    slopes = beta * m.scale[-1] / m.scale[:-1]
    const = m.shift[-1] + base["effect"] - float(slopes @ m.shift[:-1])
    others = category.levels.join(effects.where(F.col("place") > base["place"]), "place").select(
        F.lit(wide).alias("term"), "level", (F.col("effect") - F.lit(float(base["effect"]))).alias("estimate"))
    named = [("const", None, float(const)), *[(n, None, float(b)) for n, b in zip(m.names, slopes, strict=True)]]
    return df.sparkSession.createDataFrame(named, "term string, level string, estimate double").unionByName(others)
