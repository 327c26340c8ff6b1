"""One distributed moment matrix from which every least-squares question is answered."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import summed_arrays
from ..functions.scalars import number
from ..functions.tables import report
from .design import DesignSpec

PIVOT_TOLERANCE = 1e-10
Y = "__y"


@dataclass(frozen=True)
class Moments:
    """Cross products of (1, z_1 ... z_p, z_y) per cell, with z = (x - shift) / scale.

    ``grams`` holds one matrix per (grouping, cell); the cells of a grouping add up
    to the whole table, so a training set is the total minus its fold.
    """

    design: DesignSpec
    names: list[str]
    shift: np.ndarray
    scale: np.ndarray
    grams: dict[tuple[str, str], np.ndarray]

    def total(self, grouping: str | None = None) -> np.ndarray:
        grouping = next(iter(self.grams))[0] if grouping is None else grouping
        return sum(g for (name, _), g in self.grams.items() if name == grouping)

    def cells(self, grouping: str) -> list[str]:
        return sorted(c for name, c in self.grams if name == grouping)

    def positions(self, columns: Iterable[str]) -> list[int]:
        where = {n: i + 1 for i, n in enumerate(self.names)}
        return [0, *[where[c] for c in columns]]

    @property
    def y(self) -> int:
        return len(self.names) + 1

    def raw_gram(self, gram: np.ndarray) -> np.ndarray:
        """Cross products of the unshifted columns (1, x_1 ... x_p, y)."""
        m = np.diag(np.concatenate([[1.0], self.scale]))
        m[0, 1:] = self.shift
        return m.T @ gram @ m


def _upper(width: int):
    return np.triu_indices(width)


def _gram_kernel(design: DesignSpec, n_groupings: int, shift: np.ndarray, scale: np.ndarray):
    """Arrow batches (groupings, target, coded variables) in, one packed cross-product matrix per cell out."""
    width = len(shift) + 1
    upper = _upper(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, *coded = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(n_groupings, batch.num_columns)]
            x = design.expand(coded) if coded else np.ones((batch.num_rows, 1))
            z = np.column_stack([x, y])
            z[:, 1:] = (z[:, 1:] - shift) / scale
            for g in range(n_groupings):
                codes = batch.column(g).dictionary_encode()
                ids = codes.indices.to_numpy(zero_copy_only=False)
                for i, cell in enumerate(codes.dictionary.to_pylist()):
                    part = z[ids == i] if len(codes.dictionary) > 1 else z
                    gram = part.T @ part
                    key = (g, cell)
                    sums[key] = sums[key] + gram if key in sums else gram
        if sums:
            yield pa.RecordBatch.from_pydict({
                "grouping": pa.array([g for g, _ in sums], pa.int32()),
                "cell": pa.array([c for _, c in sums], pa.string()),
                "gram": pa.array([s[upper] for s in sums.values()], pa.list_(pa.float64())),
            })

    return run


def centre_and_scale(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population deviation per column; deviation 0 marks a constant column."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"), (F.max(c) - F.min(c)).alias(f"r{i}")]
    row = df.agg(*aggs).first()
    shift = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    scale = np.array([(row[f"s{i}"] or 0.0) if row[f"r{i}"] else 0.0 for i in range(len(columns))])
    return shift, scale, row["n"]


def moments(
    df: DataFrame, design: DesignSpec, y: str, groupings: Iterable[str] = (),
    centre: tuple[np.ndarray, np.ndarray] | None = None,
) -> Moments:
    """Moment matrix of the complete rows: one aggregate for means, one pass for products.

    ``groupings`` are columns (split, folds of each repetition) whose cells get their
    own matrix from the same pass.  ``centre`` gives shifts and scales known already
    (design columns, then the target) and saves the first aggregate; they steady the
    sums and do not change what is computed.
    """
    groupings = list(groupings)
    rows = design.complete(df, y)
    names = design.columns
    flat = rows.select(
        *[F.col(g).cast("string").alias(f"_g{i}") for i, g in enumerate(groupings)],
        *([] if groupings else [F.lit("all").alias("_g0")]),
        number(rows, y).alias("_y"), *[c.alias(f"_r{i}") for i, c in enumerate(design.codes(rows))],
    )
    numeric = [*[f"_x{i}" for i in range(len(names))], "_y"]
    if centre is None:
        expressions = design.expressions(rows)
        wide = rows.select(*[expressions[c].alias(x) for c, x in zip(names, numeric)], number(rows, y).alias("_y"))
        shift, scale, n = centre_and_scale(wide, numeric)
        if n == 0:
            raise ValueError("no complete rows to fit on")
        scale[scale == 0] = 1.0
    else:
        shift, scale = centre
    n_groupings = max(1, len(groupings))
    kernel = _gram_kernel(design, n_groupings, shift, scale)
    partial = flat.mapInArrow(kernel, "grouping int, cell string, gram array<double>")
    width = len(names) + 2
    upper = _upper(width)
    labels = groupings or ["all"]
    grams = {}
    for (grouping, cell), values in summed_arrays(partial, ["grouping", "cell"], "gram").items():
        g = np.zeros((width, width))
        g[upper] = values
        grams[labels[grouping], cell] = g + np.triu(g, 1).T
    return Moments(design, names, shift, scale, grams)


def moment_matrix(df: DataFrame, design: DesignSpec, y: str) -> DataFrame:
    """The unshifted cross products as rows (i, j, value), upper triangle."""
    m = moments(df, design, y)
    raw = m.raw_gram(m.total())
    names = ["const", *m.names, y]
    rows = [(names[i], names[j], float(raw[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return report(df.sparkSession, rows, "i string, j string, value double")


def solve(gram: np.ndarray, columns: list[int], y: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Least squares on a subset of the columns: coefficients, inverse, SSE, rank.

    Columns are swept in order; one that is a combination of the earlier ones gets
    coefficient 0 and does not count towards the rank.
    """
    index = [*columns, y]
    a = gram[np.ix_(index, index)].copy()
    p = len(columns)
    start = a.diagonal().copy()
    used = np.zeros(p, dtype=bool)
    for k in range(p):
        pivot = a[k, k]
        if pivot <= PIVOT_TOLERANCE * max(start[k], np.finfo(float).tiny):
            continue
        used[k] = True
        row, col = a[k, :].copy(), a[:, k].copy()
        a -= np.outer(col, row) / pivot
        a[k, :], a[:, k] = row / pivot, col / pivot
        a[k, k] = -1.0 / pivot
    beta = np.where(used, a[:p, p], 0.0)
    inverse = np.where(np.outer(used, used), -a[:p, :p], 0.0)
    return beta, inverse, max(float(a[p, p]), 0.0), int(used.sum())
