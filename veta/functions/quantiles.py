"""Exact quantiles of any number of columns and groups, found inside Spark.

One aggregate counts every column in cells of a logarithmic scale, each with its least and
greatest value; running totals over the cells say which cell holds a wanted rank and how many
values precede it.  The next scan reads only values of those cells and counts them one by one.  A
cell of very many rows is cut into equal parts between its least and greatest value first, until
what is left is few.  Cells are in value order and counts are exact, so the result is, whatever the
cells are; a task sees a bounded number of cells, and only answers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.functions.scalars import is_float
from veta.functions.staging import stage

STEPS = 128  # first cells per doubling of the absolute value
PARTS = 4_096  # equal parts a large cell is cut into
INSIDE = 2_000_000  # rows of a cell beyond which it is cut again

Group = tuple
# the value at a rank, where the cell alone tells it
VALUE = "CASE WHEN _lo = _hi THEN _lo WHEN _rank = _start THEN _lo WHEN _rank = _start + _n - 1 THEN _hi END"
COUNTS = ["count(_v) AS _n", "min(_v) AS _lo", "max(_v) AS _hi"]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _double(x: float) -> str:
    return f"double('{x!r}')"


def _log_cell() -> str:
    """Number of the first cell of a value, in value order: zero and the infinities have their own."""
    middle = 2_500 * STEPS + 1  # so that cell numbers of positive values are positive
    size = f"CASE WHEN abs(_v) = double('inf') THEN {2 * middle} ELSE floor(log2(abs(_v)) * {STEPS}) + {middle} END"
    return f"double(CASE WHEN _v = 0 THEN 0 WHEN _v > 0 THEN {size} ELSE -({size}) END)"


def _cut_cell(n: str, v: str, lo: str, hi: str) -> str:
    """Cell of a later round: the value itself, or its part of a cell of many rows."""
    return f"CASE WHEN {n} <= {INSIDE} THEN {v} ELSE double(floor(({v} - {lo}) / ({hi} - {lo}) * {PARTS})) END"


def _long(values: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    keys = [_quoted(b) for b in by]
    each = ", ".join(f"struct({i} AS _i, {_quoted(c)} AS _v)" for i, c in enumerate(columns))
    return values.selectExpr(*keys, f"explode(array({each})) AS _x").selectExpr(*keys, "_x._i", "_x._v")


def _with_ranks(cells: DataFrame, part: list[str], before: str, total: str, ranks: str, keep: list[str]) -> DataFrame:
    """One row per wanted rank: the cell that holds it; a group without values keeps a row without rank."""
    keys = ", ".join(part)
    running = f"sum(_n) OVER (PARTITION BY {keys} ORDER BY _cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = cells.selectExpr("*", f"{before} + {running} - _n AS _start", f"{total} AS _sum")
    here = f"array_distinct(filter({ranks}, r -> r >= _start AND r < _start + _n)) AS _here"
    held = placed.selectExpr(*keep, "_i", "_sum AS _total", "_start", "_n", "_lo", "_hi", here).where("size(_here) > 0 OR _total = 0")
    return held.selectExpr(*keep, "_i", "_total", "explode_outer(_here) AS _rank", "_start", "_n", "_lo", "_hi")


def _first_round(values: DataFrame, by: list[str], ps: dict[str, list[float]]) -> DataFrame:
    keys = [_quoted(b) for b in by]
    cells = _long(values, by, list(ps)).selectExpr(*keys, "_i", "_v", f"{_log_cell()} AS _cell")
    cells = cells.groupBy(*by, "_i", "_cell").agg(*[F.expr(c) for c in COUNTS])
    wanted = " ".join(f"WHEN {i} THEN array({', '.join(_double(p) for p in ps[c])})" for i, c in enumerate(ps))
    low = f"transform(CASE _i {wanted} END, p -> floor((_sum - 1) * p))"
    ranks = f"CASE WHEN _sum > 0 THEN concat({low}, transform({low}, r -> least(r + 1, _sum - 1))) ELSE array() END"
    part = [*keys, "_i"]
    return _with_ranks(cells, part, "0", f"sum(_n) OVER (PARTITION BY {', '.join(part)})", ranks, keys)


def _next_round(inside: DataFrame, by: list[str]) -> DataFrame:
    """`inside` holds (by, _i, _total, _before, _ranks, _cell, _v) for every value in an open cell."""
    keys = [_quoted(b) for b in by]
    cells = inside.groupBy(*by, "_i", "_before", "_cell").agg(*[F.expr(c) for c in [*COUNTS, "first(_ranks) AS _ranks", "first(_total) AS _total"]])
    return _with_ranks(cells, [*keys, "_i", "_before"], "_before", "_total", "_ranks", keys)


def _inside_listed(values: DataFrame, columns: list[str], open_: list[dict]) -> DataFrame:
    """Values in the open cells of an ungrouped search; the cells are literals."""
    holds, hits = [], []
    for s in open_:
        v, lo, hi = _quoted(columns[s["_i"]]), _double(s["_lo"]), _double(s["_hi"])
        holds.append(f"({v} BETWEEN {lo} AND {hi})")
        ranks = ", ".join(f"bigint({r})" for r in s["_ranks"])
        hits.append(
            f"CASE WHEN {holds[-1]} THEN struct({s['_i']} AS _i, bigint({s['_total']}) AS _total, bigint({s['_start']}) AS _before, "
            f"{_cut_cell(str(s['_n']), v, lo, hi)} AS _cell, {v} AS _v, array({ranks}) AS _ranks) END"
        )
    return values.where(" OR ".join(holds)).selectExpr(f"explode(array_compact(array({', '.join(hits)}))) AS _x").selectExpr("_x.*")


def _inside_joined(values: DataFrame, columns: list[str], by: list[str], open_: DataFrame) -> DataFrame:
    """Values in the open cells of all groups."""
    keys = [_quoted(b) for b in by]
    cells = open_.groupBy(*by, "_i", "_total", "_start", "_n", "_lo", "_hi").agg(F.collect_list("_rank").alias("_ranks"))
    named = [f"{k} AS _by{i}" for i, k in enumerate(keys)]
    cells = cells.selectExpr(*named, "_i AS _of", "_total", "_start AS _before", "_n", "_lo", "_hi", "_ranks")
    on = " AND ".join([*[f"{k} <=> _by{i}" for i, k in enumerate(keys)], "_i = _of", "_v BETWEEN _lo AND _hi"])
    joined = _long(values, by, columns).where("_v IS NOT NULL").join(cells, F.expr(on))
    return joined.selectExpr(*keys, "_i", "_total", "_before", f"{_cut_cell('_n', '_v', '_lo', '_hi')} AS _cell", "_v", "_ranks")


def _values(df: DataFrame, probabilities: dict[str, Iterable[float]], by: list[str]) -> tuple[DataFrame, dict[str, list[float]]]:
    ps = {c: sorted({float(p) for p in wanted}) for c, wanted in probabilities.items()}
    ps = {c: wanted for c, wanted in ps.items() if wanted}
    types = {f.name: f.dataType for f in df.schema}
    clean = {c: f"nullif(double({_quoted(c)}), double('nan'))" if is_float(types[c]) else f"double({_quoted(c)})" for c in ps}
    return df.selectExpr(*[_quoted(b) for b in by], *[f"{clean[c]} AS {_quoted(c)}" for c in ps]), ps


def quantile_table(df: DataFrame, probabilities: dict[str, Iterable[float]], by: Iterable[str]) -> DataFrame:
    """Quantiles of every group, however many there are: (by..., q_<column>_<j>) with j in order of p."""
    by = list(by)
    values, ps = _values(df, probabilities, by)
    found = stage(_first_round(values, by, ps))
    done = found.where(f"_rank IS NULL OR {VALUE} IS NOT NULL")
    while True:
        open_ = found.where(f"_rank IS NOT NULL AND {VALUE} IS NULL")
        if open_.isEmpty():
            break
        found = stage(_next_round(_inside_joined(values, list(ps), by, open_), by))
        done = done.unionByName(found.where(f"{VALUE} IS NOT NULL"))

    def answer(i: int, c: str, j: int, p: float) -> str:
        at = f"((_total - 1) * {_double(p)})"
        low = f"max(CASE WHEN _i = {i} AND _rank = floor({at}) THEN {VALUE} END)"
        high = f"max(CASE WHEN _i = {i} AND _rank = least(floor({at}) + 1, _total - 1) THEN {VALUE} END)"
        part = f"max(CASE WHEN _i = {i} THEN {at} - floor({at}) END)"
        return f"CASE WHEN {part} = 0 OR {low} = {high} THEN {low} ELSE {low} + {part} * ({high} - {low}) END AS {_quoted(f'q_{c}_{j}')}"

    return done.groupBy(*by).agg(*[F.expr(answer(i, c, j, p)) for i, c in enumerate(ps) for j, p in enumerate(ps[c])])


def exact_quantiles(
    df: DataFrame, probabilities: dict[str, Iterable[float]], by: Iterable[str] = ()
) -> dict[Group, dict[str, dict[float, float | None]]]:
    """Linear-interpolated quantiles {group: {column: {p: value}}} on the driver.

    Columns must be numeric; NaN counts as missing, like NULL.  The single group of an ungrouped
    call is the empty tuple.  `quantile_table` leaves the answers of many groups in Spark.
    """
    by = list(by)
    values, ps = _values(df, probabilities, by)
    if not ps:
        return {}
    if by:
        rows = quantile_table(df, ps, by).collect()
        return {tuple(r[b] for b in by): {c: {p: r[f"q_{c}_{j}"] for j, p in enumerate(ps[c])} for c in ps} for r in rows}
    around = _ranks_around(values, ps)
    return {(): {c: {p: interpolated(*around[c][p]) for p in ps[c]} for c in ps}}


def interpolated(low: float | None, high: float | None, part: float) -> float | None:
    return low if low is None or not part or low == high else low + part * (high - low)


def ranks_around(df: DataFrame, probabilities: dict[str, Iterable[float]]) -> dict[str, dict[float, tuple]]:
    """{column: {p: (value at the rank below, value at the rank above, share of the way)}}."""
    values, ps = _values(df, probabilities, [])
    return _ranks_around(values, ps) if ps else {}


def _ranks_around(values: DataFrame, ps: dict[str, list[float]]) -> dict[str, dict[float, tuple]]:
    known: dict[tuple[int, int], float] = {}
    totals: dict[int, int] = {}
    found = _first_round(values, [], ps)
    while True:
        open_: dict[tuple[int, int], dict] = {}
        for r in found.selectExpr("*", f"{VALUE} AS _value").collect():
            totals[r["_i"]] = r["_total"]
            if r["_value"] is not None:
                known[r["_i"], r["_rank"]] = r["_value"]
            elif r["_rank"] is not None:
                open_.setdefault((r["_i"], r["_start"]), r.asDict() | {"_ranks": []})["_ranks"].append(r["_rank"])
        if not open_:
            break
        found = _next_round(_inside_listed(values, list(ps), list(open_.values())), [])
    result: dict[str, dict[float, tuple]] = {}
    for i, c in enumerate(ps):
        result[c] = {}
        for p in ps[c]:
            at = (totals.get(i, 0) - 1) * p
            rank = int(at // 1)
            result[c][p] = known.get((i, rank)), known.get((i, min(rank + 1, totals.get(i, 0) - 1))), at - rank
    return result
