"""SQL text for least squares and Newton steps: cross products and the sweep operator.

Independent of the library: everything is unrolled into common table expressions on
a row of matrix cells ``a_i_j`` (i <= j), the last index being the target.
"""

from __future__ import annotations


def cell(i: int, j: int) -> str:
    return f"a_{min(i, j)}_{max(i, j)}"


def cells(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def gram(name: str, source: str, columns: list[str], keys: list[str] = ()) -> str:
    """Cross products of the expressions (constant first, target last) per key."""
    lead = ", ".join(keys) + ", " if keys else ""
    sums = ", ".join(
        f"sum(CAST({columns[i]} AS DOUBLE) * ({columns[j]})) AS {cell(i, j)}" for i, j in cells(len(columns))
    )
    tail = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"{name} AS MATERIALIZED (SELECT {lead}{sums} FROM {source}{tail})"


def sweep(name: str, source: str, predictors: int, keys: list[str] = (), mask: str | None = None) -> str:
    """Sweep predictors 0..n-1; afterwards a_i_y are coefficients and a_y_y is SSE.

    With ``mask`` (an integer column) predictor k is swept only if bit k is set.
    """
    width = predictors + 1
    lead = ", ".join(keys) + ", " if keys else ""
    steps, previous = [], source
    for k in range(predictors):
        d = cell(k, k)
        out = []
        for i, j in cells(width):
            a = cell(i, j)
            if i == k and j == k:
                new = f"-1.0 / {d}"
            elif k in (i, j):
                new = f"{a} / {d}"
            else:
                new = f"{a} - {cell(i, k)} * {cell(k, j)} / {d}"
            if mask:
                new = f"CASE WHEN ({mask} >> {k}) & 1 = 1 THEN {new} ELSE {a} END"
            out.append(f"{new} AS {a}")
        current = name if k == predictors - 1 else f"{name}_{k}"
        steps.append(f"{current} AS MATERIALIZED (SELECT {lead}{', '.join(out)} FROM {previous})")
        previous = current
    return ",\n".join(steps)


def unit_masks(units: list[list[int]]) -> list[int]:
    """Predictor bit masks of the units (each a list of predictor numbers)."""
    return [sum(1 << c for c in u) for u in units]


def all_subsets(name: str, units: list[list[int]]) -> str:
    """Table (umask, pmask, k): unit subset, predictor subset with constant, parameters."""
    bits = unit_masks(units)
    rows = []
    for s in range(1 << len(units)):
        p = 1
        for u, b in enumerate(bits):
            if s >> u & 1:
                p |= b
        rows.append(f"({s}, {p}, {bin(p).count('1')})")
    return f"{name}(umask, pmask, k) AS (VALUES {', '.join(rows)})"


def greedy_forward(name: str, metric: str, units: int, enter: float) -> str:
    """Path of forward selection over table ``metric(umask, value)`` as (step, umask)."""
    return f"""
{name} AS (
  SELECT 0 AS step, 0 AS umask, true AS live
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN best ELSE umask END, ok FROM (
    SELECT p.step, p.umask, c.best, m0.value - c.value > {enter} AS ok
    FROM {name} p JOIN {metric} m0 ON m0.umask = p.umask,
    LATERAL (
      SELECT p.umask | (1 << u) AS best, m.value FROM range({units}) t(u)
      JOIN {metric} m ON m.umask = (p.umask | (1 << u))
      WHERE (p.umask >> u) & 1 = 0 ORDER BY m.value, u LIMIT 1
    ) c WHERE p.live)
)"""


def newton(
    name: str, source: str, columns: list[str], y: str, iterations: int, l2: float,
    models: str = "(SELECT 0 AS model, -1 AS pmask)", keys: list[str] = ("model",), mask: str | None = None,
    where: str = "true",
) -> str:
    """Newton steps of penalised logistic regression as a chain of CTEs.

    Ends with ``name(keys, pmask, w_0 .. w_p-1)``.
    """
    p = len(columns)
    lead = ", ".join(keys)
    parts = [
        f"{name}_w0 AS MATERIALIZED (SELECT {lead}, pmask, {', '.join(f'CAST(0 AS DOUBLE) AS w_{i}' for i in range(p))} "
        f"FROM {models})"
    ]
    for t in range(1, iterations + 1):
        w = f"{name}_w{t - 1}"
        eta = " + ".join(f"w.w_{i} * ({columns[i]})" for i in range(p))
        sums = []
        for i, j in cells(p + 1):
            if j == p and i < p:
                penalty = "" if i == 0 else f" - {l2} * any_value(w.w_{i})"
                sums.append(f"(sum((({y}) - q) * ({columns[i]})){penalty}) * {on_any(mask, i)} AS {cell(i, j)}")
            elif i == p:
                sums.append(f"0.0 AS {cell(i, j)}")
            else:
                penalty = f" + {l2}" if i == j and i > 0 else ""
                sums.append(f"sum(q * (1 - q) * ({columns[i]}) * ({columns[j]})){penalty} AS {cell(i, j)}")
        wkeys = ", ".join(f"w.{k}" for k in keys)
        parts.append(
            f"{name}_h{t} AS MATERIALIZED (SELECT {wkeys}, w.pmask, {', '.join(sums)} FROM ("
            f"SELECT s.*, w.* , 1.0 / (1.0 + exp(-({eta}))) AS q FROM {source} s, {w} w WHERE {where}) w "
            f"GROUP BY {wkeys}, w.pmask)"
        )
        parts.append(sweep(f"{name}_s{t}", f"{name}_h{t}", p, [*keys, "pmask"], "pmask" if mask else None))
        joined = " AND ".join(f"w.{k} = s.{k}" for k in keys)
        out = name if t == iterations else f"{name}_w{t}"
        step = ", ".join(
            f"w.w_{i} + " + (f"CASE WHEN ((w.pmask >> {i}) & 1) = 1 THEN s.{cell(i, p)} ELSE 0 END" if mask else f"s.{cell(i, p)}")
            + f" AS w_{i}" for i in range(p)
        )
        parts.append(
            f"{out} AS MATERIALIZED (SELECT {', '.join('w.' + k for k in keys)}, w.pmask, {step} "
            f"FROM {w} w JOIN {name}_s{t} s ON {joined})"
        )
    return ",\n".join(parts)


def on_any(mask: str | None, i: int) -> str:
    return f"((any_value(w.pmask) >> {i}) & 1)" if mask else "1"


def _simpson(f: str, end: str, steps: int = 4000) -> str:
    """Integral from 0 to ``end`` of ``f``, which is written in {u}."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    at = f"(i * ({end}) / {steps}.0::DOUBLE)"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {f.format(u=at)})) * ({end}) / {3 * steps}.0::DOUBLE)"


def f_tail(f: str, d1: str, d2: str, cap: float = 30.0) -> str:
    """P(F >= f) by integrating the density of the root of d1 F; beyond ``cap`` nothing is left at six digits."""
    front = f"2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0) - {d1} / 2.0 * ln({d2}))"
    return f"(1 - {front} * {_simpson(f'pow({{u}}, {d1} - 1) * pow(1 + {{u}} * {{u}} / ({d2}), -({d1} + {d2}) / 2.0)', f'least(sqrt({d1} * ({f})), {cap})')})"


def t_tail(t: str, df: str) -> str:
    """P(|T| >= |t|)."""
    return f_tail(f"pow({t}, 2)", "1", df, 14.0)


def chi2_tail(x: str, df: int, cap: float = 40.0) -> str:
    """P(X >= x) by integrating the density of the root of X."""
    front = f"exp((1 - {df} / 2.0) * ln(2) - lgamma({df} / 2.0))"
    return f"(1 - {front} * {_simpson(f'pow({{u}}, {df} - 1) * exp(-{{u}} * {{u}} / 2)', f'least(sqrt({x}), {cap})')})"


def t_quantile_975(df: str) -> str:
    """The 0.975 quantile of the t distribution from that of the normal, by powers of 1 / df."""
    z = 1.959963984540054
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return "(" + " + ".join(f"{c!r} / pow({df}, {i})" for i, c in enumerate(terms)) + ")"


def stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' WHEN {p} < 0.1 THEN '.' ELSE '' END"
