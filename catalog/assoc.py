"""Association, transformation, design and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.operators import assoc, design, schema, sparse, split, transforms
from veta.operators.design import ModelSpec

from . import fixtures as fx
from .base import R, query, rounded, uniform_sql
from .fixtures import sql

PS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def edges_cte(view: str, c: str, name: str) -> str:
    qs = ", ".join(f"quantile_cont({c}, {p})" for p in PS)
    return (
        f"{name}_q AS (SELECT list_sort(list_distinct([{qs}])) AS e FROM {view}), "
        f"{name} AS (SELECT any_value(e) AS e, min({c}) FILTER ({c} > e[1]) AS second FROM {view}, {name}_q)"
    )


def bin_sql(c: str, name: str) -> str:
    """Right-closed bin of c; minimum and null go to the bin of the next larger value."""

    def inner(v: str) -> str:
        return f"len(list_filter(list_slice({name}.e, 2, len({name}.e) - 1), lambda b: b < {v})) + 1"

    return f"CAST(CASE WHEN {c} > {name}.e[1] THEN {inner(c)} ELSE {inner(name + '.second')} END AS INTEGER)"


@query("bin_quintiles", sql("line_nulls", f"""
SELECT key, {bin_sql('qty', 'eq')} AS qty_bin, {bin_sql('price', 'ep')} AS price_bin FROM line_nulls, eq, ep""", ",\n".join([
    edges_cte("line_nulls", "qty", "eq"), edges_cte("line_nulls", "price", "ep")])))
def bin_quintiles(spark, d):
    return assoc.bin_quintiles(fx.line_nulls(spark, d), ["qty", "price"]).select("key", "qty_bin", "price_bin")


@query("contingency_table", sql("cust_model", """
SELECT segment AS level_a, region AS level_b, count(*) AS n FROM cust_model GROUP BY 1, 2"""))
def contingency_table(spark, d):
    return assoc.contingency_table(fx.cust_model(spark, d), "segment", "region")


@query("contingency_table_binned", sql("cust_model", f"""
SELECT CAST({bin_sql('acctbal', 'ea')} AS VARCHAR) AS level_a, segment AS level_b, count(*) AS n
FROM cust_model, ea GROUP BY 1, 2""", edges_cte("cust_model", "acctbal", "ea")))
def contingency_table_binned(spark, d):
    return assoc.contingency_table(fx.cust_table(spark, d), "acctbal", "segment")


@query("row_normalized_crosstab", sql("doc_model", f"""
SELECT lang AS category, quality AS class, count(*) AS n,
  {R("count(*) / sum(count(*)) OVER (PARTITION BY lang)")} AS share FROM doc_model GROUP BY lang, quality"""))
def row_normalized_crosstab(spark, d):
    return rounded(assoc.row_normalized_crosstab(fx.doc_model(spark, d), "lang", "quality"))


def cramer_ctes(long: str) -> str:
    """From long(variable, level, target_level): chi-square cell by cell, with correction."""
    return f"""
long AS ({long}),
obs AS (SELECT variable, level, target_level, count(*) AS o FROM long
        WHERE level IS NOT NULL AND target_level IS NOT NULL GROUP BY ALL),
rs AS (SELECT variable, level, sum(o) AS r FROM obs GROUP BY ALL),
cs AS (SELECT variable, target_level, sum(o) AS c FROM obs GROUP BY ALL),
ns AS (SELECT variable, sum(o) AS n, count(DISTINCT level) AS nr, count(DISTINCT target_level) AS nc FROM obs GROUP BY ALL),
grid AS (SELECT rs.variable, n, nr, nc, r * c / n AS e, coalesce(o, 0) AS o
         FROM rs JOIN cs ON rs.variable = cs.variable JOIN ns ON ns.variable = rs.variable
         LEFT JOIN obs ON obs.variable = rs.variable AND obs.level = rs.level AND obs.target_level = cs.target_level),
chi AS (SELECT variable, any_value(n) AS n, any_value(nr) AS nr, any_value(nc) AS nc,
          sum(pow(greatest(abs(o - e) - CASE WHEN nr = 2 AND nc = 2 THEN 0.5 ELSE 0 END, 0), 2) / e) AS chi2
        FROM grid GROUP BY variable),
vs AS (SELECT variable, nr, nc, n, CASE WHEN least(nr, nc) > 1 THEN chi2 END AS chi2,
          CASE WHEN least(nr, nc) > 1 THEN sqrt(chi2 / (n * (least(nr, nc) - 1))) END AS v FROM chi)"""


_V = f"""SELECT variable, CAST(nr AS INTEGER) AS n_rows, CAST(nc AS INTEGER) AS n_cols, CAST(n AS BIGINT) AS n,
  {R('chi2', 5)} AS chi2, {R('v')} AS cramers_v FROM vs"""

_RANK = ["acctbal", "n_orders", "total", "mean_price"]


@query("cramers_v_ranking", sql("cust_model", _V, ",\n".join(
    [edges_cte('cust_model', c, 'e' + c) for c in _RANK]) + "," + cramer_ctes(
    " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({bin_sql(c, 'e' + c)} AS VARCHAR) AS level, segment AS target_level "
                       f"FROM cust_model, e{c}" for c in _RANK)
    + " UNION ALL SELECT 'region', region, segment FROM cust_model UNION ALL SELECT 'nation', nation, segment FROM cust_model")))
def cramers_v_ranking(spark, d):
    return rounded(assoc.cramers_v_ranking(fx.cust_table(spark, d), [*_RANK, "region", "nation"], "segment"), chi2=5)


@query("cramers_v", sql("doc_model", _V, cramer_ctes(
    "SELECT 'toxic' AS variable, CAST(toxic AS VARCHAR) AS level, CAST(quality AS VARCHAR) AS target_level FROM doc_model")))
def cramers_v(spark, d):
    """Two binary columns: the corrected 2 x 2 case."""
    return rounded(assoc.cramers_v(fx.doc_table(spark, d), "toxic", "quality"), chi2=5)


_PAIRS = [("y", "price"), ("y", "qty"), ("tax", "disc")]


@query("correlation", sql("line_nulls", " UNION ALL ".join(
    f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, {R(f'corr({a}, {b})')} AS corr FROM line_nulls" for a, b in _PAIRS)))
def correlation(spark, d):
    return rounded(assoc.correlation(fx.line_nulls(spark, d), _PAIRS))


@query("standardize", sql("event_model", f"""
SELECT event_id, {R('(value - avg(value) OVER ()) / stddev_pop(value) OVER ()')} AS value_z FROM event_model"""))
def standardize(spark, d):
    return rounded(transforms.standardize(fx.event_model(spark, d), ["value"]).select("event_id", "value_z"))


_T = {
    "x": "{x}", "logx": "ln({x})", "expx": "exp({x})", "sqrx": "{x} * {x}", "sqrtx": "sqrt({x})",
    "cuartax": "pow({x}, 4)", "raiz4": "pow({x}, 0.25)",
}


def _shifted_cte(view: str, columns: list[str], keep: str) -> str:
    z = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"
    zs = ", ".join(f"{z(c)} AS z_{c}" for c in columns)
    ss = ", ".join(f"z_{c} + abs(min(z_{c}) OVER ()) * 1.0001 AS s_{c}" for c in columns)
    return f"zs AS (SELECT {keep}, {zs} FROM {view}), shifted AS MATERIALIZED (SELECT {keep}, {ss} FROM zs)"


def _chosen_sql(scores: str) -> str:
    return f"""
SELECT variable, transform, {R('score')} AS score,
  row_number() OVER (PARTITION BY variable ORDER BY score < best - 1e-12, pos) = 1 AS chosen
FROM (SELECT *, max(score) OVER (PARTITION BY variable) AS best FROM ({scores}))"""


@query("best_transform_corr", sql("event_model", _chosen_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, '{t}' AS transform, {i} AS pos, abs(corr({e.format(x='s_' + c)}, target)) AS score FROM shifted"
    for c, target in [("value", "k")] for i, (t, e) in enumerate(_T.items()))),
    _shifted_cte("(SELECT *, k AS target FROM event_model)", ["value"], "target")))
def best_transform_corr(spark, d):
    return rounded(transforms.best_transform_corr(fx.event_model(spark, d), ["value"], "k"))


_TC = {f"{c}|{t}": (c, t, e.format(x=f"s_{c}")) for c in ("acctbal", "total") for t, e in _T.items()}


def _slug(i: int) -> str:
    return f"t{i}"


_WIDE = "wide AS MATERIALIZED (SELECT segment, " + ", ".join(f"{e} AS {_slug(i)}" for i, (_, _, e) in enumerate(_TC.values())) + " FROM shifted)"


@query("best_transform_cramer", sql("cust_model", _chosen_sql(
    "SELECT names.variable, names.transform, names.pos, v AS score FROM vs JOIN names ON names.slug = vs.variable"),
    _shifted_cte("cust_model", ["acctbal", "total"], "segment") + "," + _WIDE + ",\n" + ",\n".join(
        edges_cte('wide', _slug(i), 'e' + _slug(i)) for i in range(len(_TC)))
    + "," + cramer_ctes(" UNION ALL ".join(
        f"SELECT '{_slug(i)}' AS variable, CAST({bin_sql(_slug(i), 'e' + _slug(i))} AS VARCHAR) AS level, segment AS target_level "
        f"FROM wide, e{_slug(i)}" for i in range(len(_TC))))
    + ", names(slug, variable, transform, pos) AS (VALUES " + ", ".join(
        f"('{_slug(i)}', '{c}', '{t}', {i})" for i, (c, t, _) in enumerate(_TC.values())) + ")"))
def best_transform_cramer(spark, d):
    return rounded(transforms.best_transform_cramer(fx.cust_table(spark, d), ["acctbal", "total"], "segment"))


_EVENT_SCORES = " UNION ALL ".join(
    f"SELECT 'value' AS variable, '{t}' AS transform, {i} AS pos, abs(corr({e.format(x='s_value')}, target)) AS score FROM shifted"
    for i, (t, e) in enumerate(_T.items()))


@query("auto_transform", sql("event_model", f"""
SELECT event_id, transform || 'value' AS name, {R('CASE transform ' + ' '.join(
    f"WHEN '{t}' THEN {e.format(x='s_value')}" for t, e in _T.items()) + ' END', 3)} AS value
FROM shifted, (SELECT transform FROM ({_chosen_sql(_EVENT_SCORES)}) WHERE chosen)""",
    _shifted_cte("(SELECT *, k AS target FROM event_model)", ["value"], "event_id, target")))
def auto_transform(spark, d):
    """The result column is named after the winner, so its name is a value here."""
    out = transforms.auto_transform(fx.event_model(spark, d), ["value"], "k", keep=["event_id"])
    name = out.columns[1]
    return rounded(out.select("event_id", F.lit(name).alias("name"), F.col(name).alias("value")), 3)


# --- design ---------------------------------------------------------------------------

@query("one_hot", sql("line_nulls", """
SELECT key, CAST(flag IS NOT NULL AND flag = 'N' AS INTEGER)::DOUBLE AS flag_N,
  CAST(flag IS NOT NULL AND flag = 'R' AS INTEGER)::DOUBLE AS flag_R, CAST(status = 'O' AS INTEGER)::DOUBLE AS status_O FROM line_nulls"""))
def one_hot(spark, d):
    return design.one_hot(fx.line_nulls(spark, d), ["flag", "status"], keep=["key"])


@query("interactions", sql("line_model", """
SELECT key, qty * (flag = 'N')::INT AS qty_flag_N, qty * (flag = 'R')::INT AS qty_flag_R, qty * disc AS qty_disc FROM line_model"""))
def interactions(spark, d):
    return design.interactions(fx.line_model(spark, d), [("qty", "flag"), ("qty", "disc")], keep=["key"])


@query("design_matrix", sql("line_model", """
SELECT key, qty, tax, (flag = 'N')::INT::DOUBLE AS flag_N, (flag = 'R')::INT::DOUBLE AS flag_R,
  (status = 'O')::INT::DOUBLE AS status_O, qty * (status = 'O')::INT AS qty_status_O FROM line_model"""))
def design_matrix(spark, d):
    spec = ModelSpec.of(["qty", "tax"], ["flag", "status"], [("qty", "status")])
    return design.design_matrix(fx.line_model(spark, d), spec, keep=["key"])


# --- wide categories: parts as text, more levels than a dense design takes ------------------

WIDE_CTES = """
WITH places AS (SELECT CAST(l_partkey AS VARCHAR) AS level, dense_rank() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 AS place
  FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)),
width AS (SELECT greatest(count(*) - 1, 0) AS w FROM places),
line AS (SELECT l_orderkey, l_linenumber, row_number() OVER () AS row_id, l_quantity AS qty, l_discount AS disc, l_tax AS tax, coalesce(place, 0) AS place, w
  FROM lineitem CROSS JOIN width LEFT JOIN places ON CAST(l_partkey AS VARCHAR) = level),
entries AS (SELECT *, 1 AS position, qty AS value FROM line UNION ALL SELECT *, 1 + place, 1.0 FROM line WHERE place > 0
  UNION ALL SELECT *, 1 + w + place, qty FROM line WHERE place > 0)"""


def _wide(spark, d):
    rows = fx.table(spark, d, "lineitem")
    spec = ModelSpec.of(["qty"], ["part"], [("qty", "part")])
    return rows.withColumns({"qty": F.col("l_quantity"), "part": F.col("l_partkey").cast("string"), "disc": F.col("l_discount"), "tax": F.col("l_tax")}), spec


@query("design_matrix_wide", WIDE_CTES + " SELECT l_orderkey, l_linenumber, CAST(position AS BIGINT) AS position, value FROM entries")
def design_matrix_wide(spark, d):
    """Every non-zero design column of every row."""
    df, spec = _wide(spark, d)
    rows = sparse.sparse_design(df, spec, ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", F.explode(F.arrays_zip("positions", "values")).alias("e")).select(
        "l_orderkey", "l_linenumber", F.col("e.positions").alias("position"), F.col("e.values").alias("value"))


@query("moment_matrix_wide", WIDE_CTES + f""",
whole AS (SELECT row_id, position, value FROM entries WHERE qty IS NOT NULL AND disc IS NOT NULL
  UNION ALL SELECT row_id, 0, 1.0 FROM line WHERE qty IS NOT NULL AND disc IS NOT NULL
  UNION ALL SELECT row_id, 2 * w + 2, disc FROM line WHERE qty IS NOT NULL AND disc IS NOT NULL)
SELECT CAST(a.position AS BIGINT) AS i, CAST(b.position AS BIGINT) AS j, {R('sum(a.value * b.value)', 4)} AS value
FROM whole a JOIN whole b ON a.row_id = b.row_id AND a.position <= b.position GROUP BY ALL""")
def moment_matrix_wide(spark, d):
    df, spec = _wide(spark, d)
    return rounded(sparse.SparseDesign.fit(df, spec).cross_products(df, "disc"), 4)


@query("ols_wide_category", WIDE_CTES + f""",
whole AS (SELECT place, disc AS x, tax AS z, qty AS y FROM line WHERE disc IS NOT NULL AND tax IS NOT NULL AND qty IS NOT NULL),
means AS (SELECT place, avg(x) AS x, avg(z) AS z, avg(y) AS y FROM whole GROUP BY place),
within AS (SELECT w.x - m.x AS x, w.z - m.z AS z, w.y - m.y AS y FROM whole w JOIN means m USING (place)),
s AS (SELECT sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy FROM within),
b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s),
effects AS (SELECT place, y - bx * x - bz * z AS effect FROM means, b),
base AS (SELECT place, effect FROM effects ORDER BY place LIMIT 1)
SELECT 'const' AS term, NULL AS level, {R('effect')} AS estimate FROM base
UNION ALL SELECT 'disc', NULL, {R('bx')} FROM b UNION ALL SELECT 'tax', NULL, {R('bz')} FROM b
UNION ALL SELECT 'part', level, {R('e.effect - base.effect')} FROM effects e JOIN base ON e.place > base.place JOIN places p ON p.place = e.place""")
def ols_wide_category(spark, d):
    df, _ = _wide(spark, d)
    return rounded(sparse.ols_wide(df, ModelSpec.of(["disc", "tax"]), "part", "qty"))


@query("align_design_columns", sql("doc_model", """
SELECT doc_id, letters, """ + ", ".join(
    f"(source = '{v}')::INT::DOUBLE AS \"source_{v}\"" for v in ("b", "c")) + """ FROM
 (SELECT doc_id, letters, CASE WHEN letters > 0.8 THEN 'd' WHEN letters > 0.75 THEN 'c' WHEN letters > 0.7 THEN 'b' ELSE 'a' END AS source
  FROM doc_model) WHERE letters > 0.72"""))
def align_design_columns(spark, d):
    """Training never sees level d: it gets zeros."""
    letters = F.col("letters")
    df = fx.doc_table(spark, d).select("doc_id", "letters").withColumn(
        "source", F.when(letters > 0.8, "d").when(letters > 0.75, "c").when(letters > 0.7, "b").otherwise("a")
    )
    train, other = df.where("source <> 'd'"), df.where("letters > 0.72")
    return design.align_design_columns(train, other, ModelSpec.of(["letters"], ["source"]), keep=["doc_id"])


# --- rows by key ----------------------------------------------------------------------

@query("select_rows_by_id", sql("line_split", "SELECT key, qty FROM line_split WHERE split = 'train'"))
def select_rows_by_id(spark, d):
    df = fx.line_model(spark, d)
    train = split.train_test_split(df, "key").where("split = 'train'").select("key")
    return schema.select_rows_by_id(df, train, ["key"]).select("key", "qty")


@query("align_on_row_id", sql("doc_model", "SELECT doc_id, letters, quality FROM doc_model"))
def align_on_row_id(spark, d):
    df = fx.doc_model(spark, d)
    return schema.align_on_row_id(df.select("doc_id", "letters"), df.select("doc_id", "quality"), ["doc_id"])


# --- splits ---------------------------------------------------------------------------

@query("train_test_split", sql("line_split", "SELECT key, split FROM line_split"))
def train_test_split(spark, d):
    return split.train_test_split(fx.line_model(spark, d), "key").select("key", "split")


@query("train_test_split_exact", sql("line_model", f"""
SELECT key, CASE WHEN row_number() OVER (ORDER BY u, key) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM (SELECT key, {uniform_sql('key', 'split-123')} AS u FROM line_model)"""))
def train_test_split_exact(spark, d):
    return split.train_test_split(fx.line_model(spark, d), "key", exact=True).select("key", "split")


@query("stratified_split", sql("doc_model", f"""
SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY u, doc_id) <= quota THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, quality, {uniform_sql('doc_id', 'split-123')} AS u FROM doc_model) JOIN quotas USING (quality)""", """
fair AS (SELECT quality, ceil(0.2 * sum(count(*)) OVER ()) * count(*) / sum(count(*)) OVER () AS f,
           ceil(0.2 * sum(count(*)) OVER ()) AS wanted FROM doc_model GROUP BY quality),
quotas AS (SELECT quality, floor(f) + CASE WHEN row_number() OVER (ORDER BY f - floor(f) DESC, quality)
             <= wanted - sum(floor(f)) OVER () THEN 1 ELSE 0 END AS quota FROM fair)"""))
def stratified_split(spark, d):
    df = split.train_test_split(fx.doc_table(spark, d), "doc_id", stratify="quality", exact=True)
    return df.select("doc_id", "quality", "split")


@query("kfold_assign", sql("line_model", "SELECT key, " + ", ".join(
    f"CAST(floor({uniform_sql('key', f'fold-{123 + r}')} * 5) AS INTEGER) AS fold_{r}" for r in range(3)) + " FROM line_model"))
def kfold_assign(spark, d):
    return split.kfold_assign(fx.line_model(spark, d), "key", 5, 3).select("key", "fold_0", "fold_1", "fold_2")


STRAT_FOLDS = """
cls AS (SELECT quality, n, sum(n) OVER (ORDER BY first_id) - n AS start FROM
  (SELECT quality, count(*) AS n, min(doc_id) AS first_id FROM doc_model GROUP BY quality)),
sizes AS (SELECT quality, f, floor((start + n - 1 - f) / 5.0) - floor((start - 1 - f) / 5.0) AS size FROM cls, range(5) t(f)),
ends AS (SELECT quality, f, sum(size) OVER (PARTITION BY quality ORDER BY f) AS done, size FROM sizes),
folded AS (SELECT r.doc_id, r.quality, CAST(e.f AS INTEGER) AS fold FROM
  (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn FROM doc_model) r
  JOIN ends e ON e.quality = r.quality AND r.rn <= e.done AND r.rn > e.done - e.size)"""


@query("stratified_kfold", sql("doc_model", "SELECT doc_id, quality, fold FROM folded", STRAT_FOLDS))
def stratified_kfold(spark, d):
    return split.stratified_kfold(fx.doc_table(spark, d), "doc_id", "quality").select("doc_id", "quality", "fold")


@query("stratified_kfold_big_key", sql("doc_model", "SELECT doc_id, quality, fold FROM folded", STRAT_FOLDS))
def stratified_kfold_big_key(spark, d):
    """Keys beyond 2^53, which doubles cannot tell apart."""
    df = fx.doc_table(spark, d).withColumn("big_key", F.col("doc_id") + F.lit(2**60))
    return split.stratified_kfold(df, "big_key", "quality").select("doc_id", "quality", "fold")


@query("stratified_kfold_text_key", sql("doc_model", "SELECT doc_id, quality, fold FROM folded", STRAT_FOLDS))
def stratified_kfold_text_key(spark, d):
    df = fx.doc_table(spark, d).withColumn("text_key", F.lpad(F.col("doc_id").cast("string"), 18, "0"))
    return split.stratified_kfold(df, "text_key", "quality").select("doc_id", "quality", "fold")
