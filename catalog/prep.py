"""Profiling, repair, outlier and imputation queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from veta.operators import impute, outliers, profile, schema
from veta.sources import tables

from . import fixtures as fx
from .base import R, query, rounded, uniform_sql
from .fixtures import sql

LINE_NUM = ["qty", "disc", "tax", "price", "y"]


def _union(template: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(template.format(c=c) for c in columns)


def _describe_sql(view: str, columns: list[str]) -> str:
    parts = [("avg({c})", "mean"), ("stddev_samp({c})", "std"), ("min({c})", "min"), ("max({c})", "max"),
             ("skewness({c})", "skew"), ("kurtosis({c})", "kurtosis")]
    parts += [(f"quantile_cont({{c}}, {p})", f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    listed = ", ".join(f"{R(e, 8)} AS {n}" for e, n in parts)
    return sql(view, _union(f"SELECT '{{c}}' AS variable, count({{c}}) AS n, {listed} FROM {view}", columns))


@query("describe_numeric", _describe_sql("line_nulls", LINE_NUM[:4]))
def describe_numeric(spark, d):
    return rounded(profile.describe_numeric(fx.line_nulls(spark, d), LINE_NUM[:4]), 8)


@query("describe_numeric_events", _describe_sql("event_model", ["value", "k"]))
def describe_numeric_events(spark, d):
    return rounded(profile.describe_numeric(fx.event_model(spark, d), ["value", "k"]), 8)


_QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("target_profile", sql("event_model", "SELECT 'value' AS variable, count(value) AS n, count(*) - count(value) AS missing, "
       + ", ".join(R(f"{f}(value)") + f" AS {n}" for f, n in [
           ("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"), ("skewness", "skew"), ("kurtosis", "kurtosis")])
       + ", " + ", ".join(R(f"quantile_cont(value, {p})") + f" AS q{round(p * 100):02d}" for p in _QS) + " FROM event_model"))
def target_profile(spark, d):
    return rounded(profile.target_profile(fx.event_model(spark, d), "value"))


@query("binary_profile", sql("doc_model", f"""
SELECT 'quality' AS variable, count(quality) AS n, count(*) - count(quality) AS missing,
       {R("avg(CAST(quality = 1 AS INTEGER))")} AS p1, {R("avg(CAST(quality = 0 AS INTEGER))")} AS p0 FROM doc_model"""))
def binary_profile(spark, d):
    return rounded(profile.binary_profile(fx.doc_model(spark, d), "quality"))


@query("quantiles_exact", sql("event_model", "SELECT " + ", ".join(
    R(f"quantile_cont(value, {p})") + f" AS p{round(p * 1000):03d}" for p in (0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0))
    + " FROM event_model"))
def quantiles_exact(spark, d):
    """The sampling selection, forced, so the scalable path is what gets checked."""
    from veta.functions.quantiles import exact_quantiles

    ps = (0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0)
    q = exact_quantiles(fx.event_model(spark, d).select("value"), {"value": ps})[()]["value"]
    row = tuple(q[p] for p in ps)
    return rounded(spark.createDataFrame([row], ", ".join(f"p{round(p * 1000):03d} double" for p in ps)))


_FREQ = ["flag", "status"]


@query("frequency_table", sql("line_nulls", _union(
    "SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM line_nulls GROUP BY {c}", _FREQ)))
def frequency_table(spark, d):
    return profile.frequency_table(fx.line_nulls(spark, d), _FREQ)


@query("frequency_pct", sql("line_nulls", _union(
    "SELECT '{c}' AS variable, {c} AS value, count(*) AS n, " + R("count(*) / sum(count(*)) OVER ()")
    + " AS pct FROM line_nulls WHERE {c} IS NOT NULL GROUP BY {c}", _FREQ)))
def frequency_pct(spark, d):
    return rounded(profile.frequency_table_pct(fx.line_nulls(spark, d), _FREQ))


@query("frequency_numeric", sql("line_model", _union(
    "SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, count(*) AS n, " + R("count(*) / sum(count(*)) OVER ()")
    + " AS pct FROM line_model GROUP BY {c}", ["lineno", "yb"])))
def frequency_numeric(spark, d):
    return rounded(profile.frequency_numeric(fx.line_model(spark, d), ["lineno", "yb", "absent"]))


@query("distinct_counts", sql("line_nulls", _union(
    "SELECT '{c}' AS variable, count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS distinct_values FROM line_nulls",
    ["qty", "disc", "tax", "price"])))
def distinct_counts(spark, d):
    return profile.distinct_counts(fx.line_nulls(spark, d), ["qty", "disc", "tax", "price"])


_LINE_COLUMNS = ["key", "qty", "disc", "tax", "price", "flag", "status", "lineno", "y", "yb"]


@query("null_report", sql("line_nulls", _union(
    "SELECT '{c}' AS variable, count(*) - count({c}) AS nulls, round_even((count(*) - count({c})) / count(*) * 100, 3) + 0.0 AS pct "
    "FROM line_nulls", _LINE_COLUMNS)))
def null_report(spark, d):
    return profile.null_report(fx.line_nulls(spark, d))


_NULLS_IN_ROW = "CAST((qty IS NULL)::INT + (tax IS NULL)::INT + (flag IS NULL)::INT AS INTEGER)"


@query("nulls_per_row", sql("line_nulls", f"SELECT key, {_NULLS_IN_ROW} AS nulls FROM line_nulls"))
def nulls_per_row(spark, d):
    return profile.nulls_per_row(fx.line_nulls(spark, d)).select("key", "nulls")


@query("null_histogram", sql("line_nulls", f"SELECT {_NULLS_IN_ROW} AS nulls, count(*) AS n FROM line_nulls GROUP BY 1"))
def null_histogram(spark, d):
    return profile.null_histogram(fx.line_nulls(spark, d))


@query("null_correlation", sql("line_nulls", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, "
    + R(f"corr(CAST({a} IS NULL AS INTEGER), CAST({b} IS NULL AS INTEGER))") + " AS corr FROM line_nulls"
    for a, b in [("tax", "qty"), ("flag", "qty"), ("flag", "tax")])))
def null_correlation(spark, d):
    return rounded(profile.null_correlation(fx.line_nulls(spark, d)))


@query("duplicate_rows", """
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_rows(spark, d):
    return profile.duplicate_rows(fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("duplicate_rows_all_columns", """
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicates
FROM (SELECT *, count(*) AS c FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL)""")
def duplicate_rows_all_columns(spark, d):
    """Whole rows, the first line of every order being there twice."""
    lines = fx.table(spark, d, "lineitem")
    return profile.duplicate_rows(lines.unionByName(lines.where("l_linenumber = 1")))


@query("class_balance", sql("doc_model", f"""
SELECT quality AS class, count(*) AS n, {R("count(*) * 100.0 / sum(count(*)) OVER ()")} AS pct
FROM doc_model GROUP BY quality"""))
def class_balance(spark, d):
    return rounded(profile.class_balance(fx.doc_model(spark, d), "quality"))


@query("continuous_issues", sql("event_model", f"""
SELECT 'value' AS variable, 'few_distinct_values' AS issue, distinct_n AS n, CAST(NULL AS DOUBLE) AS rate FROM s WHERE distinct_n <= 5
UNION ALL SELECT 'value', 'below_zero', below, {R("below / n")} FROM s WHERE below > 0
UNION ALL SELECT 'value', 'above_hundred', above, {R("above / n")} FROM s WHERE above > 0
UNION ALL SELECT 'value', 'extreme_outliers', ext, {R("ext / n")} FROM s WHERE ext / n > 0.02 AND q3 > q1
UNION ALL SELECT 'value', 'high_missing_rate', total - n, {R("(total - n) / total")} FROM s WHERE (total - n) / total > 0.1""", """
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM event_model),
s AS (SELECT count(*) AS total, count(value) AS n, count(DISTINCT value) AS distinct_n,
        count(*) FILTER (value < 0) AS below, count(*) FILTER (value > 100) AS above,
        count(*) FILTER (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS ext,
        any_value(q1) AS q1, any_value(q3) AS q3 FROM event_model, q)"""))
def continuous_issues(spark, d):
    return rounded(profile.continuous_issues(fx.event_model(spark, d), "value"))


@query("binary_issues", sql("doc_model", f"""
SELECT 'toxic' AS variable, 'outside_zero_one' AS issue, n - n0 - n1 AS n, {R("(n - n0 - n1) / n")} AS rate FROM s WHERE n0 + n1 < n
UNION ALL SELECT 'toxic', 'no_binary_cases', 0, NULL FROM s WHERE n0 + n1 = 0
UNION ALL SELECT 'toxic', 'imbalance', n1, {R("n1 / (n0 + n1)")} FROM s
  WHERE n0 + n1 > 0 AND (n1 / (n0 + n1) < 0.15 OR n1 / (n0 + n1) > 0.85)
UNION ALL SELECT 'toxic', 'high_missing_rate', total - n, {R("(total - n) / total")} FROM s WHERE (total - n) / total > 0.1""", """
s AS (SELECT count(*) AS total, count(toxic) AS n, count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1
      FROM doc_model)"""))
def binary_issues(spark, d):
    return rounded(profile.binary_issues(fx.doc_model(spark, d), "toxic"))


@query("cumulative_frequency", sql("event_model", f"""
SELECT {R("value")} AS value, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY value) AS BIGINT) AS cum_n,
       {R("sum(count(*)) OVER (ORDER BY value) / (SELECT count(value) FROM event_model)")} AS cum_share
FROM event_model GROUP BY value"""))
def cumulative_frequency(spark, d):
    return rounded(profile.cumulative_frequency(fx.event_model(spark, d), "value"))


@query("share_over_group", sql("line_model", f"""
SELECT status, flag, count(*) AS n, {R("count(*) / sum(count(*)) OVER (PARTITION BY status)")} AS share
FROM line_model GROUP BY status, flag"""))
def share_over_group(spark, d):
    counts = fx.line_model(spark, d).groupBy("status", "flag").agg(F.count("*").alias("n"))
    return rounded(profile.share_over_group(counts, ["status"]))


# --- repair ---------------------------------------------------------------------------

@query("cast_columns", sql("doc_model", """
SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM doc_model"""))
def cast_columns(spark, d):
    df = fx.doc_model(spark, d).select("doc_id", "quality", "toxic")
    return schema.cast_columns(df, ["quality", "toxic", "absent"])


@query("recode_and_fill", sql("line_dirty", """
SELECT key, CASE WHEN qty <> 99999 THEN qty END AS qty,
       coalesce(CASE WHEN flag <> '?' THEN flag END, 'Unknown') AS flag FROM line_dirty"""))
def recode_and_fill(spark, d):
    df = schema.recode_to_null(fx.line_dirty(spark, d), {"qty": 99999.0, "flag": "?"})
    return schema.fill_null_constant(df, {"flag": "Unknown"}).select("key", "qty", "flag")


@query("count_sentinels", sql("line_dirty", """
SELECT 'qty' AS variable, '99999.0' AS code, count(*) FILTER (qty = 99999) AS n FROM line_dirty
UNION ALL SELECT 'flag', '?', count(*) FILTER (flag = '?') FROM line_dirty"""))
def count_sentinels(spark, d):
    return schema.count_sentinels(fx.line_dirty(spark, d), {"qty": 99999.0, "flag": "?"})


@query("drop_null_rows", sql("line_nulls", "SELECT key, qty, tax FROM line_nulls WHERE tax IS NOT NULL"))
def drop_null_rows(spark, d):
    return schema.drop_null_rows(fx.line_nulls(spark, d), ["tax"]).select("key", "qty", "tax")


@query("fill_null_median", sql("line_nulls", """
SELECT key, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM line_nulls)) AS qty,
       coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM line_nulls)) AS tax FROM line_nulls"""))
def fill_null_median(spark, d):
    return schema.fill_null_median(fx.line_nulls(spark, d), ["qty", "tax"]).select("key", "qty", "tax")


@query("complete_cases", sql("line_nulls", f"""
SELECT key, qty, tax, {R('y', 10)} AS y FROM line_nulls WHERE qty IS NOT NULL AND tax IS NOT NULL AND y IS NOT NULL"""))
def complete_cases(spark, d):
    df = schema.complete_cases(fx.line_nulls(spark, d), "y", ["qty", "tax"]).select("key", "qty", "tax", "y")
    return rounded(df, 10)


@query("binarize_by_quantile", sql("line_nulls", """
SELECT key, CASE WHEN qty <= cut THEN '<=' || label WHEN qty > cut THEN '>' || label END AS qty_cat
FROM line_nulls, (SELECT quantile_cont(qty, 0.75) AS cut, printf('%g', quantile_cont(qty, 0.75)) AS label FROM line_nulls)"""))
def binarize_by_quantile(spark, d):
    return schema.binarize_by_quantile(fx.line_nulls(spark, d), "qty").select("key", "qty_cat")


@query("drop_columns_if_present", sql("doc_model", "SELECT doc_id, letters, quality FROM doc_model"))
def drop_columns_if_present(spark, d):
    drop = ["toxic", "size", "spaces", "punct", "digits", "lang", "source", "absent"]
    return schema.drop_columns_if_present(fx.doc_model(spark, d), "quality", drop)[0]


_TYPED = ["doc_id", "size", "letters", "spaces", "punct", "digits", "quality", "toxic", "lang", "source"]


@query("split_types", sql("doc_model", _union(
    "SELECT '{c}' AS variable, CASE WHEN typeof(any_value({c})) IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') "
    "OR typeof(any_value({c})) LIKE 'DECIMAL%' THEN 'numeric' ELSE 'categorical' END AS kind, count(*) - count({c}) AS nulls FROM doc_model", _TYPED)))
def split_types(spark, d):
    """Kinds beside the nulls found in each column."""
    df = fx.doc_model(spark, d)
    return schema.split_types_table(df).join(profile.null_report(df).select("variable", "nulls"), "variable")


@query("require_columns", sql("event_model", "SELECT event_id, value FROM event_model"))
def require_columns(spark, d):
    return schema.require_columns(fx.event_model(spark, d), ["event_id", "value"]).select("event_id", "value")


@query("to_binary_target", sql("doc_model", "SELECT doc_id, CAST(quality AS INTEGER) AS quality FROM doc_model"))
def to_binary_target(spark, d):
    df = fx.doc_model(spark, d).select("doc_id", F.concat(F.lit(" "), F.col("quality").cast("string")).alias("quality"))
    return schema.to_binary_target(df, "quality")


@query("normalize_binary_lenient", sql("doc_model", """
SELECT doc_id, CASE WHEN lang <> 'en' THEN CAST(quality AS DOUBLE) END AS flag FROM doc_model"""))
def normalize_binary_lenient(spark, d):
    text = F.when(F.col("lang") == "en", F.lit("n/a")).otherwise(F.concat(F.col("quality").cast("string"), F.lit(".0 ")))
    df = fx.doc_model(spark, d).select("doc_id", text.alias("flag"))
    return schema.normalize_binary_lenient(df, "flag")


@query("to_numeric_coerce", """
SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '^Customer#', '') AS DOUBLE) AS code,
       TRY_CAST(c_mktsegment AS DOUBLE) AS segment FROM customer""")
def to_numeric_coerce(spark, d):
    df = fx.table(spark, d, "customer").select(
        "c_custkey", F.regexp_replace("c_name", "^Customer#", "").alias("code"), F.col("c_mktsegment").alias("segment")
    )
    return schema.to_numeric_coerce(df, ["code", "segment"])


@query("drop_constant_columns", sql("doc_model", "SELECT doc_id, letters FROM doc_model"))
def drop_constant_columns(spark, d):
    df = fx.doc_model(spark, d).select("doc_id", "letters").withColumn("one", F.lit(1)).withColumn("text", F.lit("x"))
    return schema.drop_constant_columns(df)


@query("import_summary", """
SELECT position, "column", type, (SELECT count(*) FROM orders) AS n_rows, 6 AS n_columns FROM (VALUES
 (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'),
 (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) t(position, "column", type)""")
def import_summary(spark, d):
    return tables.import_summary(fx.table(spark, d, "orders"))


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def first_rows(spark, d):
    return tables.first_rows(fx.table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def _shared(spark) -> str:
    """Output folder for round trips: the shared folder when the session names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return tempfile.mkdtemp(prefix="veta-out-")
    return f"{base}/veta-{uuid.uuid4().hex}"


@query("parquet_roundtrip", sql("line_split", "SELECT split, count(*) AS n FROM line_split GROUP BY split"))
def parquet_roundtrip(spark, d):
    from veta.operators.split import train_test_split

    split = train_test_split(fx.line_model(spark, d), "key")
    path = tables.write_parquet(split, _shared(spark), ["split"])
    return tables.read_parquet(spark, path, ["split"]).groupBy("split").agg(F.count("*").alias("n"))


@query("parquet_roundtrip_rows", sql("line_split", "SELECT * FROM line_split"))
def parquet_roundtrip_rows(spark, d):
    """Every column of every row, read back."""
    from veta.operators.split import train_test_split

    split = train_test_split(fx.line_model(spark, d), "key")
    path = tables.write_parquet(split, _shared(spark), ["split"])
    return tables.read_parquet(spark, path).select(*split.columns)


@query("report_roundtrip", sql("line_nulls", _union(
    "SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM line_nulls GROUP BY {c}", _FREQ)))
def report_roundtrip(spark, d):
    table = profile.frequency_table(fx.line_nulls(spark, d), _FREQ)
    path = tables.write_report_csv(table, _shared(spark))
    return tables.read_report_csv(spark, path, table.schema)


@query("csv_roundtrip", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def csv_roundtrip(spark, d):
    df = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = _shared(spark)
    df.write.option("header", True).csv(path)
    return tables.read_table(spark, path, df.schema)


@query("metadata_roundtrip", """
SELECT (SELECT count(*) FROM orders) AS n_rows, 'o_totalprice' AS target, ['o_orderkey', 'o_custkey'] AS dropped""")
def metadata_roundtrip(spark, d):
    record = {
        "n_rows": fx.table(spark, d, "orders").count(), "target": "o_totalprice", "dropped": ["o_orderkey", "o_custkey"],
    }
    path = tables.write_metadata_json(spark, record, _shared(spark))
    return tables.read_metadata_json(spark, path, "n_rows long, target string, dropped array<string>")


# --- outliers -------------------------------------------------------------------------

@query("outliers_iqr", sql("event_model", """
SELECT event_id, value FROM event_model,
 (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM event_model)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""))
def outliers_iqr(spark, d):
    return outliers.outliers_iqr(fx.event_model(spark, d), "value").select("event_id", "value")


@query("outliers_zscore", sql("event_model", """
SELECT event_id, value FROM event_model, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM event_model)
WHERE abs((value - m) / s) > 3"""))
def outliers_zscore(spark, d):
    return outliers.outliers_zscore(fx.event_model(spark, d), "value").select("event_id", "value")


def _outlier_sql(view: str, c: str) -> str:
    return f"""
SELECT '{c}' AS variable, count({c}) AS n,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers_iqr,
  count(*) FILTER (abs(({c} - m) / s) > 3) AS outliers_zscore,
  {R(f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}) * 100")} AS pct_iqr,
  {R(f"count(*) FILTER (abs(({c} - m) / s) > 3) / count({c}) * 100")} AS pct_zscore
FROM {view}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_pop({c}) AS s FROM {view})"""


@query("outlier_summary", sql("line_dirty", " UNION ALL ".join(_outlier_sql("line_dirty", c) for c in LINE_NUM)))
def outlier_summary(spark, d):
    return rounded(outliers.outlier_summary(fx.line_dirty(spark, d), [*LINE_NUM, "absent"]))


_WIN = "q AS (SELECT quantile_cont(qty, 0.99) AS lim FROM line_nulls)"


@query("winsorize_upper", sql("line_nulls", """
SELECT key, qty, CASE WHEN qty > lim THEN lim ELSE qty END AS qty_win FROM line_nulls, q""", _WIN))
def winsorize_upper(spark, d):
    treated, _ = outliers.winsorize_upper(fx.line_dirty(spark, d), "qty", 0.99, 99999)
    return treated.select("key", "qty", "qty_win")


@query("winsorize_summary", sql("line_nulls", """
SELECT 'qty' AS variable, 0.99::DOUBLE AS p, lim AS upper_limit,
 (SELECT count(*) FROM line_dirty WHERE qty = 99999) AS sentinels, count(*) FILTER (qty > lim) AS clipped
FROM line_nulls, q GROUP BY lim""", _WIN))
def winsorize_summary(spark, d):
    return outliers.winsorize_upper(fx.line_dirty(spark, d), "qty", 0.99, 99999)[1]


def _to_null_sql(view: str, c: str) -> str:
    return f"""
{c}_a AS (SELECT skewness({c}) AS sk, avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}, 0.5) AS med,
   quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {view}),
{c}_b AS (SELECT coalesce(nullif(quantile_cont(abs({c} - med), 0.5) / 0.6744897501960817, 0), 0.01) AS mad FROM {view}, {c}_a),
{c}_f AS (SELECT *, coalesce(CASE WHEN abs(sk) < 1 THEN abs(({c} - m) / s) > 3 ELSE abs(({c} - med) / mad) > 8 END
   AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)), false) AS bad FROM {view}, {c}_a, {c}_b)"""


@query("outliers_to_null", sql("event_model", "SELECT event_id, CASE WHEN NOT bad THEN value END AS value FROM value_f",
                               _to_null_sql("event_model", "value")))
def outliers_to_null(spark, d):
    return outliers.outliers_to_null(fx.event_model(spark, d), ["value"])[0].select("event_id", "value")


@query("outliers_to_null_counts", sql("line_dirty", """
SELECT 'qty' AS variable, count(*) FILTER (bad) AS outliers FROM qty_f UNION ALL
SELECT 'price', count(*) FILTER (bad) FROM price_f""",
                                      _to_null_sql("line_dirty", "qty") + "," + _to_null_sql("line_dirty", "price")))
def outliers_to_null_counts(spark, d):
    return outliers.outliers_to_null(fx.line_dirty(spark, d), ["qty", "price"])[1]


# --- imputation -----------------------------------------------------------------------

@query("impute_numeric_mean", sql("line_nulls", """
SELECT key, coalesce(qty, (SELECT round_even(avg(qty), 4) FROM line_nulls)) AS qty FROM line_nulls"""))
def impute_numeric_mean(spark, d):
    return impute.impute_numeric(fx.line_nulls(spark, d), "qty", "mean").select("key", "qty")


@query("impute_numeric_median", sql("line_nulls", """
SELECT key, coalesce(qty, (SELECT round_even(quantile_cont(qty, 0.5), 4) FROM line_nulls)) AS qty FROM line_nulls"""))
def impute_numeric_median(spark, d):
    return impute.impute_numeric(fx.line_nulls(spark, d), "qty", "median").select("key", "qty")


def _ranked(column: str, view: str) -> str:
    return f"""
ranked AS (SELECT value, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS cum, n FROM
   (SELECT {column} AS value, count(*) AS n FROM {view} WHERE {column} IS NOT NULL GROUP BY 1)),
total AS (SELECT count({column}) AS n FROM {view})"""


def _random_sql(column: str, view: str, seed: int = 123, key: str = "key") -> str:
    return sql(view, f"""
SELECT v.{key}, coalesce(v.{column}, r.value) AS {column} FROM
 (SELECT {key}, {column}, CASE WHEN {column} IS NULL
    THEN greatest(CAST(ceil({uniform_sql(key, f'impute-{column}-{seed}')} * (SELECT n FROM total)) AS BIGINT), 1) END AS rk FROM {view}) v
LEFT JOIN ranked r ON v.rk <= r.cum AND v.rk > r.cum - r.n""", _ranked(column, view))


@query("impute_numeric_random", _random_sql("qty", "line_nulls"))
def impute_numeric_random(spark, d):
    return impute.impute_numeric(fx.line_nulls(spark, d), "qty", "random", "key").select("key", "qty")


@query("impute_numeric_random_below", sql("line_nulls", f"""
SELECT v.key, coalesce(v.qty, r.value) AS qty FROM
 (SELECT key, qty, CASE WHEN qty IS NULL THEN greatest(f, CAST(floor(
    (f / (SELECT n FROM total) + {uniform_sql('key', 'impute-qty-123')} * (1 - f / (SELECT n FROM total))) * (SELECT n FROM total)) AS BIGINT)) END AS rk
  FROM line_nulls, (SELECT min(cum) AS f FROM ranked)) v
LEFT JOIN ladder r ON v.rk >= r.cum AND v.rk < r.upto""",
       _ranked("qty", "line_nulls") + ", ladder AS (SELECT value, cum, lead(cum, 1, 9000000000000) OVER (ORDER BY value) AS upto FROM ranked)"))
def impute_numeric_random_below(spark, d):
    return impute.impute_numeric(fx.line_nulls(spark, d), "qty", "random_below", "key").select("key", "qty")


@query("impute_categorical_mode", sql("line_nulls", """
SELECT key, coalesce(flag, (SELECT flag FROM line_nulls WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag
FROM line_nulls"""))
def impute_categorical_mode(spark, d):
    return impute.impute_categorical(fx.line_nulls(spark, d), "flag", "mode").select("key", "flag")


@query("impute_categorical_random", _random_sql("flag", "line_nulls"))
def impute_categorical_random(spark, d):
    return impute.impute_categorical(fx.line_nulls(spark, d), "flag", "random", "key").select("key", "flag")


@query("impute_by_distribution", sql("line_nulls", f"""
SELECT v.key, coalesce(v.status, r.value) AS status FROM
 (SELECT key, status, CASE WHEN status IS NULL
    THEN greatest(CAST(ceil({uniform_sql('key', 'impute-status-7')} * (SELECT n FROM total)) AS BIGINT), 1) END AS rk FROM holes) v
LEFT JOIN ranked r ON v.rk <= r.cum AND v.rk > r.cum - r.n""",
       "holes AS (SELECT key, CASE WHEN lineno <> 3 THEN status END AS status FROM line_nulls)," + _ranked("status", "holes")))
def impute_by_distribution(spark, d):
    df = fx.line_nulls(spark, d).select("key", F.when(F.col("lineno") != 3, F.col("status")).alias("status"))
    return impute.impute_by_distribution(df, "status", "key", seed=7)


@query("treat_missing", sql("line_nulls", f"""
SELECT key, flag, price, qty, coalesce(qty_cat, r.value) AS qty_cat FROM
 (SELECT *, CASE WHEN qty_cat IS NULL
    THEN greatest(CAST(ceil({uniform_sql('key', 'impute-qty_cat-123')} * (SELECT n FROM total)) AS BIGINT), 1) END AS rk FROM t4) v
LEFT JOIN ranked r ON v.rk <= r.cum AND v.rk > r.cum - r.n""", """
t1 AS (SELECT key, coalesce(flag, 'Unknown') AS flag, CASE WHEN lineno <> 5 THEN price END AS price, qty FROM line_nulls
       WHERE tax IS NOT NULL),
t2 AS (SELECT key, flag, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t1)) AS price, qty FROM t1),
t3 AS (SELECT quantile_cont(qty, 0.75) AS cut, printf('%g', quantile_cont(qty, 0.75)) AS label FROM t2),
t4 AS (SELECT t2.*, CASE WHEN qty <= cut THEN '<=' || label WHEN qty > cut THEN '>' || label END AS qty_cat FROM t2, t3),"""
       + _ranked("qty_cat", "t4")))
def treat_missing(spark, d):
    df = fx.line_nulls(spark, d).withColumn("price", F.when(F.col("lineno") != 5, F.col("price")))
    recipe = impute.TreatmentRecipe(
        drop_rows=["tax"], unknown_label={"flag": "Unknown"}, median=["price"], binarize={"qty": 0.75}, draw=["qty_cat"]
    )
    return impute.treat_missing(df, recipe, "key").select("key", "flag", "price", "qty", "qty_cat")
