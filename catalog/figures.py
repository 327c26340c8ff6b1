"""Chart data queries."""

from __future__ import annotations

from veta.operators import charts

from . import fixtures as fx
from .base import R, query, rounded
from .fixtures import sql


@query("histogram", sql("event_model", f"""
SELECT CAST(b AS INTEGER) AS bin, {R('lo + b * w')} AS lo, {R('lo + (b + 1) * w')} AS hi, count(event_id) AS n
FROM range(30) t(b) CROSS JOIN lim LEFT JOIN (
  SELECT event_id, least(floor((value - lo) / w), 29) AS vb FROM event_model, lim) e ON e.vb = t.b GROUP BY b, lo, w""",
    "lim AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM event_model)"))
def histogram(spark, d):
    return rounded(charts.histogram(fx.event_model(spark, d), "value"))


@query("box_stats", sql("event_model", f"""
SELECT event_type, q1 AS q25, q2 AS median, q3 AS q75, count(*) AS n,
  min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM event_model JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
  quantile_cont(value, 0.75) AS q3 FROM event_model GROUP BY event_type) USING (event_type) GROUP BY event_type, q1, q2, q3"""
    .replace("q1 AS q25", f"{R('q1')} AS q25").replace("q2 AS median", f"{R('q2')} AS median", 1).replace("q3 AS q75", f"{R('q3')} AS q75", 1)))
def box_stats(spark, d):
    return rounded(charts.box_stats(fx.event_model(spark, d), "value", "event_type"))


@query("box_stats_whole", sql("line_model", f"""
SELECT {R('q1')} AS q25, {R('q2')} AS median, {R('q3')} AS q75, count(*) AS n,
  {R('min(y) FILTER (y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low,
  {R('max(y) FILTER (y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  count(*) FILTER (y NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM line_model, (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3 FROM line_model)
GROUP BY q1, q2, q3"""))
def box_stats_whole(spark, d):
    return rounded(charts.box_stats(fx.line_model(spark, d), "y"))


def _density_sql(view: str, column: str, by: str) -> str:
    return sql(view, f"""
SELECT g AS "group", CAST(i AS INTEGER) AS point, {R('x')} AS x, {R('h')} AS bandwidth,
  {R(f'sum(exp(-0.5 * pow((v.{column} - x) / h, 2))) / (n * h * sqrt(2 * pi()))', 8)} AS density
FROM (SELECT g, i, h, n, lo + i * (hi - lo) / 49 AS x FROM (
   SELECT g, n, h, mn - 3 * h AS lo, mx + 3 * h AS hi FROM (
     SELECT CAST({by} AS VARCHAR) AS g, count(*) AS n, stddev_samp({column}) * pow(count(*), -0.2) AS h, min({column}) AS mn, max({column}) AS mx
     FROM {view} GROUP BY 1)), range(50) t(i)) grid
JOIN {view} v ON CAST(v.{by} AS VARCHAR) = g GROUP BY g, i, x, h, n""")


@query("density_by_group", _density_sql("event_model", "value", "event_type"))
def density_by_group(spark, d):
    return rounded(charts.density_by_group(fx.event_model(spark, d), "value", "event_type"), density=8)


@query("density_by_target", _density_sql("doc_model", "letters", "quality"))
def density_by_target(spark, d):
    return rounded(charts.density_by_group(fx.doc_table(spark, d), "letters", "quality"), density=8)


# fixed values: quantiles of the normal distribution at 0.05, 0.10, ... 0.45
_NORMAL = [1.6448536, 1.2815516, 1.0364334, 0.8416212, 0.6744898, 0.5244005, 0.3853205, 0.2533471, 0.1256613]
_THEORETICAL = [-z for z in _NORMAL] + [0.0] + _NORMAL[::-1]


@query("qq_points", sql("event_model", " UNION ALL ".join(
    f"SELECT {R(f'{i} / 20.0', 8)} AS p, {R(str(_THEORETICAL[i - 1]), 5)} AS theoretical, "
    f"{R(f'(quantile_cont(value, {i / 20}) - avg(value)) / stddev_samp(value)')} AS observed FROM event_model"
    for i in range(1, 20))))
def qq_points(spark, d):
    return rounded(charts.qq_points(fx.event_model(spark, d), "value", points=19, standardize=True), p=8, theoretical=5)


@query("class_bars", sql("doc_model", "SELECT CAST(quality AS DOUBLE) AS class, count(*) AS n FROM doc_model GROUP BY 1"))
def class_bars(spark, d):
    return charts.class_bars(fx.doc_model(spark, d), "quality")


@query("mosaic_table", sql("doc_model", f"""
SELECT source AS category, quality AS class, count(*) AS n,
  {R("count(*) / sum(count(*)) OVER (PARTITION BY source)")} AS share FROM doc_model GROUP BY source, quality"""))
def mosaic_table(spark, d):
    return rounded(charts.mosaic_table(fx.doc_model(spark, d), "source", "quality"))
