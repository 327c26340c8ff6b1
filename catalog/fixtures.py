"""Views on the driver tables that the queries run on, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.functions.staging import spread_few_files, stage

from .base import uniform_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to process: few files would mean few busy cores."""
    return spread_few_files(table(spark, sf_dir, name))


def line_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a constructed continuous and binary target."""
    y = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 1000
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents.cast("string")).alias("key"),
        F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("lineno"), y.alias("y"), (y > 45).cast("int").alias("yb"),
    )


def line_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_model with a numeric sentinel, nulls and an invalid category."""
    df = line_model(spark, sf_dir)
    return df.withColumns({
        "qty": F.when(F.col("qty") == 50, F.lit(99999.0)).otherwise(F.col("qty")),
        "tax": F.when(F.col("tax") != 0.08, F.col("tax")),
        "flag": F.when((F.col("flag") == "R") & (F.col("lineno") == 7), F.lit("?")).otherwise(F.col("flag")),
    })


def line_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_dirty after recoding: nulls in qty, tax and flag."""
    return line_dirty(spark, sf_dir).withColumns({
        "qty": F.when(F.col("qty") != 99999.0, F.col("qty")),
        "flag": F.when(F.col("flag") != "?", F.col("flag")),
    })


def _share(pattern: str):
    counted = F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    return counted / F.col("n_chars")


def doc_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with character shares; ``quality`` is the binary target."""
    docs = text_table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return docs.join(labels, "doc_id").select(
        "doc_id", (F.col("n_chars") / 1000).alias("size"), _share("[a-zA-Z]+").alias("letters"),
        (spaces / F.col("n_chars")).alias("spaces"), _share("[.!?]+").alias("punct"), _share("[0-9]+").alias("digits"),
        "lang", "source", "quality", "toxic",
    )


def doc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_model written once: for operators that go over the rows several times."""
    return stage(doc_model(spark, sf_dir))


def doc_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_model with a score of fixed coefficients, in steps of 0.001 so scores tie."""
    xb = -4.0 + 6.0 * F.col("letters") - 10.0 * F.col("punct")
    return doc_model(spark, sf_dir).select(
        "doc_id", F.col("quality").alias("y"), "lang",
        (F.floor(1000 / (1 + F.exp(-xb))) / 1000).alias("p"),
    )


def event_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "value", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def cust_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with region and order statistics."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean_price")
    )
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "customer").join(orders, "c_custkey")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "n_orders",
            (F.round(F.col("total") * 100) / 100).alias("total"), "mean_price",
        )
    )


def cust_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cust_model written once: its joins are not repeated in every pass."""
    return stage(cust_model(spark, sf_dir))


_LINE = """
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CAST(round(l_extendedprice * 100) AS BIGINT)) AS key,
         l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_extendedprice / 1000 AS price,
         l_returnflag AS flag, l_linestatus AS status, l_linenumber AS lineno,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y,
         CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 > 45 AS INTEGER) AS yb
  FROM lineitem"""

_DIRTY = """
  SELECT key, CASE WHEN qty = 50 THEN 99999.0 ELSE qty END AS qty, disc,
         CASE WHEN tax <> 0.08 THEN tax END AS tax, price,
         CASE WHEN flag = 'R' AND lineno = 7 THEN '?' ELSE flag END AS flag, status, lineno, y, yb
  FROM line_model"""

_NULLS = """
  SELECT key, CASE WHEN qty <> 99999.0 THEN qty END AS qty, disc, tax, price,
         CASE WHEN flag <> '?' THEN flag END AS flag, status, lineno, y, yb
  FROM line_dirty"""


def _share_sql(kind: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '{kind}', '', 'g'))) / n_chars"


_DOC = f"""
  SELECT d.doc_id, n_chars / 1000 AS size, {_share_sql('[a-zA-Z]')} AS letters, {_share_sql('[ ]')} AS spaces,
         {_share_sql('[.!?]')} AS punct, {_share_sql('[0-9]')} AS digits, lang, source, quality, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

_SCORED = """
  SELECT doc_id, quality AS y, lang,
         floor(1000 / (1 + exp(-(-4.0 + 6.0 * letters - 10.0 * punct)))) / 1000 AS p
  FROM doc_model"""

_EVENT = """
  SELECT event_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""

_CUST = """
  SELECT c_custkey, c_acctbal AS acctbal, c_mktsegment AS segment, r_name AS region, n_name AS nation,
         n_orders, round(total * 100) / 100 AS total, mean_price
  FROM customer
  JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total, avg(o_totalprice) AS mean_price
        FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

_SPLIT = f"""
  SELECT *, CASE WHEN {uniform_sql('key', 'split-123')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM line_model"""

VIEWS = {
    "line_model": (_LINE, []), "line_dirty": (_DIRTY, ["line_model"]), "line_nulls": (_NULLS, ["line_dirty"]),
    "line_split": (_SPLIT, ["line_model"]),
    "doc_model": (_DOC, []), "doc_scored": (_SCORED, ["doc_model"]), "event_model": (_EVENT, []),
    "cust_model": (_CUST, []),
}


def _needed(name: str, seen: dict[str, None]) -> None:
    for parent in VIEWS[name][1]:
        _needed(parent, seen)
    seen[name] = None


def sql(view: str, body: str, ctes: str = "") -> str:
    """SELECT ``body`` with the view, and any further CTEs, in front."""
    names: dict[str, None] = {}
    for v in view.split():
        _needed(v, names)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][0]}\n)" for n in names]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
