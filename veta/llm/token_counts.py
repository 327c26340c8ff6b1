"""Token counts: an exact histogram of encoded lengths and its suffix sums.

The histogram has one row per encoded length, however many documents there are; suffix sums
over it answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veta.llm.text import store
from veta.llm.tokens import encoder, tokenizer_path

BLOCK = 1024  # lengths summed together before the one ordered pass over blocks


def encoded_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """length: the number of ids of every row's whole text; null texts have none."""
    path = path or tokenizer_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            counts = pa.array([len(encode(t.as_py())) // 4 for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([counts], ["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lengths, "length bigint")


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """length, n_docs: one row per encoded length. An empty table gives no rows."""
    return encoded_lengths(docs, text_col, path).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L: n_docs, n_tokens; docs_from and tokens_from over lengths of L and more;
    truncated_total, the tokens left if every document is cut at L; docs_upto_share, the share
    of documents of at most L tokens.

    Sums run within blocks of lengths and over the block totals, so no window holds more
    than the lengths of a block or one row per block.
    """
    rows = store(histogram.withColumn("_block", F.floor(F.col("length") / BLOCK)).withColumn("n_tokens", F.col("length") * F.col("n_docs")))
    after = W.orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = totals.select(
        "_block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("_d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("_t"),
        F.sum("d").over(W.partitionBy()).alias("_all_d"), F.sum("t").over(W.partitionBy()).alias("_all_t"),
    )
    inside = W.partitionBy("_block").orderBy(F.col("length").desc())
    return (
        rows.join(later, "_block")
        .withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("_d"))
        .withColumn("tokens_from", F.sum("n_tokens").over(inside) + F.col("_t"))
        .select(
            "length", "n_docs", "n_tokens", "docs_from", "tokens_from",
            (F.col("_all_t") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
            ((F.col("_all_d") - F.col("docs_from") + F.col("n_docs")) / F.col("_all_d")).alias("docs_upto_share"),
        )
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at `limit`, for any limit; 0 of an empty table."""
    row = sums.agg(
        F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") >= limit, F.col("length"))).alias("at"),
        F.max("tokens_from").alias("total"),
    ).first()
    if row["total"] is None:
        return 0
    return row["total"] if row["at"] is None else row["total"] - row["at"]["tokens_from"] + limit * row["at"]["docs_from"]


def length_quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least `share` of the documents do not exceed."""
    return sums.filter(F.col("docs_upto_share") >= share).agg(F.min("length")).first()[0]
