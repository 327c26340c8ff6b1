"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents stand in a permuted order, by a hash of their id, rows of one id (or none) also by their
text and their place among equals, and the order is cut into blocks of about as many documents. A source's target says how often its blocks are drawn: whole
passes, and a last pass over blocks up to the target; of the block it stops in, the documents
that still fit are taken, largest first. The block draws of all sources are split among output shards by a binary tree: each node hands
its left half an exact hypergeometric share of every source's draws. A shard takes its draws
from each source's permuted sequence one after the other, so shards are disjoint, and orders
what it has by another hash. All row work is done by built-in functions; the driver sees one
row per source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veta.llm.text import store, words

CAP = 3.0
HASH_BITS = 52
CELL_DOCS = 128  # documents of a block; also what is gone through one by one where a pass stops
MAX_CELL_BITS = 20
SHARDS = 64
SEED = "mix-1"


def permuted(*key: Column, seed: str = SEED) -> Column:
    """A number below 2**52 from the md5 of seed and key, the same in any engine."""
    text = F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _in_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) plus h, their number in the permuted order.

    A document's number comes from its id. Rows of an id met more than once, or of none, are told
    apart by their digest and, where that is equal too, by their place among the equals: counted
    per partition first, so that many equal rows never meet in one task.
    """
    again = store(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again"), F.lit(True).alias("_repeated")))
    if again.isEmpty():
        return rows.withColumn("h", permuted(F.col("doc_id")))
    marked = rows.join(again, F.col("doc_id").eqNullSafe(F.col("_again")), "left").drop("_again")
    alone = marked.filter(F.col("_repeated").isNull()).withColumn("h", permuted(F.col("doc_id")))
    # written, so that a row's part is the same for the counts and for the places
    many = store(marked.filter("_repeated").withColumn("_part", F.spark_partition_id()))
    parts = many.groupBy("doc_id", "digest", "_part").agg(F.count("*").alias("n"))
    before = W.partitionBy("doc_id", "digest").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("doc_id").alias("_of"), F.col("digest").alias("_digest"), F.col("_part").alias("_counted"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
    )
    inside = F.row_number().over(W.partitionBy("doc_id", "digest", "_part").orderBy("_repeated"))
    on = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("digest") == F.col("_digest")) & (F.col("_part") == F.col("_counted"))
    placed = many.withColumn("_place", inside).join(parts, on).withColumn("_place", F.col("_place") + F.col("_before"))
    placed = placed.withColumn("h", permuted(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"), F.col("_place")))
    return alone.select(*rows.columns, "h").unionByName(placed.select(*rows.columns, "h"))


def _digest(source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(source_col).cast("string"), F.col(text_col))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    rows = store(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), source.isNull().alias("s_null"), F.coalesce(source, F.lit("")).alias("s_text"),
        F.size(words(F.col(text_col))).cast("bigint").alias("size"), _digest(source_col, text_col).alias("digest"),
    ))
    return _in_order(rows).drop("digest")


def targets(totals: DataFrame) -> DataFrame:
    """(s_null, s_text, source_size) plus rank and target, one row per source.

    Shares go by weight 1, 2, 3, ... in code point order, null last. A source cannot take more
    than CAP times its size; with caps c and weights w the rest is shared at the one level x
    where the sum of min(c, x w) is the whole: the greatest of (whole - capped) / weights left
    over the sources in order of c / w.
    """
    # windows without a partition, over one row per source
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy("s_null", "s_text")))
    weighted = ranked.withColumn("w", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * CAP)
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    levels = weighted.withColumn("_l", level)
    return levels.withColumn("target", F.least("cap", F.max("_l").over(W.partitionBy()) * F.col("w"))).drop("_l", "w", "cap")


def split_quotas(quotas: list[int], shards: int, seed: int = 7) -> np.ndarray:
    """shards x sources draws, each source's column summing to its quota; shards must be 2**k."""
    rng = np.random.default_rng(seed)
    level = np.array([quotas], dtype=np.int64)
    while len(level) < shards:
        halves = []
        for node in level:
            left = rng.multivariate_hypergeometric(node, int(node.sum() // 2), method="marginals") if node.sum() else node
            halves += [left, node - left]
        level = np.array(halves)
    return level


def _cell(bits: Column) -> Column:
    return F.call_function("shiftright", F.col("h"), F.lit(HASH_BITS) - bits)


def _key(h: Column, doc_id: Column) -> Column:
    return F.struct(h.alias("h"), F.coalesce(doc_id, F.lit(-1)).alias("doc_id"))


def _fitting(cell: Column, room: Column) -> Column:
    """Keys of a cell's documents (size, h, doc_id), largest first, each taken if it still fits."""
    def step(state: Column, doc: Column) -> Column:
        fits = (doc["size"] > 0) & (doc["size"] <= state["room"])
        return F.struct(
            F.when(fits, state["room"] - doc["size"]).otherwise(state["room"]).alias("room"),
            F.when(fits, F.concat(state["keys"], F.array(_key(doc["h"], doc["doc_id"])))).otherwise(state["keys"]).alias("keys"),
        )

    start = F.struct(room.alias("room"), F.array().cast("array<struct<h:bigint,doc_id:bigint>>").alias("keys"))
    return F.aggregate(F.array_sort(cell), start, step, lambda s: s["keys"])


def _plan(sized: DataFrame, shards: int) -> DataFrame:
    """One row per source: sizes, target, passes, where the last pass stops, and shard ends."""
    spark = sized.sparkSession
    key = ["s_null", "s_text"]
    totals = targets(sized.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    bits = F.least(F.greatest(F.floor(F.log2(F.col("n_docs") / CELL_DOCS)), F.lit(0)), F.lit(MAX_CELL_BITS))
    plan = totals.withColumn("passes", passes.cast("bigint")).withColumn("over", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = store(plan.withColumn("bits", bits.cast("int")))

    # the last pass takes whole cells, and in the cell where it stops what fits
    placed = sized.join(plan.select(*key, "bits"), key).withColumn("cell", _cell(F.col("bits")))
    cells = placed.groupBy(*key, "cell").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy(*key).orderBy("cell"))
    stop = cells.withColumn("upto", upto).join(plan.select(*key, "over"), key).filter(
        (F.col("over") > 0) & (F.col("upto") > F.col("over")) & (F.col("upto") - F.col("words") <= F.col("over")),
    ).select(*key, "cell", (F.col("over") - F.col("upto") + F.col("words")).alias("room"))
    doc = F.struct((-F.col("size")).alias("minus"), "h", "doc_id", "size")
    picked = placed.join(stop, [*key, "cell"]).groupBy(*key, F.col("cell").alias("stop")).agg(
        _fitting(F.collect_list(doc), F.first("room")).alias("picked"),
    )
    blocks = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits"))
    ended = plan.join(picked, key, "left").withColumn("stop", F.coalesce("stop", F.lit(-1))).withColumn("blocks", blocks)
    ended = store(ended.withColumn("draws", F.col("passes") * F.col("blocks") + F.col("stop") + 1))

    rows = ended.select("rank", "draws").orderBy("rank").collect()  # one row per source
    ends = np.cumsum(split_quotas([r["draws"] for r in rows], shards), axis=0).T
    table = spark.createDataFrame([(r["rank"], [int(x) for x in e]) for r, e in zip(rows, ends, strict=True)], "rank int, ends array<bigint>")
    # written, so that the planner knows its size and decides about broadcasting by it
    return store(ended.join(table, "rank"))


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (s_null, s_text, h, doc_id, ...) plus the plan's columns, cell, copies and draws.

    draws lists the shard of each draw of the row: the one in whose stretch of the source's
    draws it lies.
    """
    found = rows.join(plan, ["s_null", "s_text"]).withColumn("cell", _cell(F.col("bits")))
    extra = (F.col("cell") < F.col("stop")) | ((F.col("cell") == F.col("stop")) & F.coalesce(F.array_contains("picked", _key(F.col("h"), F.col("doc_id"))), F.lit(False)))
    copied = found.withColumn("copies", F.col("passes") + extra.cast("bigint"))
    at = lambda p: p * F.col("blocks") + F.col("cell")
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    return copied.withColumn("draws", F.transform(passes, lambda p: F.size(F.filter("ends", lambda e: e <= at(p)))))


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, copies, draws, taken: one row per row of docs.

    taken adds up the row's size over its draws, at most 3, whose shards draws lists. Null texts
    have size 0; null is a source of its own, the last; an empty table gives no rows; rows of one
    id, or of none, are drawn one by one; other columns are ignored.
    """
    sized = store(_sized(docs, id_col, source_col, text_col))
    return _with_copies(sized, _plan(sized, shards)).select(
        "doc_id", "size", "source_size", "target", "copies", "draws",
        (F.size(F.filter("draws", lambda shard: shard < shards)) * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """docs' own columns, each row as often as it is drawn, dealt to shards and shuffled there.

    Rows whose text has no words are drawn like any other row of their place in the order; null
    texts, sources and ids and repeated rows count as in taken; an empty table gives no rows.
    """
    plan = _plan(store(_sized(docs, id_col, source_col, text_col)), shards)
    own = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(c).alias(own[c]) for c in docs.columns))
    source = F.col(own[source_col]).cast("string")
    keyed = renamed.withColumns({
        "doc_id": F.col(own[id_col]).cast("bigint"), "s_null": source.isNull(), "s_text": F.coalesce(source, F.lit("")),
        "digest": _digest(own[source_col], own[text_col]),
    })
    keyed = _in_order(keyed)
    drawn = _with_copies(keyed, plan).filter("copies > 0")
    drawn = drawn.select("*", F.posexplode("draws").alias("_pass", "_shard"))
    placed = drawn.withColumn("_order", F.xxhash64(F.lit(SEED), "_shard", "h", "_pass"))
    return placed.repartition(shards, "_shard").sortWithinPartitions("_shard", "_order").select(*(F.col(o).alias(c) for c, o in own.items()))
