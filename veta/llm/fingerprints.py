"""Document fingerprints: 128 signed bit votes over weighted terms, and a search by block tables.

Terms are runs of two words; a term's weight is the number of times the text has it, so each
occurrence votes. All steps are built-in DataFrame functions.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veta.llm.simhash import hex16, simhash
from veta.llm.text import shingle_hashes, store, text_or_empty

TERM_WORDS = 2
BITS = 128
BLOCK_BITS = 32  # two blocks in each of the two 64-bit words, a table led by each
MOST_FLIPS = 2  # bits in which a block may differ from the query's
RANGE_CHARS = 32_000_000  # text of one key range
MAX_RANGES = 100_000  # beyond that ranges grow; windows spill, so only the task length changes


def likeness(a: Column, a2: Column, b: Column, b2: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - (F.bit_count(a.bitwiseXOR(b)) + F.bit_count(a2.bitwiseXOR(b2))) / F.lit(float(BITS))


def fingerprints(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, fp, fp2, repeats: one row per distinct keys, which must determine the text."""
    hashed = df.select(*keys, shingle_hashes(text, TERM_WORDS).alias("_hs"))
    return simhash(hashed, keys, F.col("_hs"), second=True)


def _below(bounds: list, x: Column) -> Column:
    """How many of the sorted bounds lie below x: binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    array = F.array(*(F.lit(b) for b in bounds))
    n = len(bounds)
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(n.bit_length()))))
    return F.aggregate(
        steps, F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(array, at + s - 1) < x), at + s).otherwise(at),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) plus next_text: the following row's text by descending doc_id.

    Ties go by text hash, null ids come last, the last row is followed by the first; of a
    single row the next is itself. No window spans the table: rows are cut into ranges of the
    id, and each range gets the first row of the following range as a guest.
    """
    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, min(MAX_RANGES, math.ceil(size / RANGE_CHARS)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(bounds or []))
    # ranges count upwards from the smallest ids; null ids lie below all
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(bounds, F.col("doc_id")) + 1)
    placed = docs.withColumn("_range", at).withColumn("_tie", F.xxhash64("text"))

    firsts = placed.groupBy("_range").agg(F.max("doc_id").alias("first_id")).collect()  # one row per range
    order = sorted(((r["_range"], r["first_id"]) for r in firsts), reverse=True)
    if not order:
        return docs.withColumn("next_text", F.lit(None).cast("string"))
    ids = [i for _, i in order if i is not None]
    is_first = F.col("doc_id").isin(ids) | (F.col("_range") == 0)
    guests = (
        placed.filter(is_first).groupBy("_range").agg(F.max_by("text", F.struct("doc_id", -F.col("_tie").cast("decimal(20,0)"))).alias("text"))
    )
    previous = {r: order[i - 1][0] for i, (r, _) in enumerate(order)}
    target = F.element_at(F.create_map(*(F.lit(x) for kv in previous.items() for x in kv)), F.col("_range"))
    guests = guests.select(
        F.lit(None).cast("bigint").alias("doc_id"), "text", target.alias("_range"), F.lit(None).cast("bigint").alias("_tie"), F.lit(True).alias("_guest"),
    )
    w = W.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_tie")
    return (
        placed.select("doc_id", "text", "_range", "_tie", F.lit(False).alias("_guest")).union(guests)
        .withColumn("next_text", F.lead("text").over(w)).filter(~F.col("_guest")).select("doc_id", "text", "next_text")
    )


def edit(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the following text's first."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, fp2, efp, efp2, near_edited, near_next for every row.

    Null texts count as empty, and empty texts have fingerprint 0; repeated rows stay; an
    empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    pairs = with_next(base).select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))
    pairs = pairs.withColumn("edited", edit(F.col("text"), F.col("next_text")))
    keys = ["doc_id", "key", "n_chars", "next_key", "next_chars", "sha"]
    both = pairs.select(
        "doc_id", F.xxhash64("text").alias("key"), F.length("text").cast("bigint").alias("n_chars"),
        F.xxhash64("next_text").alias("next_key"), F.length("next_text").cast("bigint").alias("next_chars"),
        F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(
            F.struct(F.lit(False).alias("is_edited"), F.col("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")),
        )).alias("_s"),
    ).select(*keys, "_s.is_edited", F.col("_s.text").alias("_t"))
    prints = fingerprints(both, [*keys, "is_edited"], F.col("_t"))
    pick = lambda c, edited: F.max(F.when(F.col("is_edited") == edited, F.col(c)))
    one = store(prints.groupBy(*keys).agg(  # read twice below
        F.max("repeats").alias("repeats"), pick("fp", False).alias("fp"), pick("fp2", False).alias("fp2"),
        pick("fp", True).alias("efp"), pick("fp2", True).alias("efp2"),
    ))
    by_text = one.groupBy(F.col("key").alias("next_key"), F.col("n_chars").alias("next_chars")).agg(F.max("fp").alias("nfp"), F.max("fp2").alias("nfp2"))
    near_next = likeness(F.col("fp"), F.col("fp2"), F.col("nfp"), F.col("nfp2"))
    return (
        one.join(by_text, ["next_key", "next_chars"], "left")
        .withColumn("_r", F.explode(F.sequence(F.lit(1).cast("bigint"), "repeats")))
        .select(
            "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fp", "fp2", "efp", "efp2",
            likeness(F.col("fp"), F.col("fp2"), F.col("efp"), F.col("efp2")).alias("near_edited"), near_next.alias("near_next"),
        )
    )


def _blocks(a: Column, b: Column) -> list[Column]:
    return [F.shiftrightunsigned(w, first).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for w in (a, b) for first in (0, BLOCK_BITS)]


def near_pairs(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """q, q2, fp, fp2, bits, n: the distinct fingerprints of prints within `radius` bits of each
    distinct query (fp, fp2), and the n rows that have them.

    Of four blocks one differs in at most a quarter of the bits in which the whole differs, so a
    query looks in each block's table for the block itself and for all its changes of so many
    bits. A pair counts in the first table it meets in, after the whole fingerprints were
    compared. Radius 0 to 11.
    """
    flips = radius // 4
    if not 0 <= flips <= MOST_FLIPS:
        raise ValueError("radius must lie between 0 and 11")
    masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(BLOCK_BITS), k)]
    changes = F.array(*(F.lit(m).cast("bigint") for m in masks))
    asked = queries.select(F.col("fp").alias("q"), F.col("fp2").alias("q2")).distinct()
    asked = asked.select("q", "q2", F.posexplode(F.array(*_blocks(F.col("q"), F.col("q2")))).alias("t", "_b"))
    asked = asked.select("q", "q2", "t", "_b", F.explode(changes).alias("_m")).select("q", "q2", "t", F.col("_b").bitwiseXOR(F.col("_m")).alias("k"))
    rows = prints.groupBy("fp", "fp2").agg(F.count("*").alias("n"))
    rows = rows.select("fp", "fp2", "n", F.posexplode(F.array(*_blocks(F.col("fp"), F.col("fp2")))).alias("t", "k"))
    x, x2 = F.col("q").bitwiseXOR(F.col("fp")), F.col("q2").bitwiseXOR(F.col("fp2"))
    bits = (F.bit_count(x) + F.bit_count(x2)).cast("int")
    first = F.coalesce(*(F.when(F.bit_count(b) <= flips, i) for i, b in enumerate(_blocks(x, x2))))
    # the planner knows only the few queries, not that each asks for thousands of keys: no broadcast
    met = asked.hint("shuffle_merge").join(rows, ["t", "k"]).filter((bits <= radius) & (F.col("t") == first))
    return met.select("q", "q2", "fp", "fp2", bits.alias("bits"), "n")


def near_classes(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, fp2, bits: the fingerprints found for every distinct query (doc_id, fp, fp2)."""
    asked = queries.select("doc_id", F.col("fp").alias("q"), F.col("fp2").alias("q2")).distinct()
    return asked.join(near_pairs(prints, queries, radius), ["q", "q2"]).select("doc_id", "fp", "fp2", "bits")


def members(prints: DataFrame) -> DataFrame:
    """fp, fp2, found_id: the documents of every fingerprint that near_classes finds."""
    return prints.select("fp", "fp2", F.col("doc_id").alias("found_id")).distinct()


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """For every distinct query (fp, fp2): n_near, the rows of prints within `radius` bits."""
    near = near_pairs(prints, queries, radius)
    return near.groupBy(F.col("q").alias("_q"), F.col("q2").alias("_q2")).agg(F.sum("n").alias("n_near")).select(F.col("_q").alias("fp"), F.col("_q2").alias("fp2"), "n_near")


def hex32(a: Column, b: Column) -> Column:
    return F.concat(hex16(a), hex16(b))
