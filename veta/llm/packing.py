"""Packing by cutting-stock column generation.

Documents are cut at the sequence length; what is left of each is a piece to pack whole.
Pieces are counted by length in units, and a linear program over cutting patterns finds how
often to use which mix of lengths: a knapsack program prices new patterns, the solution is
rounded down, and the few pieces over are packed first-fit. The program sees only the length
histogram, whose size does not depend on the corpus. Patterns are then dealt to the pieces by
their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veta.llm.text import store
from veta.llm.tokens import encoder, tokenizer_path

SEQUENCE = 2048
UNIT = 8  # tokens; a piece takes whole units of a pattern
END_ID = 1
RANK_ROWS = 200_000  # pieces ranked by one task
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, sequence: int) -> DataFrame:
    """One row per piece: full sequences of a document and what is left of it."""
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                out += [
                    (doc.as_py(), s, min(sequence, n - s), zlib.crc32(ids[4 * s : 4 * (s + sequence)]), n) for s in range(0, n, sequence)
                ]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECES.replace(" bigint", "").split(", "))

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(cut, PIECES)


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern that fits."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))  # sizes ascend
        best[c] = best[c - 1]
        if k:
            worth = values[:k] + best[c - sizes[:k]]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], last[c] = worth[i], i
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), pattern


def _apply(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def _pivot(inverse: np.ndarray, direction: np.ndarray, leave: int) -> None:
    """Update the inverse in place for a basis whose column `leave` became the one priced."""
    row = inverse[leave] / direction[leave]
    inverse -= np.outer(direction, row)
    inverse[leave] = row


def solve(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(uses, {size: pieces}) patterns that hold exactly the demanded pieces.

    Revised simplex over the patterns; it stops when no pattern can lower the number of
    sequences by more than one in two thousand.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), dtype=int)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], dtype=float)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    for _ in range(50 * len(sizes) + 50):
        worth, pattern = _price(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + 5e-4:
            break
        direction, level = _apply(inverse, pattern), np.maximum(_apply(inverse, need), 0)
        ratio = np.full(len(sizes), np.inf)
        np.divide(level, direction, out=ratio, where=direction > 1e-9)
        leave = int(ratio.argmin())
        columns[:, leave] = pattern
        _pivot(inverse, direction, leave)
    uses = np.floor(np.maximum(_apply(inverse, need), 0) + 1e-9)
    left = {int(s): int(n) for s, n in zip(sizes, need, strict=True)}
    out = []
    for j in np.argsort(-uses):
        pattern = {int(s): int(a) for s, a in zip(sizes, columns[:, j], strict=True) if a}
        times = min([int(uses[j]), *(left[s] // a for s, a in pattern.items())])
        if times > 0:
            out.append((times, pattern))
            for s, a in pattern.items():
                left[s] -= times * a
    # the pieces over, about one sequence per pattern, first-fit from the longest
    open_, rest = [], []
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            i = next((i for i, room in enumerate(rest) if room >= s), None)
            if i is None:
                open_.append(Counter())
                rest.append(capacity)
                i = len(rest) - 1
            open_[i][s] += 1
            rest[i] -= s
    return out + [(1, dict(c)) for c in open_]


def _ranked(rows: DataFrame) -> DataFrame:
    """rows plus rank: 0, 1, ... within each class, in blocks so that no class meets in one task."""
    blocks = max(1, rows.count() // RANK_ROWS + 1)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    before = W.partitionBy("class").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("class", "_block").agg(F.count("*").alias("n"))
    offsets = counts.select("class", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("class", "_block").orderBy("doc_id", "start", "ids_crc32")
    return rows.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["class", "_block"]).withColumn("rank", F.col("_in") + F.col("_before")).drop("_in", "_before", "_block")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, unit: int = UNIT,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document's ids are its text's, then the end id, so null and empty texts give one piece
    of one id. Repeated rows are packed as often as they come; null ids stay null; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    capacity = sequence // unit
    cut = pieces(docs, id_col, text_col, path or tokenizer_path(), sequence)
    cut = store(cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int")))
    histogram = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    full = histogram.pop(capacity, 0)  # pieces that fill a sequence alone
    plan, at, used = [], full, Counter()
    for times, pattern in solve(histogram, capacity):
        slot = 0
        for size, each in pattern.items():
            plan.append((size, used[size], used[size] + times * each, at, each, slot))
            used[size] += times * each
            slot += each
        at += times
    plan.append((capacity, 0, full, 0, 1, 0))
    # one row per class and pattern: bounded by the number of classes, whatever the corpus
    deal = F.broadcast(spark.createDataFrame(plan, "class int, lo bigint, hi bigint, first bigint, each bigint, slot bigint"))
    ranked = _ranked(cut)
    dealt = ranked.join(deal, (ranked["class"] == deal["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("sequence_id"),
        (F.col("slot") + F.pmod(F.col("rank") - F.col("lo"), F.col("each"))).alias("_slot"),
    )
    before = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot")
