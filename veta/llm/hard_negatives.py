"""Hard-negative mining by integer matrix products in a residue number system.

Components are scaled to integers. A product of two component matrices is taken modulo several
small primes in float32, where every partial sum stays below 2**24 and so is exact; Chinese
remaindering (mixed radix) puts the residues together to the exact signed score. As many primes
are used as the largest possible score of the table asks for.

Rows are cut into chunks of bounded size and each chunk meets all anchors, which stream past it:
what is shuffled is the rows once and the anchors once per chunk. A chunk gives back only its best
few per anchor, and ranked windows in Spark choose among the chunks. The first round finds the
positives of every anchor, the second the negatives in the score window of each positive.

Rows with a null label or vector, or a null or non-finite component (also one that leaves the
range of a double when scaled), take no part. Vectors of unlike length are compared over the
components both have. A null id is no anchor and comes last among ties. Every row of a repeated
id takes part: it is an anchor of its own, and a partner to its copies. Scores beyond 64 bits are
compared exactly and reported as the nearest 64-bit value. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veta.llm.text import store

SCALE = 256.0
PRIMES = (1021, 1019, 1013, 1009, 997, 991)  # odd, at most 1021: 64 products of halves stay below 2**24
INNER = 64  # components multiplied at a time
CHUNK_VALUES = 1 << 23  # most components of the rows held by one task
CHUNK_ROWS, FEW_CHUNKS = 4096, 256  # small tables: so many rows a chunk, up to so many chunks
SCORES = 1 << 21  # scores computed at a time
SMALL = 62  # bits of the product of primes that 64-bit integers can hold

NAMES = ["key", "anchor_id", "place", "other_id", "score", "exact", "positive_id", "positive_score"]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
SCHEMA = "key bigint, anchor_id bigint, place int, other_id bigint, score bigint, exact binary, positive_id bigint, positive_score bigint"
WINDOWS = "array<struct<place:int,id:bigint,score:bigint,exact:binary>>"


def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds twice the bound, so that signed scores are told apart."""
    chosen: list[int] = []
    while math.prod(chosen) <= 2 * bound + 1:
        if len(chosen) < len(PRIMES):
            p = PRIMES[len(chosen)]
        else:  # further primes below the last
            p = chosen[-1] - 2
            while any(p % q == 0 for q in range(3, math.isqrt(p) + 1, 2)):
                p -= 2
        if p < 3:
            raise ValueError("components too large for exact scores")
        chosen.append(p)
    return chosen


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Integer-valued doubles as float32 residues of least absolute value, one matrix a prime."""
    out = []
    for p in primes:
        r = np.fmod(values, p)  # exact for any double
        r -= p * np.rint(r / p)
        out.append(r.astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> list[np.ndarray]:
    """left @ right.T modulo each prime, in [0, p)."""
    out = []
    for a, b, p in zip(left, right, primes, strict=True):
        total = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], INNER):
            total += np.rint(a[:, k : k + INNER] @ b[:, k : k + INNER].T).astype(np.int64)
            total %= p
        out.append(total)
    return out


def remainder_scores(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers with these residues: mixed-radix digits, then the nearer of x and x - M.

    64-bit integers where the product M of the primes allows, Python's beyond.
    """
    modulus = math.prod(primes)
    wide = modulus.bit_length() > SMALL
    total = parts[0].astype(object) if wide else parts[0].copy()
    radix = primes[0]
    for r, p in zip(parts[1:], primes[1:], strict=True):
        digit = (r - (total % p).astype(np.int64)) * pow(radix, -1, p) % p
        total += (digit.astype(object) if wide else digit) * radix
        radix *= p
    return np.where(total > modulus // 2, total - modulus, total)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Scaled vectors of an Arrow column as integer-valued doubles; short ones are filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    values = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    values[row, np.arange(len(flat)) - start] = flat
    return values


def _row(score: int, modulus: int) -> tuple[int, bytes]:
    """A score as a 64-bit value, and as bytes that sort like it however large it is."""
    score = int(score)
    return max(-(1 << 63), min((1 << 63) - 1, score)), (score + modulus).to_bytes(modulus.bit_length() // 8 + 1, "big")


class _Chunk:
    """The rows of a chunk, ready to be multiplied."""

    def __init__(self, batches: list[pa.RecordBatch], width: int, primes: list[int]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        self.width, self.primes, self.modulus = width, primes, math.prod(primes)
        self.matrix = residues(integers(column("vector"), width), primes)
        self.no_id = column("id").is_null().to_numpy(zero_copy_only=False)
        self.ids = column("id").fill_null(0).to_numpy(zero_copy_only=False)
        self.keys, self.labels = column("key").to_numpy(), column("label").to_numpy()

    def best(self, scores: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple]:
        """(id, score, exact) of the k first of the places `at`: highest score, then least id, no id last."""
        some = scores[at]
        if len(some) > k:
            least = np.partition(some, len(some) - k)[len(some) - k]
            at = at[some >= least]
        for i in sorted(at.tolist(), key=lambda i: (-int(scores[i]), self.no_id[i], self.ids[i]))[:k]:
            yield None if self.no_id[i] else int(self.ids[i]), *_row(scores[i], self.modulus)

    def meet(self, anchors: pa.RecordBatch, k: int, negatives: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // len(self.ids))
        for lo in range(0, anchors.num_rows, step):
            block = anchors.slice(lo, step)
            mine = residues(integers(block.column("vector"), self.width), self.primes)
            scores = remainder_scores(products(mine, self.matrix, self.primes), self.primes)
            found: list[tuple] = []
            for row, anchor in zip(scores, block.select(["key", "id", "label", "positives"]).to_pylist(), strict=True):
                for place, positive, positive_score, at in self._asked(row, anchor, negatives):
                    for other, score, exact in self.best(row, at, k):
                        found.append((anchor["key"], anchor["id"], place, other, score, exact, positive, positive_score))
            if found:
                columns = zip(zip(*found, strict=True), TYPES, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], NAMES)

    def _asked(self, row: np.ndarray, anchor: dict, negatives: bool) -> Iterator[tuple]:
        """What is looked for: the same label, or another label in the window of a positive."""
        if not negatives:
            yield 0, None, None, np.flatnonzero((self.labels == anchor["label"]) & (self.keys != anchor["key"]))
            return
        other = np.flatnonzero(self.labels != anchor["label"])
        theirs = row[other]
        for w in anchor["positives"]:
            top = int.from_bytes(w["exact"], "big") - self.modulus
            low = -(-4 * top // 5)  # least score with 80 * positive <= 100 * score
            if low <= top:
                yield w["place"], w["id"], w["score"], other[(theirs >= low) & (theirs <= top)]


def _kernel(width: int, primes: list[int], k: int, negatives: bool):
    """Rows of chunks in, each chunk followed by the anchors; the best k of the chunk out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, chunk = None, [], None
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            asks = batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(chunks) != 0) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if chunks[lo] != number:
                    number, held, chunk = chunks[lo], [], None
                if not asks[lo]:
                    held.append(part)
                elif held:
                    chunk = chunk or _Chunk(held, width, primes)
                    yield from chunk.meet(part, k, negatives)

    return run


def _scaled(x: Column) -> Column:
    return F.abs(SCALE * x.cast("double"))


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(key, id, label, vector) of the rows that count; the key tells equal rows apart."""
    ids, vector, label = F.col("vec_id").cast("bigint"), F.col("embedding"), F.col("label").cast("bigint")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (_scaled(x) == float("inf")))
    moved = F.coalesce(ids % 7 == 0, F.lit(False))
    rows = embeddings.filter(label.isNotNull() & vector.isNotNull() & ~bad).select(
        ids.alias("id"), F.when(moved, (label + 1) % 10).otherwise(label).alias("label"), vector.alias("vector"),
    )
    return store(rows.withColumn("key", F.monotonically_increasing_id()))


def _round(rows: DataFrame, anchors: DataFrame, chunks: int, kernel) -> DataFrame:
    """Every chunk of rows against all anchors; a chunk's rows come first in its task."""
    number = F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    none = F.array().cast(WINDOWS).alias("positives")
    dealt = rows.select(number.alias("chunk"), F.lit(False).alias("anchor"), "key", "id", "label", "vector", none)
    asked = anchors.select(every.alias("chunk"), F.lit(True).alias("anchor"), "key", "id", "label", "vector", "positives")
    together = dealt.unionByName(asked).repartition(chunks, "chunk").sortWithinPartitions("chunk", "anchor")
    return together.mapInArrow(kernel, SCHEMA)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group over all chunks; a group holds k rows a chunk at most."""
    order = W.partitionBy(*by).orderBy(F.col("exact").desc(), F.col("other_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), see the module.

    Anchors are the rows whose id is divisible by `anchor_every`; the negatives of a positive are
    the first rows of another label that score at most as high and at least 0.8 times as high.
    """
    rows = taking_part(embeddings)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(_scaled(x) + 1.0, F.lit(2.0)))
    size = rows.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(squares).alias("norm"),
        F.max(F.array_max(F.transform("vector", _scaled))).alias("largest"),
    ).first()
    n, width = size["n"], max(1, size["width"] or 1)
    norm, largest = size["norm"] or 0.0, size["largest"] or 0.0
    # no product of two rows exceeds the greatest squared length
    primes = primes_for(int(norm * 1.000001) if norm < 1e300 else width * (int(largest) + 1) ** 2)
    chunks = max(1, -(-n * width // CHUNK_VALUES), min(FEW_CHUNKS, -(-n // CHUNK_ROWS)))
    anchors = rows.filter(F.col("id") % anchor_every == 0)
    near = _round(rows, anchors.withColumn("positives", F.array().cast(WINDOWS)), chunks, _kernel(width, primes, positives, False))
    chosen = _first(near, ["key"], positives).groupBy("key").agg(
        F.collect_list(F.struct(F.col("rank").alias("place"), F.col("other_id").alias("id"), "score", "exact")).alias("positives"),
    )
    asked = store(anchors.join(chosen, "key"))
    found = _round(rows, asked, chunks, _kernel(width, primes, negatives, True))
    return _first(found, ["key", "place"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
