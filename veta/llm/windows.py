"""Repeated fixed-length windows over token sequences (bytes or words) of all texts.

Every window of `length` tokens is filed under its anchor: the `gram`-token run in it with the
least hash, the leftmost of equals. Equal windows have equal anchors at equal offsets, so only
windows whose anchor run repeats can repeat. The windows of one anchor are neighbours and form
one span; a span that repeats as a whole settles all its windows at once, and only spans at
the edge of a repeat go on to the operator's own method. Nothing here depends on corpus size.

Tokens of a text are gone through in segments, so memory does not grow with the longest text;
a span cut by a segment's end just goes on to the operator's method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.text import store, text_or_empty

SEGMENT = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NO_ID = -(1 << 63)
HOT = 1024  # a key is hot with more than 1 / HOT of all rows: fewer than HOT keys can be
SPANS = "gram bigint, digest bigint, d bigint, t bigint, lo bigint, hi bigint"
Tokens = Callable[[str], np.ndarray]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift; a bijection)."""
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.cumprod(out)


class PrefixHash:
    """Polynomial hashes of any run of tokens from prefix sums, modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.down = powers(INVERSE, n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((tokens.astype(U) + U(1)) * powers(BASE, n)[:-1], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def byte_tokens(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word: a run of anything but the six ASCII blanks."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_tokens(text: str) -> np.ndarray:
    """A 64-bit hash for every word: its bytes are mixed with their places before they are summed.

    A polynomial of the bytes alone would give equal hashes to long words built for it.
    """
    raw = byte_tokens(text)
    start, end = word_bounds(raw)
    n = end - start
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    sums = np.zeros(len(place) + 1, U)
    np.cumsum(mixed(place.astype(U) * U(256) + raw[np.repeat(start, n) + place] + U(1)), out=sums[1:])
    upto = np.cumsum(n)
    return mixed(sums[upto] - sums[upto - n] + n.astype(U))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from minima within blocks."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.iinfo(U).max)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def spans(tokens: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, hash of the whole span, first and last window start) per segment."""
    for at in range(0, len(tokens) - length + 1, SEGMENT):
        part = tokens[at : at + SEGMENT + length - 1]
        sums = PrefixHash(part)
        starts = np.arange(len(part) - gram + 1)
        grams = sums.runs(starts, starts + gram)
        least = _least(grams, length - gram + 1)
        # the anchor moves when a lesser run comes in, or when the window starts behind it
        change = np.flatnonzero((least[1:] != least[:-1]) | (least[:-1] == grams[: len(least) - 1])) + 1
        lo = np.concatenate(([0], change))
        hi = np.concatenate((change - 1, [len(least) - 1]))
        yield least[lo], sums.runs(lo, hi + length) ^ mixed((hi - lo).astype(U)), lo + at, hi + at


@dataclass
class Found:
    """whole: (d, t, lo, hi) windows settled as repeated; edges: (gram, d, t, lo, hi, n) distinct
    spans of anchors with unsettled windows, n occurrences each: those of n = 1 are unsettled."""

    whole: DataFrame
    edges: DataFrame


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs plus the key of a text (_d, _t) and _text: rows that agree in id and text share it."""
    text = text_or_empty(F.col(text_col))
    return docs.withColumns({"_d": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), "_t": F.xxhash64(text), "_text": text})


def repeated(keyed_docs: DataFrame, tokens: Tokens, length: int, gram: int) -> Found:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                for least, digest, lo, hi in spans(tokens(text.as_py()), length, gram):
                    same = np.full(len(lo), 1, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (least.view(np.int64), digest.view(np.int64), same * d.as_py(), same * t.as_py(), lo, hi)],
                        ["gram", "digest", "d", "t", "lo", "hi"],
                    )

    every = store(keyed_docs.select("_d", "_t", "_text").mapInArrow(lambda b: merged(scan(b)), SPANS))
    twice = store(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    kept = store(_among(every, twice, ["gram"]))
    distinct = store(kept.groupBy("gram", "digest").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "lo", "hi")).alias("one")))
    whole = _among(kept, distinct.filter("n > 1").select("gram", "digest", "n"), ["gram", "digest"]).select("d", "t", "lo", "hi")
    open_ = distinct.groupBy("gram").agg(F.min("n").alias("_m"), F.count("*").alias("n")).filter("_m = 1")
    edges = _among(distinct, open_, ["gram"]).select("gram", "one.d", "one.t", "one.lo", "one.hi", "n")
    return Found(whole, store(edges))


def _among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The stored rows whose key is in keys, which tells with n how many rows each has.

    Rows of a hot key are not shuffled: fewer than HOT keys can be hot, so these are broadcast.
    """
    most = rows.count() // HOT
    hot = F.broadcast(keys.filter(F.col("n") > most).select(*on))
    cold = keys.filter(F.col("n") <= most).select(*on)
    return rows.join(hot, on, "left_semi").union(rows.join(hot, on, "left_anti").join(cold, on, "left_semi"))


def merged(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def with_edges(keyed_docs: DataFrame, edges: DataFrame) -> DataFrame:
    """_text and its spans (gram, d, t, lo, hi, n) for every text that has one; each text once."""
    lists = edges.groupBy("d", "t").agg(F.collect_list(F.struct("gram", "lo", "hi", "n")).alias("spans"))
    texts = keyed_docs.select("_d", "_t", "_text").join(lists, (F.col("_d") == F.col("d")) & (F.col("_t") == F.col("t")))
    # repeated rows have spans of n > 1 only, which serve as partners: once or more often is the same
    return texts.select("_text", "d", "t", "spans")


def with_ranges(keyed_docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """keyed_docs plus _ranges: the (lo, hi) first and last starts of its repeated windows."""
    lists = ranges.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    return keyed_docs.join(lists, ["_d", "_t"], "left")


def covered(n: int, ranges: list[dict] | None, length: int) -> np.ndarray:
    """Mask of the n tokens that lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    if ranges:
        at = np.array([(r["lo"], r["hi"] + length) for r in ranges])
        np.add.at(edge, at[:, 0], 1)
        np.add.at(edge, at[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0
