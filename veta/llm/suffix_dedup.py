"""Suffix-array dedup: remove every byte of a 200-byte string that starts anywhere else too.

Windows that cannot repeat are set aside by their anchors (see windows.py). Where one anchor
has more context than a task should hold, Spark counts its windows, and only stretches of
windows met more than once go on, parted by who shares them. What is left is settled by sorting suffixes: they are compared by the length of their common extension, which
a binary search over prefix polynomial hashes finds, so a comparison takes a logarithmic
number of steps; the sort is a mergesort. In suffix order the longest extension a suffix
shares with any other is that with a neighbour, and every claimed extension is compared byte
by byte before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.text import store
from veta.llm.windows import PrefixHash, byte_tokens, covered, keyed, merged, repeated, with_edges, with_ranges

LENGTH, GRAM = 200, 64
HELD_BYTES = 4_000_000  # context sorted together; anchors with more are split by their windows
CONTEXT = "gram bigint, part bigint, d bigint, t bigint, lo bigint, n bigint, context binary"
WINDOW = "gram bigint, w bigint, d bigint, t bigint, lo bigint, at bigint"
RANGE = "d bigint, t bigint, lo bigint, hi bigint"
MASK = (1 << 64) - 1


class Suffixes:
    """Suffixes of contexts laid end to end; a suffix ends with its context."""

    def __init__(self, contexts: list[bytes]):
        self.raw = b"".join(contexts)
        self.ends = np.cumsum([len(c) for c in contexts])
        self.hash = PrefixHash(np.frombuffer(self.raw, np.uint8))

    def _run(self, i: int, n: int) -> int:
        sums = self.hash.sums
        return ((int(sums[i + n]) - int(sums[i])) * int(self.hash.down[i])) & MASK

    def extension(self, i: int, j: int, room_i: int, room_j: int) -> int:
        """Length of the common extension of the suffixes at i and j, by binary search."""
        low, high = 0, min(room_i, room_j)
        while low < high:
            middle = (low + high + 1) // 2
            if self._run(i, middle) == self._run(j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def verified(self, i: int, j: int, n: int) -> int:
        """n if the bytes agree; after a hash collision the true common length."""
        a, b = self.raw[i : i + n], self.raw[j : j + n]
        if a == b:
            return n
        return int(np.flatnonzero(np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8))[0])

    def compare(self, x: tuple[int, int], y: tuple[int, int]) -> int:
        n = self.extension(x[0], y[0], x[1], y[1])
        if n == x[1] or n == y[1]:
            return x[1] - y[1] or x[0] - y[0]
        return self.raw[x[0] + n] - self.raw[y[0] + n]

    def longest(self, starts: list[int], rooms: list[int]) -> dict[int, int]:
        """For each suffix the longest verified extension it shares with another of them."""
        order = sorted(zip(starts, rooms, strict=True), key=cmp_to_key(self.compare))
        out = dict.fromkeys(starts, 0)
        for (i, room_i), (j, room_j) in zip(order, order[1:]):
            n = self.verified(i, j, self.extension(i, j, room_i, room_j))
            out[i], out[j] = max(out[i], n), max(out[j], n)
        return out


def settle(contexts: list[bytes], open_: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, first, last) window starts of open contexts whose windows repeat among all.

    Window hashes first drop windows that no other can equal. Where a row of neighbouring
    windows is left, the suffixes equal to its first window are sorted; a common extension of
    n bytes settles n - length + 1 windows, and the row goes on behind them.
    """
    suffixes = Suffixes(contexts)
    begins = suffixes.ends - np.array([len(c) for c in contexts])
    counts = suffixes.ends - begins - length + 1
    of = np.repeat(np.arange(len(contexts)), counts)
    starts = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[of]
    _, same, times = np.unique(suffixes.hash.runs(starts, starts + length), return_inverse=True, return_counts=True)
    again = times[same] > 1
    waiting = again & open_[of]
    members = np.argsort(same, kind="stable")
    first_of = np.cumsum(times) - times
    fresh = np.flatnonzero(waiting & ~np.concatenate(([False], waiting[:-1] & (of[1:] == of[:-1]))))
    found: list[tuple[int, int, int]] = []
    while len(fresh):
        reach: dict[int, int] = {}
        for c in np.unique(same[fresh]):
            group = members[first_of[c] : first_of[c] + times[c]]
            reach |= suffixes.longest(starts[group].tolist(), (suffixes.ends[of[group]] - starts[group]).tolist())
        following = []
        for w in fresh.tolist():
            n = reach[int(starts[w])]
            last = w + max(n - length, 0)  # an unverified window is passed by
            if n >= length:
                found.append((int(of[w]), int(starts[w] - begins[of[w]]), int(starts[w] - begins[of[w]]) + n - length))
            following.append(last + 1)
        # the next waiting window of the same context, behind what is settled
        after = np.flatnonzero(waiting)
        at = np.searchsorted(after, following)
        ok = at < len(after)
        nexts = after[at[ok]]
        stay = of[nexts] == of[fresh[ok]]
        # a window that starts a row of its own is already in the first round
        linked = nexts[stay] == np.array(following)[ok][stay]
        fresh = np.unique(nexts[stay][linked])
    return found


def shared_stretches(contexts: DataFrame, length: int) -> DataFrame:
    """contexts cut to the stretches of windows they share, those of one set of sharers in one part.

    Windows of one anchor met once, by hash, are dropped. Neighbouring windows shared by the same
    contexts are one stretch, whose bytes all of them have. A stretch shared by very many is dealt
    to several parts: a window needs but one partner to repeat.
    """
    contexts = store(contexts.dropDuplicates(["gram", "d", "t", "lo"]))  # repeated rows bring theirs more than once
    together = max(2, HELD_BYTES // (2 * length))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["gram", "d", "t", "lo", "context"]).to_pylist():
                starts = np.arange(len(row["context"]) - length + 1)
                w = PrefixHash(np.frombuffer(row["context"], np.uint8)).runs(starts, starts + length).view(np.int64)
                same = [pa.array(np.full(len(w), row[c], np.int64)) for c in ("gram", "d", "t", "lo")]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(w), *same[1:], pa.array(starts)], ["gram", "w", "d", "t", "lo", "at"])

    windows = store(contexts.mapInArrow(lambda b: merged(hashed(b)), WINDOW))
    own = F.xxhash64("d", "t", "lo")
    sharers = windows.groupBy("gram", "w").agg(F.count("*").alias("k"), F.bit_xor(own).alias("who")).filter("k > 1")
    # a context has at most length - gram + 1 windows
    lists = windows.join(sharers, ["gram", "w"]).groupBy("gram", "d", "t", "lo").agg(F.array_sort(F.collect_list(F.struct("at", "w", "k", "who"))).alias("_shared"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                listed = row["_shared"]
                begin = 0
                for i in range(1, len(listed) + 1):
                    a, b = listed[i - 1], listed[i] if i < len(listed) else None
                    if b and b["at"] == a["at"] + 1 and (b["k"], b["who"]) == (a["k"], a["who"]):
                        continue
                    first = listed[begin]
                    # sharers agree in the first window, so in its hash; the deal goes by the context
                    deal = (row["_own"] % max(1, first["k"] // together)) * 0x9E3779B97F4A7C15
                    part = (first["w"] + deal + (1 << 63)) % (1 << 64) - (1 << 63)
                    out.append((row["gram"], part, row["d"], row["t"], row["lo"] + first["at"], row["n"], row["context"][first["at"] : a["at"] + length]))
                    begin = i
            columns = zip(*out, strict=True) if out else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CONTEXT.split(", ")])

    return contexts.withColumn("_own", own).join(lists, ["gram", "d", "t", "lo"]).mapInArrow(cut, CONTEXT)


def repeated_ranges(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, t, lo, hi): first and last starts of repeated windows, by key of text."""
    found = repeated(docs, byte_tokens, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        for batch in batches:
            for text, d, t, listed in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = byte_tokens(text.as_py())
                rows = listed.as_py()
                context = [raw[s["lo"] : s["hi"] + length].tobytes() for s in rows]
                ids = [pa.array([x.as_py()] * len(rows), pa.int64()) for x in (d, t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["gram"] for s in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), *ids, *(pa.array([s[c] for s in rows], pa.int64()) for c in ("lo", "n")), pa.array(context, pa.binary())],
                    names,
                )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[dict]) -> pa.RecordBatch:
            out = settle([r["context"] for r in rows], np.array([r["n"] == 1 for r in rows]), length)
            columns = zip(*((rows[i]["d"], rows[i]["t"], rows[i]["lo"] + a, rows[i]["lo"] + b) for i, a, b in out), strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d", "t", "lo", "hi"])

        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= HELD_BYTES and (row["gram"], row["part"]) != (held[-1]["gram"], held[-1]["part"]):
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["context"])
        if held:
            yield flush(held)

    def contexts_of(edges: DataFrame) -> DataFrame:
        return with_edges(docs, edges).mapInArrow(lambda b: merged(cut(b), 5_000), CONTEXT)

    size = F.sum(F.col("hi") - F.col("lo") + length)
    hot = store(found.edges.groupBy("gram").agg(size.alias("_size")).filter(F.col("_size") > HELD_BYTES).select("gram"))
    if hot.isEmpty():
        contexts = contexts_of(found.edges)
    else:
        shared = shared_stretches(contexts_of(found.edges.join(hot, "gram", "left_semi")), length)
        contexts = contexts_of(found.edges.join(hot, "gram", "left_anti")).union(shared)
    edges = contexts.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(sort, RANGE)
    return found.whole.union(edges)


def duplicate_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    Texts are UTF-8 bytes, null is empty, and a text shorter than `length` loses nothing.
    Repeated rows are documents of their own, so they repeat each other's strings. An empty
    table gives no rows; other columns are ignored.
    """
    base = keyed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    marked = with_ranges(base, repeated_ranges(base, length, gram)).select("doc_id", "_text", "_ranges")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = byte_tokens(text.as_py())
                gone = covered(len(raw), ranges.as_py(), length)
                runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            n, removed, runs, sha = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return marked.mapInArrow(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes cut out of the text; its other columns stay.

    A character goes only if all its bytes are covered, so the text stays valid. Null stays null.
    """
    own = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(c).alias(own[c]) for c in docs.columns))
    base = keyed(renamed, own[id_col], own[text_col])
    marked = with_ranges(base, repeated_ranges(base, length, gram)).select(*own.values(), "_ranges")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                value, listed = text.as_py(), ranges.as_py()
                if value and listed:
                    raw = byte_tokens(value)
                    gone = covered(len(raw), listed, length)
                    first = np.flatnonzero((raw & 0xC0) != 0x80)
                    kept = np.repeat(np.logical_or.reduceat(~gone, first), np.diff(np.append(first, len(raw))))
                    value = raw[kept].tobytes().decode("utf-8", "surrogatepass")
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, list(own.values()))

    out = marked.mapInArrow(cut, renamed.schema)
    return out.select(*(F.col(o).alias(c) for c, o in own.items()))
