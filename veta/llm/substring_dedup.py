"""Substring dedup by level-wise doubling: remove words of 35-word windows that repeat.

Windows repeated at one length alone are extended to twice that length. The first level is
nine words, one anchor window for each 35-word window (see windows.py); anchors that repeat
are extended at once as far as all windows that share them reach, and where that whole run
does not repeat, to 18 and then to 35 words. What does not repeat drops out at each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.text import store
from veta.llm.windows import PrefixHash, byte_tokens, covered, keyed, merged, repeated, with_edges, with_ranges, word_bounds, word_tokens

LENGTH, GRAM = 35, 9
LEVELS = "d bigint, t bigint, at bigint, n bigint, half bigint, whole bigint"


def repeated_ranges(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, t, lo, hi): first and last word of repeated windows' starts, by key of text."""
    found = repeated(docs, word_tokens, length, gram)
    middle = min(2 * gram, length)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each window of a span: the hash of the middle length around its anchor, and its own."""
        for batch in batches:
            for text, d, t, listed in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = word_tokens(text.as_py())
                for s in listed.as_py():
                    sums = PrefixHash(words[s["lo"] : s["hi"] + length])
                    starts = np.arange(s["hi"] - s["lo"] + 1)
                    grams = np.arange(s["hi"] - s["lo"] + length - gram + 1)
                    hashes = sums.runs(grams, grams + gram).view(np.int64)
                    anchor = np.flatnonzero(hashes == s["gram"])
                    # the leftmost anchor within each window
                    anchor = anchor[np.searchsorted(anchor, starts)]
                    inner = np.minimum(anchor, starts + length - middle)
                    same = np.ones(len(starts), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (
                            same * d.as_py(), same * t.as_py(), starts + s["lo"], same * s["n"],
                            sums.runs(inner, inner + middle).view(np.int64), sums.runs(starts, starts + length).view(np.int64),
                        )],
                        [c.split()[0] for c in LEVELS.split(", ")],
                    )

    level = store(with_edges(docs, found.edges).mapInArrow(lambda b: merged(extend(b)), LEVELS))
    halves = level.groupBy("half").agg(F.sum("n").alias("_n")).filter("_n > 1").select("half")
    level = level.join(halves, "half", "left_semi")
    wholes = level.groupBy("whole").agg(F.sum("n").alias("_n")).filter("_n > 1").select("whole")
    edges = level.filter("n = 1").join(wholes, "whole", "left_semi").select("d", "t", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return found.whole.union(edges)


def duplicate_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: one row per row of docs; kept is the text left.

    Words are runs of anything but six ASCII blanks, unchanged; kept words are joined by one
    blank. Null has no words, a text of fewer than `length` words loses nothing, repeated rows
    repeat each other's windows, an empty table gives no rows, other columns are ignored.
    """
    base = keyed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    marked = with_ranges(base, repeated_ranges(base, length, gram)).select("doc_id", "_text", "_ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = byte_tokens(text.as_py())
                start, end = word_bounds(raw)
                gone = covered(len(start), ranges.as_py(), length)
                data = raw.tobytes()
                kept = b" ".join([data[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)])
                out.append((len(start), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            n, removed, sha, kept_texts = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return marked.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
