"""LM scoring: a gated recurrent language model learned from the corpus scores every document.

All training texts are counted and learned. Each task trains a copy of the model on its own
texts, the copies are averaged in Spark, each entry by the tokens it has learned from, and the
average goes on with the other half of the texts. The model lists the most frequent words, as
many as grow with the cube root of the corpus: about 8,000 of 130 million tokens, half a million
of 100 TB, so the model travels with every task and its copies stay few parts of the texts they
learn from. Counts of the words the model does not list, and of words too rare to ship with the
task, are joined by word: what is counted grows with the corpus itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veta.llm import gru
from veta.llm.text import store, text_or_empty

SHIPPED = 50_000  # most frequent words whose counts travel with the task; the rest is joined
LISTED = 50  # words are listed from a count of sqrt(training tokens) / LISTED up
FEWEST, PER_ROOT = 4096, 16  # of these at most PER_ROOT * cbrt(training tokens), or FEWEST if that is more
BLOCK = 8192  # weights averaged together
HELD_TOKENS = 400_000  # tokens a training task gathers before it learns them
SCORED_TOKENS = 4_000_000  # tokens scored side by side
COUNTED_WORDS = 300_000  # distinct words a task counts before it hands the counts on
CUT_BYTES = 8_000_000  # texts cut into words at a time
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _cut(texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Some of the texts, all their lower-cased (A-Z) words between the six ASCII blanks, and how many each text has."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    starts = [0, *(np.flatnonzero(np.diff(ends // CUT_BYTES)) + 1).tolist()][: len(texts)]
    for a, b in zip(starts, [*starts[1:], len(texts)][: len(starts)], strict=True):
        some = pc.ascii_trim_whitespace(pc.ascii_lower(texts[a:b]))
        lists = pc.ascii_split_whitespace(some)
        empty = pc.equal(some, "").to_numpy(zero_copy_only=False)  # cut into one empty piece
        words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        yield texts[a:b], words.filter(pc.not_equal(words, "")) if empty.any() else words, np.where(empty, 0, lengths)


def _numbered(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known, -1 for others."""
    return pc.index_in(words, value_set=known.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False)


def _closed(numbers: np.ndarray, lengths: np.ndarray, end: int) -> list[np.ndarray]:
    """Texts of these lengths one by one, each closed by `end`."""
    last = np.cumsum(lengths)
    return np.split(np.insert(numbers, last, end), (last + np.arange(1, len(last) + 1))[:-1])


def _counted(texts: DataFrame) -> DataFrame:
    """word, c: how often each word occurs; tasks count first, Spark adds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            yield from found.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

        held, size = [], 0
        for batch in batches:
            for _, words, _ in _cut(batch.column(0)):
                found = pc.value_counts(words)
                held.append(pa.table({"word": found.field("values").cast(pa.string()), "c": found.field("counts")}))
                size += len(found)
                if size > COUNTED_WORDS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def least_count(tokens: int) -> int:
    """The count from which a word is listed."""
    return max(1, math.ceil(math.sqrt(tokens) / LISTED))


def most_listed(tokens: int) -> int:
    """How many words are listed at most, the most frequent ones."""
    return max(FEWEST, round(PER_ROOT * math.cbrt(tokens)))


def _averaged(rows: DataFrame, start: np.ndarray) -> np.ndarray:
    """Mean of the copies' weights by what each has learned from, block by block; start where none has."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # of a share of the model's blocks, one sum each
        for batch in batches:
            for block, sums, n in zip(*(batch.column(i) for i in range(3)), strict=True):
                more = np.array([sums.values.to_numpy(), n.values.to_numpy()], dtype=float)
                key = block.as_py()
                held[key] = held[key] + more if key in held else more
        if held:
            lists = [pa.array([x[i] for x in held.values()], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *lists], ["block", "sums", "n"])

    kind = "block int, sums array<double>, n array<double>"
    got = rows.repartition("block").mapInArrow(add, kind).toArrow()  # as many entries as the model has weights
    out = start.astype(float)
    for block, sums, n in zip(*(got.column(c) for c in ("block", "sums", "n")), strict=True):
        at = block.as_py() * BLOCK
        s, k = sums.values.to_numpy(), n.values.to_numpy()
        part = out[at : at + BLOCK]
        np.divide(s, k, out=part, where=k > 0)
    return out


def _trained(texts: DataFrame, model: gru.Model, listed: pa.Array, end: int) -> gru.Model:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer(model.like(model.flat()))
        held, size = [], 0
        for batch in batches:
            for _, words, lengths in _cut(batch.column(0)):
                at = _numbered(words, listed)
                for ids in _closed(np.where(at < 0, model.other, at), lengths, end):
                    held.append(ids)
                    size += len(ids)
                    if size >= HELD_TOKENS:
                        trainer.text(np.concatenate(held), end)
                        held, size = [], 0
        if held:
            trainer.text(np.concatenate(held), end)
        n = trainer.weights().astype(np.float32)
        sums = trainer.model.flat() * n
        for at in range(0, len(n), BLOCK):
            if n[at : at + BLOCK].any():
                lists = [pa.array([x[at : at + BLOCK]], pa.list_(pa.float32())) for x in (sums, n)]
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), *lists], ["block", "sums", "n"])

    rows = texts.mapInArrow(learn, "block int, sums array<float>, n array<float>")
    return model.like(_averaged(rows, model.flat()))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Null texts are empty, so their only token is the end. Repeated rows are scored, and
    counted for training, each by itself. Without training texts the base score is 0 for all
    and the model is untrained. An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    base = base.withColumn("held_out", held_out(F.col("doc_id")))
    training = base.filter(~F.col("held_out"))

    # counts of all training tokens; the end is no word and is counted apart
    counts = store(_counted(training.select("text")))
    n_train = training.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = (sums["n"] or 0) + n_train, sums["v"] + (n_train > 0)
    least = least_count(total)
    n_listed = min(counts.filter(F.col("c") >= least).count(), most_listed(total))
    often = counts.orderBy(F.desc("c"), "word").limit(max(SHIPPED, n_listed)).toArrow()
    known, times = pa.concat_arrays([pa.array([], pa.string()), *often["word"].cast(pa.string()).chunks]), often["c"].to_numpy()

    listed = known[:n_listed]  # the most frequent words come first
    frequency = np.zeros(max(gru.WORDS, len(listed) + 1))
    frequency[: len(listed)] = times[:n_listed]
    end = len(listed)
    frequency[end] = n_train
    other, other_kinds = total - frequency.sum(), kinds - len(listed) - (n_train > 0)
    log_other = math.log10(other + 0.5 * (other_kinds + 1))
    log_base = math.log10(total + 0.5 * (kinds + 1))
    model = gru.Model.start(frequency, other + 0.5 * (other_kinds + 1))

    half = F.crc32(F.concat(F.lit("half"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) % 2
    for part in (0, 1):
        model = _trained(training.filter(half == part).select("text"), model, listed, end)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the tokens whose counts are known here, and the words to look up."""
        def flush() -> pa.RecordBatch:
            logs = gru.score(model, texts, end) / math.log(10)
            doc, out, lengths, n_known, base, other_logs, rare = zip(*held, strict=True)
            joined = [np.concatenate(x) for x in (lengths, n_known, base, other_logs)]
            joined[-1] += logs
            columns = [*map(pa.concat_arrays, (doc, out)), *map(pa.array, joined), pa.concat_arrays(rare)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"])

        log_of = np.log10(np.append(times, 0) + 0.5)
        log_end = math.log10(n_train + 0.5)
        held, texts, size = [], [], 0
        for batch in batches:
            done = 0
            for some, words, lengths in _cut(batch.column(2)):
                rows, done = slice(done, done + len(some)), done + len(some)
                at = _numbered(words, known)
                shipped, other_words = at >= 0, (at < 0) | (at >= len(listed))
                text = np.repeat(np.arange(len(lengths)), lengths)
                added = lambda x: np.bincount(text, x, len(lengths))  # noqa: B023, E731
                n_shipped, n_other = added(shipped).astype(np.int64), added(other_words)
                logs = np.where(shipped, log_of[at], 0)
                rare = words.filter(pa.array(~shipped)).cast(pa.string())
                stops = np.append(0, np.cumsum(lengths - n_shipped)).astype(np.int32)
                held.append((
                    batch.column(0)[rows], batch.column(1)[rows], lengths + 1, n_shipped + (n_train > 0), added(logs) + log_end,
                    added(logs * other_words) - n_other * log_other, pa.ListArray.from_arrays(stops, rare),
                ))
                texts += _closed(np.where(other_words, model.other, at), lengths, end)
                size += len(words) + len(some)
                if size >= SCORED_TOKENS:
                    yield flush()
                    held, texts, size = [], [], 0
        if held:
            yield flush()

    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, rare array<string>"
    rated = base.select("doc_id", "held_out", "text").mapInArrow(rate, kind)
    rated = store(rated.withColumn("key", F.xxhash64("doc_id", "n_tokens", "base", "model", "rare")))
    # rows that agree in id and words share a key; their looked-up sums are divided by their number
    looked = rated.select("doc_id", "key", F.posexplode("rare").alias("pos", "word")).join(counts, "word", "left")
    logs = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    firsts = F.sum(F.when(F.col("pos") == 0, 1).otherwise(0))
    found = looked.groupBy("doc_id", "key").agg(
        (F.sum(F.col("c").isNotNull().cast("bigint")) / firsts).cast("bigint").alias("rare_known"), (F.sum(logs) / firsts).alias("rare_logs"),
    ).withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    joined = rated.drop("rare").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_base)).alias("base_score"),
        (F.col("model") + F.coalesce("rare_logs", F.lit(0.0))).alias("score"),
    )
