"""Conversations brought back to turns that alternate, at the least cost.

A repaired conversation is empty or reads, by the initials of its roles, `(ua)+` with an optional
`s` in front. Its turns are aligned to every feasible length of that grammar string by Wagner and
Fischer's table. Target strings of all lengths end alike, so the table counts target letters from
the end and one table holds all lengths; Ukkonen's band keeps only the cells that an alignment no
dearer than the incumbent (a greedy repair) can pass. Among the lengths of least cost the
backtraced audits are compared.

The table of a conversation has its turns times the band; where that passes CELLS, cells of
target letters of one parity are folded, which cannot be told apart by the turns to come. The
folded table needs memory for one byte or word a turn, as the audit itself does; both tables give
the same costs and audits.

One task sees a conversation's turns in order but only some bytes of each; whole texts pass by in
a second ordered stream, where the audit of the conversation comes first, and are hashed as they pass.

Nulls of any column stand for one space: as role and text, and in the key of the damage. Turns
without a number come first. Rows of one number are ordered by role, then by a digest of the
text. Rows without conv_id form one conversation; its conv_id is null in the result. A repeated
row is one more row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2  # costs of the edits
CUT = 1  # cost of a truncated turn that stays
CELLS = 1 << 22  # most cells of one table
FAR = 1 << 40  # cost of what is not allowed
ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3  # faults
VISIBLE = r"[^\x20\x09-\x0D]"


@dataclass
class Turns:
    """What the alignment sees: initials of the roles and the first fault of each turn."""

    initials: str
    faults: bytes

    def __len__(self) -> int:
        return len(self.faults)

    def stays(self, i: int) -> int:
        """Cost of a turn that is not deleted, over that of its role."""
        return FAR if self.faults[i] in (BLANK, DUPLICATE) else CUT if self.faults[i] == TRUNCATED else 0


def greedy_cost(turns: Turns) -> int:
    """Cost of a repair that inserts the letters missing between turns: the first incumbent."""
    cost, said = 0, ""
    for i, c in enumerate(turns.initials):
        stay, letter = turns.stays(i), "a" if said == "u" else "u"
        if stay == FAR:
            cost += DELETE
        elif c == "s" and not said:
            cost, said = cost + stay, "s"
        else:
            if c in ROLES and c != letter:
                cost, letter = cost + INSERT, c
            cost, said = cost + stay + (KEEP if c == letter else REROLE), letter
    return cost + {"": 0, "s": 2 * INSERT, "u": INSERT, "a": 0}[said]


class BandTable:
    """Costs of aligning the turns from i on to the last r letters of a target, for r near the turns left."""

    def __init__(self, turns: Turns, incumbent: int):
        n = len(turns)
        forced = np.array([turns.stays(i) == FAR for i in range(n)], dtype=bool)
        cut = np.array([turns.stays(i) == CUT for i in range(n)], dtype=bool)
        least = DELETE * int(forced.sum()) + CUT * int(cut.sum())
        # each insertion, and each deletion beyond the forced ones, costs 2 or more over the least
        self.reach = max(0, incumbent - least) // 2
        self.left = np.concatenate([np.cumsum((~forced)[::-1])[::-1], [0]])  # unforced turns from i on
        self.turns, self.n = turns, n

    @property
    def cells(self) -> int:
        return (self.n + 1) * (2 * self.reach + 1)

    def fill(self) -> BandTable:
        n, reach, width = self.n, self.reach, 2 * self.reach + 1
        self.table = np.full((n + 1, width), FAR, np.int64)
        letters = np.arange(width) - reach
        step = INSERT * np.arange(width)

        def inserted(row: np.ndarray, left: int) -> np.ndarray:
            row = np.where(letters + left < 0, FAR, row)  # no such letter
            return np.minimum.accumulate(row - step) + step

        last = np.full(width, FAR, np.int64)
        last[reach] = 0
        self.table[n] = inserted(last, 0)
        for i in range(n - 1, -1, -1):
            after, left = self.table[i + 1], int(self.left[i])
            if left == self.left[i + 1]:  # forced out: the band does not move
                row = after + DELETE
            else:
                # the band of i + 1 is centred one letter lower, so a kept turn stays in its column
                row = np.append(after[1:], FAR) + DELETE
                even = (letters + left) % 2 == 0  # an even number of letters left: the next is u
                c = self.turns.initials[i]
                match = np.where(even, KEEP if c == "u" else REROLE, KEEP if c == "a" else REROLE)
                kept = after + match + self.turns.stays(i)
                row = np.minimum(row, np.where(letters + left >= 1, kept, FAR))
            self.table[i] = np.minimum(inserted(row, left), FAR)
        return self

    def cost(self, i: int, r: int) -> int:
        at = r - int(self.left[i]) + self.reach
        return int(self.table[i, at]) if 0 <= at < self.table.shape[1] and r >= 0 else FAR

    def lengths(self, i: int) -> list[int]:
        """Even lengths in the band from turn i on."""
        low = max(0, int(self.left[i]) - self.reach)
        return list(range(low + low % 2, int(self.left[i]) + self.reach + 1, 2))

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least edits of that cost: D, I, K and R are tried in this order."""
        out = []
        while i < self.n or r:
            cost = self.cost(i, r)
            if i < self.n and self.cost(i + 1, r) + DELETE == cost:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns.initials[i] == ("a" if r % 2 else "u") else "R")
                i, r = i + 1, r - 1
        return "".join(out)


class FoldedTable:
    """The same with target letters of one parity folded; any number of pairs may follow."""

    def __init__(self, turns: Turns):
        n = self.n = len(turns)
        self.turns = turns
        self.pair = np.zeros(n + 1, np.int64)  # between pairs: may end here
        self.answer = np.zeros(n + 1, np.int64)  # u has been said
        self.first = np.zeros(n + 1, np.int64)  # after the system turn: a pair must follow
        self.answer[n], self.first[n] = INSERT, 2 * INSERT
        p, a, f = 0, INSERT, 2 * INSERT
        for i in range(n - 1, -1, -1):
            c, stay = turns.initials[i], turns.stays(i)
            asks = a + stay + (KEEP if c == "u" else REROLE)
            answers = p + stay + (KEEP if c == "a" else REROLE)
            p, a, f = min(p + DELETE, asks), min(a + DELETE, answers), min(f + DELETE, asks)
            p = min(p, a + INSERT)
            a = min(a, p + INSERT)
            f = min(f, a + INSERT)
            self.pair[i], self.answer[i], self.first[i] = p, a, f

    def audit(self, i: int, state: str) -> str:
        out = []
        while True:
            now = {"pair": self.pair, "answer": self.answer, "first": self.first}[state]
            if i == self.n and state == "pair":
                return "".join(out)
            then, letter = ("pair", "a") if state == "answer" else ("answer", "u")
            after = self.pair if then == "pair" else self.answer
            if i < self.n and now[i + 1] + DELETE == now[i]:
                out.append("D")
                i += 1
            elif after[i] + INSERT == now[i]:
                out.append("I")
                state = then
            else:
                out.append("K" if self.turns.initials[i] == letter else "R")
                i, state = i + 1, then


def _openings(turns: Turns) -> Iterator[tuple[int, int]]:
    """(k, cost) for every system turn k that may stay as the first, all before it deleted."""
    for k, c in enumerate(turns.initials):
        if c == "s" and turns.stays(k) < FAR:
            yield k, DELETE * k + turns.stays(k)


def repair(turns: Turns, cells: int = CELLS) -> tuple[int, str]:
    """Least cost and its ASCII-least audit."""
    incumbent = greedy_cost(turns)
    band = BandTable(turns, incumbent)
    if band.cells <= cells:
        band.fill()
        ways = [(band.cost(0, r), 0, r, "") for r in band.lengths(0)]
        for k, cost in _openings(turns):
            if cost <= incumbent:
                ways += [(cost + band.cost(k + 1, r), k + 1, r, "D" * k + "K") for r in band.lengths(k + 1) if r]
        best = min(w[0] for w in ways)
        return best, min(start + band.audit(i, r) for cost, i, r, start in ways if cost == best)
    folded = FoldedTable(turns)
    ways = [(int(folded.pair[0]), 0, "pair", -1)]
    ways += [(cost + int(folded.first[k + 1]), k + 1, "first", k) for k, cost in _openings(turns)]
    best = min(w[0] for w in ways)
    return best, min(("D" * k + "K" if k >= 0 else "") + folded.audit(i, state) for cost, i, state, k in ways if cost == best)


def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage; a dropped row stays, its `kept` false."""
    rows = conversations.select("conv_id", "turn", _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text"))
    key = F.concat_ws(":", _or_space(F.col("conv_id")), _or_space(F.col("turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text", kind.alias("_kind"),
    ).select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("_kind") != 0).alias("kept"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, bool, Iterator]]:
    """Rows of sorted batches as (conv_id, first of its conversation, row)."""
    before, any_yet = None, False
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            first = not any_yet or row[0] != before
            before, any_yet = row[0], True
            yield first, row


class _Summary:
    """Counts of one conversation while its turns go by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.initials, self.faults = conv_id, [], bytearray()
        self.seen: set[bytes] = set()
        self.least = self.most = None
        self.numbers = 0

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None:
            self.numbers += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.faults.append(BLANK if blank else DUPLICATE if digest in self.seen else TRUNCATED if cut else 0)
        self.seen.add(digest)
        self.initials.append(initial)

    def row(self) -> tuple:
        turns = Turns("".join(c or "\0" for c in self.initials), bytes(self.faults))
        cost, audit = repair(turns) if len(turns) else (0, "")
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.numbers
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # as a 64-bit difference
        legal = ("su", "ua", "au")
        illegal = sum(a + b not in legal for a, b in zip(self.initials, self.initials[1:]))
        return self.conv_id, gaps, *(self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["conv_id", *NUMBERS, "audit"], [pa.int64()] * 7 + [pa.string()]
    now, done, size = None, [], 0
    for first, (conv_id, kept, turn, initial, blank, cut, digest) in _conversations(batches, ["conv_id", "kept", "turn", "initial", "blank", "cut", "digest"]):
        if first:
            if now is not None:
                done.append(now.row())
                size += len(done[-1][-1])
                if len(done) >= 4096 or size > 1 << 20:
                    yield _batch(done, names, types)
                    done, size = [], 0
            now = _Summary(conv_id)
        if kept:
            now.add(turn, initial, blank, cut, digest)
    if now is not None:
        done.append(now.row())
        yield _batch(done, names, types)


class _Repaired:
    """Hash of the repaired turns of one conversation while the texts go by in order."""

    def __init__(self, numbers: tuple, audit: str):
        self.numbers, self.audit, self.at = numbers, audit, 0
        self.hash, self.letter, self.begun = hashlib.sha256(), "u", False

    def _say(self, role: str, text: str) -> None:
        if self.begun:
            self.hash.update(b"\n")
        self.begun = True
        self.hash.update(f"{role}:".encode("utf-8", "surrogatepass"))
        self.hash.update(text.encode("utf-8", "surrogatepass"))

    def _next(self) -> str:
        letter, self.letter = self.letter, "a" if self.letter == "u" else "u"
        return ROLES[letter]

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._say(self._next(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            if role[:1] != "s":  # a system turn is kept only as the first, before the pairs
                self._next()
            self._say(role, text)
        elif edit == "R":
            self._say(self._next(), text)

    def row(self) -> tuple:
        self._inserted()
        return *self.numbers, self.audit, self.hash.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["conv_id", *NUMBERS, "audit", "repaired_sha256"], [pa.int64()] * 7 + [pa.string()] * 2
    now, done, size = None, [], 0
    columns = ["conv_id", *NUMBERS, "audit", "role", "text"]
    for first, (*numbers, audit, role, text) in _conversations(batches, columns):
        if first:  # the row of the summary
            if now is not None:
                done.append(now.row())
                size += len(now.audit)
                if len(done) >= 4096 or size > 1 << 20:
                    yield _batch(done, names, types)
                    done, size = [], 0
            now = _Repaired(tuple(numbers), audit)
        else:
            now.add(role, text)
    if now is not None:
        done.append(now.row())
        yield _batch(done, names, types)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, faults, illegal, cost, audit and hash of the repair of the damaged rows."""
    rows = damaged(conversations)
    seen = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    compact = rows.select(
        "conv_id", "kept", "turn", "role", F.substring("role", 1, 1).alias("initial"), (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"), _digest(F.col("text")).alias("digest"),
    )
    said = F.unhex(F.md5(F.concat(F.col("role"), F.lit("\0"), F.hex("digest")).cast("binary")))
    compact = compact.repartition("conv_id").sortWithinPartitions(*order).withColumn("digest", said)
    summaries = compact.select("conv_id", "kept", "turn", "initial", "blank", "cut", "digest").mapInArrow(_summaries, RESULT)
    nothing = [F.lit(None).cast("bigint").alias(c) for c in NUMBERS]
    texts = rows.filter("kept").select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", _digest(F.col("text")).alias("digest"), *nothing, F.lit(None).cast("string").alias("audit"), "text",
    )
    lead = summaries.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("digest"), *NUMBERS, "audit", F.lit(None).cast("string").alias("text"),
    )
    stream = lead.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", *order[1:])
    return stream.select("conv_id", *NUMBERS, "audit", "role", "text").mapInArrow(_hashed, f"{RESULT}, repaired_sha256 string")
