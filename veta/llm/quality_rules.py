"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Every statistic is a built-in column expression over the whole text. A rule is a conjunction
of thresholds that rejects; it is grown on two thirds of the labelled rows by information
gain, pruned on the other third, kept if it is precise enough there, and the rows it covers
are set aside for the next rule. Each step is one aggregate over (statistic, bin) counts, so
all labelled rows take part and the driver sees some hundred counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veta.llm.text import let, store, text_or_empty, words

WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOPS = ".!?,;:"
DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("bigint")


def repeated_window_words(text: Column) -> Column:
    """Words inside any run of five words that the text has twice or more."""
    def from_hashes(hs: Column) -> Column:
        order = lambda a: F.array_sort(F.transform(a, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]),
        )
        starts = F.array_sort(F.transform(let(order(hs), twice), lambda x: x["i"]))
        covered = let(starts, lambda p: F.aggregate(
            F.transform(p, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - at, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda total, n: total + n,
        ))
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered).otherwise(F.lit(0).cast("bigint"))

    def hashes(ws: Column) -> Column:
        n = F.size(ws)
        return F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW))),
        )).otherwise(F.array().cast("array<bigint>"))

    return let(let(words(text), hashes), from_hashes)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the base columns, base_failed and the further statistics rules may use (s_*).

    Null texts count as empty. `keep` names input columns to carry along.
    """
    text = text_or_empty(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE_CHARS, "") != "")
    raw = docs.select(
        *(keep or []), *([] if keep else [F.col(id_col).alias("doc_id")]),
        F.size(words(text)).cast("bigint").alias("n_words"),
        _without(text, WHITE_CHARS).alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_lines"),
        repeated_window_words(text).alias("n_repeat_words"),
        (F.length(text) - _without(text, STOPS)).alias("_stops"),
        (F.length(text) - _without(text, DIGITS)).alias("_digits"),
        (F.length(text) - _without(text, CAPITALS)).alias("_capitals"),
    )
    n, c = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    n_lines = F.greatest(F.col("_lines.n"), F.lit(1)).cast("double")
    return raw.select(
        "*", (F.col("_lines.n") - F.col("_lines.d")).cast("bigint").alias("n_dup_lines"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.col("n_words").cast("double").alias("s_words"), (F.col("word_chars") / n).alias("s_word_length"),
        (F.col("n_symbols") / c).alias("s_symbols"), (F.col("n_repeat_words") / n).alias("s_repeated"),
        ((F.col("_lines.n") - F.col("_lines.d")) / n_lines).alias("s_dup_lines"), (n / n_lines).alias("s_line_words"),
        (F.col("_stops") / n).alias("s_stops"), (F.col("_digits") / c).alias("s_digits"), (F.col("_capitals") / n).alias("s_capitals"),
    ).drop("_lines", "_stops", "_digits", "_capitals")


FEATURES = ["s_words", "s_word_length", "s_symbols", "s_repeated", "s_dup_lines", "s_line_words", "s_stops", "s_digits", "s_capitals"]


@dataclass(frozen=True)
class Condition:
    """feature <= bound, or feature > bound."""

    feature: str
    above: bool
    bin: int
    bound: float

    def on_values(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound

    def on_bins(self) -> Column:
        return F.col(self.feature) > self.bin if self.above else F.col(self.feature) <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass
class RuleList:
    """Ordered rejecting rules; a row no rule covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True to keep, as one conditional expression over the statistics."""
        out = None
        for rule in self.rules:
            all_of = F.lit(True)
            for c in rule:
                all_of = all_of & c.on_values()
            out = (F if out is None else out).when(all_of, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nkeep"


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.on_bins()
    return out


def _gain(p: int, n: int, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def _best(rows: DataFrame, bounds: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of most information gain on the growing rows; then their classes."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in bounds)))
    counted = rows.filter("grow").select("bad", pairs.alias("c")).groupBy("c.f", "c.b").agg(
        F.sum(F.col("bad").cast("bigint")).alias("p"), F.count("*").alias("n"),
    ).collect()
    table = {(r["f"], r["b"]): (r["p"], r["n"] - r["p"]) for r in counted}
    first = next(iter(bounds))
    P = sum(p for (f, _), (p, _) in table.items() if f == first)
    N = sum(n for (f, _), (_, n) in table.items() if f == first)
    if not P or not N:
        return None, P, N
    before, best, most = math.log2(P / (P + N)), None, 1e-9
    for f, cuts in bounds.items():
        p = n = 0
        for b, cut in enumerate(cuts):  # bin b holds the values up to cut b
            dp, dn = table.get((f, b), (0, 0))
            p, n = p + dp, n + dn
            for above, gain in ((False, _gain(p, n, before)), (True, _gain(P - p, N - n, before))):
                if gain > most:
                    best, most = Condition(f, above, b, cut), gain
    return best, P, N


def _midpoints(quantiles: list[float] | None) -> list[float]:
    """Thresholds half-way between neighbouring quantiles, so that none lies on a common value."""
    values = sorted({float(x) for x in quantiles or [] if x is not None})
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def learn(
    labelled: DataFrame, features: list[str] | None = None, bins: int = 64, max_conditions: int = 4, max_rules: int = 12,
    precision: float = 0.9, least_cover: int = 5, seed: int = 1,
) -> RuleList:
    """Learn from rows (doc_id, bad boolean, features). No rows, or one class: no rules.

    A rule stays if at least `precision` of the pruning rows it covers are bad and it covers
    `least_cover` of them. Rows are dealt to growing and pruning by a hash of doc_id.
    """
    features = features or FEATURES
    shares = [i / bins for i in range(bins + 1)]
    cuts = labelled.agg(*(F.percentile_approx(f, shares, 10_000).alias(f) for f in features)).first()
    bounds = {f: _midpoints(cuts[f]) for f in features}
    bounds = {f: b for f, b in bounds.items() if b}
    if not bounds:
        return RuleList()
    binned = store(labelled.select(
        "bad", (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(3)) != 0).alias("grow"),
        *(sum((F.when(F.col(f) > x, 1).otherwise(0) for x in b), F.lit(0)).cast("smallint").alias(f) for f, b in bounds.items()),
    ))
    found, left = RuleList(), binned
    for _ in range(max_rules):
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            condition, _, _ = _best(left.filter(_all(rule)), bounds)
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        # prune: the shortest prefix of the best worth on rows not used for growing
        sums = [(F.sum((F.col("bad") & _all(rule[:k])).cast("bigint")), F.sum(_all(rule[:k]).cast("bigint"))) for k in range(1, len(rule) + 1)]
        row = left.filter(~F.col("grow")).agg(*(s.alias(f"c{i}") for i, s in enumerate(x for pair in sums for x in pair))).first()
        scored = [(row[2 * i] or 0, row[2 * i + 1] or 0) for i in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: ((2 * scored[i][0] - scored[i][1]) / scored[i][1] if scored[i][1] else -2, -i))
        bad, covered = scored[k]
        if covered < least_cover or bad < precision * covered:
            break
        found.rules.append(tuple(rule[: k + 1]))
        left = left.filter(~_all(rule[: k + 1]))
    return found


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of labelled rows that pass the base rule; null ids and labels are left out."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad"))
    return stats.filter(~F.col("base_failed")).join(marks, "doc_id")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base columns, base_failed, kept and the statistics.

    Null and empty texts have no words, so they fail the base rule. Repeated rows stay. An
    empty labels table gives no rules: then all that passes the base rule is kept.
    """
    stats = store(statistics(docs, id_col, text_col))
    rules = learn(labelled_rows(stats, labels))
    return stats.withColumn("kept", ~F.col("base_failed") & rules.verdict())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with docs' own columns."""
    marked = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rules = learn(store(labelled_rows(statistics(marked), labels).select("doc_id", "bad", *FEATURES)))
    own = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}  # free of clashes with the statistics' names
    renamed = docs.select(*(F.col(c).alias(own[c]) for c in docs.columns))
    kept = statistics(renamed, text_col=own["text"], keep=list(own.values())).filter(~F.col("base_failed") & rules.verdict())
    return kept.select(*(F.col(o).alias(c) for c, o in own.items()))
