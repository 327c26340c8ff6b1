"""Repeatable splits and folds keyed on the row key, never on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cumulative import running_totals
from ..functions.scalars import portable_uniform
from ..functions.staging import stage


def _quotas(drawn: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by..., _n, _quota): test rows per class, the floor of the fair share, largest remainders first."""
    classes = stage(drawn.groupBy(*by).agg(F.count("_key").alias("_n")))
    total = F.sum("_n").over(W.partitionBy())  # a row per class from here on
    wanted = F.ceil(F.round(F.lit(share) * total, 9))
    classes = classes.withColumn("_wanted", wanted).withColumn("_fair", F.try_divide(F.col("_wanted") * F.col("_n"), total))
    rest = F.col("_fair") - F.floor("_fair")
    place = F.row_number().over(W.orderBy(rest.desc(), *[F.col(b).cast("string").asc_nulls_first() for b in by]))
    short = F.col("_wanted") - F.sum(F.floor("_fair")).over(W.partitionBy())
    return classes.select(*by, "_n", (F.floor("_fair") + (place <= short).cast("int")).alias("_quota"))


def _cuts(drawn: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _cut_u, _cut_key): the last row of each class, by draw and key, that is within its quota.

    Draws are uniform, so an interval of six deviations around the quota's share holds it; rows
    below are counted, rows inside are ranked.  A class whose interval misses is searched whole.
    """
    n, q = F.col("_n"), F.col("_quota")
    wide = 6 * F.sqrt(q * F.greatest(n - q, F.lit(1)) / n) / n + 2 / n
    limits = classes.where(q > 0).select(
        *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], q.alias("_quota"), (q / n - wide).alias("_lo"), (q / n + wide).alias("_hi"),
    )
    on = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    scoped = drawn.join(limits, on) if by else drawn.crossJoin(limits)
    names = [f"_by{i}" for i in range(len(by))]
    counted = stage(
        scoped.groupBy(*names, "_quota", "_lo", "_hi")
        .agg(F.count_if(F.col("_u") < F.col("_lo")).alias("_a"), F.count_if(F.col("_u") <= F.col("_hi")).alias("_b"))
        .withColumn("_held", (F.col("_a") < F.col("_quota")) & (F.col("_quota") <= F.col("_b")))
        .select(
            *names, F.col("_quota").alias("_q"), F.when(F.col("_held"), F.col("_a")).otherwise(0).alias("_below"),
            F.when(F.col("_held"), F.col("_lo")).otherwise(-1.0).alias("_from"), F.when(F.col("_held"), F.col("_hi")).otherwise(2.0).alias("_to"),
        )
    )
    inside = (drawn.join(counted, on) if by else drawn.crossJoin(counted)).where(F.col("_u").between(F.col("_from"), F.col("_to")))
    rank = F.row_number().over(W.partitionBy(*names, "_q", "_below").orderBy("_u", "_key"))
    last = inside.where(F.col("_key").isNotNull()).withColumn("_rank", F.col("_below") + rank).where(F.col("_rank") == F.col("_q"))
    return last.select(*names, F.col("_u").alias("_cut_u"), F.col("_key").alias("_cut_key"))


def _exact_split(df: DataFrame, key: str, by: list[str], seed: int, share: float) -> DataFrame:
    """`_test` is true for exactly the quota of rows of each class: the smallest draws, equal ones by key."""
    drawn = df.select(*by, portable_uniform(key, f"split-{seed}").alias("_u"), F.col(key).cast("string").alias("_key"))
    cuts = stage(_cuts(drawn, _quotas(drawn, by, share), by))
    u, k = portable_uniform(key, f"split-{seed}"), F.col(key).cast("string")
    if by:
        on = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
        joined = df.join(cuts, on, "left")
        cut_u, cut_key = F.col("_cut_u"), F.col("_cut_key")
    else:
        row = cuts.first()
        joined, cut_u, cut_key = df, F.lit(row and row["_cut_u"]).cast("double"), F.lit(row and row["_cut_key"]).cast("string")
    test = (u < cut_u) | ((u == cut_u) & (k <= cut_key))
    return joined.withColumn("_test", F.coalesce(test, F.lit(False))).select(*df.columns, "_test")


def train_test_split(
    df: DataFrame, key: str, test: float = 0.2, seed: int = 123, stratify: str | None = None, exact: bool = False
) -> DataFrame:
    """Add ``split`` = train / test.

    By default a row is a test row when its own draw is below the share: one
    projection, no shuffle, and class shares are kept up to sampling error.  The
    exact mode hits the row count (per class when stratified) to the row.
    """
    if exact:
        marked = _exact_split(df, key, [stratify] if stratify else [], seed, test)
        return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")
    in_test = portable_uniform(key, f"split-{seed}") < F.lit(test)
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def kfold_assign(df: DataFrame, key: str, k: int = 5, reps: int = 1, seed: int = 123) -> DataFrame:
    """Add ``fold_0`` ... ``fold_{reps-1}``: shuffled folds, seed + repetition each."""
    return df.withColumns({
        f"fold_{r}": F.floor(portable_uniform(key, f"fold-{seed + r}") * F.lit(k)).cast("int") for r in range(reps)
    })


def stratified_kfold(df: DataFrame, key: str, target: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Unshuffled stratified folds: blocks of consecutive keys per class.

    Fold sizes per class follow from dealing the class-sorted rows out in turn, classes in
    order of their first key.  Border keys are found by running totals over key ranges and
    compared in the key's own type, so 64-bit, decimal and text keys are exact.  Rows of
    equal keys stay together; rows without a key precede all others of their class, and
    together they count as one key.
    """
    counted = stage(df.groupBy(F.col(target).alias("_class"), F.col(key).alias("_key")).agg(F.count("*").alias("_n")))
    no_key = F.sum(F.when(F.col("_key").isNull(), F.col("_n")).otherwise(0))
    before = W.orderBy(F.col("_first").asc_nulls_first(), F.col("_of")).rowsBetween(W.unboundedPreceding, -1)  # a row per class
    classes = counted.groupBy(F.col("_class").alias("_of")).agg(
        F.sum("_n").alias("_rows"), no_key.alias("_no_key"), F.min("_key").alias("_first")
    ).withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    start, end = F.col("_start"), F.col("_start") + F.col("_rows")

    def dealt(upto: Column, folds: int) -> Column:
        """How many of the first ``upto`` rows the first ``folds`` folds get."""
        rest = F.pmod(upto, F.lit(k))
        return ((upto - rest) / k).cast("long") * folds + F.least(rest, F.lit(folds).cast("long"))

    borders = F.array(*[dealt(end, f) - dealt(start, f) for f in range(1, k)]).cast("array<long>")
    classes = classes.withColumn("_borders", borders)
    passed = F.size(F.filter("_borders", lambda b: b < F.col("_no_key")))  # borders among the rows without a key
    ranked = running_totals(counted.where(F.col("_key").isNotNull()), "_key", ["_n"], by=["_class"])
    last = F.col("_no_key") + F.col("cum__n")
    held = F.filter("_borders", lambda b: (b >= last - F.col("_n")) & (b < last))
    keys = ranked.join(classes, F.col("_class").eqNullSafe(F.col("_of"))).select("_class", "_key", F.explode(held))
    keys = keys.groupBy("_class").agg(F.collect_list("_key").alias("_keys"))  # at most k - 1 keys per class
    limits = classes.join(keys, F.col("_of").eqNullSafe(F.col("_class")), "left").select("_of", passed.alias("_passed"), "_keys")
    reached = F.size(F.filter(F.coalesce("_keys", F.array().cast(keys.schema["_keys"].dataType)), lambda b: b <= F.col(key)))
    fold = F.col("_passed") + F.when(F.col(key).isNull(), 0).otherwise(reached)
    joined = df.join(limits, F.col(target).eqNullSafe(F.col("_of")))
    return joined.withColumn(out, fold.cast("int")).select(*[c for c in df.columns if c != out], out)
