"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into d // 2 + 1 segments, so two fingerprints within d bits
(d up to 3) agree in one segment up to one bit. Each segment is indexed whole and with each
of its bits blanked; equal whole segments meet directly, segments that differ in one bit meet
where that bit is blanked, one side holding 0 and the other 1. So a pair meets once for each
close segment, and every met pair is verified on the whole fingerprint.

Keys with more than `LIGHT` fingerprints would give too many pairs. Their members are indexed
again with the bits left for the rest of the fingerprint blanked: members that agree there are
within d bits by construction, so each is linked to the smallest alone. No pair list is made,
no member dropped, and the components are the same as from all pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veta.llm.components import components
from veta.llm.simhash import hex16, simhash
from veta.llm.text import lower_ascii, shingle_hashes, store, text_or_empty

BITS = 64
LIGHT = 256  # members of a key up to which listing its pairs costs less than blanking more bits


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _signatures(fps: DataFrame, width: int, segments: int) -> DataFrame:
    """(seg, pos, value, bit, fp): segments whole (pos = width) and with bit pos blanked."""
    slot = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(segments * (width + 1) - 1))).alias("_i"))
    seg, pos = (F.col("_i") / (width + 1)).cast("int"), F.col("_i") % (width + 1)
    mask = (1 << width) - 1 if width < 64 else -1
    value = F.call_function("shiftrightunsigned", F.col("fp"), F.col("seg") * width).bitwiseAND(F.lit(mask))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos"))
    blank = F.when(F.col("pos") < width, one).otherwise(F.lit(0).cast("bigint"))
    return (
        slot.select("fp", seg.alias("seg"), pos.alias("pos"))
        .select("fp", "seg", "pos", value.alias("_v"), blank.alias("_b"))
        .select(
            "fp", "seg", "pos", F.col("_v").bitwiseAND(F.bitwise_not("_b")).alias("value"),
            (F.col("_v").bitwiseAND(F.col("_b")) != 0).alias("bit"),
        )
    )


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` whose closure joins all pairs within max_bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must lie between 0 and 3")
    segments = max_bits // 2 + 1
    width = BITS // segments
    key = ["seg", "pos", "value"]
    of_key = W.partitionBy(*key)
    met = _signatures(fps, width, segments).select(
        "*", F.count("*").over(of_key).alias("_n"), F.max("bit").over(of_key).alias("_hi"), F.min("bit").over(of_key).alias("_lo"),
    )
    # a blanked segment matters only where both values of the bit occur
    met = store(met.filter((F.col("_n") > 1) & ((F.col("pos") == width) | (F.col("_hi") != F.col("_lo")))).drop("_hi", "_lo"))

    light = met.filter(F.col("_n") <= LIGHT)
    a = light.filter(~F.col("bit")).select(*key, F.col("fp").alias("u"))
    b = light.select(*key, "bit", F.col("fp").alias("v"))
    pairs = (
        a.join(b, key)
        .filter(F.when(F.col("pos") == width, F.col("u") < F.col("v")).otherwise(F.col("bit")))
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
        .select("u", "v")
    )

    # blank as many bits of the other segments as the difference left allows
    parts = [pairs]
    heavy = met.filter(F.col("_n") > LIGHT)
    for seg in range(segments):
        others = [b for b in range(BITS) if not seg * width <= b < (seg + 1) * width]
        for whole in (True, False):
            left = max_bits if whole else max_bits - 1
            if left < 0:
                continue
            masks = [signed(sum(1 << b for b in c)) for c in combinations(others, min(left, len(others)))]
            rows = heavy.filter((F.col("seg") == seg) & ((F.col("pos") == width) if whole else (F.col("pos") < width)))
            blanked = (
                rows.select("pos", "value", "fp", F.explode(F.array(*map(F.lit, masks)).cast("array<bigint>")).alias("mask"))
                .withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not(F.lit(signed(((1 << width) - 1) << (seg * width)) if width < 64 else -1).cast("bigint"))).bitwiseAND(F.bitwise_not("mask")))
            )
            same = W.partitionBy("pos", "value", "mask", "rest")
            parts.append(
                blanked.select(F.col("fp").alias("u"), F.min("fp").over(same).alias("v")).filter("u <> v")
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2,
) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), root (the component's own name), component_id, text_key.

    Texts are lower-cased (A-Z), cut into word shingles with repeats, and each bit of the
    fingerprint is the majority of the shingle hashes. Fingerprints within `max_bits` link;
    component_id is the smallest id reachable. Defined results: null and word-free texts have
    fingerprint 0 and link like any other; repeated rows stay repeated; a null id never is a
    component's smallest unless all its ids are null; an empty table gives no rows; other
    columns are ignored whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("_t"))
    hashed = base.select("doc_id", F.xxhash64("_t").alias("_key"), shingle_hashes(lower_ascii(F.col("_t")), shingle).alias("_hs"))
    prints = store(simhash(hashed, ["doc_id", "_key"], F.col("_hs")).select("doc_id", "_key", "fp", "repeats"))
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), max_bits))
    # the smallest id of a component is not that of its smallest fingerprint
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return (
        prints.join(named, "fp")
        .withColumn("_r", F.explode(F.sequence(F.lit(1).cast("bigint"), "repeats")))
        .select("doc_id", "fp", "root", "component_id", F.col("_key").alias("text_key"))
    )


def as_contract(found: DataFrame) -> DataFrame:
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of docs that stand for their component: one row each, with docs' own columns.

    The smallest id stays. Of several rows with that id and its component, the one with the
    least text hash stays, and of equal rows one; of a component without ids likewise.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    # rows of one id and text have one fingerprint, so (id, text hash) names the rows that stay
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("doc_id").alias("_id"), F.min("text_key").alias("_t"))
    own = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    place = lambda c: {"_z": c.isNull(), "_d": F.coalesce(c.cast("bigint"), F.lit(0))}
    chosen = stays.withColumns(place(F.col("_id"))).select("_z", "_d", "_t").distinct()
    rows = docs.select(*(F.col(c).alias(own[c]) for c in docs.columns))
    rows = rows.withColumns({**place(F.col(own[id_col])), "_t": F.xxhash64(text_or_empty(F.col(own[text_col])))})
    # both steps are keyed alike, so a text is shuffled once
    kept = rows.join(chosen, ["_z", "_d", "_t"], "left_semi").dropDuplicates(["_z", "_d", "_t"])
    return kept.select(*(F.col(o).alias(c) for c, o in own.items()))
