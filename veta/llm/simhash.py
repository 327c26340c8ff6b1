"""SimHash voting with built-in aggregates: signed bit votes in packed 32-bit lanes.

Each term hash adds ``(h >> i) & 0x0000000100000001`` to sum i, so 32 long sums count the
ones of all 64 bits; a lane holds up to 2**32 - 1 votes, more terms than a text can have.
The partial sums run in the scan task, one row per text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = (1 << 32) + 1


def _votes(h: Column, name: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES))).alias(f"{name}_{i}") for i in range(32)]


def _bits(name: str, n: Column) -> Column:
    """Bit i is 1 if set in over half of the n hashes."""
    out = F.lit(0).cast("bigint")
    for i in range(32):
        lanes = F.col(f"{name}_{i}")
        low = lanes.bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(lanes, 32)
        for bit, ones in ((i, low), (i + 32, high)):
            out = out.bitwiseOR(F.when(ones * 2 > n, F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
    return out


def simhash(df: DataFrame, keys: list[str], hashes: Column, second: bool = False) -> DataFrame:
    """One row per distinct `keys`: fingerprint `fp` (and `fp2` from a second hash of each term).

    `hashes` is an array of 64-bit term hashes; rows that agree in `keys` must have equal
    arrays, and are counted in `repeats`. A row without terms gets fingerprint 0.
    """
    terms = df.select(*keys, F.posexplode_outer(hashes).alias("_pos", "_h"))
    columns = {"fp": F.col("_h")} | ({"fp2": F.xxhash64("_h")} if second else {})
    votes = terms.groupBy(*keys).agg(
        F.count("_h").alias("_n"),
        F.sum(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1).otherwise(0)).alias("repeats"),
        *(v for name, h in columns.items() for v in _votes(h, name)),
    )
    return votes.select(*keys, "repeats", *(
        F.when(F.col("_n") > 0, _bits(name, F.col("_n"))).otherwise(F.lit(0).cast("bigint")).alias(name) for name in columns
    ))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
