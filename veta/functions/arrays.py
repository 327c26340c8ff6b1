"""Sums of packed arrays, kept whole: one array per key reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64  # arrays of a key that the middle level leaves


def _adder(n_keys: int):
    """Arrow batches (keys, array) in, one array per key of the partition out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            names = zip(*(batch.column(i).to_pylist() for i in range(n_keys)))
            for name, row in zip(names, batch.column(n_keys)):
                values = row.values.to_numpy(zero_copy_only=False)
                sums[name] = sums[name] + values if name in sums else np.array(values)
        for name, values in sums.items():
            columns = [pa.array([k], f.type) for k, f in zip(name, schema)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([values], schema.field(n_keys).type)], schema.names)

    return run


def summed_arrays(parts: DataFrame, keys: list[str], array: str, tasks: int | None = None) -> dict[tuple, np.ndarray]:
    """Elementwise sums of the arrays of each key, added in a tree: in the task, in FAN groups, whole.

    ``parts`` has one row per task and key, so its arrays are never taken apart or shuffled by
    entry, and no task holds more than one array per key it was dealt.  The middle level is left
    out where the number of tasks is given and not above FAN.
    """
    rows = parts.select(*keys, array)
    add, kind = _adder(len(keys)), rows.schema
    if tasks is None or tasks > FAN:
        dealt = rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(FAN))).repartition(*keys, "_part").drop("_part")
        rows = dealt.mapInArrow(add, kind)
    found = rows.repartition(*keys).mapInArrow(add, kind).toArrow()
    names = zip(*(found.column(k).to_pylist() for k in keys))
    return {name: np.array(row.values.to_numpy(zero_copy_only=False)) for name, row in zip(names, found.column(array))}
