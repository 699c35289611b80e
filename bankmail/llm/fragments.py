"""Numbers dealt to hash ranges as packed arrays: a row per task and range, not a row per number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def fragment_bits(spark: SparkSession) -> int:
    """Fragments are 2 ** bits equal ranges of a hash: four for every shuffle partition, so that none outgrows a task."""
    return max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def dealt(fragment: np.ndarray, *columns: np.ndarray) -> Iterator[list]:
    """[fragment, bytes of each column] for every fragment."""
    order = np.argsort(fragment, kind="stable")
    fragment, columns = fragment[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(fragment)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(fragment)], strict=True):
        if hi > lo:
            yield [int(fragment[lo]), *(c[lo:hi].tobytes() for c in columns)]


def packed(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(len(names))], names)


def gathered(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)
