"""Index entries as arrays: dealt out by the bits of a 64-bit key, many to a row, and worked on bucket by bucket.

A row of a shuffle holds all entries that a task has for one bucket, as bytes; so the JVM moves some
thousands of rows instead of millions, and sorting is done on arrays. A bucket is what a task holds in memory; there are so
many that each has about PART_ROWS entries at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import U, give_back, run_starts

#: Index entries meant for one task.
PART_ROWS = 3_000_000


def buckets_for(rows: int, docs: DataFrame) -> int:
    """Partitions for so many index entries: as many as the session deals, or more where a task would get over PART_ROWS."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // PART_ROWS))


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket of each signature; it ascends with the signature."""
    return ((sig >> U(40)).astype(np.int64) * buckets) >> 24


DEALT = "bucket int, kind int, base long, payload binary"


def dealt(bucket: np.ndarray, rows: np.ndarray, kind: int = 0, base: int = 0) -> pa.RecordBatch:
    """Index entries, in order of their buckets, as one row for each bucket."""
    first = run_starts(bucket)
    edge = np.append(first, len(bucket)).astype(np.int64) * rows.dtype.itemsize
    raw = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(rows))])
    size = len(first)
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, base, np.int64)), raw.cast(pa.binary())], ["bucket", "kind", "base", "payload"])


def in_buckets(made: DataFrame, parts: int, work: Callable, schema: str) -> DataFrame:
    """Rows of dealt() brought together, a bucket to a task; ``work(bucket, list of (kind, base, payload))`` gives record batches."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = 0, []
        for batch in batches:
            for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "base", "payload"))):
                held.append(tuple(rest))
        if held:
            yield from work(bucket, held)
        give_back()

    return made.repartitionById(parts, F.col("bucket")).mapInArrow(go, schema)
