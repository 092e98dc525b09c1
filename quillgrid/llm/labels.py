"""Labelled rows for the classifiers: folds and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .store import Scratch


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def sample(labels: DataFrame, label: str, n_folds: int, held_out: int, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``bound`` rows outside the held-out fold, the first in the order of a hash of the id.

    Rows without id or label are left out; of several labels for an id the greatest holds.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(id_col, n_folds) != held_out))
    rows = rows.groupBy(id_col).agg((F.max(label) > 0).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(bound)


def labelled(docs: DataFrame, rows: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(label, text) of the documents that the sampled rows name; the sample is bounded, so it is broadcast."""
    rows = scratch.table(rows, "sample")
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(rows), id_col).select("label", "text")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
