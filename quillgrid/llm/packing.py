"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .units import SPACE_UNITS, encoder

#: Tokens of a sequence.
SEQUENCE = 4096


def lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """Piece lengths for n ids: as many whole sequences as fit, then the binary digits of the rest, largest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE, ids: bool = True) -> DataFrame:
    """One row for each piece: doc id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and (with ``ids``) ids.

    Every document's ids (with end_id after them) are cut into pieces whose
    lengths are powers of two, at most ``most`` (itself one). A piece is a sequence of its own, so
    offset is 0, nothing is padded and no sequence crosses documents; sequences of
    one ``bucket`` (log2 of the length) have equal lengths, for batches of one
    shape. Nothing is shuffled: a row's pieces depend on that row alone.
    sequence_id is unique: the number of the input partition and of the piece in it. A
    null or empty text gives one piece with just end_id. Repeated rows are packed
    each for itself; other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, SPACE_UNITS)
        for batch, flat, bounds in enc.encoded(batches, end_id):
            doc = batch.column(0)
            rows, start, size, crc, total = [], [], [], [], []
            parts = []
            for i in range(batch.num_rows):
                own = flat[bounds[i] : bounds[i + 1]]
                at = 0
                for k in lengths(len(own), most):
                    piece = own[at : at + k]
                    rows.append(i)
                    start.append(at)
                    size.append(k)
                    crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                    total.append(len(own))
                    if ids:
                        parts.append(piece)
                    at += k
            out = [doc.take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                edges = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    made = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(work, schema)
    return made.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_sequences(packed: DataFrame, path: str) -> None:
    """One folder for each bucket, so that a reader gets sequences of equal length."""
    packed.write.partitionBy("bucket").mode("overwrite").parquet(path)
