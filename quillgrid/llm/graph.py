"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Scratch

#: Edges of a task that are joined in memory at a time.
CHUNK = 1 << 20


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of some edges, ascending, and the least vertex that each reaches by them."""
    ids, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _forest_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v, part) -> a star (u, v) around the least vertex of each component of up to CHUNK edges, with the chunk's name."""
    held, size, made = [], 0, 0

    def done():
        nonlocal held, size, made
        table = pa.Table.from_batches(held)
        u, v, part = (table.column(c).to_numpy() for c in ("u", "v", "part"))
        ids, root = forest(u, v)
        keep = ids != root
        name = f"{part[0]}-{made}"
        held, size, made = [], 0, made + 1
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep]), pa.array([name] * int(keep.sum()), pa.string())], ["u", "v", "chunk"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * CHUNK:
                yield done()
    if held:
        yield done()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of longs -> (_uid, root): each vertex with the least vertex it reaches.

    Tasks of about CHUNK edges first join their own; if there is one such task, all is done. Else
    large-star and small-star rounds turn every component into a star around its
    least vertex; the number of rounds grows with the logarithm of the size.
    Minima are pre-aggregated before the shuffle, and the minimum goes back by a
    join whose large partitions adaptive execution can split, so a vertex with
    very many edges is no bottleneck. Vertices without edges do not appear; an
    empty table gives an empty table.
    """
    def joined(some: DataFrame, name: str) -> DataFrame:
        some = scratch.table(some, name)
        tasks = max(1, -(-some.count() // CHUNK))
        out = some.coalesce(tasks).withColumn("part", F.spark_partition_id()).mapInArrow(_forest_pass, "u long, v long, chunk string")
        out = scratch.table(out, "stars")
        scratch.drop(some)
        return out

    now = joined(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        *sign, chunks = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("chunk")).first()
        if sign == seen or chunks <= 1:
            return now.select(F.col("u").alias("_uid"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("_uid"), F.col("v").alias("root")).distinct())
        seen, now = sign, now.select("u", "v")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        #: every edge of ``large`` points from the greater to the lesser vertex
        least = _least(large)
        small = large.join(least, "u").select("u", "v", "m")
        out = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = joined(out, "edges")
        scratch.tidy()
    raise RuntimeError("components did not settle")
