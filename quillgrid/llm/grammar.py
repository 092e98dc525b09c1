"""Token-id files compressed by Re-Pair grammars, with decoding of single documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Scratch
from .text import give_back, keep_freed, run_starts
from .units import BYTE_UNITS, encoder

#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1 << 20
#: Pairs named in a round, and the least count of a named pair.
PAIRS, LEAST = 2048, 8
#: Bits of the table that pairs are looked up in.
TABLE_BITS = 18
#: A round closes up the gaps if it replaces one symbol in so many at least.
GAPS = 16
#: Shard format, version 1, little-endian: magic, version, count of terminals, rules, documents,
#: symbols, ids (6 x u32); rules (left, right: u32 each); expansion length of each rule (u32);
#: first symbol of each document and the end (u32 each); ids of each document (u32 each); symbols (u16 or,
#: if there are more than 65,536 terminals and rules, u32).
MAGIC = b"QGRP"
_HEAD = struct.Struct("<4sIIIIII")


def compress(ids: np.ndarray, bounds: np.ndarray, terminals: int) -> bytes:
    """Shard of the documents ids[bounds[i]:bounds[i+1]].

    Each round counts all adjacent pairs within documents, gives the most frequent
    ones nonterminals, and replaces those occurrences that no better pair overlaps
    (of a run of one pair, every other one). Rounds go on until no pair has the least
    count or the symbols are used up. No pair crosses documents, so every
    document starts at a symbol.
    """
    seq = np.append(ids.astype(np.uint32), np.uint32(0))  # with a border
    first = np.zeros(len(seq), bool)
    first[bounds] = first[-1] = True  # a symbol that begins a document
    left, right, size = [], [], [np.ones(terminals, np.int64)]
    n = terminals
    narrow = terminals < 1 << 16
    kind, half = (np.uint32, 16) if narrow else (np.uint64, 32)
    low = kind((1 << half) - 1)
    spread = lambda k: ((k * kind(0x9E3779B1 if narrow else 0x9E3779B97F4A7C15)) >> kind(2 * half - TABLE_BITS)).astype(np.int64)
    rank = np.full(len(seq), 1 << 30, np.int32)
    # Where pairs are counted: after the first round a pair is frequent only if it was so before or holds a new symbol; all of its occurrences are counted.
    live = np.flatnonzero(~first[1:])
    # Rounds that replace much close up the gaps, so that symbols lie side by side; the others leave gaps and link the symbols.
    linked = False
    while len(live):
        beside = after[live] if linked else live + 1
        key = (seq[live].astype(kind) << kind(half)) | seq[beside].astype(kind)
        where = spread(key)
        sorted_ = np.sort(key)
        at = run_starts(sorted_)
        count = np.diff(np.append(at, len(sorted_)))
        room = min(PAIRS, (1 << 16) - n if narrow else PAIRS)
        good = np.flatnonzero(count >= LEAST)
        if len(good) == 0 or room <= 0:
            break
        good = good[np.argsort(-count[good], kind="stable")]
        pairs = sorted_[at[good]]
        # of pairs with one place in the table the most frequent has it; the other waits for the next round
        table = np.full(1 << TABLE_BITS, -1, np.int32)
        table[spread(pairs)[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        named = table[where]
        frequent = np.flatnonzero(named >= 0)
        named, stay = named[frequent], live[frequent]
        pairs = pairs[:room]
        own = np.flatnonzero(named < room)
        named, at, own = named[own], frequent[own], stay[own]
        same = pairs[named] == key[at]
        named, at, own = named[same], at[same], own[same]
        twin = np.flatnonzero(((pairs >> kind(half)) == (pairs & low))[named])  # only pairs of one symbol twice overlap themselves
        if len(twin):
            begins = np.ones(len(twin), bool)
            begins[1:] = (beside[at[twin[:-1]]] != own[twin[1:]]) | (np.diff(named[twin]) != 0)
            run = np.flatnonzero(begins)
            odd = (np.arange(len(twin)) - np.repeat(run, np.diff(np.append(run, len(twin))))) % 2 == 1
            keep = np.ones(len(own), bool)
            keep[twin[odd]] = False
            named, at, own = named[keep], at[keep], own[keep]
        gone = beside[at]
        rank[own] = named
        best = np.flatnonzero((named < rank[before[own] if linked else own - 1]) & (named <= rank[gone]))  # the border is before the first symbol too
        rank[own] = 1 << 30
        named, gone, best = named[best].astype(np.int64), gone[best], own[best]
        used = np.bincount(named, minlength=len(pairs)) > 0  # a pair that better ones overlap everywhere gets no symbol
        pairs, named = pairs[used], (np.cumsum(used) - 1)[named]
        l, r = (pairs >> kind(half)).astype(np.int64), (pairs & low).astype(np.int64)
        lengths = np.concatenate(size)
        left.append(l)
        right.append(r)
        size.append(lengths[l] + lengths[r])
        seq[best] = (n + named).astype(np.uint32)
        n += len(pairs)
        if not linked and GAPS * len(gone) >= len(seq):
            alive, marked = np.ones(len(seq), bool), np.zeros(len(seq), bool)
            alive[gone] = False
            marked[stay] = marked[best] = True
            kept = np.flatnonzero(alive)
            seq, first, marked = seq[kept], first[kept], marked[kept]
            new = seq[:-1] >= n - len(pairs)
            marked[:-2] |= new[1:]
            live = np.flatnonzero(marked)
            live = live[~first[live + 1]]
            rank = rank[: len(seq)]
            continue
        if not linked:
            after, before, alive = np.arange(1, len(seq) + 1), np.arange(-1, len(seq) - 1), np.ones(len(seq), bool)
            linked = True
        alive[gone] = False
        after[best] = after[gone]
        before[after[best]] = best
        live = np.sort(np.concatenate((stay, best, before[best])))
        live = live[run_starts(live)]
        live = live[alive[live] & (live >= 0)]
        live = live[~first[after[live]]]
    if linked:
        seq, first = seq[alive], first[alive]
    seq, first = seq[:-1], first[:-1]
    rules = np.stack((np.concatenate(left), np.concatenate(right)), 1).astype("<u4") if left else np.zeros((0, 2), "<u4")
    lengths = np.concatenate(size)[terminals:].astype("<u4")
    full = np.diff(bounds) > 0  # a document without ids begins where the next one does
    starts = np.append(np.flatnonzero(first), len(seq))[np.append(np.cumsum(full) - full, full.sum())].astype("<u4")
    head = _HEAD.pack(MAGIC, 1, terminals, len(rules), len(starts) - 1, len(seq), len(ids))
    return b"".join((head, rules.tobytes(), lengths.tobytes(), starts.tobytes(), np.diff(bounds).astype("<u4").tobytes(), seq.astype("<u2" if n <= 1 << 16 else "<u4").tobytes()))


class Shard:
    """Reads a shard; a document is expanded without the others."""

    def __init__(self, blob: bytes):
        magic, version, self.terminals, rules, self.n_docs, symbols, self.n_ids = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of this format")
        at = _HEAD.size
        self.rules = np.frombuffer(blob, "<u4", 2 * rules, at).reshape(-1, 2)
        self.lengths = np.frombuffer(blob, "<u4", rules, at := at + 8 * rules)
        self.starts = np.frombuffer(blob, "<u4", self.n_docs + 1, at := at + 4 * rules)
        self.sizes = np.frombuffer(blob, "<u4", self.n_docs, at := at + 4 * (self.n_docs + 1))
        at += 4 * self.n_docs
        self.symbols = np.frombuffer(blob, "<u2" if self.terminals + rules <= 1 << 16 else "<u4", symbols, at)
        self._flat = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every rule in turn, and where each rule's begin; rules only use earlier symbols."""
        if self._flat is None:
            begin = np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))
            flat, done = np.empty(begin[-1], np.uint32), self.terminals
            out = self.rules.astype(np.int64)
            # expand level by level: all rules whose parts are known
            level = 0
            while level < len(out):
                upto = level + 1
                ready = np.maximum(out[level:, 0], out[level:, 1]) < self.terminals + level if level else out.max(1) < self.terminals
                stop = np.flatnonzero(~ready)
                upto = level + (int(stop[0]) if len(stop) else len(ready))
                for side in (0, 1):
                    sym = out[level:upto, side]
                    shift = self.length_of(out[level:upto, 0]) if side else 0
                    self._write(flat, begin, begin[level:upto] + shift, sym)
                level = upto
            self._flat = flat, begin
        return self._flat

    def length_of(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.terminals
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.lengths[symbols[rule] - self.terminals]
        return out

    def _write(self, flat: np.ndarray, begin: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> None:
        rule = symbols >= self.terminals
        flat[at[~rule]] = symbols[~rule]
        if rule.any():
            size = self.length_of(symbols[rule])
            total = np.concatenate(([0], np.cumsum(size)))
            step = np.arange(total[-1])
            flat[np.repeat(at[rule] - total[:-1], size) + step] = flat[np.repeat(begin[symbols[rule] - self.terminals] - total[:-1], size) + step]

    def decode(self, begin: int, end: int) -> np.ndarray:
        """The ids of the documents from begin up to end."""
        symbols = self.symbols[self.starts[begin] : self.starts[end]].astype(np.int64)
        flat, rule_begin = self._expansions()
        size = self.length_of(symbols)
        rule = symbols >= self.terminals
        total = np.concatenate(([0], np.cumsum(size)))
        # terminals stand for themselves: a source index beyond the rules' ids
        source_begin = np.where(rule, rule_begin[np.where(rule, symbols - self.terminals, 0)] if len(self.rules) else 0, 0)
        out = np.empty(total[-1], np.uint32)
        out[total[:-1][~rule]] = symbols[~rule]
        if rule.any():
            at, sz = total[:-1][rule], size[rule]
            t = np.concatenate(([0], np.cumsum(sz)))
            step = np.arange(t[-1])
            out[np.repeat(at - t[:-1], sz) + step] = flat[np.repeat(source_begin[rule] - t[:-1], sz) + step]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.decode(i, i + 1)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, terminals: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode docs and write them in ascending order of id as shards.

    A table of rows (part, shard, ids array of the documents, payload in the format
    above) is written through Spark, so any file system that Spark writes
    to will do. Rows are dealt out by ranges of (id, hash of the text): equal ids stand in the order of their
    texts' hashes, and many rows of one id are dealt to several tasks. A null text is empty, null ids come first.
    A task holds one shard at a time, or one document if that is longer.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        enc = encoder(tokenizer, BYTE_UNITS)
        docs_, parts, held, part, shard = [], [], 0, None, 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in parts], np.int64)
            payload = compress(np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes))), terminals)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([docs_], pa.list_(pa.int64())), pa.array([int(sizes.sum())], pa.int64()), pa.array([payload], pa.binary())], ["part", "shard", "doc_ids", "n_ids", "payload"])

        for batch, flat, bounds in enc.encoded(batches, end_id):
            part = batch.column(2)[0].as_py()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                docs_.append(doc)
                parts.append(flat[bounds[i] : bounds[i + 1]].copy())
                held += len(parts[-1])
                if held >= shard_ids:
                    yield flush()
                    docs_, parts, held, shard = [], [], 0, shard + 1
        if docs_:
            yield flush()
        give_back()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(n, "id", "_h").sortWithinPartitions("id", "_h").select("id", "text", F.spark_partition_id().alias("part"))
    ordered.mapInArrow(work, "part int, shard int, doc_ids array<long>, n_ids long, payload binary").write.mode("overwrite").parquet(path)


def read_token_files(spark, path: str, scratch: Scratch) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files at path.

    The ids in front of a part are summed from one number for each part, of which there are as many
    as the writer had tasks; those within a part by a running sum over its shards' sizes.
    """
    from pyspark.sql import Window

    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    parts = spark.createDataFrame(before, "part int, part_start long")
    starts = files.select("part", "shard", "n_ids").join(F.broadcast(parts), "part")
    w = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", "shard", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(w), F.lit(0))).alias("shard_start"))
    decoded = files.mapInArrow(_digests, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, shard, ids = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("part", "shard", "doc_ids"))
            s = Shard(batch.column(batch.schema.get_field_index("payload"))[row].as_buffer())
            flat = s.decode(0, s.n_docs).astype("<u4")
            sizes = s.sizes.astype(np.int64)
            inner = np.cumsum(sizes) - sizes
            crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(inner, sizes)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(inner, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens array) of the documents in ids (a column doc_id), expanding just these."""
    def work(batches):
        for batch in batches:
            for payload, at, doc in zip(batch.column("payload"), batch.column("at").to_pylist(), batch.column("doc_id").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([Shard(payload.as_buffer()).document(at).astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    files = spark.read.parquet(path)
    where = files.select("part", "shard", F.posexplode("doc_ids").alias("at", "doc_id")).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return where.join(files.select("part", "shard", "payload"), ["part", "shard"]).select("doc_id", "at", "payload").mapInArrow(work, "doc_id long, tokens array<long>")
