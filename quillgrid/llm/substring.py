"""Removal of repeated passages by relative Lempel-Ziv parsing.

The reference is the collection itself, cut into blocks where the content says so: the word windows of one document that
agree on their least 16-word seed form a block, so equal passages are cut into equal blocks
wherever they stand. Each block is indexed by a digest of its words; of equal ones the first (by row and place) is the
reference. Every document is parsed greedily against all indexed blocks: a factor (row, place, length; reference row, its place)
begins at the first block that the index holds elsewhere and goes on while the next block is found where the reference goes on.
Where factors begin or end inside a block, the
block itself is met nowhere else, but its seed is; at these boundaries the windows of 35 words are
looked up one by one and join the factors. So every factor is long enough (a window at least), and a window is repeated
if and only if one of the two look-ups finds it, as equal windows have the same seed at the same place.

Equality is that of 128-bit BLAKE2b digests of the words themselves, one space between them; hashes of 64 bits only decide
where texts are cut and which bucket an entry goes to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buckets import DEALT, bucket_of, buckets_for, dealt, in_buckets
from .store import Scratch, filter_by, own_uid_aside, rows_with_uid
from .text import U, Words, mix, run_starts, slices, text_bytes, window_hashes

WINDOW, SEED = 35, 16
#: Entries gathered by a task before it sends them on.
FLUSH = 1 << 19
_PLACE = U((1 << 28) - 1)
#: What a task's output rows hold: entries of the index, parts of factors (dealt by row), seeds of blocks not met elsewhere, and such blocks whose seed is (dealt by row).
ENTRIES, FACTORS, SEEDS, SPOTS = 0, 1, 2, 3
#: States of an entry: only answers others; asks whether it is met; is known to be met.
ANSWERS, ASKS, MET = 0, 1, 2
ENTRY = np.dtype([("key", "<u8"), ("check", "<u8"), ("uid", "<i8"), ("at", "<u4"), ("size", "u1"), ("state", "u1"), ("seed", "<u8")])
#: ``size`` windows of row ``uid`` from word ``at`` on are those of row ``ref`` from ``ref_at`` on; the reference names itself.
FACTOR = np.dtype([("uid", "<i8"), ("at", "<u4"), ("size", "<u4"), ("ref", "<i8"), ("ref_at", "<u4")])
SEED_ROW = np.dtype([("seed", "<u8"), ("uid", "<i8"), ("at", "<u4"), ("size", "u1"), ("asks", "?"), ("mark", "?")])
SPOT = np.dtype([("uid", "<i8"), ("at", "<u4"), ("size", "u1"), ("asks", "?")])


def sliding_least(seeds: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of seeds[p : p + width] for each p; of equal ones the first."""
    least = (seeds & ~_PLACE) | np.arange(len(seeds), dtype=U)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & _PLACE).astype(np.int64)


def blocks_of(words: Words) -> tuple[np.ndarray, ...]:
    """owner (number of the text), first window (from the text's first word), windows, and seed of each block."""
    h, b = words.hashes, words.bounds
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    n = np.maximum(np.diff(b) - WINDOW + 1, 0)
    if not n.any():
        return none
    seeds = window_hashes(h, SEED)
    place = sliding_least(seeds, WINDOW - SEED + 1)
    owner = np.repeat(np.arange(len(n)), n)
    skip = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(skip, n) + np.repeat(b[:-1], n)
    own_place = place[at]
    first = np.flatnonzero(np.concatenate(([True], (own_place[1:] != own_place[:-1]) | (owner[1:] != owner[:-1]))))
    size = np.diff(np.append(first, len(own_place)))
    begin, seat = at[first], own_place[first]
    return owner[first], begin - b[owner[first]], size, seeds[seat]


def digests(words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2): two halves of the digest of words[begin:end], by number in ``words``."""
    raw = words.data.tobytes()
    starts, ends = words.starts, words.ends
    odd = np.ones(len(starts) + 1, np.int64)  # words that do not follow the one before after just one space
    if len(starts):
        odd[1:-1] = (starts[1:] - ends[:-1] != 1) | (words.data[starts[1:] - 1] != 0x20)
    total = np.concatenate(([0], np.cumsum(odd)))
    plain = total[end] == total[begin + 1]
    out = []
    for a, b, ok in zip(starts[begin].tolist(), ends[end - 1].tolist(), plain.tolist()):
        piece = raw[a:b]
        out.append(hashlib.blake2b(piece if ok else b" ".join(piece.split()), digest_size=16).digest())
    return np.frombuffer(b"".join(out), U).reshape(-1, 2)


def _by(rows: np.ndarray, key: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """rows dealt out by a 64-bit key."""
    if len(rows):
        bucket = bucket_of(key, buckets)
        order = np.argsort(bucket, kind="stable")
        yield dealt(bucket[order], rows[order], kind)


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, with the reference of each run of equal ones in front of it; where runs start, and their lengths."""
    rows = rows[np.argsort(np.ascontiguousarray(rows["key"]))]
    some = run_starts(rows["key"])
    many = np.diff(np.append(some, len(rows)))
    met = np.repeat(many > 1, many)
    own = rows[met]
    rows[met] = own[np.lexsort((own["at"], own["uid"], own["state"] != ANSWERS, own["check"], own["key"]))]
    new = np.zeros(len(rows), bool)
    new[some] = True
    new[1:] |= rows["check"][1:] != rows["check"][:-1]
    first = np.flatnonzero(new)
    return rows, first, np.diff(np.append(first, len(rows)))


def _factors(rows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), FACTOR)
    for c in ("uid", "at", "size"):
        out[c] = rows[c]
    out["ref"], out["ref_at"] = lead["uid"], lead["at"]
    return out


class Index:
    """Entries of a task, sent on in large batches; of those that are equal here one goes on, and the others refer to it."""

    def __init__(self, buckets: int, key_bits: int):
        self.buckets, self.parts, self.held = buckets, [], 0
        self.mask = U((1 << 64) - (1 << 64 - key_bits))

    def add(self, digest: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.empty(len(digest), ENTRY)
        rows["key"], rows["check"] = digest[:, 0] & self.mask, digest[:, 1]
        for name, values in columns.items():
            rows[name] = values
        self.parts.append(rows)
        self.held += len(rows)
        if self.held >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows, first, count = _runs(np.concatenate(self.parts))
        self.parts, self.held = [], 0
        lead = np.repeat(first, count)
        other = np.ones(len(rows), bool)
        other[first] = False
        asked = other & (rows["state"] == ASKS)
        factors = _factors(rows[asked], rows[lead[asked]])
        yield from _by(factors, mix(factors["uid"].view(U)), FACTORS, self.buckets)
        met = first[(count > 1) & (rows["state"][first] == ASKS)]
        rows["state"][met] = MET
        keep = rows[first]
        yield dealt(bucket_of(keep["key"], self.buckets), keep)


def _block_pass(buckets: int, key_bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(buckets, key_bits)
        for batch in slices(batches):
            words = Words(*text_bytes(batch.column("text")))
            owner, at, size, seed = blocks_of(words)
            begin = words.bounds[owner] + at
            ids = batch.column("_uid").to_numpy()
            yield from index.add(digests(words, begin, begin + size + WINDOW - 1), uid=ids[owner], at=at, size=size, state=np.full(len(at), ASKS), seed=seed)
        yield from index.flush()

    return work


def _window_pass(buckets: int, key_bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of the boundary blocks."""
        index = Index(buckets, key_bits)
        for batch in slices(batches):
            words = Words(*text_bytes(batch.column("text")))
            for i, (uid, raw) in enumerate(zip(batch.column("_uid").to_pylist(), batch.column("spots").to_pylist())):
                spots = np.frombuffer(raw, SPOT)
                size = spots["size"].astype(np.int64)
                at = np.repeat(spots["at"].astype(np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                begin = words.bounds[i] + at
                yield from index.add(digests(words, begin, begin + WINDOW), uid=uid, at=at, size=1, state=np.where(np.repeat(spots["asks"], size), ASKS, ANSWERS), seed=0)
        yield from index.flush()

    return work


def _meet_work(buckets: int, seeds: bool):
    def work(_: int, held: list) -> Iterator[pa.RecordBatch]:
        """Equal entries refer to the first of them; with ``seeds``, distinct ones go on by their seeds."""
        for kind, _base, payload in held:
            if kind == FACTORS:
                rows = np.frombuffer(payload, FACTOR)
                yield from _by(rows, mix(rows["uid"].view(U)), FACTORS, buckets)
        rows = [np.frombuffer(payload, ENTRY) for kind, _base, payload in held if kind == ENTRIES]
        if not rows:
            return
        rows, first, count = _runs(np.concatenate(rows))
        shared = np.repeat(count > 1, count)
        told = (rows["state"] == MET) | (shared & (rows["state"] == ASKS))
        factors = _factors(rows[told], rows[np.repeat(first, count)[told]])
        yield from _by(factors, mix(factors["uid"].view(U)), FACTORS, buckets)
        if not seeds:
            return
        lead = rows[first]
        out = np.zeros(len(lead), SEED_ROW)
        for c in ("seed", "uid", "at", "size"):
            out[c] = lead[c]
        out["asks"] = ~told[first]
        # blocks whose seed is met here are settled here, but for a mark
        out = out[np.argsort(out["seed"], kind="stable")]
        yield from _settled_seeds(out, buckets)

    return work


def _spots(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), SPOT)
    for c in SPOT.names:
        out[c] = rows[c]
    return out


def _settled_seeds(rows: np.ndarray, buckets: int, last: bool = False) -> Iterator[pa.RecordBatch]:
    """rows: in order of seed. Blocks whose seed another block has too are spots; else the block goes on, unless this is the last task to see its seed."""
    first = run_starts(rows["seed"])
    if not len(first):
        return
    count = np.diff(np.append(first, len(rows)))
    shared = (count > 1) | np.logical_or.reduceat(rows["mark"], first)
    spots = _spots(rows[np.repeat(shared, count) & ~rows["mark"]])
    yield from _by(spots, mix(spots["uid"].view(U)), SPOTS, buckets)
    if not last:
        rest = rows[first]
        rest["mark"] = shared
        yield from _by(rest, rest["seed"], SEEDS, buckets)


def _seed_work(buckets: int):
    def work(_: int, held: list) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.frombuffer(payload, SEED_ROW) for _kind, _base, payload in held])
        yield from _settled_seeds(rows[np.argsort(rows["seed"], kind="stable")], buckets, last=True)

    return work


def _each_row(rows: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """rows, in order of uid -> one record for each uid with its rows as bytes."""
    first = run_starts(rows["uid"])
    if len(first):
        edge = np.append(first, len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(rows["uid"][first].copy()), pa.array([rows[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())], ["_uid", name])


def _spot_work(_: int, held: list) -> Iterator[pa.RecordBatch]:
    rows = np.concatenate([np.frombuffer(payload, SPOT) for _kind, _base, payload in held])
    yield from _each_row(rows[np.lexsort((rows["at"], rows["uid"]))], "spots")


def parse(rows: np.ndarray) -> np.ndarray:
    """Parts of factors -> whole factors: a part goes on the factor before it where that one's reference goes on."""
    rows = rows[np.lexsort((rows["at"], rows["uid"]))]
    before, now = rows[:-1], rows[1:]
    on = (before["uid"] == now["uid"]) & (before["at"] + before["size"] == now["at"]) & (before["ref"] == now["ref"]) & (before["ref_at"] + before["size"] == now["ref_at"])
    first = np.flatnonzero(np.concatenate(([True], ~on)))
    out = rows[first]
    out["size"] = np.add.reduceat(rows["size"], first)
    return out


def _parse_work(_: int, held: list) -> Iterator[pa.RecordBatch]:
    yield from _each_row(parse(np.concatenate([np.frombuffer(payload, FACTOR) for _kind, _base, payload in held])), "factors")


def parsed(docs: DataFrame, scratch: Scratch, text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """docs (with ``_uid``) -> (_uid, factors): the factors of each row that has any, as bytes of FACTOR records.

    Entries meet by the first ``key_bits`` bits of their digests (at most 64) and are told apart by the whole of them.
    """
    texts = docs.select("_uid", F.coalesce(text_col, F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = buckets_for(size // 40, docs)  # a block takes 40 bytes of text at least
    index = scratch.table(in_buckets(texts.mapInArrow(_block_pass(parts, key_bits), DEALT), parts, _meet_work(parts, True), DEALT), "blocks")
    scratch.tidy()
    by_seed = in_buckets(index.where(f"kind = {SEEDS}"), parts, _seed_work(parts), DEALT)
    spots = scratch.table(in_buckets(by_seed.unionByName(index.where(f"kind = {SPOTS}")), parts, _spot_work, "_uid long, spots binary"), "spots")
    some = filter_by(texts, spots.select("_uid"), "left_semi").join(spots, "_uid")
    found = scratch.table(in_buckets(some.mapInArrow(_window_pass(parts, key_bits), DEALT), parts, _meet_work(parts, False), DEALT), "windows")
    out = scratch.table(in_buckets(found.unionByName(index.where(f"kind = {FACTORS}")), parts, _parse_work, "_uid long, factors binary"), "factors")
    scratch.drop(index, spots, found)
    scratch.tidy()
    return out


def factors_of(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The parse as rows: id, at, words, ref (id of the row referred to, itself for a reference) and ref_at; places count words from 0."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("factors").to_pylist():
                r = np.frombuffer(raw, FACTOR)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (r["uid"], r["at"], r["size"] + np.int64(WINDOW - 1), r["ref"], r["ref_at"])], ["_uid", "at", "words", "_ref", "ref_at"])

    docs = rows_with_uid(docs, scratch, id_col)
    names = docs.select("_uid", F.col(id_col).alias("_id"))
    made = parsed(docs, scratch, text_col).mapInArrow(rows_of, "_uid long, at long, words long, _ref long, ref_at long")
    made = made.join(names, "_uid").withColumnRenamed("_id", id_col).join(names.toDF("_ref", "ref"), "_ref")
    return made.select(id_col, "at", "words", "ref", "ref_at")


def _cut_pass(with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            factors = batch.column("factors").to_pylist() if "factors" in batch.schema.names else None
            raw = batch.column("text").cast(pa.large_binary()).to_pylist()
            n_words, n_removed, out = [], [], []
            for i, text in enumerate(raw):
                words = text.split()
                total = len(words)
                if factors is not None:
                    own = np.frombuffer(factors[i], FACTOR)
                    at, size = own["at"].astype(np.int64), own["size"].astype(np.int64)
                    cover = np.zeros(total + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size + WINDOW - 1, -1)
                    keep = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                    words = [words[k] for k in keep.tolist()]
                n_words.append(total)
                n_removed.append(total - len(words))
                kept = b" ".join(words)
                out.append(kept.decode() if with_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["_uid", "n_words", "n_removed", "kept"])

    return work


_CUT = "_uid long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 for each row of docs.

    A word goes if it is covered by a window of 35 words whose words, in order, also start anywhere
    else in the table, in the same text too; that is judged on the input. Wholly equal
    rows repeat each other. A null text has no words. An empty table gives an empty
    table; no other column is read.
    """
    docs = rows_with_uid(docs, scratch, id_col)
    factors = parsed(docs, scratch, text_col, key_bits)
    texts = docs.select("_uid", F.coalesce(text_col, F.lit("")).alias("text"))
    cut = filter_by(texts, factors.select("_uid"), "left_semi").join(factors, "_uid").select("_uid", "text", "factors").mapInArrow(_cut_pass(False), _CUT)
    rest = filter_by(texts, factors.select("_uid"), "left_anti").mapInArrow(_cut_pass(False), _CUT)
    out = cut.unionByName(rest)
    if dict(docs.dtypes)[id_col] == "bigint" and not docs.where(f"not (`{id_col}` <=> _uid)").take(1):
        return out.select(F.col("_uid").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    return out.join(docs.select("_uid", id_col), "_uid").select(id_col, "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def cut_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words gone from their texts (the kept words joined by one space; other texts as they were).

    Every row stays, with its columns and their order; a column n_chars follows the text. Null, empty and short texts and texts without repeats are
    as they were; wholly equal rows repeat each other, and null or repeated ids do no harm. An empty table gives an empty table.
    """
    docs, back = own_uid_aside(docs)
    docs = rows_with_uid(docs, scratch, id_col)
    factors = parsed(docs, scratch, text_col)
    texts = docs.select("_uid", F.coalesce(text_col, F.lit("")).alias("text"))
    cut = filter_by(texts, factors.select("_uid"), "left_semi").join(factors, "_uid").select("_uid", "text", "factors").mapInArrow(_cut_pass(True), _CUT).select("_uid", "kept")
    touched = filter_by(docs, factors.select("_uid"), "left_semi").drop(text_col).join(cut.withColumnRenamed("kept", text_col), "_uid")
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"]))
    return back(touched.select(docs.columns).unionByName(filter_by(docs, factors.select("_uid"), "left_anti")))
