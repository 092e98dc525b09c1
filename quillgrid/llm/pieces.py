"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct units of a batch are concatenated and indexed by a suffix array;
every piece of the model is located in it by binary search, which gives the range of its
occurrences. The occurrences are the edges of a lattice, sorted by position. Edges are then
relaxed in the order of the model's merges: of the edges that join two
neighbouring symbols of a unit, the one with the best score, the leftmost
among equals, until none is left.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import run_starts, slices, text_bytes
from .units import Encoder

MARK, MARK_BYTES = "▁", "▁".encode()
#: Symbols of a unit from which on a heap picks the next merge.
LONG_UNIT = 48
_END = 0x110000


class Model:
    """Pieces of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback and no normalisation is asked for")
        self.library = sentencepiece.__name__
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        #: what every id stands for
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else (p.piece.replace(MARK, " ").encode() if p.type == 1 else b"") for p in proto.pieces]
        if any(MARK in p[1:] and p.strip(MARK) for _, p, _ in pieces):
            raise ValueError("a piece goes over white space")
        self.cut_chars = [c for c in "\n\t\r" if not any(c in p for _, p, _ in pieces)]
        pieces.sort(key=lambda x: -x[2])
        self.ids = np.array([i for i, _, _ in pieces], np.int64)
        scores = np.array([s for _, _, s in pieces])
        self.rank = np.concatenate(([0], np.cumsum(scores[1:] != scores[:-1])))  # equal scores share a rank
        self.length = np.array([len(p) for _, p, _ in pieces])
        self.most = int(self.length.max())
        self.chars = np.full((len(pieces), self.most), -1, np.int64)
        for k, (_, p, _) in enumerate(pieces):
            self.chars[k, : len(p)] = [ord(c) for c in p]


@lru_cache(4)
def model(path: str) -> Model:
    return Model(path)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    h = 1
    while True:
        if h == 1:
            new = np.concatenate(([0], np.cumsum(text[order][1:] != text[order][:-1])))
        else:
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))  # noqa: F821
        rank = np.empty(n, np.int64)
        rank[order] = new
        if h >= depth or new[-1] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        h *= 2


def occurrences(text: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of the piece) of every occurrence of every piece in text, sorted by start and length."""
    order = suffix_order(text, m.most)
    n, k = len(text), len(m.length)
    low, high = np.zeros(k, np.int64), np.full(k, n, np.int64)
    padded = np.append(text, np.full(m.most, -1, text.dtype))

    def bound(lo, hi, want, at, strict):
        """First seat of lo..hi whose symbol ``at`` is not below (strict: is above) the wanted one."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            c = padded[order[mid] + at]
            less = c <= want[live] if strict else c < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    for at in range(m.most):
        on = np.flatnonzero((m.length > at) & (low < high))
        if len(on) == 0:
            break
        want = m.chars[on, at]
        lo = bound(low[on], high[on], want, at, False)
        high[on] = bound(lo, high[on], want, at, True)
        low[on] = lo
    found = np.maximum(high - low, 0)
    seat = np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    start, piece = order[seat], np.repeat(np.arange(k), found)
    by = np.lexsort((m.length[piece], start))
    return start[by], piece[by]


def relax(begin: np.ndarray, size: np.ndarray, start: np.ndarray, piece: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of each unit; -> (starts, lengths) of the symbols left, in order of position."""
    stride = m.most + 1
    key = start * stride + m.length[piece]
    worst = np.int64(m.rank[-1] + 1)

    def rank_of(at, length):
        want = at * stride + np.minimum(length, m.most)
        slot = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where((length <= m.most) & (key[slot] == want), m.rank[piece[slot]], worst) if len(key) else np.full(len(at), worst)

    done_at, done_len = [], []
    short = size <= LONG_UNIT
    at = np.repeat(begin[short], size[short]) + np.arange(size[short].sum()) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
    length, unit = np.ones(len(at), np.int64), np.repeat(np.arange(short.sum()), size[short])
    while len(at):
        joined = np.full(len(at), worst)
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        joined[inner] = rank_of(at[inner], length[inner] + length[inner + 1])
        first = run_starts(unit)
        # best rank of each unit, the leftmost of equals
        best = np.minimum.reduceat(joined * len(at) + np.arange(len(at)), first)
        go = best // len(at) < worst
        n = np.diff(np.append(first, len(at)))
        stay = np.repeat(go, n)
        done_at.append(at[~stay])
        done_len.append(length[~stay])
        left = best[go] % len(at)
        length[left] += length[left + 1]
        stay[left + 1] = False
        at, length, unit = at[stay], length[stay], unit[stay]
    for b, n in zip(begin[~short].tolist(), size[~short].tolist()):
        a, k = _relax_long(b, n, rank_of, worst)
        done_at.append(a)
        done_len.append(k)
    at, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_at, done_len))
    by = np.argsort(at)
    return at[by], length[by]


def _relax_long(begin: int, n: int, rank_of, worst) -> tuple[np.ndarray, np.ndarray]:
    """One long unit, with a heap of joinable neighbours and a linked list of symbols."""
    length = [1] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = rank_of(begin + np.arange(n - 1), np.full(n - 1, 2))
    heap = [(int(r), i, 2) for i, r in enumerate(pairs.tolist()) if r < worst]
    heapq.heapify(heap)
    while heap:
        r, i, total = heapq.heappop(heap)
        j = after[i]
        if length[i] == 0 or j >= n or length[i] + length[j] != total:
            continue
        length[i], length[j] = total, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n:
                k = length[a] + length[b]
                r = int(rank_of(np.array([begin + a]), np.array([k]))[0])
                if r < worst:
                    heapq.heappush(heap, (r, a, k))
    kept = [i for i in range(n) if length[i]]
    return np.array(kept, np.int64) + begin, np.array([length[i] for i in kept], np.int64)


def encode_units(texts: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids and the ids of each unit (white space written as the mark)."""
    joined = "\U0010ffff".join(texts) + "\U0010ffff"
    text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    text[begin + size] = _END
    start, piece = occurrences(text, m)
    at, length = relax(begin, size, start, piece, m)
    stride = m.most + 1
    key, want = start * stride + m.length[piece], at * stride + length
    slot = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
    known = key[slot] == want if len(key) else np.zeros(len(at), bool)
    owner = np.searchsorted(begin, at, "right") - 1
    n_ids, out = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
    out[known] = m.ids[piece[slot[known]]]
    spelled = {}
    for i in np.flatnonzero(~known).tolist():
        spelled[i] = [m.byte_id[b] for b in chr(text[at[i]]).encode("utf-8", "surrogatepass")]
        n_ids[i] = len(spelled[i])
    where = np.cumsum(n_ids) - n_ids
    ids = np.empty(int(n_ids.sum()), np.uint32)
    ids[where[known]] = out[known]
    for i, x in spelled.items():
        ids[where[i] : where[i] + len(x)] = x
    return np.bincount(owner, n_ids, len(texts)).astype(np.int32), ids


class PieceEncoder(Encoder):
    """Units are runs of spaces with the word after them; new ones are matched batch by batch."""

    def __init__(self, path: str):
        self.model, self.kind = model(path), "pieces"
        self.forget()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return encode_units([t.replace(" ", MARK) for t in texts], self.model)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space = data == 0x20
        cut = space[1:] & ~space[:-1]
        for c in self.model.cut_chars:
            is_c = data == ord(c)
            cut |= is_c[1:] | is_c[:-1]
        start = np.concatenate(([True], cut, [True]))
        start[offsets] = True
        return np.flatnonzero(start[:-1])

    def prepared(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets with a space before each text that is not empty, and the mark written as a space."""
        data, offsets = text_bytes(column)
        if MARK_BYTES in data.tobytes():
            data, offsets = text_bytes(pa.array([(t or "").replace(MARK, " ") for t in column.to_pylist()], pa.string()))
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 0x20)
        return data, offsets + np.concatenate(([0], np.cumsum(full)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.flat(*self.prepared(column))


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def decode(ids: np.ndarray, bounds: np.ndarray, m: Model) -> list[bytes]:
    """The texts of ids[bounds[i]:bounds[i+1]], without the space before them."""
    table = b"".join(m.bytes)
    size = np.fromiter(map(len, m.bytes), np.int64, len(m.bytes))
    begin = np.cumsum(size) - size
    n = size[ids]
    total = np.concatenate(([0], np.cumsum(n)))
    source = np.repeat(begin[ids] - total[:-1], n) + np.arange(total[-1])
    out = np.frombuffer(table, np.uint8)[source].tobytes()
    return [out[a + 1 : b] if b > a else b"" for a, b in zip(total[bounds[:-1]].tolist(), total[bounds[1:]].tolist())]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, round_trip and (with ``ids``) ids of each row.

    The ids equal those of the sentencepiece library. Nothing is shuffled. A null or
    empty text has no ids and decodes to the empty text. A text that holds the mark U+2581 comes back
    with a space for it, as with the library. Other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        for batch in slices(batches):
            flat, bounds = enc.encode(batch.column("text"))
            texts = decode(flat, bounds, enc.model)
            raw = batch.column("text").fill_null("").cast(pa.large_binary()).to_pylist()
            out = [
                batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array([zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t == r for t, r in zip(texts, raw)]),
            ]
            names = [id_col, "n_ids", "ids_crc32", "decoded_sha256", "round_trip"]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            col = batch.column("ids")
            bounds = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.to_numpy()[bounds[0] : bounds[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(errors="replace") for t in decode(flat, bounds - bounds[0], m)])], [id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInArrow(work, f"`{id_col}` {kind}, text string")
