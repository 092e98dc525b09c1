"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

Let R be the smaller and S the larger of two linked sets. Their symmetric
difference is at most H = floor((|R| + |S|) / 7) at a similarity of 3/4. Hash
order cuts the universe of shingles into m segments, m depending on the band
of sizes. The first H + 1 + k segments hold a difference of at most H, so at
least k + 1 of them are equal in both sets. Each nonempty segment is indexed by
a hash of its content.

Cost-based allocation: an empty segment, and one whose content more than HOT
sets share, says little and costs much; its allocation is -1 (no pairs). A set
whose skipped segments number at most k still meets every partner in another
segment, and all that was skipped only lowers the number of common
segments asked for. Sets with more of them that lie in several components go to a second index:
their rare shingles are counted against the bound, and those that consist of frequent ones are grouped into classes by these, and of each class
the smallest set, and members in other components than it, are indexed by larger segments with allocation 1: each segment with its one-deletion
neighbourhood finds differences of up to one, and half as many segments do (small sets, and
those with too many empty large segments, by their first shingles, as at most a quarter of
a set is missing in a partner). What more than HOT of those share costs too much for pairs: its rows form a group, within which parity
bitmaps tell who may link. Every candidate is verified on the texts. The hot segments of groups of near copies are first
linked as stars, so that a group is one component before pairs are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buckets import DEALT, bucket_of, buckets_for, dealt, in_buckets
from .graph import components, forest
from .store import Scratch, filter_by, own_uid_aside, rows_with_uid
from .text import U, Words, give_back, mix, run_starts, slices, text_bytes, window_hashes

SHINGLE = 5
#: Sets that share a segment's content, beyond which it is not paired.
HOT = 24
#: Sets of at most this size are indexed by single shingles where the first index does not do.
SMALL = 16
#: Signatures gathered by a task before it sends them on.
FLUSH = 1 << 19
#: Bitmaps of a block.
TILE_BYTES = 1 << 19


def limit(n: int) -> int:
    """Greatest symmetric difference of a set of n with a linked set that is no smaller."""
    return (n + 4 * n // 3) // 7


def slack(n: int) -> int:
    return -(-45 * (limit(n) + 1) // 100) + 1


def n_segments(n: int) -> int:
    return limit(n) + 1 + slack(n)


@lru_cache(None)
def band_ends(up: int = 3, down: int = 2) -> np.ndarray:
    out = [8]
    while out[-1] < 1 << 40:
        out.append(out[-1] * up // down)
    return np.array(out, np.int64)


@lru_cache(256)
def thresholds(m: int) -> np.ndarray:
    """Lower ends of the m segments of the hash universe, and a last one that nothing reaches."""
    return np.array([(i << 64) // m for i in range(m)], U)


@lru_cache(256)
def salts(scheme: int, m: int) -> np.ndarray:
    return mix(np.arange(m, dtype=U) + U((scheme + 1) << 32))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; fewer words than a shingle are one, no words none."""
    data, offsets = text_bytes(column)
    words = Words(data, offsets, lower=True)
    windows, b, out = window_hashes(words.hashes, SHINGLE), words.bounds, []
    for i in range(len(b) - 1):
        n = b[i + 1] - b[i]
        if n >= SHINGLE:
            s = np.sort(windows[b[i] : b[i + 1] - SHINGLE + 1])
            out.append(s[run_starts(s)])
        elif n:
            out.append(mix(window_hashes(words.hashes[b[i] : b[i + 1]], int(n)) + U(int(n))))
        else:
            out.append(np.zeros(0, U))
    return out


def schemes_of(n: int) -> list[tuple[int, int, int]]:
    """(scheme, m, segments used): that of the own band, and of the band below if it has partners there."""
    ends = band_ends()
    j = int(np.searchsorted(ends, n))
    out = [(j, n_segments(int(ends[j])), n_segments(n))]
    if j and 3 * n <= 4 * int(ends[j - 1]):
        m = n_segments(int(ends[j - 1]))
        out.append((j - 1, m, m))
    return out


def edges_of(s: np.ndarray, m: int, used: int) -> np.ndarray:
    """Bounds of the first ``used`` of m segments in the ascending set s."""
    low = thresholds(m)
    out = np.empty(used + 1, np.int64)
    out[:used] = np.searchsorted(s, low[:used])
    out[used] = len(s) if used == m else np.searchsorted(s, low[used])
    return out


def prefix_sums(s: np.ndarray) -> np.ndarray:
    out = np.zeros(len(s) + 1, U)
    np.cumsum(mix(s + U(0x632BE59BD9B4E019)), out=out[1:])
    return out


# large segments with one deletion -------------------------------------------------
def n_large(n: int) -> int:
    return limit(n) // 2 + 1 + large_slack(n)


def large_slack(n: int) -> int:
    """Large segments with fewer than two entries that a set may have: one of those may have no counterpart."""
    return 1 + limit(n) // 4


def large_schemes(n: int) -> list[tuple[int, int, int]]:
    ends = band_ends(4, 3)
    j = int(np.searchsorted(ends, n))
    out = [(j, n_large(int(ends[j])), n_large(n))]
    if j and 3 * n <= 4 * int(ends[j - 1]):
        m = n_large(int(ends[j - 1]))
        out.append((j - 1, m, m))
    return out


def _sets_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, 128-bit fingerprint, and numbers of empty segments."""
    for batch in slices(batches):
        out = []
        for s in shingle_sets(batch.column("text")):
            n = len(s)
            if n == 0:
                out.append((0, 0, 0, 0, 0, False))
                continue
            a, b = int(mix(s).sum(dtype=U)), int(mix(s ^ U(0xA5A5A5A55A5A5A5A)).sum(dtype=U))
            own = most = 0
            unsafe = False
            if limit(n):
                counts = [int((np.diff(edges_of(s, m, used)) == 0).sum()) for _, m, used in schemes_of(n)]
                own, most = counts[0], max(counts)
                _, m, used = large_schemes(n)[0]
                unsafe = int((np.diff(edges_of(s, m, used)) < 2).sum()) > large_slack(n)
            out.append((n, a - (1 << 64 if a >> 63 else 0), b - (1 << 64 if b >> 63 else 0), own, most, unsafe))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_uid"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.bool_())],
            ["_uid", "n", "fp1", "fp2", "empty_own", "empty_most", "unsafe"],
        )


def _triangle(first: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs within the runs of at most ``most`` entries."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, most + 1):
        at = first[count == k]
        if len(at):
            i, j = np.triu_indices(k, 1)
            a.append((at[:, None] + i).ravel())
            b.append((at[:, None] + j).ravel())
    return np.concatenate(a), np.concatenate(b)


# the first index: segments as they are ---------------------------------------------
#: Entries of the first index: 39 bits of a signature (its bucket has the others), whether it stands for more than HOT rows, and the row's id after ``base``.
_ENTRY, _FAR_ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("uid", "<u4")]), np.dtype([("low", "<u4"), ("high", "u1"), ("uid", "<i8")])
_STAR = np.dtype([("uid", "<i8"), ("lead", "<i8"), ("hot", "<i8")])
_LOW = U((1 << 39) - 1)
ENTRIES, FAR_ENTRIES, STARS = 0, 1, 2


def _entries(sig: np.ndarray, uid: np.ndarray, hot: np.ndarray, buckets: int) -> pa.RecordBatch:
    """sig: ascending."""
    base = int(uid.min())
    near = int(uid.max()) - base < 1 << 32
    rows = np.empty(len(sig), _ENTRY if near else _FAR_ENTRY)
    rows["low"] = sig & U(0xFFFFFFFF)
    rows["high"] = ((sig >> U(32)) & U(0x7F)).astype(np.uint8) | (hot.astype(np.uint8) << 7)
    rows["uid"] = uid - base if near else uid
    return dealt(bucket_of(sig, buckets), rows, ENTRIES if near else FAR_ENTRIES, base if near else 0)


def _signature_pass(buckets: int, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries by bucket; of a content that more than HOT rows share here, one row stands for them, and they go as stars."""
        sigs, uids, held = [], [], 0

        def flush():
            nonlocal sigs, uids, held
            if not held:
                return
            sig, uid = np.concatenate(sigs), np.concatenate(uids)
            sigs, uids, held = [], [], 0
            order = np.argsort(sig)
            sig, uid = sig[order], uid[order]
            first = run_starts(sig)
            count = np.diff(np.append(first, len(sig)))
            hot = count > most
            if hot.any():
                lead = np.minimum.reduceat(uid, first)
                member = np.repeat(hot, count)
                rows = np.empty(int(member.sum()), _STAR)
                rows["uid"], rows["lead"] = uid[member], np.repeat(lead, count)[member]
                where = bucket_of(sig[member], buckets)
                rows["hot"] = (where << 39) | (sig[member] & _LOW).astype(np.int64)
                spread = np.sort(bucket_of(mix(uid[member].view(U)), buckets))  # any task may pass them on
                yield dealt(spread, rows, STARS)
                keep = ~member
                keep[first[hot]] = True
                uid[first[hot]] = lead[hot]
                yield _entries(sig[keep], uid[keep], member[keep], buckets)
            else:
                yield _entries(sig, uid, np.zeros(len(sig), bool), buckets)

        for batch in slices(batches):
            ids = batch.column("_uid").to_numpy()
            for uid, s in zip(ids, shingle_sets(batch.column("text"))):
                n = len(s)
                if n == 0 or limit(n) == 0:
                    continue  # linked with equal sets only
                sums = prefix_sums(s)
                for scheme, m, used in schemes_of(n):
                    e = edges_of(s, m, used)
                    full = e[1:] > e[:-1]
                    sig = mix((sums[e[1:]] - sums[e[:-1]] + salts(scheme, m)[:used])[full])
                    sigs.append(sig)
                    uids.append(np.full(len(sig), uid))
                    held += len(sig)
            if held >= FLUSH:
                yield from flush()
        yield from flush()

    return work


def _pairs(a: np.ndarray, b: np.ndarray, hot: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if hot is None else pa.array(hot)], ["a", "b", "hot"])


def _bucket_work(most: int, bucket: int, held: list) -> Iterator[pa.RecordBatch]:
    """(a, b, hot): all pairs of rows that share a content, with hot null; of more than HOT rows a star around the least (that row with itself too), with hot the content's number."""
    sig, uid, known = [], [], []
    for kind, base, payload in held:
        if kind == STARS:
            rows = np.frombuffer(payload, _STAR)
            yield _pairs(rows["uid"].copy(), rows["lead"].copy(), rows["hot"].copy())
            continue
        rows = np.frombuffer(payload, _ENTRY if kind == ENTRIES else _FAR_ENTRY)
        sig.append(rows["low"].astype(np.int64) | ((rows["high"] & 0x7F).astype(np.int64) << 32))
        uid.append(rows["uid"].astype(np.int64) + base)
        known.append(rows["high"] > 0x7F)
    if not sig:
        return
    sig, uid, known = np.concatenate(sig), np.concatenate(uid), np.concatenate(known)
    order = np.argsort(sig)
    sig, uid, known = sig[order], uid[order], known[order]
    first = run_starts(sig)
    count = np.diff(np.append(first, len(sig)))
    hot = (count > most) | np.logical_or.reduceat(known, first)
    if hot.any():
        member = np.repeat(hot, count)
        lead = np.repeat(np.minimum.reduceat(uid, first), count)
        yield _pairs(uid[member], lead[member], (np.int64(bucket) << 39) | sig[member])
    i, j = _triangle(first[~hot], count[~hot], most)
    if len(i):
        yield _pairs(uid[i], uid[j])


# the rare shingles of sets that the first index does not do for ---------------------
_HELD = np.dtype([("sig", "<u8"), ("uid", "<i8"), ("comp", "<i8"), ("hot", "?")])
_FACT = np.dtype([("uid", "<i8"), ("cold", "<i8"), ("h1", "<i8"), ("h2", "<i8")])
_PAIR, _EDGE = np.dtype([("a", "<i8"), ("b", "<i8"), ("common", "<i8")]), np.dtype([("uid", "<i8"), ("lead", "<i8")])
#: What buckets find: facts of sets, pairs of them with what they share, and stars around the least of many; each goes on by its first column, where it is summed up.
FACTS, PAIRS, EDGES = 0, 1, 2
_SUMS = "kind int, a long, b long, c long, d long"


def _facts_of(uid: np.ndarray, sig: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """For each uid: its shingles that are not hot, and two hashes of those that are."""
    order = np.argsort(uid, kind="stable")
    uid, sig, hot = uid[order], sig[order], hot[order]
    first = run_starts(uid)
    out = np.empty(len(first), _FACT)
    if len(first):
        out["uid"] = uid[first]
        out["cold"] = np.add.reduceat((~hot).astype(np.int64), first)
        for name, salt in (("h1", 0x8C4F0D1B53A9E267), ("h2", 0x3B1D9E77C2A64F05)):
            out[name] = np.bitwise_xor.reduceat(np.where(hot, mix(sig ^ U(salt)), U(0)), first).view(np.int64)
    return out


def _onward(rows: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if len(rows):
        bucket = bucket_of(mix(np.ascontiguousarray(rows[rows.dtype.names[0]]).view(U)), buckets)
        order = np.argsort(bucket, kind="stable")
        yield dealt(bucket[order], rows[order], kind)


def _sum_work(_: int, held: list) -> Iterator[pa.RecordBatch]:
    """(FACTS, uid, cold, h1, h2), (PAIRS, a, b, common) and (EDGES, uid, lead), each set, pair and edge of a forest once."""
    def rows_of(kind: int, dtype: np.dtype) -> np.ndarray:
        found = [np.frombuffer(payload, dtype) for k, _, payload in held if k == kind]
        return np.concatenate(found) if found else np.zeros(0, dtype)

    def batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        filled = [np.ascontiguousarray(c) for c in columns] + [np.zeros(n, np.int64)] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, filled)], ["kind", "a", "b", "c", "d"])

    facts = rows_of(FACTS, _FACT)
    if len(facts):
        facts = facts[np.argsort(facts["uid"], kind="stable")]
        first = run_starts(facts["uid"])
        yield batch(FACTS, facts["uid"][first], np.add.reduceat(facts["cold"], first), *(np.bitwise_xor.reduceat(facts[h], first) for h in ("h1", "h2")))
    pairs = rows_of(PAIRS, _PAIR)
    if len(pairs):
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        first = np.flatnonzero(np.concatenate(([True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1]))))
        yield batch(PAIRS, pairs["a"][first], pairs["b"][first], np.add.reduceat(pairs["common"], first))
    edges = rows_of(EDGES, _EDGE)
    if len(edges):
        ids, root = forest(edges["uid"], edges["lead"])
        yield batch(EDGES, ids[ids != root], root[ids != root])


def _shingle_pass(buckets: int, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles by bucket; one that more than HOT sets have here is settled here but for a mark."""
        sigs, uids, comps, held = [], [], [], 0

        def flush():
            nonlocal sigs, uids, comps, held
            if not held:
                return
            rows = np.zeros(held, _HELD)
            rows["sig"], rows["uid"], rows["comp"] = np.concatenate(sigs), np.concatenate(uids), np.concatenate(comps)
            sigs, uids, comps, held = [], [], [], 0
            rows = rows[np.argsort(rows["sig"])]
            first = run_starts(rows["sig"])
            count = np.diff(np.append(first, len(rows)))
            many = count > most
            if many.any():
                member = np.repeat(many, count)
                facts = _facts_of(rows["uid"][member], rows["sig"][member], np.ones(int(member.sum()), bool))
                spread = bucket_of(mix(facts["uid"].view(U)), buckets)
                order = np.argsort(spread)
                yield dealt(spread[order], facts[order], 1)
                keep = ~member
                keep[first[many]] = True
                rows["hot"] = member
                rows = rows[keep]
            yield dealt(bucket_of(rows["sig"], buckets), rows)

        for batch in slices(batches):
            for uid, comp, s in zip(batch.column("_uid").to_pylist(), batch.column("comp").to_pylist(), shingle_sets(batch.column("text"))):
                sigs.append(s)
                uids.append(np.full(len(s), uid))
                comps.append(np.full(len(s), comp))
                held += len(s)
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return work


def _shingle_work(most: int, buckets: int, _bucket: int, held: list) -> Iterator[pa.RecordBatch]:
    """Facts of sets as far as this bucket goes, and pairs of rows of two components with their common cold shingles."""
    for kind, _, payload in held:
        if kind == 1:
            yield from _onward(np.frombuffer(payload, _FACT), FACTS, buckets)
    rows = [np.frombuffer(payload, _HELD) for kind, _, payload in held if kind == 0]
    if not rows:
        return
    rows = np.concatenate(rows)
    rows = rows[np.argsort(rows["sig"])]
    first = run_starts(rows["sig"])
    count = np.diff(np.append(first, len(rows)))
    hot = (count > most) | np.logical_or.reduceat(rows["hot"], first)
    real = ~rows["hot"]  # a mark is no set's shingle
    yield from _onward(_facts_of(rows["uid"][real], rows["sig"][real], np.repeat(hot, count)[real]), FACTS, buckets)
    i, j = _triangle(first[~hot], count[~hot], most)
    apart = rows["comp"][i] != rows["comp"][j]
    yield from _onward(_paired(rows["uid"][i[apart]], rows["uid"][j[apart]]), PAIRS, buckets)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each pair once, the lesser first, with how often it is met."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    at = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(low) else np.zeros(0, np.int64)
    out = np.empty(len(at), _PAIR)
    out["a"], out["b"], out["common"] = low[at], high[at], np.diff(np.append(at, len(low)))
    return out


# the second index: large segments with one deletion ---------------------------------
_LARGE = np.dtype([("sig", "<u8"), ("uid", "<i8"), ("comp", "<i8"), ("n", "<i8"), ("whole", "?"), ("hot", "?")])


def _large_signatures(s: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Contents of large segments and of those less one entry, and of sets of at most ``upto`` the first shingles; whether each is whole."""
    n, sig, whole = len(s), [np.zeros(0, U)], [np.zeros(0, bool)]
    if n > SMALL:
        sums, each = prefix_sums(s), mix(s + U(0x632BE59BD9B4E019))
        for scheme, m, used in large_schemes(n):
            e = edges_of(s, m, used)
            size = np.diff(e)
            total = sums[e[1:]] - sums[e[:-1]] + salts(1000 + scheme, m)[:used]
            sig.append(mix(total[size > 0]))
            whole.append(np.ones(len(sig[-1]), bool))
            sig.append(mix((np.repeat(total, size) - each[e[0] : e[-1]])[np.repeat(size > 1, size)]))
            whole.append(np.zeros(len(sig[-1]), bool))
    if n <= upto:
        sig.append(mix(s[: n - (3 * n + 3) // 4 + 1] + U(0x51ED270B)))
        whole.append(np.ones(len(sig[-1]), bool))
    return np.concatenate(sig), np.concatenate(whole)


def _stars_of(uid: np.ndarray, first: np.ndarray, count: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Edges that join the rows of each run that is hot."""
    member = np.repeat(hot, count)
    ids, root = forest(uid[member], np.repeat(np.minimum.reduceat(uid, first), count)[member])
    out = np.empty(len(ids), _EDGE)  # a least row with itself too, as the group may have met it just here
    out["uid"], out["lead"] = ids, root
    return out


def _second_pass(buckets: int, upto: int, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contents by bucket; of one that more than HOT rows share here one row goes on, marked, and the stars."""
        made, held = [], 0

        def flush():
            nonlocal made, held
            if not held:
                return
            rows = np.concatenate(made)
            made, held = [], 0
            rows = rows[np.argsort(rows["sig"])]
            first = run_starts(rows["sig"])
            count = np.diff(np.append(first, len(rows)))
            hot = count > most
            if hot.any():
                yield from _onward(_stars_of(rows["uid"], first, count, hot), 1, buckets)
                whole, least = np.logical_or.reduceat(rows["whole"], first), np.minimum.reduceat(rows["uid"], first)
                keep = ~np.repeat(hot, count)
                keep[first[hot]] = True
                rows["hot"] = np.repeat(hot, count)
                rows["whole"][first[hot]], rows["uid"][first[hot]] = whole[hot], least[hot]
                rows = rows[keep]
            yield dealt(bucket_of(rows["sig"], buckets), rows)

        for batch in slices(batches):
            for uid, comp, s in zip(batch.column("_uid").to_pylist(), batch.column("comp").to_pylist(), shingle_sets(batch.column("text"))):
                if limit(len(s)) == 0:
                    continue
                sig, whole = _large_signatures(s, upto)
                rows = np.zeros(len(sig), _LARGE)
                rows["sig"], rows["whole"], rows["uid"], rows["comp"], rows["n"] = sig, whole, uid, comp, len(s)
                made.append(rows)
                held += len(rows)
                if held >= FLUSH // 2:
                    yield from flush()
        yield from flush()

    return work


def _second_work(most: int, buckets: int, _bucket: int, held: list) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of two components that share a content which is whole in one of them; stars where more than HOT rows share it."""
    rows = []
    for kind, _, payload in held:
        if kind == 1:
            yield from _onward(np.frombuffer(payload, _EDGE), EDGES, buckets)
        else:
            rows.append(np.frombuffer(payload, _LARGE))
    if not rows:
        return
    rows = np.concatenate(rows)
    rows = rows[np.argsort(rows["sig"])]
    first = run_starts(rows["sig"])
    count = np.diff(np.append(first, len(rows)))
    marked = np.logical_or.reduceat(rows["hot"], first)
    some = np.logical_or.reduceat(rows["whole"], first) & (marked | (np.minimum.reduceat(rows["comp"], first) != np.maximum.reduceat(rows["comp"], first)))
    hot = (count > most) | marked
    if (hot & some).any():
        yield from _onward(_stars_of(rows["uid"], first, count, hot & some), EDGES, buckets)
    plain = ~hot & some
    i, j = _triangle(first[plain], count[plain], most)
    a, b = rows[i], rows[j]
    ok = (a["comp"] != b["comp"]) & (a["whole"] | b["whole"]) & (3 * np.maximum(a["n"], b["n"]) <= 4 * np.minimum(a["n"], b["n"]))
    yield from _onward(_paired(a["uid"][ok], b["uid"][ok]), PAIRS, buckets)


# sets that share hot contents: parity bitmaps ---------------------------------------
def parity(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the shingles fall on i; about eight bits for each shingle. The bitmaps of two
    sets differ in at most as many bits as the sets do in shingles, whether whole or folded."""
    bits = 8 * max(8, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint64)
    while 8 * len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def size_band(n: int) -> int:
    """Sets that may link lie in one band or in adjacent ones."""
    return int(np.searchsorted(band_ends(4, 3), n))


def _bitmap_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("_uid"), pa.array([size_band(len(s)) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary())], ["_uid", "band", "bits"])


def close_pairs(left: list[dict], right: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in left and in right (or both in left) of pairs whose bitmaps let them link, and how near to the bound they are; not two satellites, not of one component."""
    other = left if right is None else right
    size = min(len(r["bits"]) for x in (left, other) for r in x)
    n, comp, cold, kind = (np.array([r[c] for r in other], np.int64) for c in ("n", "comp", "cold", "satellite"))
    bits = np.stack([fold(r["bits"], size) for r in other])
    a, b, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, r in enumerate(left):
        most = (n + r["n"]) // 7
        ok = (comp != r["comp"]) & (3 * np.maximum(n, r["n"]) <= 4 * np.minimum(n, r["n"])) & (cold + r["cold"] <= most)
        if r["satellite"]:
            ok &= kind == 0
        if right is None:
            ok[: k + 1] = False
        at = np.flatnonzero(ok)
        if len(at):
            apart = np.bitwise_count(bits[at] ^ fold(r["bits"], size)).sum(1, dtype=np.int64)
            good = apart <= most[at]
            a.append(np.full(int(good.sum()), k))
            b.append(at[good])
            near.append(apart[good] / np.maximum(most[at][good], 1))
    return np.concatenate(a), np.concatenate(b), np.concatenate(near)


def spanning(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of edges x-y that join all that the edges join, those of the least weight first."""
    _, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = place[: len(x)], place[len(x) :]
    root, kept, rest = list(range(int(place.max()) + 1 if len(place) else 0)), [], np.argsort(weight, kind="stable")
    while len(rest):
        for k in rest[:4096].tolist():
            u, v = int(a[k]), int(b[k])
            while root[u] != u:
                root[u] = u = root[root[u]]
            while root[v] != v:
                root[v] = v = root[root[v]]
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append(k)
        now = np.array(root)
        while (now[now] != now).any():
            now = now[now]
        root, rest = now.tolist(), rest[4096:]
        rest = rest[now[a[rest]] != now[b[rest]]]
    return np.array(sorted(kept), np.int64)


def _tile_pass(forest: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (tile, side) -> pairs (a, b); side 0 meets side 1, side 2 meets itself. With ``forest`` just those that join all the components that a tile's pairs join, the nearest first."""
        now, held = None, []

        def done():
            sides = [[r for r in held if r["side"] == k] for k in (0, 1, 2)]
            for x, y in ((sides[0], sides[1]), (sides[2], None)):
                if x and (y is None or y):
                    a, b, near = close_pairs(x, y)
                    column = lambda rows, c, at: np.array([r[c] for r in rows], np.int64)[at]
                    z = x if y is None else y
                    if forest:
                        at = spanning(column(x, "comp", a), column(z, "comp", b), near)
                        a, b = a[at], b[at]
                    a, b = column(x, "uid", a), column(z, "uid", b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["tile"] != now:
                    if held:
                        yield from done()
                    now, held = r["tile"], []
                held.append(r)
        if held:
            yield from done()
        give_back()

    return work


def _tiles(rows: DataFrame, scratch: Scratch, forest: bool) -> DataFrame:
    """Pairs (a, b) that may link, of rows (_uid, grp, band, n, cold, comp, satellite, bits).

    The rows of a group are dealt by size band and at random into blocks of bounded bytes; block meets block in one task's
    memory. The component with the most rows of a group is not met with itself, nor are satellites with each other, so the
    work is (rows outside that component) x (leads of the group).
    """
    main = rows.groupBy("grp", "comp").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max(F.struct("k", "comp")).alias("m")).select("grp", F.col("m.comp").alias("main"))
    rows = rows.join(main, "grp").withColumn("kind", F.col("satellite") * 2 + (F.col("comp") == F.col("main")).cast("int")).drop("main")
    subs = scratch.table(rows.groupBy("grp", "band", "kind").agg(F.ceil(F.sum(F.length("bits") + 512) / TILE_BYTES).alias("blocks")), "blocks")
    met = subs.join(subs.toDF("grp", "band2", "kind2", "blocks2"), "grp").where("abs(band - band2) <= 1 and not (kind >= 2 and kind2 >= 2) and not (kind % 2 = 1 and kind2 % 2 = 1)")
    cells = rows.join(scratch.table(met, "meetings"), ["grp", "band", "kind"]).withColumn("i", F.pmod(F.xxhash64("_uid", F.lit("block")), "blocks"))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks2") - F.lit(1).cast("long"))))
    own, far = F.struct("band", "kind", "i"), F.struct(F.col("band2").alias("band"), F.col("kind2").alias("kind"), F.col("j").alias("i"))
    cells = cells.withColumn("tile", F.xxhash64("grp", F.least(own, far), F.greatest(own, far))).withColumn("side", F.when(own == far, 2).when(own < far, 0).otherwise(1))
    cells = cells.select("tile", "side", F.col("_uid").alias("uid"), "n", "comp", "cold", "satellite", "bits")
    return scratch.table(cells.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_tile_pass(forest), "a long, b long"), "close").distinct()


def grouped_links(entities: DataFrame, stars: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join all that links join among entities (_uid, n, cold, comp, satellite) of one group.

    Linked entities of a hot content are in one component of the stars, a group. Bitmaps tell
    nearly exactly whether two sets may link; so first the nearest pairs that would join the components are
    verified, and then all that may still join two, which are few: no more than is near the bound of similarity.
    """
    groups = components(stars, scratch).toDF("_uid", "grp")
    rows = scratch.table(entities.join(groups, "_uid"), "grouped")
    bitmaps = filter_by(texts, rows.select("_uid"), "left_semi").mapInArrow(_bitmap_pass, "_uid long, band int, bits binary")
    rows = scratch.table(rows.join(bitmaps, "_uid"), "bitmaps")
    first = verified(scratch.table(_tiles(rows, scratch, True), "nearest"), texts, scratch)
    if not first.take(1):
        return verified(scratch.table(_tiles(rows, scratch, False), "rest"), texts, scratch)
    joined = components(rows.select(F.col("_uid").alias("a"), F.col("comp").alias("b")).unionByName(first), scratch)
    rows = scratch.table(rows.join(joined, "_uid", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"), "joined")
    return first.unionByName(verified(scratch.table(_tiles(rows, scratch, False), "rest"), texts, scratch))


def _verify_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "text_a"), "text_b"):
        ok = []
        for x, y in zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b"))):
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            ok.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
        ok = np.array(ok, bool)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("a").to_numpy()[ok]), pa.array(batch.column("b").to_numpy()[ok])], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The linked ones of pairs (a, b); texts: (_uid, text) of all rows. Each text goes once to each of its pairs."""
    need = scratch.table(pairs.select(F.col("a").alias("_uid")).union(pairs.select("b")).distinct(), "need")
    some = filter_by(texts, need, "left_semi")
    left = pairs.join(some.select(F.col("_uid").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(some.select(F.col("_uid").alias("b"), F.col("text").alias("text_b")), "b")
    return scratch.table(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify_pass, "a long, b long"), "links")


def _limit_sql(n: str) -> str:
    return f"(({n} + 4 * {n} div 3) div 7)"


def _slack_sql(n: str) -> str:
    return f"((45 * ({_limit_sql(n)} + 1) + 99) div 100 + 1)"


def _loose_links(texts: DataFrame, loose: DataFrame, scratch: Scratch, hot: int) -> DataFrame:
    """Links (a, b) that join components among sets that frequent segments dominate; loose: (_uid, n, comp, unsafe).

    Shingles that up to HOT of these sets hold are cold. Two linked sets R and S with c(R) and c(S) cold shingles share at
    least (c(R) + c(S) - H) / 2 of them; their common cold shingles are counted, which finds all links with a
    common cold shingle. A link without one rests on hot shingles alone, of which R and S each have 3/4 of their size at least. Such sets
    with equal hot parts form a class, with the smallest as its lead: no pair of members of two classes (or one) can be
    more similar by hot shingles than the two leads, or than one member and the other's lead. So of a link R-S the links of R with S's
    lead, of S with R's lead, and between the leads hold too, and these join R and S. Hence leads meet leads, and
    satellites - members that lie in another component than their lead - meet leads, if in different components.
    Those meetings are found by large segments with their one-deletion neighbourhoods; contents that more than HOT share make groups instead.
    """
    wanted = scratch.table(filter_by(texts, loose.select("_uid"), "left_semi").join(loose.select("_uid", "comp"), "_uid").select("_uid", "comp", "text"), "wanted")
    parts = buckets_for(loose.agg(F.sum("n")).first()[0] or 0, texts)
    index = in_buckets(wanted.mapInArrow(_shingle_pass(parts, hot), DEALT), parts, partial(_shingle_work, hot, parts), DEALT)
    index = scratch.table(in_buckets(index, parts, _sum_work, _SUMS), "parts")
    facts = index.where(f"kind = {FACTS}").select(F.col("a").alias("_uid"), F.col("b").alias("cold"), F.col("c").alias("h1"), F.col("d").alias("h2"))
    facts = scratch.table(facts.join(loose, "_uid"), "cold")
    met = index.where(f"kind = {PAIRS}").select("a", "b", F.col("c").alias("common"))
    met = met.join(facts.select(F.col("_uid").alias("a"), F.col("n").alias("na"), F.col("cold").alias("ka")), "a").join(facts.select(F.col("_uid").alias("b"), F.col("n").alias("nb"), F.col("cold").alias("kb")), "b")
    met = scratch.table(met.where("3 * greatest(na, nb) <= 4 * least(na, nb) and 2 * common >= ka + kb - (na + nb) div 7").select("a", "b"), "met")
    scratch.drop(index)

    filled = facts.where("4 * cold <= n")
    lead = filled.groupBy("h1", "h2").agg(F.min(F.struct("n", "_uid", "comp")).alias("m"))
    of_class = filled.join(lead, ["h1", "h2"]).withColumn("satellite", (F.col("_uid") != F.col("m._uid")).cast("int")).where("satellite = 0 or comp <> m.comp")
    entities = scratch.table(of_class.select("_uid", "n", "cold", "comp", "satellite", "unsafe"), "entities")
    scratch.drop(facts)
    total, unsafe = entities.agg(F.sum("n"), F.max(F.when(F.col("unsafe"), F.col("n")))).first()
    if not total:
        return verified(met, wanted.select("_uid", "text"), scratch)
    upto, parts = max(SMALL, unsafe or 0) * 4 // 3, buckets_for(3 * total, texts)
    some = filter_by(wanted.select("_uid", "text"), entities.select("_uid"), "left_semi").join(entities.select("_uid", "comp"), "_uid")
    second = in_buckets(some.mapInArrow(_second_pass(parts, upto, hot), DEALT), parts, partial(_second_work, hot, parts), DEALT)
    second = scratch.table(in_buckets(second, parts, _sum_work, _SUMS), "second")
    side = lambda x: entities.select(F.col("_uid").alias(x), F.col("cold").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("satellite").alias(f"s{x}"))
    near = second.where(f"kind = {PAIRS}").select("a", "b").join(side("a"), "a").join(side("b"), "b").where("ka + kb <= (na + nb) div 7 and sa + sb < 2").select("a", "b")
    links = verified(scratch.table(met.unionByName(near).distinct(), "few"), wanted.select("_uid", "text"), scratch)
    stars = second.where(f"kind = {EDGES}").select("a", "b")
    if stars.take(1):
        links = scratch.table(links.unionByName(grouped_links(entities.drop("unsafe"), stars, wanted.select("_uid", "text"), scratch)), "loose")
    scratch.drop(wanted, second, met)
    return links


def similar_sets(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs (with ``_uid``) -> (_uid, n_shingles, root): rows with one root are joined by links; root is the least _uid.

    A text (null: empty) is lower-cased over A-Z and cut into words; its set has its
    distinct runs of five words, or with fewer words the whole sequence. Two rows
    link when the intersection is at least 3/4 of the union. A text without
    words links with nothing. Equal sets are one vertex from the start. An empty
    table gives an empty table; no other column is read.
    """
    texts = docs.select("_uid", F.coalesce(text_col, F.lit("")).alias("text"))
    sets = scratch.table(texts.mapInArrow(_sets_pass, "_uid long, n long, fp1 long, fp2 long, empty_own int, empty_most int, unsafe boolean"), "sets")
    classes = sets.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("_uid").alias("rep"), F.count("*").alias("copies"))
    known = scratch.table(sets.where("n > 0").join(classes, ["n", "fp1", "fp2"]).select("_uid", "rep"), "classes")
    copies = known.where("_uid <> rep").select("_uid")
    single = filter_by(texts, copies, "left_anti")
    entries = sets.where("n > 0").agg(F.sum("n")).first()[0] or 0
    parts = buckets_for(entries * 6 // 10, docs)
    raw = scratch.table(in_buckets(single.mapInArrow(_signature_pass(parts, hot), DEALT), parts, partial(_bucket_work, hot), "a long, b long, hot long"), "pairs")
    scratch.tidy()

    skipped = raw.where("hot is not null").groupBy(F.col("a").alias("_uid")).agg(F.count("*").alias("hot"))
    facts = sets.where(f"n > 0 and {_limit_sql('n')} > 0").join(copies, "_uid", "left_anti").join(skipped, "_uid", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    facts = scratch.table(facts.select("_uid", "n", "empty_own", "empty_most", "hot", "unsafe"), "facts")
    thin = facts.select("_uid", "n", (F.col("empty_own") + F.col("hot")).alias("skipped"))
    merged = raw.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count_if(F.col("hot").isNull()).alias("plain"), F.count("*").alias("common"))
    sized = merged.join(thin.toDF("a", "na", "ea"), "a").join(thin.toDF("b", "nb", "eb"), "b").withColumn("r", F.least("na", "nb")).where("3 * greatest(na, nb) <= 4 * r")
    sized = sized.withColumn("asked", F.expr(f"{_slack_sql('r')} + 1 - if(na <= nb, ea, eb)")).withColumn("asked", F.when(F.col("na") == F.col("nb"), F.least("asked", F.expr(f"{_slack_sql('r')} + 1 - eb"))).otherwise(F.col("asked")))
    sized = sized.withColumn("sure", (F.col("plain") >= 1) & (F.col("plain") >= F.col("asked")))
    sized = scratch.table(sized.where(f"sure or 2 * common > {_slack_sql('r')}").select("a", "b", "common", "sure"), "candidates")
    stars = scratch.table(raw.where("hot is not null").select(F.col("a").alias("_uid"), "hot"), "hot")
    scratch.drop(raw)

    # first the likeliest partner of each row and the stars, then what these leave in different components
    best = sized.groupBy(F.col("b").alias("x")).agg(F.max(F.struct("common", F.col("a").alias("y"))).alias("m")).select(F.col("m.y").alias("a"), F.col("x").alias("b"))
    best = best.unionByName(sized.groupBy("a").agg(F.max(F.struct("common", "b")).alias("m")).select("a", F.col("m.b").alias("b"))).distinct()
    links = verified(scratch.table(best, "best"), texts, scratch)
    roots = components(links, scratch)
    comp = scratch.table(facts.select("_uid", "n", "empty_most", "unsafe").join(roots, "_uid", "left").withColumn("comp", F.coalesce("root", "_uid")).drop("root"), "comp")
    of = comp.select("_uid", "comp")
    left = sized.where("sure").select("a", "b").join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").where("ca <> cb").select("a", "b")
    # a hot bucket within one component has no more to give
    stars = stars.join(of, "_uid")
    apart = stars.groupBy("hot").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("hot")
    skipped = stars.join(scratch.table(apart, "apart"), "hot", "left_semi").groupBy("_uid").agg(F.count("*").alias("hot"))
    loose = scratch.table(comp.join(skipped, "_uid", "left").where(f"coalesce(hot, 0) + empty_most >= {_slack_sql('((3 * n + 3) div 4)')} + 1"), "loose")
    scratch.tidy()
    left = scratch.table(left.distinct(), "left")
    more = verified(left, texts, scratch) if left.take(1) else None
    if loose.take(1):
        found = _loose_links(texts, loose, scratch, hot)
        more = found if more is None else more.unionByName(found)
    if more is not None:
        roots = components(roots.select(F.col("_uid").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)
    scratch.drop(facts, sized)
    full = sets.select("_uid", "n").join(known, "_uid", "left").withColumn("rep", F.coalesce("rep", "_uid"))
    return full.join(roots.toDF("rep", "root"), "rep", "left").select("_uid", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("root"))


def near_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_shingles, component_id (least id of the component) for each row of docs."""
    docs = rows_with_uid(docs, scratch, id_col)
    joined = scratch.table(similar_sets(docs, scratch, id_col, text_col, hot).join(docs.select("_uid", F.col(id_col)), "_uid"), "joined")
    least = joined.groupBy("root").agg(F.min(id_col).alias("component_id"))
    return joined.join(least, "root").select(id_col, "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of the least id of each component only; the columns stay.

    Texts without words (null, empty, white space) link with nothing, so all of them stay. Rows with repeated or null ids are rows of their
    own, the first as numbered stays. An empty table gives an empty table.
    """
    docs, back = own_uid_aside(docs)
    docs = rows_with_uid(docs, scratch, id_col)
    gone = similar_sets(docs, scratch, id_col, text_col).where("_uid <> root").select("_uid")
    return back(filter_by(docs, scratch.table(gone, "gone"), "left_anti"))
