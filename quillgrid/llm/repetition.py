"""Quality rules on repetition, by suffix arrays over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import IS_SPACE, U, Words, mix, powers, run_starts, slices, span_hashes, text_bytes, window_hashes

#: Repeats of fewer words are ordinary phrases and are left out of account.
LEAST_REPEAT = 10
#: Greatest share (in percent) of a text's words within repeats, and of its longest repeat.
MOST_COVERED, MOST_LONGEST = 15, 10
#: A longest repeat of fewer words than this is no fault, however short the text.
LONG_REPEAT = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_array(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of several texts in an order that brings equal beginnings of one text together, and the lcp of neighbours (0 between texts).

    hashes and owner: of each word. Prefix doubling: the rank by the first 2h words
    comes from the ranks by h words of a suffix and of the one h words on; only suffixes
    whose rank is still shared are sorted again. The lcp comes by binary descent over the sizes that the rounds
    met, on hashes of runs of words from one prefix sum, so memory is in proportion to the words.
    """
    n = len(hashes)
    key = mix(hashes + owner.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    lead = run_starts(key[order])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(lead, np.diff(np.append(lead, n)))
    h = 1
    places = np.arange(n)
    shared = np.repeat(np.diff(np.append(lead, n)) > 1, np.diff(np.append(lead, n)))
    while shared.any():
        seat = places[shared]  # seats in the order that are not settled
        live = order[seat]
        ahead = np.minimum(live + h, n)
        follow = np.where((ahead < n) & (owner[np.minimum(ahead, n - 1)] == owner[live]), rank[ahead], -1)
        key = rank[live] * (n + 1) + follow + 1
        by = np.argsort(key)
        live, key = live[by], key[by]
        order[seat] = live
        lead = run_starts(key)
        size = np.diff(np.append(lead, len(key)))
        rank[live] = np.repeat(seat[lead], size)
        places, shared = seat, np.repeat(size > 1, size)
        h *= 2
    # neighbours share fewer than 2 * h words now
    pw, inv = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(hashes * pw[:n], out=total[1:])
    text_end = np.append(np.searchsorted(owner, owner, "right"), n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    alike = owner[a] == owner[b]
    left = np.minimum(text_end[a] - a, text_end[b] - b)  # words that both have left
    live = np.flatnonzero(alike)
    while h:
        live_a, live_b = a[live], b[live]
        fits = left[live] >= h
        x, y = live_a[fits], live_b[fits]
        same = (total[x + h] - total[x]) * inv[x] == (total[y + h] - total[y]) * inv[y]
        go = live[fits][same]
        lcp[go + 1] += h
        a[go] += h
        b[go] += h
        left[go] -= h
        h //= 2
    return order, lcp


def repeats_in(hashes: np.ndarray, bounds: np.ndarray, least: int = LEAST_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Words within repeated runs of at least ``least`` words, and the longest repeated run, of each text.

    An lcp of neighbours of at least ``least`` spans a repeated run at both; these spans together are those of
    all maximal repeats, as every suffix has its longest match beside it.
    """
    n_texts = len(bounds) - 1
    covered, longest = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    if len(hashes) == 0:
        return covered, longest
    owner = np.repeat(np.arange(n_texts), np.diff(bounds))
    order, lcp = suffix_array(hashes, owner)
    most = np.maximum(lcp, np.append(lcp[1:], 0))
    np.maximum.at(longest, owner[order], most)
    long_ = most >= least
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, order[long_], 1)
    np.add.at(cover, order[long_] + most[long_], -1)
    covered += np.bincount(owner, np.cumsum(cover)[:-1] > 0, n_texts).astype(np.int64)
    return covered, longest


def repeated_windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Words within windows of k words that a text has twice or more."""
    n = np.maximum(np.diff(bounds) - k + 1, 0)
    if not n.any():
        return np.zeros(len(n), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    key = mix(window_hashes(hashes, k)[at] + owner.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    first = run_starts(key[order])
    count = np.diff(np.append(first, len(order)))
    twice = order[np.repeat(count > 1, count)]
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[at[twice]] += 1  # one window begins at a place
    cover = np.cumsum(cover)
    within = cover[:-1] - np.concatenate((np.zeros(min(k, len(hashes)), np.int64), cover[: len(hashes) - k]))[: len(hashes)] > 0
    total = np.concatenate(([0], np.cumsum(within)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _sum_by(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines (between newlines) with a word that equal an earlier line of their text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(data) == 0:
        return out
    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], newline + 1)))
    ends = np.sort(np.concatenate((offsets[1:], newline)))
    total = np.concatenate(([0], np.cumsum(~IS_SPACE[data])))
    keep = (ends > starts) & (total[ends] > total[np.minimum(starts, len(data))])
    starts, ends = starts[keep], ends[keep]
    owner = np.searchsorted(offsets, starts, "right") - 1
    key = mix(span_hashes(data, starts, ends) + owner.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    first = run_starts(key[order])
    count = np.diff(np.append(first, len(order)))
    np.add.at(out, owner[order[first]], count - 1)
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = text_bytes(column)
    words = Words(data, offsets)
    n = words.counts().astype(np.int64)
    repeat = repeated_windows(words.hashes, words.bounds, 5)
    covered, longest = repeats_in(words.hashes, words.bounds)
    base = (n < 10) | (100 * repeat > 20 * n)
    fault = (100 * covered > MOST_COVERED * n) | ((longest >= LONG_REPEAT) & (100 * longest > MOST_LONGEST * n))
    return {
        "n_words": n,
        "word_chars": _sum_by(((data & 0xC0) != 0x80) & ~IS_SPACE[data], offsets),
        "n_symbols": _sum_by(_SYMBOL[data], offsets),
        "n_dup_lines": repeated_lines(data, offsets),
        "n_repeat_words": repeat,
        "base_failed": base,
        "kept": ~base & ~fault,
        "covered_words": covered,
        "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and measures of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, longest_repeat.

    Each row is judged for itself, so nothing is shuffled. A null text has no words and fails
    the base rule. Repeated rows are judged alike; an empty table gives an empty table; no other column is read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], [id_col, *found])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(
        work, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
    )
