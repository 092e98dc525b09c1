"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labels import fold, labelled, sample, sigmoid
from .repetition import _SYMBOL, _sum_by, repeated_lines, repeated_windows
from .store import Scratch
from .text import IS_SPACE, U, Words, mix, run_starts, slices, text_bytes

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 120, 4, 64, 0.1, 2.0, 3.0
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _STOP, _COMMA, _LOUD, _PIPE = (_flags(x) for x in (bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!?", b"|"))
_ALPHA = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
FEATURES = (
    "log_words log_chars mean_word sd_word longest_word symbols upper digits stops commas loud pipes beyond_ascii spaces newlines "
    "dup_lines repeat3 repeat5 distinct top_word short_words bare_words loud_words stop_words capital_words symbol_words entropy words_a_line last_stop"
).split()


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = text_bytes(column)
    words = Words(data, offsets)
    n_texts, b = len(offsets) - 1, words.bounds
    owner = np.repeat(np.arange(n_texts), np.diff(b))
    n = np.diff(b).astype(float)
    some, chars = np.maximum(n, 1), np.maximum(np.diff(offsets).astype(float), 1)
    size = (words.ends - words.starts).astype(float)
    per = lambda w: np.bincount(owner, w, n_texts)
    mean = per(size) / some
    count = lambda flags: _sum_by(flags[data], offsets) / chars
    last = data[words.ends - 1] if len(owner) else np.zeros(0, np.uint8)
    head = data[words.starts] if len(owner) else np.zeros(0, np.uint8)
    within = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags[data])))[np.stack((words.starts, words.ends), 1)], axis=1)[:, 0] if len(owner) else np.zeros(0)
    letters, upper, symbols = within(_ALPHA), within(_UPPER), within(_SYMBOL)
    longest = np.zeros(n_texts)
    np.maximum.at(longest, owner, size)
    # distinct words and the most frequent one
    key = mix(words.hashes + owner.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    first = run_starts(key[order])
    times = np.diff(np.append(first, len(order)))
    who = owner[order[first]]
    top = np.zeros(n_texts)
    np.maximum.at(top, who, times.astype(float))
    lines = np.maximum(_sum_by(data == 10, offsets) + 1, 1).astype(float)
    bytes_by = np.bincount(np.repeat(np.arange(n_texts), np.diff(offsets)) * 256 + data, minlength=n_texts * 256).reshape(n_texts, 256) / chars[:, None]
    entropy = -(bytes_by * np.log2(np.maximum(bytes_by, 1e-12))).sum(1)
    ends_well = np.zeros(n_texts)
    full = np.flatnonzero(n > 0)
    ends_well[full] = _STOP[last[b[full + 1] - 1]]
    columns = [
        np.log1p(n), np.log1p(chars), mean, np.sqrt(np.maximum(per(size**2) / some - mean**2, 0)), np.log1p(longest),
        count(_SYMBOL), count(_UPPER), count(_DIGIT), count(_STOP), count(_COMMA), count(_LOUD), count(_PIPE),
        _sum_by(data >= 0x80, offsets) / chars, _sum_by(IS_SPACE[data], offsets) / chars, _sum_by(data == 10, offsets) / some,
        repeated_lines(data, offsets) / lines, repeated_windows(words.hashes, b, 3)[0] / some, repeated_windows(words.hashes, b, 5)[0] / some,
        np.bincount(who, minlength=n_texts) / some, top / some, per((size <= 3).astype(float)) / some, per((letters == 0).astype(float)) / some,
        per(((upper == letters) & (letters > 1)).astype(float)) / some, per(_STOP[last].astype(float)) / some, per(_UPPER[head].astype(float)) / some, per((symbols > 0).astype(float)) / some,
        entropy, n / lines, ends_well,
    ]
    return np.stack(columns, 1).astype(np.float32)


class Trees:
    """Boosted trees of equal depth in arrays: node i of a tree has the children 2i+1 and 2i+2."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.cut, self.value, self.start = feature, cut, value, start

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All trees of all rows step down one level at a time."""
        tree = np.arange(len(self.feature))
        node = np.zeros((len(x), len(tree)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.start + self.value[tree, node - (2**DEPTH - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting on the logistic loss; splits from sums of gradients by bin."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((1, inner), np.int64), np.zeros((1, inner), np.float32), np.zeros((1, leaves)), start)
    cuts = [np.sort(np.array(sorted(set(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower").tolist())), np.float32)) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    f = x.shape[1]
    slot = bins + np.arange(f) * BINS
    margin = np.full(len(y), start)
    features, values, thresholds = [], [], []
    for _ in range(TREES):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width = 2**level
            at = (node[:, None] * (f * BINS) + slot).ravel()
            gs = np.bincount(at, np.repeat(g, f), width * f * BINS).reshape(width, f, BINS).cumsum(2)
            hs = np.bincount(at, np.repeat(h, f), width * f * BINS).reshape(width, f, BINS).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((hs >= LEAST_HESSIAN) & (ht - hs >= LEAST_HESSIAN), gain, -np.inf).reshape(width, -1)
            best = gain.argmax(1)
            go = np.full(width, BINS)
            for k in range(width):
                if gain[k, best[k]] > 1e-6:
                    j, c = divmod(int(best[k]), BINS)
                    feature[width - 1 + k], cut[width - 1 + k], go[k] = j, cuts[j][c], c
            node = 2 * node + (bins[np.arange(len(y)), feature[width - 1 + node]] > go[node])
        value = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
        margin += value[node]
        features.append(feature)
        thresholds.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Trees:
    """A model from at most ``bound`` labelled rows outside the held-out fold; their statistics, some 30 numbers each, come to the driver."""
    rows = labelled(docs, sample(labels, "quality", FOLDS, HELD_OUT, bound, id_col), scratch, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["label", "x"])

    got = rows.mapInArrow(work, "label int, x array<float>").toArrow().combine_chunks()
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for each row of docs.

    A score depends on the text alone, so nothing is shuffled. A null text is empty; an empty text gets the score of its
    statistics like any other. An empty table gives an empty table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(statistics(batch.column("text"))), pa.float64())], [id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, F.coalesce(fold(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; the columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(shared.value.score(statistics(batch.column(text_col))) >= THRESHOLD))

    return docs.mapInArrow(work, docs.schema)
