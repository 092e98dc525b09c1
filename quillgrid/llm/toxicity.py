"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labels import fold, sample, sigmoid
from .store import Scratch
from .text import U, Words, give_back, mix, run_starts, slices, text_bytes

#: Labelled rows that the model is fitted on, at most, and bytes of all their texts, which are used whole.
SAMPLE, TRAIN_BYTES = 5_000, 32 << 20
#: Words of a segment, and the most toxic segments by which a text is scored.
SEGMENT, TOP = 6, 4
#: Parts of the sample, each scored by a model of the others for the curve from segments to texts.
CURVE = 4
BUCKETS, DIM, NGRAMS = 1 << 18, 8, (3, 4, 5, 6, 7, 8)
ROUNDS, EPOCHS, RATE, DECAY = 3, 20, 0.15, 1e-6
#: Weight of the segments that count as toxic, as a part of that of the clean ones.
PART = 0.2
#: Subwords met in fewer of the texts say nothing.
LEAST_TEXTS = 8
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
_C = np.random.default_rng(77).integers(1, 2**63, 16, dtype=U) | U(1)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams (bytes, with an edge mark on both sides) and of the whole word, and the bounds by word."""
    size = ends - starts
    n = len(size)
    padded = size + 2
    begin = np.cumsum(padded) - padded
    flat = np.full(int(padded.sum()), 1, np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(begin + 1, size) + inner] = data[np.repeat(starts, size) + inner]
    owner = np.repeat(np.arange(n), padded)
    left = np.repeat(begin + padded, padded) - np.arange(len(flat))  # bytes up to the word's end
    parts, owners = [], []
    for k in NGRAMS:
        if len(flat) >= k:
            at = np.flatnonzero(left[: len(flat) - k + 1] >= k)
            h = np.full(len(at), k, U)
            for i in range(k):
                h = h + flat[at + i] * _C[i] * U(2 * i + 1)
            parts.append((mix(h) % U(BUCKETS)).astype(np.int32))
            owners.append(owner[at])
    total = np.add.reduceat(flat * mix(np.arange(len(flat), dtype=U) - np.repeat(begin, padded).astype(U)), begin) if n else np.zeros(0, U)
    parts.append((mix(total) % U(BUCKETS)).astype(np.int32))
    owners.append(np.arange(n))
    bucket, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def segmented(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words (lower case), first word of each segment, and the owner of each segment."""
    words = Words(*text_bytes(column), lower=True)
    n = -(-np.diff(words.bounds) // SEGMENT)
    owner = np.repeat(np.arange(len(n)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT + words.bounds[owner]
    return words, first, owner


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Place of one word for each distinct hash, and the number of the distinct word of every word."""
    order = np.argsort(words.hashes)
    first = run_starts(words.hashes[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return order[first], number


class Toxic:
    """After training the embedding and the softmax fold into one number for each bucket."""

    def __init__(self, bucket: np.ndarray, bias: float, curve: np.ndarray):
        self.bucket, self.bias, self.curve = bucket.astype(np.float32), bias, curve

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Logits of the TOP most toxic segments of each text (the bias, where it has fewer), the log of its segments, and 1."""
        words, first, owner = segmented(column)
        n = np.bincount(owner, minlength=len(column))
        out = np.full((len(column), TOP + 2), self.bias)
        out[:, TOP], out[:, TOP + 1] = np.log1p(n), 1.0
        if len(first) == 0:
            return out
        place, number = distinct_words(words)
        sub, bounds = subwords(words.data, words.starts[place], words.ends[place])
        value = np.add.reduceat(self.bucket[sub].astype(float), bounds[:-1]) / np.diff(bounds)
        size = np.diff(np.append(first, len(words.hashes)))
        logit = np.add.reduceat(value[number], first) / size + self.bias
        order = np.lexsort((-logit, owner))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        top = rank < TOP
        out[owner[order][top], rank[top]] = np.maximum(logit[order][top], self.bias)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.pooled(column) @ self.curve)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression with some ridge (none on the last column), by damped Newton steps."""
    w = np.zeros(x.shape[1])
    r = np.full(len(w), ridge)
    r[-1] = 1e-6
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(r), x.T @ (p - y) + r * w)
        w -= np.clip(step, -1, 1)
    return w


def fit(texts: pa.Array, y: np.ndarray, seed: int = 5) -> Toxic:
    """A model of all texts. The curve from segments to texts is fitted on what models of the other parts make of each of CURVE parts, if all of these have both classes."""
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Toxic(np.zeros(BUCKETS), 0.0, np.append(np.zeros(TOP + 1), np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    part = np.random.default_rng(seed).integers(0, CURVE, len(y))
    model = fit_segments(texts, y, share, seed) or model
    if all(len(set(y[part == k])) == 2 and len(set(y[part != k])) == 2 for k in range(CURVE)):
        pooled = np.empty((len(y), TOP + 2))
        for k in range(CURVE):
            other = fit_segments(texts.filter(pa.array(part != k)), y[part != k], share, seed) or model
            pooled[part == k] = other.pooled(texts.filter(pa.array(part == k)))
    else:
        pooled = model.pooled(texts)
    used = np.arange(TOP + 2)
    while True:  # a more toxic segment never makes a text less toxic
        w = logistic(pooled[:, used], y)
        against = (used < TOP) & (w < 0)
        if not against.any():
            break
        used = used[~against]
    model.curve = np.zeros(TOP + 2)
    model.curve[used] = w
    return model


def fit_segments(texts: pa.Array, y: np.ndarray, share: float, seed: int) -> Toxic | None:
    """Joint training of embeddings and softmax on segments, without the curve; None if no subword is in LEAST_TEXTS texts.

    Only whole texts have labels: in the first round every segment of a toxic text counts as toxic; in
    later rounds the one that the model finds most toxic. Every segment of the others is clean.
    """
    rng = np.random.default_rng(seed)
    words, first, owner = segmented(texts)
    if len(first) == 0:
        return None
    size = np.diff(np.append(first, len(words.hashes)))
    place, number = distinct_words(words)
    sub, bounds = subwords(words.data, words.starts[place], words.ends[place])
    n_sub = np.diff(bounds)
    sub_word = np.repeat(np.arange(len(place)), n_sub)
    # texts with each word, then (at most) with each subword; rare subwords leave the bags, not the counts
    seen = np.sort(number * len(y) + np.repeat(owner, size))
    texts_of = np.bincount(seen[run_starts(seen)] // len(y), minlength=len(place))
    common = np.bincount(sub, texts_of[sub_word], BUCKETS) >= LEAST_TEXTS
    keep = common[sub]
    sub, sub_word = sub[keep], sub_word[keep]
    has = np.bincount(sub_word, minlength=len(place)) > 0
    if not has.any():
        return None
    renumber = np.cumsum(has) - 1
    sub_word, n_sub, word_on = renumber[sub_word], n_sub[has], has[number]
    seg_word = np.repeat(np.arange(len(size)), size)[word_on]
    number = renumber[number[word_on]]
    bounds = np.searchsorted(sub_word, np.arange(len(n_sub)))
    seg_first = run_starts(seg_word)
    seg_full = seg_word[seg_first]
    met = np.bincount(sub, minlength=BUCKETS) > 0
    sub = (np.cumsum(met) - 1)[sub]
    e = rng.normal(0, 0.1, (int(met.sum()), DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.log(np.array([1 - share, share], np.float32))
    params = [e, w, bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    toxic = y[owner] > 0
    # the toxic segments weigh together as much as a fixed part of the clean ones, however long the texts are
    weighed = lambda chosen: PART * max((~toxic).sum(), 1) / max(chosen.sum(), 1) * chosen + ~toxic
    target, weight, step = toxic.astype(np.float32), weighed(toxic), 0
    for turn in range(ROUNDS):
        if turn:
            # the most toxic segment stands for its text, the text's others are left out
            top = np.lexsort((-logit, owner))  # noqa: F821
            lead = np.zeros(len(owner), bool)
            lead[top[run_starts(owner[top])]] = True
            weight = weighed(toxic & lead)
        for _ in range(EPOCHS):
            # two classes: all that a word or a subword adds to logits and gradients lies along this one direction
            toward = w[:, 1] - w[:, 0]
            value = np.add.reduceat((e @ toward)[sub], bounds) / n_sub
            logit = np.full(len(size), bias[1] - bias[0])
            logit[seg_full] += np.add.reduceat(value[number], seg_first) / size[seg_full]
            d = (sigmoid(logit) - target) * weight / weight.sum()
            by_word = np.bincount(number, (d / size)[seg_word], len(n_sub))
            by_sub = np.bincount(sub, (by_word / n_sub)[sub_word], len(e)).astype(np.float32)
            along = by_sub @ e
            grads = [by_sub[:, None] * toward + DECAY * e, np.stack((-along, along), 1) + DECAY * w, np.array([-d.sum(), d.sum()])]
            step += 1
            for k in range(3):
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.99 * m2[k] + 0.01 * grads[k] ** 2
                params[k] -= (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[met] = e @ (w[:, 1] - w[:, 0])
    return Toxic(bucket, float(bias[1] - bias[0]), np.zeros(TOP + 2))


def _fit_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (label, text) -> the one model that they give, whatever their order."""
    batches = [b for b in batches if b.num_rows]
    rows = pa.Table.from_batches(batches) if batches else pa.table({"label": pa.array([], pa.int32()), "text": pa.array([], pa.string())})
    rows = rows.sort_by([("text", "ascending"), ("label", "ascending")])
    model = fit(rows["text"].combine_chunks(), rows["label"].to_numpy().astype(float))
    yield pa.RecordBatch.from_arrays([pa.array([model.bucket.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.curve.tolist()], pa.list_(pa.float64()))], ["bucket", "bias", "curve"])
    give_back()


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE, most_bytes: int = TRAIN_BYTES) -> Toxic:
    """A model from labelled rows outside the held-out fold: in the order of a hash of the id, at most ``bound`` of them and as many as have ``most_bytes`` of text together.

    Their texts are used whole, by one task on an executor; the model comes back (1 MB). A row whose text alone exceeds ``most_bytes`` is left out.
    """
    picked = scratch.table(sample(labels, "toxic", FOLDS, HELD_OUT, bound, id_col), "sample")
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    rows = scratch.table(rows.select(F.xxhash64(id_col).alias("h"), "label", "text", F.octet_length("text").alias("size")), "labelled")
    upto, total = None, 0
    for r in rows.groupBy("h").agg(F.sum("size").alias("size")).orderBy("h").collect():  # a row for each id of the sample
        total += r["size"]
        if total > most_bytes:
            break
        upto = r["h"]
    rows = rows.where(F.lit(False) if upto is None else F.col("h") <= upto)
    got = rows.select("label", "text").coalesce(1).mapInArrow(_fit_pass, "bucket binary, bias double, curve array<double>").first()
    return Toxic(np.frombuffer(got["bucket"], np.float32), got["bias"], np.array(got["curve"])) if got else fit(pa.array([], pa.string()), np.zeros(0))


def score_toxicity(docs: DataFrame, model: Toxic, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for each row of docs; every segment of every text is scored.

    A score depends on the text alone, so nothing is shuffled. A null text is empty; a text without words
    gets the score of the bias. An empty table gives an empty table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column("text")), pa.float64())], [id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, F.coalesce(fold(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
