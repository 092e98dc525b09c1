"""Stand-ins for outside services: they are deterministic, work without a network, and can be replaced by others of the same shape."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F

from .functions import text as T


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column:
        """text -> array<double>"""


class Judge(Protocol):
    def __call__(self, label: Column, evidence: Column, prompt: Column) -> Column:
        """A check, its evidence, and the question in full -> the raw JSON of a judgement; null if the judge failed"""


def hashing_embedder(dim: int = 64) -> Embedder:
    """Counts of hashed tokens with signs, of length one; in columns throughout."""
    def embed(text: Column) -> Column:
        marks = F.transform(T.tokens(text), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("d"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
        raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(marks, lambda m: m["d"] == d), F.lit(0.0), lambda a, m: a + m["s"]))
        n = F.greatest(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
        return F.transform(raw, lambda x: x / n)

    return embed


def overlap_judge(full: float = 0.8, partial: float = 0.4) -> Judge:
    """Judges by the share of a check's words that the evidence holds."""
    def judge(label: Column, evidence: Column, prompt: Column) -> Column:
        words = T.label_tokens(label)
        share = F.size(F.array_intersect(words, T.label_tokens(evidence))) / F.greatest(F.lit(1), F.size(words))
        status = F.when(share >= full, "FULLY").when(share >= partial, "PARTIAL").otherwise("NONE")
        reason = F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("% of the check's words are in the excerpts."))
        return F.to_json(F.struct(status.alias("status"), reason.alias("reason"), F.round(share, 4).alias("confidence")))

    return judge


def with_retry(call: Callable, tries: int = 4, first: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep):
    """call() again after errors, waiting twice as long each time."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(min(most, first * 2**k))


def batched_embedder(call: Callable[[list[str]], list[list[float]]], batch: int = 50, tries: int = 4) -> Embedder:
    """An outside service that takes ``batch`` texts at a time; a call that fails is tried again, and then the job fails."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for k in range(0, len(texts), batch):
            out += with_retry(lambda part=[t or "" for t in texts[k : k + batch]]: call(part), tries)
        return pd.Series([list(map(float, v)) for v in out])

    return embed


def batched_judge(call: Callable[[str, str], str], tries: int = 1) -> Judge:
    """An outside judge of (prompt, evidence); where it fails the judgement is null, and the check counts as not judged."""
    @F.pandas_udf("string")
    def ask(prompts: pd.Series, evidence: pd.Series) -> pd.Series:
        def one(p: str, e: str) -> str | None:
            try:
                return with_retry(lambda: call(p or "", e or ""), tries)
            except Exception:  # noqa: BLE001  (whatever the service raises)
                return None

        return pd.Series([one(p, e) for p, e in zip(prompts, evidence)], dtype=object)

    return lambda label, evidence, prompt: ask(prompt, evidence)
