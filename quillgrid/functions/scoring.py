"""Vectors and rank scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import nn, strip, token_set


def dot(a: Column, b: Column) -> Column:
    """C22, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Length one; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def parse_vector(c: Column) -> Column:
    """From "[..]", "{..}" (which may be empty) or text with one "[..]" of numbers in it; null is empty, other text an error where it is read."""
    t = strip(c)
    listed = F.when(t.startswith("["), t).when(t.startswith("{") & t.endswith("}"), F.concat(F.lit("["), F.substring(t, F.lit(2), F.length(t) - 2), F.lit("]"))).otherwise(F.regexp_extract(t, r"\[[\s\-0-9eE+.,]+\]", 0))
    parsed = F.from_json(listed, "array<float>", {"mode": "FAILFAST"})
    return F.when(c.isNull(), F.array().cast("array<float>")).otherwise(F.coalesce(F.when(listed != "", parsed), F.raise_error(F.concat(F.lit("no vector: "), t)).cast("array<float>")))


def keyword_sets(keywords: Column) -> Column:
    """The token sets of keywords that have any."""
    return F.filter(F.transform(keywords, token_set), lambda s: F.size(s) > 0)


def overlap(sets: Column, have: Column) -> Column:
    """The share of keyword sets that are subsets of have."""
    n = F.size(sets)
    hits = F.size(F.filter(sets, lambda s: F.size(F.array_except(s, have)) == 0))
    return F.when((n > 0) & (F.size(have) > 0), hits / n).otherwise(F.lit(0.0))


def rank_score(similarity: Column, keyword: Column, heading: Column, section: Column) -> Column:
    """C25, C26."""
    return 0.65 * similarity + 0.22 * F.least(F.lit(1.0), keyword + 0.35 * section) + 0.13 * F.greatest(heading, section)


def similarity_status(similarity: Column) -> Column:
    """C27."""
    return F.when(similarity >= 0.83, "fully_met").when(similarity >= 0.72, "partially_met").otherwise("missing")


def normalize_keywords(c: Column, most: int | None = None, distinct: bool = False) -> Column:
    """Trimmed and lower-case, without blanks; distinct in order of appearance and cut if asked for."""
    out = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x != "")
    out = F.array_distinct(out) if distinct else out
    return F.slice(out, 1, most) if most is not None else out


def string_list(c: Column) -> Column:
    """A JSON array in a string; anything else is empty."""
    return F.coalesce(F.from_json(nn(c), "array<string>"), F.array().cast("array<string>"))
