"""Keywords, section hints and atomic checks of rules, from their own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.text import nn, strip
from ..schemas import CHECK


def _say(words: Column) -> Column:
    """Tokens of three letters or more that are no stopwords or numbers."""
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*T.STOPWORDS, *T.WEAK) & ~w.rlike(r"^\d+$"))


def _phrase_and_tokens(c: Column) -> Column:
    phrase = T.hint_phrase(c)
    return F.concat(F.when(phrase != "", F.array(phrase)).otherwise(F.array().cast("array<string>")), _say(T.tokens(c)))


def atomic_checks() -> Column:
    """One required check for a clause whose label says something of its own."""
    label = T.atomic_label(F.col("requirement_text_leaf"), F.col("requirement_text"))
    one = F.array(F.struct(F.lit("c1").alias("check_id"), label.alias("label"), F.lit("required").alias("kind")))
    good = (label != "") & (nn(F.col("clause_path")) != "") & (label != T.hint_phrase(F.col("requirement_text")))
    return F.when(good, one).otherwise(F.array().cast(f"array<{CHECK}>"))


def keywords(most: int = 10) -> Column:
    """The label (or the leaf, or leaf and text) as a phrase, and its words."""
    leaf, text, clause = F.col("requirement_text_leaf"), F.col("requirement_text"), nn(F.col("clause_path")) != ""
    label = T.atomic_label(leaf, text)
    got = (
        F.when(clause & (label != ""), F.concat(F.array(F.lower(strip(label))), _phrase_and_tokens(label)))
        .when(clause & (strip(leaf) != ""), _phrase_and_tokens(leaf))
        .otherwise(F.concat(_phrase_and_tokens(leaf), _phrase_and_tokens(text)))
    )
    return F.slice(F.array_distinct(got), 1, most)


# What a rule's wording says about the place of a disclosure.
PLACES = (
    (("statement of financial position", "balance sheet"), "balance sheet"), (("income statement", "profit and loss"), "income statement"), (("cash flow",), "cash flow"),
    (("notes",), "notes"), (("accounting policy", "accounting policies"), "accounting policies"), (("director",), "directors"), (("related party",), "related party"),
)


def section_hints(most: int = 4) -> Column:
    """C35."""
    parts = [F.col(c) for c in ("sheet_name", "section_path", "requirement_text", "requirement_text_leaf")]
    text = F.lower(F.concat_ws(" ", *(F.when(p != "", p) for p in parts)))
    found = [F.when(T.contains_any(text, terms), F.lit(hint)) for terms, hint in PLACES]
    own = [T.hint_phrase(F.col("section_path")), T.hint_phrase(F.col("sheet_name"))]
    hints = F.filter(F.array(*found, *own), lambda h: h.isNotNull() & (h != "") & ~h.isin(*T.GENERIC_HINTS))
    return F.slice(F.array_distinct(hints), 1, most)


def keywords_from_checks(checks: Column, most: int = 36) -> Column:
    """Of each label a phrase of at most six words, and its words."""
    def of(label: Column) -> Column:
        words = F.filter(T.tokens(label), lambda w: ~w.isin(*T.STOPWORDS, *T.WEAK))
        phrase = F.array_join(words, " ")
        ed = lambda w: F.endswith(w, F.lit("ed")) & F.left(w, F.greatest(F.lit(0), F.length(w) - 2)).isin(*T.STOPWORDS)
        return F.concat(F.when((phrase != "") & (F.size(words) <= 6), F.array(phrase)).otherwise(F.array().cast("array<string>")), F.filter(_say(words), lambda w: ~ed(w)))

    return F.slice(F.array_distinct(F.flatten(F.transform(checks, lambda c: of(nn(c["label"]))))), 1, most)


def with_hints(items: DataFrame) -> DataFrame:
    """Items with type key, item key, texts for storage and retrieval, checks, keywords and section hints."""
    stem = F.regexp_replace(F.element_at(F.split("source_workbook", "/"), -1), r"\.[^.]*$", "")
    out = items.withColumn("checklist_type_key", T.type_key(stem))
    return out.withColumns({
        "item_key": T.item_key(F.col("checklist_type_key"), F.col("sheet_name"), F.col("requirement_id"), F.col("requirement_text")),
        "embedding_text": T.item_embedding_text(), "retrieval_text": T.item_retrieval_text(F.col("requirement_text"), F.col("requirement_text_leaf")),
        "rule_checks": atomic_checks(), "search_keywords": keywords(), "section_hints": section_hints(),
    })
