"""Evidence: which chunks go to a check, and how much of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def evidence_blocks(chunks: Column, most: int = 560) -> Column:
    """P5: array<struct<chunkId, pageNumber, similarity, text>> of retrieved chunks."""
    text = lambda c: T.strip(c["text_redacted"])
    return F.transform(
        F.filter(chunks, lambda c: T.nn(c["chunk_id"]) != ""),
        lambda c: F.struct(
            c["chunk_id"].alias("chunkId"), F.coalesce(c["page_number"], F.lit(0)).cast("int").alias("pageNumber"), F.round(c["similarity"], 4).alias("similarity"),
            F.when(F.length(text(c)) > most, F.concat(F.left(text(c), F.lit(most - 1)), F.lit("…"))).otherwise(text(c)).alias("text"),
        ),
    )


def _pack(blocks: Column, most: Column | int, cut, fixed) -> Column:
    """Blocks joined by an empty line while they fit; of the first that does not, a part if more than 80 characters fit, and then no more.

    blocks: array<struct<label, text>>; cut(block, room): that part; fixed(block): characters that the part needs besides.
    """
    most = F.lit(most) if isinstance(most, int) else most
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(s: Column, b: Column) -> Column:
        gap = F.when(s["text"] != "", 2).otherwise(0)
        whole = F.concat(b["label"], b["text"])
        room = most - s["used"] - gap - fixed(b)
        add = lambda x: F.when(s["text"] != "", F.concat(s["text"], F.lit("\n\n"), x)).otherwise(x)
        fits = s["used"] + gap + F.length(whole) <= most
        return (
            F.when(s["full"], s)
            .when(fits, F.struct(add(whole).alias("text"), (s["used"] + gap + F.length(whole)).alias("used"), F.lit(False).alias("full")))
            .otherwise(F.struct(F.when(room > 80, add(cut(b, room))).otherwise(s["text"]).alias("text"), s["used"].alias("used"), F.lit(True).alias("full")))
        )

    return F.aggregate(blocks, zero, step, lambda s: s["text"])


def _page(c: Column) -> Column:
    return F.when(F.coalesce(c["page_number"], F.lit(0)) > 0, F.concat(F.lit("Page "), c["page_number"].cast("string"), F.lit(": "))).otherwise("")


def merge_evidence(chunks: Column, most: int = 900) -> Column:
    """struct<text, similarity> of ranked chunks; the similarity is that of the first."""
    first = F.try_element_at(chunks, F.lit(1))
    ids = F.transform(chunks, lambda c: c["chunk_id"])
    used = F.filter(chunks, lambda c, i: (T.nn(c["chunk_id"]) != "") & (F.array_position(ids, c["chunk_id"]) == i + 1) & (T.strip(c["text_redacted"]) != ""))
    blocks = F.transform(used, lambda c: F.struct(_page(c).alias("label"), T.strip(c["text_redacted"]).alias("text")))
    text = _pack(blocks, most, lambda b, room: F.concat(b["label"], F.left(b["text"], room)), lambda b: F.length(b["label"]))
    some = T.nn(first["chunk_id"]) != ""
    return F.struct(F.when(some, text).otherwise("").alias("text"), F.when(some, first["similarity"]).otherwise(F.lit(0.0)).alias("similarity"))


def check_score(label: Column, c: Column) -> Column:
    """Similarity, share of the label's words, and bonuses for those in the section title and the area."""
    words = T.label_tokens(label)
    parts = [c[x] for x in ("heading_guess", "section_title", "statement_area", "chunk_type", "note_number", "text_redacted")]
    have = T.label_tokens(F.concat_ws(" ", *(F.when(p != "", p) for p in parts)))
    share = F.size(F.array_intersect(words, have)) / F.greatest(F.lit(1), F.size(words))
    bonus = lambda field, x: F.when(F.size(F.array_intersect(words, T.label_tokens(c[field]))) > 0, x).otherwise(0.0)
    return 0.67 * F.coalesce(c["similarity"], F.lit(0.0)) + 0.28 * share + (bonus("section_title", 0.05) + bonus("statement_area", 0.03))


def chunks_for_check(label: Column, chunks: Column, most: int = 2) -> Column:
    """The best chunks for a check, ties in the order given; chunks are the few of one rule."""
    scored = F.transform(chunks, lambda c, i: F.struct((-check_score(label, c)).alias("s"), i.alias("i"), c.alias("c")))
    kept = F.filter(scored, lambda x: T.nn(x["c"]["chunk_id"]) != "")
    order = F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i"))))
    return F.slice(F.transform(order, lambda o: F.element_at(chunks, (o["i"] + 1).cast("int"))), 1, max(1, most))


def check_evidence(chosen: Column, most: Column | int = 700) -> Column:
    """The text of chosen chunks, each with its section and page."""
    def block(c: Column) -> Column:
        title = F.when(T.nn(c["section_title"]) != "", c["section_title"]).otherwise(T.nn(c["heading_guess"]))
        head = F.when(title != "", F.concat(F.lit("Section: "), title, F.lit("\n"))).otherwise("")
        page = F.when(F.coalesce(c["page_number"], F.lit(0)) != 0, F.concat(F.lit("Page "), c["page_number"].cast("string"), F.lit(": "))).otherwise("")
        return F.struct(F.lit("").alias("label"), T.strip(F.concat(head, page, T.nn(c["text_redacted"]))).alias("text"))

    return T.strip(_pack(F.transform(chosen, block), most, lambda b, room: F.concat(T.rstrip(F.left(b["text"], room)), F.lit("…")), lambda b: F.lit(0)))


def evidence_budget(merged: Column) -> Column:
    return F.greatest(F.lit(280), F.least(F.lit(700), F.when(F.length(merged) > 0, F.length(merged)).otherwise(700)))


def gather(matches: DataFrame) -> DataFrame:
    """Matches -> one row for each rule and document with its top chunks, at most top_k, in order."""
    fields = ("chunk_id", "page_number", "text_redacted", "heading_guess", "similarity", "section_title", "statement_area", "chunk_type", "note_number")
    rows = matches.groupBy("item_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("c")))).alias("r"), F.bool_or("lexical_miss").alias("lexical_miss"))
    return rows.select("item_key", "doc_id", F.transform("r", lambda x: x["c"]).alias("chunks"), "lexical_miss")
