"""Pages to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.pii import audit, redact
from ..params import Params

EDGE, REPEATED = 3, 3
_SECTION = "array<struct<heading:string,lines:array<string>>>"


def redact_pages(pages: DataFrame) -> DataFrame:
    """pages with their text redacted and a column pii_audit; placeholders are numbered page by page."""
    return pages.withColumns({"text": redact(F.col("text")), "pii_audit": audit(F.col("text"))})


def needs_ocr(pages: DataFrame) -> DataFrame:
    """(doc_id, needs_ocr): fewer pages with 40 characters than a third of them (one at least)."""
    good = F.count_if(F.length(T.strip(F.col("text"))) >= 40)
    return pages.groupBy("doc_id").agg((good < F.greatest(F.lit(1), F.floor(F.count("*") / 3))).alias("needs_ocr"))


def repeated_edges(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, lines) -> (doc_id, heads, tails): lines met three times or more among the first or last three of pages."""
    both = [pages.select("doc_id", F.lit(side).alias("side"), F.explode(cut).alias("line")) for side, cut in (("head", F.slice("lines", 1, EDGE)), ("tail", F.slice("lines", F.greatest(F.lit(1), F.size("lines") - EDGE + 1), F.lit(EDGE))))]
    often = both[0].unionByName(both[1]).groupBy("doc_id", "side", "line").count().where(F.col("count") >= REPEATED)
    return often.groupBy("doc_id").agg(F.collect_set(F.when(F.col("side") == "head", F.col("line"))).alias("heads"), F.collect_set(F.when(F.col("side") == "tail", F.col("line"))).alias("tails"))


def strip_edges(lines: Column, heads: Column, tails: Column) -> Column:
    """Without the repeated lines at the top and the bottom, and then without page numbers at the end."""
    heads, tails = (F.coalesce(x, F.array().cast("array<string>")) for x in (heads, tails))
    first = F.array_min(F.transform(lines, lambda x, i: F.when(~F.array_contains(heads, x), i + 1)))
    last = F.array_max(F.transform(lines, lambda x, i: F.when(~F.array_contains(tails, x), i + 1)))
    return T.drop_page_numbers(F.when(first.isNull() | last.isNull() | (last < first), F.array().cast("array<string>")).otherwise(F.slice(lines, first, last - first + 1)))


def _fold(lines: Column, step) -> Column:
    """Sections from lines, by one pass over a page with the state (heading, note, in_notes, body, done)."""
    zero = F.struct(F.lit("").alias("heading"), F.lit("").alias("note"), F.lit(False).alias("in_notes"), F.array().cast("array<string>").alias("body"), F.array().cast(_SECTION).alias("done"))

    def flushed(s: Column) -> Column:
        return F.when(F.size(s["body"]) > 0, F.concat(s["done"], F.array(F.struct(s["heading"].alias("heading"), s["body"].alias("lines"))))).otherwise(s["done"])

    def state(heading, note, in_notes, body, done) -> Column:
        return F.struct(heading.alias("heading"), note.alias("note"), in_notes.alias("in_notes"), body.alias("body"), done.alias("done"))

    none = F.array().cast("array<string>")
    more = lambda s, x: state(s["heading"], s["note"], s["in_notes"], F.concat(s["body"], F.array(x)), s["done"])
    return F.aggregate(lines, zero, lambda s, x: step(s, x, flushed(s), state, none, more(s, x)), flushed)  # lazily: only the branch taken is built


def plain_sections(lines: Column) -> Column:
    """A heading begins a section; below "Note n" other headings carry it in front."""
    def step(s, x, done, state, none, more):
        h = F.regexp_replace(x, ":+$", "")
        is_note = h.rlike(T.NOTE_HEADING)
        carried = (s["note"] != "") & ~h.rlike(T.NUMBERED_NOTE) & F.startswith(F.lower(s["note"]), F.lit("note "))
        heading = F.when(~is_note & carried, F.concat(s["note"], F.lit(" - "), h)).otherwise(h)
        return F.when(T.is_heading(x), state(heading, F.when(is_note, h).otherwise(s["note"]), s["in_notes"], none, done)).otherwise(more)

    return _fold(lines, step)


def note_sections(lines: Column) -> Column:
    """Below the title of the notes only a numbered note begins a section, and stays in its body."""
    def step(s, x, done, state, none, more):
        return (
            F.when(F.upper(x) == T.NOTES_TITLE, state(x, s["note"], F.lit(True), none, done))
            .when(s["in_notes"] & x.rlike(T.NUMBERED_NOTE), state(x, s["note"], s["in_notes"], F.array(x), done))
            .when(~s["in_notes"] & T.is_heading(x), state(F.regexp_replace(x, ":+$", ""), s["note"], s["in_notes"], none, done))
            .otherwise(more)
        )

    return _fold(lines, step)


def sections(lines: Column) -> Column:
    """array<struct<heading, lines>> of a page; a page of headings only is one section without heading."""
    def plain(v: Column) -> Column:
        alone = F.array(F.struct(F.lit("").alias("heading"), v.alias("lines")))
        return T.let(plain_sections(v), lambda p: F.when(F.size(p) > 0, p).otherwise(alone))

    def made(v: Column) -> Column:
        has_title = F.exists(v, lambda x: F.upper(x) == T.NOTES_TITLE)
        notes = T.let(note_sections(v), lambda n: F.when(F.size(n) > 0, n).otherwise(plain(v)))
        return F.when(F.size(v) == 0, F.array().cast(_SECTION)).when(has_title, notes).otherwise(plain(v))

    return T.let(lines, made)


def word_windows(words: Column, size: int, overlap: int) -> Column:
    """Texts of ``size`` words, each but the first beginning ``overlap`` words before the end of the one before."""
    step = size - overlap
    n = F.size(words)
    count = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " ")))


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, lines) with repeated edges gone; pages without lines drop out."""
    lines = pages.select("doc_id", "page_number", T.clean_lines(F.col("text")).alias("lines"))
    out = lines.join(repeated_edges(lines), "doc_id", "left").withColumn("lines", strip_edges(F.col("lines"), F.col("heads"), F.col("tails")))
    # lines that were second now may stand first, so they are cleaned again
    return out.select("doc_id", "page_number", T.clean_lines(F.array_join("lines", "\n")).alias("lines")).where(F.size("lines") > 0)


def build_chunks(pages: DataFrame, params: Params = Params(), strict_tables: bool = False) -> DataFrame:
    """pages (doc_id, page_number, text) -> chunks, numbered within each document.

    All but the edge lines and the numbering is computed within a page's row, without a shuffle.
    """
    split = cleaned_pages(pages).select("doc_id", "page_number", F.posexplode(sections(F.col("lines"))).alias("section", "s"))
    split = split.select("doc_id", "page_number", "section", F.col("s.heading").alias("hint"), F.col("s.lines").alias("lines"))
    table = F.forall(F.slice("lines", 1, 4), lambda x: T.is_tableish(x, strict_tables))
    windows = word_windows(T.words_of(F.array_join("lines", " ")), params.window_words, params.overlap_words)
    split = split.withColumn("is_table", table).select("doc_id", "page_number", "section", "hint", "is_table", F.slice("lines", 1, 4).alias("few"), F.posexplode(F.when(table, F.array(F.array_join("lines", " "))).otherwise(windows)).alias("window", "body"))
    body = T.squash(F.col("body"))
    split = split.withColumn("text_redacted", body).withColumn("heading_guess", F.when(F.col("hint") != "", F.col("hint")).otherwise(T.heading_guess(F.col("text_redacted"))))
    own = F.when(F.col("is_table"), F.col("few")).otherwise(F.array("text_redacted"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "section", "window")
    return split.select(
        "doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "page_number", "text_redacted", F.sha2("text_redacted", 256).alias("text_hash"), "heading_guess", F.col("heading_guess").alias("section_title"),
        T.statement_area(F.col("heading_guess"), F.col("text_redacted"), F.col("page_number")).alias("statement_area"), T.chunk_type(own, F.col("heading_guess"), strict_tables).alias("chunk_type"), T.note_number(F.col("heading_guess")).alias("note_number"),
    )
