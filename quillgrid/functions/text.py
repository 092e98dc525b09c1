"""Text functions. Patterns are Java's; (?U) makes white space and word characters Unicode's."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Prefixes, markers and patterns of the checklists and reports.
META_PREFIXES = ("client", "year", "period", "file number", "prepared by", "reviewed by", "date")
OTHER_PREFIXES = ("appendix", "main checklist", "further guidance", "audited accounts", "assurance review report", "political donations")
NOTE_PREFIXES = ("note", "notes")
GUIDANCE_PREFIXES = ("[guidance]", "guidance", "per the above", "table of equivalence")
TITLES_SENTENCE = "a micro-entity may use titles for the financial statements other than"
ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx", "xxi", "xxii")
MODALS = (" must ", " shall ", " should ", " may ", " is ", " are ")
REQUIREMENT_ID = r"^(?:[A-Z]{1,5}\s*)?\d+(?:\.\d+)+$"
CLAUSE = r"^\(([A-Za-z0-9]+)\)\s*(.*)$"
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
NOTES_TITLE = "NOTES TO THE FINANCIAL STATEMENTS"
NOTE_HEADING = r"(?i)^(note|notes)\s+[a-z0-9]+"
NUMBERED_NOTE = r"^\d+\s+[A-Za-z]"
NUMBERED_HEADING = r"^(?:\d+(?:\.\d+)*|[A-Z])[).\-:]\s+\S"
NOTE_NUMBER = r"(?i)^(?:note\s+)?(\d+(?:\.\d+)*)\b"
PRIMARY_STATEMENT = r"(?i)\b(balance sheet|statement of|income statement|cash flow|changes in equity)\b"
PAGE_MARKER = r"(?i)^--\s*\d+\s+of\s+\d+\s*--$"
PAGE_NUMBER = r"^\d{1,3}$"
YEAR_ROW = r"^(?:\d{4}\s+){1,3}\d{4}$"
CURRENCY_ROW = r"^(?:[£$€]\s*){1,4}$"
YEAR_ENDED = r"(?i)^y\s*ear ended\b"
NOISE = r"(?i)\[[A-Z_0-9]+\]|\b\d[\d,.\[\]]*\b|£m\b"
NUMERICISH = r"(?i)^[\[\]A-Z_0-9,.()%/-]+$"
STRICT_NUMERICISH = r"^[\[\]_0-9,.()%/£$€-]+$"
FRONT_TERMS = ("contents", "independent auditor", "directors' report")
GENERIC_LEAF = ("the ", "any ", "its ", "their ", "details of ", "amount of ")
# Words that say nothing in a hint, and hints that are too general.
STOPWORDS = (
    "the", "a", "an", "and", "any", "all", "at", "by", "be", "been", "being", "can", "covered", "date", "dates", "disclose", "disclosed", "disclosure", "disclosures",
    "end", "entity", "financial", "following", "for", "is", "include", "includes", "including", "information", "items", "name", "period", "position", "report",
    "reporting", "required", "requirement", "of", "or", "are", "shall", "state", "stated", "statements", "that", "there", "these", "with", "from", "this", "have", "has",
    "must", "under", "above", "year", "question",
)
WEAK = (
    "verify", "check", "ensure", "confirm", "presence", "indicates", "correct",
)
GENERIC_HINTS = ("disclosure", "disclosures", "financial statements", "reporting period", "period", "date", "details")
LABEL_STOPWORDS = (
    "the", "a", "an", "and", "of", "for", "to", "in", "on", "by", "or", "its", "any",
)


def array_of(words) -> Column:
    return F.array(*map(F.lit, words))


def nn(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def squash(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(nn(c), r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(nn(c), r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(nn(c), r"(?U)\s+$", "")


def starts_any(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def contains_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def normalize_text(c: Column) -> Column:
    """Typographic quotes, dashes and no-break spaces become plain, U+FFFD goes, white space is squashed."""
    return squash(F.translate(nn(c), "\r\n‘’“”–— �", "  ''\"\"-- "))


def append_sentence(base: Column, extra: Column) -> Column:
    """Extra after base, unless either is empty or base holds it already."""
    b, e = normalize_text(base), normalize_text(extra)
    gap = F.when(b.rlike(r"[.:;)\]]$"), F.lit(" ")).otherwise(F.lit("; "))
    return F.when(b == "", e).when((e == "") | F.contains(b, e), b).otherwise(F.concat(b, gap, e))


def compose_requirement(base: Column, alpha: Column, leaf: Column) -> Column:
    """C3."""
    first = strip(base)
    return strip(append_sentence(F.when(nn(alpha) != "", append_sentence(first, alpha)).otherwise(first), leaf))


def row_text(first: Column, second: Column) -> Column:
    """C4: the second cell, with the first before it if that is a clause marker; or whichever there is."""
    f, s = nn(first), nn(second)
    both = F.when(f.rlike(CLAUSE), F.concat(f, F.lit(" "), s)).otherwise(s)
    return normalize_text(F.when((f != "") & (s != ""), both).when(f != "", f).otherwise(s))


def clause_token(c: Column) -> Column:
    """What stands in the parentheses of a clause marker."""
    return F.trim(F.regexp_extract(strip(c), CLAUSE, 1))


def clause_body(c: Column) -> Column:
    return normalize_text(F.regexp_extract(strip(c), CLAUSE, 2))


def repair_id(c: Column) -> Column:
    """A number with ten decimals or more is a float's artefact; 15 significant digits are kept."""
    t = strip(c)
    whole = F.length(F.regexp_extract(t, r"^(\d+)\.", 1))
    digits = F.regexp_replace(_fixed(t, whole), r"0+$", "")
    return F.when(t.rlike(r"^\d+\.\d{10,}$") & ~F.endswith(digits, F.lit(".")), digits).otherwise(nn(c))


def _fixed(t: Column, whole: Column) -> Column:
    """t as a decimal with 15 significant digits; whole: digits before the point."""
    out = F.lit(None).cast("string")
    for n in range(1, 13):
        out = F.when(whole == n, F.when(t.rlike(r"^\d+\.\d{10,}$"), t).try_cast(f"decimal(38,{15 - n})").cast("string")).otherwise(out)
    return out


def pad_id(c: Column) -> Column:
    """6.1 is a 6.10 whose zero a spreadsheet dropped."""
    t = strip(c)
    return F.when(t.rlike(r"^\d+\.\d$"), F.concat(F.regexp_replace(F.regexp_extract(t, r"^(\d+)", 1), r"^0+(?=\d)", ""), F.regexp_extract(t, r"(\.\d)$", 1), F.lit("0"))).otherwise(nn(c))


def framework_of(stem: Column) -> Column:
    """From a workbook's name without its ending."""
    n = F.lower(stem)
    return (
        F.when(F.contains(n, F.lit("charit")), "CHARITIES_FRS102")
        .when(F.contains(n, F.lit("ifrs")), "IFRS")
        .when(F.contains(n, F.lit("frs102")) & F.contains(n, F.lit("1a")), "FRS102_1A")
        .when(F.contains(n, F.lit("frs102")), "FRS102")
        .otherwise(F.replace(F.upper(stem), F.lit(" "), F.lit("_")))
    )


# Workbook names and form labels of the three checklists.
STEM_KEYS = {
    "ifrs_dc_2025": "ifrs", "listed_co_dc_2025": "ifrs", "frs1021a_dc_2025": "frs102", "llp_frs102_dc_2025": "frs102",
    "private_co_frs102_2025": "frs102", "charities_frs102_dc_2025": "frs102", "frs105_dc_2025": "frs105",
}
FORM_KEYS = {
    "ifrs": "ifrs", "ifrs_dc_2025": "ifrs", "frs102": "frs102", "frs_102": "frs102", "frs1021a": "frs102", "frs1021a_dc_2025": "frs102", "frs105": "frs105", "frs_105": "frs105",
    "frs105_dc_2025": "frs105", "charities_frs102_dc_2025": "frs102", "charitiesfrs102": "frs102", "listed_co_dc_2025": "ifrs", "llp_frs102_dc_2025": "frs102", "private_co_frs102_2025": "frs102",
}
DISPLAY_NAMES = {"ifrs": "IFRS", "frs102": "FRS 102", "frs105": "FRS 105"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_stem(c: Column) -> Column:
    """C9."""
    t = F.translate(F.replace(F.lower(c), F.lit("&"), F.lit("and")), " -", "__")
    return F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")


def type_key(stem: Column) -> Column:
    s = normalize_stem(stem)
    has = lambda x: F.contains(s, F.lit(x))
    return (
        F.when(_lookup(STEM_KEYS, s).isNotNull(), _lookup(STEM_KEYS, s))
        .when(has("frs105"), "frs105")
        .when(has("listed_co") | has("ifrs"), "ifrs")
        .when(has("frs102") | has("1021a") | (has("charities") & has("frs")), "frs102")
        .otherwise(s)
    )


def form_key(c: Column, strict: bool = True) -> Column:
    """The checklist that a form label names; an unknown label is an error, or null if not strict."""
    compact = F.replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))
    found = _lookup(FORM_KEYS, compact)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown framework: "), nn(c))).cast("string")) if strict else found


def display_name(key: Column) -> Column:
    return F.coalesce(_lookup(DISPLAY_NAMES, key), F.upper(F.replace(key, F.lit("_"), F.lit(" "))))


# predicates of checklist rows ------------------------------------------------------
def is_requirement_id(c: Column) -> Column:
    return strip(c).rlike(REQUIREMENT_ID)


def is_metadata_row(first: Column) -> Column:
    return starts_any(F.lower(nn(first)), META_PREFIXES)


def is_other_text(c: Column) -> Column:
    return starts_any(F.lower(nn(c)), OTHER_PREFIXES)


def is_section_header(first: Column, second: Column) -> Column:
    f, s = nn(first), nn(second)
    upper = (F.upper(s) == s) & (F.lower(s) != s)
    return ~is_requirement_id(f) & (((f != "") & (s == "") & ~is_other_text(f)) | (f.rlike(r"^\d+$") & (s != "") & upper))


def is_guidance(c: Column) -> Column:
    t = F.lower(strip(c))
    quoted = F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))
    return (t != "") & (starts_any(t, GUIDANCE_PREFIXES) | quoted | F.contains(t, F.lit("guidance only")) | F.startswith(t, F.lit(TITLES_SENTENCE)))


def is_note_row(c: Column) -> Column:
    return starts_any(F.lower(strip(c)), NOTE_PREFIXES) | is_guidance(c)


def is_roman(token: Column) -> Column:
    return F.lower(F.trim(token)).isin(*ROMANS)


def is_alpha(token: Column) -> Column:
    t = F.lower(F.trim(token))
    return t.rlike("^[a-z]$") & ~is_roman(t)


def splits_alpha_list(first: Column, second: Column) -> Column:
    """an unnumbered row that is an entry of the list under an open clause."""
    t = row_text(strip(first), strip(second))
    low = F.lower(t)
    short = F.endswith(t, F.lit(";")) | (F.size(F.split(t, " ")) <= 8)
    return (strip(second) != "") & (strip(first) == "") & (t != "") & ~is_note_row(t) & (clause_token(t) == "") & ~contains_any(low, MODALS) & short


# lines of reports ------------------------------------------------------------------
def words_of(c: Column) -> Column:
    return F.filter(F.split(nn(c), r"(?U)\s+"), lambda w: w != "")


def is_noise_line(line: Column) -> Column:
    return (line == "") | line.rlike(PAGE_MARKER) | line.rlike(CURRENCY_ROW)


def is_heading(line: Column) -> Column:
    """F12, for a squashed line."""
    words = F.split(line, " ")
    n = F.size(words)
    digit = line.rlike(r"\p{Nd}")
    letters = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^[\p{Lu}\p{Lt}]")))
    all_caps = (F.upper(line) == line) & line.rlike(r"\p{Lu}") & (n <= 10) & ~digit
    title = (capitals >= F.greatest(F.lit(1), n - 1)) & ~digit & ~line.rlike(r"[.;]$")
    return (
        F.when((line == "") | line.rlike(PAGE_NUMBER) | line.rlike(YEAR_ROW) | line.rlike(CURRENCY_ROW) | (n > 12) | ~line.rlike(r"\p{L}"), False)
        .when(line.rlike(NOTE_HEADING) | line.rlike(NUMBERED_NOTE) | line.rlike(NUMBERED_HEADING), True)
        .when(digit & (letters <= 1), False)
        .otherwise(all_caps | F.endswith(line, F.lit(":")) | title)
    )


def is_tableish(line: Column, strict: bool = False) -> Column:
    """F13, for a squashed line; not strict, ordinary words count as numeric too."""
    tokens = F.split(line, " ")
    n = F.size(tokens)
    numeric = F.size(F.filter(tokens, lambda t: t.rlike(STRICT_NUMERICISH if strict else NUMERICISH)))
    many = (n >= 5) & (numeric >= F.greatest(F.lit(3), F.floor(n / 2)))
    return (line != "") & (line.rlike(YEAR_ROW) | line.rlike(CURRENCY_ROW) | F.contains(line, F.lit("|")) | many)


def clean_lines(text: Column) -> Column:
    """Squashed lines of a page without noise, and without page numbers at its end."""
    t = F.translate(F.replace(F.replace(nn(text), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), "’", "'")
    lines = F.filter(F.transform(F.split(F.regexp_replace(t, YEAR_ENDED, "Year ended"), r"\r?\n+"), squash), lambda x: ~is_noise_line(x))
    return drop_page_numbers(lines)


def drop_page_numbers(lines: Column) -> Column:
    last = lambda v: F.array_max(F.transform(v, lambda x, i: F.when(x.rlike(PAGE_NUMBER), 0).otherwise(i + 1)))
    return let(lines, lambda v: F.slice(v, F.lit(1), F.coalesce(last(v), F.lit(0))))


def heading_guess(text: Column, most: int = 120) -> Column:
    """C10."""
    def clean(picked: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(picked, NOISE, " "), r"(?U)\s+", " "), r"^[ \-,:;()]+|[ \-,:;()]+$", "")

    def cut(t: Column) -> Column:
        short = F.left(t, F.lit(most))
        return strip(F.when(F.length(t) > most, F.when(short.rlike("^.+ "), F.regexp_replace(short, " [^ ]*$", "")).otherwise(short)).otherwise(t))

    def guess(t: Column) -> Column:
        first = let(strip(F.element_at(F.split(t, r"[.!?\n:;]+", 2), 1)), lambda x: F.when(x != "", x).otherwise(F.left(t, F.lit(most))))
        whole = let(clean(first), lambda x: F.when(F.trim(x) == "", squash(F.left(t, F.lit(most)))).otherwise(x))
        few = let(whole, lambda x: let(words_of(x), lambda w: F.when(F.size(w) > 12, F.array_join(F.slice(w, 1, 12), " ")).otherwise(x)))
        return let(few, cut)

    return let(strip(text), guess)


def statement_area(heading: Column, body: Column, page: Column) -> Column:
    """C11."""
    h = F.lower(squash(heading))
    return let(F.trim(F.concat(h, F.lit(" "), F.lower(squash(body)))), lambda both: _area(nn(heading), h, both, page))


def _area(heading: Column, h: Column, both: Column, page: Column) -> Column:
    return (
        F.when(nn(heading).rlike(NOTE_HEADING) | starts_any(h, ("note ", "notes ")), "notes")
        .when(squash(heading).rlike(NUMBERED_NOTE), "notes")
        .when(both.rlike(PRIMARY_STATEMENT), "primary_statement")
        .when((page <= 2) & contains_any(both, FRONT_TERMS), "front_matter")
        .when(F.contains(both, F.lit("note")), "notes")
        .otherwise("other")
    )


def note_number(heading: Column) -> Column:
    """C13."""
    h = squash(heading)
    return F.when(F.startswith(F.lower(h), F.lit("notes to ")), "").otherwise(F.regexp_extract(h, NOTE_NUMBER, 1))


def chunk_type(lines: Column, heading: Column, strict: bool = False) -> Column:
    """C12, from squashed lines that are not empty."""
    few = F.slice(lines, 1, 4)
    return F.when((F.size(lines) == 0) & (nn(heading) != ""), "heading_block").when((F.size(lines) > 0) & F.forall(few, lambda x: is_tableish(x, strict)), "table_like").otherwise("narrative")


# tokens and phrases ----------------------------------------------------------------
def tokens(c: Column) -> Column:
    """Lower-case words, in order."""
    return F.regexp_extract_all(F.lower(nn(c)), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def label_tokens(c: Column) -> Column:
    return F.array_except(token_set(c), array_of(LABEL_STOPWORDS))


def hint_phrase(c: Column) -> Column:
    """The first six words that say something."""
    return F.array_join(F.slice(F.filter(tokens(c), lambda w: ~w.isin(*STOPWORDS, *WEAK)), 1, 6), " ")


def atomic_context(text: Column) -> Column:
    """C17."""
    return (
        F.when(nn(text).rlike(r"(?i)advances?\s+and\s+credits?\s+granted.*?directors?"), "advances and credits to directors")
        .when(nn(text).rlike(r"(?i)guarantees?\s+of\s+any\s+kind.*?directors?"), "guarantees on behalf of directors")
        .otherwise(hint_phrase(text))
    )


def atomic_label(leaf: Column, text: Column) -> Column:
    """C17: the leaf's words; "its x" and "any x" with what they refer to."""
    phrase, low = hint_phrase(leaf), F.lower(F.regexp_replace(strip(leaf), "[.;:]+$", ""))
    rest, context = hint_phrase(F.substring(low, 5, 1 << 30)), atomic_context(text)
    said = (context != "") & (rest != "")
    return (
        F.when(phrase == "", "")
        .when(F.startswith(low, F.lit("its ")) & said, F.concat(rest, F.lit(" of "), context))
        .when(F.startswith(low, F.lit("any ")) & said, F.concat(rest, F.lit(" for "), context))
        .otherwise(phrase)
    )


def truncate(c: Column, n: int) -> Column:
    """C18."""
    return let(strip(c), lambda t: _cut_to(t, n))


def _cut_to(t: Column, n: int) -> Column:
    return F.when(F.length(t) <= n, t).otherwise(F.concat(rstrip(F.left(t, F.lit(n - 1))), F.lit("…")))


def reason_text(c: Column, n: int) -> Column:
    """C19."""
    t = squash(c)
    return F.when(t != "", truncate(t, n))


# derived texts ---------------------------------------------------------------------
def _labelled(label: str, c: Column) -> Column:
    return F.when(nn(c) != "", F.concat(F.lit(f"{label}: "), c))


def item_embedding_text() -> Column:
    """P1, over the columns of an item."""
    c = F.col
    return strip(F.concat_ws("\n",
        F.concat(F.lit("Framework: "), nn(c("framework"))), F.concat(F.lit("Sheet: "), nn(c("sheet_name"))), _labelled("Section", c("section_path")),
        F.concat(F.lit("Requirement ID: "), nn(c("requirement_id"))), _labelled("Base Requirement ID", c("requirement_base_id")), _labelled("Clause Path", c("clause_path")),
        F.concat(F.lit("Requirement (full): "), nn(c("requirement_text"))), F.when(c("requirement_text_leaf") != c("requirement_text"), _labelled("Requirement (leaf)", c("requirement_text_leaf"))),
        _labelled("Notes", c("notes_text")), _labelled("Reference", c("reference_text")),
    ))


def item_retrieval_text(text: Column, leaf: Column) -> Column:
    """P2."""
    full, part = strip(text), strip(leaf)
    few = F.size(words_of(F.regexp_replace(part, "[.;:]+$", ""))) <= 5
    return (
        F.when((full == "") & (part == ""), "disclosure requirement")
        .when((part == "") | (part == full), F.when(full != "", full).otherwise(part))
        .when(few | starts_any(F.lower(part), GENERIC_LEAF), F.concat(F.lit("Requirement context: "), full, F.lit("\nFocus: "), part))
        .otherwise(part)
    )


def chunk_embedding_text() -> Column:
    """P3, over the columns of a chunk."""
    c = F.col
    return strip(F.concat_ws("\n",
        _labelled("Statement area", c("statement_area")), _labelled("Section title", c("section_title")), _labelled("Note number", c("note_number")), _labelled("Chunk type", c("chunk_type")),
        F.when(c("heading_guess") != c("section_title"), _labelled("Heading hint", c("heading_guess"))), F.concat(F.lit("Content: "), nn(c("text_redacted"))),
    ))


def chunk_search_text() -> Column:
    """P4, over the columns of a chunk."""
    parts = ("heading_guess", "section_title", "statement_area", "chunk_type", "note_number", "text_redacted")
    return strip(F.concat_ws(" ", *(F.when(strip(F.col(p)) != "", F.col(p)) for p in parts)))


def item_key(type_: Column, sheet: Column, id_: Column, text: Column) -> Column:
    """P6."""
    return F.sha2(F.concat_ws("||", *map(strip, (type_, sheet, id_, text))), 256)
