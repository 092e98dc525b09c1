"""C20: redaction of personal data, with numbered placeholders and an audit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, nn, strip

# What each kind looks like.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
NATIONAL_ID = r"(?i)\b[A-Z]{2}\d{6}[A-Z]?\b"
NAME_FIELD = r"\b(Name|Client|Prepared by|Reviewed by)\s*:\s*([A-Za-z][A-Za-z\s'.-]{1,80})"
CONTACT_FIELD = r"(?i)\b(Tel|Telephone|Phone|Mobile|Fax)\s*:\s*(\+?\d[\d\s().-]{6,}\d)\b"
#: in the order in which they are redacted: kind, pattern, whether the label before it stays
KINDS = (("EMAIL", EMAIL, False), ("ID", NATIONAL_ID, False), ("PERSON", NAME_FIELD, True), ("PHONE", CONTACT_FIELD, True))


def _numbered(text: Column, kind: str, pattern: str, labelled: bool) -> Column:
    """Each match becomes [KIND_n], n from 1 on: the parts between matches and the placeholders are zipped. text is used as it is, so it should be bound."""
    def join(parts: Column, labels: Column | None) -> Column:
        def piece(part: Column, i: Column) -> Column:
            mark = F.concat(F.lit(f"[{kind}_"), (i + 1).cast("string"), F.lit("]"))
            if labels is not None:
                mark = F.concat(F.try_element_at(labels, i + 1), F.lit(": "), mark)
            return F.when(i < F.size(parts) - 1, F.concat(part, mark)).otherwise(part)

        return F.array_join(F.transform(parts, piece), "")

    parts = F.split(text, pattern, -1)
    if not labelled:
        return let(parts, lambda p: join(p, None))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda found: let(parts, lambda p: join(p, found)))


def _audit(text: Column, kind: str, pattern: str, labelled: bool) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if labelled else 0))
    return F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(kind.lower()).alias("entity_type"), (strip(x) if labelled else x).alias("original_value"), F.concat(F.lit(f"[{kind}_"), (i + 1).cast("string"), F.lit("]")).alias("replacement_value")
        ),
    )


def _step(kind: str, pattern: str, labelled: bool):
    return lambda text: _numbered(text, kind, pattern, labelled)


def redact(text: Column) -> Column:
    """The redacted text; numbers start anew for every value."""
    out = nn(text)
    for kind, pattern, labelled in KINDS:
        out = let(out, _step(kind, pattern, labelled))
    return out


def audit(text: Column) -> Column:
    """array<struct<entity_type, original_value, replacement_value>>, kind by kind."""
    def rest(t: Column, k: int) -> Column:
        kind, pattern, labelled = KINDS[k]
        own = _audit(t, kind, pattern, labelled)
        return own if k + 1 == len(KINDS) else F.concat(own, let(_numbered(t, kind, pattern, labelled), lambda u: rest(u, k + 1)))

    return let(nn(text), lambda t: rest(t, 0))
