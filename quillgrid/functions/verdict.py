"""Judgements, checks and explanations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import CHECK
from .text import nn, reason_text, starts_any, strip, truncate

# Messages of explanations.
NO_EVIDENCE = "No document passages matched the rule keyword filter."
NOT_JUDGED = "Automatic evaluation failed (upstream error)."
BAD_JUDGEMENT = "The model returned an invalid or empty judgment."
UNSUPPORTED = "The excerpts do not support this atomic check."
KEYWORDS_MISSED = "Keyword shortlist missed; fallback retrieval used. "
GENERIC_CHECKS = ("verify", "check", "ensure", "confirm")


def clamp_confidence(c: Column) -> Column:
    """Within 0 and 1; what is no number is null."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def parse_judgement(raw: Column, reason_chars: int = 320) -> Column:
    """struct<status, reason, confidence> of a JSON object; all null unless the status is known."""
    body = F.from_json(F.when(strip(raw).startswith("{"), strip(raw)), "status string, reason string, confidence string", {"mode": "PERMISSIVE"})
    word = F.upper(strip(body["status"]))
    status = F.when(word == "FULLY", "fully_met").when(word == "PARTIAL", "partially_met").when(word == "NONE", "missing")
    known = status.isNotNull()
    return F.struct(status.alias("status"), F.when(known, reason_text(body["reason"], reason_chars)).alias("reason"), F.when(known, clamp_confidence(body["confidence"])).alias("confidence"))


def check_prompt(requirement: Column, label: Column) -> Column:
    """What a judge is asked: a check in the context of its requirement."""
    context = F.when(strip(requirement) != "", truncate(requirement, 220)).otherwise(nn(requirement))
    return F.concat(F.lit("Row context: "), context, F.lit("\nAtomic check: "), label, F.lit("\nJudge only this atomic check against the evidence."))


def _kind(c: Column) -> Column:
    k = F.lower(strip(c))
    return F.when(k.isin("required", "supporting"), k).otherwise("required")


def _first_by(checks: Column, key) -> Column:
    """Checks without those whose key an earlier one has."""
    keys = F.transform(checks, key)
    return F.filter(checks, lambda c, i: F.array_position(keys, key(c)) == i + 1)


def tidy_checks(checks: Column, most: int = 4) -> Column:
    """Trimmed labels, distinct without regard to case, ids from the place in the list, at most ``most``."""
    made = F.transform(
        F.coalesce(checks, F.array().cast(f"array<{CHECK}>")),
        lambda c, i: F.struct(F.when(strip(c["check_id"]) != "", strip(c["check_id"])).otherwise(F.concat(F.lit("c"), (i + 1).cast("string"))).alias("check_id"), strip(c["label"]).alias("label"), _kind(c["kind"]).alias("kind")),
    )
    return F.slice(_first_by(F.filter(made, lambda c: c["label"] != ""), lambda c: F.lower(c["label"])), 1, most)


def drop_weak_checks(checks: Column) -> Column:
    """without checks that only ask to check something."""
    low = lambda c: F.lower(strip(c["label"]))
    has = lambda c, t: F.contains(low(c), F.lit(t))
    good = F.filter(checks, lambda c: (low(c) != "") & ~starts_any(low(c), GENERIC_CHECKS) & ~has(c, "correct financial year") & ~(has(c, "qualifies for") & has(c, "exemption")))
    return _first_by(good, low)


def checks_or_default(checks: Column, requirement: Column) -> Column:
    """The requirement itself is the check if there is none."""
    made = F.filter(
        F.transform(
            F.coalesce(checks, F.array().cast(f"array<{CHECK}>")),
            lambda c, i: F.struct(F.when(strip(c["check_id"]) != "", strip(c["check_id"])).otherwise(F.concat(F.lit("c"), (i + 1).cast("string"))).alias("check_id"), strip(c["label"]).alias("label"), _kind(c["kind"]).alias("kind")),
        ),
        lambda c: c["label"] != "",
    )
    label = F.when(strip(requirement) != "", strip(requirement)).otherwise("Disclosure requirement")
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.struct(F.lit("c1").alias("check_id"), label.alias("label"), F.lit("required").alias("kind"))))


def rule_status(statuses: Column, kinds: Column) -> Column:
    """A1 over arrays: struct<status, coverage>."""
    pairs = F.arrays_zip(statuses.alias("s"), kinds.alias("k"))
    weight = lambda p: F.when(p["k"] == "supporting", 0.35).otherwise(1.0)
    score = lambda p: F.when(p["s"] == "fully_met", weight(p)).when(p["s"] == "partially_met", 0.5 * weight(p)).otherwise(0.0)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + weight(p))
    coverage = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + score(p)) / F.greatest(total, F.lit(1e-9))
    required = F.filter(pairs, lambda p: ~F.coalesce(p["k"] == "supporting", F.lit(False)))
    asked = F.when(F.size(required) > 0, required).otherwise(pairs)
    status = F.when(F.forall(asked, lambda p: p["s"] == "fully_met"), "fully_met").when(F.forall(asked, lambda p: p["s"] == "missing"), "missing").otherwise("partially_met")
    return F.when(F.size(pairs) == 0, F.struct(F.lit("missing").alias("status"), F.lit(0.0).alias("coverage"))).otherwise(F.struct(status.alias("status"), coverage.alias("coverage")))


def counts_text(total: Column, full: Column, partial: Column, missing: Column, only_reason: Column, most: int = 256) -> Column:
    """A2: what the checks of a rule came to, in words."""
    s = lambda c: c.cast("string")
    parts = F.concat_ws(", ", F.when(full > 0, F.concat(s(full), F.lit(" met"))), F.when(partial > 0, F.concat(s(partial), F.lit(" partial"))), F.when(missing > 0, F.concat(s(missing), F.lit(" missing"))))
    text = (
        F.when(full == total, F.concat(F.lit("All "), s(total), F.lit(" atomic checks matched.")))
        .when(missing == total, F.concat(F.lit("All "), s(total), F.lit(" atomic checks missing.")))
        .otherwise(F.concat(parts, F.lit(" out of "), s(total), F.lit(" checks.")))
    )
    reason = strip(only_reason)
    return F.when(total == 0, F.lit(None).cast("string")).when(total == 1, F.when(reason != "", truncate(reason, most))).otherwise(truncate(text, most))


def row_explanation(has_evidence: Column, lexical_miss: Column, uniform: Column, counted: Column) -> Column:
    """A4; uniform: the reason that all checks share, or null."""
    return (
        F.when(~has_evidence, NO_EVIDENCE).when(nn(uniform) != "", uniform).when(lexical_miss & counted.isNotNull(), F.concat(F.lit(KEYWORDS_MISSED), counted)).otherwise(counted)
    )


def needs_review(status: Column, confidences: Column, similarity: Column, threshold: float = 0.72) -> Column:
    """F17."""
    known = F.filter(F.coalesce(confidences, F.array().cast("array<double>")), lambda x: x.isNotNull())
    return (
        F.when(status == "missing", True).when(F.size(known) > 0, F.array_min(known) < threshold).when(status == "partially_met", True).otherwise(F.coalesce(similarity, F.lit(0.0)) < 0.55)
    )


def natural_id(c: Column) -> Column:
    """array<struct<tag, num, word>>; arrays compare entry by entry, the shorter first."""
    parts = F.regexp_extract_all(F.lower(strip(c)), F.lit(r"[a-z]+\d*|\d+|\([a-z0-9]+\)"), F.lit(0))
    return F.transform(
        parts,
        lambda t: F.struct(
            F.when(F.startswith(t, F.lit("(")), 1).when(t.rlike(r"^\d+$"), 0).otherwise(2).alias("tag"), F.coalesce(F.when(t.rlike(r"^\d+$"), t).try_cast("decimal(38,0)"), F.lit(0)).alias("num"), F.when(t.rlike(r"^\d+$"), "").otherwise(t).alias("word")
        ),
    )
