"""Verdicts of rules, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, verdict as V
from ..params import Params


def rollup_checks(checks: DataFrame, key: list[str], params: Params = Params()) -> DataFrame:
    """A1-A3 over rows of checks (key, status, kind, reason): status, coverage, counts, uniform_reason and counted explanation. All aggregates are partial before the shuffle."""
    weight = F.when(F.col("kind") == "supporting", 0.35).otherwise(1.0)
    score = F.when(F.col("status") == "fully_met", weight).when(F.col("status") == "partially_met", 0.5 * weight).otherwise(0.0)
    required = ~F.coalesce(F.col("kind") == "supporting", F.lit(False))
    reason = T.strip(F.col("reason"))
    is_ = lambda s: F.coalesce(F.col("status") == s, F.lit(False))
    got = checks.groupBy(*key).agg(
        F.count("*").alias("n_checks"), *(F.count_if(is_(s)).alias(n) for s, n in (("fully_met", "n_full"), ("partially_met", "n_partial"), ("missing", "n_missing"))),
        (F.sum(score) / F.greatest(F.sum(weight), F.lit(1e-9))).alias("coverage"), F.count_if(required).alias("n_required"),
        F.count_if(required & is_("fully_met")).alias("required_full"), F.count_if(required & is_("missing")).alias("required_missing"), F.min(reason).alias("r0"), F.max(reason).alias("r1"),
    )
    any_ = F.col("n_required") > 0
    asked, full, missing = (F.when(any_, F.col(a)).otherwise(F.col(b)) for a, b in (("n_required", "n_checks"), ("required_full", "n_full"), ("required_missing", "n_missing")))
    got = got.withColumns({"status": F.when(full == asked, "fully_met").when(missing == asked, "missing").otherwise("partially_met"), "uniform_reason": F.when((F.col("r0") == F.col("r1")) & (F.col("r0") != ""), F.col("r0"))})
    got = got.withColumn("explanation", V.counts_text(F.col("n_checks"), F.col("n_full"), F.col("n_partial"), F.col("n_missing"), F.col("r0"), params.row_explanation_chars))
    return got.select(*key, "status", "coverage", "n_checks", "n_full", "n_partial", "n_missing", "uniform_reason", "explanation")


def report_items(items: DataFrame, results: DataFrame, params: Params = Params()) -> DataFrame:
    """Every rule with its result, missing if there is none, in order of sheet and natural id."""
    joined = items.join(results.withColumn("_has", F.lit(True)), "item_key", "left")
    status = F.coalesce("status", F.lit("missing"))
    confidences = F.transform("check_results", lambda c: c["confidence"]) if "check_results" in joined.columns else F.lit(None).cast("array<double>")
    sim = F.col("similarity") if "similarity" in joined.columns else F.lit(None).cast("double")
    out = joined.withColumns({"status": status}).withColumn("needs_review", V.needs_review(F.col("status"), confidences, sim, params.review_threshold))
    return out.drop("_has").orderBy(F.lower("sheet_name"), V.natural_id(F.col("requirement_id")))


def summarize(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A5: total, missing, partial, and all the rest as fully met."""
    n = lambda s: F.count_if(F.col("status") == s)
    return report.groupBy(*(by or [])).agg(F.count("*").alias("total"), n("missing").alias("missing"), n("partially_met").alias("partial"), (F.count("*") - n("missing") - n("partially_met")).alias("fully_met"))


def valid_evidence(c) -> Column:
    """Entries with an id and a text; null if none is left."""
    kept = F.filter(c, lambda e: e.isNotNull() & e["chunkId"].isNotNull() & e["text"].isNotNull())
    return F.when(F.size(kept) > 0, kept)

