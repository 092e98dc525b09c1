"""What a person looks at before or after a run: nearest rows, summaries, previews and plain-text exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring as S, text as T
from ..functions.pii import audit, redact


def nearest(query: Sequence[float], vectors: DataFrame, rows: DataFrame, key: str, most: int = 8, vec: str = "vec") -> DataFrame:
    """Rows joined to their vectors by key, the ``most`` (one at least) most similar to the query, ties by key."""
    asked = S.unit(F.array(*(F.lit(float(x)) for x in query)))
    sims = vectors.select(key, S.dot(asked, S.unit(F.col(vec))).alias("similarity"))
    return rows.join(sims, key).orderBy(F.desc("similarity"), F.col(key)).limit(max(1, most))


def match_checklist_items(query: Sequence[float], items: DataFrame, embeddings: DataFrame, type_key: str, most: int = 8) -> DataFrame:
    """The items of one checklist nearest to a vector."""
    return nearest(query, embeddings, items.where(F.col("checklist_type_key") == type_key), "item_key", most, "rule_vec")


def match_chunks(query: Sequence[float], chunks: DataFrame, doc_id: str, most: int = 8) -> DataFrame:
    """The chunks of one document nearest to a vector."""
    own = chunks.where(F.col("doc_id") == doc_id)
    return nearest(query, own.select("chunk_id", "vec"), own.drop("vec"), "chunk_id", most)


def of_sheets(items: DataFrame, sheets: Sequence[str] = ()) -> DataFrame:
    """items of the sheets named, without regard to case; all if none is named."""
    names = sorted({s.strip().lower() for s in sheets if s.strip()})
    return items if not sheets else items.where(F.lower("sheet_name").isin(names))


def most_common(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """How often each value is met, the most frequent first, ties by value."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column))
    return counted if most is None else counted.limit(most)


def type_keys(items: DataFrame) -> DataFrame:
    """X5."""
    return items.select("checklist_type_key").distinct().orderBy("checklist_type_key")


def pii_preview(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S20, A10 over pages (doc_id, page_number, text): redacted pages (doc_id, page_number, block), audit rows, and for each document its
    pages, those with text, the average characters of these (0.0 if there are none) and the replacements."""
    text = T.nn(F.col("text"))
    seen = pages.select("doc_id", "page_number", text.alias("text"), audit(text).alias("found"))
    blocks = pages.select("doc_id", "page_number", F.concat(F.lit("===== Page "), F.col("page_number").cast("string"), F.lit(" =====\n"), redact(text), F.lit("\n")).alias("block"))
    rows = seen.select("doc_id", F.col("page_number").alias("pageNumber"), F.explode("found").alias("a"))
    rows = rows.select("doc_id", "pageNumber", F.col("a.entity_type").alias("entityType"), F.col("a.original_value").alias("originalValue"), F.col("a.replacement_value").alias("replacementValue"))
    full = T.strip(F.col("text")) != ""
    stats = seen.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(full).alias("pages_with_text"), F.coalesce(F.avg(F.when(full, F.length("text"))), F.lit(0.0)).alias("average_chars"), F.sum(F.size("found")).alias("replacements"))
    return blocks, rows, stats


def write_pii_preview(pages: DataFrame, path: str) -> None:
    """The redacted pages as text and the audit as JSON, a folder each, documents in folders of their own."""
    blocks, rows, _ = pii_preview(pages)
    order = ["doc_id", "page_number"]
    blocks.repartition("doc_id").sortWithinPartitions(*order).select("doc_id", "block").write.partitionBy("doc_id").mode("overwrite").text(f"{path}/redacted")
    rows.repartition("doc_id").write.partitionBy("doc_id").mode("overwrite").json(f"{path}/audit")


def _or_none(name: str) -> Column:
    return F.when(T.nn(F.col(name)) != "", F.col(name)).otherwise("[none]")


def item_text() -> Column:
    """An item as a block of a text file."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    return F.concat_ws(
        "\n", F.lit("=" * 80), line("Framework", T.nn(F.col("framework"))), line("Sheet", T.nn(F.col("sheet_name"))), line("Section", _or_none("section_path")), line("Requirement ID", T.nn(F.col("requirement_id"))),
        line("Reference", _or_none("reference_text")), line("Requirement", T.nn(F.col("requirement_text"))), F.concat(F.lit("Embedding text:\n"), T.item_embedding_text(), F.lit("\n")),
    )


def preview(items: DataFrame, most: int = 20) -> DataFrame:
    """The first items in the order of their sheets."""
    columns = [F.col("requirement_id").alias("ID"), F.col("sheet_name").alias("Sheet"), _or_none("section_path").alias("Section"), _or_none("reference_text").alias("Reference"), F.col("requirement_text").alias("Text")]
    return items.orderBy("source_workbook", "seq").limit(most).select(*columns)
