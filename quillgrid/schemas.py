"""Tables, their keys, and the sets of values that a column may have."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAGES = "doc_id string, page_number int, text string"
RAW_ROWS = "workbook string, sheet_idx int, sheet string, row_idx int, first string, second string, third string, cells array<string>"
ITEMS = (
    "source_workbook string, framework string, sheet_name string, section_path string, requirement_id string, requirement_text string, "
    "reference_text string, requirement_base_id string, clause_path string, requirement_text_leaf string, notes_text string, item_kind string"
)
CHECK = "struct<check_id:string,label:string,kind:string>"
CHECK_RESULT = "struct<checkId:string,label:string,kind:string,status:string,reason:string,confidence:double,selectedChunkIds:array<string>,evidenceSnippet:string>"
EVIDENCE = "struct<chunkId:string,pageNumber:int,similarity:double,text:string>"
STATUSES = ("fully_met", "partially_met", "missing")
STEPS = ("ingestion", "embedding", "matching", "reporting")

#: key columns of every table, and (child column, parent table, parent column)
KEYS = {
    "checklist_types": ["type_key"], "checklist_items": ["item_key"], "checklist_item_embeddings": ["item_key"], "analyses": ["analysis_id"],
    "analysis_documents": ["document_id"], "analysis_chunks": ["analysis_id", "chunk_index"], "analysis_chunk_embeddings": ["chunk_id"], "analysis_results": ["analysis_id", "item_key"],
}
REFERENCES = {
    "checklist_items": [("checklist_type_key", "checklist_types", "type_key")], "checklist_item_embeddings": [("item_key", "checklist_items", "item_key")],
    "analysis_chunks": [("analysis_id", "analyses", "analysis_id")], "analysis_results": [("analysis_id", "analyses", "analysis_id"), ("item_key", "checklist_items", "item_key")],
}


def repeated_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*KEYS[table]).count().where("count > 1")


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Rows of child without a parent."""
    return child.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")
