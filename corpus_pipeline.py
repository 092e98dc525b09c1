"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm.exact import drop_copies
from quillgrid.llm.jaccard import drop_near_copies
from quillgrid.llm.packing import pack
from quillgrid.llm.quality import keep_good, train
from quillgrid.llm.queries import tokenizer_path
from quillgrid.llm.store import Scratch, read_table
from quillgrid.llm.substring import cut_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of documents that are here."""
    return keep_good(docs, train(docs, read_table(spark, sf_dir, "labels"), Scratch(spark, "stage-quality")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one with the largest doc_id stays."""
    return drop_copies(docs, Scratch(spark, "stage-exact"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows joined by links of similarity 3/4 or more, the one with the least doc_id stays."""
    return drop_near_copies(docs, Scratch(spark, "stage-near"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that are met elsewhere among the documents still here go from the texts; every document stays."""
    return cut_repeats(docs, Scratch(spark, "stage-substring"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("substring", substring_stage), ("packing", packing_stage)]

#: Trained models and tokenisers are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before kept, each written to the shared folder and read again.

    Null texts count as empty: the classifier scores them, the exact stage keeps one of them, and they get one piece with just the end id. Rows with
    null or repeated ids are rows of their own. All but the last stage give back the columns of documents, further ones included. Empty tables give an
    empty table.
    """
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
