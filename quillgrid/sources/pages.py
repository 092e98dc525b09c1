"""Pages of documents. Extraction from PDF is a provider's matter; tables of pages are read as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import PAGES

#: bytes of a file -> texts of its pages
Extractor = Callable[[bytes], list[str]]


def plain_text_pages(content: bytes) -> list[str]:
    """Pages of a text file, parted by form feeds."""
    return [p.strip() for p in content.decode("utf-8", "replace").split("\f")]


def extract_pages(files: DataFrame, extractor: Extractor = plain_text_pages) -> DataFrame:
    """(path, content) -> (doc_id, page_number, text), pages from 1 on."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                pages = extractor(f.content)
                yield pd.DataFrame({"doc_id": f.path, "page_number": range(1, len(pages) + 1), "text": [p.strip() for p in pages]})

    return files.select("path", "content").mapInPandas(work, PAGES)


def read_pages(spark: SparkSession, root: str, glob: str = "*.txt", extractor: Extractor = plain_text_pages) -> DataFrame:
    return extract_pages(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root), extractor)


def pages_of_table(documents: DataFrame, doc_id: str, text: str, page_number: str | None = None) -> DataFrame:
    number = F.col(page_number).cast("int") if page_number else F.lit(1)
    return documents.select(F.col(doc_id).cast("string").alias("doc_id"), number.alias("page_number"), F.col(text).alias("text"))
