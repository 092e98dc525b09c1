"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .store import Scratch, read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2, ids=False)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_groups

    return near_groups(read_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grammar import read_token_files, write_token_files

    scratch = Scratch(spark, "op9")
    path = scratch.path("tokens")
    write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), 0, 50257)
    return read_token_files(spark, path, scratch)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition_rules

    return repetition_rules(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_toxicity(docs, train(docs, labels, Scratch(spark, "op6")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(read_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_quality(docs, train(docs, labels, Scratch(spark, "op8")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_ngram_jaccard, op3_sentencepiece, op4_substring_dedup, op5_exact_dedup,
        op6_toxicity, op7_license_scan, op8_quality_classifier, op9_token_output, op10_quality_rules,
    )
}

ORACLES: dict[str, str] = {}
ORACLES["op5_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""
