"""The queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: F12 of a squashed line, in DuckDB's SQL.
HEADING = r"""CASE WHEN line = '' OR regexp_matches(line, '^\d{1,3}$') OR regexp_matches(line, '^(?:\d{4}\s+){1,3}\d{4}$') OR len(string_split(line, ' ')) > 12 OR NOT regexp_matches(line, '\p{L}') THEN false
WHEN regexp_matches(line, '(?i)^(note|notes)\s+[a-z0-9]+') OR regexp_matches(line, '^\d+\s+[A-Za-z]') OR regexp_matches(line, '^(?:\d+(?:\.\d+)*|[A-Z])[).\-:]\s+\S') THEN true
WHEN regexp_matches(line, '\d') AND len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '\p{L}'))) <= 1 THEN false
ELSE (upper(line) = line AND regexp_matches(line, '\p{Lu}') AND len(string_split(line, ' ')) <= 10 AND NOT regexp_matches(line, '\d')) OR line LIKE '%:'
 OR (len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '^\p{Lu}'))) >= greatest(1, len(string_split(line, ' ')) - 1) AND NOT regexp_matches(line, '\d') AND NOT regexp_matches(line, '[.;]$')) END"""
