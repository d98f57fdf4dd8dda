"""What chunks of source call, use, import and branch on, read from their text by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernstone.operators import tables
from quernstone.runtime import stored

# Patterns over source text. Group 1 is the name where there is one.
CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("
USE = r"([a-z_][A-Za-z0-9_]*)\.[A-Za-z_]"
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "match", "elif", "def", "func", "fn", "constructor", "sizeof", "super")
IMPORT = r"(?m)(?:(?:from\s+|import\s+|require\(|#include\s+)[\"'<]|^from\s+|^use\s+)([\w./@:-]+)"
BRANCH, LOOP, BREAK, CONTINUE = r"\b(if|switch|match|case)\b", r"\b(for|while|loop)\b", r"\b(break)\b", r"\b(continue)\b"


def names(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def calls(text: Column) -> Column:
    """Distinct names that are called, sorted; keywords before brackets are no calls."""
    return F.filter(names(text, CALL), lambda c: ~c.isin(*NOT_CALLS))


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def imports(content: Column) -> Column:
    """Distinct modules a file imports, sorted."""
    return names(content, IMPORT)


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located chunks with calls, usages and imports, control-flow counts, visibility and async flag; made once for all queries."""
    def build():
        c = tables.located(spark, sf_dir)
        signature = F.coalesce(F.col("docmeta.signature"), F.lit(""))
        return c.select(
            "*", calls(F.col("text")).alias("calls"), names(F.col("text"), USE).alias("usages"),
            count(F.col("text"), BRANCH).alias("branches"), count(F.col("text"), LOOP).alias("loops"), count(F.col("text"), BREAK).alias("breaks"), count(F.col("text"), CONTINUE).alias("continues"),
            F.when(signature.rlike("^(export|pub)"), "public").when(F.col("name").startswith("_"), "private").alias("visibility"),
            signature.rlike(r"\basync\b").alias("is_async"),
        )
    return stored(spark, sf_dir, "related", ("chunks", "files"), build)


def _sql_names(text: str, pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}', 1)))"


RELATED_SQL = f"""(SELECT *, list_filter({_sql_names('text', CALL)}, lambda c: c NOT IN ({", ".join(f"'{w}'" for w in NOT_CALLS)})) AS calls, {_sql_names('text', USE)} AS usages, {_sql_names('content', IMPORT)} AS imports,
len(regexp_extract_all(text, '{BRANCH}')) AS branches, len(regexp_extract_all(text, '{LOOP}')) AS loops, len(regexp_extract_all(text, '{BREAK}')) AS breaks, len(regexp_extract_all(text, '{CONTINUE}')) AS continues,
CASE WHEN regexp_matches(coalesce(docmeta.signature, ''), '^(export|pub)') THEN 'public' WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'private' END AS visibility,
regexp_matches(coalesce(docmeta.signature, ''), '\\basync\\b') AS is_async FROM {tables.LOCATED_SQL})"""
