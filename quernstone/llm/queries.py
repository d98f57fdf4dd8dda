"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm import abuse, documentation, handwritten, leakage, mixing, splitting, syntax, vocabulary
from quernstone.operators.tables import LOCATED_SQL
from quernstone.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, sf_dir):
    return splitting.oversized_pieces(spark, sf_dir).select("id").distinct()


# the definition itself: bytes and lines of the chunk's range of its file
SQL["p1_found"] = rf"""
SELECT DISTINCT c.id FROM {LOCATED_SQL} c JOIN chunklimits l ON c.mode = l.mode
WHERE c.text <> '' AND (octet_length(encode(c.text)) > l.max_bytes OR length(c.text) - length(replace(c.text, chr(10), '')) - CASE WHEN ends_with(c.text, chr(10)) THEN 1 ELSE 0 END + 1 > l.max_lines)
"""


@query
def p1_pieces(spark, sf_dir):
    return splitting.oversized_pieces(spark, sf_dir)


@query
def p3_found(spark, sf_dir):
    """Chunks whose documentation tells something: their own, or, where it asks to inherit, that of the method they override."""
    return documentation.documented(spark, sf_dir).filter("source != 'inherited' or asked").select("id")


@query
def p3_pairs(spark, sf_dir):
    return documentation.pairs(spark, sf_dir)


@query
def p4_found(spark, sf_dir):
    return handwritten.classify(table(spark, sf_dir, "files")).filter(F.size("reasons") > 0).select("file_id")


@query
def p4_reasons(spark, sf_dir):
    reasons = handwritten.classify(table(spark, sf_dir, "files"))
    return reasons.select(F.explode_outer("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query
def p5_found(spark, sf_dir):
    return vocabulary.marked_terms(spark, sf_dir)


@query
def p5_terms(spark, sf_dir):
    return vocabulary.term_frequencies(spark, sf_dir)


SQL["p5_terms"] = r"""
WITH c AS (SELECT DISTINCT id, mode, ngrams FROM chunks WHERE id IS NOT NULL),
sizes AS (SELECT mode, count(DISTINCT id) AS n FROM c GROUP BY mode),
v AS (SELECT mode, token_id, lower(token) AS term FROM token_vocab WHERE token IS NOT NULL),
p AS (SELECT DISTINCT mode, token_id, doc_id, tf FROM token_postings WHERE tf > 0 AND doc_id IN (SELECT id FROM c)),
t AS (SELECT p.mode, 'token' AS kind, v.term, sum(p.tf) AS total, count(DISTINCT p.doc_id) AS chunks
      FROM p JOIN v ON p.mode = v.mode AND p.token_id = v.token_id GROUP BY p.mode, v.term),
g0 AS (SELECT id, mode, unnest(ngrams) AS g FROM c WHERE mode IS NOT NULL),
g1 AS (SELECT id, mode, trim(regexp_replace(g, '[\x01_\s]+', ' ', 'g')) AS term FROM g0 WHERE g IS NOT NULL),
g AS (SELECT mode, 'ngram' AS kind, term, count(*) AS total, count(DISTINCT id) AS chunks FROM g1 WHERE term <> '' GROUP BY mode, term),
a AS (SELECT * FROM t UNION ALL SELECT * FROM g)
SELECT a.mode, a.kind, a.term, CAST(a.total AS BIGINT) AS total, a.chunks, a.chunks <= 2 AS rare, a.chunks > 0.2 * s.n AS common
FROM a JOIN sizes s ON a.mode = s.mode
"""
SQL["p5_found"] = "SELECT mode, kind, term, 'rare' AS mark FROM (" + SQL["p5_terms"] + ") WHERE rare UNION ALL SELECT mode, kind, term, 'common' AS mark FROM (" + SQL["p5_terms"] + ") WHERE common"


@query
def p6_found(spark, sf_dir):
    return syntax.checked(table(spark, sf_dir, "files")).filter("error_line is not null").select("file_id").distinct()


@query
def p6_rates(spark, sf_dir):
    return syntax.rates(table(spark, sf_dir, "files"))


@query
def p7_found(spark, sf_dir):
    return leakage.leaked_pairs(spark, sf_dir).select("doc_id", "item_id")


@query
def p7_items(spark, sf_dir):
    return leakage.leaked_pairs(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("most_words"))


@query
def p8_mix(spark, sf_dir):
    return mixing.mixed_documents(spark, sf_dir)


@query
def p8_shares(spark, sf_dir):
    return mixing.mixed_shares(spark, sf_dir)


@query
def p9_found(spark, sf_dir):
    return abuse.scored_documents(spark, sf_dir).filter(F.col("score") >= abuse.CASE).select("doc_id")


@query
def p9_scores(spark, sf_dir):
    return abuse.scored_documents(spark, sf_dir)


@query
def p9_rates(spark, sf_dir):
    return abuse.rates(table(spark, sf_dir, "documents"))
