"""Filters and boolean queries over chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import relations, tables
from quernstone.operators.relations import RELATED_SQL
from quernstone.operators.tables import CHUNKS_SQL, LOCATED_SQL
from quernstone.plans import filters as P, query as Q
from quernstone.queries import query
from quernstone.queries.text import lower_split_sql
from quernstone.runtime import table

_NORMAL = "regexp_replace(regexp_replace(trim(file), '[\\\\]+', '/', 'g'), '^(\\.?/)+', '')"


def _chunks(spark, sf_dir, *columns):
    return tables.chunks(spark, sf_dir, *columns)


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE lower({_NORMAL}) LIKE '%graph/%' OR regexp_matches(file, '(?i)LEASE.*\\.py')")
def f01_file(spark, sf_dir):
    return _chunks(spark, sf_dir, "file").filter(P.path_matches(F.col("file"), ["graph/", "/LEASE.*\\.py/i"])).select("id")


@query(sql=rf"""SELECT id FROM (SELECT id, lower(trim(ext)) AS e, '.' || lower(regexp_extract(trim(file), '\.([^./\\]+)$', 1)) AS x FROM {CHUNKS_SQL})
WHERE (CASE WHEN e IS NULL OR e = '' THEN x WHEN starts_with(e, '.') THEN e ELSE '.' || e END) IN ('.py', '.rs')""")
def f02_ext(spark, sf_dir):
    return _chunks(spark, sf_dir, "file", "ext").filter(P.ext_matches(F.col("ext"), F.col("file"), ["*.py", "RS"])).select("id")


@query(sql=f"SELECT id FROM {LOCATED_SQL} WHERE coalesce(CASE lower(trim(lang)) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'clike' ELSE lower(trim(lang)) END, 'unknown') IN ('python', 'clike', 'unknown')")
def f03_lang(spark, sf_dir):
    return tables.located(spark, sf_dir).filter(P.lang_matches(F.col("lang"), ["py", "C++", "unknown"])).select("id")


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE lower(kind) IN ('function', 'fn')")
def f04_kind(spark, sf_dir):
    return _chunks(spark, sf_dir, "kind").filter(P._true(F.lower("kind").isin("function", "fn"))).select("id")


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE lower(last_author) LIKE '%tolv%' OR lower(last_author) LIKE '%quill%'")
def f05_author(spark, sf_dir):
    """Author, and chunk author, which falls back to it."""
    return _chunks(spark, sf_dir, "last_author").filter(P.contains_any(F.col("last_author"), ["TOLV", "quill"])).select("id")


@query(sql=f"SELECT id, name FROM {RELATED_SQL} WHERE list_contains(imports, 'log') OR list_contains(imports, 'stdio.h')")
def f07_import(spark, sf_dir):
    r = relations.related(spark, sf_dir)
    return r.filter(P.has_member(F.col("imports"), ["log", "stdio.h"], fold=False)).select("id", "name")


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE churn >= 20")
def f09_churn(spark, sf_dir):
    return _chunks(spark, sf_dir, "churn").filter(P._true(F.col("churn") >= 20)).select("id")


@query(sql=f"SELECT id FROM {RELATED_SQL} WHERE list_has_any(list_transform(calls, lambda c: lower(c)), ['report', 'len'])")
def f10_calls(spark, sf_dir):
    return relations.related(spark, sf_dir).filter(P.has_member(F.col("calls"), ["report", "LEN"])).select("id")


@query(sql=f"SELECT id FROM {RELATED_SQL} WHERE list_has_any(usages, ['log', 'logger'])")
def f11_uses(spark, sf_dir):
    return relations.related(spark, sf_dir).filter(P.has_member(F.col("usages"), ["log", "logger"], fold=False)).select("id")


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE contains(docmeta.signature, 'async def')")
def f12_signature(spark, sf_dir):
    return _chunks(spark, sf_dir, "docmeta").filter(P._true(F.col("docmeta.signature").contains("async def"))).select("id")


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE list_has_any(docmeta.params, ['graph', 'lease'])")
def f13_param(spark, sf_dir):
    return _chunks(spark, sf_dir, "docmeta").filter(P.has_member(F.col("docmeta.params"), ["graph", "lease"], fold=False)).select("id")


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE len(list_filter(ngrams, lambda g: contains(lower(g), 'merge'))) > 0")
def f14_list_contains(spark, sf_dir):
    """An entry of a list that contains a text: decorators, throws, awaits, reads, writes, types, extends."""
    return _chunks(spark, sf_dir, "ngrams").filter(P.list_contains(F.col("ngrams"), ["MERGE"])).select("id")


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE contains(lower(docmeta.returnType), 'num')")
def f16_return_type(spark, sf_dir):
    return _chunks(spark, sf_dir, "docmeta").filter(P.contains_any(F.col("docmeta.returnType"), ["NUM"])).select("id")


@query(sql=f"SELECT id, branches, loops FROM {RELATED_SQL} WHERE branches >= 2 AND loops >= 1")
def f20_control_flow(spark, sf_dir):
    r = relations.related(spark, sf_dir)
    return r.filter("branches >= 2 and loops >= 1").select("id", F.col("branches").cast("long").alias("branches"), F.col("loops").cast("long").alias("loops"))


@query(sql=f"SELECT id FROM {RELATED_SQL} WHERE visibility = 'public' AND (is_async OR docmeta.returns)")
def f21_visibility_and_flags(spark, sf_dir):
    """Visibility, async and returns flags."""
    r = relations.related(spark, sf_dir)
    return r.filter(P.contains_any(F.col("visibility"), ["public"]) & P._true(F.coalesce(F.col("is_async"), F.lit(False)) | F.coalesce(F.col("docmeta.returns"), F.lit(False)))).select("id")


@query(sql=f"""SELECT id, t AS modified FROM (SELECT id, CASE WHEN regexp_matches(trim(last_modified), '^[0-9]{{9,10}}$') THEN to_timestamp(CAST(trim(last_modified) AS BIGINT)) AT TIME ZONE 'UTC'
WHEN regexp_matches(trim(last_modified), '^[0-9]{{12,13}}$') THEN epoch_ms(CAST(trim(last_modified) AS BIGINT))
ELSE TRY_CAST(regexp_replace(regexp_replace(trim(last_modified), 'Z$', '+00:00'), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}) ([0-9]{{2}}:[0-9]{{2}})$', '\\1T\\2:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS t FROM {CHUNKS_SQL})
WHERE t >= greatest(TIMESTAMP '2033-10-01 00:00:00', TIMESTAMP '2034-02-01 00:00:00' - INTERVAL 90 DAY)""")
def f24_modified(spark, sf_dir):
    """Modified after a date and within days of a fixed now; dates come in mixed forms."""
    c = _chunks(spark, sf_dir, "last_modified").withColumn("modified", P.parsed_time(F.col("last_modified")))
    return c.filter(P.modified(F.col("modified"), "2033-10-01", 90, F.lit("2034-02-01").cast("timestamp"))).select("id", F.col("modified").cast("timestamp_ntz").alias("modified"))


@query(sql="SELECT DISTINCT rec_id FROM generic WHERE json_valid(payload) AND contains(lower(json_extract_string(payload, '$.vuln.severity')), 'high')")
def f25_record_meta(spark, sf_dir):
    """A dotted path of a record that contains a text."""
    g = table(spark, sf_dir, "generic").filter("rec_id is not null")
    return g.filter(P.meta_matches(F.col("payload"), "vuln.severity", "HIGH")).select("rec_id").distinct()


@query(sql=f"SELECT id FROM (SELECT id, {lower_split_sql('name')} AS t, list_transform(coalesce(ngrams, []), lambda g: regexp_replace(g, '[\\x01_]+', ' ', 'g')) AS g FROM {CHUNKS_SQL} WHERE name IS NOT NULL) WHERE NOT list_has_any(t, ['graph', 'lease']) AND NOT list_contains(g, 'the next')")
def f26_excluded(spark, sf_dir):
    c = _chunks(spark, sf_dir, "name", "ngrams").filter("name is not null")
    grams = F.transform(F.coalesce("ngrams", F.array().cast("array<string>")), lambda g: F.regexp_replace(g, r"[\x01_]+", " "))
    excluded = F.arrays_overlap(X.split_identifier(F.col("name")), F.array(F.lit("graph"), F.lit("lease"))) | F.array_contains(grams, "the next")
    return c.filter(~excluded).select("id")


@query(sql=rf"""SELECT id FROM {LOCATED_SQL} WHERE contains(lower(regexp_replace(regexp_replace(trim(file), '[\\]+', '/', 'g'), '^(\.?/)+', '')), 'src/') AND lower(kind) IN ('function', 'func')
AND coalesce(CASE lower(trim(lang)) WHEN 'py' THEN 'python' ELSE lower(trim(lang)) END, 'unknown') IN ('python', 'go')""")
def f27_expression(spark, sf_dir):
    parsed = P.parse_expression("path:src/ lang=py,go type:function,func")
    c = tables.located(spark, sf_dir)
    return c.filter(P.expression_condition(parsed, file=F.col("file"), ext=F.col("ext"), lang=F.col("lang"), kind=F.col("kind"))).select("id")


@query(sql="SELECT id FROM chunks WHERE false")
def f28_impossible(spark, sf_dir):
    """Filters that exclude each other give no rows, and a plan without a scan."""
    a, b = P.parse_expression("lang:python"), P.parse_expression("lang:go")
    c = _chunks(spark, sf_dir, "file", "ext", "kind").withColumn("lang", F.lit(None).cast("string"))
    return c.filter(P.expression_condition(a, file=F.col("file"), ext=F.col("ext"), lang=F.col("lang"), kind=F.col("kind"), more=b)).select("id")


QUERY = '(graph or "never blocks") and -retry the'


@query(sql=f"""SELECT id FROM (SELECT id, list_concat({lower_split_sql("coalesce(name, '')")}, {lower_split_sql("coalesce(docmeta.doc, '')")}) AS t, list_transform(coalesce(ngrams, []), lambda g: regexp_replace(g, '[\\x01_]+', ' ', 'g')) AS g FROM {CHUNKS_SQL})
WHERE (list_contains(t, 'graph') OR list_contains(g, 'never blocks')) AND NOT list_contains(t, 'retry') AND list_contains(t, 'the')""")
def q06_boolean_query(spark, sf_dir):
    """A boolean query as a condition over tokens and n-grams (Q1-Q6)."""
    c = _chunks(spark, sf_dir, "name", "docmeta", "ngrams")
    tokens = F.concat(X.split_identifier(F.coalesce("name", F.lit(""))), X.split_identifier(F.coalesce("docmeta.doc", F.lit(""))))
    grams = F.transform(F.coalesce("ngrams", F.array().cast("array<string>")), lambda g: F.regexp_replace(g, r"[\x01_]+", " "))
    t = c.select("id", tokens.alias("t"), grams.alias("g"))
    return t.filter(Q.condition(Q.plan(QUERY).tree, F.col("t"), F.col("g"))).select("id")


@query(sql=f"SELECT id, array_to_string(calls, ',') AS calls, array_to_string(usages, ',') AS usages, branches, loops FROM {RELATED_SQL} WHERE text <> ''")
def t32_control_flow_counts(spark, sf_dir):
    """Calls, usages and control-flow counts of every chunk."""
    r = relations.related(spark, sf_dir).filter("text != ''")
    return r.select("id", F.array_join("calls", ",").alias("calls"), F.array_join("usages", ",").alias("usages"), F.col("branches").cast("long").alias("branches"), F.col("loops").cast("long").alias("loops"))


@query(sql=f"SELECT kind, visibility, count(*) AS chunks, CAST(sum(CASE WHEN docmeta.doc IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS documented, CAST(sum(len(calls)) AS BIGINT) AS calls FROM {RELATED_SQL} GROUP BY kind, visibility")
def t33_chunk_metadata(spark, sf_dir):
    r = relations.related(spark, sf_dir)
    return r.groupBy("kind", "visibility").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("docmeta.doc").isNotNull().cast("long")).alias("documented"), F.sum(F.size("calls").cast("long")).alias("calls"))
