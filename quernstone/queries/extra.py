"""Stems, local and passed types, the job queue, snapshots and generated queries."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.functions import stem
from quernstone.operators import tables
from quernstone.operators.snapshots import Snapshots
from quernstone.operators.tables import LOCATED_SQL
from quernstone.plans import query as Q
from quernstone.queries import query
from quernstone.runtime import shared_dir, table


@query
def t06_stems(spark, sf_dir):
    """Stems of the vocabulary."""
    return stem.stemmed(table(spark, sf_dir, "token_vocab").filter("token is not null").select(F.lower("token").alias("token")).distinct())


_PARAM = r"([A-Za-z_][A-Za-z0-9_]*)\??: ([A-Za-z_&][A-Za-z0-9_.\[\]<>&]*)"


@query(sql=f"SELECT id, unnest(regexp_extract_all(docmeta.signature, '{_PARAM}', 1)) AS name, unnest(regexp_extract_all(docmeta.signature, '{_PARAM}', 2)) AS type FROM {tables.CHUNKS_SQL} WHERE docmeta.signature IS NOT NULL")
def g16_local_types(spark, sf_dir):
    """Types that signatures declare for their parameters."""
    c = tables.chunks(spark, sf_dir, "docmeta").filter("docmeta.signature is not null")
    both = F.arrays_zip(F.regexp_extract_all("docmeta.signature", F.lit(_PARAM), F.lit(1)).alias("name"), F.regexp_extract_all("docmeta.signature", F.lit(_PARAM), F.lit(2)).alias("type"))
    return c.select("id", F.explode(both).alias("p")).select("id", "p.name", "p.type")


_CALL = r"([A-Za-z_]\w*)\(([^()]*)\)"
_TYPE = "CASE WHEN regexp_matches(arg, '^[\"'']') THEN 'string' WHEN regexp_matches(arg, '^-?[0-9]') THEN 'number' WHEN arg IN ('true', 'false') THEN 'boolean' END"


@query(sql=f"""WITH l AS (SELECT * FROM {LOCATED_SQL}), s AS (SELECT repo, name, min(id) AS id, min(path) AS path FROM l WHERE name IS NOT NULL AND docmeta.params IS NOT NULL GROUP BY repo, name HAVING count(*) = 1),
k AS (SELECT repo, path, unnest(regexp_extract_all(text, '{_CALL}', 1)) AS name, unnest(regexp_extract_all(text, '{_CALL}', 2)) AS args FROM l WHERE text IS NOT NULL),
a AS (SELECT s.id, k.path = s.path AS same, generate_subscripts(string_split(k.args, ','), 1) - 1 AS pos, trim(unnest(string_split(k.args, ','))) AS arg FROM k JOIN s ON k.repo = s.repo AND k.name = s.name)
SELECT id, CAST(pos AS INTEGER) AS pos, type, max(CASE WHEN same THEN 0.55::DOUBLE ELSE 0.4675::DOUBLE END) AS confidence FROM (SELECT *, {_TYPE} AS type FROM a) WHERE type IS NOT NULL GROUP BY id, pos, type""")
def g15_passed_types(spark, sf_dir):
    """Types of literal arguments, passed on to the parameters of the function called: less sure across files."""
    c = tables.located(spark, sf_dir)
    symbols = c.filter("name is not null and docmeta.params is not null").groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("path").alias("home")).filter("n = 1").drop("n")
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(_CALL), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(_CALL), F.lit(2)).alias("args"))
    calls = c.filter("text is not null").select("repo", "path", F.explode(pairs).alias("c")).select("repo", "path", "c.name", "c.args")
    args = calls.join(symbols, ["repo", "name"]).select("id", (F.col("path") == F.col("home")).alias("same"), F.posexplode(F.split("args", ",")).alias("pos", "arg")).withColumn("arg", F.trim("arg"))
    kind = F.when(F.col("arg").rlike("^[\"']"), "string").when(F.col("arg").rlike("^-?[0-9]"), "number").when(F.col("arg").isin("true", "false"), "boolean")
    typed = args.withColumn("type", kind).filter("type is not null")
    return typed.groupBy("id", "pos", "type").agg(F.max(F.when(F.col("same"), 0.55).otherwise(0.4675)).alias("confidence"))


@query(sql="""WITH s AS (SELECT user_id AS job, arg_max(event_type, event_id) AS last, max(ts) AS seen, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failures FROM events GROUP BY user_id)
SELECT job, CASE WHEN last = 'purchase' THEN 'done' WHEN last = 'error' AND failures > 3 THEN 'failed' WHEN last = 'error' THEN 'retry' WHEN seen < TIMESTAMP '2024-01-15 00:00:00' THEN 'stale' ELSE 'running' END AS state, failures FROM s""")
def st4_job_states(spark, sf_dir):
    """States of jobs from their events: finished, failed too often, to retry, without a sign of life, or running."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("last"), F.max("ts").alias("at"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failures"))
    state = F.when(F.col("last") == "purchase", "done").when((F.col("last") == "error") & (F.col("failures") > 3), "failed").when(F.col("last") == "error", "retry").when(
        F.col("at") < F.lit("2024-01-15 00:00:00").cast("timestamp"), "stale").otherwise("running")
    return s.select("job", state.alias("state"), "failures")


@query(sql="SELECT repo, count(*) AS files FROM (SELECT DISTINCT repo, file_id FROM files WHERE file_id % 3 <> 0 AND file_id IS NOT NULL) GROUP BY repo")
def g20_as_of(spark, sf_dir):
    """Files by repo as of a tagged snapshot that a later one no longer shows."""
    root = os.path.join(shared_dir(spark), "snapshots-" + format(random.getrandbits(48), "x"))
    snaps = Snapshots(spark, root)
    f = tables.files(spark, sf_dir, "repo")
    first = snaps.create(f.filter("file_id % 3 != 0"), "first")
    snaps.tag(first, "release")
    snaps.create(f.filter("file_id % 2 = 0"), "second")
    return snaps.read("tag:release").groupBy("repo").agg(F.count(F.lit(1)).alias("files"))


# intents of generated queries and how often each comes, in parts of their sum
FORMS = {"term": 5, "phrase": 2, "both": 3, "either": 2, "path": 1}


def generated_queries(spark, n: int, seed: int, words: list[str]):
    """(n, intent, query) of n queries, by weights of intents, each from a digest of the seed and its number: any part of them can be made anywhere."""
    pick = lambda tag, k: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{tag}:"), F.col("n").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
    known = F.array(*[F.lit(w) for w in words])
    word = lambda tag: F.element_at(known, pick(tag, len(words)) + 1)
    bound, intent = 0, F.lit(None).cast("string")
    for name, weight in FORMS.items():
        bound += weight
        intent = F.coalesce(intent, F.when(F.col("k") < bound, name))
    a, b, c = word("a"), word("b"), word("c")
    text = (
        F.when(F.col("intent") == "term", a).when(F.col("intent") == "phrase", F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"'))).when(F.col("intent") == "both", F.concat(a, F.lit(" and "), b))
        .when(F.col("intent") == "either", F.concat(F.lit("("), a, F.lit(" or "), b, F.lit(") -"), c)).otherwise(F.concat(F.lit("src/"), a, F.lit("/"), b, F.lit(".js"))))
    return spark.range(n).select(F.col("id").cast("int").alias("n")).withColumn("k", pick("intent", sum(FORMS.values()))).withColumn("intent", intent).select("n", "intent", text.alias("query"))


_MATCH = StructType([StructField("n", IntegerType()), StructField("intent", StringType()), StructField("query", StringType()), StructField("match", StringType())])
_PICK = "CAST('0x' || substr(md5('7:{0}:' || n), 1, 8) AS BIGINT) % {1}"
_WORD = "(['graph', 'lease', 'merge', 'token', 'index'])[CAST(" + _PICK + " AS INTEGER) + 1]"


@query(sql=f"""WITH w AS (SELECT CAST(n AS INTEGER) AS n, {_PICK.format('intent', 13)} AS k, {_WORD.format('a', 5)} AS a, {_WORD.format('b', 5)} AS b, {_WORD.format('c', 5)} AS c FROM range(200) t(n)), i AS (SELECT *, CASE WHEN k < 5 THEN 'term' WHEN k < 7 THEN 'phrase' WHEN k < 10 THEN 'both' WHEN k < 12 THEN 'either' ELSE 'path' END AS intent FROM w)
SELECT n, intent, CASE intent WHEN 'term' THEN a WHEN 'phrase' THEN '"' || a || ' ' || b || '"' WHEN 'both' THEN a || ' and ' || b WHEN 'either' THEN '(' || a || ' or ' || b || ') -' || c ELSE 'src/' || a || '/' || b || '.js' END AS query,
CASE intent WHEN 'term' THEN '"' || a || '"' WHEN 'phrase' THEN '"' || a || ' ' || b || '"' WHEN 'both' THEN '("' || a || '") AND ("' || b || '")' WHEN 'either' THEN '("' || a || '") OR ("' || b || '")' ELSE '"src/' || a || '/' || b || '.js"' END AS match FROM i""")
def g26_generated_queries(spark, sf_dir):
    """Generated queries with their full-text form."""
    def make():
        def kernel(n, intent, text):
            yield n, intent, text, Q.match_text(Q.plan(text).tree)
        return kernel
    return map_rows(generated_queries(spark, 200, 7, ["graph", "lease", "merge", "token", "index"]), make, _MATCH)
