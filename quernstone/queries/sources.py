"""Sources, sinks and incremental behaviour."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from quernstone.operators import tables
from quernstone.operators.tables import CHUNKS_SQL, FILES_SQL, NAMED_SQL
from quernstone.queries import query
from quernstone.operators import codegraph
from quernstone.queries.graphs import _EDGES_SQL
from quernstone.runtime import shared_dir, table
from quernstone.sources import files as S, symbols as Y
from quernstone.streaming import incremental as I

_PROSE = ", ".join(f"'{x}'" for x in S.PROSE)
_BIN = ", ".join(f"'{x}'" for x in S.BINARY)
_DIRS = "|".join(x.replace(".", "\\.") for x in S.SKIPPED_DIRS)


@query(sql=f"SELECT file_id, CASE WHEN suffix IN ('pdf', 'docx') THEN 'extracted-prose' WHEN suffix IN ({_BIN}) THEN NULL WHEN regexp_matches(trim(path), '(?:^|/)(?:records|triage)/') THEN 'records' WHEN suffix IN ({_PROSE}) THEN 'prose' ELSE 'code' END AS mode FROM {FILES_SQL}")
def s05_mode_routing(spark, sf_dir):
    """Mode of each file by its suffix."""
    return tables.files(spark, sf_dir, "path").select("file_id", S.mode(F.trim("path")).alias("mode"))


@query(sql=rf"""SELECT reason, count(*) AS files FROM (SELECT CASE WHEN regexp_matches(path, '(?:^|/)(?:{_DIRS})/') THEN 'skipped_dir' WHEN suffix IN ({_BIN}) THEN 'binary' WHEN regexp_matches(path, '[.-]min\.(?:js|css)$') THEN 'minified'
WHEN regexp_matches(path, '(?i)(?:^|/)[\w.-]*(?:lock|shrinkwrap)[\w.-]*\.json$') THEN 'lock_file' END AS reason FROM {FILES_SQL}) GROUP BY reason""")
def s03_skip_policy(spark, sf_dir):
    """Files by why they are not read (S3)."""
    f = tables.files(spark, sf_dir, "path", "content")
    return f.groupBy(S.skip_reason(F.col("path"), F.length("content")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


@query(sql=rf"""SELECT file_id, CASE WHEN regexp_matches(path, '(?:^|/)(?:{_DIRS})/') OR suffix IN ({_BIN}) OR regexp_matches(path, '[.-]min\.(?:js|css)$') OR regexp_matches(path, '(?i)(?:^|/)[\w.-]*(?:lock|shrinkwrap)[\w.-]*\.json$') THEN 'skip'
WHEN regexp_matches(path, '(?:^|/)(?:__generated__|generated|gen)/|\.(?:generated|gen|g|pb)\.[A-Za-z]+$|_(?:pb2|generated)\.[A-Za-z]+$') THEN 'metadata' ELSE 'index' END AS policy FROM {FILES_SQL}""")
def s03_generated_policy(spark, sf_dir):
    """What becomes of each file: skipped, kept as its facts alone where a tool wrote it, or indexed (S3)."""
    return tables.files(spark, sf_dir, "path", "content").select("file_id", S.policy(F.col("path"), F.length("content")).alias("policy"))


@query(sql=f"SELECT file_id FROM {FILES_SQL} WHERE CASE WHEN regexp_matches(path, '^docs/important/') THEN false WHEN regexp_matches(path, '(?:^|/)[^/]*\\.md(?:/|$)') THEN true WHEN regexp_matches(path, '^(?:.*/)?graph/[^/]*\\.py(?:/|$)') THEN true ELSE regexp_matches(path, '(?:^|/)generated/') END")
def s02_ignored(spark, sf_dir):
    """Files that ignore rules leave out."""
    return tables.files(spark, sf_dir, "path").filter(S.ignored(F.col("path"), ["generated/", "# comment", "**/graph/*.py", "*.md", "!/docs/important/"])).select("file_id")


@query(sql=f"SELECT file_id, length(content) AS chars FROM {FILES_SQL} WHERE content IS NOT NULL")
def s06_decoded(spark, sf_dir):
    """Contents of every file as bytes, and decoded again within the cap of production, which none of them reaches."""
    f = tables.files(spark, sf_dir, "content").filter("content is not null").withColumn("b", F.encode("content", "UTF-8"))
    return f.select("file_id", F.length(S.decoded(F.col("b"))).cast("long").alias("chars"))


@query(sql=f"SELECT mode, count(*) AS chunks FROM {CHUNKS_SQL} WHERE mode IS NOT NULL GROUP BY mode")
def s10_mode_partitions(spark, sf_dir):
    """Chunks written by mode to the shared folder, and read again."""
    target = os.path.join(shared_dir(spark), f"chunks-by-mode-{uuid.uuid4().hex[:12]}")  # of this run alone
    S.write_modes(tables.chunks(spark, sf_dir, "mode", "repo", "name").filter("mode is not null"), target)
    return spark.read.parquet(target).groupBy("mode").agg(F.count(F.lit(1)).alias("chunks"))


@query(sql="SELECT source || ':' || rec_id AS k, sha1(source || ':' || rec_id) AS symbol_id FROM (SELECT DISTINCT 'generic' AS source, rec_id FROM generic WHERE rec_id IS NOT NULL)")
def s18_record_ids(spark, sf_dir):
    """Stable ids of records from source and key."""
    g = table(spark, sf_dir, "generic").filter("rec_id is not null").select("rec_id").distinct()
    return g.select(F.concat_ws(":", F.lit("generic"), F.col("rec_id").cast("string")).alias("k"), Y.symbol_id(F.lit("generic"), F.col("rec_id").cast("string")).alias("symbol_id"))


@query(sql="""WITH g AS (SELECT * FROM generic WHERE rec_id IS NOT NULL QUALIFY ingested_at = max(ingested_at) OVER (PARTITION BY rec_id) OR max(ingested_at) OVER (PARTITION BY rec_id) IS NULL)
SELECT DISTINCT sha1('generic:' || rec_id) AS record_id, service, env, team, owner, vuln.vulnId AS vuln_id, package.name AS package,
array_to_string(list_filter(['# ' || coalesce(vuln.title, 'Untitled'), '- severity: ' || vuln.severity, '- service: ' || service, '- package: ' || package.name, '- exposure: ' || exposure.publicEndpoint], lambda x: x IS NOT NULL), chr(10)) AS markdown FROM g""")
def s18_promoted_records(spark, sf_dir):
    """Records with their fields lifted to the top, a stable id, and as a page of text."""
    from quernstone.runtime import latest

    g = latest(table(spark, sf_dir, "generic").filter("rec_id is not null"), ["rec_id"], "ingested_at")
    lines = F.array_compact(F.array(F.concat(F.lit("# "), F.coalesce("vuln.title", F.lit("Untitled"))), *[F.concat(F.lit(f"- {n}: "), F.col(c)) for n, c in (("severity", "vuln.severity"), ("service", "service"), ("package", "package.name"), ("exposure", "exposure.publicEndpoint"))]))
    return g.select(Y.symbol_id(F.lit("generic"), F.col("rec_id").cast("string")).alias("record_id"), "service", "env", "team", "owner", F.col("vuln.vulnId").alias("vuln_id"), F.col("package.name").alias("package"),
                    F.array_join(lines, "\n").alias("markdown")).distinct()


@query(sql=f"""WITH {_EDGES_SQL} SELECT '  "' || src || '" -> "' || dst || '";' AS line FROM e""")
def s19_dot(spark, sf_dir):
    return S.dot_lines(codegraph.edges(spark, sf_dir).select("src", "dst").distinct())


@query(sql=f"SELECT row_number() OVER (ORDER BY CASE mode WHEN 'code' THEN 0 WHEN 'prose' THEN 1 ELSE 2 END, mode NULLS LAST, id) - 1 AS doc_id, id FROM {CHUNKS_SQL}")
def s20_piece_assembly(spark, sf_dir):
    """A piece of every mode with ids of its own as one index, code and prose first, chunks without a mode last."""
    c = tables.chunks(spark, sf_dir, "mode")
    modes = [r.mode for r in c.select("mode").distinct().collect()]  # a handful of modes
    return pieces(c, sorted(modes, key=lambda m: (m is None, m not in ("code", "prose"), m or "")))


@query(sql=f"""WITH p AS (SELECT mode, token, doc_id, tf FROM {NAMED_SQL}), s AS (SELECT mode, token, doc_id, tf, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS piece FROM p)
SELECT mode, token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM s GROUP BY mode, token""")
def s20_merged_postings(spark, sf_dir):
    """Postings of two pieces of an index, each with vocabulary and ids of its own, merged by token."""
    p = tables.named_postings(spark, sf_dir)
    return S.merged_postings([p.filter("doc_id % 3 = 0"), p.filter("doc_id % 3 != 0")]).groupBy("mode", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(sql=f"SELECT mode, count(*) AS chunks, 2 AS files FROM {CHUNKS_SQL} WHERE mode IS NOT NULL GROUP BY mode")
def s21_compacted(spark, sf_dir):
    """Many small pieces of a table rewritten as fewer, and what is left."""
    source, target = (os.path.join(shared_dir(spark), f"{n}-{uuid.uuid4().hex[:12]}") for n in ("pieces", "compact"))
    tables.chunks(spark, sf_dir, "mode").filter("mode is not null").repartition(16).write.parquet(source)
    S.compact(spark, source, target, 2)
    c = spark.read.parquet(target).withColumn("file", F.input_file_name())
    return c.groupBy("mode").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file").cast("int").alias("files"))


def pieces(c, modes):
    """(doc_id, id): one piece of each mode, in the order of the list."""

    def piece(m):
        from pyspark.sql import Window

        part = c.filter(F.col("mode").eqNullSafe(m)).select("id")
        # dense ids in the order of the key: ranks within ranges of ids, shifted by the sizes of the ranges before
        span = part.withColumn("__r", F.floor(F.col("id") / (1 << 20)))
        local = span.withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy("id")))
        before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
        sizes = span.groupBy("__r").count().withColumn("__s", F.coalesce(F.sum("count").over(before), F.lit(0))).select("__r", "__s")
        return local.join(sizes, "__r").select((F.col("__n") + F.col("__s") - 1).alias("doc_id"), "id")

    return S.assemble([piece(m) for m in modes])


@query(sql="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st1_event_windows(spark, sf_dir):
    """Tumbling windows over event time; an extension, the reference has none."""
    w = I.event_windows(table(spark, sf_dir, "events"), "1 hour")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def st1_sessions(spark, sf_dir):
    s = I.sessions(table(spark, sf_dir, "events"), "30 minutes")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query(sql="""WITH c AS (SELECT event_id % 500 AS k, event_type, value, event_id AS ts, event_type = 'error' AS deleted FROM events), l AS (SELECT k, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, arg_max(deleted, ts) AS deleted FROM c WHERE ts >= 500 GROUP BY k),
b AS (SELECT event_id AS k, event_type, value FROM events WHERE event_id < 500) SELECT k, event_type, value FROM b WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT k, event_type, value FROM l WHERE NOT deleted""")
def st3_upsert(spark, sf_dir):
    """A table of the first events, kept up to date by the later ones."""
    e = table(spark, sf_dir, "events")
    current = e.filter("event_id < 500").select(F.col("event_id").alias("k"), "event_type", "value")
    changes = e.filter("event_id >= 500").select((F.col("event_id") % 500).alias("k"), "event_type", "value", F.col("event_id").alias("ts"), (F.col("event_type") == "error").alias("deleted"))
    return I.upsert(current, changes, "k")
