"""Index build: chunkers, comments, boilerplate, identity, risk, reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.functions import vectors as V
from quernstone.operators import chunking as C, codegraph, evaluation as E, keyed, relations, risk as K, tables
from quernstone.operators.relations import RELATED_SQL
from quernstone.operators.tables import CHUNKS_SQL, FILES_SQL, LOCATED_SQL, NAMED_SQL, POSTINGS_SQL
from quernstone.queries import SQL, graphs, query  # noqa: F401 the SQL of the graphs' queries is part of that of these
from quernstone.runtime import table

_SQL_OF = SQL
WORDS = "graph lease merge index token vector chunk query cache line node edge frame batch signal window record plan rule gate scope stage look up lookup work space workspace".split()


@query
def t04_dictionary_segmentation(spark, sf_dir):
    """Vocabulary tokens as words of a dictionary."""
    v = table(spark, sf_dir, "token_vocab").filter("token is not null").select(F.lower("token").alias("token")).distinct()
    return C.segmented(v, WORDS)


_N = "regexp_replace(content, '\\r\\n?', chr(10), 'g')"
_HEADED = " ".join(f"WHEN '{s}' THEN regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}')" for s, p in C.HEADINGS.items())


@query(sql=f"""WITH f AS (SELECT file_id, suffix, string_split({_N}, chr(10)) AS l FROM {FILES_SQL} WHERE content IS NOT NULL), x AS (SELECT file_id, suffix, len(l) AS lines, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n) AS section, lead(n) OVER (PARTITION BY file_id ORDER BY n) AS nxt FROM x WHERE CASE suffix {_HEADED} ELSE false END)
SELECT file_id, CAST(section AS INTEGER) AS section, trim(x) AS title, n AS start_line, coalesce(nxt - 1, lines) AS end_line FROM h
UNION ALL SELECT file_id, 1, 'root', 1, len(l) FROM f WHERE file_id NOT IN (SELECT file_id FROM h)""")
def t15_sections(spark, sf_dir):
    """Chunks at heading and declaration lines of every file, one root chunk where its suffix has no such lines."""
    f = tables.files(spark, sf_dir, "suffix", "content").filter(F.col("content").isNotNull())
    s = C.sections(f, "file_id", "suffix", "content")
    return s.select("file_id", "section", "title", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query
def t20_split_by_bytes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return C.byte_pieces(d, "doc_id", "text", 256)


_FENCE_RE = C._FENCE.replace("'", "''")


@query(sql=f"""WITH d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, regexp_extract_all(t, '{_FENCE_RE}', 1) AS g, regexp_extract_all(t, '{_FENCE_RE}', 2) AS c FROM d)
SELECT doc_id, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS n, unnest(g) AS language, unnest(c) AS code FROM m WHERE len(g) > 0""")
def t23_fenced_segments(spark, sf_dir):
    """Embedded segments of documents."""
    return C.fenced(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")


@query
def t24_content_defined_segments(spark, sf_dir):
    """Content-defined cuts of every file, with sizes that fit small files."""
    f = tables.files(spark, sf_dir, "content").filter("content is not null")
    return C.cdc(f, "file_id", "content", low=128, average=512, high=2048, least=0)


_CLEAN = r"trim(regexp_replace(regexp_replace(c, '(?m)^\s*(?:/\*+|\*+/|\*|//+|#+)|\*+/\s*$', ' ', 'g'), '\s+', ' ', 'g'))"


@query(sql=f"""WITH f AS (SELECT file_id, list_filter(list_transform(regexp_extract_all({_N}, '{C.COMMENT}'), lambda c: {_CLEAN}), lambda c: length(c) >= 8) AS c FROM {FILES_SQL} WHERE content IS NOT NULL AND suffix NOT IN ('md', 'json'))
SELECT file_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS n, unnest(c) AS comment FROM f WHERE len(c) > 0""")
def t25_comments(spark, sf_dir):
    f = tables.files(spark, sf_dir, "suffix", "content").filter(F.col("content").isNotNull() & ~F.col("suffix").isin("md", "json"))
    return C.comments(f, "file_id", "content")


_BLOCK = rf"regexp_extract({_N}, '^((?:[ \t]*(?:/\*(?s:.*?)\*/|//[^\n]*|#[^\n]*|;[^\n]*|--[^\n]*)?[ \t]*\n)*)', 1)"
_BARE = rf"regexp_replace({_BLOCK}, '(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+|;+|--)|\*+/', ' ', 'g')"
_NORM = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({_BARE}), '\b(?:19|20)[0-9]{{2}}(?:\s*-\s*(?:19|20)[0-9]{{2}})?\b', '<year>', 'g'), '\b[\w.-]+\.(?:c|h|js|ts|py|go|rs)\b', '<file>', 'g'), '\s+', ' ', 'g'))"
_CODE = ("js", "mjs", "cjs", "ts", "py", "go", "rs", "c", "h")


@query(sql=f"""SELECT md5(b) AS signature, regexp_matches(b, '{C.LICENSE}') AS license, regexp_matches(b, '{C.GENERATED}') AS generated, count(*) AS files
FROM (SELECT {_NORM} AS b FROM {FILES_SQL} WHERE suffix IN {_CODE} AND content IS NOT NULL) WHERE b <> '' GROUP BY ALL""")
def t26_boilerplate(spark, sf_dir):
    """Comment blocks at the top of files by normalised text, and how many files have each."""
    f = tables.files(spark, sf_dir, "suffix", "content").filter(F.col("suffix").isin(*_CODE) & F.col("content").isNotNull())
    b = f.select(C.boilerplate(F.col("content")).alias("b")).filter("b is not null")
    return b.groupBy(F.md5("b").alias("signature"), F.col("b").rlike(C.LICENSE).alias("license"), F.col("b").rlike(C.GENERATED).alias("generated")).agg(F.count(F.lit(1)).alias("files"))


_LINE = "'^[ \\t]*(?:$|//|#|;|--|/?\\*)'"


@query(sql=f"""WITH x AS (SELECT file_id, l, unnest(l) AS t, generate_subscripts(l, 1) AS n, len(l) AS lines FROM (SELECT file_id, string_split({_N}, chr(10)) AS l FROM {FILES_SQL} WHERE content IS NOT NULL AND suffix IN {_CODE})),
c AS (SELECT file_id, max(lines) AS lines, coalesce(min(CASE WHEN NOT regexp_matches(t, {_LINE}) THEN n END), max(lines) + 1) AS first_code, max(CASE WHEN NOT regexp_matches(t, {_LINE}) THEN n END) AS last_code FROM x GROUP BY file_id),
b AS (SELECT x.file_id, 'leading' AS part, min(n) AS start_line, max(n) AS end_line FROM x JOIN c USING (file_id) WHERE n < least(first_code, 161) AND regexp_matches(t, '\\S') GROUP BY x.file_id
UNION ALL SELECT x.file_id, 'trailing', min(n), max(n) FROM x JOIN c USING (file_id) WHERE last_code IS NOT NULL AND n > greatest(last_code, x.lines - 160) AND regexp_matches(t, '\\S') GROUP BY x.file_id)
SELECT file_id, part, CASE WHEN part = 'trailing' THEN greatest(start_line, end_line - 119) ELSE start_line END AS start_line, CASE WHEN part = 'leading' THEN least(end_line, start_line + 119) ELSE end_line END AS end_line FROM b""")
def t26_comment_blocks(spark, sf_dir):
    """Comment blocks at both ends of source files, by their lines."""
    f = tables.files(spark, sf_dir, "suffix", "content").filter(F.col("suffix").isin(*_CODE) & F.col("content").isNotNull())
    return C.comment_blocks(f, "file_id", "content")


@query(sql=f"""WITH b AS (SELECT file_id, length({_BLOCK}) AS b_end FROM {FILES_SQL} WHERE suffix IN {_CODE} AND content IS NOT NULL)
SELECT c.id, round(max(greatest(least(c."end", b.b_end) - greatest(c.start, 0), 0) / (c."end" - c.start)), 6) AS share FROM {LOCATED_SQL} c JOIN b ON c.file_id = b.file_id WHERE c."end" > c.start GROUP BY c.id""")
def t27_boilerplate_overlap(spark, sf_dir):
    """How much of each chunk the block at the top of its file covers."""
    f = tables.files(spark, sf_dir, "suffix", "content").filter(F.col("suffix").isin(*_CODE) & F.col("content").isNotNull())
    block = F.regexp_extract(F.regexp_replace("content", "\r\n?", "\n"), r"^((?:[ \t]*(?:/\*(?s:.*?)\*/|//[^\n]*|#[^\n]*|;[^\n]*|--[^\n]*)?[ \t]*\n)*)", 1)
    blocks = f.select("file_id", F.lit(0).alias("b_start"), F.length(block).alias("b_end"))
    c = tables.located(spark, sf_dir).filter("`end` > start").select("id", "file_id", "start", "end")
    return C.coverage(blocks, c).withColumn("share", F.round("share", 6))


@query(sql=f"""WITH c AS (SELECT file_id, id, "end" AS e FROM {LOCATED_SQL} WHERE "end" > start), p AS (SELECT DISTINCT file_id, unnest([0, 120, 700, 5000]) AS at FROM c)
SELECT p.file_id, p.at || '' AS point, coalesce((SELECT id FROM c WHERE c.file_id = p.file_id AND c.e > p.at ORDER BY e, id LIMIT 1), (SELECT id FROM c WHERE c.file_id = p.file_id ORDER BY e DESC, id DESC LIMIT 1)) AS id FROM p""")
def t28_point_to_chunk(spark, sf_dir):
    """The chunk that holds, or follows, places in every file: an as-of join."""
    c = tables.located(spark, sf_dir).filter("`end` > start").select("file_id", "id", "start", "end")
    p = c.select("file_id").distinct().select("file_id", F.explode(F.array(F.lit(0), F.lit(120), F.lit(700), F.lit(5000))).alias("at")).withColumn("point", F.col("at").cast("string"))
    return C.chunk_of(p.withColumn("at", F.col("at").cast("long")), c)


@query(sql=f"""SELECT c.id, m.match FROM {LOCATED_SQL} c, (SELECT 'a' AS match, 1 AS lo, 4 AS hi UNION ALL SELECT 'b', 30, 31 UNION ALL SELECT 'c', 100, 200) m WHERE m.lo <= c.endLine AND c.startLine <= m.hi""")
def t29_line_matches(spark, sf_dir):
    """Chunks whose lines overlap three stretches of every file."""
    c = tables.located(spark, sf_dir).select("id", "file_id", "startLine", "endLine")
    spans = F.array(*[F.struct(F.lit(m).alias("match"), F.lit(a).alias("m_start"), F.lit(b).alias("m_end")) for m, a, b in (("a", 1, 4), ("b", 30, 31), ("c", 100, 200))])
    m = c.select("file_id").distinct().select("file_id", F.explode(spans).alias("s")).select("file_id", "s.match", "s.m_start", "s.m_end")
    return C.line_matches(m, c)


_PIECE = "md5(nullif(substring(content, CAST({0} + 1 AS BIGINT), CAST(greatest({1} - ({0}), 0) AS BIGINT)), ''))"


def _uid_sql(span, pre, post):
    return f"concat_ws(':', 'ck64:v1', coalesce(repo, 'repo'), coalesce(path, ''), {span}, {pre}, {post})"


@query(sql=f"""WITH a AS (SELECT id, repo, path, coalesce(content, '') AS content, greatest(coalesce(start, 0), 0) AS lo, greatest(coalesce("end", 0), coalesce(start, 0), 0) AS hi, concat_ws(':', coalesce(chunk_id, ''), coalesce(startLine::VARCHAR, ''), coalesce(endLine::VARCHAR, ''), coalesce(kind, ''), coalesce(name, '')) AS salt,
concat_ws(':', coalesce(start::VARCHAR, ''), coalesce("end"::VARCHAR, ''), coalesce(kind, ''), coalesce(name, '')) AS place FROM {LOCATED_SQL}),
p AS (SELECT *, md5(substring(content, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT))) AS span, {_PIECE.format('greatest(lo - 128, 0)', 'lo')} AS pre, {_PIECE.format('hi', '(hi + 128)')} AS post, {_PIECE.format('greatest(lo - 1024, 0)', 'lo')} AS wpre, {_PIECE.format('hi', '(hi + 1024)')} AS wpost FROM a),
u AS (SELECT *, {_uid_sql('span', 'pre', 'post')} AS u0, {_uid_sql("md5('span:' || salt || ':' || span)", 'pre', 'post')} AS u1, {_uid_sql("md5('span:' || salt || ':' || span)", 'wpre', 'wpost')} AS u2 FROM p),
c0 AS (SELECT *, count(*) OVER (PARTITION BY u0) AS n0 FROM u), c1 AS (SELECT *, count(*) OVER (PARTITION BY u1) AS n1 FROM c0 WHERE n0 > 1), c2 AS (SELECT *, count(*) OVER (PARTITION BY u2) AS n2, row_number() OVER (PARTITION BY u2 ORDER BY place, id) AS k FROM c1 WHERE n1 > 1)
SELECT id, u0 AS uid FROM c0 WHERE n0 = 1 UNION ALL SELECT id, u1 FROM c1 WHERE n1 = 1 UNION ALL SELECT id, CASE WHEN n2 = 1 THEN u2 ELSE u2 || ':ord' || k END FROM c2""")
def t30_chunk_uids(spark, sf_dir):
    """Stable ids of chunks, with salt, wider surroundings and ordinals where they collide."""
    return C.uids(tables.identities(spark, sf_dir))


_PARTS = ", '-', ".join(f"CAST(sum(CAST('0x' || substr(md5(path || ':' || md5(content)), {1 + 8 * k}, 8) AS BIGINT)) AS VARCHAR)" for k in range(4))


@query(sql=f"SELECT repo, count(*) AS files, concat({_PARTS}) AS fingerprint FROM {FILES_SQL} WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY repo")
def t34_repo_fingerprint(spark, sf_dir):
    """A fingerprint of the files of each repo that does not depend on their order, so that no list of them is made: the sums of the four parts of their digests."""
    f = tables.files(spark, sf_dir, "repo", "path", "content").filter("path is not null and content is not null").select("repo", F.md5(F.concat_ws(":", "path", F.md5("content"))).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long")).cast("string")
    return f.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.concat_ws("-", *[part(k) for k in range(4)]).alias("fingerprint"))


# Multiplier and addend of the sequence whose members, scaled to [-1, 1], are the vector.
STUB = (1664525, 1013904223)


def stub_vector(text, dims: int):
    """A vector of unit length that depends on the text alone: a digest seeds a linear congruential sequence."""
    seed = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    grow = F.aggregate(F.sequence(F.lit(1), F.lit(dims)), F.array(seed), lambda s, _: F.concat(s, F.array((F.element_at(s, -1) * STUB[0] + STUB[1]) % (1 << 32))))
    raw = F.transform(F.slice(grow, 2, dims), lambda x: x / float((1 << 32) - 1) * 2 - 1)
    return V.unit(raw)


@query(sql="""WITH s AS (SELECT doc_id, list_reduce(list_prepend([CAST('0x' || substr(sha256(coalesce(text, '')), 1, 8) AS BIGINT)], list_transform(range(64), lambda i: [i])), lambda a, b: list_append(a, (a[-1] * 1664525 + 1013904223) % 4294967296)) AS s FROM documents),
v AS (SELECT doc_id, list_transform(s[2:], lambda x: x / 4294967295.0::DOUBLE * 2 - 1) AS v FROM s), n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT doc_id, list_transform(v, lambda x: round(x / n, 5)) AS vector FROM n""")
def t35_stub_embeddings(spark, sf_dir):
    """Vectors that stand in for a model's, made in the engine."""
    v = table(spark, sf_dir, "documents").select("doc_id", stub_vector(F.coalesce("text", F.lit("")), 64).alias("v"))
    return v.select("doc_id", F.transform("v", lambda x: F.round(x, 5)).alias("vector"))


@query(sql=f"SELECT repo, regexp_replace(regexp_replace(trim(file), '[\\\\]+', '/', 'g'), '^(\\.?/)+', '') AS path, CAST(sum(churn) AS DOUBLE) AS churn, count(DISTINCT last_author) AS authors, max(last_author) AS last_author FROM {CHUNKS_SQL} WHERE NOT isnan(coalesce(churn, 0)) GROUP BY 1, 2")
def t40_file_history(spark, sf_dir):
    """Churn and authors of each file from those of its chunks."""
    from quernstone.functions.paths import normal_path

    c = tables.chunks(spark, sf_dir, "repo", "file", "churn", "last_author").filter(~F.isnan(F.coalesce("churn", F.lit(0.0))))
    return c.groupBy("repo", normal_path(F.col("file")).alias("path")).agg(F.sum("churn").alias("churn"), F.count_distinct("last_author").alias("authors"), F.max("last_author").alias("last_author"))


RISK_RULES = [
    K.Rule("collect", "source", r"\b(?:collect|gather|load|read)\w*\(", "input", confidence=0.6), K.Rule("item", "source", r"\bitem\.\w+", "input", confidence=0.5),
    K.Rule("report", "sink", r"\breport\(", "output", "low", 0.5), K.Rule("push", "sink", r"\.(?:push|append)\(", "memory", "medium", 0.6), K.Rule("abort", "sink", r"\b(?:panic|abort_with)\(", "process", "high", 0.7),
    K.Rule("clean", "sanitizer", r"\b(?:normalize|validate|clip)\w*\(", confidence=0.5)]


def _signals_sql(rules=None):
    parts = " UNION ALL ".join(f"SELECT id, '{r.id}' AS rule, '{r.kind}' AS kind, '{r.category}' AS category, '{r.severity}' AS severity, {r.confidence} AS confidence FROM l WHERE regexp_matches(text, '{r.pattern}')" for r in rules or RISK_RULES)
    return f"l AS (SELECT id, text FROM {LOCATED_SQL} WHERE text IS NOT NULL), sg AS ({parts})"


def risk_chunks(spark, sf_dir):
    return tables.located(spark, sf_dir).filter("text is not null").select("id", "text")


@query(sql=f"WITH {_signals_sql()} SELECT id, coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (WHERE category <> ''))), ','), '') AS categories, CAST(max(confidence) AS DOUBLE) AS confidence, coalesce(arg_max(severity, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END) FILTER (WHERE kind = 'sink'), CASE WHEN max(CASE WHEN kind = 'source' THEN 1 ELSE 0 END) = 1 THEN 'low' END) AS severity FROM sg GROUP BY id")
def a12_risk_rollup(spark, sf_dir):
    """Signals of custom rules by chunk."""
    r = K.rollup(K.signals(risk_chunks(spark, sf_dir), RISK_RULES))
    return r.select("id", F.array_join("categories", ",").alias("categories"), "confidence", "severity")


@query(sql=f"WITH {_signals_sql()} SELECT rule, kind, count(*) AS chunks FROM sg GROUP BY rule, kind")
def g14_risk_summary(spark, sf_dir):
    return K.signals(risk_chunks(spark, sf_dir), RISK_RULES).groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("chunks"))


@query
def g11_local_taint(spark, sf_dir):
    return K.local_flows(risk_chunks(spark, sf_dir), RISK_RULES).withColumn("confidence", F.round("confidence", 6))


FLOW_RULES = [
    K.Rule("item", "source", r"\bitem\.\w+", "input", confidence=0.5), K.Rule("caught", "source", r"\bcatch\b|\breport\(", "error", confidence=0.4), K.Rule("thrown", "sink", r"\bthrow new\b|\braise\b", "error", "low", 0.6),
    K.Rule("push", "sink", r"\.(?:push|append)\(", "memory", "medium", 0.6), K.Rule("ready", "sanitizer", r"\.ready\b", confidence=0.5)]


def _hops_sql():
    """Levels of a walk along calls, each pair of source and node once, with the fewest sanitizers on the way."""
    steps = []
    for d in range(1, 5):
        seen = " UNION ALL ".join(f"SELECT source_id, node FROM h{i}" for i in range(d))
        steps.append(f"h{d} AS (SELECT p.source_id, c.dst AS node, min(p.b + CASE WHEN c.dst IN (SELECT id FROM sz) THEN 1 ELSE 0 END) AS b FROM h{d - 1} p JOIN cg c ON c.src = p.node WHERE (p.source_id, c.dst) NOT IN ({seen}) GROUP BY 1, 2)")
    return ", ".join(steps)


def _g13_sql():
    from quernstone.queries import QUERIES, SQL  # noqa: F401

    return f"""WITH cg AS ({SQL['g01_call_graph']}), {_signals_sql(FLOW_RULES)}, sz AS (SELECT DISTINCT id FROM sg WHERE kind = 'sanitizer'), h0 AS (SELECT DISTINCT id AS source_id, id AS node, 0 AS b FROM sg WHERE kind = 'source'), {_hops_sql()},
rc AS ({" UNION ALL ".join(f"SELECT *, {d} AS hops FROM h{d}" for d in range(1, 5))}),
fw AS (SELECT rc.source_id, rc.node AS sink_id, so.rule AS source, si.rule AS sink, rc.hops, round(greatest(0.05, least(1, sqrt(so.confidence * si.confidence) * pow(0.85, rc.hops) * pow(0.9, rc.b))), 6) AS confidence
 FROM rc JOIN (SELECT DISTINCT id, rule, confidence FROM sg WHERE kind = 'source') so ON so.id = rc.source_id JOIN (SELECT DISTINCT id, rule, confidence FROM sg WHERE kind = 'sink') si ON si.id = rc.node)
SELECT source_id, sink_id, source, sink, hops, CAST(confidence AS DOUBLE) AS confidence FROM fw QUALIFY row_number() OVER (PARTITION BY source_id, sink_id ORDER BY confidence DESC, source, sink) <= 3"""


@query(sql=_g13_sql())
def g13_interprocedural_risk(spark, sf_dir):
    """Flows along resolved calls, ranked."""
    calls = codegraph.edges(spark, sf_dir).filter("graph = 'call' and dst like 'c%'")
    number = lambda c: F.expr(f"substring({c}, 2)").cast("long").alias(c)
    return K.interprocedural(K.signals(risk_chunks(spark, sf_dir), FLOW_RULES), calls.select(number("src"), number("dst")))


@query(sql=f"""SELECT source_id, source, sink_id, sink FROM ({_g13_sql()}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN sink_id % 2 = 0 THEN 1 ELSE 0 END DESC, CASE sink WHEN 'push' THEN 2 ELSE 1 END DESC, confidence DESC, hops, sink_id, sink, source) <= 2""")
def w18_ranked_flows(spark, sf_dir):
    """The two first flows of each source: those that touch a seed, then by severity, confidence, hops and ids."""
    flows = g13_interprocedural_risk(spark, sf_dir)
    seeds = flows.filter("sink_id % 2 = 0").select(F.col("sink_id").alias("id"))
    return K.ranked(flows, seeds, F.when(F.col("sink") == "push", "medium").otherwise("low"), 2).select("source_id", "source", "sink_id", "sink")


@query(sql=f"""WITH {_signals_sql()}, so AS (SELECT id, rule FROM sg WHERE kind = 'source'), si AS (SELECT id, rule FROM sg WHERE kind = 'sink'), ln AS (SELECT id, coalesce(startLine, 1) AS line FROM {LOCATED_SQL})
SELECT to_json({{'ruleId': si.rule, 'level': 'warning', 'message': {{'text': so.rule || ' -> ' || si.rule}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': so.id::VARCHAR}}, 'region': {{'startLine': ln.line}}}}}}]}})::VARCHAR AS result FROM so JOIN si USING (id) JOIN ln USING (id)""")
def s19_sarif(spark, sf_dir):
    """A SARIF result of each source and sink of a chunk."""
    found = K.signals(risk_chunks(spark, sf_dir), RISK_RULES)
    of = lambda kind: found.filter(F.col("kind") == kind).select("id", F.col("rule").alias(kind))
    lines = tables.located(spark, sf_dir).select("id", F.coalesce("startLine", F.lit(1)).alias("line"))
    return K.sarif(of("source").join(of("sink"), "id").join(lines, "id"))


_HITS = "h AS (SELECT l.rater AS query_id, l.doc_id AS item, row_number() OVER (PARTITION BY l.rater ORDER BY d.n_chars DESC, l.doc_id) AS rank, d.n_chars AS score FROM (SELECT DISTINCT rater, doc_id FROM labels WHERE rater IS NOT NULL AND doc_id IS NOT NULL) l JOIN documents d ON l.doc_id = d.doc_id), x AS (SELECT DISTINCT rater AS query_id, doc_id AS item FROM labels WHERE quality >= 4 AND rater IS NOT NULL AND doc_id IS NOT NULL)"


def label_hits(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("rater is not null and doc_id is not null")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    pairs = labels.select("rater", "doc_id").distinct().join(d, "doc_id").select(F.col("rater").alias("query_id"), F.col("doc_id").alias("item"), F.col("n_chars").alias("score"))
    hits = keyed.ordered_rank(pairs, ["query_id"], [F.desc("score"), F.asc("item")])
    return hits, labels.filter("quality >= 4").select(F.col("rater").alias("query_id"), F.col("doc_id").alias("item")).distinct()


@query(sql=f"""WITH {_HITS}, t AS (SELECT query_id, count(*) AS total FROM x GROUP BY 1), f AS (SELECT x.query_id, h.rank FROM x JOIN h USING (query_id, item))
SELECT t.query_id, round(count(*) FILTER (WHERE rank <= 10) / total, 6) AS recall, round(coalesce(1.0 / min(rank), 0), 6) AS rr, round(coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 0) / list_sum(list_transform(range(1, CAST(least(total, 10) + 1 AS BIGINT)), lambda i: 1 / log2(i + 1))), 6) AS ndcg
FROM t LEFT JOIN f ON t.query_id = f.query_id GROUP BY t.query_id, total""")
def a14_ranking_quality(spark, sf_dir):
    """Longest first as a ranking, against what raters called good."""
    q = E.ranking_quality(*label_hits(spark, sf_dir), 10)
    return q.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


@query(sql=f"""WITH {_HITS}, b AS (SELECT l.rater AS query_id, l.doc_id AS item, row_number() OVER (PARTITION BY l.rater ORDER BY l.q DESC, l.doc_id) AS rank, l.q AS score FROM (SELECT rater, doc_id, max(coalesce(quality, 0)) AS q FROM labels WHERE rater IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL) l JOIN documents d ON l.doc_id = d.doc_id),
j AS (SELECT query_id, item, h.rank AS ra, b.rank AS rb, h.score AS sa, b.score AS sb FROM (SELECT * FROM h WHERE rank <= 20) h FULL JOIN (SELECT * FROM b WHERE rank <= 20) b USING (query_id, item)),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ra) AS da, row_number() OVER (PARTITION BY query_id ORDER BY rb) AS db FROM j WHERE ra IS NOT NULL AND rb IS NOT NULL)
SELECT q.query_id, round(count(s.item) / 20, 6) AS overlap, round(avg(abs(sa - sb)), 6) AS mean_delta, round(CASE WHEN count(s.item) > 1 THEN 1 - 6 * sum((da - db) ** 2) / (count(s.item) * (count(s.item) ** 2 - 1)) END, 6) AS spearman, coalesce(bool_or(ra = 1 AND rb = 1), false) AS same_first
FROM (SELECT DISTINCT query_id FROM j) q LEFT JOIN s ON q.query_id = s.query_id GROUP BY q.query_id""")
def a15_model_comparison(spark, sf_dir):
    hits, _ = label_hits(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").filter("rater is not null and doc_id is not null").groupBy("rater", "doc_id").agg(F.max(F.coalesce("quality", F.lit(0))).alias("score"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    scored = labels.join(d, "doc_id", "left_semi").select(F.col("rater").alias("query_id"), F.col("doc_id").alias("item"), "score")
    other = keyed.ordered_rank(scored, ["query_id"], [F.desc("score"), F.asc("item")])
    c = E.compared(hits, other, 20)
    return c.select("query_id", *[F.round(x, 6).alias(x) for x in ("overlap", "mean_delta", "spearman")], "same_first")


@query(sql="SELECT event_type AS stage, count(*) AS runs, round(avg(value), 6) AS mean_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY 1")
def a16_throughput(spark, sf_dir):
    t = E.throughput(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))
    return t.withColumn("mean_ms", F.round("mean_ms", 6))


@query(sql=f"""SELECT c.mode, count(*) AS chunks, count(DISTINCT c.repo) AS repos, CAST(coalesce(sum(l.tokens), 0) AS BIGINT) AS tokens, CAST(sum(length(coalesce(c.docmeta.doc, ''))) AS BIGINT) AS doc_chars
FROM {CHUNKS_SQL} c LEFT JOIN (SELECT doc_id, sum(tf) AS tokens FROM {POSTINGS_SQL} GROUP BY doc_id) l ON c.id = l.doc_id GROUP BY c.mode""")
def a17_index_stats(spark, sf_dir):
    n = tables.postings(spark, sf_dir).groupBy("doc_id").agg(F.sum("tf").alias("tokens"))
    c = tables.chunks(spark, sf_dir, "mode", "repo", "docmeta").join(n, F.col("id") == F.col("doc_id"), "left")
    return c.groupBy("mode").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("repo").alias("repos"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum(F.length(F.coalesce("docmeta.doc", F.lit("")))).alias("doc_chars"))


_CALLS_SQL = f"""y AS (SELECT repo, name, max(len(docmeta.params)) AS required FROM {LOCATED_SQL} WHERE name IS NOT NULL AND docmeta.params IS NOT NULL GROUP BY repo, name),
k AS (SELECT repo, unnest(regexp_extract_all(text, '([A-Za-z_]\\w*)\\(([^()]*)\\)', 1)) AS name, unnest(regexp_extract_all(text, '([A-Za-z_]\\w*)\\(([^()]*)\\)', 2)) AS args FROM {LOCATED_SQL} WHERE text IS NOT NULL)"""


@query(sql=f"""WITH {_CALLS_SQL} SELECT y.repo || ':' || y.name AS symbol_id, count(*) AS calls, CAST(sum(CASE WHEN (CASE WHEN trim(args) = '' THEN 0 ELSE len(string_split(args, ',')) END) < required OR (CASE WHEN trim(args) = '' THEN 0 ELSE len(string_split(args, ',')) END) > required + 1 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches
FROM y JOIN k ON y.repo = k.repo AND y.name = k.name GROUP BY 1""")
def a20_api_contracts(spark, sf_dir):
    """Calls of each function by the number of their arguments."""
    c = tables.located(spark, sf_dir)
    key = F.concat_ws(":", "repo", "name")
    symbols = c.filter("name is not null and docmeta.params is not null").groupBy(key.alias("symbol_id")).agg(F.max(F.size("docmeta.params")).alias("required")).withColumn("most", F.col("required") + 1)
    form = F.lit(r"([A-Za-z_]\w*)\(([^()]*)\)")
    pairs = F.arrays_zip(F.regexp_extract_all("text", form, F.lit(1)).alias("name"), F.regexp_extract_all("text", form, F.lit(2)).alias("args"))
    calls = c.filter("text is not null").select("repo", F.explode(pairs).alias("c")).select(
        F.concat_ws(":", "repo", "c.name").alias("symbol_id"), F.when(F.trim("c.args") == "", 0).otherwise(F.size(F.split("c.args", ","))).alias("args"))
    return E.contracts(symbols, calls)


@query(sql="SELECT cohort, count(*) AS repos, CAST(sum(coalesce(priority, 0)) AS BIGINT) AS priority, CAST(row_number() OVER (ORDER BY count(*) DESC, sum(coalesce(priority, 0)) DESC, cohort NULLS LAST) AS INTEGER) AS rank FROM repos WHERE enabled GROUP BY cohort")
def a21_cohort_ranking(spark, sf_dir):
    return E.cohorts(table(spark, sf_dir, "repos"))


@query(sql="SELECT repo, alias, priority FROM repos WHERE repo = 'keelhaven/monolith' OR alias IN ('field-filter') OR (enabled AND list_has_any(tags, ['core', 'docs']) AND (regexp_matches(repo, '^otterbay/[^/]*$') OR regexp_matches(repo, '^b[^/]*/.*$')))")
def g22_selected_repos(spark, sf_dir):
    return E.selected_repos(table(spark, sf_dir, "repos"), ["keelhaven/monolith", "field-filter"], ["core", "docs"], ["otterbay/*", "b*/**"]).select("repo", "alias", "priority")


@query(sql="""WITH c AS (SELECT cohort, row_number() OVER (ORDER BY count(*) DESC, sum(coalesce(priority, 0)) DESC, cohort NULLS LAST) AS rank FROM repos WHERE enabled GROUP BY cohort), m AS (SELECT min(cohort) AS cohort FROM repos WHERE enabled)
SELECT 'default' AS gate, r.repo, r.cohort, r.cohort IS NOT DISTINCT FROM c.cohort AS kept FROM repos r, c WHERE r.enabled AND c.rank = 1 UNION ALL SELECT 'chosen', r.repo, r.cohort, r.cohort IS NOT DISTINCT FROM m.cohort FROM repos r, m WHERE r.enabled UNION ALL SELECT 'unsafe', repo, cohort, true FROM repos WHERE enabled""")
def g23_cohort_gate(spark, sf_dir):
    """Repos kept by each gate: the first cohort, one that is asked for, and all."""
    r = table(spark, sf_dir, "repos")
    least = r.filter("enabled").agg(F.min("cohort")).first()[0]
    gate = lambda name, df: df.select(F.lit(name).alias("gate"), "repo", "cohort", "kept")
    return gate("default", E.cohort_gate(r)).unionByName(gate("chosen", E.cohort_gate(r, least))).unionByName(gate("unsafe", E.cohort_gate(r, unsafe=True)))


@query(sql="""SELECT 'duplicate_ids' AS "check", count(*) AS violations FROM (SELECT id FROM chunks GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'dangling_postings', count(*) FROM token_postings WHERE doc_id NOT IN (SELECT id FROM chunks)
UNION ALL SELECT 'empty_postings', count(*) FROM token_postings WHERE tf IS NULL OR tf <= 0 UNION ALL SELECT 'inverted_ranges', count(*) FROM chunks WHERE "end" <= start""")
def g24_validation(spark, sf_dir):
    return E.checks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "token_postings"))


@query(sql="SELECT a.vec_id, round(1 - (1 - list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))), 6) AS similarity FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 1) b")
def w07_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    return e.withColumn("q", e.filter("vec_id = 1").select("v").scalar()).select("vec_id", F.round(V.similarity(1 - V.dot(F.col("v"), F.col("q")), "cosine"), 6).alias("similarity"))


@query(sql=f"SELECT id, round(least(1.5::DOUBLE, 0.25::DOUBLE * len(list_intersect(list_transform(calls, lambda c: lower(c)), ['report', 'len', 'push', 'append'])) + 0.1::DOUBLE * len(list_intersect(list_transform(usages, lambda c: lower(c)), ['log', 'logger', 'item', 'push']))), 6) AS boost FROM {RELATED_SQL} WHERE text IS NOT NULL")
def w13_relation_boost(spark, sf_dir):
    r = relations.related(spark, sf_dir).filter("text is not null")
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    return r.select("id", F.round(F.least(F.lit(1.5), 0.25 * F.size(F.array_intersect(low("calls"), F.array(*[F.lit(x) for x in ("report", "len", "push", "append")])))
                                          + 0.1 * F.size(F.array_intersect(low("usages"), F.array(*[F.lit(x) for x in ("log", "logger", "item", "push")])))), 6).alias("boost"))


_PRIMARY = "pr AS (SELECT id, repo, path, name, calls, usages, imports FROM m WHERE regexp_matches(name, '(?i)graph') AND kind IS NOT NULL)"
_TIERS = ("call", "usage", "export", "import", "name")  # why a chunk comes along, the strongest first


@query(sql=f"""WITH m AS (SELECT * FROM {RELATED_SQL}), {_PRIMARY}, nm AS (SELECT id, repo, path, name, visibility FROM m WHERE name IS NOT NULL), mo AS (SELECT id, repo, path, name, regexp_extract(path, '([^/.]+)[^/]*$', 1) AS base FROM nm),
x AS (SELECT p.id AS hit, n.id, 1 AS priority FROM pr p JOIN nm n ON n.repo = p.repo AND list_contains(p.calls, n.name) UNION ALL SELECT p.id, n.id, 2 FROM pr p JOIN nm n ON n.repo = p.repo AND list_contains(p.usages, n.name)
 UNION ALL SELECT p.id, n.id, 3 FROM pr p JOIN nm n ON n.repo = p.repo AND n.path = p.path AND n.id <> p.id AND n.visibility = 'public'
 UNION ALL SELECT p.id, n.id, 4 FROM pr p JOIN mo n ON n.repo = p.repo AND n.base <> '' AND list_contains(list_transform(p.imports, lambda i: regexp_extract(i, '([^/.:]+)(?:\\.[a-z]+)?$', 1)), n.base)
 UNION ALL SELECT p.id, n.id, 5 FROM pr p JOIN nm n ON n.repo = p.repo AND n.path = p.path AND n.id <> p.id),
y AS (SELECT hit, id, min(priority) AS priority, array_to_string(list_slice(list_sort(list(DISTINCT priority)), 1, 3), ',') AS reasons FROM x WHERE id NOT IN (SELECT id FROM pr) GROUP BY hit, id),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY hit ORDER BY priority, id) <= 4)
SELECT hit, id, priority, reasons FROM z ORDER BY hit, priority, id LIMIT 40""")
def g10_context_expansion(spark, sf_dir):
    """Up to four chunks around each hit and forty in all: what it calls, what it uses, what its file exports, what it imports, and its file; hits themselves are not added."""
    m = relations.related(spark, sf_dir)
    primary = m.filter(F.col("name").rlike("(?i)graph") & F.col("kind").isNotNull()).select(F.col("id").alias("hit"), "repo", "path", "calls", "usages", "imports")
    named = m.filter("name is not null").select("id", "repo", F.col("path").alias("path2"), "name", "visibility")
    tier = lambda df, n: df.select("hit", "id", F.lit(n).alias("priority"))
    by_name = lambda names, n: tier(primary.select("hit", "repo", F.explode(names).alias("name")).join(named, ["repo", "name"]), n)
    base = named.withColumn("base", F.regexp_extract("path2", r"([^/.]+)[^/]*$", 1)).filter("base != ''")
    modules = F.array_distinct(F.transform("imports", lambda i: F.regexp_extract(i, r"([^/.:]+)(?:\.[a-z]+)?$", 1)))
    by_import = tier(primary.select("hit", "repo", F.explode(modules).alias("base")).join(base, ["repo", "base"]), 4)
    here = lambda of, n: tier(primary.select("hit", "repo", F.col("path").alias("path2")).join(of, ["repo", "path2"]).filter("id != hit"), n)
    # of a file no hit takes more chunks than its own four, besides hits: the first of each file are enough
    hits = primary.select(F.col("hit").alias("id")).distinct()
    first = keyed.top_n(named.join(hits, "id", "left_anti"), ["repo", "path2"], [F.asc("id")], 4)
    public = keyed.top_n(named.filter("visibility = 'public'").join(hits, "id", "left_anti"), ["repo", "path2"], [F.asc("id")], 4)
    found = by_name("calls", 1).unionByName(by_name("usages", 2)).unionByName(here(public, 3)).unionByName(by_import).unionByName(here(first, 5)).join(hits, "id", "left_anti")
    best = found.groupBy("hit", "id").agg(F.min("priority").alias("priority"))
    kept = keyed.top_n(best, ["hit"], [F.asc("priority"), F.asc("id")], 4).orderBy("hit", "priority", "id").limit(40)
    # all reasons of what is kept: a few rows
    full = here(named, 5).unionByName(here(named.filter("visibility = 'public'"), 3)).unionByName(by_name("calls", 1)).unionByName(by_name("usages", 2)).unionByName(by_import)
    why = full.join(kept.select("hit", "id"), ["hit", "id"], "left_semi").groupBy("hit", "id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_set(F.col("priority"))), lambda x: x.cast("string")), 1, 3), ",").alias("reasons"))
    return kept.join(why, ["hit", "id"]).select("hit", "id", "priority", "reasons")


_EXCERPT_BYTES, _EXCERPT_TOKENS = 400, 30
_CUT_SQL = f"substring(text, 1, len(list_filter(range(1, least(length(text), {_EXCERPT_BYTES}) + 1), lambda n: octet_length(encode(substring(text, 1, CAST(n AS BIGINT)))) <= {_EXCERPT_BYTES})))"


@query(sql=f"""WITH l AS (SELECT id, name, docmeta, text FROM {LOCATED_SQL} WHERE regexp_matches(name, '(?i)graph') AND text IS NOT NULL), {_signals_sql().replace('l AS (SELECT', 'la AS (SELECT', 1).replace('FROM l WHERE', 'FROM la WHERE')},
ce AS ({{CALLS}}), o AS (SELECT src AS id, count(*) AS callees FROM ce GROUP BY src), i AS (SELECT dst AS id, count(*) AS callers FROM ce GROUP BY dst), rk AS (SELECT id, array_to_string(list_sort(list(DISTINCT rule)), ',') AS risks FROM sg GROUP BY id)
SELECT l.id, name, coalesce(docmeta.signature, '') AS signature, array_to_string(list_filter(string_split_regex({_CUT_SQL}, '\\s+'), lambda w: w <> '')[1:{_EXCERPT_TOKENS}], ' ') AS excerpt,
coalesce(o.callees, 0) AS callees, coalesce(i.callers, 0) AS callers, array_to_string(list_sort(list_transform(coalesce(docmeta.params, []), lambda p: 'param:' || coalesce(p, '')))[1:20], ',') || CASE WHEN docmeta.returnType IS NOT NULL THEN ';return:' || docmeta.returnType ELSE '' END AS types, coalesce(rk.risks, '') AS risks
FROM l LEFT JOIN o ON l.id = o.id LEFT JOIN i ON l.id = i.id LEFT JOIN rk ON l.id = rk.id""".replace("{CALLS}", _SQL_OF["g01_call_graph"]))
def g09_context_pack(spark, sf_dir):
    """Chunks as context: an excerpt within bytes and tokens, neighbours in the call graph, types and risks."""
    from quernstone.sources.files import decoded

    c = tables.located(spark, sf_dir).filter(F.col("name").rlike("(?i)graph") & F.col("text").isNotNull())
    words = F.filter(F.split(decoded(F.encode("text", "UTF-8"), _EXCERPT_BYTES), r"\s+"), lambda w: w != "")
    e = codegraph.edges(spark, sf_dir).filter("graph = 'call' and dst like 'c%'").select("src", "dst")
    number = lambda c: F.expr(f"substring({c}, 2)").cast("long").alias("id")
    out, back = e.groupBy(number("src")).agg(F.count(F.lit(1)).alias("callees")), e.groupBy(number("dst")).agg(F.count(F.lit(1)).alias("callers"))
    risks = K.signals(risk_chunks(spark, sf_dir), RISK_RULES).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("risks"))
    params = F.slice(F.array_sort(F.transform(F.coalesce("docmeta.params", F.array().cast("array<string>")), lambda p: F.concat(F.lit("param:"), F.coalesce(p, F.lit(""))))), 1, 20)
    types = F.concat(F.array_join(params, ","), F.when(F.col("docmeta.returnType").isNotNull(), F.concat(F.lit(";return:"), F.col("docmeta.returnType"))).otherwise(""))
    return c.join(out, "id", "left").join(back, "id", "left").join(risks, "id", "left").select(
        "id", "name", F.coalesce("docmeta.signature", F.lit("")).alias("signature"), F.array_join(F.slice(words, 1, _EXCERPT_TOKENS), " ").alias("excerpt"),
        F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers"), types.alias("types"), F.coalesce("risks", F.lit("")).alias("risks"))


_BODIES = f"""c AS (SELECT id, file_id, start, "end" AS e, text FROM {LOCATED_SQL} WHERE kind = 'Comment' AND text <> ''), b AS (SELECT id, file_id, "end" AS e FROM {LOCATED_SQL} WHERE "end" > start AND coalesce(kind, '') <> 'Comment')"""


@query(sql=f"""WITH {_BODIES}, p AS (SELECT DISTINCT file_id, start, e FROM c), r AS (SELECT p.file_id, p.start, p.e, coalesce((SELECT id FROM b WHERE b.file_id = p.file_id AND b.e > p.start ORDER BY e, id LIMIT 1), (SELECT id FROM b WHERE b.file_id = p.file_id ORDER BY e DESC, id DESC LIMIT 1)) AS id FROM p)
SELECT r.id, r.start, r.e AS stop, min(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) AS excerpt FROM r JOIN c ON c.file_id = r.file_id AND c.start = r.start AND c.e = r.e WHERE r.id IS NOT NULL GROUP BY ALL""")
def j14_comment_excerpts(spark, sf_dir):
    """Chunks with the comments that belong to them, by file, start and end of the comment."""
    l = tables.located(spark, sf_dir)  # noqa: E741
    comments = l.filter("kind = 'Comment' and text != ''").select("file_id", "start", F.col("end").alias("stop"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("excerpt"))
    bodies = l.filter("`end` > start and coalesce(kind, '') != 'Comment'").select("file_id", "id", "start", "end")
    points = comments.select("file_id", F.col("start").alias("at"), F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string")).alias("point")).distinct()
    refs = C.chunk_of(points, bodies).select("file_id", "id", F.split("point", ":")[0].cast("long").alias("start"), F.split("point", ":")[1].cast("long").alias("stop"))
    return refs.join(comments, ["file_id", "start", "stop"]).groupBy("id", "start", "stop").agg(F.min("excerpt").alias("excerpt"))


@query(sql=f"""WITH f AS (SELECT file_id, suffix, string_split({_N}, chr(10)) AS l, {_N} AS t FROM {FILES_SQL} WHERE content IS NOT NULL), x AS (SELECT file_id, suffix, len(l) AS lines, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n) AS part, lead(n) OVER (PARTITION BY file_id ORDER BY n) AS nxt FROM x WHERE CASE suffix {_HEADED} ELSE false END),
z AS (SELECT file_id, t, unnest(range(0, greatest(length(t), 1), 800)) AS ps FROM f WHERE file_id NOT IN (SELECT file_id FROM h))
SELECT file_id, CASE WHEN suffix IN ('md', 'markdown', 'rst') THEN 'heading' ELSE 'declaration' END AS chunker, CAST(part AS INTEGER) AS part, n AS start_line, coalesce(nxt - 1, lines) AS end_line FROM h
UNION ALL SELECT file_id, 'slices', CAST(ps // 800 + 1 AS INTEGER), length(substring(t, 1, ps)) - length(replace(substring(t, 1, ps), chr(10), '')) + 1, length(substring(t, 1, greatest(least(ps + 800, length(t)) - 1, 0))) - length(replace(substring(t, 1, greatest(least(ps + 800, length(t)) - 1, 0)), chr(10), '')) + 1 FROM z""")
def t14_dispatched_chunks(spark, sf_dir):
    """Chunks of every file by the chunker that its kind asks for: headings, declarations, or slices of 800 characters where there are none."""
    f = tables.files(spark, sf_dir, "suffix", "content").filter("content is not null")
    return C.dispatched(f, "file_id", "suffix", "content").withColumns({c: F.col(c).cast("long") for c in ("start_line", "end_line")})


@query(sql=f"""WITH t AS (SELECT mode, token FROM {NAMED_SQL} GROUP BY ALL), c AS (SELECT token FROM t WHERE mode = 'code'), p AS (SELECT token FROM t WHERE mode = 'prose')
SELECT 'both' AS part, token FROM (SELECT * FROM c INTERSECT SELECT * FROM p) UNION ALL SELECT 'code_only', token FROM (SELECT * FROM c EXCEPT SELECT * FROM p) UNION ALL SELECT 'prose_only', token FROM (SELECT * FROM p EXCEPT SELECT * FROM c)""")
def x09_set_operations(spark, sf_dir):
    """Tokens of code and prose: intersection, differences, union of the parts (section 2.9)."""
    t = tables.named_postings(spark, sf_dir).select("mode", "token").distinct()
    c, p = t.filter("mode = 'code'").select("token"), t.filter("mode = 'prose'").select("token")
    part = lambda df, n: df.select(F.lit(n).alias("part"), "token")
    return part(c.intersect(p), "both").unionByName(part(c.subtract(p), "code_only")).unionByName(part(p.subtract(c), "prose_only"))


@query(sql="SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 100")
def x08_hash_sample(spark, sf_dir):
    """A sample of fixed size that depends on keys and a seed alone (section 2.8)."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id").limit(100)


@query
def x10_normal_text(spark, sf_dir):
    """Texts in Unicode's compatibility form, with white space squashed (section 2.10)."""
    def normal(batches):
        import unicodedata

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(normal, "doc_id bigint, text string")


