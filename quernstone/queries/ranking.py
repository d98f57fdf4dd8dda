"""Postings, statistics, ranking and fusion over the chunk index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import keyed, ranking as R, relations, similarity as S, tables
from quernstone.operators.relations import RELATED_SQL
from quernstone.operators.chunking import COMMENT
from quernstone.operators.tables import CHUNKS_SQL, LOCATED_SQL, NAMED_SQL, POSTINGS_SQL
from quernstone.queries import SQL, query
from quernstone.queries.text import lower_split_sql
from quernstone.runtime import one, stored, table

QUERY = ["graph", "lease", "merge", "graph"]
_QTF = "CASE token WHEN 'graph' THEN 2 ELSE 1 END"
_IN = "('graph', 'lease', 'merge')"


def index(spark, sf_dir, mode="code"):
    """Postings, lengths and statistics of one mode; chunks without postings count as documents of length 0."""
    of = lambda df: df.filter(F.col("mode") == mode)
    return of(tables.named_postings(spark, sf_dir)).select("token", "doc_id", "tf"), of(tables.named_lengths(spark, sf_dir)).select("doc_id", "dl"), of(tables.index_statistics(spark, sf_dir)).select("n", "avg_dl")


_INDEX_SQL = f"""p AS (SELECT token, doc_id, tf FROM {NAMED_SQL} WHERE mode = 'code'), dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id),
st AS (SELECT count(*) AS n, (SELECT sum(dl) FROM dl) / count(*) AS avg_dl FROM {CHUNKS_SQL} WHERE mode = 'code')"""


def bm25_sql(k1=1.2, b=0.75):
    return f"""q AS (SELECT * FROM p WHERE token IN {_IN}), df AS (SELECT token, count(*) AS df FROM q GROUP BY token),
hits AS (SELECT q.doc_id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * q.tf * ({k1} + 1) / (q.tf + {k1} * (1 - {b} + {b} * dl.dl / st.avg_dl)) * ({_QTF.replace('token', 'q.token')})) AS score
FROM q JOIN df ON q.token = df.token JOIN dl ON q.doc_id = dl.doc_id, st GROUP BY q.doc_id)"""


@query(sql=f"SELECT mode, token, doc_id, tf FROM {NAMED_SQL}")
def a01_term_frequency(spark, sf_dir):
    return tables.named_postings(spark, sf_dir)


@query(sql=f"SELECT mode, doc_id, CAST(sum(tf) AS BIGINT) AS dl, count(*) AS terms FROM {POSTINGS_SQL} GROUP BY mode, doc_id")
def a01_doc_lengths(spark, sf_dir):
    return tables.postings(spark, sf_dir).groupBy("mode", "doc_id").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("terms"))


def field_postings(spark, sf_dir):
    """(field, token, doc_id, tf) of name, signature, doc, comments and body of code chunks; made once for all queries, sorted by token.

    The body is the chunk's text; chunks of no known file have neither comments nor body.
    """
    def build():
        c = tables.chunks(spark, sf_dir, "mode", "name", "docmeta").filter("mode = 'code'")
        l = tables.located(spark, sf_dir).filter("mode = 'code' and text is not null").select("id", "text")  # noqa: E741
        comment = F.array_join(F.regexp_extract_all("text", F.lit(COMMENT), F.lit(0)), " ")
        of = lambda df, *fields: df.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(v, F.lit("")).alias("v")) for n, v in fields])).alias("f")).select("id", "f.field", "f.v")
        texts = of(c, ("name", F.col("name")), ("signature", F.col("docmeta.signature")), ("doc", F.col("docmeta.doc"))).unionByName(of(l, ("comment", comment), ("body", F.col("text"))))
        return texts.select(F.col("id").alias("doc_id"), "field", F.explode(X.split_identifier(F.col("v"))).alias("token")).groupBy("field", "token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    laid = lambda df: df.repartitionByRange("token", "doc_id").sortWithinPartitions("field", "token", "doc_id")
    return stored(spark, sf_dir, "field_postings", ("chunks", "files"), build, laid, "field").select("field", "token", "doc_id", "tf")


def field_index(spark, sf_dir):
    """Postings, lengths and statistics of each field; n counts all code chunks."""
    p = field_postings(spark, sf_dir)
    lengths = stored(spark, sf_dir, "field_lengths", ("chunks", "files"), lambda: p.groupBy("field", "doc_id").agg(F.sum("tf").alias("dl")), by="field").select("field", "doc_id", "dl")
    n = tables.index_statistics(spark, sf_dir).filter("mode = 'code'").select("n")
    stats = lengths.groupBy("field").agg(F.sum("dl").alias("s")).withColumn("n", n.scalar()).select("field", "n", (F.col("s") / F.col("n")).alias("avg_dl"))
    return p, lengths, stats


_LC = f"(SELECT id, text FROM {LOCATED_SQL} WHERE mode = 'code' AND text IS NOT NULL)"
_FIELDS_SQL = " UNION ALL ".join(
    f"SELECT id AS doc_id, '{n}' AS field, unnest({lower_split_sql(f'coalesce({v}, {chr(39) * 2})')}) AS token FROM {src}"
    for n, v, src in (("name", "name", f"{CHUNKS_SQL} WHERE mode = 'code'"), ("signature", "docmeta.signature", f"{CHUNKS_SQL} WHERE mode = 'code'"), ("doc", "docmeta.doc", f"{CHUNKS_SQL} WHERE mode = 'code'"),
                      ("comment", f"array_to_string(regexp_extract_all(text, '{COMMENT}'), ' ')", _LC), ("body", "text", _LC)))


@query(sql=f"SELECT field, token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ({_FIELDS_SQL}) GROUP BY field, token")
def a02_field_postings(spark, sf_dir):
    return field_postings(spark, sf_dir).groupBy("field", "token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(sql=f"SELECT mode, token, count(*) AS df FROM {NAMED_SQL} GROUP BY mode, token")
def a03_document_frequency(spark, sf_dir):
    return tables.named_postings(spark, sf_dir).groupBy("mode", "token").agg(F.count(F.lit(1)).alias("df"))


@query(sql=f"""SELECT c.mode, count(*) AS docs, round(sum(coalesce(l.dl, 0)) / count(*), 6) AS avg_dl, CASE WHEN sum(coalesce(l.dl, 0)) / count(*) > 800 THEN 1.2::DOUBLE ELSE 1.7::DOUBLE END AS k1,
CASE WHEN sum(coalesce(l.dl, 0)) / count(*) > 800 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS b
FROM {CHUNKS_SQL} c LEFT JOIN (SELECT doc_id, sum(tf) AS dl FROM {POSTINGS_SQL} GROUP BY doc_id) l ON c.id = l.doc_id GROUP BY c.mode""")
def a04_index_statistics(spark, sf_dir):
    """Documents, average length and the BM25 parameters tuned to it (A4, A5), by mode."""
    lengths = tables.postings(spark, sf_dir).groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    c = tables.chunks(spark, sf_dir, "mode").join(lengths, F.col("id") == F.col("doc_id"), "left")
    s = c.groupBy("mode").agg(F.count(F.lit(1)).alias("docs"), (F.sum(F.coalesce("dl", F.lit(0))) / F.count(F.lit(1))).alias("a"))
    long = F.col("a") > 800
    return s.select("mode", "docs", F.round("a", 6).alias("avg_dl"), F.when(long, R.tuned(801)[0]).otherwise(R.tuned(0)[0]).alias("k1"), F.when(long, R.tuned(801)[1]).otherwise(R.tuned(0)[1]).alias("b"))


@query(sql=rf"""SELECT mode, gram, count(DISTINCT id) AS chunks FROM (SELECT id, mode, trim(regexp_replace(unnest(ngrams), '[\x01_\s]+', ' ', 'g')) AS gram FROM {CHUNKS_SQL}) WHERE gram IS NOT NULL AND gram <> '' GROUP BY mode, gram""")
def a06_phrase_postings(spark, sf_dir):
    """Chunks of each phrase, of all phrases."""
    return phrase_postings(spark, sf_dir)


@query(sql=rf"""SELECT mode, gram, count(DISTINCT id) AS chunks FROM (SELECT id, mode, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: substr(w, i, 3)))) AS gram FROM (SELECT id, mode, unnest(list_transform(t, lambda x: '^' || x || '$')) AS w FROM (SELECT id, mode, list_distinct({lower_split_sql("coalesce(name, '')")}) AS t FROM {CHUNKS_SQL}))) GROUP BY mode, gram""")
def a06_chargram_postings(spark, sf_dir):
    """Chunks of each three-character piece of the tokens of their names, with marks at the ends."""
    c = tables.chunks(spark, sf_dir, "mode", "name").select("id", "mode", F.explode(F.array_distinct(X.split_identifier(F.coalesce("name", F.lit(""))))).alias("t"))
    w = F.concat(F.lit("^"), F.col("t"), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))
    return c.select("id", "mode", F.explode(grams).alias("gram")).distinct().groupBy("mode", "gram").agg(F.count(F.lit(1)).alias("chunks"))


def phrase_postings(spark, sf_dir, max_df: int | None = None):
    """(mode, gram, chunks) of each phrase; with max_df, without phrases in more chunks than that."""
    c = tables.chunks(spark, sf_dir, "mode", "ngrams").select("id", "mode", F.explode("ngrams").alias("g"))
    g = c.select("id", "mode", F.trim(F.regexp_replace("g", r"[\x01_\s]+", " ")).alias("gram")).filter("gram != ''").distinct()
    counts = g.groupBy("mode", "gram").agg(F.count(F.lit(1)).alias("chunks"))
    return counts if max_df is None else counts.filter(F.col("chunks") <= max_df)


_FOLD = "list_reduce(list_transform(string_split(x, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT)"
_POWER = "list_reduce(list_transform(string_split(x, ''), lambda c: 31::BIGINT), lambda h, c: (h * c) % 4294967296, 1::BIGINT)"
_SIGN_SQL = f"""(WITH t AS (SELECT doc_id, list_distinct({lower_split_sql('text')}) AS t FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_transform(t, lambda x: [{_FOLD}, {_POWER}]) AS f FROM t WHERE len(t) > 0)
SELECT doc_id, list_transform(range(1, 129), lambda k: list_min(list_transform(f, lambda y: (y[2] * k + y[1]) % 4294967296))) AS signature FROM f)"""


def signatures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return S.minhash(d, "doc_id", "text", words=X.identifier_words)


@query(sql=f"SELECT doc_id, array_to_string(signature, ',') AS signature FROM {_SIGN_SQL}")
def a07_minhash(spark, sf_dir):
    return signatures(spark, sf_dir).select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query(sql=f"""WITH s AS {_SIGN_SQL}, n AS (SELECT count(*) AS n FROM documents), p AS (SELECT CASE WHEN n <= 250 THEN 1 ELSE greatest(1, least(8, n // 250)) END AS stride FROM n)
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, 129), lambda i: (i - 1) % stride = 0)[1:CAST(greatest(16, ceil(128 / stride)) AS INTEGER)], lambda i: signature[i]), ',') AS signature FROM s, p""")
def a08_minhash_sampling(spark, sf_dir):
    """Signatures of an index with more documents than it is made for: of every document fewer slots."""
    stride, slots = S.sampling_plan(table(spark, sf_dir, "documents").count(), 250)
    short = S.shortened(F.col("signature"), stride, slots)
    return signatures(spark, sf_dir).select("doc_id", F.array_join(F.transform(short, lambda x: x.cast("string")), ",").alias("signature"))


@query(sql=f"""WITH s AS {_SIGN_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT a.doc_id AS query_id, b.doc_id,
len(list_filter(range(1, 129), lambda i: a.signature[i] = b.signature[i])) / 128.0 AS score FROM s a, s b WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id)
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def w05_minhash_rank(spark, sf_dir):
    """The ten documents most alike each document whose id is divisible by 100."""
    s = stored(spark, sf_dir, "signatures", ("documents",), lambda: signatures(spark, sf_dir))
    return S.minhash_nearest(s, s.filter("doc_id % 100 = 0"), 10).withColumn("score", F.round("score", 6))


@query(sql=f"WITH {_INDEX_SQL}, {bm25_sql()} SELECT h.doc_id, round(h.score * CASE WHEN coalesce(c.weight, 0) = 0 OR isnan(c.weight) THEN 1 ELSE c.weight END, 6) AS score FROM hits h JOIN {CHUNKS_SQL} c ON h.doc_id = c.id ORDER BY 2 DESC, 1 LIMIT 50")
def w01_bm25(spark, sf_dir):
    """BM25 times the chunk's weight (W1, J1, J2, A9); the fifty best."""
    p, lengths, stats = index(spark, sf_dir)
    c = tables.chunks(spark, sf_dir, "weight").withColumnRenamed("id", "doc_id")
    hits = R.bm25(p, lengths, stats, QUERY).join(c, "doc_id").select("doc_id", F.round(F.col("score") * R.weight_of(F.col("weight")), 6).alias("score"))
    return R.top_k(hits, 50)


@query(sql=f"""WITH f AS ({_FIELDS_SQL}), p AS (SELECT field, token, doc_id, count(*) AS tf FROM f GROUP BY ALL), dl AS (SELECT field, doc_id, sum(tf) AS dl FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n FROM {CHUNKS_SQL} WHERE mode = 'code'), st AS (SELECT field, n.n, sum(dl) / n.n AS avg_dl FROM dl, n GROUP BY field, n.n),
q AS (SELECT * FROM p WHERE token IN {_IN}), df AS (SELECT field, token, count(*) AS df FROM q GROUP BY ALL),
h AS (SELECT q.doc_id, q.field, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * q.tf * 2.2 / (q.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avg_dl)) * ({_QTF.replace('token', 'q.token')})) AS score
FROM q JOIN df USING (field, token) JOIN dl ON q.field = dl.field AND q.doc_id = dl.doc_id JOIN st ON q.field = st.field GROUP BY ALL)
SELECT doc_id, round(sum(score * CASE field WHEN 'name' THEN 2.0::DOUBLE WHEN 'signature' THEN 1.5::DOUBLE WHEN 'doc' THEN 1.2::DOUBLE WHEN 'comment' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM h GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 50""")
def w02_fielded_bm25(spark, sf_dir):
    p, lengths, stats = field_index(spark, sf_dir)
    hits = R.bm25(p, lengths, stats, QUERY, field="field")
    w = F.lit(0.0)
    for name, value in R.FIELD_WEIGHTS["code"].items():
        w = F.when(F.col("field") == name, value).otherwise(w)
    return R.top_k(hits.groupBy("doc_id").agg(F.round(F.sum(F.col("score") * w), 6).alias("score")), 50)


@query(sql=f"""WITH c AS (SELECT id, weight, {lower_split_sql("coalesce(docmeta.doc, '')")} AS t, {lower_split_sql("coalesce(name, '')")} AS h, list_transform(coalesce(ngrams, []), lambda g: regexp_replace(g, '[\\x01_]+', ' ', 'g')) AS g FROM {CHUNKS_SQL}),
s AS (SELECT id AS doc_id, (len(list_filter(['graph', 'lease', 'merge'], lambda x: list_contains(t, x))) + 2 * len(list_filter(['merge graph', 'lease graph'], lambda x: list_contains(g, x)))
 + 3 * len(list_filter(['graph', 'lease', 'merge'], lambda x: list_contains(h, x)))) * CASE WHEN coalesce(weight, 0) = 0 OR isnan(weight) THEN 1 ELSE weight END AS score FROM c)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 50""")
def w03_legacy_score(spark, sf_dir):
    """One for a token, two for an n-gram, three for the headline, times the weight."""
    c = tables.chunks(spark, sf_dir, "weight", "docmeta", "name", "ngrams")
    t, h = X.split_identifier(F.coalesce("docmeta.doc", F.lit(""))), X.split_identifier(F.coalesce("name", F.lit("")))
    g = F.transform(F.coalesce("ngrams", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"[\x01_]+", " "))
    q, qg = F.array(*[F.lit(x) for x in ("graph", "lease", "merge")]), F.array(F.lit("merge graph"), F.lit("lease graph"))
    score = (F.size(F.array_intersect(t, q)) + 2 * F.size(F.array_intersect(g, qg)) + 3 * F.size(F.array_intersect(h, q))) * R.weight_of(F.col("weight"))
    return R.top_k(c.select(F.col("id").alias("doc_id"), F.round(score, 6).alias("score")).filter("score > 0"), 50)


_FTS_SQL = f"""WITH f AS ({_FIELDS_SQL}), p AS (SELECT field, token, doc_id, count(*) AS tf FROM f GROUP BY ALL), dl AS (SELECT field, doc_id, sum(tf) AS dl FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n FROM {CHUNKS_SQL} WHERE mode = 'code'), st AS (SELECT field, n.n, sum(dl) / n.n AS avg_dl FROM dl, n GROUP BY field, n.n),
q AS (SELECT * FROM p WHERE token IN {_IN}), df AS (SELECT field, token, count(*) AS df FROM q GROUP BY ALL),
h AS (SELECT q.doc_id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * q.tf * 2.2 / (q.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avg_dl)) * ({_QTF.replace('token', 'q.token')}) * CASE q.field WHEN 'name' THEN 1.5::DOUBLE WHEN 'signature' THEN 1.2::DOUBLE WHEN 'doc' THEN 1.8::DOUBLE WHEN 'body' THEN 1.0::DOUBLE ELSE 0::DOUBLE END) AS score
FROM q JOIN df USING (field, token) JOIN dl ON q.field = dl.field AND q.doc_id = dl.doc_id JOIN st ON q.field = st.field GROUP BY q.doc_id)"""


@query(sql=_FTS_SQL + " SELECT doc_id, round(CASE WHEN (SELECT max(score) FROM h) = (SELECT min(score) FROM h) THEN 1 ELSE (score - (SELECT min(score) FROM h)) / ((SELECT max(score) FROM h) - (SELECT min(score) FROM h)) END, 6) AS score FROM h")
def w04_fts_normalized(spark, sf_dir):
    """Full-text weights of the balanced profile, min-max normalised over all hits."""
    p, lengths, stats = field_index(spark, sf_dir)
    w = F.lit(0.0)
    for name, value in R.FTS_WEIGHTS["balanced"].items():
        w = F.when(F.col("field") == {"tokens": "body"}.get(name, name), value).otherwise(w)
    hits = R.bm25(p, lengths, stats, QUERY, field="field").groupBy("doc_id").agg(F.sum(F.col("score") * w).alias("score"))
    bounds = hits.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    b = one(bounds)
    return hits.select("doc_id", F.round(F.when(b["hi"] == b["lo"], 1.0).otherwise((F.col("score") - b["lo"]) / (b["hi"] - b["lo"])), 6).alias("score"))


@query(sql="""SELECT query_id, id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10""")
def w06_dense_rank(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    return S.nearest(e, e.filter("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 5))


@query(sql=SQL["w06_dense_rank"])
def w23_pruned_rank(spark, sf_dir):
    """The same from an index of lists around centroids, which is kept; lists that cannot hold a better row are not read."""
    e = table(spark, sf_dir, "embeddings")
    c = S.centroids(e)
    index_ = stored(spark, sf_dir, "vector_lists", ("embeddings",), lambda: S.listed(e, c), lambda df: df.repartition("list").sortWithinPartitions("list"), by="list")
    return S.pruned_nearest(index_, c, e.filter("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 5))


_DENSE_SQL = """d AS (SELECT b.vec_id AS doc_id, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS score
FROM (SELECT * FROM embeddings WHERE vec_id = 0) a, embeddings b ORDER BY 2 DESC, 1 LIMIT 40)"""


def hit_lists(spark, sf_dir):
    """Forty hits of each side; vector ids stand for chunk ids."""
    from quernstone.functions import vectors as V

    p, lengths, stats = index(spark, sf_dir)
    sparse = R.top_k(R.bm25(p, lengths, stats, QUERY), 40)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), V.unit(F.col("embedding")).alias("v"))
    q = e.filter("doc_id = 0").select("v").scalar()
    dense = R.top_k(e.withColumn("q", q).select("doc_id", V.dot(F.col("v"), F.col("q")).alias("score")), 40)
    return sparse, dense


_LISTS_SQL = f"WITH {_INDEX_SQL}, {bm25_sql()}, s AS (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT 40), {_DENSE_SQL}"


@query(sql=_LISTS_SQL + """, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM d)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def w08_rrf_fusion(spark, sf_dir):
    """Reciprocal ranks of two hit lists, by a full outer join."""
    return R.fuse_rrf(*hit_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(sql=_LISTS_SQL + """ SELECT coalesce(s.doc_id, d.doc_id) AS doc_id, round((coalesce(s.score / (SELECT max(score) FROM s) * 0.7, 0) + coalesce((least(greatest(d.score, -1), 1) + 1) / 2 * 0.3, 0)) / (CASE WHEN s.doc_id IS NULL THEN 0 ELSE 0.7 END + CASE WHEN d.doc_id IS NULL THEN 0 ELSE 0.3 END), 6) AS score FROM s FULL JOIN d ON s.doc_id = d.doc_id""")
def w09_blend_fusion(spark, sf_dir):
    return R.fuse_blend(*hit_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(sql=_LISTS_SQL + " SELECT coalesce(s.doc_id, d.doc_id) AS doc_id, round(coalesce(s.score, d.score), 6) AS score, CASE WHEN s.doc_id IS NULL THEN 'dense' ELSE 'sparse' END AS source FROM s FULL JOIN d ON s.doc_id = d.doc_id")
def w10_single_source(spark, sf_dir):
    return R.single_source(*hit_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(sql=f"""WITH {_INDEX_SQL}, {bm25_sql()} SELECT h.doc_id, round(h.score, 6) AS base, round(1 + least(0.5::DOUBLE, 0.1::DOUBLE * len(list_filter(list_transform(coalesce(c.ngrams, []), lambda g: regexp_replace(g, '[\\x01_]+', ' ', 'g')), lambda g: g IN ('merge graph', 'graph lease', 'lease graph')))), 6) AS phrase,
CASE WHEN regexp_matches(lower(c.kind), 'function|class|method|interface|struct|enum|trait|func|fn|type') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN regexp_matches(coalesce(c.docmeta.signature, ''), '^(export|pub)') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS symbol
FROM hits h JOIN {CHUNKS_SQL} c ON h.doc_id = c.id""")
def w11_boosts(spark, sf_dir):
    """Phrase and symbol factors of each hit (W11, W12), as parts of an explained score."""
    p, lengths, stats = index(spark, sf_dir)
    c = tables.chunks(spark, sf_dir, "kind", "docmeta", "ngrams").withColumnRenamed("id", "doc_id")
    h = R.bm25(p, lengths, stats, QUERY).join(c, "doc_id")
    grams = F.transform(F.coalesce("ngrams", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"[\x01_]+", " "))
    matches = F.size(F.filter(grams, lambda g: g.isin("merge graph", "graph lease", "lease graph")))
    return h.select("doc_id", F.round("score", 6).alias("base"), F.round(R.phrase_boost(matches), 6).alias("phrase"),
                    R.symbol_boost(F.col("kind"), F.coalesce(F.col("docmeta.signature"), F.lit("")).rlike("^(export|pub)")).alias("symbol"))


_RELATION_SQL = "least(1.5::DOUBLE, 0.25::DOUBLE * len(list_intersect(list_transform(r.calls, lambda c: lower(c)), ['graph', 'lease', 'merge'])) + 0.1::DOUBLE * len(list_intersect(list_transform(r.usages, lambda c: lower(c)), ['graph', 'lease', 'merge'])))"


@query(sql=f"""WITH {_INDEX_SQL}, {bm25_sql()}, x AS (SELECT h.doc_id, h.score AS base, 1 + least(0.5::DOUBLE, 0.1::DOUBLE * len(list_filter(list_transform(coalesce(c.ngrams, []), lambda g: regexp_replace(g, '[\\x01_]+', ' ', 'g')), lambda g: g IN ('merge graph', 'graph lease', 'lease graph')))) AS phrase,
CASE WHEN regexp_matches(lower(c.kind), 'function|class|method|interface|struct|enum|trait|func|fn|type') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN regexp_matches(coalesce(c.docmeta.signature, ''), '^(export|pub)') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS symbol,
CASE WHEN coalesce(c.weight, 0) = 0 OR isnan(c.weight) THEN 1::DOUBLE ELSE c.weight END AS weight, coalesce({_RELATION_SQL}, 0::DOUBLE) AS relation FROM hits h JOIN {CHUNKS_SQL} c ON h.doc_id = c.id LEFT JOIN {RELATED_SQL} r ON r.id = h.doc_id)
SELECT doc_id, round(base, 6) AS base, round(weight, 6) AS weight, round(phrase, 6) AS phrase, round(symbol, 6) AS symbol, round(relation, 6) AS relation, round(base * weight * phrase * symbol + relation, 6) AS total FROM x""")
def w19_score_breakdown(spark, sf_dir):
    """Every part of the score of each hit, and what they make together."""
    c = tables.chunks(spark, sf_dir, "kind", "docmeta", "ngrams", "weight").withColumnRenamed("id", "doc_id")
    r = relations.related(spark, sf_dir).select(F.col("id").alias("doc_id"), "calls", "usages")
    h = R.bm25(*index(spark, sf_dir), QUERY).join(c, "doc_id").join(r, "doc_id", "left")
    grams = F.transform(F.coalesce("ngrams", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"[\x01_]+", " "))
    matches = F.size(F.filter(grams, lambda g: g.isin("merge graph", "graph lease", "lease graph")))
    low = lambda n: F.transform(F.coalesce(n, F.array().cast("array<string>")), lambda x: F.lower(x))
    exported = F.coalesce(F.col("docmeta.signature"), F.lit("")).rlike("^(export|pub)")
    parts = R.explained(F.col("score"), R.phrase_boost(matches), R.symbol_boost(F.col("kind"), exported), R.relation_boost(low("calls"), low("usages"), F.array(*[F.lit(t) for t in ("graph", "lease", "merge")])), R.weight_of(F.col("weight")))
    return h.select("doc_id", parts.alias("p")).select("doc_id", *[F.round(f"p.{n}", 6).alias(n) for n in ("base", "weight", "phrase", "symbol", "relation", "total")])


@query(sql=f"""WITH {_INDEX_SQL}, {bm25_sql()}, r AS (SELECT h.doc_id, h.score, c.repo, c.mode, c.file, row_number() OVER (PARTITION BY c.repo, c.mode ORDER BY h.score DESC, h.doc_id) AS rank FROM hits h JOIN {CHUNKS_SQL} c ON h.doc_id = c.id)
SELECT r.repo, r.mode, r.doc_id, round(1.0 / (60 + r.rank), 12) AS score, coalesce(p.priority, 0) AS priority FROM r LEFT JOIN repos p ON r.repo = p.repo WHERE r.rank <= 5""")
def w17_federated_merge(spark, sf_dir):
    """Reciprocal ranks within each repo and mode; hits of different repos are not added up."""
    from pyspark.sql import Window

    p, lengths, stats = index(spark, sf_dir)
    c = tables.chunks(spark, sf_dir, "repo", "mode").withColumnRenamed("id", "doc_id")
    order = [F.desc("score"), F.asc("doc_id")]
    best = keyed.top_n(R.bm25(p, lengths, stats, QUERY).join(c, "doc_id"), ["repo", "mode"], order, 5)  # five of each are left to rank
    h = best.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "mode").orderBy(*order)))
    repos = table(spark, sf_dir, "repos").select("repo", "priority")
    return h.join(repos, "repo", "left").select("repo", "mode", "doc_id", F.round(1.0 / (60 + F.col("rank")), 12).alias("score"), F.coalesce("priority", F.lit(0)).alias("priority"))


@query(sql=f"""WITH {_INDEX_SQL}, {bm25_sql()}, k AS (SELECT id, name FROM {CHUNKS_SQL} WHERE mode = 'code' AND lower(kind) LIKE '%function%') SELECT h.doc_id, k.name, round(h.score, 6) AS score FROM hits h JOIN k ON h.doc_id = k.id""")
def j04_allowed_hits(spark, sf_dir):
    """Hits cut to allowed chunks by a semi join; document frequencies stay those of the whole index."""
    p, lengths, stats = index(spark, sf_dir)
    allowed = tables.chunks(spark, sf_dir, "mode", "kind", "name").filter("mode = 'code' and lower(kind) like '%function%'").select(F.col("id").alias("doc_id"), "name")
    hits = R.bm25(p, lengths, stats, QUERY).join(allowed.select("doc_id"), "doc_id", "left_semi")
    return hits.join(allowed, "doc_id").select("doc_id", "name", F.round("score", 6).alias("score"))


@query(sql=f"SELECT DISTINCT doc_id FROM {NAMED_SQL} WHERE mode = 'code' AND token IN {_IN}")
def j06_candidate_ids(spark, sf_dir):
    return tables.named_postings(spark, sf_dir).filter(F.col("token").isin("graph", "lease", "merge") & (F.col("mode") == "code")).select("doc_id").distinct()


def _w14_sql():
    from quernstone.queries.graphs import _EDGES_SQL

    return f"""WITH {_INDEX_SQL}, {bm25_sql()}, {_EDGES_SQL}, hh AS (SELECT doc_id, score, 'c' || doc_id AS node FROM hits ORDER BY score DESC, doc_id LIMIT 100), bs AS (SELECT node FROM hh ORDER BY score DESC, doc_id LIMIT 3),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), l1 AS (SELECT DISTINCT u.dst AS node FROM bs JOIN u ON u.src = bs.node WHERE u.dst NOT IN (SELECT node FROM bs)),
l2 AS (SELECT DISTINCT u.dst AS node FROM l1 JOIN u ON u.src = l1.node WHERE u.dst NOT IN (SELECT node FROM bs UNION SELECT node FROM l1)),
nr AS (SELECT node, 1.0 AS p FROM bs UNION ALL SELECT node, 0.5 FROM l1 UNION ALL SELECT node, 1.0 / 3 FROM l2), dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)
SELECT hh.doc_id, round(hh.score + 0.01 * coalesce(dg.degree, 0) + 0.2 * coalesce(nr.p, 0), 6) AS score FROM hh LEFT JOIN dg ON hh.node = dg.node LEFT JOIN nr ON hh.node = nr.node"""


@query(sql=_w14_sql())
def w14_graph_rerank(spark, sf_dir):
    """Hits reranked by their degree in the graphs of the index and their nearness to the first three."""
    from quernstone.operators import codegraph, graph as G

    hits = R.top_k(R.bm25(*index(spark, sf_dir), QUERY), 100)
    return G.rerank(hits, codegraph.edges(spark, sf_dir), 0.01, 0.2, 2, 3, lambda c: F.concat(F.lit("c"), c.cast("string"))).withColumn("score", F.round("score", 6))
