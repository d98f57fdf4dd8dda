"""Tokenization, n-grams, windows and vectors of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as X, vectors as V
from quernstone.operators import tables
from quernstone.operators.tables import CHUNKS_SQL, FILES_SQL
from quernstone.queries import query
from quernstone.runtime import table


def split_sql(column: str) -> str:
    return rf"list_filter(string_split(regexp_replace(regexp_replace({column}, '[^a-zA-Z0-9]+', ' ', 'g'), '([A-Z])', ' \1', 'g'), ' '), lambda t: t <> '')"


def lower_split_sql(column: str) -> str:
    return f"list_transform({split_sql(column)}, lambda t: lower(t))"


@query(sql=f"SELECT id, array_to_string({lower_split_sql('name')}, ' ') AS tokens FROM {CHUNKS_SQL} WHERE name IS NOT NULL")
def t01_identifier_split(spark, sf_dir):
    return tables.chunks(spark, sf_dir, "name").filter("name is not null").select("id", F.array_join(X.split_identifier(F.col("name")), " ").alias("tokens"))


@query(sql=f"SELECT id, array_to_string({split_sql('docmeta.signature')}, ' ') AS tokens FROM {CHUNKS_SQL} WHERE docmeta.signature IS NOT NULL")
def t02_case_preserving_split(spark, sf_dir):
    c = tables.chunks(spark, sf_dir, "docmeta").filter("docmeta.signature is not null")
    return c.select("id", F.array_join(X.split_keep_case(F.col("docmeta.signature")), " ").alias("tokens"))


@query(sql=rf"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '[=<>!:+\-*/%&|^~.?]{{1,4}}|[()\[\]{{}}.,;:]')) AS token FROM {FILES_SQL}) GROUP BY token")
def t03_punctuation_tokens(spark, sf_dir):
    f = tables.files(spark, sf_dir, "content")
    return f.select(F.explode(X.punctuation(F.col("content"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_GRAMS = "list_distinct(list_transform(range(1, len(t) - {m} + 1), lambda i: array_to_string(t[i:i+{m}], chr(1))))"


@query(sql=f"""SELECT doc_id, len(t) AS tokens, len({_GRAMS.format(m=1)}) AS bigrams, len({_GRAMS.format(m=2)}) AS trigrams, len({_GRAMS.format(m=3)}) AS fourgrams
FROM (SELECT doc_id, {lower_split_sql('text')} AS t FROM documents WHERE text IS NOT NULL)""")
def t08_token_ngrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", X.split_identifier(F.col("text")).alias("t"))
    n = lambda k: F.size(F.array_distinct(X.token_ngrams(F.col("t"), k, k))).cast("long")
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), n(2).alias("bigrams"), n(3).alias("trigrams"), n(4).alias("fourgrams"))


_CHARS = "SELECT DISTINCT mode, w, unnest(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))) AS gram FROM (SELECT mode, chr(10220) || lower(token) || chr(10221) AS w FROM token_vocab WHERE token IS NOT NULL)"


@query(sql=f"SELECT mode, gram, count(*) AS tokens FROM ({_CHARS}) GROUP BY mode, gram")
def t09_char_ngrams(spark, sf_dir):
    v = table(spark, sf_dir, "token_vocab").filter("token is not null").select("mode", F.lower("token").alias("token")).distinct()
    grams = v.select("mode", "token", F.explode(F.array_distinct(X.char_ngrams(F.col("token")))).alias("gram"))
    return grams.groupBy("mode", "gram").agg(F.count(F.lit(1)).alias("tokens"))


@query(sql=f"SELECT mode, count(DISTINCT gram) AS grams, count(DISTINCT gram) AS hashes FROM ({_CHARS}) GROUP BY mode")
def t10_chargram_hash(spark, sf_dir):
    v = table(spark, sf_dir, "token_vocab").filter("token is not null").select("mode", F.lower("token").alias("token")).distinct()
    grams = v.select("mode", F.explode(X.char_ngrams(F.col("token"))).alias("gram"))
    return grams.groupBy("mode").agg(F.count_distinct("gram").alias("grams"), F.count_distinct(F.xxhash64("gram")).alias("hashes"))


# Reserved words that tell keywords from identifiers, over the languages of the files.
KEYWORDS = (
    "and as async await break case class const continue def default defer do elif else enum export extends fn for from func function go if impl import in interface let match mod mut "
    "new not or package pass pub raise range return select self static struct switch throw try type use var void while with yield"
).split()
_LITERAL = r"\"[^\"\n]*\"|'[^'\n]*'|\b[0-9][0-9a-fA-FxX._]*\b"
_IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"


@query(sql=rf"""
WITH t AS (SELECT suffix, regexp_extract_all(content, '{_LITERAL.replace("'", "''")}') AS lit, regexp_replace(content, '{_LITERAL.replace("'", "''")}', ' ', 'g') AS body FROM {FILES_SQL} WHERE content IS NOT NULL),
w AS (SELECT suffix, len(lit) AS literals, regexp_extract_all(body, '{_IDENT}') AS words, len(regexp_extract_all(body, '[=<>!:+\-*/%&|^~.?]{{1,4}}|[()\[\]{{}}.,;:]')) AS operators FROM t)
SELECT suffix, CAST(sum(len(list_filter(words, lambda x: x IN ({", ".join(f"'{k}'" for k in KEYWORDS)})))) AS BIGINT) AS keywords,
  CAST(sum(len(list_filter(words, lambda x: x NOT IN ({", ".join(f"'{k}'" for k in KEYWORDS)})))) AS BIGINT) AS identifiers,
  CAST(sum(literals) AS BIGINT) AS literals, CAST(sum(operators) AS BIGINT) AS operators FROM w GROUP BY suffix""")
def t11_token_classification(spark, sf_dir):
    f = tables.files(spark, sf_dir, "suffix", "content").filter("content is not null")
    body = F.regexp_replace("content", _LITERAL, " ")
    words = F.regexp_extract_all(body, F.lit(f"({_IDENT})"), F.lit(1))
    known = lambda x: x.isin(KEYWORDS)
    t = f.select(
        "suffix", F.size(F.filter(words, known)).alias("k"), F.size(F.filter(words, lambda x: ~known(x))).alias("i"),
        F.size(F.regexp_extract_all("content", F.lit(f"({_LITERAL})"), F.lit(1))).alias("l"), F.size(F.regexp_extract_all(body, F.lit(f"({X.PUNCTUATION})"), F.lit(1))).alias("o"))
    return t.groupBy("suffix").agg(F.sum("k").alias("keywords"), F.sum("i").alias("identifiers"), F.sum("l").alias("literals"), F.sum("o").alias("operators"))


_CHUNK_TEXT = "coalesce(name, '') || ' ' || coalesce(docmeta.signature, '') || ' ' || coalesce(docmeta.doc, '')"


@query(sql=f"""
WITH c AS (SELECT id, {lower_split_sql(_CHUNK_TEXT)} AS t FROM {CHUNKS_SQL})
SELECT id, len(t) AS tokens, len(list_distinct(t)) AS vocabulary,
  greatest(len(t) - 1, 0) + greatest(len(t) - 2, 0) + greatest(len(t) - 3, 0) AS ngrams, CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS chargrams FROM c""")
def t12_chunk_tokenization(spark, sf_dir):
    c = tables.chunks(spark, sf_dir, "name", "docmeta")
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("docmeta.signature", F.lit("")), F.coalesce("docmeta.doc", F.lit("")))
    t = c.select("id", X.split_identifier(text).alias("t"))
    chars = F.aggregate(F.transform("t", lambda x: F.size(X.char_ngrams(x))), F.lit(0), lambda s, n: s + n)
    return t.select("id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("vocabulary"),
                    F.size(X.token_ngrams(F.col("t"))).cast("long").alias("ngrams"), chars.cast("long").alias("chargrams"))


@query(sql=f"""SELECT id, len(t) AS full_tokens, array_to_string(t[1:8], ' ') AS sampled, 0::BIGINT AS none_tokens FROM (SELECT id, {lower_split_sql('docmeta.doc')} AS t FROM {CHUNKS_SQL} WHERE docmeta.doc IS NOT NULL)""")
def t13_token_retention(spark, sf_dir):
    c = tables.chunks(spark, sf_dir, "docmeta").filter("docmeta.doc is not null").select("id", X.split_identifier(F.col("docmeta.doc")).alias("t"))
    return c.select("id", F.size(X.retained(F.col("t"), "full")).cast("long").alias("full_tokens"), F.array_join(X.retained(F.col("t"), "sample", 8), " ").alias("sampled"),
                    F.size(X.retained(F.col("t"), "none")).cast("long").alias("none_tokens"))


@query(sql="SELECT doc_id, w AS start, least(w + 800, length(text)) AS \"end\", substring(text, CAST(w + 1 AS BIGINT), 800) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS w FROM documents WHERE text <> '')")
def t14_fixed_slices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    w = d.select("doc_id", "text", F.explode(X.windows(F.col("text"), 800)).alias("w"))
    return w.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"), F.substring("text", F.col("w.start") + 1, F.lit(800)).alias("piece"))


@query(sql=r"""SELECT doc_id, CAST(floor((k - 1) / 12) AS BIGINT) AS part, count(*) AS lines, CAST(sum(length(l)) AS BIGINT) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, part""")
def t19_split_by_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "l"))
    return d.groupBy("doc_id", F.floor(F.col("k") / 12).alias("part")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("l")).alias("chars"))


@query(sql="SELECT doc_id, length(text) > 1200 AS windowed, CASE WHEN length(text) > 1200 THEN CAST(ceil(length(text) / 240.0) AS BIGINT) ELSE 1 END AS pieces FROM documents WHERE text <> ''")
def t21_large_prose_windows(spark, sf_dir):
    """Prose beyond a size falls into windows; the sizes are a hundredth of the defaults, as texts here are short."""
    d = table(spark, sf_dir, "documents").filter("text != ''")
    large = F.length("text") > 1200
    return d.select("doc_id", large.alias("windowed"), F.when(large, F.size(X.windows(F.col("text"), 240))).otherwise(1).cast("long").alias("pieces"))


@query(sql="SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def t37_l2_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(sql="""WITH u AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
SELECT vec_id, list_transform(v, lambda x: CAST(least(greatest(floor((x::DOUBLE / n + 1) * 255 / 2.0 + 0.5), 0), 255) AS INTEGER)) AS q FROM u""")
def t38_quantize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.quantize(V.unit(F.col("embedding"))).alias("q"))


@query(sql="""WITH u AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
q AS (SELECT vec_id, list_transform(v, lambda x: least(greatest(floor((x::DOUBLE / n + 1) * 255 / 2.0 + 0.5), 0), 255)) AS q, list_transform(v, lambda x: x::DOUBLE / n) AS w FROM u)
SELECT vec_id, round(list_max(list_transform(range(1, len(q) + 1), lambda i: abs(q[i] * (2.0 / 255) - 1 - w[i]))), 6) AS worst FROM q""")
def t38_dequantize_error(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("w"))
    back = F.zip_with(V.dequantize(V.quantize(F.col("w"))), F.col("w"), lambda a, b: F.abs(a - b))
    return e.select("vec_id", F.round(F.array_max(back), 6).alias("worst"))


@query(sql="""SELECT a.vec_id, list_transform(range(1, 65), lambda i: round((a.embedding[i]::DOUBLE + coalesce(b.embedding, a.embedding)[i]::DOUBLE) / 2, 6)) AS v
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND b.vec_id % 2 = 1""")
def t36_merge_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("doc"))
    return e.join(other, "vec_id", "left").select("vec_id", F.transform(V.merge(F.col("embedding"), F.col("doc")), lambda x: F.round(x, 6)).alias("v"))


@query(sql="""SELECT vec_id, list_concat(list_transform(CASE WHEN vec_id % 3 = 0 THEN [] ELSE embedding END, lambda x: CAST(floor(x::DOUBLE) AS INTEGER)), list_transform(range(80), lambda i: 128))[1:72] AS q FROM embeddings""")
def t39_fitted_vectors(spark, sf_dir):
    """Vectors of a third of the rows are missing and become the fallback; the others are padded to more dimensions."""
    e = table(spark, sf_dir, "embeddings")
    have = F.when(F.col("vec_id") % 3 != 0, F.transform("embedding", lambda x: F.floor(x.cast("double")).cast("int")))
    return e.select("vec_id", V.fitted(have, 72).alias("q"))
