"""Decisions of a search, over whole tables of queries: plans, intents, budgets, candidates, routes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.functions import text as X
from quernstone.operators import ranking as R, tables
from quernstone.operators.tables import CHUNKS_SQL
from quernstone.plans import policies as P, query as Q
from quernstone.queries import query
from quernstone.queries.text import lower_split_sql
from quernstone.runtime import table

# what is asked: each evaluation query as it is, and in forms that make a plan decide otherwise
_FORMS = {0: "query", 1: "query || ' (open'", 2: "query || ' \"held out\" -retry'", 3: "query || '*'", 4: "query || ' 漢字'"}
_ASKED_SQL = "(SELECT item_id, CASE item_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _FORMS.items()) + " END AS q FROM eval_items WHERE query IS NOT NULL AND item_id IS NOT NULL)"


def asked(spark, sf_dir):
    k = F.col("item_id") % 5
    q = F.when(k == 1, F.concat("query", F.lit(" (open"))).when(k == 2, F.concat("query", F.lit(' "held out" -retry'))).when(k == 3, F.concat("query", F.lit("*"))).when(k == 4, F.concat("query", F.lit(" 漢字"))).otherwise(F.col("query"))
    return table(spark, sf_dir, "eval_items").filter("query is not null and item_id is not null").select("item_id", q.alias("q"))


_WORDS = "list_filter(string_split_regex(trim({}), '\\s+'), lambda w: w <> '')"
_PLAN = StructType([StructField("item_id", LongType()), StructField("fallback", BooleanType()), *[StructField(n, ArrayType(StringType())) for n in ("terms", "phrases", "excluded", "tokens", "grams")], StructField("variant", StringType())])


def plans(spark, sf_dir):
    def make():
        def kernel(item_id, q):
            p = Q.plan(q)
            yield item_id, p.fallback is not None, p.flat.terms, p.flat.phrases, p.flat.not_terms + p.flat.not_phrases, p.tokens, p.grams, ":".join(p.variant)
        return kernel
    return map_rows(asked(spark, sf_dir), make, _PLAN)


@query(sql=f"""WITH a AS (SELECT item_id, q, item_id % 5 = 1 AS fallback, {_WORDS.format("regexp_replace(q, '[()]', ' ', 'g')")} AS w FROM {_ASKED_SQL})
SELECT item_id, fallback, array_to_string(list_filter(w, lambda x: NOT contains(x, '"') AND NOT starts_with(x, '-') AND x NOT IN ('held', 'out') AND (fallback OR lower(x) NOT IN ('and', 'or', 'not'))), '|') AS terms,
CASE WHEN item_id % 5 = 2 THEN 'held out' ELSE '' END AS phrases, CASE WHEN item_id % 5 = 2 THEN 'retry' ELSE '' END AS excluded FROM a""")
def q04_parsed_or_split(spark, sf_dir):
    """Terms, phrases and exclusions of queries; what does not parse is split into words (Q1-Q4)."""
    join = lambda c: F.array_join(c, "|").alias(c)
    return plans(spark, sf_dir).select("item_id", "fallback", join("terms"), join("phrases"), join("excluded"))


@query(sql=f"""SELECT item_id, CASE item_id % 5 WHEN 3 THEN 'trigram:substring_mode' WHEN 4 THEN 'trigram:cjk_or_emoji' ELSE 'unicode61:default_unicode61' END AS variant FROM {_ASKED_SQL}""")
def q08_fts_variants(spark, sf_dir):
    return plans(spark, sf_dir).select("item_id", "variant")


@query(sql=f"""WITH a AS (SELECT item_id, q, item_id % 5 = 1 AS fallback FROM {_ASKED_SQL}), w AS (SELECT *, list_filter({_WORDS.format("regexp_replace(q, '[()]', ' ', 'g')")}, lambda x: NOT contains(x, '"') AND NOT starts_with(x, '-') AND x NOT IN ('held', 'out') AND (fallback OR lower(x) NOT IN ('and', 'or', 'not'))) AS t FROM a)
SELECT item_id, array_to_string(list_concat({lower_split_sql("array_to_string(t, ' ')")}, CASE WHEN item_id % 5 = 2 THEN ['held', 'out'] ELSE [] END), ' ') AS tokens, CASE WHEN item_id % 5 = 2 THEN 'held out' ELSE '' END AS grams FROM w""")
def q11_query_plans(spark, sf_dir):
    """What a plan looks up: tokens of terms and phrases, and the n-grams of phrases."""
    return plans(spark, sf_dir).select("item_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("grams", " ").alias("grams"))


_URL = "(?i)\\b(?:[a-z][a-z0-9+.-]*://\\S+|www\\.[^\\s/$.?#].\\S*)"
_START = "(?:^|[\\s\"''`])(?:\\.{1,2}[\\\\/]|[A-Za-z]:[\\\\/]|~[\\\\/]|/(?:[^/]|$))"
_INTENT_SQL = f"""w AS (SELECT id, of, q, fb, list_filter(string_split_regex(trim(coalesce(q, '')), '\\s+'), lambda x: x <> '') AS w FROM i),
s AS (SELECT *, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z0-9_]+'))) AS plain, len(list_filter(w, lambda x: regexp_matches(x, '[^A-Za-z0-9_]'))) AS odd, coalesce(regexp_matches(q, '{_URL}'), false) AS url,
 coalesce(regexp_matches(q, '[a-z][A-Z]') OR contains(q, '_'), false) AS named, len(list_filter(w, lambda x: regexp_full_match(x, '[^\\\\/\\s]+[\\\\/][^\\\\/\\s]+[\\\\/]\\S+') OR regexp_full_match(x, '[^\\s]*[^\\\\/\\s]+[\\\\/][^\\s]*\\.[A-Za-z0-9]{{1,12}}[,;:.!?]?'))) > 0 AS pathlike FROM w),
g AS (SELECT *, NOT url AND (coalesce(regexp_matches(q, '{_START}'), false) OR pathlike) AS pth, coalesce(regexp_matches(q, '[{{}}()\\[\\];:<>.=]|->|\\+\\+|--|\\|\\||&&'), false) OR odd > 0 AS punct FROM s),
k AS (SELECT *, (CASE WHEN punct THEN 2 ELSE 0 END) + (CASE WHEN named THEN 1 ELSE 0 END) + (CASE WHEN odd >= 2 THEN 1 ELSE 0 END) AS code, (CASE WHEN url THEN 1 ELSE 0 END) + (CASE WHEN plain >= 3 THEN 2 ELSE 0 END) AS prose,
 CASE WHEN pth THEN 3 ELSE 0 END AS path, CASE WHEN url THEN 4 ELSE 0 END AS u FROM g),
t AS (SELECT *, list_reverse_sort([code, prose, path, u]) AS o FROM k),
y AS (SELECT *, CASE WHEN o[1] = 0 THEN 'mixed' WHEN u >= 4 AND u = o[1] THEN 'url' WHEN path >= 3 AND path = o[1] THEN 'path' WHEN o[1] >= 2 AND o[1] - o[2] <= 1 THEN 'mixed' WHEN code = o[1] THEN 'code' WHEN prose = o[1] THEN 'prose' ELSE 'path' END AS type FROM t),
c AS (SELECT *, round(least(1, greatest(0, 0.42::DOUBLE + 0.28::DOUBLE * least(1, o[1] / 6) + 0.2::DOUBLE * least(1, (o[1] - o[2]) / 4) + 0.08::DOUBLE * least(1, (pth::INT + url::INT + punct::INT + named::INT + (plain >= 3)::INT) / 5)
 + CASE WHEN type = 'path' AND pth THEN 0.1::DOUBLE WHEN type = 'url' AND url THEN 0.12::DOUBLE WHEN type = 'code' AND (punct OR named) THEN 0.06::DOUBLE WHEN type = 'prose' AND plain >= 4 THEN 0.06::DOUBLE WHEN type = 'mixed' THEN -0.18::DOUBLE ELSE 0::DOUBLE END - CASE WHEN fb THEN 0.06::DOUBLE ELSE 0::DOUBLE END)), 6) AS confidence FROM y),
b AS (SELECT *, CASE WHEN confidence >= 0.78 THEN 'high' WHEN confidence >= 0.56 THEN 'medium' ELSE 'low' END AS bucket FROM c),
e AS (SELECT *, CASE WHEN bucket = 'low' THEN 'mixed' ELSE type END AS effective FROM b)"""


@query(sql=f"""WITH i AS (SELECT item_id AS id, 'item' AS of, query AS q, item_id % 3 = 0 AS fb FROM eval_items UNION ALL SELECT id, 'file', file, false FROM {CHUNKS_SQL} UNION ALL SELECT id, 'name', name, false FROM {CHUNKS_SQL} UNION ALL SELECT id, 'signature', docmeta.signature, false FROM {CHUNKS_SQL}), {_INTENT_SQL}
SELECT id, of, code, prose, path, u AS url, type, confidence, bucket, effective, CASE effective WHEN 'prose' THEN 'doc' WHEN 'url' THEN 'doc' WHEN 'code' THEN 'code' WHEN 'path' THEN 'code' END AS vector_mode FROM e""")
def q09_intents(spark, sf_dir):
    """What each evaluation query, and each file, name and signature of a chunk as a query, is after, and how sure that is (Q9, Q10)."""
    e = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), F.col("query").alias("q"), F.lit("item").alias("of"), (F.col("item_id") % 3 == 0).alias("fb"))
    c = tables.chunks(spark, sf_dir, "file", "name", "docmeta")
    of = lambda n, v: c.select("id", F.col(v).alias("q"), F.lit(n).alias("of"), F.lit(False).alias("fb"))
    every = e.unionByName(of("file", "file")).unionByName(of("name", "name")).unionByName(of("signature", "docmeta.signature"))
    return every.select("id", "of", Q.intent(F.col("q"), F.col("fb")).alias("i")).select("id", "of", "i.*")


@query(sql=f"""WITH i AS (SELECT id, 'file' AS of, file AS q, false AS fb FROM {CHUNKS_SQL}), {_INTENT_SQL}, w2 AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{f}', {w}::DOUBLE)" for k, fs in R.FIELD_WEIGHTS.items() for f, w in fs.items())}) v(kind, field, weight))
SELECT effective, field, count(*) AS queries, round(sum(weight), 6) AS weight FROM e JOIN w2 ON e.effective = w2.kind GROUP BY effective, field""")
def q10_intent_weights(spark, sf_dir):
    """Weights of fields that queries take by what they are after (Q10)."""
    weights = F.create_map(*[x for k, fs in R.FIELD_WEIGHTS.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for pair in fs.items() for y in pair]))])
    effective = tables.chunks(spark, sf_dir, "file").select(Q.intent(F.col("file"))["effective"].alias("effective"))
    per = effective.select("effective", F.explode(weights[F.col("effective")]).alias("field", "w"))
    return per.groupBy("effective", "field").agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum("w"), 6).alias("weight"))


# names of chunks as queries, with figures of their rows as those of a search
_SEARCH_SQL = f"""x AS (SELECT id, mode, {lower_split_sql("coalesce(name, '')")} AS t, len(coalesce(ngrams, [])) AS hits, greatest(coalesce(weight, 0), coalesce(churn, 0) / 10) AS first, least(coalesce(weight, 0), coalesce(churn, 0) / 10) AS second, coalesce(startLine, 0) % 40 AS dense,
coalesce(file, '') AS f FROM {CHUNKS_SQL} WHERE NOT isnan(coalesce(weight, 0)) AND NOT isnan(coalesce(churn, 0)))"""


def searches(spark, sf_dir):
    c = tables.chunks(spark, sf_dir, "mode", "name", "ngrams", "weight", "churn", "startLine", "file").filter(~F.isnan(F.coalesce("weight", F.lit(0.0))) & ~F.isnan(F.coalesce("churn", F.lit(0.0))))
    w, k = F.coalesce("weight", F.lit(0.0)), F.coalesce("churn", F.lit(0.0)) / 10
    return c.select("id", "mode", X.split_identifier(F.coalesce("name", F.lit(""))).alias("t"), F.size(F.coalesce("ngrams", F.array().cast("array<string>"))).alias("hits"), F.greatest(w, k).alias("first"), F.least(w, k).alias("second"),
                    (F.coalesce("startLine", F.lit(0)) % 40).alias("dense"), F.coalesce("file", F.lit("")).alias("f"))


@query(sql=f"""WITH {_SEARCH_SQL}, y AS (SELECT *, len(t) AS n, CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END AS variety, first > 0 AND second >= 0 AND (first - second) / first >= 0.2 AND hits >= 20 AS leads FROM x)
SELECT id, CASE WHEN leads AND n <= 2 THEN 4 WHEN n >= 7 OR variety >= 0.9 OR hits < 8 OR dense >= 20 THEN 9 WHEN n <= 3 THEN 6 ELSE 8 END AS slack,
CASE WHEN leads AND n <= 2 THEN 'high_confidence_low_entropy' WHEN n >= 7 OR variety >= 0.9 OR hits < 8 OR dense >= 20 THEN 'high_entropy_or_low_confidence' WHEN n <= 3 THEN 'moderate_confidence_short_query' ELSE 'baseline' END AS reason FROM y""")
def w16_rerank_budgets(spark, sf_dir):
    s = searches(spark, sf_dir)
    b = P.rerank_budget(P.query_signals(F.col("t")), F.col("hits"), F.col("first"), F.col("second"), F.col("dense"))
    return s.select("id", b.alias("b")).select("id", "b.slack", "b.reason")


@query(sql="""WITH d AS (SELECT doc_id, n_chars % 30000 AS c, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 0 ELSE doc_id % 900 END AS a, doc_id % 2 = 0 AS f FROM documents)
SELECT doc_id, CASE WHEN c = 0 AND f AND coalesce(a, 0) > 0 THEN 'allowed' WHEN c = 0 AND f AND a IS NOT NULL THEN 'nothing' WHEN c = 0 THEN 'all' WHEN c > 20000 AND f THEN 'candidates' WHEN c > 20000 THEN 'all' WHEN c < 100 AND f AND coalesce(a, 0) > 0 THEN 'allowed' WHEN c < 100 THEN 'all' ELSE 'candidates' END AS among,
CASE WHEN (c = 0 OR c < 100) AND f AND coalesce(a, 0) > 0 THEN 'filtersActiveAllowedIdx' WHEN c = 0 THEN 'noCandidates' WHEN c > 20000 THEN 'tooLarge' WHEN c < 100 THEN 'tooSmallNoFilters' ELSE 'ok' END AS reason FROM d""")
def w20_candidate_policy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    allowed = F.when(k == 0, None).when(k == 1, 0).otherwise(F.col("doc_id") % 900)
    return d.select("doc_id", P.candidate_policy(F.col("n_chars") % 30000, allowed, F.col("doc_id") % 2 == 0).alias("p")).select("doc_id", "p.among", "p.reason")


_ODD = "len(regexp_replace(f, '[0-9A-Za-z_]', '', 'g')) / nullif(len(f), 0)"


@query(sql=f"""WITH {_SEARCH_SQL}, y AS (SELECT *, id % 90 AS cand, id * 10 AS docs, coalesce({_ODD}, 0) >= 0.3 AS heavy, len(f) > 0 AND len(f) <= 18 AS short FROM x)
SELECT id, CASE WHEN id % 7 = 0 THEN 'filtersActive' WHEN docs > 0 AND docs <= 64 THEN 'smallIndexBypass' WHEN cand > 0 AND cand <= 16 THEN 'lowCandidateBypass' WHEN cand > 0 AND cand <= 64 AND short AND heavy THEN 'queryClassBypass' ELSE 'routeVector' END AS route_reason,
CASE WHEN id % 7 = 0 THEN 'vector' WHEN (docs > 0 AND docs <= 64) OR (cand > 0 AND cand <= 16) OR (cand > 0 AND cand <= 64 AND short AND heavy) THEN 'sparse' ELSE 'vector' END AS route,
CASE WHEN heavy THEN 'hnsw,sqlite-vector,dense' WHEN docs >= 50000 THEN 'hnsw,sqlite-vector,dense' WHEN cand >= 16 THEN 'dense,sqlite-vector,hnsw' WHEN mode IN ('prose', 'extracted-prose') THEN 'hnsw,sqlite-vector,dense' ELSE 'dense,hnsw,sqlite-vector' END AS providers,
CASE WHEN heavy THEN 'symbolHeavyQuery' WHEN docs >= 50000 THEN 'largeIndex' WHEN cand >= 16 THEN 'smallCandidateSet' WHEN mode IN ('prose', 'extracted-prose') THEN 'proseHeavyMode' ELSE 'unchanged' END AS order_reason FROM y""")
def w21_routes(spark, sf_dir):
    """Files of chunks as queries: where a search of them goes, and to which providers first."""
    s = searches(spark, sf_dir).withColumns({"q": P.query_signals(F.filter(F.array("f"), lambda x: x != "")), "cand": F.col("id") % 90, "docs": F.col("id") * 10})
    r = P.route(F.col("q"), F.col("docs"), F.col("cand"), F.col("id") % 7 == 0, F.lit(3))
    o = P.provider_order(F.col("q"), F.col("mode"), F.col("docs"), F.col("cand"), ["dense", "hnsw", "sqlite-vector"])
    return s.select("id", r.alias("r"), o.alias("o")).select("id", "r.route", F.col("r.reason").alias("route_reason"), F.array_join("o.providers", ",").alias("providers"), F.col("o.reason").alias("order_reason"))


@query(sql="""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'vector' WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'vector_allowed' WHEN n_chars > 0 AND n_chars <= 5000 AND doc_id % 5 <> 0 THEN 'minhash' WHEN doc_id % 3 = 0 AND doc_id <= 5000 THEN 'minhash_allowed' ELSE 'none' END AS source
FROM documents WHERE doc_id > 0""")
def w22_fallbacks(spark, sf_dir):
    """Where the hits of a dense stage come from, by what each step before found."""
    d = table(spark, sf_dir, "documents").filter("doc_id > 0")
    n = lambda c, v: F.when(c, v).otherwise(0)
    k = F.col("doc_id")
    return d.select("doc_id", P.fallback_source(n(k % 4 == 0, 5), n(k % 2 == 1, 2), n(k % 5 != 0, F.col("n_chars")), n(k % 3 == 0, k)).alias("source"))


@query(sql="""SELECT pattern, safe FROM (VALUES ('a+b', true), ('(a+)+b', false), ('(\\w+)\\1', false), ('(?=x)y', false), ('[unclosed', false), ('^src/.*\\.js$', true), (repeat('ab|', 400) || 'c', true)) v(pattern, safe)""")
def f32_safe_patterns(spark, sf_dir):
    from quernstone.plans.filters import safe_pattern

    given = ["a+b", "(a+)+b", r"(\w+)\1", "(?=x)y", "[unclosed", r"^src/.*\.js$", "ab|" * 400 + "c"]
    return spark.createDataFrame([(p, safe_pattern(p)) for p in given], "pattern string, safe boolean")


@query
def t05_expanded_tokens(spark, sf_dir):
    """Vocabulary tokens, as of a query, as the words to look for: short and known ones stay, others are cut into words of a dictionary."""
    from quernstone.queries.build import WORDS

    known = frozenset(WORDS)
    v = table(spark, sf_dir, "token_vocab").filter("token is not null").select(F.lower("token").alias("token")).distinct()

    def make():
        def kernel(token):
            yield token, " ".join(P.expand(token, known))
        return kernel
    return map_rows(v, make, StructType([StructField("token", StringType()), StructField("words", StringType())]))


@query(sql="""WITH r AS (SELECT DISTINCT repo, '漢字仮名' || substr('交じり文', 1, 1 + CAST(priority % 4 AS INTEGER)) AS run FROM repos WHERE priority IS NOT NULL)
SELECT repo, unnest(list_distinct(list_concat([run], list_transform(range(1, len(run)), lambda i: substr(run, i, 2)), list_transform(range(1, len(run) - 1), lambda i: substr(run, i, 3))))) AS gram FROM r""")
def t07_cjk_ngrams(spark, sf_dir):
    """Runs of ideographs as themselves and their n-grams of two and three."""
    r = table(spark, sf_dir, "repos").filter("priority is not null").select("repo", F.concat(F.lit("漢字仮名"), F.expr("substring('交じり文', 1, 1 + priority % 4)")).alias("run")).distinct()

    def make():
        def kernel(repo, run):
            for g in P.cjk_tokens(run):
                yield repo, g
        return kernel
    return map_rows(r, make, StructType([StructField("repo", StringType()), StructField("gram", StringType())]))
