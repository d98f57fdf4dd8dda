"""Symbol tables, findings of other tools and files, written in the formats of their tools and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from quernstone.operators import relations, risk as K, tables
from quernstone.operators.relations import RELATED_SQL
from quernstone.operators.tables import CHUNKS_SQL, FILES_SQL, LOCATED_SQL
from quernstone.plans import filters as P
from quernstone.queries import query
from quernstone.queries.build import RISK_RULES, _signals_sql, risk_chunks
from quernstone.runtime import shared_dir, table
from quernstone.sources import files as S, symbols as Y


def _target(spark, name):
    """A folder of its own for what a query writes, so that runs do not meet."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


# The tables of a data folder.
_TABLES = "chunklimits chunks customer dependabot documents embeddings eval_items events files generic inspector labels lineitem mixtargets nation orders part region repos supplier token_postings token_vocab".split()


@query(sql=f"SELECT unnest({[t + '.parquet' for t in _TABLES if t not in ('nation', 'region')]}) AS path, 'code' AS mode")
def s01_discovered(spark, sf_dir):
    """Files of the data folder itself, without those that rules leave out."""
    known = [t + ".parquet" for t in _TABLES]
    return S.discover(spark, sf_dir, ["nation.*", "region.parquet"]).filter(F.col("path").isin(known)).select("path", "mode")


@query(sql=f"SELECT file_id, length(content) > 0 AND file_id % 3 = 0 AS is_binary FROM {FILES_SQL} WHERE content IS NOT NULL")
def s04_binary(spark, sf_dir):
    """Contents as bytes, of every third file with a zero byte put first, told from text."""
    f = tables.files(spark, sf_dir, "content").filter("content is not null")
    b = F.encode("content", "UTF-8")
    odd = F.when((F.col("file_id") % 3 == 0) & (F.length("content") > 0), F.concat(F.unhex(F.lit("00")), b)).otherwise(b)
    return f.select("file_id", S.looks_binary(odd).alias("is_binary"))


@query(sql=f"SELECT id, mode, name FROM {CHUNKS_SQL} WHERE id IN (1, 17, 99, 256, 100000)")
def s09_rows_by_id(spark, sf_dir):
    """Rows of some ids of a table that is kept sorted by id."""
    target = _target(spark, "by-id")
    tables.chunks(spark, sf_dir, "mode", "name").repartitionByRange("id").sortWithinPartitions("id").write.parquet(target)
    return S.rows_at(spark, target, "id", [1, 17, 99, 256, 100000])


_NAMED = f"(SELECT id, path, name, kind, coalesce(startLine, 1) AS line FROM {LOCATED_SQL} WHERE name IS NOT NULL AND path IS NOT NULL)"


def named(spark, sf_dir):
    return tables.located(spark, sf_dir).filter("name is not null and path is not null").select("id", "path", "name", "kind", F.coalesce("startLine", F.lit(1)).alias("line"))


@query(sql=f"SELECT path AS file, name, kind, line::BIGINT AS line, count(*) AS n FROM {_NAMED} GROUP BY ALL")
def s13_ctags(spark, sf_dir):
    """Named chunks as tags of a JSON-lines file, between lines that are none."""
    target = _target(spark, "ctags")
    n = named(spark, sf_dir)
    tags = n.select(F.lit("tag").alias("_type"), "name", "path", "line", "kind").unionByName(n.select(F.lit("ptag").alias("_type"), "name", "path", "line", "kind"))
    tags.write.json(target)
    return Y.ctags(spark, target).groupBy("file", "name", "kind", "line").agg(F.count(F.lit(1)).alias("n"))


@query(sql=f"SELECT path AS file, name, line::BIGINT AS line, count(*) AS n FROM {_NAMED} WHERE regexp_full_match(name, '\\S+') GROUP BY ALL")
def s14_gtags(spark, sf_dir):
    """Named chunks as `name line path` lines (S14); names with blanks have no such line."""
    target = _target(spark, "gtags")
    named(spark, sf_dir).filter(F.col("name").rlike(r"^\S+$")).select(F.concat_ws(" ", "name", F.col("line").cast("string"), "path").alias("value")).write.text(target)
    return Y.gtags(spark, target).groupBy("file", "name", "line").agg(F.count(F.lit(1)).alias("n"))


@query(sql=f"SELECT DISTINCT '/repo/' || path AS file, name, CASE WHEN id % 3 = 0 THEN 'reference' ELSE 'definition' END AS role, line::BIGINT AS line FROM {_NAMED}")
def s15_lsif(spark, sf_dir):
    """Named chunks as a dump of vertices and edges, whose items go from ranges to results for every second chunk, and the other way for others."""
    target = _target(spark, "lsif")
    n = named(spark, sf_dir)
    key = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    doc = F.concat(F.lit("d"), F.md5("path"))
    line = lambda *columns: F.to_json(F.struct(*columns)).alias("value")
    v, e = F.lit("vertex").alias("type"), F.lit("edge").alias("type")
    tag = F.when(F.col("id") % 5 == 0, F.to_json(F.struct(F.col("name").alias("text")))).otherwise(F.col("name"))
    docs = n.select("path").distinct().select(line(doc.alias("id"), v, F.lit("document").alias("label"), F.concat(F.lit("file:///repo/"), "path").alias("uri")))
    ranges = n.select(line(key("r").alias("id"), v, F.lit("range").alias("label"), F.struct((F.col("line") - 1).alias("line"), F.lit(0).alias("character")).alias("start"), tag.alias("tag")))
    results = n.select(line(key("x").alias("id"), v, F.when(F.col("id") % 3 == 0, "referenceResult").otherwise("definitionResult").alias("label")))
    holds = n.select(line(e, F.lit("contains").alias("label"), doc.alias("outV"), F.array(key("r")).alias("inVs")))
    forth = F.col("id") % 2 == 0
    items = n.select(line(e, F.lit("item").alias("label"), F.when(forth, key("r")).otherwise(key("x")).alias("outV"), F.array(F.when(forth, key("x")).otherwise(key("r"))).alias("inVs")))
    docs.union(ranges).union(results).union(holds).union(items).write.text(target)
    return Y.lsif(spark, target)


@query(sql=f"SELECT path AS file, 'sym ' || id AS symbol, name, CASE WHEN id % 2 = 1 THEN 'definition' ELSE 'reference' END AS role, line::BIGINT AS line FROM {_NAMED}")
def s16_scip(spark, sf_dir):
    """Named chunks as documents of an index with symbols and occurrences, an index in each line."""
    target = _target(spark, "scip")
    n = named(spark, sf_dir)
    symbol = F.concat(F.lit("sym "), F.col("id").cast("string"))
    of = n.groupBy("path", F.pmod("id", F.lit(64)).alias("part")).agg(  # a file of many chunks gives several documents
        F.collect_list(F.struct(symbol.alias("symbol"), "kind", F.col("name").alias("displayName"))).alias("symbols"),
        F.collect_list(F.struct(F.array(F.col("line").cast("long") - 1, F.lit(0).cast("long")).alias("range"), symbol.alias("symbol"), (F.col("id") % 2).alias("symbolRoles"))).alias("occurrences"))
    of.select(F.array(F.struct(F.col("path").alias("relativePath"), "symbols", "occurrences")).alias("documents")).write.json(target)
    return Y.scip(spark, target, lines=True).select("file", "symbol", "name", "role", "line")


_LONG = 100  # characters of a line from which it is too long


@query(sql=f"SELECT id, 1 + branches + loops + len(regexp_extract_all(text, '&&|\\|\\||\\band\\b|\\bor\\b')) AS complexity FROM {RELATED_SQL} WHERE text <> ''")
def t31_complexity(spark, sf_dir):
    """Cyclomatic complexity of chunks, by branches, loops and joined conditions."""
    r = relations.related(spark, sf_dir).filter("text != ''")
    return r.select("id", (F.lit(1) + F.col("branches") + F.col("loops") + relations.count(F.col("text"), r"(&&|\|\||\band\b|\bor\b)")).cast("long").alias("complexity"))


_LINT_SQL = f"list_filter([CASE WHEN regexp_matches(text, '[^\\n]{{{_LONG},}}') THEN 'line-too-long' END, CASE WHEN regexp_matches(text, '[ \\t]+\\n') THEN 'trailing-space' END, CASE WHEN regexp_matches(text, '(?i)\\b(?:todo|fixme|xxx)\\b') THEN 'open-task' END, CASE WHEN regexp_matches(text, '(?:^|\\n)\\t+ +') THEN 'mixed-indent' END], lambda x: x IS NOT NULL)"


def lint(text):
    """Names of the lint rules that a text breaks."""
    rules = [("[^\\n]{%d,}" % _LONG, "line-too-long"), (r"[ \t]+\n", "trailing-space"), (r"(?i)\b(?:todo|fixme|xxx)\b", "open-task"), (r"(?:^|\n)\t+ +", "mixed-indent")]
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for p, n in rules]))


@query(sql=f"SELECT id, array_to_string(l, ',') AS lint FROM (SELECT id, {_LINT_SQL} AS l FROM {LOCATED_SQL} WHERE text IS NOT NULL) WHERE len(l) > 0")
def f08_lint(spark, sf_dir):
    c = tables.located(spark, sf_dir).filter("text is not null").select("id", lint(F.col("text")).alias("l"))
    return c.filter(P.has_items(F.col("l"))).select("id", F.array_join("l", ",").alias("lint"))


_FLOWS = {"writes": r"\b([A-Za-z_]\w*) (?:=|:=) ", "reads": r"\b([A-Za-z_]\w*)\.[A-Za-z_]\w*", "mutates": r"\b([A-Za-z_]\w*)\.(?:push|append|insert|pop|clear)\(", "aliases": r"\bas ([A-Za-z_]\w*)"}
_FLOWS_SQL = ", ".join(f"list_sort(list_distinct(regexp_extract_all(text, '{p}', 1))) AS {n}" for n, p in _FLOWS.items())


@query(sql=f"""WITH d AS (SELECT id, {_FLOWS_SQL} FROM {LOCATED_SQL} WHERE text IS NOT NULL)
SELECT id, len(list_filter(writes, lambda x: contains(lower(x), 'score'))) > 0 AS writes, len(list_filter(reads, lambda x: contains(lower(x), 'item'))) > 0 AS reads, len(mutates) > 0 AS mutates, len(list_filter(aliases, lambda x: contains(lower(x), 'er'))) > 0 AS aliases FROM d
WHERE len(list_filter(writes, lambda x: contains(lower(x), 'score'))) > 0 OR len(list_filter(reads, lambda x: contains(lower(x), 'item'))) > 0 OR len(mutates) > 0 OR len(list_filter(aliases, lambda x: contains(lower(x), 'er'))) > 0""")
def f15_dataflow(spark, sf_dir):
    """What chunks write, read, mutate and rename, each filtered by a list of its own."""
    c = tables.located(spark, sf_dir).filter("text is not null")
    d = c.select("id", *[relations.names(F.col("text"), p).alias(n) for n, p in _FLOWS.items()])
    hit = {"writes": P.list_contains(F.col("writes"), ["SCORE"]), "reads": P.list_contains(F.col("reads"), ["item"]), "mutates": P.has_items(F.col("mutates")), "aliases": P.list_contains(F.col("aliases"), ["ER"])}
    return d.select("id", *[c.alias(n) for n, c in hit.items()]).filter("writes or reads or mutates or aliases")


_TYPE = r"\??: ([A-Za-z_&][A-Za-z0-9_.]*)"


@query(sql=f"SELECT id FROM {CHUNKS_SQL} WHERE len(list_filter(regexp_extract_all(coalesce(docmeta.signature, ''), '{_TYPE}', 1), lambda t: contains(lower(t), 'num'))) > 0")
def f17_inferred_type(spark, sf_dir):
    """Chunks one of whose inferred types contains a text."""
    c = tables.chunks(spark, sf_dir, "docmeta").select("id", F.regexp_extract_all(F.coalesce("docmeta.signature", F.lit("")), F.lit(_TYPE), F.lit(1)).alias("types"))
    return c.filter(P.list_contains(F.col("types"), ["NUM"])).select("id")


@query(sql=f"""WITH {_signals_sql()}, x AS (SELECT id, list(DISTINCT rule) FILTER (WHERE kind = 'source') AS sources, list(DISTINCT rule) FILTER (WHERE kind = 'sink') AS sinks, list(DISTINCT category) AS tags FROM sg GROUP BY id)
SELECT id, list_contains(coalesce(sources, []), 'item') AND list_contains(coalesce(sinks, []), 'push') AS item_to_push, list_contains(tags, 'memory') AS memory FROM x WHERE len(coalesce(sources, [])) > 0 AND len(coalesce(sinks, [])) > 0""")
def f18_risk_flows(spark, sf_dir):
    """Flows within a chunk, each source to each sink, filtered by their text, and by tags."""
    of = lambda kind: F.coalesce(F.collect_set(F.when(F.col("kind") == kind, F.col("rule"))), F.array().cast("array<string>"))
    x = K.signals(risk_chunks(spark, sf_dir), RISK_RULES).groupBy("id").agg(of("source").alias("sources"), of("sink").alias("sinks"), F.collect_set("category").alias("tags"))
    flows = F.flatten(F.transform("sources", lambda a: F.transform("sinks", lambda b: F.struct(a.alias("source"), b.alias("sink")))))
    return x.withColumn("flows", flows).filter(P.has_items(F.col("flows"))).select("id", P.flow_matches(F.col("flows"), ["ITEM->push"]).alias("item_to_push"), P.has_member(F.col("tags"), ["memory"]).alias("memory"))


@query(sql=f"""WITH l AS (SELECT id, {_LINT_SQL} AS l FROM {LOCATED_SQL} WHERE text IS NOT NULL) SELECT id FROM l WHERE list_contains(l, 'open-task') OR (list_contains(l, 'line-too-long') AND id % 2 = 0)""")
def f19_structural(spark, sf_dir):
    """Chunks with a structural match of a pack, rule and tag together."""
    c = tables.located(spark, sf_dir).filter("text is not null").select("id", F.transform(lint(F.col("text")), lambda r: F.struct(
        F.lit("lint").alias("pack"), r.alias("rule"), F.array(F.when(r == "open-task", "review").when((r == "line-too-long") & (F.col("id") % 2 == 0), "Review").otherwise("style")).alias("tags"))).alias("entries"))
    found = P.structural_matches(F.col("entries"), "LINT", "task", "review") | P.structural_matches(F.col("entries"), "lint", "long", "review")
    return c.filter(found).select("id")


@query(sql=f"""SELECT id, CASE WHEN lower(kind) LIKE '%interface%' THEN 'interface' WHEN lower(kind) LIKE '%struct%' THEN 'struct' ELSE 'class' END AS form FROM {LOCATED_SQL} WHERE regexp_matches(text, '(?s)\\b(?:class|interface|struct)\\b') AND regexp_matches(lower(kind), 'class|interface|struct')""")
def f22_types(spark, sf_dir):
    """Chunks that declare types, by form; what they extend is filtered as other lists are."""
    c = tables.located(spark, sf_dir).filter(F.col("text").rlike(r"(?s)\b(?:class|interface|struct)\b") & F.lower("kind").rlike("class|interface|struct"))
    k = F.lower("kind")
    return c.select("id", F.when(k.contains("interface"), "interface").when(k.contains("struct"), "struct").otherwise("class").alias("form"))


@query(sql="SELECT repo, coalesce(priority, 0) % 3 = 1 AS allowed FROM repos")
def f29_branches(spark, sf_dir):
    """Repositories on a branch that a query names (F29); their priority stands for it."""
    from quernstone.plans.policies import branch_allows

    branch = F.concat(F.lit("release-"), (F.coalesce("priority", F.lit(0)) % 3).cast("string"))
    return table(spark, sf_dir, "repos").select("repo", branch_allows("release-1", branch).alias("allowed"))


@query(sql=f"SELECT file_id FROM {FILES_SQL} WHERE contains(lower(path), 'graph/') OR contains(lower(path), 'rank')")
def f31_chargram_prefilter(spark, sf_dir):
    """Files whose paths contain any of some texts: first those that have all three-character pieces of one, then those that hold it."""
    f = tables.files(spark, sf_dir, "path").filter("path is not null").select("file_id", F.lower("path").alias("path"))
    n = F.length("path")
    grams = F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring("path", i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    g = f.withColumn("grams", grams)
    hit, sure = F.lit(False), F.lit(False)
    for needle in ("graph/", "rank"):
        hit = hit | (F.size(F.array_except(F.array(*[F.lit(needle[i : i + 3]) for i in range(len(needle) - 2)]), "grams")) == 0)
        sure = sure | F.col("path").contains(needle)
    return g.filter(hit).filter(sure).select("file_id")


@query(sql=f"""WITH t AS (SELECT file_id, unnest(['select a from ' || repo_name, 'insert into log_' || file_id || ' values (''x;y'')', 'update ' || repo_name || ' set a = 1']) AS statement, unnest([0, 1, 2]) AS n FROM (SELECT file_id, regexp_replace(lower(split_part(repo, '/', 2)), '[^a-z]', '_', 'g') AS repo_name FROM {FILES_SQL} WHERE repo IS NOT NULL))
SELECT file_id, CAST(n AS INTEGER) AS n, statement, CASE n WHEN 1 THEN 'log_' || file_id ELSE regexp_extract(statement, '(?:from|update) (\\w+)', 1) END AS tables FROM t""")
def t17_statements(spark, sf_dir):
    """Statements of SQL texts and the tables they touch (T17): a text made for each file, with comments and quoted semicolons."""
    from quernstone.operators import chunking as C

    name = F.regexp_replace(F.lower(F.split("repo", "/")[1]), "[^a-z]", "_")
    f = tables.files(spark, sf_dir, "repo").filter("repo is not null")
    text = F.concat(F.lit("-- head; none\nselect a\n  from "), name, F.lit(";\ninsert into log_"), F.col("file_id").cast("string"), F.lit(" values ('x;y'); /* a; b */ update "), name, F.lit(" set a = 1;\n"))
    return C.statements(f.select("file_id", text.alias("t")), "file_id", "t").select("file_id", "n", "statement", F.array_join(C.table_refs(F.col("statement")), ",").alias("tables"))


@query(sql=f"SELECT pack, rule, file, start_line, count(*) AS n FROM (SELECT 'lint' AS pack, unnest(l) AS rule, path AS file, line AS start_line FROM (SELECT path, coalesce(startLine, 1)::BIGINT AS line, {_LINT_SQL} AS l FROM {LOCATED_SQL} WHERE text IS NOT NULL AND path IS NOT NULL)) GROUP BY ALL")
def g25_structural_matches(spark, sf_dir):
    """Lint findings written in the forms of three search tools, and read again as one table."""
    target = _target(spark, "structural")
    c = tables.located(spark, sf_dir).filter("text is not null and path is not null").select("id", "path", F.coalesce("startLine", F.lit(1)).cast("long").alias("line"), F.explode(lint(F.col("text"))).alias("rule"))
    place = F.struct(F.col("line").alias("line"))
    a = F.to_json(F.struct(F.lit("lint").alias("pack"), F.col("rule").alias("check_id"), "path", place.alias("start"), place.alias("end")))
    b = F.to_json(F.struct(F.lit("lint").alias("tool"), F.col("rule").alias("ruleId"), F.col("path").alias("file"), F.struct(place.alias("start"), place.alias("end")).alias("range")))
    d = F.to_json(F.struct(F.lit("lint").alias("pack"), "rule", F.col("path").alias("uri"), F.col("line").alias("startLine"), F.col("line").alias("endLine")))
    c.select(F.when(F.col("id") % 3 == 0, a).when(F.col("id") % 3 == 1, b).otherwise(d).alias("value")).write.text(target)
    return Y.structural(spark, target).groupBy("pack", "rule", "file", "start_line").agg(F.count(F.lit(1)).alias("n"))


_COMMITS = f"(SELECT id, path, coalesce(last_author, 'nobody') AS author, id % 7 AS added, id % 4 AS deleted, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (id % 5000) AS ts FROM {LOCATED_SQL} WHERE path IS NOT NULL)"


@query(sql=f"""SELECT path, count(*) AS commits, CAST(sum(CASE WHEN id % 11 = 0 THEN 0 ELSE added + deleted END) AS BIGINT) AS churn, count(DISTINCT author) AS authors, arg_max(author, strftime(ts, '%Y%m%d%H%M%S') || 'c' || lpad(id::VARCHAR, 12, '0')) AS last_author, max(ts) AS last_at FROM {_COMMITS} GROUP BY path""")
def t40_vcs_history(spark, sf_dir):
    """A log in which each chunk is a commit that touches its file, read again: churn, authors and last change of each file."""
    from quernstone.sources import vcs

    target = _target(spark, "log")
    c = tables.located(spark, sf_dir).filter("path is not null")
    commit = F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 12, "0"))
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("id") % 5000) * 60), "yyyy-MM-dd'T'HH:mm:ssXXX")
    binary = F.col("id") % 11 == 0
    numbers = F.when(binary, F.lit("-\t-\t")).otherwise(F.concat((F.col("id") % 7).cast("string"), F.lit("\t"), (F.col("id") % 4).cast("string"), F.lit("\t")))
    record = F.concat(F.lit(vcs.RECORD), F.concat_ws(vcs.FIELD, commit, F.coalesce("last_author", F.lit("nobody")), at), F.lit("\n\n"), numbers, "path")
    c.select(record.alias("value")).write.text(target)
    return vcs.history(vcs.log(spark, target)).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


_RUN = 12  # lines of a run of one author
_BLAME = f"b AS (SELECT file_id, path, 'writer' || ((file_id + k) % 5) AS author, k * {_RUN} + 1 AS lo, (k + 1) * {_RUN} AS hi FROM (SELECT file_id, path, unnest(range(0, CAST(ceil((length(content) - length(replace(content, chr(10), '')) + 1) / {_RUN}.0) AS BIGINT))) AS k FROM {FILES_SQL} WHERE content IS NOT NULL AND path IS NOT NULL))"


def authorship(spark, sf_dir):
    """(id, author): whoever wrote lines of a chunk, by runs of lines of its file."""
    from quernstone.operators import chunking as C
    from quernstone.sources import vcs

    target = _target(spark, "blame")
    f = tables.files(spark, sf_dir, "path", "content").filter("content is not null and path is not null")
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    runs = f.select("file_id", F.explode(F.sequence(F.lit(0), F.ceil(lines / _RUN).cast("int") - 1)).alias("k"))
    runs.select(F.concat_ws("\t", F.col("file_id").cast("string"), (F.col("k") * _RUN + 1).cast("string"), F.lit(str(_RUN)), F.concat(F.lit("writer"), ((F.col("file_id") + F.col("k")) % 5).cast("string"))).alias("value")).write.text(target)
    told = vcs.blame(spark, target).select(F.col("path").cast("long").alias("file_id"), F.col("author").alias("match"), F.col("first").alias("m_start"), F.col("last").alias("m_end"))
    return C.line_matches(told, tables.located(spark, sf_dir).select("id", "file_id", "startLine", "endLine")).select("id", F.col("match").alias("author")).distinct()


@query(sql=f"WITH {_BLAME} SELECT DISTINCT c.id, b.author FROM {LOCATED_SQL} c JOIN b ON c.file_id = b.file_id AND b.lo <= c.endLine AND c.startLine <= b.hi")
def j10_chunk_authors(spark, sf_dir):
    """Authors of chunks, by the runs of lines that overlap theirs."""
    return authorship(spark, sf_dir)


@query(sql=f"WITH {_BLAME}, a AS (SELECT DISTINCT c.id, b.author FROM {LOCATED_SQL} c JOIN b ON c.file_id = b.file_id AND b.lo <= c.endLine AND c.startLine <= b.hi) SELECT id FROM {CHUNKS_SQL} WHERE CASE WHEN id IN (SELECT id FROM a) THEN id IN (SELECT id FROM a WHERE author IN ('writer1', 'writer3')) ELSE contains(lower(coalesce(last_author, '')), 'quill') END")
def f06_chunk_author(spark, sf_dir):
    """Chunks by their own authors; those without any by that of their file."""
    own = authorship(spark, sf_dir).groupBy("id").agg(F.collect_set("author").alias("authors"))
    c = tables.chunks(spark, sf_dir, "last_author").join(own, "id", "left")
    hit = F.when(F.col("authors").isNotNull(), P.list_contains(F.col("authors"), ["WRITER1", "writer3"])).otherwise(P.contains_any(F.col("last_author"), ["quill"]))
    return c.filter(hit).select("id")


@query(sql=f"SELECT id, mode, name, coalesce(array_to_string(ngrams, '|'), '') AS grams FROM {CHUNKS_SQL}")
def s08_jsonl_shards(spark, sf_dir):
    """Chunks as compressed shards of JSON lines, among lines that are none, read again by their schema."""
    target = _target(spark, "jsonl")
    c = tables.chunks(spark, sf_dir, "mode", "name", "ngrams")
    S.write_jsonl(c.repartition(6), os.path.join(target, "part=a"), "gzip")
    spark.createDataFrame([("{broken",), ("not json",)], "value string").write.text(os.path.join(target, "part=b"))
    rows = S.read_jsonl(spark, target, c.schema)
    return rows.select("id", "mode", "name", F.coalesce(F.array_join("ngrams", "|"), F.lit("")).alias("grams"))


_SEVERITY_SQL = "SELECT id, coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (WHERE category <> ''))), ','), '') AS categories, coalesce(arg_max(severity, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END) FILTER (WHERE kind = 'sink'), CASE WHEN max(CASE WHEN kind = 'source' THEN 1 ELSE 0 END) = 1 THEN 'low' END) AS severity FROM sg GROUP BY id"


@query(sql=f"""WITH {_signals_sql()}, rk AS ({_SEVERITY_SQL}) SELECT m.id, docmeta.doc IS NOT NULL AND trim(docmeta.doc) <> '' AS documented, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(docmeta.signature, ''), '{_TYPE}', 1))), ',') AS types,
concat_ws('/', branches, loops, breaks, continues) AS flow, len(calls) AS calls, coalesce(visibility, '') AS visibility, coalesce(rk.categories, '') AS risk_categories, coalesce(rk.severity, '') AS risk FROM {RELATED_SQL} m LEFT JOIN rk ON m.id = rk.id WHERE text IS NOT NULL""")
def t33_merged_metadata(spark, sf_dir):
    """Documentation, types, control flow, calls and risk of each chunk as one row."""
    r = relations.related(spark, sf_dir).filter("text is not null")
    risk = K.rollup(K.signals(risk_chunks(spark, sf_dir), RISK_RULES)).select("id", F.array_join("categories", ",").alias("risk_categories"), F.col("severity").alias("risk"))
    types = F.array_join(relations.names(F.coalesce("docmeta.signature", F.lit("")), _TYPE), ",")
    return r.join(risk, "id", "left").select(
        "id", (F.col("docmeta.doc").isNotNull() & (F.coalesce(F.trim("docmeta.doc"), F.lit("")) != "")).alias("documented"), types.alias("types"), F.concat_ws("/", *[F.col(c).cast("string") for c in ("branches", "loops", "breaks", "continues")]).alias("flow"),
        F.size("calls").cast("long").alias("calls"), F.coalesce("visibility", F.lit("")).alias("visibility"), F.coalesce("risk_categories", F.lit("")).alias("risk_categories"), F.coalesce("risk", F.lit("")).alias("risk"))


@query(sql=f"SELECT repo, mode, count(*) AS chunks, count(DISTINCT file_id) AS files, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS bytes, CAST(max(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS largest FROM {LOCATED_SQL} GROUP BY repo, mode")
def a17_shard_census(spark, sf_dir):
    """Chunks, files and bytes of each repo and mode, as shards of an index."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return tables.located(spark, sf_dir).groupBy("repo", "mode").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_id").alias("files"), F.sum(size).cast("long").alias("bytes"), F.max(size).cast("long").alias("largest"))


_CALL = r"([A-Za-z_]\w*)\(([^()]*)\)"


@query(sql=f"""WITH y AS (SELECT repo, name, max(len(docmeta.params)) AS required FROM {LOCATED_SQL} WHERE name IS NOT NULL AND docmeta.params IS NOT NULL AND regexp_matches(coalesce(docmeta.signature, ''), '^(export|pub)') GROUP BY repo, name),
k AS (SELECT DISTINCT repo, path AS file, id AS caller, unnest(regexp_extract_all(text, '{_CALL}', 1)) AS name, unnest(regexp_extract_all(text, '{_CALL}', 2)) AS args FROM {LOCATED_SQL} WHERE text IS NOT NULL),
n AS (SELECT DISTINCT y.repo || ':' || y.name AS symbol_id, file, caller, CASE WHEN trim(args) = '' THEN 0 ELSE len(string_split(args, ',')) END AS args, required FROM y JOIN k ON y.repo = k.repo AND y.name = k.name)
SELECT symbol_id, file, caller, args, CASE WHEN args < required OR args > required + 1 THEN 'ARITY_MISMATCH' END AS warning FROM n QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY file, caller, args) <= 5""")
def a20_call_lists(spark, sf_dir):
    """The first five calls of each exported function, with a warning where the number of arguments does not fit."""
    from quernstone.operators import keyed

    c = tables.located(spark, sf_dir)
    key = F.concat_ws(":", "repo", "name")
    exported = F.coalesce("docmeta.signature", F.lit("")).rlike("^(export|pub)")
    symbols = c.filter(exported & F.col("name").isNotNull() & F.col("docmeta.params").isNotNull()).groupBy(key.alias("symbol_id")).agg(F.max(F.size("docmeta.params")).alias("required"))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(_CALL), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(_CALL), F.lit(2)).alias("args"))
    calls = c.filter("text is not null").select("repo", F.col("path").alias("file"), F.col("id").alias("caller"), F.explode(pairs).alias("c")).select(
        F.concat_ws(":", "repo", "c.name").alias("symbol_id"), "file", "caller", F.when(F.trim("c.args") == "", 0).otherwise(F.size(F.split("c.args", ","))).cast("long").alias("args"))
    told = calls.join(symbols, "symbol_id").distinct().withColumn("warning", F.when((F.col("args") < F.col("required")) | (F.col("args") > F.col("required") + 1), "ARITY_MISMATCH")).drop("required")
    return keyed.top_n(told, ["symbol_id"], [F.asc("file"), F.asc("caller"), F.asc("args")], 5)
