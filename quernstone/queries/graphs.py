"""Graph, symbol, import and difference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import codegraph as CG, diff as D, graph as G, keyed, relations, symbols as S, tables
from quernstone.operators.relations import RELATED_SQL
from quernstone.operators.tables import CHUNKS_SQL, FILES_SQL
from quernstone.queries import query
from quernstone.runtime import table

_IMPORTS_SQL = f"""f AS (SELECT * FROM {FILES_SQL}), i AS (SELECT DISTINCT repo, path AS src, unnest(list_distinct(regexp_extract_all(content, '{relations.IMPORT.replace(chr(39), chr(39) * 2)}', 1))) AS spec FROM f)"""


_JS = "['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs']"
_UP = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"
# a folder and a relative path with ./ and up to three ../ worked off; null beyond the root
_JOIN = ("CASE WHEN starts_with({1}, '../../../') THEN NULL WHEN starts_with({1}, '../../') THEN CASE WHEN contains({0}, '/') THEN ltrim(" + _UP.format(_UP.format("{0}")) + " || '/' || substr({1}, 7), '/') END "
         "WHEN starts_with({1}, '../') THEN CASE WHEN {0} <> '' THEN ltrim(" + _UP.format("{0}") + " || '/' || substr({1}, 4), '/') END WHEN starts_with({1}, './') THEN ltrim({0} || '/' || substr({1}, 3), '/') ELSE ltrim({0} || '/' || {1}, '/') END")
_RESOLVED_SQL = f"""{_IMPORTS_SQL}, x1 AS (SELECT *, {_UP.format('src')} AS dir, CASE WHEN regexp_matches(src, '(?i)\\.(?:js|mjs|cjs|jsx|ts|tsx)$') THEN 'js' WHEN regexp_matches(src, '(?i)\\.pyi?$') THEN 'py' WHEN regexp_matches(src, '(?i)\\.rs$') THEN 'rs' WHEN regexp_matches(src, '(?i)\\.go$') THEN 'go' WHEN regexp_matches(src, '(?i)\\.(?:c|h|cc|cpp|hpp)$') THEN 'c' ELSE 'other' END AS language,
 regexp_matches(spec, '^\\.{{1,2}}/') AS jsrel, length(regexp_extract(spec, '^(\\.*)', 1)) AS dots, regexp_matches(spec, '^(?:crate|self|super)::') AS rsrel FROM i),
x2 AS (SELECT *, (language = 'js' AND jsrel) OR (language = 'py' AND dots > 0) OR (language = 'rs' AND rsrel) OR (language IN ('c', 'other') AND jsrel) AS rel, replace(regexp_replace(spec, '^\\.+', ''), '.', '/') AS rest, replace(regexp_replace(spec, '^(?:crate|self|super)::', ''), '::', '/') AS tail FROM x1),
x3 AS (SELECT *, {_JOIN.format('dir', 'spec')} AS js, CASE WHEN dots = 0 THEN rest ELSE {_JOIN.format('dir', "(repeat('../', CAST(dots - 1 AS INTEGER)) || rest)")} END AS py, CASE WHEN starts_with(spec, 'crate') THEN 'src/' || tail WHEN starts_with(spec, 'self') THEN {_JOIN.format('dir', 'tail')} ELSE {_JOIN.format('dir', "('../' || tail)")} END AS rs FROM x2),
x4 AS (SELECT *, list_filter(CASE WHEN language IN ('js', 'other') AND jsrel THEN CASE WHEN regexp_matches(spec, '\\.[A-Za-z0-9]+$') THEN [js || '|exact'] WHEN ends_with(spec, '/') THEN list_transform({_JS}, lambda e: js || '/index.' || e || '|index')
  ELSE list_concat([js || '|exact'], list_transform({_JS}, lambda e: js || '.' || e || '|extension'), list_transform({_JS}, lambda e: js || '/index.' || e || '|index')) END
 WHEN language = 'py' THEN CASE WHEN rest = '' THEN [ltrim(py || '/__init__.py', '/') || '|index'] ELSE [py || '.py|extension', py || '/__init__.py|index'] END
 WHEN language = 'rs' AND rsrel THEN [rs || '.rs|extension', rs || '/mod.rs|index', {_UP.format('rs')} || '.rs|parent', {_UP.format('rs')} || '/mod.rs|parent']
 WHEN language = 'go' THEN list_transform(range(1, len(string_split(spec, '/')) + 1), lambda k: array_to_string(string_split(spec, '/')[CAST(k AS INTEGER):], '/') || '|folder')
 WHEN language = 'c' THEN [js || '|beside', 'include/' || spec || '|include', spec || '|root'] ELSE [] END, lambda c: c IS NOT NULL) AS cs FROM x3),
x5 AS (SELECT repo, src, spec, language, unnest(cs) AS cand, generate_subscripts(cs, 1) AS pr FROM x4),
kn AS (SELECT DISTINCT repo, path, false AS folder FROM f UNION SELECT repo, {_UP.format('path')}, true FROM f WHERE ends_with(lower(path), '.go') AND {_UP.format('path')} <> ''),
x6 AS (SELECT x5.repo, src, spec, arg_min(cand, pr) AS hit FROM x5 JOIN kn ON x5.repo = kn.repo AND split_part(cand, '|', 1) = kn.path AND (language = 'go') = kn.folder GROUP BY ALL),
ri AS (SELECT x4.repo, x4.src, x4.spec, split_part(hit, '|', 1) AS dst, CASE WHEN hit IS NOT NULL THEN 'resolved' WHEN rel THEN 'unresolved' ELSE 'external' END AS status,
 CASE WHEN hit IS NOT NULL OR NOT rel THEN NULL WHEN (CASE language WHEN 'py' THEN py WHEN 'rs' THEN rs ELSE js END) IS NULL THEN 'outside_root' WHEN language IN ('js', 'c', 'other') AND regexp_matches(x4.spec, '\\.[A-Za-z0-9]+$') THEN 'missing_file' ELSE 'missing_candidates' END AS reason, language, split_part(hit, '|', 2) AS stage
 FROM x4 LEFT JOIN x6 ON x4.repo = x6.repo AND x4.src = x6.src AND x4.spec = x6.spec)"""


@query(sql=f"WITH {_RESOLVED_SQL} SELECT * FROM ri")
def j09_import_resolution(spark, sf_dir):
    """Every import of every file, by the rules of its language."""
    return CG.file_imports(spark, sf_dir)


_EDGES_SQL = f"""m AS (SELECT * FROM {RELATED_SQL}), sy AS (SELECT id AS symbol_id, repo, path AS file, name FROM m WHERE name IS NOT NULL),
ow AS (SELECT repo, file, name, min(symbol_id) AS s, count(*) AS n FROM sy GROUP BY ALL), al AS (SELECT repo, name, min(symbol_id) AS s, count(*) AS n FROM sy GROUP BY ALL),
r AS (SELECT 'call' AS graph, id AS src_id, repo, path AS file, unnest(calls) AS name FROM m UNION ALL SELECT 'usage', id, repo, path, unnest(usages) FROM m),
res AS (SELECT r.*, CASE WHEN coalesce(ow.n, al.n, 0) = 1 THEN coalesce(ow.s, al.s) END AS sid, CASE WHEN ow.n = 1 THEN 1.0::DOUBLE WHEN ow.n IS NULL AND al.n = 1 THEN 0.8::DOUBLE END AS confidence
 FROM r LEFT JOIN ow ON r.repo = ow.repo AND r.file = ow.file AND r.name = ow.name LEFT JOIN al ON r.repo = al.repo AND r.name = al.name), {_RESOLVED_SQL},
ge AS (SELECT DISTINCT * FROM (SELECT graph, 'c' || src_id AS src, CASE WHEN sid IS NULL THEN 's:' || repo || ':' || name ELSE 'c' || sid END AS dst, confidence FROM res WHERE sid IS NULL OR sid <> src_id
 UNION ALL SELECT 'import', 'f:' || repo || ':' || src, CASE WHEN dst IS NULL THEN 'm:' || spec ELSE 'f:' || repo || ':' || dst END, CASE WHEN dst IS NOT NULL THEN 1.0::DOUBLE END FROM ri
 UNION ALL SELECT 'symbol', 'f:' || repo || ':' || path, 'c' || id, NULL FROM m) WHERE src IS NOT NULL AND dst IS NOT NULL),
e AS (SELECT DISTINCT src, dst FROM ge)"""
_KIND_SQL = "CASE WHEN starts_with({0}, 'f:') THEN 'file' WHEN starts_with({0}, 's:') THEN 'name' WHEN starts_with({0}, 'm:') THEN 'module' ELSE 'chunk' END"
# where walks begin: the least sources of each graph
_SEEDS_SQL = "s0 AS (SELECT DISTINCT min(src) AS node FROM ge GROUP BY graph)"
# the node that most edges lead to
_HUB_SQL = "hub AS (SELECT dst AS node FROM e WHERE starts_with(dst, '{0}') GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def least_sources(spark, sf_dir):
    return CG.edges(spark, sf_dir).groupBy("graph").agg(F.min("src").alias("node")).select("node").distinct()


def hub(spark, sf_dir, prefix):
    e = CG.edges(spark, sf_dir).select("src", "dst").distinct().filter(F.col("dst").startswith(prefix))
    return e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("node")).limit(1).select("node")


@query(sql=f"WITH {_EDGES_SQL} SELECT graph, src, dst, confidence FROM ge")
def g01_edges(spark, sf_dir):
    """Call, usage, import and symbol edges (G1)."""
    return CG.edges(spark, sf_dir)


@query(sql=f"WITH {_EDGES_SQL} SELECT node, {_KIND_SQL.format('node')} AS kind FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)")
def g01_nodes(spark, sf_dir):
    return CG.nodes(CG.edges(spark, sf_dir))


@query(sql=f"WITH {_EDGES_SQL} SELECT graph, count(*) AS edges, max(n) AS nodes FROM (SELECT DISTINCT graph, src, dst FROM ge) g JOIN (SELECT graph, count(DISTINCT node) AS n FROM (SELECT graph, src AS node FROM ge UNION ALL SELECT graph, dst FROM ge) GROUP BY graph) USING (graph) GROUP BY graph")
def a11_graph_counts(spark, sf_dir):
    return CG.counts(CG.edges(spark, sf_dir))


@query(sql=f"WITH {_EDGES_SQL} SELECT graph, src, dst FROM ge WHERE graph IN ('call', 'import') AND (confidence IS NULL OR confidence >= 0.9)")
def g03_filtered_edges(spark, sf_dir):
    """Edges of two graphs that are sure enough, or of which nothing is known."""
    return G.filter_edges(CG.edges(spark, sf_dir).withColumnRenamed("graph", "kind"), ["call", "import"], 0.9).select(F.col("kind").alias("graph"), "src", "dst")


_LEVELS_SQL = f"""WITH {_EDGES_SQL}, {_SEEDS_SQL}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
l1 AS (SELECT DISTINCT dst AS node FROM s0 JOIN u ON u.src = s0.node WHERE dst NOT IN (SELECT node FROM s0)),
l2 AS (SELECT DISTINCT dst AS node FROM l1 JOIN u ON u.src = l1.node WHERE dst NOT IN (SELECT node FROM s0 UNION SELECT node FROM l1)),
l3 AS (SELECT DISTINCT dst AS node FROM l2 JOIN u ON u.src = l2.node WHERE dst NOT IN (SELECT node FROM s0 UNION SELECT node FROM l1 UNION SELECT node FROM l2)),
w AS (SELECT node, 0 AS distance FROM s0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2 UNION ALL SELECT node, 3 FROM l3)"""


@query(sql=_LEVELS_SQL + " SELECT node, distance FROM w")
def g02_neighborhood(spark, sf_dir):
    """Three levels around the seeds, both ways."""
    return G.neighborhood(CG.edges(spark, sf_dir), least_sources(spark, sf_dir), 3, "both").select("node", "distance")


@query(sql=_LEVELS_SQL + " SELECT node, distance FROM w ORDER BY distance, node LIMIT 40")
def g02_capped(spark, sf_dir):
    """The same walk with a cap of nodes, which are taken level by level in order."""
    found, _, _ = G.bounded_walk(CG.edges(spark, sf_dir), least_sources(spark, sf_dir), 3, "both", G.Caps(nodes=40))
    return found.select("node", "distance")


@query(sql=f"""WITH {_EDGES_SQL}, {_SEEDS_SQL}, r3 AS (SELECT src, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 3),
l1 AS (SELECT dst AS node, min([src, dst]) AS path FROM s0 JOIN r3 ON r3.src = s0.node WHERE dst NOT IN (SELECT node FROM s0) GROUP BY dst),
l2 AS (SELECT dst AS node, min(list_append(l1.path, dst)) AS path FROM l1 JOIN r3 ON r3.src = l1.node WHERE dst NOT IN (SELECT node FROM s0 UNION SELECT node FROM l1) GROUP BY dst)
SELECT node, node AS path, 0 AS distance FROM s0 UNION ALL SELECT node, array_to_string(path, '>'), 1 FROM l1 UNION ALL SELECT node, array_to_string(path, '>'), 2 FROM l2""")
def g04_witness_paths(spark, sf_dir):
    """Least shortest paths with a fanout of three."""
    n = G.neighborhood(CG.edges(spark, sf_dir), least_sources(spark, sf_dir), 2, fanout=3)
    return n.select("node", F.array_join("path", ">").alias("path"), "distance")


@query(sql=f"WITH {_EDGES_SQL} SELECT src, count(*) AS observed, count(*) - 10 AS omitted FROM e GROUP BY src HAVING count(*) > 10")
def g02_truncation(spark, sf_dir):
    return G.truncation(CG.edges(spark, sf_dir), 10)


@query(sql=f"WITH {_EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def a10_degree(spark, sf_dir):
    """Degrees, whose sum is twice the distinct edges."""
    return G.degrees(CG.edges(spark, sf_dir))


@query(sql=f"""WITH {_EDGES_SQL}, {_HUB_SQL.format("m:")}, l1 AS (SELECT DISTINCT src AS node FROM e JOIN hub ON e.dst = hub.node), l2 AS (SELECT DISTINCT src AS node FROM e JOIN l1 ON e.dst = l1.node WHERE src NOT IN (SELECT node FROM l1) AND src NOT IN (SELECT node FROM hub))
SELECT node, 1 AS distance FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def g05_impact(spark, sf_dir):
    """What depends on the module that most files import, upstream."""
    return G.impact(CG.edges(spark, sf_dir), hub(spark, sf_dir, "m:"), 2, "in").select("node", "distance")


@query(sql=f"""WITH {_EDGES_SQL}, {_HUB_SQL.format("s:")}, l1 AS (SELECT DISTINCT src AS node FROM e JOIN hub ON e.dst = hub.node), l2 AS (SELECT DISTINCT dst AS node FROM e JOIN l1 ON e.src = l1.node WHERE dst NOT IN (SELECT node FROM l1) AND dst NOT IN (SELECT node FROM hub))
SELECT kind, count(*) AS nodes FROM (SELECT {_KIND_SQL.format('node')} AS kind FROM l2) GROUP BY kind""")
def g08_context(spark, sf_dir):
    """Kinds of what the users of the most used name touch besides: a seed and its surroundings in two walks."""
    e = CG.edges(spark, sf_dir)
    seed = hub(spark, sf_dir, "s:")
    users = G.neighborhood(e, seed, 1, "in").filter("distance = 1").select("node")
    beside = G.neighborhood(e, users, 1, "out").filter("distance = 1").join(seed, "node", "left_anti")
    return beside.groupBy(CG.node_kind(F.col("node")).alias("kind")).agg(F.count(F.lit(1)).alias("nodes"))


def call_refs(spark, sf_dir):
    r = relations.related(spark, sf_dir)
    refs = r.select(F.col("id").alias("src_id"), "repo", F.col("path").alias("file"), F.explode("calls").alias("name")).withColumn("ref_id", F.concat_ws(":", "src_id", "name"))
    symbols = r.filter("name is not null").select(F.col("id").alias("symbol_id"), "repo", F.col("path").alias("file"), "name")
    return refs, symbols


_REFS_SQL = f"""m AS (SELECT * FROM {RELATED_SQL}), r AS (SELECT id AS src_id, repo, path AS file, unnest(calls) AS name FROM m), sy AS (SELECT id AS symbol_id, repo, path AS file, name FROM m WHERE name IS NOT NULL),
ow AS (SELECT repo, file, name, min(symbol_id) AS s, count(*) AS n FROM sy GROUP BY ALL), al AS (SELECT repo, name, min(symbol_id) AS s, count(*) AS n FROM sy GROUP BY ALL),
res AS (SELECT r.src_id, r.name, coalesce(ow.n, al.n, 0) AS candidates, CASE WHEN coalesce(ow.n, al.n, 0) = 1 THEN coalesce(ow.s, al.s) END AS symbol_id
FROM r LEFT JOIN ow ON r.repo = ow.repo AND r.file = ow.file AND r.name = ow.name LEFT JOIN al ON r.repo = al.repo AND r.name = al.name)"""


@query(sql=f"WITH {_REFS_SQL} SELECT src_id || ':' || name AS ref_id, CASE WHEN candidates = 0 THEN 'unresolved' WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(symbol_id, -1) AS symbol_id, candidates FROM res")
def j08_symbol_resolution(spark, sf_dir):
    """Every call of every chunk, resolved by name in its file, else in one it imports, else in its repo."""
    refs, symbols = call_refs(spark, sf_dir)
    return S.resolve_names(refs, symbols, CG.file_imports(spark, sf_dir)).withColumn("symbol_id", F.coalesce("symbol_id", F.lit(-1)))


@query(sql=f"WITH {_REFS_SQL} SELECT DISTINCT src_id AS src, symbol_id AS dst FROM res WHERE symbol_id IS NOT NULL AND symbol_id <> src_id")
def g01_call_graph(spark, sf_dir):
    """Edges between chunks from resolved calls, without links to itself."""
    e = CG.edges(spark, sf_dir).filter("graph = 'call' and dst like 'c%'")
    number = lambda c: F.expr(f"substring({c}, 2)").cast("long").alias(c)
    return e.select(number("src"), number("dst"))


@query(sql=f"WITH {_RESOLVED_SQL} SELECT language, status AS disposition, coalesce(reason, CASE status WHEN 'resolved' THEN 'found' ELSE 'not_in_repo' END) AS cause, coalesce(stage, 'none') AS stage, count(*) AS imports, count(DISTINCT repo || ' ' || src) AS files FROM ri GROUP BY ALL")
def a18_import_taxonomy(spark, sf_dir):
    """Imports by language, what became of them, why, and at which candidate."""
    i = CG.file_imports(spark, sf_dir)
    cause = F.coalesce("reason", F.when(F.col("status") == "resolved", "found").otherwise("not_in_repo"))
    return i.groupBy("language", F.col("status").alias("disposition"), cause.alias("cause"), F.coalesce("stage", F.lit("none")).alias("stage")).agg(
        F.count(F.lit(1)).alias("imports"), F.count_distinct(F.concat_ws(" ", "repo", "src")).alias("files"))


@query(sql=f"""WITH {_IMPORTS_SQL} SELECT DISTINCT spec, CASE WHEN spec = './rule' THEN './rule' WHEN starts_with(spec, './') THEN './*' WHEN starts_with(spec, 'crate::') THEN 'crate::*' END AS pattern,
CASE WHEN spec = './rule' THEN 'rules/main' WHEN starts_with(spec, './') THEN 'src/' || substr(spec, 3) WHEN starts_with(spec, 'crate::') THEN 'rs/' || substr(spec, 8) END AS target FROM i""")
def g17_path_aliases(spark, sf_dir):
    rows = CG.file_imports(spark, sf_dir)
    return S.best_alias(rows.select("spec").distinct(), [("./*", "src/*"), ("crate::*", "rs/*"), ("./rule", "rules/main")])


# what a file imports, as a path where it is given relative to the file
_PATHS_SQL = f"""{_RESOLVED_SQL}, pe AS (SELECT repo, src, CASE WHEN regexp_matches(spec, '^\\./') THEN regexp_extract(src, '^(.*)/[^/]*$', 1) || '/' || substr(spec, 3) ELSE spec END AS dst FROM ri)"""


def import_paths(spark, sf_dir):
    folder = F.regexp_extract("src", r"^(.*)/[^/]*$", 1)
    dst = F.when(F.col("spec").rlike(r"^\./"), F.concat(folder, F.lit("/"), F.expr("substring(spec, 3)"))).otherwise(F.col("spec"))
    return CG.file_imports(spark, sf_dir).select("repo", "src", dst.alias("dst"), F.lit("import").alias("kind"))


@query(sql=f"""WITH {_PATHS_SQL}, m2 AS (SELECT path, unnest(calls) AS name FROM {RELATED_SQL})
SELECT DISTINCT 'no-io-in-core' AS rule, src, dst FROM pe WHERE regexp_matches(src, '^(?:core|server)/.*$') AND NOT regexp_matches(src, '^core/graph/.*$') AND dst IN ('stdio.h', 'log', 'logging')
UNION ALL SELECT DISTINCT 'no-panic', path, name FROM m2 WHERE regexp_matches(path, '^.*\\.(?:rs|py)$') AND name IN ('panic', 'len')
UNION ALL SELECT DISTINCT 'layers', src, dst FROM pe WHERE CASE WHEN starts_with(src, 'core/') THEN 0 WHEN starts_with(src, 'lib/') THEN 1 WHEN src IN ('stdio.h', 'log', 'logging') THEN 2 END < CASE WHEN starts_with(dst, 'core/') THEN 0 WHEN starts_with(dst, 'lib/') THEN 1 WHEN dst IN ('stdio.h', 'log', 'logging') THEN 2 END""")
def g07_architecture(spark, sf_dir):
    """Forbidden imports and calls, and layers, over the imports and calls of files."""
    calls = relations.related(spark, sf_dir).select(F.col("path").alias("src"), F.explode("calls").alias("dst"), F.lit("call").alias("kind"))
    io = G.Selector(["stdio.h", "log", "logging"])
    return G.violations(import_paths(spark, sf_dir).drop("repo").unionByName(calls), [
        G.Rule("no-io-in-core", "forbiddenImport", G.Selector(["{core,server}/**"], ["core/graph/**"]), io), G.Rule("no-panic", "forbiddenCall", G.Selector(["**.{rs,py}"]), G.Selector(["panic", "len"])),
        G.Rule("layers", "layering", layers=[G.Selector(["core/**"]), G.Selector(["lib/**"]), io])])


_TESTS = "(?i)probe|check|validate|verify"
_BASE_SQL = "lower(regexp_replace(regexp_replace(regexp_extract({0}, '([^/]+)$', 1), '\\.[A-Za-z0-9]+$', ''), '(?i)^test[_.-]|[_.-]?(?:test|spec)s?$', ''))"


@query(sql=f"""WITH {_EDGES_SQL}, {_HUB_SQL.format("m:")}, fl AS (SELECT DISTINCT 'f:' || repo || ':' || path AS node, path, regexp_matches(regexp_extract(path, '([^/]+)$', 1), '{_TESTS}') AS t FROM {FILES_SQL} WHERE repo IS NOT NULL AND path IS NOT NULL),
ch AS (SELECT node FROM hub UNION SELECT node FROM fl WHERE regexp_matches(path, 'lease|^(?:lib|src)/[^/]+$')), im AS (SELECT DISTINCT src, dst FROM ge WHERE graph = 'import'),
l1 AS (SELECT DISTINCT src AS node FROM im JOIN ch ON im.dst = ch.node WHERE src NOT IN (SELECT node FROM ch)), a AS (SELECT l1.node, 1 AS distance, 0.5::DOUBLE AS score FROM l1 JOIN fl USING (node) WHERE fl.t),
o AS (SELECT DISTINCT {_BASE_SQL.format('path')} AS base FROM fl WHERE node IN (SELECT node FROM ch)), d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS folder FROM fl WHERE node IN (SELECT node FROM ch)),
xx AS (SELECT node, CASE WHEN {_BASE_SQL.format('path')} IN (SELECT base FROM o) THEN 0.5::DOUBLE WHEN EXISTS (SELECT 1 FROM d WHERE folder <> '' AND starts_with(path, folder || '/')) THEN 0.25::DOUBLE END AS score FROM fl WHERE t AND node NOT IN (SELECT node FROM a) AND node NOT IN (SELECT node FROM ch))
SELECT node, distance, score FROM a UNION ALL SELECT node, NULL, score FROM xx WHERE score IS NOT NULL""")
def g06_suggested_tests(spark, sf_dir):
    """Files that look like tests and import what changed, or are named after it or beside it: the most imported module, files about leases and those right below two folders changed."""
    f = tables.files(spark, sf_dir, "repo", "path").filter("repo is not null and path is not null")
    files = f.select(F.concat(F.lit("f:"), "repo", F.lit(":"), "path").alias("node"), "path", F.regexp_extract("path", r"([^/]+)$", 1).rlike(_TESTS).alias("is_test")).distinct()
    changed = hub(spark, sf_dir, "m:").union(files.filter(F.col("path").rlike("lease|^(?:lib|src)/[^/]+$")).select("node"))
    imports = CG.edges(spark, sf_dir).filter("graph = 'import'")
    test = (F.col("distance") > 0) & F.regexp_extract("node", r"([^/:]+)$", 1).rlike(_TESTS) & F.col("node").startswith("f:")
    return G.suggest_tests(imports, changed, test, 1, files)


def states(spark, sf_dir):
    """Two states of the files: some removed, moved, changed and copied in the second."""
    f = tables.files(spark, sf_dir, "repo", "path", "content").select("file_id", F.concat_ws(":", "repo", "path").alias("path"), "content")
    state = lambda df: df.select("path", F.md5("content").alias("hash"), F.length("content").alias("size"))
    k = F.col("file_id") % 9
    after = f.filter(k != 0).select(
        "file_id", F.when(k == 1, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"), F.when(k == 2, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    copies = f.filter("file_id % 50 = 7").select("file_id", F.concat("path", F.lit(".copy")).alias("path"), "content")
    return state(f), state(after.unionByName(copies))


_STATES_SQL = f"""f AS (SELECT file_id, repo || ':' || path AS path, content FROM {FILES_SQL}), b AS (SELECT path, md5(content) AS hash, length(content) AS size FROM f),
a AS (SELECT path, md5(content) AS hash, length(content) AS size FROM (SELECT CASE WHEN file_id % 9 = 1 THEN path || '.moved' ELSE path END AS path, CASE WHEN file_id % 9 = 2 THEN content || 'x' ELSE content END AS content FROM f WHERE file_id % 9 <> 0
UNION ALL SELECT path || '.copy', content FROM f WHERE file_id % 50 = 7)),
j AS (SELECT coalesce(a.path, b.path) AS path, b.hash AS bh, a.hash AS ah, nullif(b.size, 0) AS bs, nullif(a.size, 0) AS az, b.path IS NOT NULL AS inb, a.path IS NOT NULL AS ina FROM b FULL JOIN a ON a.path = b.path),
rm AS (SELECT path, bh AS hash, row_number() OVER (PARTITION BY bh ORDER BY path) AS rn FROM j WHERE NOT ina), ad AS (SELECT path, ah AS hash, row_number() OVER (PARTITION BY ah ORDER BY path) AS rn FROM j WHERE NOT inb),
ev AS (SELECT 'modified' AS kind, path, path AS path_before FROM j WHERE ina AND inb AND (bh IS DISTINCT FROM ah OR bs IS DISTINCT FROM az)
UNION ALL SELECT CASE WHEN ad.path IS NULL THEN 'removed' WHEN rm.path IS NULL THEN 'added' ELSE 'renamed' END, coalesce(ad.path, rm.path), rm.path FROM rm FULL JOIN ad ON rm.hash = ad.hash AND rm.rn = ad.rn)"""


@query(sql=f"WITH {_STATES_SQL} SELECT * FROM ev")
def j11_file_changes(spark, sf_dir):
    """Added, removed, modified and renamed files."""
    return D.file_changes(*states(spark, sf_dir))


@query(sql=f"WITH {_STATES_SQL} SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def a13_change_summary(spark, sf_dir):
    return D.summary(D.file_changes(*states(spark, sf_dir)))


def chunk_states(spark, sf_dir):
    c = tables.chunks(spark, sf_dir, "chunk_id", "file", "name", "kind", "start", "end", "docmeta")
    base = c.filter("chunk_id is not null").select(
        F.col("id").alias("uid"), "chunk_id", F.concat_ws("|", "file", "kind", "name").alias("logical"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"), F.md5(F.coalesce("docmeta.signature", F.lit(""))).alias("hash"))
    k = F.col("uid") % 8
    after = base.filter(k != 0).select(
        "uid", F.when(k.isin(1, 2), F.concat("chunk_id", F.lit("!"))).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(k == 2, F.concat("logical", F.lit("!"))).otherwise(F.col("logical")).alias("logical"),
        F.when(k == 3, F.col("start") + 5).otherwise(F.col("start")).alias("start"), "end", F.when(k == 4, F.lit("changed")).otherwise(F.col("hash")).alias("hash"))
    return base, after


@query(sql=f"""WITH b AS (SELECT id AS uid, chunk_id, concat_ws('|', file, kind, name) AS logical, coalesce(start, 0) AS s, coalesce("end", 0) AS e, md5(coalesce(docmeta.signature, '')) AS h FROM {CHUNKS_SQL} WHERE chunk_id IS NOT NULL),
a AS (SELECT uid, CASE WHEN uid % 8 IN (1, 2) THEN chunk_id || '!' ELSE chunk_id END AS chunk_id, CASE WHEN uid % 8 = 2 THEN logical || '!' ELSE logical END AS logical, CASE WHEN uid % 8 = 3 THEN s + 5 ELSE s END AS s, e, CASE WHEN uid % 8 = 4 THEN 'changed' ELSE h END AS h FROM b WHERE uid % 8 <> 0),
b1 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY uid) AS rn FROM b), a1 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY uid) AS rn FROM a),
p1 AS (SELECT a1.chunk_id, a1.logical, b1.uid AS bu, a1.uid AS au, b1.h AS bh, a1.h AS ah, b1.s AS bs, a1.s AS az, b1.e AS be, a1.e AS ae FROM b1 JOIN a1 ON b1.chunk_id = a1.chunk_id AND b1.rn = a1.rn),
b2 AS (SELECT *, row_number() OVER (PARTITION BY logical ORDER BY uid) AS rn FROM b WHERE uid NOT IN (SELECT bu FROM p1)), a2 AS (SELECT *, row_number() OVER (PARTITION BY logical ORDER BY uid) AS rn FROM a WHERE uid NOT IN (SELECT au FROM p1)),
p2 AS (SELECT coalesce(a2.chunk_id, b2.chunk_id) AS chunk_id, coalesce(a2.logical, b2.logical) AS logical, b2.uid AS bu, a2.uid AS au, b2.h AS bh, a2.h AS ah, b2.s AS bs, a2.s AS az, b2.e AS be, a2.e AS ae FROM b2 FULL JOIN a2 ON b2.logical = a2.logical AND b2.rn = a2.rn)
SELECT kind, chunk_id, logical FROM (SELECT *, CASE WHEN bu IS NULL THEN 'added' WHEN au IS NULL THEN 'removed' WHEN bh <> ah THEN 'modified' WHEN bs <> az OR be <> ae THEN 'moved' ELSE 'same' END AS kind FROM (SELECT * FROM p1 UNION ALL BY NAME SELECT * FROM p2)) WHERE kind <> 'same'""")
def j13_chunk_changes(spark, sf_dir):
    """Chunk events, paired by id, then by logical key."""
    return D.chunk_changes(*chunk_states(spark, sf_dir))


@query(sql=f"WITH {_STATES_SQL}, r AS (SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY path) AS n FROM ev) SELECT kind, path FROM r WHERE n <= 20")
def g19_bounded_events(spark, sf_dir):
    """The first events of each kind."""
    e = D.file_changes(*states(spark, sf_dir)).select("kind", "path")
    return D.bounded(e, "kind", ["path"], 20, 1_000_000)


@query(sql=f"""WITH f AS (SELECT * FROM {FILES_SQL}), s AS (SELECT repo || ':' || path AS path, md5(content) AS h FROM f WHERE file_id % 5 <> 0), n AS (SELECT repo || ':' || path AS path, md5(CASE WHEN file_id % 7 = 0 THEN content || ' ' ELSE content END) AS h FROM f WHERE file_id % 11 <> 0)
SELECT coalesce(s.path, n.path) AS path, CASE WHEN s.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'remove' WHEN s.h = n.h THEN 'keep' ELSE 'update' END AS action FROM s FULL JOIN n ON s.path = n.path""")
def j17_manifest_plan(spark, sf_dir):
    """What an incremental build has to do (J17, ST2)."""
    f = tables.files(spark, sf_dir, "repo", "path", "content").select("file_id", F.concat_ws(":", "repo", "path").alias("path"), "content")
    state = lambda df, c: df.select("path", F.md5(c).alias("hash"), F.lit(0).alias("mtime"), F.length(c).alias("size"))
    changed = F.when(F.col("file_id") % 7 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    return D.manifest_plan(state(f.filter("file_id % 5 != 0"), F.col("content")), state(f.filter("file_id % 11 != 0"), changed))


@query(sql=f"""WITH {_EDGES_SQL}, pl AS (SELECT 'c' || id AS node, split_part(path, '/', 1) AS place FROM m), pa AS (SELECT node, min(place) AS place FROM pl GROUP BY node),
k AS (SELECT graph, src, dst, CASE WHEN starts_with(src, 'f:') THEN split_part(split_part(src, ':', 3), '/', 1) ELSE a.place END AS sp, CASE WHEN starts_with(dst, 'f:') THEN split_part(split_part(dst, ':', 3), '/', 1) WHEN starts_with(dst, 's:') THEN '(name)' WHEN starts_with(dst, 'm:') THEN '(module)' ELSE b.place END AS dp
 FROM (SELECT DISTINCT graph, src, dst FROM ge) LEFT JOIN pa a ON src = a.node LEFT JOIN pa b ON dst = b.node)
SELECT graph, sp AS src_place, dp AS dst_place, count(*) AS edges FROM k GROUP BY ALL""")
def a19_map_edges(spark, sf_dir):
    """Edges of each graph between top folders: a map with its nodes collapsed."""
    at = relations.related(spark, sf_dir).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("node"), F.split("path", "/")[0].alias("place")).groupBy("node").agg(F.min("place").alias("place"))
    e = CG.edges(spark, sf_dir).select("graph", "src", "dst").distinct()
    of = lambda c, joined: F.when(F.col(c).startswith("f:"), F.split(F.split(c, ":")[2], "/")[0]).when(F.col(c).startswith("s:"), "(name)").when(F.col(c).startswith("m:"), "(module)").otherwise(F.col(joined))
    j = e.join(at.select(F.col("node").alias("src"), F.col("place").alias("sp")), "src", "left").join(at.select(F.col("node").alias("dst"), F.col("place").alias("dp")), "dst", "left")
    return j.groupBy("graph", of("src", "sp").alias("src_place"), of("dst", "dp").alias("dst_place")).agg(F.count(F.lit(1)).alias("edges"))


@query(sql=f"WITH {_EDGES_SQL}, d AS (SELECT node, {_KIND_SQL.format('node')} AS kind, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT kind, node, degree FROM d QUALIFY row_number() OVER (PARTITION BY kind ORDER BY degree DESC, node) <= 5")
def g21_map_top_nodes(spark, sf_dir):
    d = G.degrees(CG.edges(spark, sf_dir)).withColumn("kind", CG.node_kind(F.col("node")))
    return keyed.top_n(d, ["kind"], [F.desc("degree"), F.asc("node")], 5).select("kind", "node", "degree")
