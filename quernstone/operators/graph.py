"""Graphs as edge lists: neighbourhoods by bounded frontier joins, and what is built on them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.keyed import top_n
from quernstone.runtime import cut


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) to follow: out as they are, in turned round, both ways."""
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def filter_edges(edges: DataFrame, kinds: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """Edges of some kinds with enough confidence; one without confidence passes."""
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(kinds))
    if min_confidence is not None:
        edges = edges.filter(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    return edges


def better_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (kind, src, dst): of greatest confidence, then with evidence."""
    best = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), F.col("evidence").isNotNull().alias("e"), F.coalesce("evidence", F.lit("")).alias("v"))
    kept = edges.groupBy("kind", "src", "dst").agg(F.max(best).alias("b"))
    return kept.select("kind", "src", "dst", F.when(F.col("b.c") >= 0, F.col("b.c")).alias("confidence"), F.when(F.col("b.e"), F.col("b.v")).alias("evidence"))


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", fanout: int | None = None) -> DataFrame:
    """(node, distance, path): what is reached from the seeds (column node), each with its least shortest path.

    Goes level by level. fanout bounds the neighbours of a node that are followed, the least ids first. The frontier alone
    is joined with the edges; its lineage is cut at each level. Ends early where nothing new is reached.
    """
    steps = directed(edges, direction).filter("src is not null and dst is not null").distinct()
    if fanout is not None:
        steps = top_n(steps, ["src"], [F.col("dst")], fanout)
    if depth > 1:
        steps = cut(steps)  # every level reads the edges: they are made once
    frontier = cut(seeds.select("node").filter("node is not null").distinct().select("node", F.lit(0).alias("distance"), F.array("node").alias("path")))
    seen = frontier
    for d in range(1, depth + 1):
        reached = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = reached.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut(fresh.select("node", F.lit(d).alias("distance"), "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@dataclass(frozen=True)
class Caps:
    """Bounds of a walk; None for none. fanout: neighbours of a node; work: edges looked at."""

    fanout: int | None = None
    nodes: int | None = None
    edges: int | None = None
    work: int | None = None


def bounded_walk(edges: DataFrame, seeds: DataFrame, depth: int, direction: str, caps: Caps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, distance, path), edges (src, dst) and truncation (cap, most, observed) of a walk within caps.

    Levels are taken in full or up to a cap, in the order of node ids, so that the result depends on nothing else. Edges to nodes that were met before are
    kept too, those to nodes that a cap leaves out are not. A walk whose work or nodes are used up ends. observed counts what was there where a cap cut.
    """
    spark = edges.sparkSession
    steps = directed(edges, direction).filter("src is not null and dst is not null").distinct()
    cut_off: list[tuple[str, int, int]] = []
    if caps.fanout is not None:
        over = truncation(steps, caps.fanout).agg(F.max("observed")).first()[0]
        if over:
            cut_off.append(("fanout", caps.fanout, over))
        steps = top_n(steps, ["src"], [F.col("dst")], caps.fanout)
    steps = cut(steps)
    frontier = cut(seeds.select("node").filter("node is not null").distinct().select("node", F.lit(0).alias("distance"), F.array("node").alias("path")))
    seen, walked, n_nodes, work = frontier, None, frontier.count(), 0
    for d in range(1, depth + 1):
        looked = frontier.join(steps, frontier["node"] == steps["src"]).select("src", "dst", "path")
        if caps.work is not None:
            n = looked.count()
            if work + n > caps.work:
                cut_off.append(("work", caps.work, work + n))
                looked = cut(looked.orderBy("src", "dst").limit(max(0, caps.work - work)))
            work = min(caps.work, work + n)
        reached = cut(looked.select("src", "dst", F.concat("path", F.array("dst")).alias("path")))
        fresh = reached.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        if caps.nodes is not None:
            m = fresh.count()
            if n_nodes + m > caps.nodes:
                cut_off.append(("nodes", caps.nodes, n_nodes + m))
                fresh = fresh.orderBy("node").limit(max(0, caps.nodes - n_nodes))
        frontier = cut(fresh.select("node", F.lit(d).alias("distance"), "path"))
        seen = seen.unionByName(frontier)
        walked = reached.select("src", "dst") if walked is None else walked.unionByName(reached.select("src", "dst"))
        n_nodes += frontier.count()
        full = (caps.nodes is not None and n_nodes >= caps.nodes) or (caps.work is not None and work >= caps.work)
        if full or frontier.isEmpty():
            break
    kept = spark.createDataFrame([], "src string, dst string") if walked is None else walked.distinct().join(seen.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    if caps.edges is not None:
        m = kept.count()
        if m > caps.edges:
            cut_off.append(("edges", caps.edges, m))
            kept = kept.orderBy("src", "dst").limit(caps.edges)
    return seen, kept, spark.createDataFrame(cut_off, "cap string, most long, observed long")


def truncation(edges: DataFrame, fanout: int) -> DataFrame:
    """(src, observed, omitted): nodes whose neighbours a fanout cuts."""
    n = edges.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("observed"))
    return n.filter(F.col("observed") > fanout).withColumn("omitted", F.col("observed") - fanout)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours out plus in."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def impact(edges: DataFrame, changed: DataFrame, depth: int, direction: str = "out", fanout: int | None = None) -> DataFrame:
    """(node, distance, path): what changed nodes reach, without themselves."""
    return neighborhood(edges, changed, depth, direction, fanout).filter("distance > 0")


# Scores of tests that are found by their names alone.
SAME_BASE, SAME_FOLDER = 0.5, 0.25


def suggest_tests(imports: DataFrame, changed: DataFrame, test: Column, depth: int = 4, files: DataFrame | None = None, marks: str = r"(?i)^test[_.-]|[_.-]?(?:test|spec)s?$") -> DataFrame:
    """(node, distance, score): tests that import what changed, by 1 / (distance + 1).

    files, if given (node, path, is_test): tests that reach nothing that changed count by their names: those of the base name of a changed file
    without its marks, then those below the folder of one. Their distance is null.
    """
    reached = neighborhood(imports, changed, depth, "in").filter(test).select("node", "distance", (1.0 / (F.col("distance") + 1)).alias("score"))
    if files is None:
        return reached
    base = lambda path: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", ""), marks, ""))
    folder = F.regexp_extract("path", "^(.*)/", 1)
    of = files.join(changed.select("node").distinct(), "node", "left_semi")
    bases, folders = of.select(base(F.col("path")).alias("__base"), F.lit(True).alias("b")).distinct(), of.select(folder.alias("__folder"), F.lit(True).alias("f")).distinct()
    rest = files.filter("is_test").join(reached.select("node"), "node", "left_anti").join(changed.select("node"), "node", "left_anti")
    # every folder above a test meets the folders of changed files by equality
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = rest.filter("path like '%/%'").select("node", F.explode(above).alias("__folder")).join(folders, "__folder").select("node", "f").distinct()
    named = rest.join(bases, base(F.col("path")) == F.col("__base"), "left").join(below, "node", "left")
    score = F.when(F.col("b"), SAME_BASE).when(F.col("f"), SAME_FOLDER)
    return reached.unionByName(named.select("node", F.lit(None).cast("int").alias("distance"), score.alias("score")).filter("score is not null"))


def rerank(hits: DataFrame, edges: DataFrame, degree_weight: float, proximity_weight: float, depth: int, seeds: int, node=lambda c: c.cast("string")) -> DataFrame:
    """(doc_id, score) of a hit list: score plus weighted degree and proximity to its first hits. No hit from outside enters; node: the node of an id."""
    best = hits.orderBy(F.desc("score"), F.asc("doc_id")).limit(seeds).select(node(F.col("doc_id")).alias("node"))
    near = neighborhood(edges, best, depth, "both").select("node", (1.0 / (F.col("distance") + 1)).alias("proximity"))
    h = hits.withColumn("node", node(F.col("doc_id"))).join(degrees(edges), "node", "left").join(near, "node", "left")
    return h.select("doc_id", (F.col("score") + degree_weight * F.coalesce("degree", F.lit(0)) + proximity_weight * F.coalesce("proximity", F.lit(0.0))).alias("score"))


def glob_pattern(glob: str) -> str:
    """A path glob as a pattern: ** any folders, * within one, ? a character, {a,b} either."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out.append("(?:" + "|".join(re.escape(x) for x in glob[i + 1 : j].split(",")) + ")")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


@dataclass
class Selector:
    any_of: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)

    def holds(self, path: Column) -> Column:
        out = F.lit(not self.any_of)
        for g in self.any_of:
            out = out | path.rlike(glob_pattern(g))
        for g in self.none_of:
            out = out & ~path.rlike(glob_pattern(g))
        return out


@dataclass
class Rule:
    """A forbidden edge between paths, or an order of layers: edges may only go to earlier layers."""

    id: str
    kind: str
    source: Selector = field(default_factory=Selector)
    target: Selector = field(default_factory=Selector)
    layers: list[Selector] = field(default_factory=list)


def violations(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, src, dst) of edges between paths that break a rule. One pass a rule over the edges, no join."""
    out = edges.sparkSession.createDataFrame([], "rule string, src string, dst string")
    for r in rules:
        e = edges.filter(F.col("kind") == ("call" if r.kind == "forbiddenCall" else "import"))
        if r.kind == "layering":
            def layer(path, r=r):
                found = F.lit(None).cast("int")
                for i, s in reversed(list(enumerate(r.layers))):
                    found = F.when(s.holds(path), i).otherwise(found)
                return found
            bad = layer(F.col("src")) < layer(F.col("dst"))
        else:
            bad = r.source.holds(F.col("src")) & r.target.holds(F.col("dst"))
        out = out.unionByName(e.filter(bad).select(F.lit(r.id).alias("rule"), "src", "dst").distinct())
    return out
