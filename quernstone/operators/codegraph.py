"""The graphs of an index: calls and usages between chunks, imports between files, and the nodes they join.

A node is a chunk (`c` and its id), a file (`f:repo:path`), a name that resolves to no one symbol (`s:repo:name`), or a module that is no file of the
repository (`m:specifier`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.operators import relations, symbols as S, tables
from quernstone.runtime import stored

# How sure an edge is whose symbol is in the same file or one it imports, or the only one of its name in the repository.
SURE_FILE, SURE_REPO = 1.0, 0.8


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, src_id, repo, file, name): every name that a chunk calls or uses."""
    r = relations.related(spark, sf_dir)
    of = lambda graph, names: r.select(F.lit(graph).alias("graph"), F.col("id").alias("src_id"), "repo", F.col("path").alias("file"), F.explode(names).alias("name"))
    return of("call", "calls").unionByName(of("usage", "usages"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, repo, file, name) of named chunks."""
    return relations.related(spark, sf_dir).filter("name is not null").select(F.col("id").alias("symbol_id"), "repo", F.col("path").alias("file"), "name")


def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, src, spec, dst, status, reason): every import of every file, resolved; made once for all queries."""
    def build():
        f = tables.files(spark, sf_dir, "repo", "path", "content")
        rows = f.select("repo", F.col("path").alias("src"), F.explode(relations.imports(F.col("content"))).alias("spec"))
        return S.resolve_imports(rows, f.select("repo", "path"))
    return stored(spark, sf_dir, "file_imports", ("files",), build)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, src, dst, confidence): distinct edges of the call, usage, import and symbol graphs, laid out by src; made once for all queries.

    The symbol graph joins files to their chunks. Edges of a chunk to itself are left out; those to names and modules have no confidence.
    """
    def build():
        refs = references(spark, sf_dir).withColumn("ref_id", F.concat_ws(":", "graph", "src_id", "name"))
        done = S.resolve_names(refs, symbols(spark, sf_dir), file_imports(spark, sf_dir), keep=["graph", "src_id", "repo", "name"])
        named = done.filter("symbol_id is null or symbol_id != src_id").select(
            "graph", F.concat(F.lit("c"), F.col("src_id").cast("string")).alias("src"),
            F.when(F.col("symbol_id").isNotNull(), F.concat(F.lit("c"), F.col("symbol_id").cast("string"))).otherwise(F.concat(F.lit("s:"), "repo", F.lit(":"), "name")).alias("dst"),
            F.when(F.col("symbol_id").isNotNull(), F.when(F.col("level") == "repo", SURE_REPO).otherwise(SURE_FILE)).alias("confidence"))
        node = lambda path: F.concat(F.lit("f:"), "repo", F.lit(":"), path)
        imported = file_imports(spark, sf_dir).select(
            F.lit("import").alias("graph"), node("src").alias("src"), F.when(F.col("dst").isNotNull(), node("dst")).otherwise(F.concat(F.lit("m:"), "spec")).alias("dst"),
            F.when(F.col("dst").isNotNull(), SURE_FILE).alias("confidence"))
        held = relations.related(spark, sf_dir).select(F.lit("symbol").alias("graph"), node("path").alias("src"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("dst"), F.lit(None).cast("double").alias("confidence"))
        return named.unionByName(imported).unionByName(held).filter("src is not null and dst is not null").distinct()
    return stored(spark, sf_dir, "edges", ("chunks", "files"), build, lambda df: df.repartition("src").sortWithinPartitions("src", "graph", "dst"))


def node_kind(node):
    """chunk, file, name or module, by the form of a node."""
    return F.when(node.startswith("f:"), "file").when(node.startswith("s:"), "name").when(node.startswith("m:"), "module").otherwise("chunk")


def nodes(edges: DataFrame) -> DataFrame:
    """(node, kind): every node of some edges."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", node_kind(F.col("node")).alias("kind"))


def counts(edges: DataFrame) -> DataFrame:
    """(graph, edges, nodes) of each graph, edges of one pair counted once."""
    e = edges.select("graph", "src", "dst").distinct()
    ends = e.select("graph", F.col("src").alias("node")).union(e.select("graph", "dst")).distinct().groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    return e.groupBy("graph").agg(F.count(F.lit(1)).alias("edges")).join(ends, "graph").select("graph", "edges", "nodes")
