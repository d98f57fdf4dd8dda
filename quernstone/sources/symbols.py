"""Symbol tables of other tools: ctags, GNU Global, LSIF, SCIP, and matches of structural search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CTAGS = "_type string, name string, path string, line bigint, kind string, language string, signature string, scope string"
SYMBOL = ["file", "name", "kind", "language", "line", "signature"]


def ctags(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a ctags JSON-lines file; rows that are no tags, or lack name or path, are left out."""
    t = spark.read.schema(CTAGS).json(path)
    return t.filter("_type = 'tag' and name is not null and path is not null").select(F.col("path").alias("file"), "name", "kind", "language", "line", "signature")


def gtags(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of `name line path` lines; a path may hold blanks."""
    parts = F.regexp_extract("value", r"^(\S+)\s+(\d+)\s+(\S.*?)\s*$", 1)
    t = spark.read.text(path)
    return t.filter(parts != "").select(
        F.regexp_extract("value", r"^(\S+)\s+(\d+)\s+(\S.*?)\s*$", 3).alias("file"), parts.alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("language"),
        F.regexp_extract("value", r"^(\S+)\s+(\d+)\s+", 2).cast("long").alias("line"), F.lit(None).cast("string").alias("signature"))


LSIF = ("id string, type string, label string, uri string, languageId string, start struct<line:bigint,character:bigint>, `end` struct<line:bigint,character:bigint>, "
        "tag string, text string, outV string, inV string, inVs array<string>, document string")


def lsif(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, role, line): ranges of definitions and references of a dump, by its edges.

    item edges join ranges with definition or reference results, in whichever direction a dump has them; contains edges tell the document of a range. A tag is
    a name, or an object with a text.
    """
    g = spark.read.schema(LSIF).json(path)
    v, e = g.filter("type = 'vertex'"), g.filter("type = 'edge'").withColumn("to", F.explode(F.coalesce("inVs", F.array("inV"))))
    documents = v.filter("label = 'document'").select(F.col("id").alias("doc"), F.regexp_replace("uri", "^file://", "").alias("file"))
    name = F.coalesce(F.get_json_object("tag", "$.text"), F.when(~F.col("tag").startswith("{"), F.col("tag")), F.col("text"))
    ranges = v.filter("label = 'range'").select(F.col("id").alias("range"), name.alias("name"), (F.col("start.line") + 1).alias("line"))
    results = v.filter("label in ('definitionResult', 'referenceResult')").select(F.col("id").alias("result"), F.when(F.col("label") == "definitionResult", "definition").otherwise("reference").alias("role"))
    holds = e.filter("label = 'contains'").select(F.col("outV").alias("doc"), F.col("to").alias("range"))
    items = e.filter("label = 'item'")
    either = items.select(F.col("outV").alias("result"), F.col("to").alias("range")).unionByName(items.select(F.col("to").alias("result"), F.col("outV").alias("range")))
    return either.join(results, "result").join(ranges, "range").join(holds, "range", "left").join(documents, "doc", "left").select("file", "name", "role", "line").distinct()


SCIP = ("documents array<struct<relativePath:string,language:string,symbols:array<struct<symbol:string,kind:string,displayName:string,signature:string>>,"
        "occurrences:array<struct<range:array<bigint>,symbol:string,symbolRoles:bigint>>>>")


def scip(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, language, symbol, name, role, line): occurrences; bit 1 of the roles marks definitions, others are references.

    lines: whether each line is an index of its own, as of parts of a large repository; else each file is one.
    """
    d = spark.read.schema(SCIP).option("multiLine", not lines).json(path).select(F.explode("documents").alias("d"))
    o = d.select("d.relativePath", "d.language", F.explode("d.occurrences").alias("o"))
    names = d.select("d.relativePath", F.explode("d.symbols").alias("s")).select("relativePath", F.col("s.symbol").alias("symbol"), F.col("s.displayName").alias("name"))
    occ = o.select("relativePath", "language", F.col("o.symbol").alias("symbol"), F.when(F.col("o.symbolRoles").bitwiseAND(1) != 0, "definition").otherwise("reference").alias("role"), (F.col("o.range")[0] + 1).alias("line"))
    return occ.join(names, ["relativePath", "symbol"], "left").select(F.col("relativePath").alias("file"), "language", "symbol", "name", "role", "line")


def structural(spark: SparkSession, path: str) -> DataFrame:
    """(pack, rule, file, start_line, end_line, snippet): matches of structural search tools, whichever of their forms a line has."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    at = lambda *keys: F.coalesce(*[F.get_json_object("value", "$." + k) for k in keys])
    return raw.select(
        at("pack", "tool").alias("pack"), at("check_id", "ruleId", "rule_id", "rule").alias("rule"), at("path", "file", "uri").alias("file"),
        at("start.line", "range.start.line", "startLine").cast("long").alias("start_line"), at("end.line", "range.end.line", "endLine").cast("long").alias("end_line"),
        at("extra.lines", "text", "matched", "snippet").alias("snippet")).filter("file is not null")


def symbol_id(source: Column, key: Column) -> Column:
    """A stable id from a source and the key it gives."""
    return F.sha1(F.concat_ws(":", source, key))
