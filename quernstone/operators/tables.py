"""The tables of the data model as operators use them: rows delivered again are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernstone.functions.paths import extension, normal_path
from quernstone.runtime import latest, stored, table


AGAIN = 1_000_000  # repeated ids up to which they are broadcast; more meet the rows in a shuffle join
BATCH = 512  # chunks of one file that one row may carry; a file with more has several rows


def repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(again): ids of chunks that were delivered more than once. Made once for all queries: only ids move."""
    return stored(spark, sf_dir, "repeated_chunks", ("chunks",), lambda: table(spark, sf_dir, "chunks").filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("again")))


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunks by id, each once. Deliveries of a chunk are the same row; where they are not, the greatest row counts.

    Chunks that come once stay where they are; those that come again are compared.
    """
    df = table(spark, sf_dir, "chunks").filter("id is not null")
    picked = [c for c in (columns or df.columns) if c != "id"]
    if not picked:
        return df.select("id").distinct()
    again = repeated_chunks(spark, sf_dir)
    few = again if again.count() > AGAIN else F.broadcast(again)
    marked = df.select("id", *picked).join(few, F.col("id") == F.col("again"), "left")
    once = marked.filter("again is null").select("id", *picked)
    best = marked.filter("again is not null").groupBy("id").agg(F.max(F.struct(*picked)).alias("r")).select("id", *[F.col(f"r.`{c}`").alias(c) for c in picked])
    return once.unionByName(best)


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest delivery of each file; with `language` from the extension of its path among the columns."""
    df = table(spark, sf_dir, "files").filter("file_id is not null").withColumn("suffix", extension(F.trim("path")))
    picked = list(columns or ("repo", "path", "ext", "lang", "content", "suffix"))
    return latest(df.select("file_id", *[c for c in picked if c != "ingested_at"], "ingested_at"), ["file_id"], "ingested_at").select("file_id", *picked)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, token_id, doc_id, tf) of live postings: tf above 0, of chunks that exist."""
    def build():
        p = table(spark, sf_dir, "token_postings").filter("tf > 0 and doc_id is not null and token_id is not null and mode is not null")
        ids = table(spark, sf_dir, "chunks").filter("id is not null").select(F.col("id").alias("doc_id"))
        # laid out by document at once: the semi join and the aggregate need no other order
        return p.select("mode", "token_id", "doc_id", "tf").join(ids, "doc_id", "left_semi").groupBy("mode", "token_id", "doc_id").agg(F.max("tf").alias("tf"))
    return stored(spark, sf_dir, "postings", ("token_postings", "chunks"), build, by="mode").select("mode", "token_id", "doc_id", "tf")


def named_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, token, doc_id, tf): live postings by lower-case token; spellings that differ in case add up.

    Kept by mode and sorted by token, so that a query reads the row groups of its tokens alone; a hot token lies in several files.
    """
    def build():
        vocab = table(spark, sf_dir, "token_vocab").filter("token is not null").select("mode", "token_id", F.lower("token").alias("token"))
        return postings(spark, sf_dir).join(vocab, ["mode", "token_id"]).groupBy("mode", "token", "doc_id").agg(F.sum("tf").alias("tf"))
    laid = lambda df: df.repartitionByRange("token", "doc_id").sortWithinPartitions("mode", "token", "doc_id")
    return stored(spark, sf_dir, "named_postings", ("token_postings", "token_vocab", "chunks"), build, laid, "mode").select("mode", "token", "doc_id", "tf")


def named_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, doc_id, dl): tokens of each chunk."""
    build = lambda: named_postings(spark, sf_dir).groupBy("mode", "doc_id").agg(F.sum("tf").alias("dl"))
    return stored(spark, sf_dir, "named_lengths", ("token_postings", "token_vocab", "chunks"), build, by="mode").select("mode", "doc_id", "dl")


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, n, avg_dl): chunks of each mode, those without postings too, and their average length."""
    def build():
        n = chunks(spark, sf_dir, "mode").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
        total = named_lengths(spark, sf_dir).groupBy("mode").agg(F.sum("dl").alias("total"))
        return n.join(total, "mode", "left").select("mode", "n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avg_dl")).coalesce(1)
    return stored(spark, sf_dir, "index_statistics", ("token_postings", "token_vocab", "chunks"), build)


#: The same tables in SQL.
CHUNKS_SQL = "(SELECT DISTINCT * FROM chunks WHERE id IS NOT NULL)"
FILES_SQL = (r"(SELECT file_id, max(repo) AS repo, max(path) AS path, max(ext) AS ext, max(lang) AS lang, max(content) AS content, "
             r"max(lower(regexp_extract(trim(path), '\.([^./\\]+)$', 1))) AS suffix FROM files WHERE file_id IS NOT NULL GROUP BY file_id)")
POSTINGS_SQL = ("(SELECT mode, token_id, doc_id, max(tf) AS tf FROM token_postings WHERE tf > 0 AND mode IS NOT NULL AND token_id IS NOT NULL "
                "AND doc_id IN (SELECT id FROM chunks) GROUP BY mode, token_id, doc_id)")
NAMED_SQL = (f"(SELECT p.mode, v.token, p.doc_id, CAST(sum(p.tf) AS BIGINT) AS tf FROM {POSTINGS_SQL} p JOIN (SELECT mode, token_id, lower(token) AS token FROM token_vocab WHERE token IS NOT NULL) v "
             "ON p.mode = v.mode AND p.token_id = v.token_id GROUP BY p.mode, v.token, p.doc_id)")


def with_file_id(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks with file_id filled from (repo, normalised path) where it is null; chunks of no known file are left out.

    Only rows without file_id move for that; among files of one path the latest, then the greatest id, is taken.
    """
    known = chunks.filter("file_id is not null")
    paths = (
        files.filter("file_id is not null and path is not null")
        .groupBy(F.col("repo").alias("__repo"), normal_path(F.col("path")).alias("__path"))
        .agg(F.max_by("file_id", F.struct("ingested_at", "file_id")).alias("__file_id"))
    )
    lost = chunks.filter("file_id is null").withColumn("__p", normal_path(F.col("file")))
    found = lost.join(paths, (lost["repo"] == paths["__repo"]) & (lost["__p"] == paths["__path"]))
    return known.unionByName(found.select(*[F.col("__file_id").alias("file_id") if c == "file_id" else lost[c] for c in chunks.columns]))


#: Chunks with the id, path, suffix and text of their file; its content too.
LOCATED_SQL = rf"""(SELECT c.* EXCLUDE (file_id), f.file_id, f.path, f.suffix, f.lang, f.content, CASE WHEN c."end" > c.start AND c.start >= 0 THEN substring(f.content, CAST(c.start + 1 AS BIGINT), CAST(c."end" - c.start AS BIGINT)) END AS text
FROM {CHUNKS_SQL} c LEFT JOIN (SELECT repo, path, max(file_id) AS file_id FROM files GROUP BY repo, path) p
  ON c.file_id IS NULL AND c.repo = p.repo AND p.path = regexp_replace(replace(trim(c.file), chr(92), '/'), '^(\.?/)+', '')
JOIN {FILES_SQL} f ON f.file_id = coalesce(c.file_id, p.file_id))"""


def files_with_chunks(chunks: DataFrame, texts: DataFrame, ref: Column) -> DataFrame:
    """The rows of `texts` (file_id and what is wanted of files, each file once) with `refs`, the `ref` of the chunks of each.

    chunks: file_id, id and what ref needs. A row carries about BATCH refs at most: a file that many chunks name comes in several
    rows, its chunks spread by a hash of their id; a file's text moves once for each. Files without chunks are left out.
    """
    crowded = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > BATCH)
    batch = F.when(F.col("__n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / BATCH)))
    grouped = (
        chunks.join(crowded, "file_id", "left").select("file_id", batch.alias("__batch"), ref.alias("__ref"))
        .groupBy("file_id", "__batch").agg(F.collect_list("__ref").alias("refs"))
    )
    return texts.join(grouped, "file_id").drop("__batch")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of known files, each once, with path, suffix and lang of the file, `text`, the chunk's range of its content, and `imports` of the file.

    Made once for all queries: contents move once for the chunks of a file, and leave no copy in a chunk's row. Ranges that are null or inverted give a null text.
    """
    from quernstone.operators.relations import imports

    def build():
        c = with_file_id(chunks(spark, sf_dir), table(spark, sf_dir, "files"))
        f = files(spark, sf_dir, "path", "suffix", "lang", "content")
        rows = files_with_chunks(c, f, F.struct(*[k for k in c.columns if k != "file_id"]))
        one = rows.select("file_id", "path", "suffix", "lang", "content", imports(F.col("content")).alias("imports"), F.explode("refs").alias("c"))
        text = F.substring("content", (F.col("c.start") + 1).cast("int"), F.greatest(F.col("c.end") - F.col("c.start"), F.lit(0)).cast("int"))
        return one.select("c.*", "file_id", "path", "suffix", "lang", "imports", F.when((F.col("c.end") > F.col("c.start")) & (F.col("c.start") >= 0), text).alias("text"))
    return stored(spark, sf_dir, "located", ("chunks", "files"), build)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, repo, path, parts, salt, place) of chunks of known files: what their stable ids are made from; contents move as for `located`."""
    from quernstone.operators.chunking import identity_parts

    c = with_file_id(chunks(spark, sf_dir, "chunk_id", "repo", "file_id", "file", "start", "end", "startLine", "endLine", "kind", "name"), table(spark, sf_dir, "files"))
    rows = files_with_chunks(c, files(spark, sf_dir, "path", "content"), F.struct(*[k for k in c.columns if k != "file_id"]))
    one = rows.select("path", "content", F.explode("refs").alias("c"))
    text = lambda *names: F.concat_ws(":", *[F.coalesce(F.col(f"c.{n}").cast("string"), F.lit("")) for n in names])
    return one.select("c.id", "c.repo", "path", identity_parts(F.coalesce("content", F.lit("")), F.coalesce("c.start", F.lit(0)), F.coalesce("c.end", F.lit(0))).alias("parts"),
                      text("chunk_id", "startLine", "endLine", "kind", "name").alias("salt"), text("start", "end", "kind", "name").alias("place"))
