"""History and authorship as version control tells them: its log with numbers of lines, and who wrote which lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Between commits, and between the fields of a commit's head, in the log that is read: `git log --numstat --format=%x1e%H%x1f%an%x1f%aI`.
RECORD, FIELD = "\x1e", "\x1f"


def log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, at, path, added, deleted): the files of each commit of a log; binary files count no lines, heads without fields are left out.

    Commits are read as records of their own, so that a log of any length is read in parallel.
    """
    lines = F.split(F.trim("value"), "\n")
    head = F.split(lines[0], FIELD)
    commits = spark.read.option("lineSep", RECORD).text(path).filter(F.size(head) >= 3).select(
        head[0].alias("commit"), head[1].alias("author"), F.try_to_timestamp(head[2]).alias("at"), F.explode(F.filter(F.slice(lines, 2, 1_000_000_000), lambda x: x.rlike("^(?:\\d+|-)\t(?:\\d+|-)\t."))).alias("l"))
    part = F.split("l", "\t", 3)
    number = lambda c: F.when(c == "-", 0).otherwise(c.cast("long"))
    return commits.select("commit", "author", "at", part[2].alias("path"), number(part[0]).alias("added"), number(part[1]).alias("deleted"))


def history(changes: DataFrame) -> DataFrame:
    """(path, commits, churn, authors, last_author, last_at) of each file: churn counts lines added and deleted; of commits at one time the greatest is the last."""
    return changes.groupBy("path").agg(
        F.count_distinct("commit").alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count_distinct("author").alias("authors"),
        F.max(F.struct("at", "commit", "author")).alias("l")).select("path", "commits", "churn", "authors", F.col("l.author").alias("last_author"), F.col("l.at").alias("last_at"))


def blame(spark: SparkSession, path: str) -> DataFrame:
    """(path, author, first, last): runs of lines by author, from lines `path`, first line, number of lines and author, parted by tabs."""
    part = F.split("value", "\t", 4)
    rows = spark.read.text(path).filter(F.size(part) == 4).select(part[0].alias("path"), part[3].alias("author"), part[1].cast("long").alias("first"), part[2].cast("long").alias("n"))
    return rows.filter("first > 0 and n > 0").select("path", "author", "first", (F.col("first") + F.col("n") - 1).alias("last"))
