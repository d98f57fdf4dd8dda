"""Scanner findings, dependency alerts and generic records as flat, related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.operators.nested import NestedTable, flat_tables
from quernstone.runtime import cut, latest, table
from quernstone.sources.payloads import unpack_payloads

# Nested columns of each table, other names of their keys, and where packages are: path -> place.
SOURCES = {
    "inspector": (
        ["packageVulnerabilityDetails", "resources"],
        {"packagevulnerabilitydetails": ["vulnerabilitydetails"], "vulnerablepackages": ["packages", "package"], "name": ["packagename"]},
        {"packageVulnerabilityDetails.vulnerablePackages": "vulnerablepackages"},
    ),
    "dependabot": (
        ["security_advisory", "security_vulnerability", "dependency", "alert"],
        {"name": ["packagename"], "securityvulnerability": ["vulnerability"], "securityadvisory": ["advisory"]},
        {"security_vulnerability.package": "security_vulnerability", "dependency.package": "dependency"},
    ),
    "generic": (["vuln", "package", "exposure"], {"name": ["packagename"], "vuln": ["vulnerability"]}, {"package": "package"}),
}


def finding_tables(spark: SparkSession, sf_dir: str, source: str, packages_only: bool = False) -> dict[str, NestedTable]:
    """Flat tables of one source, by path, of every nested column; or of those that hold packages. Of records delivered again the latest counts.

    A payload is read where the columns that hold packages are all null.
    """
    columns, aliases, places = SOURCES[source]
    telling = [c for c in columns if any(p.split(".")[0] == c for p in places)]
    picked = telling if packages_only else columns
    df = table(spark, sf_dir, source).select("rec_id", *picked, "payload", "ingested_at")
    df = latest(df.filter("rec_id is not null"), ["rec_id"], "ingested_at")
    # unpacked once: each flat table and each of its two sides reads it
    return flat_tables(cut(unpack_payloads(df, "payload", picked, aliases, telling).select("rec_id", *picked)), ["rec_id"], picked)


def package_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, rec_id, place, pos, name, object_id): each mention of a package with a non-blank name.

    A bridge row keeps the record and place of a mention; its name comes from the object stored once. Hot packages make the
    bridge side of that join skewed, the object side never: adaptive execution splits it.
    """
    parts = []
    for source, (_, _, places) in SOURCES.items():
        tables = finding_tables(spark, sf_dir, source, packages_only=True)
        for path, place in places.items():
            t = tables[path]
            parts.append(
                t.bridge.join(t.objects, "object_id").select(
                    F.lit(source).alias("source"), "rec_id", F.lit(place).alias("place"), F.col("ordinal").alias("pos"),
                    F.regexp_replace("name", r"^\s+|\s+$", "").alias("name"), "object_id",
                ).filter("name != ''")
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def severity_level(value):
    """Canonical severity from its spellings; null where unknown."""
    v = F.lower(F.trim(value))
    return (
        F.when(v.isin("critical", "crit", "severe"), "critical").when(v.isin("high", "important"), "high")
        .when(v.isin("medium", "moderate", "med"), "medium").when(v.isin("low", "minor", "informational", "info"), "low")
    )


def finding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, rec_id, vuln_id, severity, title): one row per record of the three tables in canonical form."""
    parts = []
    picks = {
        "inspector": (F.coalesce("packageVulnerabilityDetails.vulnerabilityId", "title"), F.coalesce("severity", "packageVulnerabilityDetails.severity"), F.col("title")),
        "dependabot": (F.coalesce("security_advisory.cve_id", "security_advisory.ghsa_id"), F.col("security_advisory.severity"), F.col("security_advisory.summary")),
        "generic": (F.col("vuln.vulnId"), F.col("vuln.severity"), F.col("vuln.title")),
    }
    for source, (vuln, severity, title) in picks.items():
        df = latest(table(spark, sf_dir, source).filter("rec_id is not null"), ["rec_id"], "ingested_at")
        parts.append(df.select(F.lit(source).alias("source"), "rec_id", vuln.alias("vuln_id"), severity_level(severity).alias("severity"), title.alias("title")).distinct())
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct mentions of packages: (source, rec_id, place, pos, name)."""
    return package_mentions(spark, sf_dir).select("source", "rec_id", "place", "pos", "name").distinct()


def p2_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct objects of every flat table: (source, path, occurrences, objects)."""
    parts = []
    for source in SOURCES:
        for path, t in finding_tables(spark, sf_dir, source).items():
            parts.append(t.bridge.groupBy(F.lit(source).alias("source"), F.lit(path).alias("path")).agg(
                F.count(F.lit(1)).alias("occurrences"), F.count_distinct("object_id").alias("objects")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
