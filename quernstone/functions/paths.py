"""Paths and extensions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading `./` or `/`, no empty or `.` parts; null stays null."""
    p = F.regexp_replace(F.trim(path), r"\\+", "/")
    p = F.regexp_replace(p, r"/(?:\./|/)+", "/")
    return F.regexp_replace(p, r"^(?:\.?/)+", "")


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last part, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
