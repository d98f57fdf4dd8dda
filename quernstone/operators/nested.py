"""Nested records as flat tables with Merkle identities.

Every object below a record gets an identity: the digest of its canonical form, in which child objects stand by their own
identities, computed bottom-up from the schema by built-in functions. Objects that are alike are stored once; each place
an object occurs in stays as a bridge row (record key, parent identity, child identity, ordinal).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _canonical(value: Column, kind: DataType) -> Column:
    """Text that is equal exactly for equal values; null has a form of its own."""
    if isinstance(kind, MapType):
        body = F.to_json(F.array_sort(F.map_entries(value)))
    elif isinstance(kind, ArrayType):
        body = F.to_json(value)
    else:
        body = value.cast("string")
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(body).cast("string"), F.lit(":"), body))


def _enricher(kind: StructType):
    return lambda x: enriched(x, kind)


def enriched(value: Column, kind: StructType) -> Column:
    """value with `__id` at every object: struct(__id, fields...), with child objects enriched before their parents."""
    fields, forms = [], []
    for f in sorted(kind.fields, key=lambda f: f.name):
        v, t = value[f.name], f.dataType
        if isinstance(t, StructType):
            v = enriched(v, t)
            form = F.coalesce(v["__id"], F.lit("n"))
        elif isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
            element = t.elementType
            v = F.transform(v, _enricher(element))
            form = F.when(v.isNull(), F.lit("n")).otherwise(
                F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.coalesce(x["__id"], F.lit("n"))), ","), F.lit("]"))
            )
        else:
            form = _canonical(v, t)
        fields.append(v.alias(f.name))
        forms.append(F.concat(F.lit(f.name + "="), form))
    digest = F.md5(F.concat_ws("\x1f", *forms)).alias("__id")
    return F.when(value.isNull(), F.lit(None)).otherwise(F.struct(digest, *fields))


@dataclass
class NestedTable:
    """One kind of object: `objects` has each distinct object once, `bridge` each place where it occurs."""

    path: str
    objects: DataFrame
    bridge: DataFrame


def flat_tables(df: DataFrame, key: list[str], columns: list[str]) -> dict[str, NestedTable]:
    """Nested columns of df as flat tables, by dotted path.

    key: columns that name a record. Each struct column, and each struct or array of structs below it, becomes a table:
    objects(object_id, scalar fields; lists and maps of scalars stay as they are) and bridge(key..., parent_id, object_id,
    ordinal). parent_id is null right below the record; ordinal is the zero-based place as delivered (0 outside arrays).
    Null objects and null elements give no row, but elements after a null keep their place. Records delivered again in the
    same form give their bridge rows once.
    """
    return {t.path: t for c in columns for t in _tables_of(df, key, c)}


def _tables_of(df: DataFrame, key: list[str], column: str) -> list[NestedTable]:
    kind = df.schema[column].dataType
    many = isinstance(kind, ArrayType)
    keyed = [F.col(k) for k in key]
    if many:
        element = kind.elementType
        grown = F.transform(F.col(column), _enricher(element))
        base = df.select(*keyed, F.lit(None).cast("string").alias("__parent"), F.posexplode(grown).alias("__ordinal", "__o"))
        base = base.withColumn("__ordinal", F.col("__ordinal").cast("long"))
        kind = element
    else:
        base = df.select(*keyed, F.lit(None).cast("string").alias("__parent"), F.lit(0).cast("long").alias("__ordinal"), enriched(F.col(column), kind).alias("__o"))
    return list(_walk(base.filter("__o is not null"), key, column, kind))


def _walk(rows: DataFrame, key: list[str], path: str, kind: StructType):
    children = [f for f in kind.fields if _object_kind(f.dataType) is not None]
    scalars = [f for f in kind.fields if _object_kind(f.dataType) is None]
    objects = (
        rows.select(F.col("__o")["__id"].alias("object_id"), F.struct(F.lit(0).alias("__"), *[F.col("__o")[f.name].alias(f.name) for f in scalars]).alias("__s"))
        .groupBy("object_id").agg(F.first("__s").alias("__s"))
        .select("object_id", *[F.col("__s")[f.name].alias(f.name) for f in scalars])
    )
    bridge = rows.select(*key, F.col("__parent").alias("parent_id"), F.col("__o")["__id"].alias("object_id"), F.col("__ordinal").alias("ordinal")).distinct()
    yield NestedTable(path, objects, bridge)
    for f in children:
        below, element = F.col("__o")[f.name], _object_kind(f.dataType)
        parent = F.col("__o")["__id"].alias("__parent")
        if isinstance(f.dataType, ArrayType):
            lower = rows.select(*key, parent, F.posexplode(below).alias("__ordinal", "__o")).withColumn("__ordinal", F.col("__ordinal").cast("long"))
        else:
            lower = rows.select(*key, parent, F.lit(0).cast("long").alias("__ordinal"), below.alias("__o"))
        yield from _walk(lower.filter("__o is not null"), key, f"{path}.{f.name}", element)


def _object_kind(kind: DataType) -> StructType | None:
    if isinstance(kind, StructType):
        return kind
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return kind.elementType
    return None
