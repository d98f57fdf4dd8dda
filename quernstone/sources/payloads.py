"""Raw JSON of collectors, whose key spelling and nesting vary, aligned to the schema of its table."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from quernstone.arrow import map_rows

# Keys under which deliveries wrap a record.
WRAPPERS = ("body", "record", "alerts", "alert_record", "data", "payload", "item", "items", "finding", "findings", "records")


def bare(key: str) -> str:
    """A key without case and separators."""
    return re.sub(r"[^a-z0-9]", "", key.lower())


def _opened(value):
    """JSON inside a string, opened; None where the string is none."""
    try:
        return json.loads(value)
    except (ValueError, RecursionError):
        return None


def unwrapped(value, fields: set[str]) -> list[dict]:
    """All objects that hold records: JSON inside strings is opened, wrappers are left behind, every element of a list counts.

    An object without any of the fields and without a wrapper's key is a record of its own. Nesting is followed as deep as it goes.
    """
    found, todo = [], [value]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            value = _opened(value)
            if isinstance(value, (str, dict, list)):
                todo.append(value)
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            inner = [v for k, v in value.items() if bare(k) in WRAPPERS and isinstance(v, (dict, list, str))]
            if inner and not {bare(k) for k in value} & fields:
                todo.append(inner[0])
            else:
                found.append(value)
    return found


def aligned(value, kind, aliases: dict[str, list[str]]) -> list:
    """value in the form of the Spark type kind: keys by spelling-free name or alias, lone objects as lists of one.

    Where an object is due and a list of several is there, each of them is a form of its own: the first result holds the first of every
    such list, and each further element one more result that differs in its place alone. Nothing is left out, and places in lists stay.
    """
    if isinstance(kind, (StructType, ArrayType)) and isinstance(value, str):
        value = _opened(value)
    if value is None:
        return [None]
    if isinstance(kind, StructType):
        if isinstance(value, list):
            forms = [f for v in value if isinstance(v, dict) for f in aligned(v, kind, aliases)]
            return forms or [None]
        if not isinstance(value, dict):
            return [None]
        by_name = {bare(k): v for k, v in reversed(list(value.items()))}
        parts = []
        for f in kind.fields:
            name = bare(f.name)
            found = next((n for n in [name, *aliases.get(name, [])] if by_name.get(n) is not None), None)
            parts.append((f.name, aligned(by_name[found], f.dataType, aliases) if found is not None else [None]))
        first = {n: forms[0] for n, forms in parts}
        return [first, *({**first, n: form} for n, forms in parts for form in forms[1:])]
    if isinstance(kind, ArrayType):
        parts = [aligned(v, kind.elementType, aliases) for v in (value if isinstance(value, list) else [value])]
        first = [forms[0] for forms in parts]
        return [first, *([*first[:i], form, *first[i + 1 :]] for i, forms in enumerate(parts) for form in forms[1:])]
    if isinstance(kind, MapType):
        return [{str(k): None if v is None else str(v) for k, v in value.items()} if isinstance(value, dict) else None]
    if isinstance(kind, StringType):
        return [value if isinstance(value, str) else json.dumps(value, sort_keys=True)]
    return [value if isinstance(value, (int, float, bool)) else None]


def unpack_payloads(df: DataFrame, payload: str, columns: list[str], aliases: dict[str, list[str]], told_by: list[str] | None = None) -> DataFrame:
    """df with each of `columns` that is null filled from the JSON of `payload`, a row for each record that it holds.

    Only rows whose columns (those of told_by, if given) are all null and that carry a payload go through Python; a text that is not valid JSON, or
    holds nothing of the schema, leaves them null. All other rows and columns stay as they are.
    """
    kind = StructType([f for f in df.schema.fields if f.name in columns])
    names = {bare(c) for c in columns} | {a for c in columns for a in aliases.get(bare(c), [])}
    empty = F.lit(True)
    for c in told_by or columns:
        empty = empty & F.col(c).isNull()
    packed = empty & F.col(payload).isNotNull()
    # the whole row travels beside its payload, so no join back is needed
    rest = [c for c in df.columns if c != payload]
    carried = df.filter(packed).select(F.to_json(F.struct(*[F.col(c) for c in rest]), {"ignoreNullFields": "false"}).alias("__rest"), F.col(payload).alias("__raw"))

    def make():
        def kernel(rest_json, raw):
            records = [f for v in unwrapped(_opened(raw), names) for f in aligned(v, kind, aliases)]
            for r in records or [None]:
                yield rest_json, raw, json.dumps(r) if r else None
        return kernel

    carried_kind = StructType([StructField(c, StringType()) for c in ("__rest", "__raw", "__json")])
    rest_kind = StructType([f for f in df.schema.fields if f.name in rest])
    opened = (
        map_rows(carried, make, carried_kind)
        .select(F.from_json("__rest", rest_kind).alias("r"), "__raw", F.from_json("__json", kind).alias("k"))
        .select(*[(F.coalesce(F.col("r")[c], F.col("k")[c]) if c in columns else F.col("__raw") if c == payload else F.col("r")[c]).alias(c) for c in df.columns])
    )
    return df.filter(~packed).unionByName(opened)


__all__ = ["aligned", "bare", "unpack_payloads", "unwrapped"]
