"""Vectors as Column builders: arrays of numbers, without Python in the way."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of one length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """a scaled to length one; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def merge(code: Column, doc: Column) -> Column:
    """Mean of two vectors; where one is missing the other; null where their lengths differ."""
    mean = F.zip_with(code, doc, lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    as_double = lambda v: F.transform(v, lambda x: x.cast("double"))
    return F.when(code.isNull(), as_double(doc)).when(doc.isNull(), as_double(code)).when(F.size(code) == F.size(doc), mean)


def levels_of(levels: int) -> int:
    return min(256, max(2, levels))


def quantize(a: Column, low: float = -1.0, high: float = 1.0, levels: int = 256) -> Column:
    """Whole numbers 0..levels-1 for values low..high, half rounded up, clamped."""
    top = levels_of(levels) - 1
    return F.transform(a, lambda x: F.least(F.greatest(F.floor((x.cast("double") - low) * top / (high - low) + 0.5), F.lit(0)), F.lit(top)).cast("int"))


def dequantize(q: Column, low: float = -1.0, high: float = 1.0, levels: int = 256) -> Column:
    scale = (high - low) / (levels_of(levels) - 1)
    return F.transform(q, lambda x: x.cast("double") * scale + low)


def fitted(q: Column, dims: int, fill: int = 128) -> Column:
    """q clipped or padded to `dims` places; a missing vector is all `fill`."""
    filled = F.array_repeat(F.lit(fill), dims)
    return F.when(q.isNull(), filled).otherwise(F.slice(F.concat(q, filled), 1, dims))


def similarity(distance: Column, metric: str) -> Column:
    """Similarity of a distance: 1 - d for cosine, -d otherwise."""
    return 1 - distance if metric == "cosine" else -distance
