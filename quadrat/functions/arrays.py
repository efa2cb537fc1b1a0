"""Helpers on nested arrays as column expressions, and on slices of arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_nested(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString().startswith("array<array<")


def flattened(df: DataFrame, name: str) -> DataFrame:
    """A nested array as one; others stay."""
    return df.withColumn(name, F.flatten(name)) if is_nested(df, name) else df


def mapped(df: DataFrame, name: str, f: Callable[[Column], Column]) -> DataFrame:
    """f of each element, at whatever depth of one or two."""
    inner = (lambda a: F.transform(a, f)) if is_nested(df, name) else f
    return df.withColumn(name, F.transform(name, inner))


def added(df: DataFrame, name: str, value: float) -> DataFrame:
    return mapped(df, name, lambda x: x + value)


Slices = Sequence[tuple[int, int]]


def intersected(a: Slices, b: Slices) -> list[tuple[int, int]] | None:
    """The part that two boxes of half-open ranges share; null if there is none."""
    out = [(max(p, r), min(q, s)) for (p, q), (r, s) in zip(a, b)]
    return out if all(p < q for p, q in out) else None


def trimmed(box: Slices, shape: Sequence[int]) -> list[tuple[int, int]] | None:
    """The part of a box inside an array of that shape."""
    return intersected(box, [(0, n) for n in shape])


def placed(shape_a: Sequence[int], shape_b: Sequence[int], offset_a: Sequence[int], offset_b: Sequence[int]) -> tuple[Slices, Slices] | None:
    """Where two arrays at offsets share elements, in each one's own indices; null if they do not meet."""
    box = lambda shape, off: [(o, o + n) for n, o in zip(shape, off)]
    both = intersected(box(shape_a, offset_a), box(shape_b, offset_b))
    own = lambda off: [(p - o, q - o) for (p, q), o in zip(both, off)]
    return (own(offset_a), own(offset_b)) if both else None
