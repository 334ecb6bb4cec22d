"""Arrays. Positions count from 0; lengths are 64-bit Ints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import require


def _upto(n: Column) -> Column:
    """Ints from 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))


def range_(n: Column) -> Column:
    """0 to n - 1; a negative n fails."""
    n = n.cast("long")
    return require(n >= 0, _upto(n), "range of a negative number")


def transpose(rows: Column) -> Column:
    """Columns of rows of equal length; others fail."""
    width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    out = F.transform(_upto(width.cast("long")), lambda j: F.transform(rows, lambda r: F.get(r, j.cast("int"))))
    return require(F.forall(rows, lambda r: F.size(r) == width), out, "transpose of rows that differ in length")


def cross(a: Column, b: Column) -> Column:
    """Pairs of each of a with each of b, a's order first."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("left"), y.alias("right")))))


def zip_(a: Column, b: Column) -> Column:
    """Pairs by position; unequal lengths fail."""
    return require(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.struct(x.alias("left"), y.alias("right"))), "zip of arrays that differ in length")


def unzip(pairs: Column) -> Column:
    return F.struct(F.transform(pairs, lambda p: p["left"]).alias("left"), F.transform(pairs, lambda p: p["right"]).alias("right"))


def contains(items: Column, value: Column) -> Column:
    """Whether the value is an item; null is found among nulls, and the answer is never null."""
    return F.coalesce(F.exists(items, lambda x: x.eqNullSafe(value)), F.lit(False))


def chunk(items: Column, size: Column | int) -> Column:
    """Runs of `size` items, the last one shorter; a size under 1 fails."""
    size = (F.lit(size) if isinstance(size, int) else size).cast("int")
    n = F.ceil(F.size(items) / F.greatest(size, F.lit(1))).cast("long")
    return require(size >= 1, F.transform(_upto(n), lambda k: F.slice(items, (k.cast("int") * size + 1).cast("int"), size)), "chunks of no items")


def flatten(arrays: Column) -> Column:
    return F.flatten(arrays)


def select_first(items: Column, default: Column | None = None) -> Column:
    """The first item that isn't null, else the default, else a failure."""
    found = F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(found, *([default] if default is not None else []), F.raise_error(F.lit("select_first: all items are null")))


def select_all(items: Column) -> Column:
    """The items that aren't null, in order."""
    return F.filter(items, lambda x: x.isNotNull())


def length(x: Column, text: bool = False) -> Column:
    """Items of an array or map, or code points of a string."""
    return (F.length(x) if text else F.when(x.isNotNull(), F.size(x))).cast("long")


def defined(x: Column) -> Column:
    return x.isNotNull()
