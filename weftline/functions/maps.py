"""Maps keep the order in which keys came."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Type, once, require


def lookup(m: Column, key: Column) -> Column:
    """m[key]; a key that isn't there fails."""
    return require(F.map_contains_key(m, key), m[key], "no such key")


def as_pairs(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("left"), e["value"].alias("right")))


def as_map(pairs: Column) -> Column:
    """A map of pairs; a key that comes twice fails, whatever the session's policy for duplicate keys."""
    names = F.transform(pairs, lambda p: p["left"])
    return require(F.size(F.array_distinct(names)) == F.size(names), F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["left"].alias("key"), p["right"].alias("value")))), "duplicate key")


def keys(m: Column) -> Column:
    return F.map_keys(m)


def values(m: Column) -> Column:
    return F.map_values(m)


def contains_key(m: Column, key: Column) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def collect_by_key(pairs: Column) -> Column:
    """Values by key: keys by first appearance, each key's values in order. The pairs are sorted once, so that a group is a
    stretch of them."""

    def grouped(order: Column) -> Column:
        n = F.size(order)
        begins = F.filter(F.transform(order, lambda e, j: F.struct(e["i"].alias("i"), j.alias("j"), e["k"].alias("k"))), lambda b: (b["j"] == 0) | ~F.get(order, b["j"] - 1)["k"].eqNullSafe(b["k"]))
        ends = lambda b: F.concat(F.transform(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), lambda x: x["j"]), F.array(n))
        parts = once(begins, lambda b: F.array_sort(F.zip_with(b, F.when(n > 0, ends(b)).otherwise(F.array().cast("array<int>")), lambda x, e: F.struct(x["i"].alias("i"), x["j"].alias("j"), e.alias("e"), x["k"].alias("k")))))
        value = lambda e: F.get(pairs, e["i"])["right"]
        return once(parts, lambda p: F.map_from_arrays(F.transform(p, lambda x: x["k"]), F.transform(p, lambda x: F.transform(F.slice(order, x["j"] + 1, x["e"] - x["j"]), value))))

    return F.when(pairs.isNotNull(), once(F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["left"].alias("k"), i.alias("i")))), grouped))


def enum_value(choice: Column, of: Type) -> Column:
    """The value behind a choice's name."""
    return lookup(F.create_map(*[x for k, v in of.choices for x in (F.lit(k), F.lit(v).cast("long") if type(v) is int else F.lit(v))]), choice)
