"""Assertions on outputs, as Boolean columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, strings


def assertion(kind: str, col: Column, want=None, text: bool = False) -> Column:
    """Defined (want: True or False), Equals, Contains, Name, First, Last, Length, Left, Right (want: an inner assertion as (kind, want)) and Empty."""
    first, last = (lambda c: F.get(c, F.lit(0))), (lambda c: F.get(c, F.size(c) - 1))
    inner = lambda c: assertion(want[0], c, *want[1:])
    made: dict[str, Callable[[], Column]] = {
        "Defined": lambda: col.isNotNull() == F.lit(bool(want)),
        "Equals": lambda: col.eqNullSafe(F.lit(want)),
        "Contains": lambda: F.coalesce(F.contains(col, F.lit(want)), F.lit(False)) if text else arrays.contains(col, F.lit(want)),
        "Name": lambda: strings.basename(col).eqNullSafe(F.lit(want)),
        "First": lambda: inner(first(col)),
        "Last": lambda: inner(last(col)),
        "Length": lambda: arrays.length(col, text).eqNullSafe(F.lit(want)),
        "Left": lambda: inner(col["left"]),
        "Right": lambda: inner(col["right"]),
        "Empty": lambda: (arrays.length(col, text) == 0).eqNullSafe(F.lit(bool(want))),
    }
    if kind not in made:
        raise ValueError(f"no assertion {kind}")
    return F.coalesce(made[kind](), F.lit(False))


def checked(outputs: DataFrame, wanted: dict[str, list[tuple]], text: tuple[str, ...] = ()) -> DataFrame:
    """outputs with `passed`, and `failed`: names of the assertions that don't hold."""
    marks = [F.when(~assertion(kind, F.col(name), *want, text=name in text), f"{name}: {kind}") for name, tests in wanted.items() for kind, *want in tests]
    out = outputs.withColumn("failed", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))
    return out.withColumn("passed", F.size("failed") == 0)
