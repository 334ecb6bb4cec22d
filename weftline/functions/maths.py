"""Numbers. Int is a checked 64-bit integer, Float an IEEE double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import require

_TOP, _LOW = 2**63 - 1, -(2**63)


def _saturated(x: Column) -> Column:
    """A whole double as an Int: NaN is 0, what is out of range the nearest Int."""
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= float(2**63), F.lit(_TOP)).when(x <= float(_LOW), F.lit(_LOW)).otherwise(x.cast("long"))


def floor(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNotNull(), F.floor(x).cast("long"))


def ceil(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNotNull(), F.ceil(x).cast("long"))


def round_(x: Column) -> Column:
    """To the nearest Int, halves away from zero."""
    x = x.cast("double")
    whole = F.signum(x) * F.floor(F.abs(x))
    return F.when(x.isNotNull(), _saturated(F.when(F.isnan(x) | (F.abs(x) >= float(2**52)), x).when(F.abs(x) - F.abs(whole) >= 0.5, whole + F.signum(x)).otherwise(whole)))


def min_(a: Column, b: Column) -> Column:
    """The smaller; NaN only if both are. Null if one is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def max_(a: Column, b: Column, floats: bool = False) -> Column:
    """The larger; with floats, NaN only if both are. Null if one is null."""
    out = F.greatest(a, b)
    if floats:
        out = F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(out)
    return F.when(a.isNotNull() & b.isNotNull(), out)


def divide(a: Column, b: Column, floats: bool = False) -> Column:
    """Ints: truncated toward zero, division by zero (or of the least Int by -1) fails. Floats: IEEE."""
    if not floats:
        return require(b != 0, F.call_function("div", a, F.when(b != 0, b)), "division by zero")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), nan).otherwise(F.when(a > 0, inf).otherwise(-inf))


def remainder(a: Column, b: Column, floats: bool = False) -> Column:
    """With the sign of the dividend; Ints by zero fail, Floats by zero are NaN."""
    if floats:
        a, b = a.cast("double"), b.cast("double")
        return F.when(b != 0, a % F.when(b != 0, b)).when(a.isNotNull() & b.isNotNull(), F.lit(float("nan")))
    return require(b != 0, a % F.when(b != 0, b), "division by zero")


def int_power(base: Column, exponent: Column) -> Column:
    """Checked power of Ints; a negative exponent and an overflow fail. Squares in turn: 64 steps at most.

    Beyond an exponent of 62 only 0, 1 and -1 stay in range, so the fold is bounded whatever the exponent.
    """
    base, exponent = base.cast("long"), exponent.cast("long")
    small = F.abs(base) <= 1
    times = F.when(small, F.pmod(exponent, F.lit(2)) + F.when(exponent > 0, 2).otherwise(0)).otherwise(F.least(exponent, F.lit(64))).cast("int")
    folded = F.aggregate(F.array_repeat(base, times), F.lit(1).cast("long"), lambda x, y: x * y)
    return require(exponent >= 0, folded, "negative exponent")
