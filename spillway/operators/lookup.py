"""Lookups by a number that is only nearly equal, without comparing everything with everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _place(x: Column, rtol: float, atol: float) -> Column:
    """A scale on which numbers within atol + rtol |x| of x are less than one step away, for every size of x.

    asinh(x / s) with s = atol / rtol rises by dx / sqrt(x^2 + s^2), and s + |x| is at most sqrt(2) of that root.
    """
    s = F.lit(max(atol, 1e-300) / rtol)
    return F.floor(F.signum(x) * F.asinh(F.abs(x) / s) / (2 * 2**0.5 * rtol)).cast("long")  # of negative numbers asinh loses digits


def close_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: Sequence[str] = ("series_id",), rtol: float = 1e-5, atol: float = 1e-8, how: str = "inner") -> DataFrame:
    """left joined with right on equal keys and |left_on - right_on| <= atol + rtol |right_on|; how is inner or left.

    right stands at its place on a scale of numbers and left looks at its own place and the two beside it, so the join is one of
    equal keys, with the exact closeness as a residual. Null and infinite numbers are close to nothing. All columns
    stay; right's must not repeat left's but for the keys.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if rtol <= 0:
        raise ValueError("rtol must be positive")
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    a, b = F.col(left_on).cast("double"), F.col(right_on).cast("double")
    rows = left.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else left
    at = _place(a, rtol, atol)
    looks = rows.filter(usable(a)).withColumn("_place", F.explode(F.array(at - 1, at, at + 1)))
    stands = right.filter(usable(b)).withColumn("_place", _place(b, rtol, atol))
    found = looks.join(stands, [*keys, "_place"]).filter(F.abs(a - b) <= atol + rtol * F.abs(b)).drop("_place")
    if how == "inner":
        return found
    extra = [c for c in right.columns if c not in keys]
    return rows.join(found.select("_row", *extra), "_row", "left").drop("_row")
