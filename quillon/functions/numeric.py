"""Rounding half to even on the binary value of a double, as Python's round() does, in integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def round_exact(x: Column, digits: int, below: int = 128) -> Column:
    """x (0 <= x < below) to that many digits. Exact wherever x has no bits under 2^-b, for b the bits left in a long."""
    bits = 62 - below.bit_length()
    unit, half = F.lit(2**bits).cast("decimal(19,0)"), F.lit(2 ** (bits - 1)).cast("decimal(19,0)")
    n = (x * F.lit(float(2**bits))).cast("bigint").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(4,0)")
    parts = let(n, lambda v: F.struct(F.call_function("div", v, unit).alias("q"), (v % unit).alias("r")))
    return let(parts, lambda p: (p["q"] + F.when((p["r"] > half) | ((p["r"] == half) & (p["q"] % 2 == 1)), 1).otherwise(0)).cast("double") / F.lit(float(10**digits)))


def round_exact_sql(x: str, digits: int, below: int = 128) -> str:
    """The same in the oracle's SQL."""
    bits = 62 - below.bit_length()
    n = f"((({x}) * {float(2**bits)!r}::DOUBLE)::BIGINT::HUGEINT * {10**digits})"
    unit, half = f"{2**bits}::HUGEINT", f"{2 ** (bits - 1)}::HUGEINT"
    q, r = f"({n} // {unit})", f"({n} % {unit})"
    return f"(({q} + CASE WHEN {r} > {half} OR ({r} = {half} AND {q} % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {float(10**digits)!r}::DOUBLE)"
