"""Random values as pure functions of (seed, table, column, row id).

The same row gets the same value on any partitioning and after any retry, which ``rand(seed)`` does not give.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the inverse normal distribution.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_LOW = 0.02425


def uniform(seed: int, table: str, column: str, row_id: Column) -> Column:
    """A double in [0, 1) with 52 random bits."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(table), F.lit(column), row_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def _poly(coefs, x: Column) -> Column:
    total = F.lit(coefs[0])
    for c in coefs[1:]:
        total = total * x + F.lit(c)
    return total


def normal_ppf(u: Column) -> Column:
    """Standard normal quantile of ``u`` (0 is moved to the smallest positive draw)."""
    p = F.greatest(u, F.lit(2.0**-52))
    q = p - F.lit(0.5)
    r = q * q
    centre = _poly(PPF_A, r) * q / (_poly(PPF_B, r) * r + F.lit(1.0))
    lo = F.sqrt(F.lit(-2.0) * F.log(p))
    hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))

    def tail(t: Column) -> Column:
        return _poly(PPF_C, t) / (_poly(PPF_D, t) * t + F.lit(1.0))

    return F.when(p < PPF_LOW, tail(lo)).when(p > 1.0 - PPF_LOW, -tail(hi)).otherwise(centre)


def stride(n: int) -> int:
    """A multiplier coprime with ``n`` whose product with any id below ``n`` fits a bigint."""
    if n <= 2:
        return 1
    a = max(1, min(int(n * 0.6180339887498949), 2**62 // n))
    while gcd(a, n) != 1:
        a += 1
    return a


def permuted(row_id: Column, n: int, shift: int) -> Column:
    """A bijection of 0..n-1, computed without a shuffle."""
    return F.pmod(row_id * F.lit(stride(n)) + F.lit(shift % max(n, 1)), F.lit(max(n, 1)))
