"""Scalar functions as SQL expressions, so that they stay inside generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.schema import EARTH_KM

#: A published rational approximation of the normal quantile (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
#: A published Chebyshev fit of the complementary error function (relative error 1.2e-7).
_E = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _poly(x: str, coefficients: tuple[float, ...], tail: str = "") -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return f"({out} * {x} + 1)" if tail else out


def norm_ppf_sql(p: str) -> str:
    """SQL for the standard normal quantile of 0 < p < 1."""
    low, q = f"sqrt(-2 * ln({p}))", f"({p} - 0.5)"
    high = f"sqrt(-2 * ln(1 - {p}))"
    r = f"({q} * {q})"
    return (
        f"CASE WHEN {p} < 0.02425 THEN {_poly(low, _C)} / {_poly(low, _D, '+')} "
        f"WHEN {p} > 0.97575 THEN -{_poly(high, _C)} / {_poly(high, _D, '+')} "
        f"ELSE {_poly(r, _A)} * {q} / {_poly(r, _B, '+')} END"
    )


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """The same formula, in the same order, for an array."""

    def poly(x, coefficients):
        out = np.full(x.shape, coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    q = p - 0.5
    r = q * q
    out = poly(r, _A) * q / (poly(r, _B) * r + 1)
    for far, x, sign in ((p < 0.02425, p, 1), (p > 0.97575, 1 - p, -1)):
        if far.any():
            t = np.sqrt(-2 * np.log(x[far]))
            out[far] = sign * (poly(t, _C) / (poly(t, _D) * t + 1))
    return out


def norm_sf_sql(x: str) -> str:
    """SQL for the upper tail of the standard normal."""
    a = f"(abs({x}) / sqrt(CAST(2 AS DOUBLE)))"
    t = f"(1 / (1 + 0.5 * {a}))"
    half = f"(0.5 * {t} * exp(-{a} * {a} + {_poly(t, _E[::-1])}))"
    return f"CASE WHEN {x} >= 0 THEN {half} ELSE 1 - {half} END"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bits(p: Column, floor: float = 1e-9) -> Column:
    return -F.log2(F.greatest(p, F.lit(floor)))


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many decimals: the whole number nearest to x * 10^digits, halves away from zero.

    round() on a double goes by its shortest decimal text instead, which takes 0.145 up although 100 * 0.145 is below 14.5.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double") * F.lit(float(10**digits)), 0) / F.lit(float(10**digits))


def top2mean(values: Column) -> Column:
    """Mean of the two largest of an array of doubles; NaN and null are left out; NaN if none is left."""
    top = F.slice(F.sort_array(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)), asc=False), 1, 2)
    return F.when(F.size(top) == 0, F.lit(float("nan"))).otherwise(F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top))


def band(score: Column, theta: Column) -> Column:
    """HIGH from theta on, MEDIUM from half of it, else LOW (for theta >= 0)."""
    return F.when(score >= theta, "HIGH").when(score >= theta / 2, "MEDIUM").otherwise("LOW")


def bumped(version: Column, by: Column | int = 1) -> Column:
    """A version with its last number raised; text without a number stays."""
    by = F.lit(by) if isinstance(by, int) else by
    head, last, tail = (F.regexp_extract(version, r"^(.*?)(\d+)(\D*)$", i) for i in (1, 2, 3))
    return F.when(version.rlike(r"\d"), F.concat(head, (last.cast("long") + by).cast("string"), tail)).otherwise(version)
