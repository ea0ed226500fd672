"""Numeric column functions that stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody's rational approximations of the error function (1969), for |x| up to
# 0.46875, up to 4, and beyond; numerators and denominators by falling power, the last entry of A, C and P first.
ERF_A = 1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3
ERF_B = 1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3
ERF_C = 2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3
ERF_D = 1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3
ERF_P = 1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4
ERF_Q = 1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def erf_text(x: str) -> str:
    """The error function of a SQL expression, to double precision, as SQL text: one call parses all of it."""
    y, xx = f"abs({x})", f"(({x}) * ({x}))"
    small = f"({x}) * {_polynomial(xx, ERF_A)} / {_polynomial(xx, ERF_B)}"
    middle = f"signum({x}) * (1 - exp(-{xx}) * {_polynomial(y, ERF_C)} / {_polynomial(y, ERF_D)})"
    z = f"(1 / greatest({xx}, 1D))"
    tail = f"({1 / math.sqrt(math.pi)!r}D - {z} * {_polynomial(z, ERF_P)} / {_polynomial(z, ERF_Q)}) / greatest({y}, 1D)"
    return f"(CASE WHEN {y} <= 0.46875D THEN {small} WHEN {y} <= 4D THEN {middle} WHEN {y} < 6D THEN signum({x}) * (1 - exp(-{xx}) * {tail}) ELSE signum({x}) END)"


def normal_cdf_text(z: str) -> str:
    return f"(0.5D * (1 + {erf_text(f'({z} / {math.sqrt(2)!r}D)')}))"


def rounded_text(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits}D + 0.5D) / 1e{digits}D)"


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding by floor: the one rule used for every rounded output and rank key."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def plain_number(x: Column, digits: int = 4) -> Column:
    """Fixed decimals without trailing zeros, as text."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNotNull(), shown)
