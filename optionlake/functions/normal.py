"""Standard normal density and distribution as Catalyst expressions.

Spark SQL has no error function. ``erfc`` is W. J. Cody's rational minimax
approximation (Math. Comp. 23, 1969), good to a few units in the last place on
the whole line, and written as polynomials so whole-stage codegen compiles it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cody's published coefficients, highest power first.
ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
           3.77485237685302021e2, 3.20937758913846947e3]
ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2,
           1.28261652607737228e3, 2.84423683343917062e3]
MID_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
           6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
           1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
MID_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2,
           5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3,
           4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
TAIL_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
            1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
TAIL_DEN = [1.0, 2.56852019228982242e0, 1.87295284992346725e0,
            5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]

UNDERFLOW = 27.0  # erfc is below the smallest double from here on
INV_SQRT_PI = 1.0 / math.sqrt(math.pi)
SQRT_2PI = math.sqrt(2.0 * math.pi)


def _horner(x: str, coefficients) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}D)", coefficients[1:], f"{coefficients[0]!r}D")


def erfc_sql(x: str) -> str:
    """SQL text of erfc of a column name; text costs one call to build, not hundreds."""
    y, square, inverse = f"abs({x})", f"({x} * {x})", f"(1.0D / ({x} * {x}))"
    # exp(-y*y) with y split in two so the square is not rounded before exp.
    coarse = f"(rint({y} * 16.0D) / 16.0D)"
    decay = f"exp(-{coarse} * {coarse}) * exp(-({y} - {coarse}) * ({y} + {coarse}))"
    middle = f"{_horner(y, MID_NUM)} / {_horner(y, MID_DEN)}"
    tail = f"({INV_SQRT_PI!r}D - {inverse} * {_horner(inverse, TAIL_NUM)} / {_horner(inverse, TAIL_DEN)}) / {y}"
    upper = f"({decay} * CASE WHEN {y} <= 4.0D THEN {middle} ELSE {tail} END)"
    return (
        f"CASE WHEN {y} <= 0.46875D THEN 1.0D - {x} * {_horner(square, ERF_NUM)} / {_horner(square, ERF_DEN)}"
        f" WHEN {x} >= {UNDERFLOW}D THEN 0.0D WHEN {x} <= -{UNDERFLOW}D THEN 2.0D"
        f" WHEN {x} > 0 THEN {upper} ELSE 2.0D - {upper} END"
    )


def with_norm_cdf(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """Add N(x) for each named argument; both tails keep full relative accuracy.

    The argument becomes a column first, so a long one is written once and not
    once per mention in the approximation. N(+-inf) is exact.
    """
    scaled = {f"_erfc_{n}": x * (-math.sqrt(0.5)) for n, x in names.items()}
    values = {n: F.expr(f"0.5D * ({erfc_sql(f'_erfc_{n}')})") for n in names}
    return df.withColumns(scaled).withColumns(values).drop(*scaled)


def norm_pdf(x: Column) -> Column:
    return F.exp(x * x * -0.5) / SQRT_2PI
