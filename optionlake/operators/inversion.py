"""Implied volatility in the JVM: a start for each part of the price curve, then steps of third order.

Time value in units of D * sqrt(F * K) is a function of total volatility alone
once the log-moneyness is given. Below its inflection point the steps solve for
the reciprocal of its logarithm, near its upper limit for the logarithm of what
is missing from that, and in between for the price itself: in these the curve is
nearly straight. From the starts here three steps come within 1e-10 of the price
over all log-moneyness up to 5 and total volatility from 0.001 to 5, and a
volatility is an answer only if it gives the price back.

Every stage is a projection, so nothing leaves the JVM and no row waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import black76
from ..functions.normal import SQRT_2PI, with_norm_cdf

# Search range in total volatility and the price-bound margin.
MIN_VOL = 1e-8
MAX_VOL = 5.0
MARGIN = 1e-12

#: A price counts as matched within this share of itself, or of the least price that is told apart from nothing.
RESIDUAL, LEAST_PRICE = 1e-8, 1e-8
STEPS = 3
#: The inflection point is taken no nearer to zero than this; prices beyond this share of the limit are solved for what is missing.
LEAST_START, HIGH = 1e-3, 0.5


def _unit_price(df: DataFrame, price: str, slope: str, v: str) -> DataFrame:
    """Out-of-the-money price per unit of sqrt(F * K) and its derivative; ``_x = -|ln(F/K)|`` makes a call of every contract."""
    staged = with_norm_cdf(df.withColumn("_d1", F.expr(f"_x / {v} + {v} / 2D")), {"_n1": F.col("_d1"), "_n2": F.col("_d1") - F.col(v)})
    return staged.withColumns(
        {price: F.expr("_half * _n1 - _n2 / _half"), slope: F.expr(f"_half * exp(-0.5D * _d1 * _d1) / {SQRT_2PI!r}D")}
    ).drop("_d1", "_n1", "_n2")


def _start(df: DataFrame) -> DataFrame:
    """Add ``_low`` and ``_high`` (which part of the curve) and ``_v``, a volatility near the answer."""
    at = _unit_price(df.withColumn("_vc", F.expr(f"least(greatest(sqrt(-2D * _x), {LEAST_START}D), {MAX_VOL}D)")), "_cc", "_sc", "_vc")
    at = at.withColumns({"_low": F.expr("_c < _cc"), "_high": F.expr(f"_c >= _cc AND _c > {HIGH}D * _half")})
    # The tail of the price far below the inflection, or the chord from nothing to it, whichever is higher.
    tail = "-_x / nullif(sqrt(2D * (-_x / 4D + ln(_cc / _c))), 0D)"
    below = f"greatest({tail}, _vc * try_divide(_c, _cc))"
    # At the money the price is 1 - 2N(-v/2); the normal quantile by a rational approximation good to 5e-4.
    t = "sqrt(-2D * ln(greatest((_half - _c) / _half / 2D, 1e-300D)))"
    at = at.withColumn("_t", F.expr(f"CASE WHEN _high THEN {t} END"))
    quantile = "_t - (2.515517D + 0.802853D * _t + 0.010328D * _t * _t) / (1D + 1.432788D * _t + 0.189269D * _t * _t + 0.001308D * _t * _t * _t)"
    first = f"CASE WHEN _low THEN {below} WHEN _high THEN greatest(2D * ({quantile}), _vc) ELSE _vc + try_divide(_c - _cc, _sc) END"
    return at.withColumn("_v", F.expr(f"least(greatest(coalesce({first}, _vc), {MIN_VOL}D), {MAX_VOL}D)")).drop("_t", "_cc", "_sc", "_vc")


def _cut(df: DataFrame, name: str) -> DataFrame:
    """End the generated code here: a lambda is evaluated outside it, and all steps in one method would pass the JVM's limit.

    The column is named twice, so that what it stands for is not moved into the lambda.
    """
    return df.withColumn(name, F.element_at(F.transform(F.array(name, name), lambda v: v), 1))


def _step(df: DataFrame) -> DataFrame:
    """One step: what is left over the slope, corrected by the second and third derivatives."""
    at = _unit_price(df, "_m", "_s", "_v").withColumn("_h2", F.expr("_x * _x / (_v * _v * _v) - _v / 4D"))
    at = at.withColumns(
        {
            "_h3": F.expr("_h2 * _h2 - 3D * _x * _x / (_v * _v * _v * _v) - 0.25D"), "_l": F.expr("ln(try_divide(_m, _half))"),
            "_r": F.expr("CASE WHEN _low THEN try_divide(_s, _m) WHEN _high THEN try_divide(_s, _half - _m) END"),
        }
    )
    left = (
        "CASE WHEN _low THEN try_divide((try_divide(1D, _l) - try_divide(1D, ln(_c / _half))) * _l * _l, -_r)"
        " WHEN _high THEN try_divide(ln(try_divide(_half - _m, _half - _c)), -_r) ELSE try_divide(_m - _c, _s) END"
    )
    second = "CASE WHEN _low THEN _h2 - _r * (1D + try_divide(2D, _l)) WHEN _high THEN _h2 + _r ELSE _h2 END"
    third = (
        "CASE WHEN _low THEN _h3 - 3D * _r * _h2 * (1D + try_divide(2D, _l)) + _r * _r * (2D + try_divide(6D, _l) + try_divide(6D, _l * _l))"
        " WHEN _high THEN _h3 + 3D * _r * _h2 + 2D * _r * _r ELSE _h3 END"
    )
    at = at.withColumns({"_nu": F.expr(left), "_a": F.expr(second), "_b": F.expr(third)})
    move = F.expr("try_divide(_nu * (1D - 0.5D * _nu * _a), 1D - _nu * (_a - _b * _nu / 6D))")
    at = at.withColumn("_move", F.when(F.abs(move) < float("inf"), move).otherwise(0.0))  # not for NaN either
    return at.withColumn("_v", F.expr(f"least(greatest(least(greatest(_v - _move, _v / 3D), _v * 3D), {MIN_VOL}D), {MAX_VOL}D)")).drop(
        "_m", "_s", "_h2", "_h3", "_l", "_r", "_nu", "_a", "_b", "_move"
    )


def with_total_vol(df: DataFrame, name: str, price: Column, forward: Column, strike: Column, discount: Column, right: Column) -> DataFrame:
    """Add the total volatility of a price; null where none gives it. Never raises.

    Prices on or outside the no-arbitrage bounds, and anything null, NaN or of
    another right, have none.
    """
    given = {"_p": price, "_f": forward, "_k": strike, "_d": discount}
    staged = df.withColumns({n: c.cast("double") for n, c in given.items()} | {"_side": F.when(right == "call", 1.0).when(right == "put", -1.0)})
    inside = (
        f"_p > _d * greatest(_side * (_f - _k), 0D) + {MARGIN}D AND _p < _d * (CASE WHEN _side > 0 THEN _f ELSE _k END) - {MARGIN}D"
        " AND _d > 0 AND _f > 0 AND _k > 0 AND _f < double('infinity') AND _k < double('infinity') AND _d < double('infinity')"
    )
    staged = staged.withColumn("_unit", F.expr(f"CASE WHEN {inside} THEN _d * sqrt(_f * _k) END"))
    staged = staged.withColumns(
        {"_c": F.expr("(_p - _d * greatest(_side * (_f - _k), 0D)) / _unit"), "_x": F.expr("CASE WHEN _unit IS NOT NULL THEN -abs(ln(_f / _k)) END")}
    ).withColumn("_half", F.expr("exp(_x / 2D)"))
    solved = _cut(_start(staged), "_v")
    for _ in range(STEPS):
        solved = _cut(_step(solved), "_v")
    proved = _unit_price(solved, "_m", "_s", "_v")
    missed = f"abs(_m - _c) * _unit / greatest(_p, {LEAST_PRICE}D)"
    return proved.withColumn(name, F.expr(f"CASE WHEN {missed} < {RESIDUAL}D THEN _v END")).drop(
        *given, "_side", "_unit", "_c", "_x", "_half", "_low", "_high", "_v", "_m", "_s"
    )


def with_implied_vol(df: DataFrame, name: str, price: Column, forward: Column, strike: Column, tenor: Column, discount: Column, right: Column) -> DataFrame:
    """Add the annualised volatility; null where there is no total one, or no time left."""
    staged = with_total_vol(df.withColumn("_tenor", tenor.cast("double")), "_total", price, forward, strike, discount, right)
    return staged.withColumn(name, F.when(F.col("_tenor") > 0, F.col("_total") / F.sqrt("_tenor"))).drop("_tenor", "_total")


def prepare(quotes: DataFrame) -> DataFrame:
    """Add implied_vol, total_variance and the vega a smile fit weighs by."""
    solved = with_implied_vol(
        quotes, "implied_vol", F.col("mid"), F.col("forward"), F.col("strike"), F.col("tenor_years"), F.col("discount"), F.col("option_right")
    )
    return solved.withColumn("total_variance", F.col("implied_vol") * F.col("implied_vol") * F.col("tenor_years")).withColumn(
        "vega",
        black76.vega(
            F.col("forward"), F.col("strike"),
            F.col("implied_vol") * F.sqrt(F.greatest("tenor_years", F.lit(0.0))), F.col("discount"),
        ),
    )
