"""Black-76 in total volatility ``v = sigma * sqrt(T)``, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normal import norm_pdf, with_norm_cdf

CALL = "call"
PUT = "put"
_INF = float("inf")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _side(right) -> Column:
    """+1 for a call and -1 for a put; a right that is neither has no price."""
    if isinstance(right, str):
        if right not in (CALL, PUT):
            raise ValueError(f"right must be {CALL!r} or {PUT!r}, got {right!r}")
        return F.lit(1.0 if right == CALL else -1.0)
    return F.when(right == CALL, 1.0).when(right == PUT, -1.0)


def d1(forward, strike, total_vol) -> Column:
    """First Black argument; the limit of zero volatility is signed infinity."""
    log_fk = F.ln(F.try_divide(_col(forward), _col(strike)))
    v = F.nanvl(F.coalesce(_col(total_vol), F.lit(0.0)), F.lit(0.0))
    return (
        F.when(v > 0, (log_fk + v * v * 0.5) / v)
        .when(log_fk > 0, F.lit(_INF))
        .when(log_fk < 0, F.lit(-_INF))
        .otherwise(F.lit(0.0))
    )


def d2(forward, strike, total_vol) -> Column:
    v = F.nanvl(F.coalesce(_col(total_vol), F.lit(0.0)), F.lit(0.0))
    return F.when(v > 0, d1(forward, strike, total_vol) - v).otherwise(
        d1(forward, strike, total_vol)
    )


def with_price(df: DataFrame, name: str, forward, strike, total_vol, discount=1.0, right=CALL) -> DataFrame:
    """Add a column of discounted option prices. One signed formula covers both rights."""
    v = F.nanvl(F.coalesce(_col(total_vol), F.lit(0.0)), F.lit(0.0))
    staged = df.withColumns(
        {"_f": _col(forward), "_k": _col(strike), "_v": v, "_s": _side(right), "_d": _col(discount)}
    ).withColumn("_d1", d1(F.col("_f"), F.col("_k"), F.col("_v")))
    far = F.when(F.col("_v") > 0, F.col("_d1") - F.col("_v")).otherwise(F.col("_d1"))
    priced = with_norm_cdf(staged, {"_n1": F.col("_s") * F.col("_d1"), "_n2": F.col("_s") * far})
    return priced.withColumn(name, F.expr("_d * _s * (_f * _n1 - _k * _n2)")).drop(
        "_f", "_k", "_v", "_s", "_d", "_d1", "_n1", "_n2"
    )


def vega(forward, strike, total_vol, discount=1.0, tenor=None) -> Column:
    """dPrice/dv, or dPrice/dsigma when a tenor is given."""
    base = _col(discount) * _col(forward) * norm_pdf(d1(forward, strike, total_vol))
    return base if tenor is None else base * F.sqrt(_col(tenor))


def price_bounds(forward, strike, discount=1.0, right=CALL) -> tuple[Column, Column]:
    """No-arbitrage range: the zero-volatility and infinite-volatility limits."""
    f, k, d, s = _col(forward), _col(strike), _col(discount), _side(right)
    return d * F.greatest(s * (f - k), F.lit(0.0)), d * F.when(s > 0, f).otherwise(k)
