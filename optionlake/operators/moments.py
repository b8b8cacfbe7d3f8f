"""Moments of the terminal price by two routes that share only the smile.

*Density*: integrate powers of ln(S/F) against the closed-form density.
*Spanning*: integrate out-of-the-money option prices (Carr-Madan weights, the
Bakshi-Kapadia-Madan contracts), touching neither the density nor its formula.

Both run over one grid, in numpy inside the tasks: the 2,001 density nodes are every second node
of the 4,001 spanning nodes, since both use the same half-width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grid
from ..functions.svi import PDF_FLOOR
from .density import NODES, SPAN_NODES, with_half_width

# Fixed value: scale floor of a relative comparison.
RELATIVE_FLOOR = 1e-6
_TINY = 1e-300


def _shape(mean: Column, m2: Column, m3: Column, m4: Column) -> tuple[Column, Column, Column]:
    """Central variance, skewness and (non-excess) kurtosis from raw moments."""
    var = m2 - mean * mean
    sd = F.sqrt(F.greatest(var, F.lit(_TINY)))
    third = m3 - mean * m2 * 3.0 + mean * mean * mean * 2.0
    fourth = m4 - mean * m3 * 4.0 + mean * mean * m2 * 6.0 - mean * mean * mean * mean * 3.0
    return var, F.try_divide(third, sd * sd * sd), F.try_divide(fourth, sd * sd * sd * sd)


#: Smiles whose grids are in memory at once.
CHUNK = 16
SUMS = (
    "mass", "min_pdf", "max_pdf", "implied_forward", *(f"log_{p}" for p in range(1, 5)), *(f"rel_{p}" for p in range(1, 5)),
    *(f"span_{p}" for p in range(1, 5)),
)


def _sums(p: dict[str, np.ndarray]) -> np.ndarray:
    """``SUMS`` of a few smiles whose parameters are given as columns of numbers."""
    n, forward, discount, half = SPAN_NODES, p["forward"], p["discount"], p["half_width"]
    step = half * 2.0 / (n - 1)
    k = step * np.arange(n) - half
    strike = forward * np.exp(k)
    w, slope, bend = grid.variance(p, k)
    vol = np.sqrt(np.maximum(w, PDF_FLOOR))
    side = np.where(k >= 0, 1.0, -1.0)
    d1 = (np.log(forward / strike) + vol * vol * 0.5) / vol
    price = discount * side * (forward * grid.norm_cdf(side * d1) - strike * grid.norm_cdf(side * (d1 - vol)))
    o = price * grid.simpson(n, strike, step) / (strike * strike * discount)
    span = (-o, o * (1.0 - k) * 2.0, o * (k * 6.0 - k * k * 3.0), o * (k * k * 12.0 - k * k * k * 4.0))
    k, strike = k[:, ::2], strike[:, ::2]
    pdf = grid.pdf(k, w[:, ::2], slope[:, ::2], bend[:, ::2], forward)
    q = pdf * grid.simpson(NODES, strike, half * 2.0 / (NODES - 1))
    u, none = strike / forward - 1.0, np.isnan(pdf)
    low = np.where(none.all(1), np.nan, np.min(np.where(none, np.inf, pdf), 1))
    return np.stack(
        [q.sum(1), low, pdf.max(1), (q * strike).sum(1), *((q * x**e).sum(1) for x in (k, u) for e in range(1, 5)), *(x.sum(1) for x in span)], 1
    )


def _integrated():
    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SUMS]))
    def run(a: pd.Series, b: pd.Series, rho: pd.Series, m: pd.Series, sigma: pd.Series, forward: pd.Series, discount: pd.Series, half_width: pd.Series) -> pd.DataFrame:
        given = {"a": a, "b": b, "rho": rho, "m": m, "sigma": sigma, "forward": forward, "discount": discount, "half_width": half_width}
        columns = {n: c.to_numpy("float64")[:, None] for n, c in given.items()}
        with np.errstate(all="ignore"):
            parts = [_sums({n: c[at : at + CHUNK] for n, c in columns.items()}) for at in range(0, len(a), CHUNK)]
        return pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, len(SUMS))), columns=list(SUMS))

    return run


def integrals(smiles: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """Every integral of both routes, one row per smile.

    Smiles are spread over the tasks and a task works through a few grids at a
    time, so no node ever is a row. ``carry`` columns ride along. A smile
    without parameters has NULL integrals.
    """
    ready = with_half_width(smiles, keys)
    given = [F.col(c).cast("double") for c in ("a", "b", "rho", "m", "sigma", "forward", "discount", "half_width")]
    summed = ready.withColumn("_sums", _integrated()(*given))
    known = F.col("a").isNotNull()
    return summed.select(
        *keys, *[c for c in dict.fromkeys(["forward", *carry]) if c not in keys],
        *[F.when(known, F.col("_sums")[n]).alias(n) for n in SUMS],
    )


def moments(smiles: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """Density diagnostics and the moments of both routes, one row per smile.

    ``bl_*`` are log-space moments of the density, ``bkm_*`` those of the
    spanning route (its mean is the forward), ``px_*`` price-space moments.
    Density moments are normalised by the measured mass, and are NULL without
    one to normalise by.
    """
    sums = integrals(smiles, keys, carry)
    usable = (F.col("mass") > 0) & ~F.isnan("mass") & (F.col("mass") < float("inf"))

    def normed(prefix: str) -> list[Column]:
        return [F.when(usable, F.col(f"{prefix}_{p}") / F.col("mass")) for p in range(1, 5)]

    log_m, rel_m = normed("log"), normed("rel")
    bl, px = _shape(*log_m), _shape(*rel_m)
    bkm = _shape(*[F.col(f"span_{p}") for p in range(1, 5)])
    forward = F.col("forward")
    out = sums.select(
        *keys, *carry, "mass", "min_pdf", "max_pdf", "implied_forward",
        log_m[0].alias("bl_mean"), bl[0].alias("bl_variance"), bl[1].alias("bl_skewness"), bl[2].alias("bl_kurtosis"),
        forward.alias("bkm_mean"), bkm[0].alias("bkm_variance"), bkm[1].alias("bkm_skewness"), bkm[2].alias("bkm_kurtosis"),
        (forward * (rel_m[0] + 1.0)).alias("px_mean"), (forward * forward * px[0]).alias("px_variance"),
        px[1].alias("px_skewness"), px[2].alias("px_kurtosis"),
    )
    return out.withColumn(
        "bl_bkm_gap",
        F.greatest(*[F.abs(relative(f"bl_{f}", f"bkm_{f}")) for f in ("variance", "skewness", "kurtosis")]),
    )


def relative(left: str, right: str) -> Column:
    """Signed difference over the larger size, floored so noise stays noise."""
    a, b = F.col(left), F.col(right)
    return (a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(RELATIVE_FLOOR))


def relative_to(frame: DataFrame, keys: list[str], left: str = "bl", right: str = "bkm") -> DataFrame:
    fields = ("mean", "variance", "skewness", "kurtosis")
    return frame.select(*keys, *[relative(f"{left}_{f}", f"{right}_{f}").alias(f) for f in fields])


def volatility(variance: Column) -> Column:
    return F.when(variance.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0))))


def annualised_vol(variance: Column, tenor: Column) -> Column:
    return F.when(tenor > 0, volatility(variance) / F.sqrt(tenor))
